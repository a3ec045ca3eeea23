"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "fluvial", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, UTC and skew handling on; ``conf`` overrides.

    Shuffle partitions are left to the cluster's setting, since adaptive
    execution coalesces them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
