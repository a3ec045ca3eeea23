from fluvial import storage
from fluvial.operators import spatial as sp


def test_few_bytes_of_boxes_are_joined_in_all_tasks(spark, monkeypatch):
    # Tables as large as these few would be merged into one task.
    monkeypatch.setattr(storage, "MERGED_BYTES", 0)
    rows = [(i, float(i * 37 % 10), float(i * 53 % 10), i * 37 % 10 + 3.0, i * 53 % 10 + 3.0) for i in range(60)]
    boxes = spark.createDataFrame(rows, "tile_ord long, x0 double, y0 double, x1 double, y1 double")
    out = sp.overlapping_boxes(boxes, boxes, "tile_ord", "tile_ord", margin=1.0)
    want = sorted((a[0], b[0]) for a in rows for b in rows if all(a[k] - 1 <= b[k + 2] and b[k] <= a[k + 2] + 1 for k in (1, 2)))
    assert sorted(tuple(r) for r in out.collect()) == want
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
