"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides (operator 12).

Everything on the main path is a DataFrame expression; the driver holds the
parameters of the two models only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

#: Kinds in the order in which spans of one start are listed (fixed values).
KINDS = ("email", "ip", "card", "phone")

#: The base patterns (fixed values), with possessive repeats and a look behind
#: where they find the same spans: then a long run is read once, not from each
#: of its characters, and no repeat recurses.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Further candidates: written-out addresses, and cards and phone numbers that a base match has swallowed or that lack its mark.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3}) ?[.-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}

#: A text without these has no wider candidate of the kind.
_NEEDS = {"email": r"[\[({]at[\])}]", "ip": r"[\[(]\.[\])]", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Gazetteers (fixed values): top-level domains, card issuers' first digits, telephone country codes.
DOMAINS = "com|net|org|edu|gov|mil|int|info|biz|io|eu|us|uk|de|fr|es|it|nl|ch|at|be|ca|au|jp|cn|in|br|mx|se|no|dk|fi|pl|pt|ie"
ISSUERS = r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6011|64[4-9]|65|35(?:2[89]|[3-8])|3(?:0[0-5]|[689])|62"
COUNTRIES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]"

#: Words before a span that speak for its kind, in four languages, and words that speak for another number (fixed values).
CUES = {
    "email": r"e-?mail|mail|courriel|correo|contact|kontakt|contacto|write|schreib|écri|escrib",
    "ip": r"\bip\b|host|server|serveur|servidor|address|adresse|direcci|login",
    "card": r"card|karte|carte|tarjeta|visa|master|credit|kredit|crédit|crédito|payment|zahlung|paiement|pago",
    "phone": r"phone|tel|call|fax|mobil|handy|appel|llam|anruf|contact|kontakt",
}
AGAINST = r"version|build|release|order|bestell|commande|pedido|invoice|rechnung|facture|factura|isbn|serial|\bno\b|\bid\b|total|sum|token|hash|sku"


@dataclass(frozen=True)
class PiiParameters:
    """``threshold`` is the least probability of an added span. Rounds of EM and of the classifier's descent."""

    threshold: float = 0.9
    em_rounds: int = 12
    fit_rounds: int = 10


_STEP = 256


def fold(items: Column, state: Column, emitted: str, step) -> Column:
    """What ``step(state, item) -> (state, array)`` emits over an array, in order.

    Goes by blocks, so that appending takes time in proportion to the array.
    """
    none = F.array().cast(f"array<{emitted}>")
    blocks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _STEP).cast("int")), lambda b: F.slice(items, b * _STEP + 1, _STEP)))

    def one(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, rows: Column) -> Column:
        inner = F.aggregate(rows, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        # Through an array of one, so that the inner fold is evaluated once.
        return F.transform(F.array(inner), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{emitted}>>").alias("out"))
    return F.coalesce(F.flatten(F.aggregate(blocks, start, block)["out"]), none)


_SPAN = "struct<first:int,last:int,hit:string,before:string,after:string>"


def with_matches(docs: DataFrame, patterns: dict[str, str], needs: dict[str, str] | None = None) -> DataFrame:
    """``docs`` (with ``text``, not null) and for each pattern its matches: places in code points, end exclusive, and what surrounds them."""
    raw = docs
    for name, pattern in patterns.items():
        some = F.col("text").rlike(needs[name]) if needs else F.lit(True)
        raw = raw.withColumn(f"_f_{name}", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    # The gaps only where there are matches.
    cut = raw.select("*", *[F.when(F.size(f"_f_{n}") > 0, F.split("text", p, -1)).alias(f"_g_{n}") for n, p in patterns.items()])

    def item(name: str):
        gaps = F.col(f"_g_{name}")
        return lambda hit, i: F.struct(F.char_length(gaps[i]).alias("skip"), hit.alias("hit"), F.substring(gaps[i], -32, 32).alias("before"), F.substring(gaps[i + 1], 1, 8).alias("after"))

    items = cut.select(*docs.columns, *[F.when(F.size(f"_f_{n}") > 0, F.transform(f"_f_{n}", item(n))).otherwise(F.array().cast("array<struct<skip:int,hit:string,before:string,after:string>>")).alias(f"_i_{n}") for n in patterns])

    def place(at: Column, r: Column):
        first = at + r["skip"]
        last = first + F.char_length(r["hit"])
        return last, F.array(F.struct(first.alias("first"), last.alias("last"), r["hit"].alias("hit"), r["before"].alias("before"), r["after"].alias("after")))

    return items.select(*docs.columns, *[fold(F.col(f"_i_{n}"), F.lit(0), _SPAN, place).alias(n) for n in patterns])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes(kind: str, hit: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(_digits(hit)).between(14, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.char_length(_digits(hit)).between(10, 15)
    return F.lit(True)


#: Labelers: format, checksum or range, gazetteer, context, edges.
LABELERS = ("rule", "check", "gazetteer", "context", "edge")


def votes(kind: str, s: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1 for its kind, -1 against, 0 none. Of a span beyond any format's length the first part is judged."""
    hit, before, after = F.substring(s["hit"], 1, 400), s["before"], s["after"]
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    plain = F.regexp_replace(F.regexp_replace(hit, r" ?[\[({]at[\])}] ?", "@"), r" ?(?:[\[({]dot[\])}]|[\[(]\.[\])]) ?", ".")
    rule = {
        "email": plain.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$"),
        "ip": plain.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"),
        "card": hit.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"),
        "phone": hit.rlike(r"^(?:\+[0-9]{10,15}|(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4})$"),
    }[kind]
    check = {
        "email": F.lit(0) + F.when(plain.rlike(r"\.\.|[.-]@|@-|-\.|@.*@"), -1).otherwise(1),
        "ip": yes_no(passes("ip", plain)),
        "card": yes_no(passes("card", s["hit"])),
        "phone": yes_no(passes("phone", s["hit"])),
    }[kind]
    gazetteer = {
        "email": F.when(F.lower(plain).rlike(rf"\.(?:{DOMAINS})$"), 1).otherwise(0),
        "ip": F.when(plain.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-9])\."), -1).otherwise(1),
        "card": yes_no(_digits(hit).rlike(f"^(?:{ISSUERS})")),
        "phone": F.when(hit.startswith("+"), F.when(_digits(hit).rlike(f"^(?:{COUNTRIES})"), 1).otherwise(-1)).otherwise(0),
    }[kind]
    low = F.lower(before)
    return {
        "rule": yes_no(rule & (F.char_length(s["hit"]) <= 320)),
        "check": check,
        "gazetteer": gazetteer,
        "context": F.when(low.rlike(CUES[kind]), 1).when(low.rlike(AGAINST), -1).otherwise(0),
        "edge": yes_no(~before.rlike(r"[\p{L}0-9_]$") & ~after.rlike(r"^[\p{L}0-9_]")),
    }


def _candidate(kind: str, s: Column, base: Column) -> Column:
    found = votes(kind, s)
    long = F.when(F.char_length(s["hit"]) < 12, 0).when(F.char_length(s["hit"]) < 18, 1).when(F.char_length(s["hit"]) < 26, 2).otherwise(3)
    return F.struct(
        s["first"].alias("first"), F.lit(KINDS.index(kind)).alias("kind"), s["last"].alias("last"), base.alias("base"),
        *[v.cast("int").alias(k) for k, v in found.items()], long.alias("long"), s["hit"].rlike("[ ().-]").cast("int").alias("parts"),
    )


_FEATURES = [*LABELERS, "long", "parts"]
_CANDIDATE = "array<struct<first:int,kind:int,last:int,base:boolean," + ",".join(f"{f}:int" for f in _FEATURES) + ">>"
#: Values of each feature from its least one; all features are one-hot.
_LEAST, _VALUES = {f: -1 for f in LABELERS} | {"long": 0, "parts": 0}, {f: 3 for f in LABELERS} | {"long": 4, "parts": 2}
_OFFSET = {f: sum(_VALUES[g] for g in _FEATURES[:i]) for i, f in enumerate(_FEATURES)}
_WIDTH = sum(_VALUES.values())


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all candidates of each row, base spans among them, in the order of their places."""
    text = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = with_matches(text, BASE)
    both = with_matches(found.withColumnsRenamed({k: f"base_{k}" for k in KINDS}), WIDER, _NEEDS)
    none = F.array().cast(_CANDIDATE)
    lists = []
    for kind in KINDS:
        lists.append(F.transform(f"base_{kind}", lambda s: _candidate(kind, s, passes(kind, s["hit"]))))  # noqa: B023
        lists.append(F.transform(kind, lambda s: _candidate(kind, s, F.lit(False))))  # noqa: B023
    return both.select("doc_id", F.concat(none, *[F.coalesce(x.cast(_CANDIDATE), none) for x in lists]).alias("found"))


def _picked(weights: list[list[float]], row: str = "") -> str:
    """SQL for the sum of the weights of a row's features; ``weights`` has one list a kind."""
    flat = "array(" + ",".join(f"{float(w)!r}D" for ws in weights for w in ws) + ")"
    return "(" + " + ".join(f"{flat}[{row}kind * {_WIDTH} + {_OFFSET[f] - _LEAST[f]} + {row}{f}]" for f in _FEATURES) + ")"


def _hot(features: list[str] | tuple[str, ...]) -> dict[tuple[str, int], str]:
    """SQL of the indicator of each feature value."""
    return {(f, v): f"int({f} = {v + _LEAST[f]})" for f in features for v in range(_VALUES[f])}


def _by_kind(df: DataFrame, weight: str, sums: dict[tuple[str, int], str]) -> dict[int, dict[tuple[str, int] | str, float]]:
    """Sums of ``weight`` over each kind, and over its rows with each feature value; a row a kind is collected."""
    exprs = [F.expr("sum(w) AS total"), *[F.expr(f"sum(w * {sql}) AS {f}{v}") for (f, v), sql in sums.items()]]
    rows = df.withColumn("w", F.expr(weight)).groupBy("kind").agg(*exprs).collect()
    return {r["kind"]: {"total": r["total"]} | {(f, v): r[f"{f}{v}"] for f, v in sums} for r in rows}


def _first_odds() -> list[list[float]]:
    """Every labeler is right six times as often as wrong."""
    vote = [-math.log(6.0), 0.0, math.log(6.0)]
    return [[vote[i % 3] if i < _OFFSET["long"] else 0.0 for i in range(_WIDTH)] for _ in KINDS]


def weigh_labelers(patterns: DataFrame, p: PiiParameters) -> list[list[float]]:
    """Log odds that each vote adds, by expectation-maximisation over the counted vote patterns.

    Labelers err independently, given whether a span is of its kind; each
    starts as right more often than not. The last feature carries the log odds
    of the kind's share. What is counted is every candidate of the corpus; what
    is collected is a row a kind.
    """
    odds, hot = _first_odds(), _hot(LABELERS)
    every = _by_kind(patterns, "n", hot)
    for _ in range(p.em_rounds):
        grown = [list(o) for o in odds]
        for k, yes in _by_kind(patterns, f"n / (1 + exp(-{_picked(odds)}))", hot).items():
            n, s = every[k]["total"], yes["total"]
            for f, v in hot:
                one, zero = (yes[f, v] + 1) / (s + 3), (every[k][f, v] - yes[f, v] + 1) / (n - s + 3)
                grown[k][_OFFSET[f] + v] = math.log(one / max(zero, 1e-9))
            grown[k][_OFFSET["parts"]] = grown[k][_OFFSET["parts"] + 1] = math.log((s + 1) / (n - s + 1))
        moved = max(abs(a - b) for x, y in zip(odds, grown, strict=True) for a, b in zip(x, y, strict=True))
        odds = grown
        if moved < 1e-3:
            break
    return odds


def fit_classifier(patterns: DataFrame, odds: list[list[float]], p: PiiParameters) -> list[list[float]]:
    """Weights of a logistic span classifier a kind, fitted to the labelers' posteriors.

    Its features are the votes and the span's length and shape. It starts from
    labelers that are equally good and is held there by a weak ridge, so that
    feature values no candidate has keep their meaning. Each step moves every
    weight by its gradient over a bound of its curvature: the loss never rises
    and no rate has to be chosen.
    """
    hot, ridge, first = _hot(_FEATURES), 0.1, _first_odds()
    size = _by_kind(patterns, "n", hot)
    weights = [list(o) for o in first]
    for _ in range(p.fit_rounds):
        miss = f"n * (1 / (1 + exp(-{_picked(odds)})) - 1 / (1 + exp(-{_picked(weights)})))"
        for k, slope in _by_kind(patterns, miss, hot).items():
            for f, v in hot:
                at = _OFFSET[f] + v
                weights[k][at] += (slope[f, v] - ridge * (weights[k][at] - first[k][at])) / (0.25 * len(_FEATURES) * size[k][f, v] + ridge)
    return weights


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["first"].cast("string"), s["last"].cast("string"))), ",")


_FOUND = "struct<first:int,kind:int,last:int>"


def find_personal_data(docs: DataFrame, params: PiiParameters | None = None) -> DataFrame:
    """Spans of personal data: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and ``base_sha256`` are of the base spans; ``spans`` also has
    the candidates that the classifier accepts and that overlap no base span
    and no earlier accepted one. Places are code points. A null or empty text
    has no spans; rows that repeat an id are rows each, null ids are kept. The
    labelers' reliabilities and the classifier are learnt from all candidates
    of the table; an empty table gives no rows. Other columns are ignored.
    """
    p = params or PiiParameters()
    ws = Workspace(docs.sparkSession, "pii")
    rows = ws.keep(candidates(docs.select("doc_id", "text")), "candidates")
    one = rows.select(F.explode("found").alias("c")).select("c.kind", *[F.col(f"c.{f}").alias(f) for f in _FEATURES])
    # At most 3**5 vote patterns, 4 lengths and 2 shapes a kind.
    patterns = ws.keep(one.groupBy("kind", *_FEATURES).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    weights = fit_classifier(patterns, weigh_labelers(patterns, p), p)
    enough = math.log(p.threshold / (1 - p.threshold))
    taken = F.expr(f"filter(found, c -> c.base OR {_picked(weights, 'c.')} >= {enough!r}D)")
    span = lambda c: F.struct(c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last"))
    # Base spans before others of the same start.
    ordered = F.array_sort(F.transform(taken, lambda c: F.struct(c["first"].alias("first"), (~c["base"]).alias("added"), c["kind"].alias("kind"), c["last"].alias("last"))))
    staged = rows.select("doc_id", F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), span)).alias("base"), ordered.alias("all"))
    nothing = F.lit(None).cast(_FOUND)
    # The end of what is accepted, and an accepted span that a base span may still overlap.
    state = F.struct(F.lit(0).alias("reach"), nothing.alias("open"))

    def step(s: Column, c: Column):
        over = s["reach"] > c["first"]
        fits, is_open = c["added"] & ~over, s["open"].isNotNull()
        hit = is_open & (s["open"]["last"] > c["first"])
        after = F.when(fits, F.struct(c["last"].alias("reach"), span(c).alias("open")))
        after = after.when(c["added"], s).otherwise(F.struct(F.when(hit, c["last"]).otherwise(F.greatest(s["reach"], c["last"])).alias("reach"), nothing.alias("open")))
        # An open span is settled by the next base span, or by the next accepted one.
        done = is_open & F.when(c["added"], fits).otherwise(~hit)
        return after, F.when(done, F.array(s["open"])).otherwise(F.array().cast(f"array<{_FOUND}>"))

    end = F.array(F.struct(F.lit((1 << 31) - 1).alias("first"), F.lit(False).alias("added"), F.lit(0).alias("kind"), F.lit((1 << 31) - 1).alias("last")))
    added = staged.select("doc_id", "base", F.concat("all", end).alias("all")).select("doc_id", "base", fold(F.col("all"), state, _FOUND, step).alias("added"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return added.select(
        F.col("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans")
    )


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_personal_data(table(spark, sf_dir, "documents"))
