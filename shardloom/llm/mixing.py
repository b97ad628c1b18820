"""Mixing sources to target weights by Pareto order sampling.

A source's target share gives each of its documents an expected number of
copies e.  floor(e) copies are certain; the rest f = e - floor(e) is the
inclusion probability of one more.  Of all documents with f > 0 the n with the
smallest ranking value, u/(1-u) divided by f/(1-f), get it; u is a uniform
number from a hash of the identifier, and n makes the total exactly the budget.
The n-th smallest value is found by histograms of 65536 counts over the whole
table, so nothing is sorted globally and no text is shuffled.

Defined results: a null source is a source; a row with a null identifier draws by
its text; rows that tie with the last one are ranked by a digest of all their
columns, and rows that are alike in every column are given out as one with the
copies of all, so the budget is hit exactly; null, empty and very long texts are
rows like others; identifiers keep their type; an empty table, or weights that no
source has, give an empty result; other columns, whatever their names and values,
are carried by ``mix_stage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import columns, row_key

EXPONENT = 0.5
BUDGET = 1.0
SEED = 17
BROADCAST_SOURCES = 100_000
BINS = 65536
FEW = 100_000


def uniform(digest):
    """A number between 0 and 1 from the first 52 bits of a hex digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, exponent: float = EXPONENT, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """(row, copies): how many of each row of docs the mixture has.  Target shares: ``weights``, else each source's count to the power ``exponent``."""
    said = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), row_key(id_col, text_col)["a"].cast("string")))
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.col(f"`{source_col}`").alias("source"), uniform(F.md5(F.concat(F.lit(f"{seed}:"), said))).alias("u"))
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt("n") if exponent == 0.5 else F.pow(F.col("n").cast("double"), F.lit(exponent))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col("source")] if weights else F.lit(0.0), F.lit(0.0))
    sources = sources.withColumn("w", weight)
    total = sources.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("sources")).first()
    if not total["n"] or not total["w"]:
        return rows.select("row", F.lit(0).cast("long").alias("copies"))
    size = int(budget * total["n"] + 0.5)
    sources = sources.withColumn("e", F.lit(float(size)) * F.col("w") / F.lit(float(total["w"])) / F.col("n"))
    sources = sources.select(F.col("source").alias("of"), "n", F.floor("e").alias("whole"), (F.col("e") - F.floor("e")).alias("f"))
    extra = size - (sources.agg(F.sum(F.col("n") * F.col("whole"))).first()[0] or 0)
    small = F.broadcast(sources.drop("n")) if total["sources"] <= BROADCAST_SOURCES else sources.drop("n")
    drawn = rows.join(small, F.col("source").eqNullSafe(F.col("of")))
    drawn = drawn.withColumn("q", F.when(F.col("f") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f"))))).select("row", "whole", "q")
    ranks = drawn.where("q IS NOT NULL").select("q", (F.col("q") / (1 + F.col("q"))).alias("v"))
    last, taken, equal = nth(ranks, extra)
    if last is None:
        return drawn.select("row", F.col("whole").cast("long").alias("copies"))
    if taken == equal:
        return drawn.select("row", (F.col("whole") + F.when(F.col("q") <= last, 1).otherwise(0)).cast("long").alias("copies"))
    clear = drawn.where(F.col("q").isNull() | (F.col("q") != last)).select("row", (F.col("whole") + F.when(F.col("q") < last, 1).otherwise(0)).cast("long").alias("copies"))
    digest = F.md5(F.to_json(F.struct("row"), {"ignoreNullFields": "false"}))
    tied = drawn.where(F.col("q") == last).select("row", "whole", digest.alias("digest")).withColumn("v", uniform(F.col("digest")))
    cut, taken, _ = nth(tied.select(F.col("v").alias("q"), "v"), taken)
    more = F.when(F.col("v") < cut, 1).otherwise(0) if cut is not None else F.lit(0)
    apart = tied.where(F.col("v") != cut if cut is not None else F.lit(True)).select("row", (F.col("whole") + more).cast("long").alias("copies"))
    out = clear.unionByName(apart)
    if cut is not None:
        alike = tied.where(F.col("v") == cut).groupBy("digest").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"), F.first("whole").alias("whole")).orderBy("digest")
        counts, gets = alike.select("digest", "n").collect(), {}  # rows alike in 52 bits of a digest: one group, if no digests coincide
        for r in counts:
            gets[r["digest"]] = min(taken, r["n"])
            taken -= gets[r["digest"]]
        got = F.create_map(*[F.lit(x) for kv in gets.items() for x in kv])[F.col("digest")]
        out = out.unionByName(alike.select("row", (F.col("whole") * F.col("n") + got).cast("long").alias("copies")))
    return out


def nth(ranks: DataFrame, n: int) -> tuple:
    """(the n-th smallest q, how many rows equal to it are among the first n, how many there are); (None, 0, 0) if n < 1.  v grows with q and lies in [0, 1]."""
    if n < 1:
        return None, 0, 0
    for level in (1, 2, 3):
        bin_ = F.floor(F.col("v") * float(BINS**level))
        for b, count in sorted(tuple(r) for r in ranks.groupBy(bin_.alias("b")).count().collect()):  # BINS rows at most
            if n <= count:
                ranks = ranks.where(bin_ == b)
                break
            n -= count
        else:
            return float("inf"), 0, 0
        if count <= FEW:
            break
    for q, count in ranks.groupBy("q").count().orderBy("q").collect():  # values of one bin
        if n <= count:
            return q, n, count
        n -= count
    return float("inf"), 0, 0


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, copies) of every document that the mixture has at least once."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    return with_copies(docs, **options).where("copies > 0").select(F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].alias("source"), "copies")


def mix_stage(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as many times as the mixture has it."""
    return with_copies(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE_SQL = f"""
WITH s AS (SELECT source, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
t AS (SELECT sum(n) AS n, sum(w) AS w FROM s),
e AS (SELECT source, s.n, floor(t.n * s.w / t.w / s.n) AS whole, t.n * s.w / t.w / s.n - floor(t.n * s.w / t.w / s.n) AS f FROM s, t),
x AS (SELECT (SELECT n FROM t) - sum(n * whole) AS extra FROM e),
u AS (SELECT doc_id, source, (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
q AS (SELECT doc_id, u.source, whole, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS q FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source),
r AS (SELECT *, row_number() OVER (ORDER BY q NULLS LAST, doc_id) AS place FROM q)
SELECT doc_id, source, CAST(whole + CASE WHEN q IS NOT NULL AND place <= extra THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r, x WHERE whole + CASE WHEN q IS NOT NULL AND place <= extra THEN 1 ELSE 0 END > 0
"""
