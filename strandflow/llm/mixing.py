"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source_size. The copies are drawn
systematically: documents are put in a fixed order, the expected copies are prefix-summed within the source, one random
offset of the source is added, and a document is emitted once for each integer that its interval crosses. Ordering by
size first stratifies the draw, so the words taken stay near the target.

The prefix sum never gathers a source in one task. A source is cut into cells (eighths of an octave of size, times 64
parts of a hash); counts of cells are summed map-side and prefix-summed (at most some thousands of rows a source), ranks
are taken within a cell, and both are added.

Defined cases: null text has size 0 and is never taken; a source of size 0 has target 0; null source is a source of its own,
last in order; a null doc_id orders like an empty one; repeated rows are documents of their own; an empty table gives an
empty result; other columns are ignored (mix_sizes) or carried along (mixed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.llm.common import WORD, table

WEIGHTS = (5, 2, 1)
CAP = 3


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(mx_key, source, source_size) with the target of each source.

    The excess of capped sources is reshared by weight until none is above its cap. With sources ordered by cap / weight
    the capped ones are a prefix, so prefix sums find the fixed point in one pass over one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    # exact for the weights' ratios: cap * size / weight is compared as integers scaled by all weights
    scale = 1
    for x in weights:
        scale *= x
    s = sizes.withColumn("w", w.cast("long")).withColumn("ratio", F.col("source_size") * cap * scale / F.col("w"))
    ahead = W.orderBy("ratio", "w", F.col("source").isNull(), "source")
    before = ahead.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("whole"),
        F.sum("w").over(every).alias("w_all"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    # level if all sources before this one are capped; the first source whose cap reaches it sets the level of the rest
    s = s.withColumn("level", (F.col("whole") - cap * F.col("s_before")) / (F.col("w_all") - F.col("w_before")))
    s = s.withColumn("fits", F.col("source_size") * cap >= F.col("w") * F.col("level"))
    s = s.withColumn("level", F.min(F.when(F.col("fits"), F.struct("ratio", "w_before", "level"))).over(every)["level"])
    target = F.least(F.col("w") * F.col("level"), (F.col("source_size") * cap).cast("double"))
    return s.select("mx_key", "source", "source_size", target.alias("target"))


def draw(docs: DataFrame, keep: list[str], weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """mx_row (a struct of the columns keep of docs, so that no name clashes), mx_size, mx_source_size, mx_target and mx_copies."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bits = F.length(F.bin(F.col("mx_size")))
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("mx_row"),
        size.alias("mx_size"),
        h.alias("mx_h"),
        F.col("doc_id").alias("mx_id"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("mx_key"),
        F.col("source").alias("mx_source"),
    )
    d = d.withColumns({
        "mx_bin": (bits * 16 + F.expr("shiftright(mx_size, greatest(length(bin(mx_size)) - 4, 0))")).cast("int"),
        "mx_part": F.shiftright(F.conv(F.substring("mx_h", 1, 2), 16, 10).cast("int"), 2),
    })
    cell = ["mx_key", "mx_bin", "mx_part"]
    # counted from the table itself, so that only three narrow columns are read and carried
    cells = d.groupBy("mx_source", *cell).agg(F.count(F.lit(1)).alias("n"), F.sum("mx_size").alias("words"))
    sums = cells.groupBy("mx_key", F.col("mx_source").alias("source")).agg(F.sum("words").alias("source_size"))
    aim = targets(sums, weights, cap).select(
        F.col("mx_key").alias("k"), F.col("source_size").alias("mx_source_size"), F.col("target").alias("mx_target")
    )
    before = W.partitionBy("mx_key").orderBy("mx_bin", "mx_part").rowsBetween(W.unboundedPreceding, -1)
    start = cells.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mx_start"))
    start = start.join(aim, start["mx_key"] == aim["k"]).drop("k")
    ranked = d.withColumn("mx_rank", F.row_number().over(W.partitionBy(*cell).orderBy("mx_size", "mx_h", "mx_id")))
    out = ranked.join(start, cell)
    return out.select("mx_row", "mx_size", "mx_source_size", "mx_target", copies().alias("mx_copies"))


def copies() -> Column:
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), "mx_key").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rho = F.when(F.col("mx_source_size") > 0, F.col("mx_target") / F.col("mx_source_size")).otherwise(F.lit(0.0))
    at = F.col("mx_start") + F.col("mx_rank")
    return F.when(F.col("mx_size") > 0, F.floor(u + at * rho) - F.floor(u + (at - 1) * rho)).otherwise(F.lit(0)).cast("long")


def mix_sizes(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of docs."""
    d = draw(docs.select("doc_id", "text", "source"), ["doc_id"], weights, cap)
    return d.select(
        "mx_row.doc_id",
        F.col("mx_size").alias("size"),
        F.col("mx_source_size").cast("long").alias("source_size"),
        F.col("mx_target").alias("target"),
        (F.col("mx_copies") * F.col("mx_size")).alias("taken"),
        F.col("mx_copies").alias("copies"),
    )


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each row of docs as often as it is drawn, with the columns of docs."""
    d = draw(docs, docs.columns, weights, cap).filter("mx_copies > 0")
    d = d.withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("mx_copies").cast("int"))))
    return d.select("mx_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def ctes(docs: str, p: str = "", w: tuple = WEIGHTS, cap: int = CAP) -> str:
    """DuckDB's common table expressions, ending in {p}drawn: the rows of docs with size, source_size, target, copies."""
    scale = 1
    for x in w:
        scale *= x
    return f"""
{p}d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS mx_size, md5(coalesce(doc_id::VARCHAR, '')) AS mx_h,
    coalesce('s' || source, 'n') AS mx_key FROM {docs}),
{p}b AS (SELECT *, length(bin(mx_size)) * 16 + (mx_size >> greatest(length(bin(mx_size)) - 4, 0)) AS mx_bin, ('0x' || substr(mx_h, 1, 2))::INT >> 2 AS mx_part FROM {p}d),
{p}s AS (SELECT mx_key, source, sum(mx_size)::BIGINT AS source_size FROM {p}d GROUP BY ALL),
{p}w AS (SELECT *, ([{', '.join(map(str, w))}])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(w)} + 1)::INT]::BIGINT AS w FROM {p}s),
{p}r AS (SELECT *, source_size * {cap * scale} / w AS ratio FROM {p}w),
{p}c AS (SELECT *, sum(source_size) OVER () AS whole, sum(w) OVER () AS w_all,
    coalesce(sum(source_size) OVER o, 0) AS s_before, coalesce(sum(w) OVER o, 0) AS w_before FROM {p}r
    WINDOW o AS (ORDER BY ratio, w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}l AS (SELECT *, (whole - {cap} * s_before)::DOUBLE / (w_all - w_before)::DOUBLE AS level FROM {p}c),
{p}t AS (SELECT mx_key, source_size, least(w * (SELECT level FROM {p}l WHERE source_size * {cap} >= w * level ORDER BY ratio, w_before LIMIT 1), ({cap} * source_size)::DOUBLE) AS target FROM {p}l),
{p}n AS (SELECT {p}b.*, source_size, target, row_number() OVER (PARTITION BY mx_key ORDER BY mx_bin, mx_part, mx_size, mx_h, doc_id) AS mx_at,
    ('0x' || substr(md5('mix:' || mx_key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS mx_u, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END AS mx_rho FROM {p}b JOIN {p}t USING (mx_key)),
{p}drawn AS (SELECT *, CASE WHEN mx_size > 0 THEN (floor(mx_u + mx_at::DOUBLE * mx_rho) - floor(mx_u + (mx_at - 1)::DOUBLE * mx_rho))::BIGINT ELSE 0 END AS mx_copies FROM {p}n)"""


SQL = f"WITH {ctes('documents')} SELECT doc_id, mx_size AS size, source_size, target, mx_copies * mx_size AS taken, mx_copies AS copies FROM drawn"
