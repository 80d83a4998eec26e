"""Reads, annotations and samples derived from the driver's tables by one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common table expressions: exons(read_id, k, chr, strand, locus, s, e), anno (tx, gene instead of read_id) and rexons (the others).
BASE = """x1 AS (SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k,
    20 + 10 * (l_partkey % 3) AS width, 50 + 50 * (l_suppkey % 2) AS gap FROM lineitem),
x2 AS (SELECT *, coalesce(sum(width + gap) OVER (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x1),
exons AS (SELECT read_id, CAST(k AS BIGINT) AS k, concat('chr', CAST(read_id % 7 % 5 + 1 AS VARCHAR(9))) AS chr, CASE WHEN read_id % 3 = 0 THEN '-' ELSE '+' END AS strand, read_id % 41 AS locus,
    CAST(1000 + 700 * (read_id % 41) + off AS BIGINT) AS s, CAST(1000 + 700 * (read_id % 41) + off + width - 1 AS BIGINT) AS e FROM x2),
anno AS (SELECT concat('tx', CAST(read_id AS VARCHAR(19))) AS tx, concat('g', chr, '_', CAST(locus AS VARCHAR(9))) AS gene, read_id AS txid, k, chr, strand, locus, s, e FROM exons WHERE read_id % 10 = 0),
rexons AS (SELECT * FROM exons WHERE read_id % 10 <> 0)"""

#: In DuckDB: one row per transcript or read with its ranges as a list.
LISTS = BASE + """,
reads AS (SELECT read_id, chr, strand, locus, list({'s': s, 'e': e} ORDER BY s) AS x, min(s) AS s, max(e) AS e, count(*) AS n FROM rexons GROUP BY ALL),
txs AS (SELECT tx, gene, txid, chr, strand, locus, list({'s': s, 'e': e} ORDER BY s) AS x, min(s) AS s, max(e) AS e, count(*) AS n FROM anno GROUP BY ALL),
introns AS (SELECT * FROM (SELECT read_id, chr, strand, locus, e + 1 AS s, lead(s) OVER (PARTITION BY read_id ORDER BY s) - 1 AS e FROM rexons) WHERE e IS NOT NULL),
aintrons AS (SELECT * FROM (SELECT tx, gene, txid, chr, strand, locus, e + 1 AS s, lead(s) OVER (PARTITION BY tx ORDER BY s) - 1 AS e FROM anno) WHERE e IS NOT NULL)"""


def _views(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(f"WITH {BASE.replace('lineitem', '{lineitem}')} SELECT * FROM {name}", lineitem=lineitem)


def read_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, "rexons")


def annotation_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, "anno")


def listed(exons: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with x, its ranges in ascending order, and s, e, n."""
    return exons.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("x"), F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(read_exons(spark, sf_dir), ["read_id", "chr", "strand", "locus"])


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(annotation_exons(spark, sf_dir), ["tx", "gene", "txid", "chr", "strand", "locus"])


def genome(spark: SparkSession) -> DataFrame:
    """chr, chunk, seq: the bases substr('ACGT', (p * 7 + 3) % 4 + 1, 1) of positions p of five chromosomes, in chunks as of a file."""
    from strandflow.sources.genome import CHUNK

    d = spark.range(5).select(F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("chr"))
    return d.select("chr", F.lit(0).cast("long").alias("chunk"), F.repeat(F.lit("GCAT"), F.lit(CHUNK // 4)).alias("seq"))


def lengths(spark: SparkSession, length: int = 40_000) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("chr"), F.lit(length).cast("long").alias("length"))
