"""Queries on assignment: best hits of reads, minimal classes, relative counts, names, bounds, terminal bases."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.operators import annotations, assignment, scoring
from strandflow.plans.fixtures import LISTS, genome, reads, transcripts
from strandflow.plans.quantities import CLASSES, EQ, eq_rows, eqclass_counts, sample_classes

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {LISTS}, {CLASSES}, {EQ}{sql}" if sql.startswith(",") else f"WITH {LISTS}, {CLASSES}, {EQ} {sql}"
        return f

    return add


@query("""SELECT gene, key, coalesce(nobs, 0)::BIGINT AS nobs FROM
(SELECT gene, key, sum(nobs) AS nobs FROM (SELECT gene, cls, string_agg((tx * CASE WHEN equal THEN -1 ELSE 1 END)::VARCHAR, ',' ORDER BY tx * CASE WHEN equal THEN -1 ELSE 1 END) AS key, any_value(nobs) AS nobs FROM ec GROUP BY ALL) GROUP BY ALL)
FULL JOIN (SELECT gene, tx::VARCHAR AS key FROM ec UNION SELECT gene, (-tx)::VARCHAR AS key FROM ec) USING (gene, key)""")
def minimal_classes(spark, sf_dir):
    observed = eqclass_counts(spark, sf_dir).groupBy("gene", "key").agg(F.sum("nobs").alias("nobs"))
    return assignment.with_minimal(observed, eq_rows(spark, sf_dir).select("gene", "tx"))


@query("SELECT sample, gene, chain, strand, read_count, round(read_count / sum(read_count) OVER (PARTITION BY gene), 6) AS rel_read_count FROM rc")
def relative_counts(spark, sf_dir):
    share = F.col("read_count") / F.sum("read_count").over(W.partitionBy("gene"))
    return sample_classes(spark, sf_dir).select("sample", "gene", "chain", "strand", "read_count", F.round(share, 6).alias("rel_read_count"))


@query("SELECT cls, CASE WHEN bool_or(equal) THEN gene::VARCHAR ELSE gene::VARCHAR || '_unidentified' END AS gene, max(nobs)::BIGINT AS nobs FROM ec GROUP BY cls, ec.gene")
def unidentified_classes(spark, sf_dir):
    d = eq_rows(spark, sf_dir).groupBy("cls", "gene").agg(F.bool_or("equal").alias("any"), F.max("nobs").alias("nobs"))
    name = F.col("gene").cast("string")
    return d.select("cls", F.when(F.col("any"), name).otherwise(F.concat(name, F.lit("_unidentified"))).alias("gene"), "nobs")


@query("SELECT tx, sum(n)::BIGINT AS counts, count(DISTINCT gene) AS n_genes FROM ec GROUP BY tx")
def remove_duplicates(spark, sf_dir):
    d = eq_rows(spark, sf_dir).groupBy("tx", "gene").agg(F.sum("n").alias("n"))
    return d.groupBy("tx").agg(F.sum("n").alias("counts"), F.count(F.lit(1)).alias("n_genes"))


@query(""", g AS (SELECT tx, chr, 'g' || locus AS gene FROM txs), c AS (SELECT gene, chr, count(*) OVER (PARTITION BY gene) AS n, row_number() OVER (PARTITION BY gene ORDER BY chr) AS k FROM (SELECT DISTINCT gene, chr FROM g))
SELECT tx, CASE WHEN n > 1 THEN gene || '-' || k ELSE gene END AS unique_name FROM g JOIN c USING (gene, chr)""")
def names_by_chromosome(spark, sf_dir):
    t = transcripts(spark, sf_dir).select("tx", "chr", F.concat(F.lit("g"), F.col("locus").cast("string")).alias("gene"))
    return annotations.separated_names(t).select("tx", "unique_name")


@query("SELECT read_id, chr, e FROM reads WHERE chr <> 'chr5' AND e < 25000")
def in_bounds(spark, sf_dir):
    lengths = spark.createDataFrame([(f"chr{i}", 25000) for i in range(1, 5)], "chr string, length long")
    return annotations.in_bounds(reads(spark, sf_dir), lengths).select("read_id", "chr", "e")


_LETTER = "len(list_filter(range({0}, {0} + 10), lambda p: (p * 7 + 3) % 4 = {1}))"


@query(f"""SELECT read_id, CASE WHEN strand = '-' THEN {_LETTER.format('e - 9', 3)} ELSE {_LETTER.format('s', 0)} END AS n_a_start, CASE WHEN strand = '-' THEN {_LETTER.format('e - 9', 0)} ELSE {_LETTER.format('s', 3)} END AS n_t_start,
CASE WHEN strand = '-' THEN {_LETTER.format('s', 3)} ELSE {_LETTER.format('e - 9', 0)} END AS n_a_end, CASE WHEN strand = '-' THEN {_LETTER.format('s', 0)} ELSE {_LETTER.format('e - 9', 3)} END AS n_t_end FROM reads""")
def terminal_letters(spark, sf_dir):
    return scoring.terminal_letters(reads(spark, sf_dir), genome(spark), "read_id")
