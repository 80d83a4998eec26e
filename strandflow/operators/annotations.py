"""Prepared annotations: transcripts with ranges, ranks, numbers and equivalence classes; names; chromosomes.

Defined cases: of exons that a transcript has twice one stays; names on several chromosomes are made unique by a suffix; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import genes
from strandflow.operators.ordered import numbered


def separated_names(tx: DataFrame, name: str = "gene") -> DataFrame:
    """tx with unique_name: a name on several chromosomes gets the chromosome's number among them as a suffix."""
    places = tx.select(name, "chr").distinct()
    n = F.count(F.lit(1)).over(W.partitionBy(name))
    k = F.row_number().over(W.partitionBy(name).orderBy("chr"))
    places = places.withColumn("n", n).withColumn("k", k)
    d = tx.join(places, [name, "chr"])
    return d.withColumn("unique_name", F.when(F.col("n") > 1, F.concat(name, F.lit("-"), F.col("k").cast("string"))).otherwise(F.col(name))).drop("n", "k")


def prepared(exons: DataFrame) -> DataFrame:
    """tx, gene, txid, chr, strand, x, s, e, ranked, eq of exons (chr, s, e, strand, gene, tx).

    A gene on several chromosomes gets one name, and its transcripts one, for each. txid numbers the transcripts by name; ranked has each range
    with its rank from either end; eq the txids that the transcript is a part of, by splice sites, itself included."""
    d = separated_names(exons.select("chr", "s", "e", "strand", "gene", "tx").distinct())
    suffix = F.expr("substring(unique_name, length(gene) + 1)")
    d = d.select(F.concat("tx", suffix).alias("tx"), F.col("unique_name").alias("gene"), "chr", "strand", "s", "e")
    t = d.groupBy("tx", "gene", "chr", "strand").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("x"))
    t = numbered(t, ["tx", "gene", "chr", "strand"], "txid").withColumn("s", F.col("x")[0]["s"]).withColumn("e", F.array_max(F.transform("x", lambda r: r["e"])))
    t = t.withColumn("ranked", R.ranks(F.col("x"), F.col("strand")))
    return t.join(genes.equivalence(t), "tx")


def shared_chromosomes(reads: DataFrame, annotations: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(reads, annotations, warnings): where reads lie on chromosomes that the genome (chr, length) has not, these reads go, and with them the
    annotations of chromosomes that the genome or the reads lack."""
    r, a, g = (d.select("chr").distinct().cache() for d in (reads, annotations, lengths))
    out = []
    if not a.isEmpty() and r.join(a, "chr", "left_semi").isEmpty():
        out.append("no chromosome of the reads is annotated; all transcripts will be new")
    if not r.join(a, "chr", "left_anti").isEmpty():
        out.append("not all chromosomes of the reads are annotated")
    if not r.join(g, "chr", "left_anti").isEmpty():
        both = g.join(r, "chr", "left_semi")
        if not a.join(both, "chr", "left_anti").isEmpty():
            out.append("annotations of chromosomes without a sequence or reads are dropped")
            annotations = annotations.join(both, "chr", "left_semi")
        out.append("reads of chromosomes without a sequence are dropped")
        reads = reads.join(both, "chr", "left_semi")
    return reads, annotations, out


def in_bounds(reads: DataFrame, lengths: DataFrame) -> DataFrame:
    """The reads on chromosomes of the genome (chr, length) that end before the chromosome does."""
    return reads.join(lengths, "chr").filter(F.col("e") < F.col("length")).select(reads.columns)
