"""Genes of reads and read classes, and equivalence classes of transcripts.

Defined cases: ranges on `*` fit either strand where a strand is compared; of equally good genes the first name is taken; items that
meet nothing get no row from `assign`, `vote` and `by_reference`, and a novel gene from `cascade`; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators.distance import compatible_ids
from strandflow.operators.interval_join import HOT, first_of, members, overlap_join, reduced
from strandflow.operators.staged import written


def equivalence(tx: DataFrame) -> DataFrame:
    """tx with eq: the sorted txids of all transcripts that its cut ranges are compatible with, itself included."""
    q = tx.select(F.col("tx").alias("qid"), "chr", "strand", "x")
    t = tx.select(F.col("txid").alias("sid"), "chr", "strand", F.col("x").alias("y"))
    return compatible_ids(q, t).select(F.col("qid").alias("tx"), F.col("sids").alias("eq"))


def assign(exons: DataFrame, gene_ranges: DataFrame, least: int = 10) -> DataFrame:
    """read_id, gene (of the most common bases; ties: first name), bases, n_genes.

    Equal exons of different reads are joined with the genes once."""
    g = gene_ranges.select("gene", "chr", "strand", F.col("s").alias("rs"), F.col("e").alias("re"))
    keys = ["chr", "strand", "s", "e"]
    j = overlap_join(exons.select(keys).distinct(), g, ["chr", "strand"], least, hot=HOT)
    j = j.groupBy(*keys, "gene").agg(F.sum(F.least("e", "re") - F.greatest("s", "rs") + 1).alias("w"))
    w = exons.join(j, keys).groupBy("read_id", "gene").agg(F.sum("w").alias("bases"))
    best = w.groupBy("read_id").agg(F.min(F.struct((-F.col("bases")).alias("cost"), "gene")).alias("b"), F.count(F.lit(1)).alias("n_genes"))
    return best.select("read_id", F.col("b.gene").alias("gene"), (-F.col("b.cost")).alias("bases"), "n_genes")


def vote(introns: DataFrame, annotated: DataFrame) -> DataFrame:
    """read_id, gene with the most of the read's introns (ties: first name), votes."""
    v = introns.join(annotated, ["chr", "strand", "s", "e"]).groupBy("read_id", "gene").agg(F.count(F.lit(1)).alias("votes"))
    return first_of(v, ["read_id"], F.desc("votes"), F.col("gene")).select("read_id", "gene", "votes")


def merged_exons(items: DataFrame) -> DataFrame:
    """gene, chr, strand, s, e: the merged ranges of each gene of items (gene, chr, strand, x)."""
    flat = items.select("gene", "chr", "strand", F.explode("x").alias("r")).select("gene", "chr", "strand", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    return reduced(flat, ["gene", "chr", "strand"]).select("gene", "chr", "strand", "s", "e")


def by_reference(items: DataFrame, reference: DataFrame, least: int = 10, fusion: bool = False) -> DataFrame:
    """id, gene of the items (id, chr, strand, x) that have a range with at least `least` positions in common with one of a gene.

    reference: merged ranges (gene, chr, strand, s, e). Of several genes the one with the most positions in common is taken, or with
    fusion, all that have more than `least`, by name, joined by `:` (the best one where none has)."""
    q = items.select("id", "chr", F.col("strand").alias("qs"), F.explode("x").alias("r")).select("id", "chr", "qs", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    g = reference.select("gene", "chr", F.col("strand").alias("gs"), F.col("s").alias("rs"), F.col("e").alias("re"))
    j = overlap_join(q, g, ["chr"], 1).filter(R.fits_strand(F.col("qs"), F.col("gs")))
    n = F.least("e", "re") - F.greatest("s", "rs") + 1
    w = j.groupBy("id", "gene").agg(F.sum(n).alias("w"), F.max(n).alias("most")).filter(F.col("most") >= least)
    best = F.min(F.struct((-F.col("w")).alias("cost"), "gene"))["gene"]
    if not fusion:
        return w.groupBy("id").agg(best.alias("gene"))
    wide = F.array_sort(F.collect_set(F.when(F.col("w") > least, F.col("gene"))))  # as many as genes lie at one place
    return w.groupBy("id").agg(best.alias("best"), wide.alias("all")).select("id", F.when(F.size("all") > 1, F.array_join("all", ":")).otherwise(F.col("best")).alias("gene"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least node of its connected component. Min-label propagation with pointer jumping; each round is written."""
    edges = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = written(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        step = step.join(labels.select(F.col("node").alias("new"), F.col("label").alias("far")), "new", "left")
        step = written(step.select("node", "old", F.least("new", "far").alias("label")))
        labels = step.select("node", "label")
        if step.filter("old != label").isEmpty():
            return labels


def novel(exons: DataFrame, prefix: str = "Novel") -> DataFrame:
    """read_id, gene: reads joined through merged exons, as connected components.

    Node of a read is its least merged exon; edges run between merged exons that some read has both of, so they number a read's
    exons and not its pairs of them."""
    name = F.concat_ws(":", "chr", "strand", F.lpad(F.col("rs").cast("string"), 12, "0"))
    distinct = exons.select("chr", "strand", "s", "e").distinct()
    of = exons.join(members(distinct, ["chr", "strand"]), ["chr", "strand", "s", "e"]).select("read_id", name.alias("node")).distinct()
    of = written(of)
    hub = of.groupBy("read_id").agg(F.min("node").alias("hub"))
    edges = of.join(hub, "read_id").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    labels = components(edges, of.select("node").distinct())
    return hub.join(labels, F.col("hub") == F.col("node")).select("read_id", F.concat(F.lit(f"{prefix}Gene:"), "label").alias("gene"))


def cascade(items: DataFrame, annotations: DataFrame, least: int = 10, fusion: bool = False, rounds: int = 3, prefix: str = "Novel") -> DataFrame:
    """id, gene, novel_gene, stage of each item (id, chr, strand, x); annotations: (gene, chr, strand, x), may be empty.

    Stranded items: by the annotated genes (stage 1); then by the items assigned so, and up to rounds - 1 times by those that the round
    before assigned (2); the rest form novel genes (3). Items on `*`: by all assigned ones (4), then by the annotated genes (5), then novel
    genes with a name of their own (6). Only stage 1 gives fusions. Every stage is written, as the next ones use it repeatedly."""
    items = written(items.select("id", "chr", "strand", "x"))
    stranded, rest = items.filter("strand != '*'"), items.filter("strand = '*'")
    known = written(merged_exons(annotations))
    empty = known.isEmpty()
    done: list[DataFrame] = []

    def step(left: DataFrame, reference: DataFrame, stage: int, several: bool = False) -> tuple[DataFrame, DataFrame]:
        got = written(by_reference(left, reference, least, several).withColumn("stage", F.lit(stage)))
        done.append(got)
        return got, left.join(got, "id", "left_anti")

    def ranges_of(got: DataFrame) -> DataFrame:
        return written(merged_exons(items.join(got.select("id", "gene"), "id")))

    def fresh(left: DataFrame, stage: int, name: str) -> None:
        flat = left.select(F.col("id").alias("read_id"), "chr", "strand", F.explode("x").alias("r")).select("read_id", "chr", "strand", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
        done.append(written(novel(flat, name).select(F.col("read_id").alias("id"), "gene").withColumn("stage", F.lit(stage))))

    left = stranded
    if not empty:
        got, left = step(left, known, 1, fusion)
        for _ in range(rounds):
            if got.isEmpty() or left.isEmpty():
                break
            got, left = step(left, ranges_of(got), 2)
    if not left.isEmpty():
        fresh(left, 3, prefix)
    if not rest.isEmpty():
        if done:
            every = done[0]
            for d in done[1:]:
                every = every.unionByName(d)
            _, rest = step(rest, ranges_of(every), 4)
        if not empty:
            _, rest = step(rest, known, 5)
        if not rest.isEmpty():
            fresh(rest, 6, f"unstranded.{prefix}")
    if not done:
        return items.select("id").withColumns({"gene": F.lit("").cast("string"), "novel_gene": F.lit(True), "stage": F.lit(0)})
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    names = known.select("gene").distinct().withColumn("novel_gene", F.lit(False))
    return out.join(names, "gene", "left").select("id", "gene", F.coalesce("novel_gene", F.lit(True)).alias("novel_gene"), "stage")
