"""Read classes: reads with the same chain of junctions, and unspliced reads by the exons that they lie in.

Reads are rows (read_id, chr, strand, x, s, e, n): ranges x from s to e, n of them. Classes are rows (class_id, chr, strand, confidence,
chain, x, s, e, read_count, plus_count, start_sd, end_sd, n_exons); which reads a class has is a table (read_id, class_id) of its own, as a
class may have any number of them. class_id is a hash of what defines the class, the same in every run.

Defined cases: a class of one read has null deviations; empty tables give empty results; reads without ranges are in no class; a read
unspliced in several reference exons counts once, for the range that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators.interval_join import reduced, within_join
from strandflow.operators.junctions import collapse_micro_exons
from strandflow.operators.staged import written

HIGH, LOW = "highConfidenceJunctionReads", "lowConfidenceJunctionReads"
COLUMNS = ["class_id", "chr", "strand", "confidence", "chain", "x", "s", "e", "read_count", "plus_count", "start_sd", "end_sd", "n_exons"]


def chain_of(gaps: Column) -> Column:
    return F.array_join(F.transform(gaps, lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",")


def gaps_of(chain: Column) -> Column:
    """The ranges of a chain's text."""
    return F.transform(F.split(chain, ","), lambda t: F.struct(F.split(t, "-")[0].cast("long").alias("s"), F.split(t, "-")[1].cast("long").alias("e")))


def _id(*columns: str | Column) -> Column:
    return F.concat(F.lit("rc."), F.substring(F.md5(F.concat_ws("|", *columns)), 1, 16))


def spliced(reads: DataFrame) -> DataFrame:
    """One row per (chr, strand, chain of junctions): counts, the 20th and 80th percentile bounds, their deviations.

    Bounds lie at least two positions outside the outer junctions. The chain is the group key, so all is one shuffle."""
    d = reads.withColumn("g", R.introns(F.col("x"))).filter(F.size("g") > 0)
    d = d.select("chr", "strand", chain_of(F.col("g")).alias("chain"), F.least("s", F.col("g")[0]["s"] - 2).alias("s"), F.greatest("e", F.element_at("g", -1)["e"] + 2).alias("e"))
    return _grouped(d, ["chr", "strand", "chain"])


def _grouped(d: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("read_count"),
        F.expr("percentile_disc(0.2) within group (order by s)").cast("long").alias("s"),
        F.expr("percentile_disc(0.8) within group (order by e)").cast("long").alias("e"),
        F.round(F.stddev_samp("s"), 6).alias("start_sd"),
        F.round(F.stddev_samp("e"), 6).alias("end_sd"),
        *more,
    )


def chains(reads: DataFrame, junctions: DataFrame, stranded: bool = False) -> DataFrame:
    """read_id, chr, strand, chain, confidence, s, e, plus of each spliced read, its junctions replaced by their reference ones.

    junctions: (chr, s, e, ms, me, mstrand, confident). Introns that come to overlap are collapsed; the strand is the majority of the
    junctions' (stranded: the alignment's); a read with a junction that has no confident one is of low confidence."""
    g = reads.filter("n > 1").select("read_id", "chr", F.explode(R.introns(F.col("x"))).alias("r")).select("read_id", "chr", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    j = g.join(junctions.select("chr", "s", "e", "ms", "me", "mstrand", "confident"), ["chr", "s", "e"])
    j = collapse_micro_exons(j.select("read_id", F.col("ms").alias("s"), F.col("me").alias("e"), "mstrand", "confident"), "mstrand", "confident")
    vote = F.sum(F.when(F.col("mstrand") == "-", -1).when(F.col("mstrand") == "+", 1).otherwise(0))
    g = F.array_sort(F.collect_list(F.struct("s", "e")))  # a read's introns
    j = j.groupBy("read_id").agg(g.alias("g"), vote.alias("v"), F.bool_and("confident").alias("sure"))
    d = reads.select("read_id", "chr", F.col("strand").alias("aligned"), "s", "e").join(j, "read_id")
    voted = F.when(F.col("v") > 0, "+").when(F.col("v") < 0, "-").otherwise("*")
    return d.select(
        "read_id", "chr", (F.col("aligned") if stranded else voted).alias("strand"), chain_of(F.col("g")).alias("chain"), F.when(F.col("sure"), HIGH).otherwise(LOW).alias("confidence"),
        F.least("s", F.col("g")[0]["s"] - 2).alias("s"), F.greatest("e", F.element_at("g", -1)["e"] + 2).alias("e"), (F.col("aligned") == "+").alias("plus"),
    )


def spliced_classes(chained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, read_id and class_id) of chains."""
    key = ["chr", "strand", "chain", "confidence"]
    c = chained.withColumn("class_id", _id(*key))
    d = _grouped(c, ["class_id", *key], F.count_if("plus").alias("plus_count")).withColumn("g", gaps_of(F.col("chain")))
    d = d.withColumn("x", R.from_fragments(F.col("s"), F.col("e"), F.col("g"))).withColumn("n_exons", F.size("x"))
    return d.select(COLUMNS), c.select("read_id", "class_id")


def unspliced(reads: DataFrame) -> DataFrame:
    """Distinct ranges of the reads of one exon, with their counts."""
    return reads.filter("n = 1").groupBy("chr", "strand", "s", "e").agg(F.count(F.lit(1)).alias("n"))


def unspliced_within(counted: DataFrame, reference: DataFrame) -> DataFrame:
    """Counted ranges within reference ranges (rs, re), as classes of the range that all containing ones share."""
    keys = ["chr", "strand", "s", "e", "n"]
    j = within_join(counted, reference, ["chr", "strand"]).groupBy(*keys).agg(F.max("rs").alias("cs"), F.min("re").alias("ce"))
    x, n = F.col("s").cast("double"), F.col("n")
    total = F.sum(n)
    return j.groupBy("chr", "strand", "cs", "ce").agg(total.alias("read_count"), F.round(_spread(x, n), 4).alias("start_sd")).withColumnsRenamed({"cs": "s", "ce": "e"})


def _spread(x: Column, n: Column) -> Column:
    """The sample deviation of values x that occur n times each; null of one."""
    total = F.sum(n)
    return F.when(total > 1, F.sqrt(F.greatest(F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x) / total, F.lit(0.0)) / (total - 1)))


def _by_reference(counted: DataFrame, reference: DataFrame, confidence: str, stranded: bool) -> tuple[DataFrame, DataFrame]:
    """(classes, placed: chr, strand, s, e, class_id of each counted range within some reference range (chr, strand, rs, re))."""
    on = ["chr", "strand"] if stranded else ["chr"]
    ref = reference.select(*on, "rs", "re").distinct()
    j = within_join(counted, ref, on).groupBy("chr", "strand", "s", "e", "n").agg(F.max("rs").alias("cs"), F.min("re").alias("ce"))
    side = F.col("strand") if stranded else F.lit("*")
    j = j.withColumn("side", side).withColumn("class_id", _id("chr", "side", F.col("cs").cast("string"), F.col("ce").cast("string"), F.lit(confidence)))
    n, xs, xe = F.col("n"), F.col("s").cast("double"), F.col("e").cast("double")
    d = j.groupBy("class_id", "chr", "side", "cs", "ce").agg(
        F.sum(n).alias("read_count"), F.round(_spread(xs, n), 6).alias("start_sd"), F.round(_spread(xe, n), 6).alias("end_sd"), F.sum(F.when(F.col("strand") == "+", n).otherwise(0)).alias("plus_count")
    )
    x = F.array(F.struct(F.col("cs").alias("s"), F.col("ce").alias("e")))
    d = d.select("class_id", "chr", F.col("side").alias("strand"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("chain"), x.alias("x"), F.col("cs").alias("s"), F.col("ce").alias("e"), "read_count", "plus_count", "start_sd", "end_sd", F.lit(1).alias("n_exons"))
    return d, j.select("chr", "strand", "s", "e", "class_id")


def unspliced_classes(reads: DataFrame, spliced: DataFrame, annotations: DataFrame, stranded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, read_id and class_id) of the reads of one exon.

    First those within exons of annotations (chr, strand, x) or of stranded spliced classes of high confidence; the rest within their
    own merged ranges. Without stranded, strands are not looked at and classes are on `*`."""
    sure = spliced.filter((F.col("confidence") == HIGH) & (F.col("strand") != "*")).select("chr", "strand", F.explode("x").alias("r"))
    ref = sure.union(annotations.select("chr", "strand", F.explode("x").alias("r"))).select("chr", "strand", F.col("r.s").alias("rs"), F.col("r.e").alias("re"))
    counted = written(unspliced(reads))
    inside, placed = _by_reference(counted, ref, "unsplicedWithin", stranded)
    placed = written(placed)
    keys = ["chr", "strand", "s", "e"]
    rest = written(counted.join(placed, keys, "left_anti"))
    on = ["chr", "strand"] if stranded else ["chr"]
    own = reduced(rest.select(*on, "s", "e"), on).select(*on, F.col("s").alias("rs"), F.col("e").alias("re"))
    fresh, placed_too = _by_reference(rest, own, "unsplicedNew", stranded)
    of = placed.unionByName(placed_too)
    return inside.unionByName(fresh), reads.filter("n = 1").select("read_id", *keys).join(of, keys).select("read_id", "class_id")


def construct(reads: DataFrame, junctions: DataFrame, annotations: DataFrame, stranded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, read_id and class_id) of all reads: spliced ones by corrected chain, then unspliced ones."""
    a, of_a = spliced_classes(written(chains(reads, junctions, stranded)))
    a = written(a)
    b, of_b = unspliced_classes(reads, a, annotations, stranded)
    return a.unionByName(b), of_a.unionByName(of_b)
