"""Combining the read classes of several samples to candidates.

Rows are read classes with sample; samples are rows and not columns, so any number of them is one aggregation. Defined cases: missing
scores count as not passing; empty tables give empty results; of equal places the sample's name decides a median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.operators.interval_join import reduced, within_join
from strandflow.operators.read_classes import HIGH

KEY = ["chr", "strand", "chain"]


def flagged(classes: DataFrame, least_reads: int = 2, least_prop: float = 0.05, least_multi: float = 0.0, least_single: float = 1.0) -> DataFrame:
    """The spliced classes of high confidence with ok_count, ok_prop and ok_score: whether the sample passes each bound."""
    d = classes.filter((F.col("read_count") >= 1) & (F.col("confidence") == HIGH))
    score = ((F.col("score") > least_multi) & (F.col("n_exons") >= 2)) | ((F.col("score") > least_single) & (F.col("n_exons") == 1))
    return d.withColumns({"ok_count": F.col("read_count") >= least_reads, "ok_prop": F.col("gene_read_prop") >= least_prop, "ok_score": F.coalesce(score, F.lit(False))})


def medians(classes: DataFrame) -> DataFrame:
    """KEY, start, end: over the samples' starts (ends) in ascending order, the first at which half of the reads are reached."""
    w = W.partitionBy(*KEY)
    total = F.sum("read_count").over(w)
    out = None
    for c, name in (("s", "start"), ("e", "end")):
        run = F.sum("read_count").over(w.orderBy(c, "sample").rowsBetween(W.unboundedPreceding, W.currentRow))
        d = classes.withColumn("run", run).withColumn("total", total).filter("run * 2 >= total").groupBy(*KEY).agg(F.min(c).alias(name))
        out = d if out is None else out.join(d, KEY)
    return out


def combined(classes: DataFrame) -> DataFrame:
    """KEY, start, end, read_count, n_count, n_prop, n_score (samples that pass), max_score, max_score_default, confidence of flagged
    classes: one row for each chain."""
    d = classes.groupBy(*KEY).agg(*[F.count_if(f"ok_{c}").alias(f"n_{c}") for c in ("count", "prop", "score")], F.max("score").alias("max_score"), F.max("score_default").alias("max_score_default"), F.sum("read_count").alias("read_count"))
    return d.join(medians(classes), KEY).withColumn("confidence", F.lit(HIGH))


def unspliced_combined(classes: DataFrame, stranded: bool = False, least_reads: int = 2, least_prop: float = 0.05, least_single: float = 1.0) -> DataFrame:
    """The same for new unspliced classes of more than one read that equal no annotation: merged across samples, summed by sample (scores
    as means by reads), then across samples."""
    d = classes.filter((F.col("confidence") == "unsplicedNew") & (F.col("read_count") > 1) & ~F.col("equal"))
    on = ["chr", "strand"] if stranded else ["chr"]
    m = reduced(d.select(*on, "s", "e"), on).select(*on, F.col("s").alias("rs"), F.col("e").alias("re"))
    j = within_join(d, m, on).withColumn("strand", F.col("strand") if stranded else F.lit("*"))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("read_count")), F.sum("read_count")).alias(c)
    j = j.groupBy("chr", "strand", "rs", "re", "sample").agg(mean("score"), mean("score_default"), F.sum("gene_read_prop").alias("prop"), F.sum("read_count").alias("read_count"))
    j = j.groupBy("chr", "strand", F.col("rs").alias("start"), F.col("re").alias("end")).agg(
        F.sum("read_count").alias("read_count"), F.count_if(F.col("read_count") >= least_reads).alias("n_count"), F.count_if(F.col("prop") >= least_prop).alias("n_prop"),
        F.count_if(F.col("score") > least_single).alias("n_score"), F.max("score").alias("max_score"), F.max("score_default").alias("max_score_default"),
    )
    return j.withColumn("chain", F.lit(None).cast("string")).withColumn("confidence", F.lit("unsplicedNew"))


def candidates(classes: DataFrame, stranded: bool = False, **bounds) -> DataFrame:
    """Spliced and unspliced candidates of all samples in one table."""
    single = {k: v for k, v in bounds.items() if k in ("least_reads", "least_prop", "least_single")}
    return combined(flagged(classes, **bounds)).unionByName(unspliced_combined(classes, stranded, **single))


def passing(found: DataFrame, least_samples: int = 1) -> DataFrame:
    """The candidates with which enough samples pass each bound."""
    return found.filter((F.col("n_count") >= least_samples) & (F.col("n_score") >= least_samples) & (F.col("n_prop") >= least_samples))
