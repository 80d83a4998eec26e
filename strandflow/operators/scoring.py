"""Novel discovery rates, ROC and precision curves, features of read classes, models that score them, and recommended rates.

Defined cases: empty tables give empty results or one row of zeros and nulls; of equal scores the id decides the order; classes with
fewer reads than the threshold have null features and scores; missing deviations (classes of one read) are features of their own
to the trees; a sample that cannot be trained on gives no model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import boosting
from strandflow.operators.distance import within_pairs
from strandflow.operators.ordered import cumulated, dealt
from strandflow.operators.staged import written

FEATURES = ["num_reads", "gene_read_prop", "start_sd", "end_sd", "n_a_start", "n_a_end", "n_t_start", "n_t_end", "strand_bias"]


def ndr(df: DataFrame, id_: str = "id", score: str = "score", label: str = "label", places: int | None = 6) -> DataFrame:
    """df (id, score, label) with ndr: the share of unlabelled rows from the best score down, made monotone from the end.

    Rows are ranked within ranges of the order, and what lies ahead of and behind a range is added: no task orders the whole table. Both orders are made from written tables, as each is read
    for a sample, for the sums of its ranges and for its rows."""
    d = written(df.withColumn("_rank", -F.col(score)).withColumn("_u", (~F.col(label)).cast("long")))
    d = cumulated(d, ["_rank", id_], _n=F.lit(1).cast("long"), _f=F.col("_u")).withColumn("_raw", F.col("_f") / F.col("_n")).withColumn("_back", -F.col("_n"))
    return _monotone(written(d)).select(*df.columns, (F.round("_ndr", places) if places is not None else F.col("_ndr")).alias("ndr"))


def _monotone(d: DataFrame) -> DataFrame:
    """d with _ndr, the least _raw of this place and the later ones, by _back (the place from the end, negative)."""
    from pyspark.sql import Window as W

    d = dealt(d, ["_back"])
    least = d.groupBy("bucket").agg(F.min("_raw").alias("m"))  # as many rows as there are parts
    ahead = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    least = least.select("bucket", F.min("m").over(ahead).alias("later"))
    run = W.partitionBy("bucket").orderBy("_back").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.join(F.broadcast(least), "bucket")
    return d.withColumn("_ndr", F.least(F.min("_raw").over(run), F.col("later")))


def curve(df: DataFrame) -> DataFrame:
    """score, tp, fp of each distinct score, from the best down: one row per distinct score is what the running sums see."""
    t = df.groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q")).withColumn("_o", -F.col("score"))
    return cumulated(t, ["_o"], tp=F.col("p"), fp=F.col("q")).select("score", "tp", "fp")


def roc(df: DataFrame) -> DataFrame:
    """n_pos, n_neg, auc, pr_auc: the mean true-positive rate at the last position of each distinct false-positive rate, and the mean
    precision at the last position of each distinct true-positive rate. Positions are those of distinct scores."""
    c = curve(df)
    a = c.groupBy("fp").agg(F.max("tp").alias("tp")).agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"), F.round(F.avg("tp") / F.max("tp"), 6).alias("auc"))
    last = c.groupBy("tp").agg(F.max("fp").alias("fp"))
    b = last.agg(F.round(F.avg(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), 6).alias("pr_auc"))
    return a.join(F.broadcast(b))  # one row each


def trainable(df: DataFrame, least: int = 1000, each: int = 50) -> DataFrame:
    n, pos = F.count(F.lit(1)), F.count_if("label")
    return df.agg(n.alias("n"), pos.alias("n_pos"), ((n >= least) & (pos >= each) & (n - pos >= each)).alias("trainable"))


def gene_shares(classes: DataFrame) -> DataFrame:
    """classes (gene, read_count, ...) with gene_read_count and gene_read_prop; genes are summed first, so a gene's classes never meet
    in one task."""
    total = classes.groupBy("gene").agg(F.sum("read_count").alias("gene_read_count"))
    return classes.join(total, "gene").withColumn("gene_read_prop", F.col("read_count") / F.col("gene_read_count")).select(*classes.columns, "gene_read_count", "gene_read_prop")


def compatibility(classes: DataFrame, annotations: DataFrame) -> DataFrame:
    """class_id, compatible (how many annotated transcripts it is a part of, by splice sites), equal (one has the same junctions).

    classes: (class_id, chr, strand, x); annotations: (tx, chr, strand, x); classes without any are not listed."""
    q = classes.select(F.col("class_id").alias("qid"), "chr", "strand", R.cut_terminals(F.col("x")).alias("x"))
    t = annotations.select(F.col("tx").alias("sid"), "chr", "strand", R.cut_terminals(F.col("x")).alias("y"))
    j = within_pairs(q, t).join(q.select("qid", "x"), "qid").join(t.select("sid", "y"), "sid").filter(R.compatible(F.col("x"), F.col("y")))
    return j.groupBy(F.col("qid").alias("class_id")).agg(F.count(F.lit(1)).alias("compatible"), F.bool_or(F.size("x") == F.size("y")).alias("equal"))


def terminal_letters(items: DataFrame, genome: DataFrame, id_: str = "class_id", size: int = 10) -> DataFrame:
    """id, n_a_start, n_t_start, n_a_end, n_t_end: the numbers of A and T in the first and last `size` bases of (id, chr, strand, s, e)
    along its strand (`*` reads as `+`)."""
    from strandflow.sources.genome import sequence_at

    d = sequence_at(items.select(id_, "chr", "strand", "s", "e"), genome, F.col("s"), F.col("s") + size - 1, "head")
    d = sequence_at(d, genome, F.col("e") - size + 1, F.col("e"), "tail")
    minus = F.col("strand") == "-"
    d = d.select(id_, F.when(minus, R.reverse_complement(F.col("tail"))).otherwise(F.col("head")).alias("a"), F.when(minus, R.reverse_complement(F.col("head"))).otherwise(F.col("tail")).alias("b"))
    count = lambda c, x: R.letter_count(F.upper(c), x).cast("long")
    return d.select(id_, count("a", "A").alias("n_a_start"), count("a", "T").alias("n_t_start"), count("b", "A").alias("n_a_end"), count("b", "T").alias("n_t_end"))


def features(classes: DataFrame) -> DataFrame:
    """classes (read_count, plus_count, gene_read_prop, deviations, letters) with num_reads (log2 of reads a million of these
    classes) and strand_bias. The total is one number, summed first."""
    total = classes.agg((F.sum("read_count") / 1e6).alias("_scale"))
    d = classes.join(F.broadcast(total))  # one row
    d = d.withColumn("num_reads", F.log2(F.greatest(F.lit(1.0), 1 + F.try_divide(F.col("read_count"), F.col("_scale")))))
    return d.withColumn("strand_bias", 1 - F.abs(0.5 - F.col("plus_count") / F.col("read_count"))).drop("_scale")


class GeneShare:
    """The rule that scores where no model was trained: a class's share of its gene's reads."""

    def column(self, *values: Column) -> Column:
        return values[FEATURES.index("gene_read_prop")].cast("double")


@dataclass
class TranscriptModels:
    """Models for classes of several exons and of one, and how the score falls with the novel discovery rate."""

    multi: object
    single: object
    curve: tuple[float, ...] = (1.0, -1.0, 0.0, 0.0)  #: score = sum of curve[i] ndr^i
    threshold: float = 0.1

    def baseline(self, rate: float | None = None) -> float:
        """The score at a novel discovery rate."""
        r = self.threshold if rate is None else rate
        return float(sum(c * r**i for i, c in enumerate(self.curve)))


DEFAULT = TranscriptModels(GeneShare(), GeneShare())


def cubic(df: DataFrame, x: str, y: str) -> tuple[float, ...]:
    """Coefficients of the least-squares cubic of y over x; the sums of powers are all that leaves the executors. Where x has fewer than four
    values the least coefficients are taken; no rows give zeros."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = df.filter(a.isNotNull() & b.isNotNull()).agg(*[F.sum(F.pow(a, F.lit(i))).alias(f"x{i}") for i in range(7)], *[F.sum(b * F.pow(a, F.lit(i))).alias(f"y{i}") for i in range(4)]).first()
    if r.x0 is None:
        return (0.0,) * 4
    m = np.array([[r[f"x{i + j}"] for j in range(4)] for i in range(4)])
    return tuple(float(v) for v in np.linalg.lstsq(m, np.array([r[f"y{i}"] for i in range(4)]), rcond=1e-12)[0])


def train(scored: DataFrame, rounds: int = 50, threshold: float = 0.1, least_reads: int = 2) -> TranscriptModels | None:
    """Models from classes with FEATURES, read_count, n_exons, novel_gene and equal (the label), or None where there are too few of either
    label. Classes of novel genes take no part in the fits."""
    d = scored.filter(F.col("read_count") >= least_reads).withColumn("label", F.coalesce("equal", F.lit(False)))
    if not trainable(d).first().trainable:
        return None
    parts = {"multi": d.filter("not novel_gene and n_exons > 1"), "single": d.filter("not novel_gene and n_exons = 1")}
    models, curve_ = {"multi": DEFAULT.multi, "single": DEFAULT.single}, DEFAULT.curve
    for name, part in parts.items():
        rows = boosting.sampled(part, [*FEATURES, "label"])
        if len(rows):
            models[name] = boosting.fit(rows[FEATURES].to_numpy(), rows["label"].to_numpy(), rounds)
    if not isinstance(models["multi"], boosting.Booster):
        return TranscriptModels(models["multi"], models["single"], curve_, threshold)
    p = parts["multi"].select("class_id", "label", boosting.predicted(models["multi"], *[F.col(c) for c in FEATURES]).alias("score"))
    return TranscriptModels(models["multi"], models["single"], cubic(ndr(p, "class_id", places=None), "ndr", "score"), threshold)


def transcript_score(scored: DataFrame, models: TranscriptModels = DEFAULT, name: str = "score") -> DataFrame:
    """scored with the score of each class by the model for its number of exons."""
    f = [F.col(c) for c in FEATURES]
    return scored.withColumn(name, F.when(F.col("n_exons") == 1, boosting.predicted(models.single, *f)).otherwise(boosting.predicted(models.multi, *f)))


def score_classes(classes: DataFrame, genes: DataFrame, annotations: DataFrame, genome: DataFrame, models: TranscriptModels = DEFAULT, fit: bool = True, least_reads: int = 2) -> tuple[DataFrame, TranscriptModels | None]:
    """(classes with gene, novel_gene, their shares, features, compatible, equal, score_default and score; the sample's own models).

    genes: (id = class_id, gene, novel_gene). Only classes with least_reads reads or more are described and scored; the default
    models always score, the sample's own where they can be trained."""
    d = gene_shares(classes.join(genes.select(F.col("id").alias("class_id"), "gene", "novel_gene"), "class_id"))
    some = d.filter(F.col("read_count") >= least_reads)
    c = some.join(compatibility(some, annotations), "class_id", "left").fillna(0, ["compatible"]).fillna(False, ["equal"])
    c = written(features(c.join(terminal_letters(some, genome), "class_id")))
    own = train(c, least_reads=least_reads) if fit else None
    c = transcript_score(transcript_score(c, models, "score_default"), own or models, "score")
    more = [*FEATURES[4:8], "num_reads", "strand_bias", "compatible", "equal", "score_default", "score"]
    return d.join(c.select("class_id", *more), "class_id", "left"), own


def ndr_of_transcripts(candidates: DataFrame, id_: str, annotated: bool = True, least: int = 50) -> DataFrame:
    """candidates (id, max_score, label) with ndr; 1 - max_score where there are fewer than `least` of either label, or no annotation."""
    n = candidates.agg(F.count_if("label").alias("a"), F.count_if(~F.col("label")).alias("b")).first()
    if not annotated or min(n.a, n.b) < least:
        return candidates.withColumn("ndr", 1 - F.col("max_score"))
    known = candidates.filter("max_score is not null")
    out = ndr(known, id_, "max_score", "label", None)
    return out.unionByName(candidates.filter("max_score is null").withColumn("ndr", F.lit(None).cast("double")))


def recommended(candidates: DataFrame, id_: str, models: TranscriptModels = DEFAULT, base: float = 0.1) -> float:
    """The novel discovery rate, to 3 places and not below 0, at which this sample has the score that the default models have at `base`:
    the cubic of rate over score, where the default's curve says."""
    d = ndr(candidates.filter("max_score_default is not null"), id_, "max_score_default", "label", None)
    c = cubic(d, "max_score_default", "ndr")
    at = models.baseline(base)
    return max(0.0, round(sum(k * at**i for i, k in enumerate(c)), 3))
