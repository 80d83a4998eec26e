"""Equivalence classes, bias, expectation-maximisation and roll-up.

Defined cases: genes without reads get zeros; a transcript in several genes is summed; a total of nothing counts as 1 in shares per
million where the roll-up says so; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import distance
from strandflow.operators.ordered import median
from strandflow.operators.staged import written


def em(i: np.ndarray, j: np.ndarray, a: np.ndarray, y: np.ndarray, gene: np.ndarray, max_iterations: int = 10_000, tolerance: float = 1e-2, least: float = 1e-8) -> np.ndarray:
    """Abundances of transcripts that explain the class shares y, for many genes at once.

    Entry k of the sparse matrix says that transcript i[k] explains class j[k] with a[k]; gene has the sorted gene number of each
    transcript. A gene stops by itself when no theta above least moves by more than tolerance of itself."""
    n = len(gene)
    theta, size = np.ones(n), np.bincount(i, a, n)
    first = np.flatnonzero(np.r_[True, gene[1:] != gene[:-1]])
    moving = np.ones(len(first), bool)
    of = np.cumsum(np.r_[False, gene[1:] != gene[:-1]])
    live = np.arange(len(i))
    for _ in range(max_iterations - 1):
        li, lj = i[live], j[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            part = a[live] * theta[li]
            ratio = np.nan_to_num(y / np.bincount(lj, part, len(y)), posinf=0.0)
            new = np.nan_to_num(np.bincount(li, part * ratio[lj], n) / size)
            new = np.where(moving[of], new, theta)
            step = np.where(new > least, np.abs(new - theta) / np.maximum(new, least), 0.0)
        theta = new
        now = np.maximum.reduceat(step, first) > tolerance
        if not now.any():
            break
        if now.sum() < moving.sum():
            moving = now
            live = live[moving[of[i[live]]]]
    return theta


def _genes(max_iterations: int, tolerance: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["gene", "tx", "cls"])
        tx = rows[["gene", "tx"]].drop_duplicates()
        i = rows.groupby(["gene", "tx"], sort=True).ngroup().to_numpy()
        j = rows.groupby(["gene", "cls"], sort=True).ngroup().to_numpy()
        gene = tx.groupby("gene", sort=True).ngroup().to_numpy()
        a, equal, multi = rows["aval"].to_numpy(float), rows["equal"].to_numpy(bool), rows["multi"].to_numpy(bool)
        nobs = np.zeros(j.max() + 1)
        nobs[j] = rows["nobs"]
        owner = np.zeros(len(nobs), np.int64)
        owner[j] = gene[i]
        k = np.bincount(owner, nobs)
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = em(i, j, a, np.nan_to_num(nobs / k[owner]), gene, max_iterations, tolerance)
            part = a * theta[i]
            share = np.nan_to_num(part * (nobs / np.bincount(j, part, len(nobs)))[j], posinf=0.0)
        out = tx.reset_index(drop=True)
        for name, kept in (("counts", True), ("full_length_counts", equal), ("unique_counts", ~multi)):
            out[name] = np.bincount(i, share * kept, len(out))
        return out

    return run


def quantified(classes: DataFrame, max_iterations: int = 10_000, tolerance: float = 1e-2) -> DataFrame:
    """gene, tx, counts, full_length_counts, unique_counts from (gene, cls, tx, nobs, equal, multi, aval).

    Genes are dealt by hash over some groups per task and solved together; a gene never leaves its group."""
    kinds = dict(classes.dtypes)
    groups = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"gene {kinds['gene']}, tx {kinds['tx']}, counts double, full_length_counts double, unique_counts double"
    d = classes.select("gene", "cls", "tx", "nobs", "equal", "multi", "aval", F.pmod(F.hash("gene"), F.lit(groups)).alias("part"))
    return d.groupBy("part").applyInPandas(_genes(max_iterations, tolerance), schema)


def signed_classes(distances: DataFrame, widths: DataFrame) -> DataFrame:
    """gene, key, nobs, rc_width of the observed equivalence classes.

    distances: (class_id, gene, txid, equal, read_count) of each class in its own gene; widths: (class_id, first_width, total_width). The key
    is the sorted list of txids, negative where the read class has all junctions of the transcript. rc_width: the greatest whole width if some
    transcript is equal, else the greatest first exon."""
    signed = F.when(F.col("equal"), -F.col("txid")).otherwise(F.col("txid"))
    c = distances.groupBy("class_id", "gene").agg(F.array_sort(F.collect_list(signed)).alias("key"), F.bool_or("equal").alias("any_equal"), F.max("read_count").alias("read_count"))
    c = c.join(widths, "class_id").groupBy("gene", "key").agg(F.sum("read_count").alias("nobs"), F.bool_or("any_equal").alias("any_equal"), F.max("total_width").alias("a"), F.max("first_width").alias("b"))
    return c.select("gene", "key", "nobs", F.when(F.col("any_equal"), F.col("a")).otherwise(F.col("b")).cast("double").alias("rc_width"))


def least_classes(transcripts: DataFrame) -> DataFrame:
    """gene, key, least: of each transcript (gene, txid, eq) the class of all that it is a part of, plain (least) and with itself negative."""
    own = F.array_sort(F.transform("eq", lambda t: F.when(t == F.col("txid"), -t).otherwise(t)))
    d = transcripts.select("gene", F.explode(F.array(F.struct(F.array_sort("eq").alias("key"), F.lit(True).alias("least")), F.struct(own.alias("key"), F.lit(False).alias("least")))).alias("k"))
    return d.groupBy("gene", "k.key").agg(F.max("k.least").alias("least"))


def class_table(observed: DataFrame, transcripts: DataFrame) -> DataFrame:
    """gene, cls, txid, equal, nobs, rc_width, least, tx_len: one row for each transcript of each class, observed or not.

    observed: signed_classes; transcripts: (gene, txid, eq, x). cls is a hash of the key."""
    d = observed.join(least_classes(transcripts), ["gene", "key"], "full").fillna(0, ["nobs", "rc_width"]).fillna(False, ["least"])
    d = d.withColumn("cls", F.md5(F.array_join(F.transform("key", lambda k: k.cast("string")), ",")))
    d = d.select("gene", "cls", "nobs", "rc_width", "least", F.explode("key").alias("k")).withColumn("txid", F.abs("k")).withColumn("equal", F.col("k") < 0).drop("k")
    return d.join(transcripts.select("txid", R.width(F.col("x")).alias("tx_len")), "txid")


def degradation(classes: DataFrame) -> DataFrame:
    """One row, rate and n_genes: the median over genes of the share of partial reads for each 1000 positions of the longest transcript.

    classes: (gene, cls, txid, equal, nobs, tx_len). Taken from genes with 30 reads and 5 of full length, or from all where there is none."""
    each = classes.groupBy("gene", "cls").agg(F.max("nobs").alias("nobs"), F.bool_or(~F.col("equal")).alias("partial"), F.max("tx_len").alias("tx_len"))
    g = each.groupBy("gene").agg(F.sum("nobs").alias("nobs"), F.sum(F.when(F.col("partial"), F.col("nobs"))).alias("part"), F.max("tx_len").alias("len"))
    g = g.withColumn("rate", F.try_divide(F.col("part"), F.col("nobs")) * 1000 / F.col("len"))
    good = (F.col("nobs") >= 30) & (F.coalesce(F.col("nobs") - F.col("part") >= 5, F.lit(False)))
    g = g.withColumn("good", good)
    n = g.agg(F.count_if("good").alias("n_good"), F.count(F.lit(1)).alias("n_all"))
    g = g.join(F.broadcast(n)).filter("good or n_good = 0")  # one row
    n = n.select(F.when(F.col("n_good") > 0, F.col("n_good")).otherwise(F.col("n_all")).alias("n_genes"))
    return median(g, "rate").select(F.col("median").alias("rate")).join(F.broadcast(n))


def valued(classes: DataFrame, rate: float | None = None, tx: str = "tx") -> DataFrame:
    """classes (gene, cls, tx, equal, rc_width, ...) with multi (several transcripts in the class) and aval.

    Without a rate every aval is 1. With one, a partial row of a shared class has w = rc_width rate / 1000, an equal one what its transcript's
    partial rows in shared classes leave of 1, but w at least; with rate 0, rows of shared classes without any equal one have 0.01. All lie
    within [0, 1]; a row of a class of one transcript has 1."""
    c = W.partitionBy("gene", "cls")
    d = classes.withColumn("multi", F.count(F.lit(1)).over(c) > 1)
    if rate is None:
        return d.withColumn("aval", F.lit(1.0))
    w = F.col("rc_width") * rate / 1000
    partial = F.sum(F.when(F.col("multi") & ~F.col("equal"), w)).over(W.partitionBy("gene", tx))
    a = F.when(F.col("equal"), 1 - F.coalesce(partial, F.lit(0.0))).otherwise(w)
    if rate == 0:
        d = d.withColumn("none_equal", ~F.max("equal").over(c))
        a = F.when(F.col("none_equal"), F.lit(0.01)).otherwise(a)
    held = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    a = F.when(F.col("equal"), held(F.greatest(held(a), w))).otherwise(held(a))
    return d.withColumn("aval", F.when(~F.col("multi"), F.lit(1.0)).otherwise(a)).drop("none_equal")


def observed_only(classes: DataFrame, tx: str = "tx") -> DataFrame:
    """classes without the genes and, in the others, the transcripts that have no read at all."""
    g = F.sum("nobs").over(W.partitionBy("gene"))
    t = F.sum("nobs").over(W.partitionBy("gene", tx))
    return classes.withColumn("_g", g).filter("_g > 0").withColumn("_t", t).filter("_t > 0").drop("_g", "_t")


def written_back(estimates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """txid, counts, full_length_counts, unique_counts of every transcript: the estimates, summed over genes, zero where there is none."""
    names = ["counts", "full_length_counts", "unique_counts"]
    e = estimates.groupBy(F.col("tx").alias("txid")).agg(*[F.sum(c).alias(c) for c in names])
    return transcripts.select("txid").join(e, "txid", "left").fillna(0.0, names)


def incompatible(distances: DataFrame, own_gene: DataFrame, genes: DataFrame) -> DataFrame:
    """gene, counts: the reads of classes without a compatible transcript, in each class's own gene; 0 for the other genes.

    distances: (class_id, gene, compatible, read_count); own_gene: (class_id, gene)."""
    c = distances.groupBy("class_id").agg(F.bool_or("compatible").alias("fits"), F.max("read_count").alias("read_count")).filter("not fits")
    n = c.join(own_gene, "class_id").groupBy("gene").agg(F.sum("read_count").alias("counts"))
    return genes.select("gene").distinct().join(n, "gene", "left").fillna(0, ["counts"])


def sample_counts(classes: DataFrame, transcripts: DataFrame, bias: bool = True, max_iterations: int = 10_000, tolerance: float = 1e-2, most: int = 35, slack: int = 5, slack_ends: int = 5, places: int = 5) -> dict[str, DataFrame]:
    """A sample quantified: counts (tx, gene, txid, counts, cpm, full_length_counts, unique_counts), incompatible (gene, counts), distances.

    classes: read classes; transcripts: (tx, gene, txid, chr, strand, x, eq)."""
    q = classes.select(F.col("class_id").alias("qid"), "chr", "strand", "x")
    hits = distance.cascade(q, transcripts.select(F.col("tx").alias("sid"), "chr", "strand", F.col("x").alias("y")), most, slack, slack_ends)
    dist = written(distance.table(hits, classes, transcripts))
    own = written(distance.class_genes(dist))
    lost = written(incompatible(dist, own, transcripts))
    fits = dist.groupBy("class_id").agg(F.bool_or("compatible").alias("fits")).filter("fits").select("class_id")
    used = dist.join(own, ["class_id", "gene"]).join(fits, "class_id")
    first = R.first(F.col("x"), F.col("strand"))
    widths = classes.select("class_id", (first["e"] - first["s"] + 1).alias("first_width"), R.width(F.col("x")).alias("total_width"))
    t = written(class_table(signed_classes(used, widths), transcripts)).withColumn("tx", F.col("txid"))
    rate = (degradation(t).first().rate or 0.0) if bias else None
    est = quantified(observed_only(valued(t, rate)), max_iterations, tolerance)
    c = transcripts.select("tx", "gene", "txid").join(written_back(est, transcripts), "txid")
    c = written(c)
    total = c.agg(F.sum("counts").alias("a")).join(F.broadcast(lost.agg(F.sum("counts").alias("b")))).select((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0))).alias("whole"))
    c = c.join(F.broadcast(total)).withColumn("cpm", F.try_divide(F.col("counts") * 1e6, F.col("whole")))  # one row
    r = [F.round(x, places).alias(x) for x in ("counts", "cpm", "full_length_counts")]
    return {"counts": c.select("tx", "gene", "txid", *r, "unique_counts"), "incompatible": lost, "distances": dist}


def read_map(members: DataFrame, distances: DataFrame) -> DataFrame:
    """read_id, equal_matches, compatible_matches: the sorted transcripts of the read's class, equal ones and compatible other ones; null: none."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("tx"))))
    d = distances.groupBy("class_id").agg(names(F.col("equal")).alias("a"), names(F.col("compatible") & ~F.col("equal")).alias("b"))
    j = members.join(d, "class_id", "left")
    return j.select("read_id", *[F.when(F.size(c) > 0, F.col(c)).alias(n) for c, n in (("a", "equal_matches"), ("b", "compatible_matches"))])


def gene_expression(counts: DataFrame, lost: DataFrame) -> DataFrame:
    """gene, sample, counts, cpm from transcripts' counts (gene, sample, counts) and incompatible counts of the same form; a sample's total has
    both, and one below 1 counts as 1."""
    d = counts.select("gene", "sample", "counts").unionByName(lost.join(counts.select("sample").distinct(), "sample", "left_semi").select("gene", "sample", "counts"))
    return cpm(d.groupBy("gene", "sample").agg(F.sum("counts").alias("counts")), ["sample"])


def cpm(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts with cpm, by the total of each key; a total below 1 counts as 1. Totals are summed map-side and joined, so no key is gathered."""
    total = counts.groupBy(*keys).agg(F.greatest(F.sum("counts"), F.lit(1)).alias("_t"))
    return counts.join(total, keys).withColumn("cpm", F.round(F.col("counts") * 1e6 / F.col("_t"), 5)).drop("_t")
