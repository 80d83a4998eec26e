"""What plots of a run show, as tables: annotations with expression, principal components and correlations of samples.

counts: (tx, gene, sample, cpm). Defined cases: a transcript that a sample lacks has 0 there; samples without variation have null
correlations; fewer than two samples have no second component (0).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.ordered import median, mid_ranks
from strandflow.operators.staged import written
from strandflow.sources.gtf import wide


def annotation(annotations: DataFrame, counts: DataFrame, gene: list[str] | None = None, tx: list[str] | None = None) -> DataFrame:
    """tx, gene, label, chr, strand, x, sample, value (log2 of CPM + 1) of the named transcripts, or of those of the named genes."""
    if not gene and not tx:
        raise ValueError("name genes or transcripts")
    want = F.col("tx").isin(tx) if tx else F.col("gene").isin(gene)
    a = annotations.filter(want).withColumn("label", F.concat_ws(":", "tx", "strand"))
    c = counts.select("tx", "sample", F.log2(F.col("cpm") + 1).alias("value"))
    return a.select("tx", "gene", "label", "chr", "strand", "x").join(c, "tx")


def varying(counts: DataFrame, samples: list[str], keys: list[str], value: str = "cpm") -> DataFrame:
    """One row per key whose deviation across samples is above the median of all, with log2(value + 1) of each sample as s0, s1, ..."""
    w = wide(counts, keys, value, samples)
    names = [f"s{i}" for i in range(len(samples))]
    d = w.select(*keys, *[F.col(f"`{s}`").cast("double").alias(n) for s, n in zip(samples, names, strict=True)])
    v = F.array(*names)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / len(samples)
    squares = F.array(F.struct(mean.alias("m"), v.alias("v")))
    sd = F.transform(squares, lambda z: F.sqrt(F.aggregate(z["v"], F.lit(0.0), lambda a, x: a + (x - z["m"]) * (x - z["m"])) / max(1, len(samples) - 1)))[0]
    d = d.withColumn("sd", sd)
    return d.join(F.broadcast(median(d, "sd").select("median"))).filter("sd > median").select(*keys, *[F.log2(F.col(n) + 1).alias(n) for n in names], "sd")  # one row


def correlations(d: DataFrame, n: int) -> DataFrame:
    """a, b, rho: Spearman's correlation of each pair of the columns s0, s1, ..., by mid-ranks."""
    base = d = written(d.select(*[f"s{i}" for i in range(n)]))
    for i in range(n):
        d = d.join(mid_ranks(base, f"s{i}", f"r{i}"), f"s{i}")
    pairs = [(i, j) for i in range(n) for j in range(n)]
    row = d.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"c{i}_{j}").alias("rho")) for i, j in pairs])).alias("x")).select("x.*")


def principal_components(d: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the samples' first two components, n x 2; each component's share of the deviations) of the rows s0, s1, ...: samples are points in the
    space of rows. Only the n x n sums of products leave the executors; signs make the first sample's part positive."""
    names = [f"s{i}" for i in range(n)]
    mean = sum((F.col(c) for c in names), F.lit(0.0)) / n
    c = d.select(*[(F.col(x) - mean).alias(x) for x in names])
    r = c.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    value, vector = np.linalg.eigh(g)
    order = np.argsort(value)[::-1]
    sd = np.sqrt(np.maximum(value[order], 0))
    p = vector[:, order[:2]] * sd[:2]
    p = np.pad(p, ((0, 0), (0, 2 - p.shape[1])))
    p *= np.where(p[:1] < 0, -1, 1)
    return p, sd / sd.sum() if sd.sum() else sd
