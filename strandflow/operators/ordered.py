"""Running sums, ranks and medians over a whole table without a task that orders all of it.

Rows are dealt over ranges of the order, whose bounds come from a bounded sample (it balances the work and changes no result). Each
range is summed by itself, the sums of the ranges, as many as there are parts, are summed ahead and added to the rows.

Defined cases: an empty table gives an empty result (the median of nothing is null); rows that are equal in all order columns have
the same place in the order, and get running sums in some order of their own; null order columns come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS, SAMPLE = 64, 4096


def dealt(df: DataFrame, order: list[str], parts: int = PARTS) -> DataFrame:
    """df with bucket, ascending in the order columns: rows of a lower bucket come first."""
    keys = df.select(*order)
    sample = keys.orderBy(F.xxhash64(*order)).limit(SAMPLE).collect()
    sample.sort(key=lambda r: tuple((x is not None, x) for x in r))
    step = max(1, len(sample) // parts)
    cuts = list(dict.fromkeys(tuple(r) for r in sample[step::step]))
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    kinds = [f.dataType for f in keys.schema.fields]
    bounds = [F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(c, kinds, strict=True))]) for c in cuts]
    at = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])

    def below(a: int, b: int) -> Column:
        """How many bounds are not beyond the row, of which a are known not to be and all from b on are: a search by halves."""
        half = (a + b) // 2
        return F.lit(a) if a == b else F.when(bounds[half] <= at, below(half + 1, b)).otherwise(below(a, half))

    return df.withColumn("bucket", below(0, len(bounds)))


def cumulated(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """df with the running sum of each expression, this row included, in ascending order."""
    d = dealt(df.select("*", *[c.alias(f"_{k}") for k, c in sums.items()]), order)
    ahead = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # as many rows as there are parts
    totals = d.groupBy("bucket").agg(*[F.sum(f"_{k}").alias(k) for k in sums])
    carry = totals.select("bucket", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_{k}_0") for k in sums])
    run = W.partitionBy("bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.join(F.broadcast(carry), "bucket")
    return d.select(*df.columns, *[(F.col(f"_{k}_0") + F.sum(f"_{k}").over(run)).alias(k) for k in sums])


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with its row numbers from 1."""
    return cumulated(df, order, **{name: F.lit(1).cast("long")})


def median(df: DataFrame, column: str) -> DataFrame:
    """One row: n, median (null of nothing); the mean of the two middle values where n is even."""
    d = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    d = cumulated(d, ["v"], upto=F.col("c"))
    n = d.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    d = d.join(F.broadcast(n))  # one row
    low = F.min(F.when(F.col("upto") > F.expr("(n - 1) div 2"), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.expr("n div 2"), F.col("v")))
    return d.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), ((low + high) / 2).alias("median"))


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """column, name: the mean rank of each distinct value."""
    d = df.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    return cumulated(d, [column], upto=F.col("c")).select(column, (F.col("upto") - (F.col("c") - 1) / 2).alias(name))
