"""Interval joins as equi-joins on bins: exact, each pair once, no distinct.

Bins have a few widths. A range belongs to the least width that is not less than its own (its home level, where it touches two bins), and is
a guest at the wider ones. The pair of two ranges is looked for at the wider of their home levels, in the first bin that both touch; guests
do not meet each other. So no range, however long, becomes more than a few rows, and long and short ranges may be mixed. With `hot`, bins with
more than so many rows on the left are dealt over several tasks, to each of which the right rows of the bin go.

Defined cases: ranges are closed, ones with s > e meet nothing; null bounds or keys meet nothing; repeated rows meet as often as they are there;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of the widths of bins. Ranges wider than the last are in all of its bins that they touch.
LEVELS = (9, 14, 19, 24)
HOT = 200_000
#: Positions whose ranges are merged in one task before the merged ones of a whole key are.
REGION = 65_536


def _level(s: str, e: str) -> str:
    cases = " ".join(f"when {e} - {s} < {1 << k} then {k}" for k in LEVELS[:-1])
    return f"case {cases} else {LEVELS[-1]} end"


def binned(df: DataFrame, s: str, e: str, guests: bool = True, last: bool = True) -> DataFrame:
    """df with home, lv, bin: its bins at its home level and, with guests, at the wider ones; last: all of them, not only the first."""
    stop = f"shiftright({e}, l)" if last else f"shiftright({s}, l)"
    levels = f"filter(array({', '.join(map(str, LEVELS))}), l -> l {'>=' if guests else '='} home)"
    at = f"flatten(transform({levels}, l -> transform(sequence(shiftright({s}, l), {stop}), b -> struct(l as lv, b as bin))))"
    d = df.filter(f"{s} <= {e}").withColumn("home", F.expr(_level(s, e)))
    return d.select(*df.columns, "home", F.explode(F.expr(at)).alias("at")).select(*df.columns, "home", "at.lv", "at.bin")


def _split(a: DataFrame, b: DataFrame, on: list[str], hot: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with part: the rows of a's crowded bins are dealt over parts, the rows of b go to each of them."""
    if hot is None:
        return a, b, on
    crowded = a.groupBy(*on).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot).select(*on, F.ceil(F.col("c") / hot).cast("int").alias("parts"))
    one = F.coalesce("parts", F.lit(1))
    a = a.join(crowded, on, "left").withColumn("part", F.pmod(F.xxhash64(*a.columns), one).cast("int")).drop("parts")
    return a, b.join(crowded, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts"), [*on, "part"]


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], least: int = 1, how: str = "inner", hot: int | None = None) -> DataFrame:
    """left (keys, s, e, ...) with right (keys, rs, re, ...) where at least `least` positions overlap.

    how: inner, left_semi or left_anti; the latter two keep distinct left rows."""
    at_home = F.col("home") == F.col("lv")
    a = binned(left, "s", "e").withColumn("guest", (~at_home).cast("int"))
    b = binned(right, "rs", "re").withColumn("guest", F.explode(F.when(at_home, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("home")
    a, b, on = _split(a, b, [*keys, "lv", "bin", "guest"], hot)
    j = a.join(b, on).filter(F.least("e", "re") - F.greatest("s", "rs") + 1 >= least)
    j = j.filter(F.col("bin") == F.greatest(F.expr("shiftright(s, lv)"), F.expr("shiftright(rs, lv)")))
    if how == "inner":
        return j.select(*left.columns, *[c for c in right.columns if c not in keys])
    hit = j.select(left.columns).distinct()
    return hit if how == "left_semi" else left.join(hit, left.columns, "left_anti")


def within_join(left: DataFrame, right: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """left within right: a containing range has the bin of left's start at its home level, which is left's or a wider one."""
    a, b, on = _split(binned(left, "s", "e", last=False), binned(right, "rs", "re", guests=False), [*keys, "lv", "bin"], hot)
    j = a.drop("home").join(b.drop("home"), on).filter("rs <= s and e <= re")
    return j.select(*left.columns, *[c for c in right.columns if c not in keys])


def nearest_equal(left: DataFrame, right: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """left (keys, s, e) with the nearest right (keys, rs, re) whose both ends differ by at most `most`; of equally near the last one."""
    size = most + 1
    b = right.withColumn("bin", F.explode(F.expr(f"array(rs div {size} - 1, rs div {size}, rs div {size} + 1)")))
    a = left.withColumn("bin", F.expr(f"s div {size}"))
    d = F.greatest(F.abs(F.col("s") - F.col("rs")), F.abs(F.col("e") - F.col("re")))
    j = a.join(b, [*keys, "bin"]).withColumn("distance", d).filter(F.col("distance") <= most)
    rank = W.partitionBy(*left.columns).orderBy("distance", F.desc("rs"), F.desc("re"))
    return j.withColumn("rn", F.row_number().over(rank)).filter("rn = 1").drop("rn", "bin")


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    d = df.withColumn("new", (before.isNull() | (F.col("s") > before + 1)).cast("int"))
    d = d.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return d.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("island")


def reduced(df: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the ranges (s, e) of each key as maximal ranges; touching ranges merge. Columns: keys, s, e, n (members).

    Equal ranges are counted first, then merged by region of their starts, then the merged ones of a key. The last step sees ranges
    that are apart within a region: as many as positions allow, however many rows there were."""
    d = df.groupBy(*keys, "s", "e").agg(F.count(F.lit(1)).alias("n")).withColumn("region", F.expr(f"s div {REGION}"))
    return _islands(_islands(d, [*keys, "region"]).drop("region"), keys)


def members(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with rs, re: the merged range of its key that each row's range (s, e) lies in. The rows of a merged range are not gathered."""
    merged = reduced(df, keys).select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"))
    return within_join(df, merged, keys)


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")
