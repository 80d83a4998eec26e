"""Lists of queries against lists of subjects, held against the column functions and against plain loops."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import compare, distance, genes, ordered, pairwise

LIST = "array<struct<s:bigint,e:bigint>>"


def lists(spark, n, seed, name, id_, far=0):
    r, rows = random.Random(seed), []
    for k in range(n):
        at, x = far + r.randrange(1, 1200), []
        for _ in range(r.choice([1, 1, 2, 3, 4, 7])):
            w = r.choice([1, 2, 20, 30, 40])
            x.append((at, at + w - 1))
            at += w + r.choice([2, 3, 50, 100])
        rows += [(k * 10 + c, r.choice(["chr1", "chr1", "chr2"]), r.choice("+-*"), x) for c in range(r.choice([1, 1, 3]))]
    d = spark.createDataFrame([(r.choice([str]) and f"{id_}{k}", *v) for k, *v in rows], f"{id_} string, chr string, strand string, {name} {LIST}")
    return d.localCheckpoint()


@pytest.fixture(scope="module")
def both(spark):
    return lists(spark, 60, 1, "x", "qid"), lists(spark, 50, 2, "y", "sid")


def crossed(q, y):
    return q.join(y.withColumnsRenamed({"strand": "ss"}), "chr").filter(R.fits_strand(F.col("strand"), F.col("ss")))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def touching(most):
    return F.exists("p", lambda a: F.exists("y", lambda b: F.least(a["e"], b["e"] + most) - F.greatest(a["s"], b["s"] - most) >= 0))


def measured(q, y, most, kind, cut, drop):
    """splice_overlaps by its definition, over all pairs."""
    x, c = F.col("x"), R.cut_terminals(F.col("x"))
    keep = F.filter(F.arrays_zip(c.alias("c"), x.alias("w")), lambda r: r["w"]["e"] - r["w"]["s"] + 1 >= most)
    d = crossed(q, y).withColumn("p", F.transform(keep, lambda r: r["c"] if cut else r["w"]) if drop else c if cut else x)
    wide = F.transform("y", lambda r: F.struct(F.greatest(r["s"] - most, F.lit(1)).alias("s"), (r["e"] + most).alias("e")))
    d = d.filter((F.size("p") > 0) & R.contained(F.col("p"), wide) if kind == "within" else touching(most))
    ends = [R.end_differences(f(x, F.col("strand")), f(F.col("y"), F.col("ss")), F.col("y")) for f in (R.first, R.last)]
    d = d.select("qid", "sid", R.differences(c, F.col("y"), most).alias("d"), (c == R.cut_terminals(F.col("y"))).alias("equal"), ((F.col("strand") == F.col("ss")) & (F.col("strand") != "*")).alias("m"), ends[0].alias("a"), ends[1].alias("b"))
    alone = F.sum(F.col("d.compatible").cast("int")).over(W.partitionBy("qid")) == 1
    return d.select("qid", "sid", "d.*", "equal", F.col("d.compatible") & alone, "m", "a.*", "b.*")


@pytest.mark.parametrize("how", [(35, "within", True, True), (0, "any", True, False), (0, "any", False, False), (5, "within", False, False), (5, "any", True, True)])
def test_measures_are_those_of_the_column_functions(both, how):
    """every candidate pair has the measures of ranges.differences and ranges.end_differences."""
    assert rows(distance.splice_overlaps(*both, *how)) == rows(measured(*both, *how))


def test_pairs_and_cascade(both):
    """Pairs by their definition; the summaries are those of the cascade's hits."""
    q, y = both
    d = crossed(q, y).withColumn("p", F.col("x"))
    assert rows(distance.within_pairs(q, y)) == rows(d.filter(R.contained(F.col("x"), F.col("y"))).select("qid", "sid"))
    assert rows(distance.overlap_pairs(q, y)) == rows(d.filter(touching(0)).select("qid", "sid"))
    hits = distance.cascade(q, y).localCheckpoint()
    assert {r.stage for r in hits.select("stage").distinct().collect()} == {1, 2, 3}
    want = hits.groupBy("qid").agg(F.min("dist"), *[F.bool_or(c) for c in ("start_match", "end_match", "compatible")])
    assert rows(distance.by_query(q, y)) == rows(want)
    gene = y.withColumn("sid", F.concat(F.lit("g"), F.length("sid")))
    want = hits.withColumn("sid", F.concat(F.lit("g"), F.length("sid"))).groupBy("qid", "sid").count()
    assert rows(distance.counted(q, gene)) == rows(want)


def test_far_positions_and_empty_sides(spark, both):
    """Positions beyond 32 bits give the same, moved; an empty side gives nothing."""
    q, y = both
    move = lambda d, c, by: d.withColumn(c, F.transform(c, lambda r: F.struct((r["s"] + by).alias("s"), (r["e"] + by).alias("e"))))
    by = 1 << 33
    assert rows(distance.splice_overlaps(move(q, "x", by), move(y, "y", by), 0, "any")) == rows(distance.splice_overlaps(q, y, 0, "any"))
    assert rows(pairwise.union(move(q, "x", by), move(y, "y", by), ["chr"])) == rows(pairwise.union(q, y, ["chr"]).select("qid", "sid", F.col("s") + by, F.col("e") + by))
    assert distance.cascade(q.limit(0), y).isEmpty() and distance.cascade(q, y.limit(0)).isEmpty()


def nothing_after(df):
    """No shuffle or window over the pairs: the plan ends with what makes them."""
    head = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    return len(head) == 2 and "Exchange" not in head[0] and "Window" not in head[0]


def test_pairs_are_not_shuffled(both):
    """what is shuffled are the tables, not their pairs, which are many more."""
    for d in (distance.within_pairs(*both), distance.overlap_pairs(*both), distance.splice_overlaps(*both), distance.best_hits(*both), distance.cascade(*both)):
        assert nothing_after(d)


KEYS = ["chr", "strand"]


@pytest.mark.parametrize("name", ["setdiff", "intersect", "union"])
def test_ranges_of_pairs(both, name):
    """the ranges of all pairs."""
    q, y = both
    d = q.join(y, KEYS).select("qid", "sid", F.explode(getattr(R, name)(F.col("x"), F.col("y"))).alias("r")).select("qid", "sid", "r.s", "r.e")
    assert rows(getattr(pairwise, name)(q, y, KEYS)) == rows(d)


def test_numbers_of_pairs(both):
    """widths, compatibility and descriptors of all pairs."""
    q, y = both
    d, x, z = q.join(y, KEYS), F.col("x"), F.col("y")
    assert rows(pairwise.setdiff_widths(q, y, KEYS)) == rows(d.select("qid", "sid", R.setdiff_width(x, z), R.common(z, R.introns(x))))
    c = R.compatible(R.cut_terminals(x), z)
    assert rows(pairwise.compatible(q, y, KEYS)) == rows(d.select("qid", "sid", c, c & (F.size(x) == F.size(z))))
    assert rows(pairwise.described(q, y, KEYS)) == rows(compare.described(d, x, z, F.col("strand"), ["qid", "sid"]))


def test_equivalence_is_not_shuffled(spark, both):
    """compatible transcripts of each, by definition, and no shuffle of pairs."""
    t = both[1].select(F.col("sid").alias("tx"), F.hash("sid").cast("long").alias("txid"), "chr", "strand", F.col("y").alias("x"))
    v = t.select("txid", "chr", "strand", F.col("x").alias("y"))
    want = t.join(v.withColumnRenamed("txid", "other"), ["chr", "strand"]).filter(R.compatible(R.cut_terminals(F.col("x")), F.col("y")))
    assert rows(genes.equivalence(t)) == rows(want.groupBy("tx").agg(F.array_sort(F.collect_set("other"))))
    assert nothing_after(genes.equivalence(t).select("tx", "eq"))


def test_buckets_are_searched_by_halves(spark):
    """a row is compared with few bounds, not with each; the buckets are those of a count of the bounds."""
    d = spark.range(1000).select(F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 1009).alias("v"), "id")
    got = ordered.dealt(d, ["v", "id"])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    r = got.groupBy("bucket").agg(F.min(F.struct("v", "id")).alias("a"), F.max(F.struct("v", "id")).alias("b")).orderBy("bucket").collect()
    key = lambda x: (x[0] is not None, x[0], x[1])
    assert len(r) > 32 and all(key(a.b) < key(b.a) for a, b in zip(r, r[1:]))
