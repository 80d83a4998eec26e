"""Junction tables, strands by majority, neighbours, splice-site models, high-confidence junctions and micro-exon collapse.

Junctions are rows (chr, s, e): the first and last intron position; their strand is a column of its own, as reads of either strand share
them. Defined cases: empty tables give empty results; null strands count as `*`; of equally near reference junctions the last by
position is taken; a junction without a confident one within reach stays itself and is not confident.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import boosting
from strandflow.operators.interval_join import REGION, first_of, nearest_equal
from strandflow.operators.staged import written

KEYS = ["chr", "s", "e"]
#: Sites this far apart or more do not compete.
WINDOW = 15
#: Junctions of a sample with annotation and without from which on its own splice-site models are trained.
LEAST_KNOWN, LEAST_OTHER = 5000, 4000


def table(introns: DataFrame) -> DataFrame:
    """Distinct junctions (chr, s, e) with read counts, by strand and by site. One shuffle for the counts, two narrow ones for the sites."""
    t = introns.groupBy("chr", "s", "e").agg(
        F.count(F.lit(1)).alias("score"), F.count_if(F.col("strand") == "+").alias("plus_score"), F.count_if(F.col("strand") == "-").alias("minus_score")
    )
    return t.withColumn("start_score", F.sum("score").over(W.partitionBy("chr", "s"))).withColumn("end_score", F.sum("score").over(W.partitionBy("chr", "e")))


def with_motif(t: DataFrame, genome: DataFrame) -> DataFrame:
    """t with motif (the first two and the last two bases of the intron) and splice_strand, from the genome (chr, chunk, seq)."""
    from strandflow.sources.genome import sequence_at

    d = sequence_at(sequence_at(t, genome, F.col("s"), F.col("s") + 1, "donor"), genome, F.col("e") - 1, F.col("e"), "acceptor")
    d = d.withColumn("motif", F.concat_ws("-", "donor", "acceptor")).drop("donor", "acceptor")
    return d.withColumn("splice_strand", R.motif_strand(F.col("motif")))


def annotated(t: DataFrame, known: DataFrame) -> DataFrame:
    """t (chr, s, e, jstrand, ...) with annotated (as known (chr, s, e, strand) has it), and annotated_start and annotated_end: the site
    is one of an annotated junction of t."""
    k = known.select("chr", "s", "e", F.col("strand").alias("jstrand")).distinct().withColumn("annotated", F.lit(True))
    d = t.join(k, [*KEYS, "jstrand"], "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))
    return d.withColumn("annotated_start", F.max("annotated").over(W.partitionBy("chr", "s"))).withColumn("annotated_end", F.max("annotated").over(W.partitionBy("chr", "e")))


def adjacent(sites: DataFrame, columns: list[str], key: str = "chr", at: str = "s") -> DataFrame:
    """sites (one row a key and place) with before and after: structs (place and columns) of the places next to each, null at the ends.

    Neighbours are found within regions; only each region's first and last place meet those of other regions."""
    here = F.struct(F.col(at).alias("at"), *columns)
    d = sites.withColumn("here", here).withColumn("region", F.expr(f"{at} div {REGION}"))
    w = W.partitionBy(key, "region").orderBy(at)
    d = d.withColumn("before", F.lag("here").over(w)).withColumn("after", F.lead("here").over(w))
    edges = d.groupBy(key, "region").agg(F.min_by("here", at).alias("lo"), F.max_by("here", at).alias("hi"))
    along = W.partitionBy(key).orderBy("region")
    edges = edges.select(key, "region", F.lag("hi").over(along).alias("hi"), F.lead("lo").over(along).alias("lo"))
    d = d.join(edges, [key, "region"])
    return d.select(*sites.columns, F.coalesce("before", "hi").alias("before"), F.coalesce("after", "lo").alias("after"))


def neighbours(sites: DataFrame) -> DataFrame:
    """chr, s, score with the distance to and the score of the sites before and after; 0 at a chromosome's ends."""
    zero = F.lit(0)
    return adjacent(sites, ["score"]).select(
        "chr", "s", "score",
        F.coalesce(F.col("s") - F.col("before.at"), zero).alias("before"), F.coalesce(F.col("after.at") - F.col("s"), zero).alias("after"),
        F.coalesce("before.score", zero).alias("score_before"), F.coalesce("after.score", zero).alias("score_after"),
    )


def splice_features(junctions: DataFrame, site: str) -> DataFrame:
    """Each start (site = "start") or end of junctions (chr, s, e, splice_strand, start_score, ..., annotated_start, ...) beside the
    sites next to it: chr, at, score, strand, known, and for side start (before) and end (after): dist_*, score_*, plus_*, minus_*,
    known_*, ratio_*, and use_*: whether the model of this side applies.

    Of several junctions with the site the first by position speaks for it."""
    at, other = ("s", "e") if site == "start" else ("e", "s")
    d = junctions.select("chr", F.col(at).alias("at"), F.col(other).alias("o"), F.col(f"{site}_score").alias("score"), F.col("splice_strand").alias("strand"), F.col(f"annotated_{site}").alias("known"))
    d = first_of(d, ["chr", "at"], F.col("o")).drop("o")
    d = adjacent(d, ["score", "strand", "known"], at="at")
    for side, x, dist in (("start", "before", F.col("at") - F.col("before.at")), ("end", "after", F.col("at") - F.col("after.at"))):
        d = d.withColumn(f"dist_{side}", F.coalesce(dist, F.lit(0)))
        d = d.withColumns({f"score_{side}": F.coalesce(f"{x}.score", F.lit(0)), f"plus_{side}": F.coalesce(F.col(f"{x}.strand") == "+", F.lit(False)), f"minus_{side}": F.coalesce(F.col(f"{x}.strand") == "-", F.lit(False)), f"known_{side}": F.coalesce(f"{x}.known", F.lit(False))})
        d = d.withColumn(f"ratio_{side}", F.try_divide("score", F.col("score") + F.col(f"score_{side}")))
        d = d.withColumn(f"use_{side}", (F.col(f"dist_{side}") != 0) & (F.col("strand") != "*") & (F.col("score") > 0) & (F.abs(f"dist_{side}") < WINDOW))
    return d.drop("before", "after")


def _inputs(side: str) -> list[str]:
    return [f"ratio_{side}", "score", f"dist_{side}", f"plus_{side}", f"minus_{side}"]


class ScoreShare:
    """The rule used where no model was trained: a site's share of the reads of both sites."""

    def column(self, *features: Column) -> Column:
        return features[0].cast("double")


@dataclass
class SpliceModels:
    """A model for each site (start, end) and side (start, end)."""

    models: dict[tuple[str, str], object]


DEFAULT = SpliceModels({(site, side): ScoreShare() for site in ("start", "end") for side in ("start", "end")})


def fit_splice_models(junctions: DataFrame, rounds: int = 50) -> SpliceModels:
    """Models that tell annotated sites from others near them; where a side has no rows of both kinds the rule stays."""
    out = dict(DEFAULT.models)
    for site in ("start", "end"):
        f = splice_features(junctions, site)
        for side in ("start", "end"):
            rows = boosting.sampled(f.filter(F.col(f"use_{side}") & (F.col("known") | F.col(f"known_{side}"))), [*_inputs(side), "known"])
            y = rows["known"].to_numpy()
            if len(y) and 0 < y.mean() < 1:
                out[site, side] = boosting.fit(rows[_inputs(side)].to_numpy(), y, rounds)
    return SpliceModels(out)


def site_predictions(junctions: DataFrame, models: SpliceModels = DEFAULT) -> DataFrame:
    """junctions with p_start_start, p_start_end, p_end_start, p_end_end; null where a model does not apply."""
    d = junctions
    for site, at in (("start", "s"), ("end", "e")):
        f = splice_features(junctions, site)
        cols = [F.when(F.col(f"use_{side}"), boosting.predicted(models.models[site, side], *[F.col(c) for c in _inputs(side)])).alias(f"p_{site}_{side}") for side in ("start", "end")]
        d = d.join(f.select("chr", F.col("at").alias(at), *cols), ["chr", at], "left")
    return d.select(*junctions.columns, *[f"p_{a}_{b}" for a in ("start", "end") for b in ("start", "end")])


def read_strand(introns: DataFrame) -> DataFrame:
    """Each read's strand by the majority of its junctions' strands (jstrand); a tie is `*`."""
    v = F.sum(F.when(F.col("jstrand") == "-", -1).when(F.col("jstrand") == "+", 1).otherwise(0))
    d = introns.groupBy("read_id").agg(v.alias("v"))
    return d.select("read_id", F.when(F.col("v") < 0, "-").when(F.col("v") > 0, "+").otherwise("*").alias("read_strand"))


def corrected_strands(introns: DataFrame, known: DataFrame, stranded: bool = False) -> DataFrame:
    """Strands (chr, s, e, jstrand) of the junctions of introns (read_id, chr, s, e, strand, jstrand), jstrand being what the motif says.

    Reads take the majority of their junctions' strands, and junctions that of their reads (stranded: of the alignments' strands), again
    and again as long as more of them match known (chr, s, e, strand); without any match at first nothing changes. The number of matches
    rises in each round and is bounded by the junctions, so it ends. Each round's table is written."""
    best = written(introns.select(*KEYS, "jstrand").distinct())
    reads = written(introns.select("read_id", *KEYS, *(["strand"] if stranded else [])))

    def matches(t: DataFrame) -> int:
        return t.join(known.select(*KEYS, F.col("strand").alias("jstrand")), [*KEYS, "jstrand"], "left_semi").count()

    n = matches(best)
    while n:
        if stranded:
            now = reads.withColumnRenamed("strand", "read_strand")
        else:
            j = reads.join(best, KEYS)
            now = j.drop("jstrand").join(read_strand(j), "read_id")
        votes = now.groupBy(*KEYS).agg(F.sum(F.when(F.col("read_strand") == "-", 1).when(F.col("read_strand") == "+", -1).otherwise(0)).alias("v"))
        new = written(best.join(votes, KEYS).select(*KEYS, F.when(F.col("v") < 0, "+").when(F.col("v") > 0, "-").otherwise(F.col("jstrand")).alias("jstrand")))
        m = matches(new)
        if m <= n:
            break
        best, n = new, m
    return best


def resolved(plus: DataFrame, minus: DataFrame) -> DataFrame:
    """chr, s, e, ms, me of junctions matched (chr, s, e, ms, me, mscore) on one strand or both: of two different references the one with
    more reads; of equally many none (null)."""
    b = minus.select(*KEYS, *[F.col(c).alias(f"{c}2") for c in ("ms", "me", "mscore")])
    d = plus.join(b, KEYS, "full")
    first = F.col("ms2").isNull() | (F.col("mscore") > F.col("mscore2"))
    second = F.col("ms").isNull() | (F.col("mscore2") > F.col("mscore"))
    return d.select(*KEYS, *[F.when(first, F.col(c)).when(second, F.col(f"{c}2")).alias(c) for c in ("ms", "me")])


def high_confidence(junctions: DataFrame, models: SpliceModels = DEFAULT, most: int = 10) -> DataFrame:
    """chr, s, e, ms, me, mstrand, confident: the reference junction that each of junctions (chr, s, e, jstrand, splice_strand, score,
    start_score, end_score, annotated, annotated_start, annotated_end) belongs to, or itself.

    By strand, of the junctions of that strand and of `*`: those with more than one read and a motif of the strand are judged among
    themselves; references are the annotated ones and those that all four predictions favour (one that does not apply does). Each junction takes
    the nearest reference within `most` positions at both ends. Without candidates on both strands nothing is merged, and all are
    confident."""
    j = written(junctions)
    seeds = {s: j.filter((F.col("jstrand").isin(s, "*")) & (F.col("score") > 1) & (F.col("splice_strand") == s)) for s in "+-"}
    strands = j.select(*KEYS, F.col("jstrand").alias("own"))
    if any(d.isEmpty() for d in seeds.values()):
        return strands.select(*KEYS, F.col("s").alias("ms"), F.col("e").alias("me"), F.col("own").alias("mstrand"), F.lit(True).alias("confident"))
    found = {}
    for s in "+-":
        p = site_predictions(seeds[s], models)
        good = F.lit(True)
        for a in ("start", "end"):
            for b in ("start", "end"):
                good &= F.coalesce(F.col(f"p_{a}_{b}"), F.lit(1.0)) > 0.5
        ref = p.filter(good | F.col("annotated")).select("chr", F.col("s").alias("rs"), F.col("e").alias("re"), F.col("score").alias("mscore"))
        mine = j.filter(F.col("jstrand").isin(s, "*")).select(*KEYS)
        found[s] = nearest_equal(mine, ref, ["chr"], most).select(*KEYS, F.col("rs").alias("ms"), F.col("re").alias("me"), "mscore")
    d = strands.join(resolved(found["+"], found["-"]), KEYS, "left")
    d = d.withColumn("confident", F.col("ms").isNotNull()).withColumn("ms", F.coalesce("ms", "s")).withColumn("me", F.coalesce("me", "e"))
    of = strands.select("chr", F.col("s").alias("ms"), F.col("e").alias("me"), F.col("own").alias("mstrand"))
    return d.join(of, ["chr", "ms", "me"]).select(*KEYS, "ms", "me", "mstrand", "confident")


def build(introns: DataFrame, known: DataFrame, genome: DataFrame, stranded: bool = False) -> DataFrame:
    """The junction table of a sample: counts, motif, corrected strand, annotation, and the reference junction of each (see
    high_confidence). introns: (read_id, chr, s, e, strand); known: annotated introns (chr, s, e, strand)."""
    t = written(with_motif(table(introns), genome))
    marked = introns.join(t.select(*KEYS, F.col("splice_strand").alias("jstrand")), KEYS)
    t = written(annotated(t.join(corrected_strands(marked, known, stranded), KEYS), known))
    n = t.agg(F.count_if("annotated").alias("a"), F.count_if(~F.col("annotated")).alias("b")).first()
    models = fit_splice_models(t) if n.a > LEAST_KNOWN and n.b > LEAST_OTHER else DEFAULT
    return t.join(high_confidence(t, models), KEYS)


def collapse_micro_exons(introns: DataFrame, *carried: str) -> DataFrame:
    """Of consecutive introns of a read where the next starts before this one ends, the earlier goes and the later takes its start."""
    w = W.partitionBy("read_id").orderBy("s")
    d = introns.withColumn("last_s", F.lag("s").over(w)).withColumn("last_e", F.lag("e").over(w)).withColumn("next_s", F.lead("s").over(w))
    gone = F.coalesce(F.col("next_s") <= F.col("e"), F.lit(False))
    return d.filter(~gone).select("read_id", F.when(F.col("s") <= F.col("last_e"), F.col("last_s")).otherwise(F.col("s")).alias("s"), "e", *carried)
