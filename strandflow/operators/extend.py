"""Extending an annotation by candidates: what is new about them, which are kept, and the merged annotation.

Candidates are rows (cid, chr, strand, chain, start, end, confidence, read_count, max_score, ...); annotations rows (tx, gene, txid, chr, strand,
x, s, e). Defined cases: without candidates the annotation is returned with its own columns; without annotations every candidate is new; candidates
on `*` have no first or last junction; of several transcripts that a candidate equals the least txid is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import distance, genes, scoring
from strandflow.operators.ordered import numbered
from strandflow.operators.read_classes import HIGH, gaps_of
from strandflow.operators.staged import written

#: In the order in which they are joined.
SLOTS = ("equal", "compatible", "newWithin", "newLastJunction", "newFirstJunction", "newJunction", "allNew", "newFirstExon", "newLastExon")


def with_ranges(candidates: DataFrame) -> DataFrame:
    """candidates with g (introns) and x (exons), from the chain and the outer bounds; unspliced ones are one exon."""
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    d = candidates.withColumn("g", F.when(F.col("chain").isNull(), none).otherwise(gaps_of(F.col("chain"))))
    return d.withColumn("x", R.from_fragments(F.col("start"), F.col("end"), F.col("g")))


def splice_matches(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """id, equal, compatible, tx: whether (id, chr, strand, x) has the splice sites of a transcript, or is a part of one; tx is the first
    that it equals. Items that are neither are not listed."""
    q = items.select(F.col("id").alias("qid"), "chr", "strand", R.cut_terminals(F.col("x")).alias("x"))
    t = annotations.select(F.col("tx").alias("sid"), "chr", "strand", R.cut_terminals(F.col("x")).alias("y"), "txid")
    j = distance.within_pairs(q, t).join(q.select("qid", "x"), "qid").join(t.select("sid", "y", "txid"), "sid")
    j = j.withColumn("c", R.compatible(F.col("x"), F.col("y"))).withColumn("q", F.col("x") == F.col("y")).filter("c or q")
    return j.groupBy(F.col("qid").alias("id")).agg(F.bool_or("q").alias("equal"), F.bool_or("c").alias("compatible"), F.min(F.when(F.col("q"), F.struct("txid", "sid")))["sid"].alias("tx"))


def classified(candidates: DataFrame, annotations: DataFrame, most: int = 35, slack: int = 5, slack_ends: int = 5) -> DataFrame:
    """Spliced candidates (with cid, g, x) with tx (null: no transcript has its junctions), novelty (SLOTS joined by `:`) and novel_transcript."""
    c = candidates
    items = c.select(F.col("cid").alias("id"), "chr", "strand", "x")
    m = splice_matches(items, annotations).withColumnRenamed("id", "cid")
    known = annotations.select("chr", "strand", F.explode(R.introns(F.col("x"))).alias("r")).select("chr", "strand", F.col("r.s").alias("s"), F.col("r.e").alias("e")).distinct().withColumn("k", F.lit(True))
    i = c.select("cid", "chr", "strand", F.posexplode("g").alias("i", "r")).select("cid", "chr", "strand", "i", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    i = i.join(known, ["chr", "strand", "s", "e"], "left").withColumn("k", F.coalesce("k", F.lit(False)))
    i = i.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.count_if("k").alias("nk"), F.min_by("k", "i").alias("first"), F.max_by("k", "i").alias("last"))
    h = distance.by_query(items.withColumnRenamed("id", "qid"), annotations.select(F.col("tx").alias("sid"), "chr", "strand", F.col("x").alias("y")), most, slack, slack_ends)
    h = h.select(F.col("qid").alias("cid"), "start_match", "end_match", F.col("compatible").alias("near"))
    d = c.join(m, "cid", "left").join(i, "cid").join(h, "cid", "left")
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    any_ = F.col("nk") > 0
    equal, part = F.coalesce("equal", F.lit(False)), F.coalesce("compatible", F.lit(False))
    new_last, new_first = any_ & ((plus & no("last")) | (minus & no("first"))), any_ & ((plus & no("first")) | (minus & no("last")))
    told = {
        "equal": equal,
        "compatible": (part & ~equal) | F.coalesce("near", F.lit(False)),
        "newWithin": (F.col("n") == F.col("nk")) & ~(part | equal),
        "newLastJunction": new_last,
        "newFirstJunction": new_first,
        "newJunction": any_ & (F.col("n") - F.col("nk") > no("first").cast("int") + no("last").cast("int")),
        "allNew": ~any_,
        "newFirstExon": new_first & (F.col("start_match") == F.lit(False)),
        "newLastExon": new_last & (F.col("end_match") == F.lit(False)),
    }
    novelty = F.concat_ws(":", *[F.when(told[s], s) for s in SLOTS])
    return d.select(*c.columns, "tx", novelty.alias("novelty"), (~equal).alias("novel_transcript"))


def unspliced_new(candidates: DataFrame, annotations: DataFrame, least: int = 10) -> DataFrame:
    """Unspliced candidates (with cid, x) of which no exon has `least` positions in common with an annotated one."""
    q = candidates.select(F.col("cid").alias("qid"), "chr", "strand", "x")
    hit = distance.overlap_pairs(q, annotations.select(F.col("tx").alias("sid"), "chr", "strand", F.col("x").alias("y")), least).select(F.col("qid").alias("cid"))
    d = candidates.join(hit, "cid", "left_anti")
    return d.withColumns({"tx": F.lit(None).cast("string"), "novelty": F.lit("unsplicedNew"), "novel_transcript": F.lit(True)})


def relative_counts(d: DataFrame) -> DataFrame:
    """d with rel_read_count, the share of its gene's reads."""
    total = d.groupBy("gene").agg(F.sum("read_count").alias("_t"))
    return d.join(total, "gene").withColumn("rel_read_count", F.col("read_count") / F.col("_t")).drop("_t")


def subset_counts(d: DataFrame) -> DataFrame:
    """d with rel_subset_count, its reads among those of all of d that it is a part of, by splice sites, itself included."""
    t = numbered(d.select("cid", "chr", "strand", "x", "read_count"), ["cid"], "txid").withColumn("tx", F.col("cid").cast("string"))
    t = t.withColumn("s", F.get("x", F.lit(0))["s"]).withColumn("e", F.try_element_at("x", F.lit(-1))["e"])
    eq = genes.equivalence(t).join(t.select("tx", "cid"), "tx").select("cid", F.explode("eq").alias("txid"))
    n = eq.join(t.select("txid", "read_count"), "txid").groupBy("cid").agg(F.sum("read_count").alias("_t"))
    return d.join(n, "cid").withColumn("rel_subset_count", F.col("read_count") / F.col("_t")).drop("_t")


def filtered(d: DataFrame, threshold: float | None, annotated: bool = True, drop_subsets: bool = True, least_share: float = 0.0, base: float = 0.1, models: scoring.TranscriptModels = scoring.DEFAULT) -> tuple[DataFrame, float]:
    """(the candidates that are kept, the novel discovery rate): parts of annotated transcripts go, then those above the rate, then, with
    least_share, those with too small a share among the transcripts that they are a part of.

    d: cid, gene, novelty, read_count, max_score, max_score_default, ... Without a threshold the recommended one is taken, 0.5 without
    annotations."""
    d = relative_counts(d)
    if drop_subsets:
        d = d.filter(~F.col("novelty").contains("compatible") | (F.col("novelty") == "equal:compatible"))
    d = written(d.withColumn("label", F.col("novelty") == "equal:compatible"))
    if threshold is None:
        threshold = scoring.recommended(d, "cid", models, base) if annotated else 0.5
    d = written(scoring.ndr_of_transcripts(d, "cid", annotated).filter(F.col("ndr") <= threshold))
    d = subset_counts(d)
    if least_share > 0:
        d = d.filter(F.col("rel_subset_count") > least_share)
    return d, threshold


STATS = ["ndr", "read_count", "rel_read_count", "rel_subset_count"]
ANNOTATION = ["tx", "gene", "ndr", "novel_gene", "novel_transcript", "description", "read_count", "rel_read_count", "rel_subset_count", "txid", "chr", "strand", "x", "s", "e", "eq"]


def merged(kept: DataFrame, annotations: DataFrame, prefix: str = "Novel") -> DataFrame:
    """ANNOTATION rows: the new candidates first, named {prefix}Tx1, ..., then the annotations, with the numbers of the candidates that
    equal them; txid numbers them, eq has each transcript's equivalence class by txid."""
    description = F.when((F.col("novelty") == "unsplicedNew") & F.col("novel_gene"), "newGene-unspliced").when((F.col("novelty") == "allNew") & F.col("novel_gene"), "newGene-spliced").otherwise(F.col("novelty"))
    new = numbered(kept.filter("tx is null"), ["cid"], "txid")
    new = new.select(F.concat(F.lit(f"{prefix}Tx"), F.col("txid").cast("string")).alias("tx"), "gene", "novel_gene", "novel_transcript", description.alias("description"), *STATS, "txid", "chr", "strand", "x")
    of = kept.filter("tx is not null").groupBy("tx").agg(*[F.min_by(c, "cid").alias(c) for c in STATS])
    n = new.count()
    old = numbered(annotations.select("tx", "gene", F.col("txid").alias("old"), "chr", "strand", "x"), ["old"], "txid").join(of, "tx", "left")
    old = old.select("tx", "gene", F.lit(False).alias("novel_gene"), F.lit(False).alias("novel_transcript"), F.lit("annotation").alias("description"), *STATS, (F.col("txid") + n).alias("txid"), "chr", "strand", "x")
    d = written(new.unionByName(old).withColumn("s", F.get("x", F.lit(0))["s"]).withColumn("e", F.try_element_at("x", F.lit(-1))["e"]))
    return d.join(genes.equivalence(d), "tx", "left").select(ANNOTATION)


def extended(
    candidates: DataFrame, annotations: DataFrame, threshold: float | None = None, least_samples: int = 1, most: int = 35, least_overlap: int = 10, slack: int = 5, slack_ends: int = 5,
    drop_subsets: bool = True, least_share: float = 0.0, base: float = 0.1, fusion: bool = False, prefix: str = "Novel", models: scoring.TranscriptModels = scoring.DEFAULT,
) -> tuple[DataFrame, float | None]:
    """(the extended annotation, the novel discovery rate used): candidates that pass in enough samples are classified, given genes, filtered
    and merged with the annotations."""
    from strandflow.operators.samples import passing

    c = passing(candidates, least_samples)
    c = numbered(c, ["chr", "start", "end", "strand", "chain", "confidence"], "cid")
    c = written(with_ranges(c))
    if c.isEmpty():
        return original(annotations), threshold
    annotated = not annotations.isEmpty()
    d = classified(c.filter(F.col("confidence") == HIGH), annotations, most, slack, slack_ends).unionByName(unspliced_new(c.filter(F.col("confidence") != HIGH), annotations, least_overlap))
    d = written(d)
    g = genes.cascade(d.select(F.col("cid").alias("id"), "chr", "strand", "x"), annotations.select("gene", "chr", "strand", "x"), least_overlap, fusion, prefix=prefix)
    d = d.join(g.select(F.col("id").alias("cid"), "gene", "novel_gene"), "cid")
    if fusion:
        d = d.withColumn("novelty", F.when(F.col("gene").contains(":") & ~F.col("gene").startswith(prefix), "fusionTranscript").otherwise(F.col("novelty")))
    kept, threshold = filtered(d, threshold, annotated, drop_subsets, least_share, base, models)
    return merged(written(kept), annotations, prefix), threshold


def original(annotations: DataFrame) -> DataFrame:
    """Annotations as they are, in the columns of an extended one."""
    d = annotations.select("tx", "gene", "txid", "chr", "strand", "x", "s", "e").withColumns({"novel_gene": F.lit(False), "novel_transcript": F.lit(False), "description": F.lit("annotation")})
    d = d.withColumns({c: F.lit(None).cast("double") for c in ("ndr", "rel_read_count", "rel_subset_count")}).withColumn("read_count", F.lit(None).cast("long"))
    return d.join(genes.equivalence(d), "tx", "left").select(ANNOTATION)
