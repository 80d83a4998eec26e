"""Queries on structures: ranges, joins, junctions, read classes, genes, comparison of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import genes, junctions, pairwise, read_classes
from strandflow.operators.interval_join import members, nearest_equal, overlap_join, reduced, within_join
from strandflow.plans.fixtures import BASE, LISTS, annotation_exons, genome, read_exons, reads, transcripts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, lists: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {LISTS if lists else BASE}{sql}" if sql.startswith(",") else f"WITH {LISTS if lists else BASE} {sql}"
        return f

    return add


def _flat(df: DataFrame, x, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(x).alias("i", "r")).select(*keys, "i", F.col("r.s").alias("s"), F.col("r.e").alias("e"))


@query("SELECT read_id, chr, strand, s, e FROM introns")
def introns(spark, sf_dir):
    d = reads(spark, sf_dir)
    return _flat(d, R.introns(F.col("x")), "read_id", "chr", "strand").drop("i")


@query("SELECT read_id, s, e, CASE WHEN strand = '-' THEN n - k + 1 ELSE k END AS exon_rank, CASE WHEN strand = '-' THEN k ELSE n - k + 1 END AS end_rank FROM rexons JOIN (SELECT read_id, count(*) AS n FROM rexons GROUP BY 1) USING (read_id)", False)
def exon_ranks(spark, sf_dir):
    d = reads(spark, sf_dir).select("read_id", F.explode(R.ranks(F.col("x"), F.col("strand"))).alias("r"))
    return d.select("read_id", "r.s", "r.e", F.col("r.rank").cast("long").alias("exon_rank"), F.col("r.end_rank").cast("long").alias("end_rank"))


@query("SELECT read_id, k - 1 AS i, CASE WHEN k = 1 THEN e - 1 ELSE s END AS s, CASE WHEN k = 1 THEN e WHEN k = n THEN s + 1 ELSE e END AS e FROM rexons JOIN (SELECT read_id, count(*) AS n FROM rexons GROUP BY 1) USING (read_id)", False)
def cut_terminals(spark, sf_dir):
    return _flat(reads(spark, sf_dir), R.cut_terminals(F.col("x")), "read_id").withColumn("i", F.col("i").cast("long"))


@query("SELECT read_id, greatest(s - 35, 1) AS s, least(e + 35, 30000) AS e FROM rexons", False)
def extend_exons(spark, sf_dir):
    return _flat(reads(spark, sf_dir), R.extend(F.col("x"), 35, 30000), "read_id").drop("i")


@query("SELECT read_id, count(*) FILTER (e - s + 1 >= 35) AS n_long, count(*) AS n FROM rexons GROUP BY 1", False)
def drop_short_exons(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", F.size(R.drop_short(F.col("x"), 35)).cast("long").alias("n_long"), "n")


@query("SELECT read_id, CASE WHEN strand = '-' THEN max_by(s, s) ELSE min(s) END AS first_s, CASE WHEN strand = '-' THEN max(e) ELSE min_by(e, s) END AS first_e, CASE WHEN strand = '-' THEN min(s) ELSE max_by(s, s) END AS last_s, CASE WHEN strand = '-' THEN min_by(e, s) ELSE max(e) END AS last_e FROM rexons GROUP BY read_id, strand", False)
def first_last_exons(spark, sf_dir):
    d = reads(spark, sf_dir)
    first = R.first_n(F.col("x"), F.col("strand"), 1)[0]
    last = R.first_n(F.col("x"), F.when(F.col("strand") == "-", "+").otherwise("-"), 1)[0]
    return d.select("read_id", first["s"].alias("first_s"), first["e"].alias("first_e"), last["s"].alias("last_s"), last["e"].alias("last_e"))


_ISLANDS = """, f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM {t}),
g AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT {k}, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY {k}, island"""


@query(_ISLANDS.format(k="chr, strand", t="rexons"), False)
def range_reduce(spark, sf_dir):
    return reduced(read_exons(spark, sf_dir).select("chr", "strand", "s", "e"), ["chr", "strand"])


@query("""SELECT r.read_id, r.s, r.e, m.s AS rs, m.e AS re FROM rexons r JOIN ("""
       + _ISLANDS.format(k="chr, strand", t="rexons").replace(", f AS (", "WITH f AS (", 1) + """) m ON r.chr = m.chr AND r.strand = m.strand AND m.s <= r.s AND r.e <= m.e""", False)
def range_members(spark, sf_dir):
    return members(read_exons(spark, sf_dir).select("read_id", "chr", "strand", "s", "e"), ["chr", "strand"]).select("read_id", "s", "e", "rs", "re")


@query(_ISLANDS.format(k="gene, chr, strand", t="anno"), False)
def gene_ranges(spark, sf_dir):
    return reduced(annotation_exons(spark, sf_dir).select("gene", "chr", "strand", "s", "e"), ["gene", "chr", "strand"])


def pairs(spark, sf_dir) -> DataFrame:
    """Reads with all annotated transcripts of the same chromosome, strand and locus: x and y lists."""
    t = transcripts(spark, sf_dir).select("chr", "strand", "locus", "tx", "gene", F.col("x").alias("y"))
    return reads(spark, sf_dir).join(t, ["chr", "strand", "locus"])


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    """Reads, annotated transcripts and the keys of their pairs: chromosome, strand and locus."""
    keys = ["chr", "strand", "locus"]
    t = transcripts(spark, sf_dir).select(*keys, F.col("tx").alias("sid"), F.col("x").alias("y"))
    return reads(spark, sf_dir).select(*keys, F.col("read_id").alias("qid"), "x"), t, keys


def named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"qid": "read_id", "sid": "tx"})


PAIRS = "p AS (SELECT r.read_id, r.strand, t.tx, r.x AS q, t.x AS y FROM reads r JOIN txs t USING (chr, strand, locus))"
_PAIRS = f", {PAIRS}"
_WIDTH = "coalesce(list_sum(list_transform({0}, lambda r: r.e - r.s + 1)), 0)"
_COMMON = "coalesce(list_sum(list_transform({0}, lambda a: coalesce(list_sum(list_transform({1}, lambda b: greatest(least(a.e, b.e) - greatest(a.s, b.s) + 1, 0))), 0))), 0)"
_GAPS = "list_transform(range(1, len({0})), lambda i: {{'s': {0}[i].e + 1, 'e': {0}[i + 1].s - 1}})"


@query(f"{_PAIRS} SELECT read_id, tx, ({_WIDTH.format('q')} - {_COMMON.format('q', 'y')})::BIGINT AS outside, {_COMMON.format('y', _GAPS.format('q'))}::BIGINT AS skipped FROM p")
def range_setdiff_width(spark, sf_dir):
    return named(pairwise.setdiff_widths(*sides(spark, sf_dir)))


@query(f"{_PAIRS} SELECT read_id, tx, greatest(least(q[-1].e, y[-1].e) - greatest(q[1].s, y[1].s) + 1, 0) AS span_common, greatest(q[-1].e, y[-1].e) - least(q[1].s, y[1].s) + 1 AS span_union FROM p")
def parallel_overlap(spark, sf_dir):
    d = pairs(spark, sf_dir)
    qs, qe, ss, se = F.col("s"), F.col("e"), F.col("y")[0]["s"], F.element_at("y", -1)["e"]
    return d.select("read_id", "tx", F.greatest(F.least(qe, se) - F.greatest(qs, ss) + 1, F.lit(0)).alias("span_common"), (F.greatest(qe, se) - F.least(qs, ss) + 1).alias("span_union"))


@query("SELECT read_id, k - 1 AS i, s, e FROM rexons", False)
def fragments_to_exons(spark, sf_dir):
    d = reads(spark, sf_dir).withColumn("g", R.introns(F.col("x")))
    return _flat(d, R.from_fragments(F.col("s"), F.col("e"), F.col("g")), "read_id").withColumn("i", F.col("i").cast("long"))


def _introns(spark, sf_dir) -> DataFrame:
    return _flat(reads(spark, sf_dir), R.introns(F.col("x")), "read_id", "chr", "strand", "locus").drop("i")


def _annotated(spark, sf_dir) -> DataFrame:
    return _flat(transcripts(spark, sf_dir), R.introns(F.col("x")), "tx", "gene", "chr", "strand", "locus").drop("i")


@query("SELECT i.chr, i.strand, i.s, i.e, count(DISTINCT i.read_id) AS n_reads, count(DISTINCT a.tx) AS n_tx FROM introns i JOIN aintrons a USING (chr, strand, s, e) GROUP BY ALL")
def exact_match(spark, sf_dir):
    keys = ["chr", "strand", "s", "e"]
    r = _introns(spark, sf_dir).groupBy(*keys).agg(F.countDistinct("read_id").alias("n_reads"))
    return r.join(_annotated(spark, sf_dir).groupBy(*keys).agg(F.countDistinct("tx").alias("n_tx")), keys)


@query("SELECT DISTINCT chr, strand, s, e, EXISTS (SELECT 1 FROM aintrons a WHERE a.chr = i.chr AND a.strand = i.strand AND a.s = i.s AND a.e = i.e) AS known FROM introns i")
def semi_anti(spark, sf_dir):
    keys = ["chr", "strand", "s", "e"]
    r, a = _introns(spark, sf_dir).select(keys).distinct(), _annotated(spark, sf_dir).select(keys)
    return r.join(a, keys, "left_semi").withColumn("known", F.lit(True)).unionByName(r.join(a, keys, "left_anti").withColumn("known", F.lit(False)))


@query("SELECT a.tx, count(*) AS n_pairs, sum(least(r.e, a.e) - greatest(r.s, a.s) + 1)::BIGINT AS bases FROM (SELECT chr, strand, s, e FROM rexons GROUP BY ALL) r JOIN anno a ON r.chr = a.chr AND r.strand = a.strand AND r.s <= a.e AND a.s <= r.e AND least(r.e, a.e) - greatest(r.s, a.s) + 1 >= 10 GROUP BY 1", False)
def overlap_join_exons(spark, sf_dir):
    a = annotation_exons(spark, sf_dir).select("tx", "chr", "strand", F.col("s").alias("rs"), F.col("e").alias("re"))
    r = read_exons(spark, sf_dir).select("chr", "strand", "s", "e").distinct()
    j = overlap_join(r, a, ["chr", "strand"], 10)
    return j.groupBy("tx").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.least("e", "re") - F.greatest("s", "rs") + 1).alias("bases"))


@query("SELECT r.chr, r.s, r.e, count(*) AS n_within, max(a.s) AS inner_s, min(a.e) AS inner_e FROM (SELECT DISTINCT chr, strand, s, e FROM rexons) r JOIN (SELECT DISTINCT chr, strand, s, e FROM anno) a ON r.chr = a.chr AND r.strand = a.strand AND a.s <= r.s AND r.e <= a.e GROUP BY r.chr, r.strand, r.s, r.e", False)
def within_join_exons(spark, sf_dir):
    a = annotation_exons(spark, sf_dir).select("chr", "strand", F.col("s").alias("rs"), F.col("e").alias("re")).distinct()
    r = read_exons(spark, sf_dir).select("chr", "strand", "s", "e").distinct()
    j = within_join(r, a, ["chr", "strand"]).groupBy("chr", "strand", "s", "e")
    return j.agg(F.count(F.lit(1)).alias("n_within"), F.max("rs").alias("inner_s"), F.min("re").alias("inner_e")).drop("strand")


@query("""SELECT i.chr, i.strand, i.s, i.e, a.s AS rs, a.e AS re, greatest(abs(i.s - a.s), abs(i.e - a.e)) AS distance FROM (SELECT DISTINCT chr, strand, s, e FROM introns) i
JOIN (SELECT DISTINCT chr, strand, s, e FROM aintrons) a ON i.chr = a.chr AND i.strand = a.strand AND abs(i.s - a.s) <= 10 AND abs(i.e - a.e) <= 10
QUALIFY row_number() OVER (PARTITION BY i.chr, i.strand, i.s, i.e ORDER BY greatest(abs(i.s - a.s), abs(i.e - a.e)), a.s DESC, a.e DESC) = 1""")
def equal_join_tol(spark, sf_dir):
    keys = ["chr", "strand", "s", "e"]
    a = _annotated(spark, sf_dir).select("chr", "strand", F.col("s").alias("rs"), F.col("e").alias("re")).distinct()
    return nearest_equal(_introns(spark, sf_dir).select(keys).distinct(), a, ["chr", "strand"])


_COMPAT = f"""{_PAIRS}, cut AS (SELECT read_id, tx, y, list_transform(range(1, len(q) + 1), lambda i: CASE WHEN i = 1 THEN {{'s': q[i].e - 1, 'e': q[i].e}} WHEN i = len(q) THEN {{'s': q[i].s, 'e': q[i].s + 1}} ELSE q[i] END) AS q FROM p),
f AS (SELECT read_id, tx, ({_WIDTH.format('q')} = {_COMMON.format('q', 'y')} AND {_COMMON.format('y', _GAPS.format('q'))} = 0) AS compatible, len(q) = len(y) AS same FROM cut)"""


@query(f"{_COMPAT} SELECT read_id, tx, compatible, compatible AND same AS equal FROM f")
def splice_compatible(spark, sf_dir):
    return named(pairwise.compatible(*sides(spark, sf_dir)))


@query(f"""SELECT u.tx, string_agg(v.txid::VARCHAR, ',' ORDER BY v.txid) AS eq_class FROM
(SELECT tx, chr, strand, locus, s, e, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 THEN {{'s': x[i].e - 1, 'e': x[i].e}} WHEN i = len(x) THEN {{'s': x[i].s, 'e': x[i].s + 1}} ELSE x[i] END) AS q FROM txs) u
JOIN txs v ON u.chr = v.chr AND u.strand = v.strand AND v.s <= u.q[1].s AND v.e >= u.q[-1].e
WHERE {_WIDTH.format('u.q')} = {_COMMON.format('u.q', 'v.x')} AND {_COMMON.format('v.x', _GAPS.format('u.q'))} = 0 GROUP BY 1""")
def eq_classes(spark, sf_dir):
    return genes.equivalence(transcripts(spark, sf_dir)).select("tx", F.array_join(F.transform("eq", lambda i: i.cast("string")), ",").alias("eq_class"))


@query("""SELECT chr, s, e, count(*) AS score, count(*) FILTER (strand = '+') AS plus_score, count(*) FILTER (strand = '-') AS minus_score,
sum(count(*)) OVER (PARTITION BY chr, s)::BIGINT AS start_score, sum(count(*)) OVER (PARTITION BY chr, e)::BIGINT AS end_score FROM introns GROUP BY chr, s, e""")
def junction_table(spark, sf_dir):
    return junctions.table(_introns(spark, sf_dir))


_MOTIF = """, m AS (SELECT DISTINCT chr, s, e, substr('ACGT', ((s * 7 + 3) % 4 + 1)::INT, 1) || substr('ACGT', (((s + 1) * 7 + 3) % 4 + 1)::INT, 1) || '-' || substr('ACGT', (((e - 1) * 7 + 3) % 4 + 1)::INT, 1) || substr('ACGT', ((e * 7 + 3) % 4 + 1)::INT, 1) AS motif FROM introns)
SELECT chr, s, e, motif, CASE WHEN motif IN ('GT-AG', 'GC-AG', 'AT-AC', 'AT-AA', 'AT-AG', 'GT-AA') THEN '+' WHEN motif IN ('CT-AC', 'CT-GC', 'GT-AT', 'TT-AT', 'CT-AT', 'TT-AC') THEN '-' ELSE '*' END AS splice_strand FROM m"""


@query(_MOTIF)
def splice_motif(spark, sf_dir):
    d = junctions.with_motif(_introns(spark, sf_dir).select("chr", "s", "e").distinct(), genome(spark))
    return d.select("chr", "s", "e", "motif", "splice_strand")


@query("""SELECT chr, s, score, coalesce(s - lag(s) OVER w, 0) AS before, coalesce(lead(s) OVER w - s, 0) AS after, coalesce(lag(score) OVER w, 0) AS score_before, coalesce(lead(score) OVER w, 0) AS score_after
FROM (SELECT chr, s, count(*) AS score FROM introns GROUP BY ALL) WINDOW w AS (PARTITION BY chr ORDER BY s)""")
def neighbour_junctions(spark, sf_dir):
    return junctions.neighbours(_introns(spark, sf_dir).groupBy("chr", "s").agg(F.count(F.lit(1)).alias("score")))


@query("""SELECT read_id, CASE WHEN sum(v) < 0 THEN '-' WHEN sum(v) > 0 THEN '+' ELSE '*' END AS read_strand FROM (
SELECT i.read_id, CASE WHEN (i.s // 50) % 3 = 0 THEN -1 WHEN (i.s // 50) % 3 = 1 THEN 1 ELSE 0 END AS v FROM introns i) GROUP BY 1""")
def junction_strand(spark, sf_dir):
    d = _introns(spark, sf_dir).withColumn("jstrand", F.expr("case when (s div 50) % 3 = 0 then '-' when (s div 50) % 3 = 1 then '+' else '*' end"))
    return junctions.read_strand(d)


@query("""SELECT chr, strand, chain, count(*) AS read_count, list_sort(list(s))[ceil(count(*) / 5.0)::INT] AS s, list_sort(list(e))[ceil(count(*) / 1.25)::INT] AS e,
round(stddev_samp(s), 6) AS start_sd, round(stddev_samp(e), 6) AS end_sd FROM (
SELECT r.read_id, r.chr, r.strand, i.chain, least(r.s, i.a - 2) AS s, greatest(r.e, i.b + 2) AS e FROM reads r JOIN (SELECT read_id, string_agg(s || '-' || e, ',' ORDER BY s) AS chain, min(s) AS a, max(e) AS b FROM introns GROUP BY 1) i USING (read_id)) GROUP BY ALL""")
def read_classes_spliced(spark, sf_dir):
    return read_classes.spliced(reads(spark, sf_dir))


@query("""SELECT read_id, s, e FROM (SELECT read_id, CASE WHEN s <= lag(e + 20) OVER w THEN lag(s) OVER w ELSE s END AS s, e + 20 AS e, coalesce(lead(s) OVER w <= e + 20, false) AS gone FROM (
SELECT read_id, s, e, strand FROM introns) WINDOW w AS (PARTITION BY read_id ORDER BY s)) WHERE NOT gone""")
def micro_exon_collapse(spark, sf_dir):
    d = _introns(spark, sf_dir).select("read_id", "s", (F.col("e") + 20).alias("e"))
    return junctions.collapse_micro_exons(d)


@query("SELECT chr, strand, s, e, count(*) AS n FROM reads WHERE n = 1 GROUP BY ALL")
def unspliced_dedupe(spark, sf_dir):
    return read_classes.unspliced(reads(spark, sf_dir))


@query("""SELECT chr, strand, cs AS s, ce AS e, sum(n)::BIGINT AS read_count, CASE WHEN sum(n) > 1 THEN round(sqrt(greatest(sum(n * rs * rs) - sum(n * rs) * sum(n * rs) / sum(n), 0) / (sum(n) - 1)), 4) END AS start_sd FROM (
SELECT r.chr, r.strand, r.s::DOUBLE AS rs, r.e AS re, r.n, max(a.s) AS cs, min(a.e) AS ce FROM (SELECT chr, strand, s, e, count(*) AS n FROM reads WHERE n = 1 GROUP BY ALL) r
JOIN (SELECT DISTINCT chr, strand, s, e FROM anno) a ON r.chr = a.chr AND r.strand = a.strand AND a.s <= r.s AND r.e <= a.e GROUP BY r.chr, r.strand, r.s, r.e, r.n) GROUP BY ALL""")
def unspliced_by_ref(spark, sf_dir):
    a = annotation_exons(spark, sf_dir).select("chr", "strand", F.col("s").alias("rs"), F.col("e").alias("re")).distinct()
    return read_classes.unspliced_within(read_classes.unspliced(reads(spark, sf_dir)), a)


_GENE = """, gr AS (SELECT DISTINCT gene, chr, strand, s, e FROM anno), hit AS (SELECT r.read_id, g.gene, sum(least(r.e, g.e) - greatest(r.s, g.s) + 1) AS w FROM rexons r JOIN gr0 g ON r.chr = g.chr AND r.strand = g.strand AND r.s <= g.e AND g.s <= r.e AND least(r.e, g.e) - greatest(r.s, g.s) + 1 >= 10 GROUP BY ALL)
SELECT read_id, gene, w::BIGINT AS bases, n_genes FROM (SELECT *, count(*) OVER (PARTITION BY read_id) AS n_genes, row_number() OVER (PARTITION BY read_id ORDER BY w DESC, gene) AS rn FROM hit) WHERE rn = 1"""


@query(", gr0 AS (SELECT gene, chr, strand, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY gene, chr, strand ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY gene, chr, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM anno)) GROUP BY gene, chr, strand, island)" + _GENE, False)
def max_overlap_gene(spark, sf_dir):
    g = reduced(annotation_exons(spark, sf_dir).select("gene", "chr", "strand", "s", "e"), ["gene", "chr", "strand"])
    return genes.assign(read_exons(spark, sf_dir).select("read_id", "chr", "strand", "s", "e"), g)


@query("""SELECT read_id, gene, votes FROM (SELECT read_id, gene, count(*) AS votes, row_number() OVER (PARTITION BY read_id ORDER BY count(*) DESC, gene) AS rn
FROM introns i JOIN (SELECT DISTINCT gene, chr, strand, s, e FROM aintrons) a USING (chr, strand, s, e) GROUP BY read_id, gene) WHERE rn = 1""")
def gene_vote(spark, sf_dir):
    return genes.vote(_introns(spark, sf_dir), _annotated(spark, sf_dir).select("gene", "chr", "strand", "s", "e").distinct())


def _count(x: str, test: str) -> str:
    return f"len(list_filter({x}, lambda g: {test}))"


def _nested(x: str, y: str, test: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda g: len(list_filter({y}, lambda r: {test})))), 0)::BIGINT"


def _skips(g: str, full: str, one: str, end: str) -> str:
    within = lambda r: _count(g, f"g.s <= {r}.s AND {r}.e <= g.e")
    return f"greatest({_nested(full, g, 'r.s <= g.s AND g.e <= r.e')} - {within(one)} - {within(end)}, 0)::BIGINT"


_OVER = "(r.s <= g.{0} AND g.{0} <= r.e)"
_AT_END, _AT_START = (_nested("gq", "y", f"{_OVER.format(a)} AND NOT {_OVER.format(b)}") for a, b in (("e", "s"), ("s", "e")))
_IN_START, _IN_END = ("g.s < {0}.s AND {0}.s < g.e AND {0}.e > g.e", "{0}.s < g.s AND g.s < {0}.e AND g.e > {0}.e")


@query(f"""{_PAIRS}, k AS (SELECT *, {_GAPS.format('q')} AS gq, {_GAPS.format('y')} AS gy, CASE WHEN strand = '-' THEN q[-1] ELSE q[1] END AS fq, CASE WHEN strand = '-' THEN q[1] ELSE q[-1] END AS lq, CASE WHEN strand = '-' THEN y[-1] ELSE y[1] END AS fs, CASE WHEN strand = '-' THEN y[1] ELSE y[-1] END AS ls FROM p),
f AS (SELECT *, NOT (fq.s <= fs.e AND fs.s <= fq.e) AS af, NOT (lq.s <= ls.e AND ls.s <= lq.e) AS al, {_AT_END} AS at_end, {_AT_START} AS at_start FROM k)
SELECT read_id, tx, af AS alternative_first_exon, al AS alternative_last_exon,
CASE WHEN af THEN 0 WHEN strand = '-' THEN fq.e - fs.e ELSE fs.s - fq.s END AS alternative_tss, CASE WHEN al THEN 0 WHEN strand = '-' THEN ls.s - lq.s ELSE lq.e - ls.e END AS alternative_tes,
af AND {_count('y', 'g.s <= fq.e AND fq.s <= g.e')} > 0 AS internal_first_exon_query, af AND {_count('q', 'g.s <= fs.e AND fs.s <= g.e')} > 0 AS internal_first_exon_subject,
al AND {_count('y', 'g.s <= lq.e AND lq.s <= g.e')} > 0 AS internal_last_exon_query, al AND {_count('q', 'g.s <= ls.e AND ls.s <= g.e')} > 0 AS internal_last_exon_subject,
{_nested('gq', 'y', 'r.s <= g.s AND g.e <= r.e')} AS intron_retention_subject, {_nested('gy', 'q', 'r.s <= g.s AND g.e <= r.e')} AS intron_retention_query,
{_skips('gq', 'y', 'fs', 'ls')} AS exon_skipping_query, {_skips('gy', 'q', 'fq', 'lq')} AS exon_skipping_subject,
CASE WHEN strand = '-' THEN at_start - {_count('gq', _IN_END.format('fs'))} ELSE at_end - {_count('gq', _IN_START.format('fs'))} END AS exon_5prime,
CASE WHEN strand = '-' THEN at_end - {_count('gq', _IN_START.format('ls'))} ELSE at_start - {_count('gq', _IN_END.format('ls'))} END AS exon_3prime FROM f""")
def compare_transcripts(spark, sf_dir):
    return named(pairwise.described(*sides(spark, sf_dir)))


@query("""SELECT name, n, name || CASE WHEN n = 1 THEN '' ELSE '...' || row_number() OVER (PARTITION BY name ORDER BY txid) END AS unique_name FROM (SELECT gene AS name, txid, count(*) OVER (PARTITION BY gene) AS n FROM txs)""")
def duplicated_names(spark, sf_dir):
    d = transcripts(spark, sf_dir).select(F.col("gene").alias("name"), "txid")
    n, k = F.count(F.lit(1)).over(W.partitionBy("name")), F.row_number().over(W.partitionBy("name").orderBy("txid"))
    return d.withColumn("n", n).withColumn("k", k).select("name", "n", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("..."), F.col("k").cast("string"))).alias("unique_name"))


@query("""SELECT chr || chr(9) || 'strandflow' || chr(9) || 'exon' || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'gene_id "' || gene || '"; transcript_id "' || tx || '"; exon_number "' || CASE WHEN strand = '-' THEN n - k + 1 ELSE k END || '";' AS line FROM anno JOIN (SELECT tx, count(*) AS n FROM anno GROUP BY 1) USING (tx)
UNION ALL SELECT any_value(chr) || chr(9) || 'strandflow' || chr(9) || 'transcript' || chr(9) || min(s) || chr(9) || max(e) || chr(9) || '.' || chr(9) || any_value(strand) || chr(9) || '.' || chr(9) || 'gene_id "' || any_value(gene) || '"; transcript_id "' || tx || '";' AS line FROM anno GROUP BY tx""", False)
def gtf_lines(spark, sf_dir):
    from strandflow.sources.gtf import lines

    return lines(transcripts(spark, sf_dir)).select("line")
