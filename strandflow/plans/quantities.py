"""Queries on quantities: scores, samples, discovery, equivalence classes, expectation-maximisation, roll-up."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import plots, quantify, samples, scoring
from strandflow.plans.fixtures import LISTS, reads, transcripts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if plain else f"WITH {LISTS}, {CLASSES}, {EQ}{sql}" if sql.startswith(",") else f"WITH {LISTS}, {CLASSES}, {EQ} {sql}"
        return f

    return add


#: Read classes of a sample with a gene, and rows (gene, tx, cls) of equivalence classes from the orders.
CLASSES = """rc AS (SELECT concat('s', CAST(read_id % 4 AS VARCHAR)) AS sample, chr, strand, concat('g', chr, '_', locus) AS gene, chain, count(*) AS read_count, min(s) AS s, max(e) AS e FROM reads
JOIN (SELECT read_id, string_agg(s || '-' || e, ',' ORDER BY s) AS chain FROM introns GROUP BY 1) USING (read_id) GROUP BY ALL)"""
EQ = """eq AS (SELECT o_custkey AS gene, l_suppkey % 5 AS cls, l_partkey % 4 AS tx, count(*) AS n, bool_or(l_linenumber = 1) AS equal, max(20 + l_partkey % 7 * 30)::DOUBLE AS rc_width FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
ec AS (SELECT *, sum(n) OVER (PARTITION BY gene, cls)::BIGINT AS nobs, count(*) OVER (PARTITION BY gene, cls) > 1 AS multi FROM eq)"""


def sample_classes(spark, sf_dir):
    d = reads(spark, sf_dir).withColumn("g", R.introns(F.col("x"))).filter(F.size("g") > 0)
    chain = F.array_join(F.transform("g", lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",")
    d = d.select(F.concat(F.lit("s"), F.pmod("read_id", F.lit(4)).cast("string")).alias("sample"), "chr", "strand", F.concat(F.lit("g"), "chr", F.lit("_"), F.col("locus").cast("string")).alias("gene"), chain.alias("chain"), "s", "e")
    return d.groupBy("sample", "chr", "strand", "gene", "chain").agg(F.count(F.lit(1)).alias("read_count"), F.min("s").alias("s"), F.max("e").alias("e"))


def eq_rows(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    d = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    d = d.groupBy(F.col("o_custkey").alias("gene"), (F.col("l_suppkey") % 5).alias("cls"), (F.col("l_partkey") % 4).alias("tx")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_linenumber") == 1).alias("equal"), F.max(20 + F.col("l_partkey") % 7 * 30).cast("double").alias("rc_width")
    )
    w = W.partitionBy("gene", "cls")
    return d.withColumn("nobs", F.sum("n").over(w)).withColumn("multi", F.count(F.lit(1)).over(w) > 1)


def scores(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    id_ = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.groupBy(id_.alias("id")).agg((F.min(cents % 100000) / 100000).alias("score"), F.max(F.col("l_returnflag") == "R").alias("label"))


_SCORES = "WITH sc AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, min(round(l_extendedprice * 100)::BIGINT % 100000)::DOUBLE / 100000 AS score, bool_or(l_returnflag = 'R') AS label FROM lineitem GROUP BY 1)"


@query(f"{_SCORES}, r AS (SELECT *, sum((NOT label)::INT) OVER w / row_number() OVER w AS raw FROM sc WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)) SELECT id, score, label, round(min(raw) OVER (ORDER BY score DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS ndr FROM r", True)
def ndr(spark, sf_dir):
    return scoring.ndr(scores(spark, sf_dir))


_CURVE = f"{_SCORES}, t AS (SELECT score, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q FROM sc GROUP BY 1), c AS (SELECT score, (sum(p) OVER w)::BIGINT AS tp, (sum(q) OVER w)::BIGINT AS fp FROM t WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"{_CURVE} SELECT score, tp, fp FROM c", True)
def score_curve(spark, sf_dir):
    return scoring.curve(scores(spark, sf_dir))


@query(f"{_CURVE}, l AS (SELECT fp, max(tp) AS tp FROM c GROUP BY 1), m AS (SELECT tp, max(fp) AS fp FROM c GROUP BY 1) SELECT max(tp)::BIGINT AS n_pos, max(fp)::BIGINT AS n_neg, round(avg(tp) / max(tp), 6) AS auc, (SELECT round(avg(tp / (tp + fp)), 6) FROM m) AS pr_auc FROM l", True)
def roc_auc(spark, sf_dir):
    return scoring.roc(scores(spark, sf_dir))


@query(f"{_SCORES} SELECT count(*) AS n, count(*) FILTER (label) AS n_pos, count(*) >= 1000 AND count(*) FILTER (label) >= 50 AND count(*) FILTER (NOT label) >= 50 AS trainable FROM sc", True)
def trainable(spark, sf_dir):
    return scoring.trainable(scores(spark, sf_dir))


@query("SELECT sample, gene, chain, strand, read_count, sum(read_count) OVER (PARTITION BY sample, gene)::BIGINT AS gene_read_count, round(read_count / sum(read_count) OVER (PARTITION BY sample, gene), 6) AS gene_read_prop FROM rc")
def gene_proportion(spark, sf_dir):
    d = sample_classes(spark, sf_dir)
    t = d.groupBy("sample", "gene").agg(F.sum("read_count").alias("gene_read_count"))
    return d.join(t, ["sample", "gene"]).select("sample", "gene", "chain", "strand", "read_count", "gene_read_count", F.round(F.col("read_count") / F.col("gene_read_count"), 6).alias("gene_read_prop"))


#: The classes of all samples with what features need; deviations and letters by formula.
_FC = "fc AS (SELECT sample, chr, strand, gene, chain, read_count, read_count // 2 AS plus_count, read_count / sum(read_count) OVER (PARTITION BY gene) AS gene_read_prop FROM rc)"


def _featured(spark, sf_dir):
    d = sample_classes(spark, sf_dir).withColumn("plus_count", F.expr("read_count div 2"))
    return scoring.gene_shares(d)


@query(f", {_FC} SELECT sample, chr, strand, chain, round(gene_read_prop, 6) AS gene_read_prop, round(log2(greatest(1, 1 + read_count / (sum(read_count) OVER () / 1e6))), 6) AS num_reads, round(1 - abs(0.5 - plus_count / read_count), 6) AS strand_bias FROM fc")
def features(spark, sf_dir):
    d = scoring.features(_featured(spark, sf_dir))
    return d.select("sample", "chr", "strand", "chain", *[F.round(c, 6).alias(c) for c in ("gene_read_prop", "num_reads", "strand_bias")])


#: Scores by formula, from the tens of the end (all ends have 9 as last digit, all starts of a locus are equal); classes of every seventh have none.
_SC = "sc0 AS (SELECT *, read_count / sum(read_count) OVER (PARTITION BY sample, gene) AS gene_read_prop, CASE WHEN e // 10 % 7 = 0 THEN NULL ELSE (e // 10 % 10) / 10.0::DOUBLE END AS score, (e // 10 % 9) / 10.0::DOUBLE AS score_default FROM rc)"
_FLAGS = f"{_SC}, fl AS (SELECT *, read_count >= 2 AS ok_count, gene_read_prop >= 0.05 AS ok_prop, coalesce(score > 0, false) AS ok_score FROM sc0)"


def _tens(n):
    return F.expr("e div 10") % n


def scored_classes(spark, sf_dir):
    d = sample_classes(spark, sf_dir)
    t = d.groupBy("sample", "gene").agg(F.sum("read_count").alias("t"))
    d = d.join(t, ["sample", "gene"]).withColumn("gene_read_prop", F.col("read_count") / F.col("t")).drop("t")
    return d.withColumns({
        "score": F.when(_tens(7) != 0, _tens(10) / 10.0), "score_default": _tens(9) / 10.0,
        "confidence": F.lit("highConfidenceJunctionReads"), "n_exons": F.lit(2), "equal": F.lit(False),
    })


@query(f", {_FLAGS} SELECT sample, chr, strand, chain, ok_count, ok_prop, ok_score FROM fl")
def sample_flags(spark, sf_dir):
    return samples.flagged(scored_classes(spark, sf_dir)).select("sample", "chr", "strand", "chain", "ok_count", "ok_prop", "ok_score")


_COMBINED = f"{_FLAGS}, cb AS (SELECT chr, strand, chain, count(*) FILTER (ok_count) AS n_count, count(*) FILTER (ok_prop) AS n_prop, count(*) FILTER (ok_score) AS n_score, max(score) AS max_score, max(score_default) AS max_score_default, sum(read_count)::BIGINT AS read_count FROM fl GROUP BY ALL)"
_MEDIANS = """md AS (SELECT * FROM (SELECT chr, strand, chain, min(s) AS "start" FROM (SELECT *, sum(read_count) OVER (PARTITION BY chr, strand, chain ORDER BY s, sample ROWS UNBOUNDED PRECEDING) AS run, sum(read_count) OVER (PARTITION BY chr, strand, chain) AS total FROM rc) WHERE run * 2 >= total GROUP BY ALL)
JOIN (SELECT chr, strand, chain, min(e) AS "end" FROM (SELECT *, sum(read_count) OVER (PARTITION BY chr, strand, chain ORDER BY e, sample ROWS UNBOUNDED PRECEDING) AS run, sum(read_count) OVER (PARTITION BY chr, strand, chain) AS total FROM rc) WHERE run * 2 >= total GROUP BY ALL) USING (chr, strand, chain))"""


def _combined(spark, sf_dir):
    return samples.combined(samples.flagged(scored_classes(spark, sf_dir))).drop("confidence")


@query(f", {_COMBINED}, {_MEDIANS} SELECT * FROM cb JOIN md USING (chr, strand, chain)")
def sample_combine(spark, sf_dir):
    return _combined(spark, sf_dir)


@query(f", {_COMBINED} SELECT chr, strand, chain, read_count FROM cb WHERE n_count >= 1 AND n_prop >= 1 AND n_score >= 1")
def candidate_filter(spark, sf_dir):
    return samples.passing(_combined(spark, sf_dir)).select("chr", "strand", "chain", "read_count")


@query(f", {_MEDIANS} SELECT * FROM md")
def weighted_median(spark, sf_dir):
    return samples.medians(sample_classes(spark, sf_dir))


#: Reads of one exon by sample as new unspliced classes.
_UN = "un AS (SELECT concat('s', CAST(read_id % 4 AS VARCHAR)) AS sample, chr, strand, s, e, count(*) + 1 AS read_count, count(*) / 100.0::DOUBLE AS gene_read_prop, (e // 10 % 10) / 5.0::DOUBLE AS score, (e // 10 % 9) / 5.0::DOUBLE AS score_default FROM reads WHERE n = 1 GROUP BY ALL)"


@query(f""", {_UN}, f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM un),
g AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM f), i AS (SELECT *, min(s) OVER (PARTITION BY chr, island) AS rs, max(e) OVER (PARTITION BY chr, island) AS re FROM g),
b AS (SELECT chr, rs, re, sample, sum(score * read_count) / sum(read_count) AS score, sum(score_default * read_count) / sum(read_count) AS score_default, sum(gene_read_prop) AS prop, sum(read_count) AS read_count FROM i GROUP BY ALL)
SELECT chr, '*' AS strand, rs AS "start", re AS "end", sum(read_count)::BIGINT AS read_count, count(*) FILTER (read_count >= 2) AS n_count, count(*) FILTER (prop >= 0.05) AS n_prop, count(*) FILTER (score > 1) AS n_score, round(max(score), 6) AS max_score, round(max(score_default), 6) AS max_score_default FROM b GROUP BY ALL""")
def unspliced_combine(spark, sf_dir):
    d = reads(spark, sf_dir).filter("n = 1").groupBy(F.concat(F.lit("s"), F.pmod("read_id", F.lit(4)).cast("string")).alias("sample"), "chr", "strand", "s", "e").agg(F.count(F.lit(1)).alias("c"))
    d = d.withColumns({"read_count": F.col("c") + 1, "gene_read_prop": F.col("c") / 100.0, "score": _tens(10) / 5.0, "score_default": _tens(9) / 5.0, "confidence": F.lit("unsplicedNew"), "equal": F.lit(False)})
    d = samples.unspliced_combined(d).drop("chain", "confidence")
    return d.withColumns({c: F.round(c, 6) for c in ("max_score", "max_score_default")})


_NOVEL = """, known AS (SELECT DISTINCT chr, strand, s || '-' || e AS j FROM aintrons),
n AS (SELECT c.chr, c.strand, c.chain, len(js) AS n_junctions, len(list_filter(ks, lambda k: k)) AS n_known, ks[1] AS first_known, ks[-1] AS last_known FROM (
SELECT chr, strand, chain, list(j ORDER BY i) AS js, list(k ORDER BY i) AS ks FROM (SELECT u.*, EXISTS (SELECT 1 FROM known a WHERE a.chr = u.chr AND a.strand = u.strand AND a.j = u.j) AS k FROM (SELECT chr, strand, chain, unnest(string_split(chain, ',')) AS j, generate_subscripts(string_split(chain, ','), 1) AS i FROM (SELECT DISTINCT chr, strand, chain FROM rc)) u) GROUP BY ALL) c)
SELECT chr, strand, chain, CASE WHEN n_known = n_junctions THEN 'newWithin' WHEN n_known = 0 THEN 'allNew' ELSE concat_ws(':', CASE WHEN (strand = '+' AND NOT last_known) OR (strand = '-' AND NOT first_known) THEN 'newLastJunction' END, CASE WHEN (strand = '+' AND NOT first_known) OR (strand = '-' AND NOT last_known) THEN 'newFirstJunction' END, CASE WHEN n_junctions - n_known > (NOT first_known)::INT + (NOT last_known)::INT THEN 'newJunction' END) END AS novelty FROM n"""


@query(_NOVEL)
def classify_novelty(spark, sf_dir):
    t = transcripts(spark, sf_dir).select("chr", "strand", F.explode(R.introns(F.col("x"))).alias("r"))
    known = t.select("chr", "strand", F.concat_ws("-", F.col("r.s").cast("string"), F.col("r.e").cast("string")).alias("j")).distinct().withColumn("k", F.lit(True))
    c = sample_classes(spark, sf_dir).select("chr", "strand", "chain").distinct()
    d = c.select("*", F.posexplode(F.split("chain", ",")).alias("i", "j")).join(known, ["chr", "strand", "j"], "left")
    d = d.groupBy("chr", "strand", "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("k", F.lit(False)).alias("k")))), lambda x: x["k"]).alias("ks"))
    n, k = F.size("ks"), F.size(F.filter("ks", lambda x: x))
    first, last, plus = F.col("ks")[0], F.element_at("ks", -1), F.col("strand") == "+"
    parts = F.concat_ws(
        ":",
        F.when(F.when(plus, ~last).otherwise(~first), "newLastJunction"),
        F.when(F.when(plus, ~first).otherwise(~last), "newFirstJunction"),
        F.when(n - k > (~first).cast("int") + (~last).cast("int"), "newJunction"),
    )
    return d.select("chr", "strand", "chain", F.when(k == n, "newWithin").when(k == 0, "allNew").otherwise(parts).alias("novelty"))


@query("SELECT gene, cls, string_agg((tx * CASE WHEN equal THEN -1 ELSE 1 END)::VARCHAR, ',' ORDER BY tx * CASE WHEN equal THEN -1 ELSE 1 END) AS key, any_value(nobs) AS nobs, max(rc_width) AS rc_width FROM ec GROUP BY ALL")
def eqclass_counts(spark, sf_dir):
    signed = F.when(F.col("equal"), -F.col("tx")).otherwise(F.col("tx"))
    g = eq_rows(spark, sf_dir).groupBy("gene", "cls").agg(F.array_sort(F.collect_list(signed)).alias("key"), F.max("nobs").alias("nobs"), F.max("rc_width").alias("rc_width"))
    return g.withColumn("key", F.array_join(F.transform("key", lambda x: x.cast("string")), ","))


@query("SELECT gene, cls, nobs, k, round(nobs / k, 6) AS share FROM (SELECT gene, cls, nobs, sum(nobs) OVER (PARTITION BY gene)::BIGINT AS k FROM (SELECT DISTINCT gene, cls, nobs FROM ec))")
def normalise_k(spark, sf_dir):
    d = eq_rows(spark, sf_dir).groupBy("gene", "cls").agg(F.max("nobs").alias("nobs"))
    k = F.sum("nobs").over(W.partitionBy("gene"))
    return d.select("gene", "cls", "nobs", k.alias("k"), F.round(F.col("nobs") / k, 6).alias("share"))


#: Transcript lengths by formula.
_LEN = "(500 + tx * 250)"
_RATE = f"""gr AS (SELECT gene, sum(nobs) AS nobs, sum(nobs) FILTER (partial) AS part, max(len) AS len FROM (SELECT gene, cls, max(nobs) AS nobs, bool_or(NOT equal) AS partial, max({_LEN}) AS len FROM ec GROUP BY ALL) GROUP BY 1),
gd AS (SELECT *, nobs >= 30 AND coalesce(nobs - part >= 5, false) AS good FROM gr), gk AS (SELECT part / nobs * 1000 / len AS rate FROM gd WHERE good OR NOT (SELECT bool_or(good) FROM gd)),
dr AS (SELECT median(rate) AS rate, count(*) AS n_genes FROM gk)"""


def eq_classes_of(spark, sf_dir):
    return eq_rows(spark, sf_dir).withColumns({"txid": F.col("tx"), "tx_len": 500 + F.col("tx") * 250})


@query(f", {_RATE} SELECT round(rate, 6) AS rate, n_genes FROM dr")
def degradation_rate(spark, sf_dir):
    return quantify.degradation(eq_classes_of(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def _a_values(rate: str, none: str = "") -> str:
    w = f"(rc_width * {rate} / 1000)"
    a = f"CASE {none} WHEN equal THEN 1 - coalesce(sum(CASE WHEN multi AND NOT equal THEN {w} END) OVER (PARTITION BY gene, tx), 0) ELSE {w} END"
    return f"CASE WHEN NOT multi THEN 1.0::DOUBLE WHEN equal THEN least(1, greatest(least(greatest({a}, 0), 1), {w})) ELSE least(greatest({a}, 0), 1) END"


@query(f"SELECT gene, cls, tx, round({_a_values('0.5')}, 6) AS aval FROM ec")
def a_values(spark, sf_dir):
    return quantify.valued(eq_rows(spark, sf_dir), 0.5).select("gene", "cls", "tx", F.round("aval", 6).alias("aval"))


@query(f"SELECT gene, cls, tx, round({_a_values('0', 'WHEN NOT bool_or(equal) OVER (PARTITION BY gene, cls) THEN 0.01')}, 6) AS aval FROM ec")
def a_values_without_rate(spark, sf_dir):
    return quantify.valued(eq_rows(spark, sf_dir), 0.0).select("gene", "cls", "tx", F.round("aval", 6).alias("aval"))


@query("SELECT gene, cls, tx, nobs FROM (SELECT *, sum(nobs) OVER (PARTITION BY gene) AS g, sum(nobs) OVER (PARTITION BY gene, tx) AS t FROM (SELECT gene, cls, tx, CASE WHEN (gene + tx) % 3 = 0 THEN 0 ELSE nobs END AS nobs FROM ec)) WHERE g > 0 AND t > 0")
def observed_transcripts(spark, sf_dir):
    d = eq_rows(spark, sf_dir).select("gene", "cls", "tx", F.when((F.col("gene") + F.col("tx")) % 3 == 0, 0).otherwise(F.col("nobs")).alias("nobs"))
    return quantify.observed_only(d)


#: Five rounds of the iteration, unrolled.
_EM = ", em0 AS (SELECT gene, cls, tx, nobs, equal, multi, " + _a_values("0.5") + " AS a, nobs / k AS y, 1.0::DOUBLE AS th FROM (SELECT *, sum(n) OVER (PARTITION BY gene) AS k FROM ec))" + "".join(
    f", em{i} AS (SELECT * EXCLUDE (th, mix), coalesce(sum(CASE WHEN mix > 0 THEN a * th * y / mix ELSE 0 END) OVER (PARTITION BY gene, tx) / nullif(sum(a) OVER (PARTITION BY gene, tx), 0), 0) AS th FROM (SELECT *, sum(a * th) OVER (PARTITION BY gene, cls) AS mix FROM em{i - 1}))" for i in range(1, 6)
)
_ESTIMATE = "CASE WHEN mix > 0 THEN a * th * nobs / mix ELSE 0 END"


@query(f"{_EM} SELECT gene, tx, round(sum({_ESTIMATE}), 4) AS counts, round(sum(CASE WHEN equal THEN {_ESTIMATE} ELSE 0 END), 4) AS full_length_counts, round(sum(CASE WHEN NOT multi THEN {_ESTIMATE} ELSE 0 END), 4) AS unique_counts FROM (SELECT *, sum(a * th) OVER (PARTITION BY gene, cls) AS mix FROM em5) GROUP BY gene, tx")
def em_quant(spark, sf_dir):
    """Five rounds, as many as its SQL has."""
    d = quantify.quantified(quantify.valued(eq_rows(spark, sf_dir), 0.5), max_iterations=6, tolerance=0.0)
    return d.select("gene", "tx", *[F.round(c, 4).alias(c) for c in ("counts", "full_length_counts", "unique_counts")])


_LONG = ", tc AS (SELECT gene, tx, cls AS sample, sum(n)::BIGINT AS counts FROM eq GROUP BY ALL)"


def _long(spark, sf_dir):
    return eq_rows(spark, sf_dir).groupBy("gene", "tx", F.col("cls").alias("sample")).agg(F.sum("n").alias("counts"))


@query(f"{_LONG} SELECT gene, tx, sample, counts, round(counts * 1e6 / greatest(sum(counts) OVER (PARTITION BY sample), 1), 5) AS cpm FROM tc")
def cpm(spark, sf_dir):
    return quantify.cpm(_long(spark, sf_dir), ["sample"])


@query(f"{_LONG} SELECT gene, sample, sum(counts)::BIGINT AS counts, round(sum(counts) * 1e6 / greatest(sum(sum(counts)) OVER (PARTITION BY sample), 1), 5) AS cpm FROM tc GROUP BY gene, sample")
def gene_rollup(spark, sf_dir):
    return quantify.cpm(_long(spark, sf_dir).groupBy("gene", "sample").agg(F.sum("counts").alias("counts")), ["sample"])


@query(f"{_LONG} SELECT gene, tx, " + ", ".join(f"coalesce(sum(counts) FILTER (sample = {i}), 0)::BIGINT AS s{i}" for i in range(5)) + " FROM tc GROUP BY ALL")
def pivot_counts(spark, sf_dir):
    d = _long(spark, sf_dir).withColumn("sample", F.concat(F.lit("s"), F.col("sample").cast("string")))
    return d.groupBy("gene", "tx").pivot("sample", [f"s{i}" for i in range(5)]).agg(F.sum("counts")).fillna(0)


@query(f"{_LONG} SELECT gene, tx, sample, counts FROM tc WHERE counts > 0")
def melt_counts(spark, sf_dir):
    names = [f"s{i}" for i in range(5)]
    d = pivot_counts(spark, sf_dir).unpivot(["gene", "tx"], names, "sample", "counts").filter("counts > 0")
    return d.withColumn("sample", F.substring("sample", 2, 9).cast("long"))


_WIDE = f"{_LONG}, wd AS (SELECT gene, tx, " + ", ".join(f"coalesce(sum(counts) FILTER (sample = {i}), 0)::DOUBLE AS c{i}" for i in range(5)) + " FROM tc GROUP BY ALL)"
_SD = "list_stddev_samp([c0, c1, c2, c3, c4])"
_VARY = f"{_WIDE}, vs AS (SELECT *, {_SD} AS sd FROM wd), vv AS (SELECT gene, tx, sd, " + ", ".join(f"log2(c{i} + 1) AS s{i}" for i in range(5)) + " FROM vs WHERE sd > (SELECT median(sd) FROM vs) + 1e-9)"


def _varying(spark, sf_dir):
    d = _long(spark, sf_dir).withColumn("sample", F.concat(F.lit("s"), F.col("sample").cast("string")))
    return plots.varying(d, [f"s{i}" for i in range(5)], ["gene", "tx"], "counts")


@query(f"{_VARY} SELECT gene, tx, round(sd, 6) AS sd FROM vv")
def variance_filter(spark, sf_dir):
    return _varying(spark, sf_dir).select("gene", "tx", F.round("sd", 6).alias("sd"))


_RANKS = ", ".join(f"(rank() OVER (ORDER BY s{i}) + (count(*) OVER (PARTITION BY s{i}) - 1) / 2)::DOUBLE AS r{i}" for i in range(5))


@query(f"{_VARY}, rk AS (SELECT {_RANKS} FROM vv) " + " UNION ALL ".join(f"SELECT {i}::INT AS a, {j}::INT AS b, round(corr(r{i}, r{j}), 6) AS rho FROM rk" for i in range(5) for j in range(5)))
def spearman(spark, sf_dir):
    return plots.correlations(_varying(spark, sf_dir), 5).withColumn("rho", F.round("rho", 6))


@query("SELECT gene, count(*) FILTER (NOT any_equal) AS incompatible, sum(nobs) FILTER (NOT any_equal)::BIGINT AS counts FROM (SELECT gene, cls, max(nobs) AS nobs, bool_or(equal) AS any_equal FROM ec GROUP BY ALL) GROUP BY 1 HAVING count(*) FILTER (NOT any_equal) > 0")
def incompatible_counts(spark, sf_dir):
    d = eq_rows(spark, sf_dir).groupBy("gene", "cls").agg(F.max("nobs").alias("nobs"), F.bool_or("equal").alias("any_equal")).filter("not any_equal")
    return d.groupBy("gene").agg(F.count(F.lit(1)).alias("incompatible"), F.sum("nobs").alias("counts"))


@query("SELECT read_id, string_agg(tx, ',' ORDER BY tx) AS equal_matches FROM (SELECT DISTINCT read_id, tx FROM (SELECT read_id, chr, strand, string_agg(s || '-' || e, ',' ORDER BY s) AS chain FROM introns GROUP BY ALL) JOIN (SELECT tx, chr, strand, string_agg(s || '-' || e, ',' ORDER BY s) AS chain FROM aintrons GROUP BY ALL) USING (chr, strand, chain)) GROUP BY 1")
def read_to_tx(spark, sf_dir):
    def chained(d, key):
        d = d.withColumn("g", R.introns(F.col("x"))).filter(F.size("g") > 0)
        return d.select(key, "chr", "strand", "g")

    j = chained(reads(spark, sf_dir), "read_id").join(chained(transcripts(spark, sf_dir), "tx"), ["chr", "strand", "g"])
    return j.groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_set("tx")), ",").alias("equal_matches"))


@query(None)
def pca(spark, sf_dir):
    """sample, pc1, pc2, share (of the deviations): the samples' first two principal components over the transcripts that vary."""
    p, share = plots.principal_components(_varying(spark, sf_dir), 5)
    rows = [(f"s{i}", round(float(p[i, 0]), 4), round(float(p[i, 1]), 4), round(float(share[0]), 6)) for i in range(5)]
    return spark.createDataFrame(rows, "sample string, pc1 double, pc2 double, share double")
