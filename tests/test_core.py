"""Ranges, joins, sources, EM and scores on hand-made cases, and each query against its SQL twin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import boosting, compare, genes, junctions, ordered, quantify, scoring
from strandflow.operators.interval_join import nearest_equal, overlap_join, reduced, within_join
from strandflow.plans.catalog import ORACLES, QUERIES
from strandflow.sources import bam, genome, gtf
from strandflow.streaming.accumulate import chain_counts

SF = "/root/testdata/sf0.001"
LIST = "tx string, gene string, txid long, chr string, strand string, x array<struct<s:long,e:long>>"
A, B, C = [(100, 200), (300, 400), (500, 600)], [(300, 400), (500, 600)], [(100, 200), (500, 600)]


def transcripts(spark, strand="+"):
    d = spark.createDataFrame([(n, "g", i, "chr1", strand, x) for i, (n, x) in enumerate((("A", A), ("B", B), ("C", C)), 1)], LIST)
    return d.withColumn("s", F.col("x")[0]["s"]).withColumn("e", F.element_at("x", -1)["e"])


def one(spark, column, **cols):
    return spark.range(1).select(column.alias("v")).first().v


def ranges(*x):
    return F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in x])


def test_ranges(spark):
    assert [tuple(r) for r in one(spark, R.introns(ranges(*A)))] == [(201, 299), (401, 499)]
    assert [tuple(r) for r in one(spark, R.cut_terminals(ranges(*A)))] == [(199, 200), (300, 400), (500, 501)]
    assert [r.rank for r in one(spark, R.ranks(ranges(*A), F.lit("-")))] == [3, 2, 1]
    assert one(spark, R.setdiff_width(ranges(*A), ranges(*C))) == 101
    assert one(spark, R.introns(ranges((1, 5)))) == []
    assert [tuple(r) for r in one(spark, R.from_fragments(F.lit(100), F.lit(600), R.introns(ranges(*A))))] == A
    assert one(spark, R.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert [one(spark, R.motif_strand(F.lit(m))) for m in ("GT-AG", "CT-AC", "AA-AA")] == ["+", "-", "*"]


def test_equivalence_classes(spark):
    got = {r.tx: r.eq for r in genes.equivalence(transcripts(spark)).collect()}
    assert got == {"A": [1], "B": [1, 2], "C": [3]}


def test_reduce_merges_touching(spark):
    d = spark.createDataFrame([("c", 900, 950), ("c", 940, 990), ("c", 991, 995), ("c", 1000, 1001)], "k string, s long, e long")
    assert sorted((r.s, r.e, r.n) for r in reduced(d, ["k"]).collect()) == [(900, 995, 3), (1000, 1001, 1)]


def test_overlap_join_counts_each_pair_once(spark):
    r = np.random.default_rng(1)
    a = [("c", int(s), int(s + w)) for s, w in zip(r.integers(0, 5000, 200), r.integers(0, 900, 200), strict=True)]
    b = [("c", int(s), int(s + w)) for s, w in zip(r.integers(0, 5000, 200), r.integers(0, 900, 200), strict=True)]
    left, right = spark.createDataFrame(a, "k string, s long, e long"), spark.createDataFrame(b, "k string, rs long, re long")
    for least in (1, 10):
        got = sorted((x.s, x.e, x.rs, x.re) for x in overlap_join(left, right, ["k"], least).collect())
        assert got == sorted((s, e, u, v) for _, s, e in a for _, u, v in b if min(e, v) - max(s, u) + 1 >= least)
    semi = overlap_join(left.distinct(), right, ["k"], 1, how="left_semi").count()
    assert semi + overlap_join(left.distinct(), right, ["k"], 1, how="left_anti").count() == left.distinct().count()


def test_nearest_within_tolerance(spark):
    left = spark.createDataFrame([("c", 203, 298), ("c", 500, 600)], "k string, s long, e long")
    right = spark.createDataFrame([("c", 201, 299), ("c", 203, 308)], "k string, rs long, re long")
    assert [(r.s, r.rs, r.distance) for r in nearest_equal(left, right, ["k"]).collect()] == [(203, 201, 2)]


def test_em_conserves_mass_and_separates(spark):
    rows = [(1, "a", 1, 10, True, False), (1, "b", 2, 30, True, False), (1, "ab", 1, 20, False, True), (1, "ab", 2, 20, False, True), (2, "x", 7, 5, True, False)]
    d = spark.createDataFrame(rows, "gene int, cls string, tx int, nobs int, equal boolean, multi boolean").withColumn("aval", F.lit(1.0))
    got = {r.tx: r for r in quantify.quantified(d, tolerance=1e-9).collect()}
    assert sum(got[t].counts for t in (1, 2)) == pytest.approx(60)
    assert got[7].counts == pytest.approx(5)
    assert got[2].unique_counts == pytest.approx(30)


def test_ndr_is_monotone(spark):
    d = spark.createDataFrame([(str(i), i / 10, i % 2 == 0) for i in range(1, 10)], "id string, score double, label boolean")
    got = [r.ndr for r in scoring.ndr(d).orderBy(F.desc("score")).collect()]
    assert got == sorted(got) and got[-1] == pytest.approx(5 / 9, abs=1e-5)


def test_novel_genes_join_chains(spark):
    rows = [("r1", 1, 10), ("r1", 100, 110), ("r2", 105, 120), ("r2", 200, 210), ("r3", 205, 220), ("r4", 500, 510)]
    d = spark.createDataFrame([(a, "c", "+", s, e) for a, s, e in rows], "read_id string, chr string, strand string, s long, e long")
    got = {r.read_id: r.gene for r in genes.novel(d).collect()}
    assert got["r1"] == got["r2"] == got["r3"] != got["r4"]


def test_strand_correction_only_when_more_match(spark):
    rows = [("r", "c", 10, 20, "+"), ("r", "c", 30, 40, "+"), ("r", "c", 50, 60, "*")]
    i = spark.createDataFrame(rows, "read_id string, chr string, s long, e long, jstrand string")
    known = spark.createDataFrame([("c", 50, 60, "+"), ("c", 10, 20, "+")], "chr string, s long, e long, strand string")
    got = {r.s: r.jstrand for r in junctions.corrected_strands(i, known).collect()}
    assert got[50] == "+"
    # without any match to begin with there is nothing to improve on
    got = {r.s: r.jstrand for r in junctions.corrected_strands(i, known.filter("s = 50")).collect()}
    assert got[50] == "*"


def test_gtf_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.gtf")
    gtf.write_gtf(transcripts(spark, "-"), path)
    got = sorted((r.tx, r.s, r.e, r.exon_number) for r in gtf.read_gtf(spark, path, ("exon_number",)).collect())
    assert got[:3] == [("A", 100, 200, "3"), ("A", 300, 400, "2"), ("A", 500, 600, "1")]


def test_fasta_and_sam(spark, tmp_path):
    path = str(tmp_path / "g.fa")
    (tmp_path / "g.fa").write_text(">c1 some text\nACGT\nAC\n>c2\nGGG\n>c3\n")
    g = genome.read_fasta(spark, path, 4)
    assert sorted((r.chr, r.chunk, r.seq) for r in g.collect()) == [("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c2", 0, "GGG")]
    assert {r.chr: r.length for r in genome.lengths(spark, path).collect()} == {"c1": 6, "c2": 3, "c3": 0}
    d = spark.createDataFrame([("c1", 3, 5), ("c1", 1, 9), ("c2", 2, 2), ("cx", 1, 2)], "chr string, a long, b long")
    got = {(r.chr, r.a): r.seq for r in genome.sequence_at(d, g, F.col("a"), F.col("b"), "seq", 4).collect()}
    assert got == {("c1", 3): "GTA", ("c1", 1): "ACGTAC", ("c2", 2): "G", ("cx", 1): None}
    (tmp_path / "g.fa.fai").write_text("c2\t3\t26\t3\t4\n")
    assert [r.chr for r in genome.lengths(spark, path).collect()] == ["c2"]
    sam = "@HD\tVN:1\nq1\t0\tc1\t10\t60\t5M10N3M2I4D1N2M\t*\t0\t0\t*\t*\nq2\t256\tc1\t10\t60\t5M\t*\t0\t0\t*\t*\nq3\t16\tc1\t3\t60\t4M\t*\t0\t0\t*\t*\n"
    (tmp_path / "a.sam").write_text(sam)
    got = {r.read_id: (r.strand, [tuple(x) for x in r.x]) for r in gtf.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert got == {"q1": ("+", [(10, 14), (25, 31), (33, 34)]), "q3": ("-", [(3, 6)])}


def test_bam_in_any_ranges(spark, tmp_path):
    """Each record once, whatever the ranges; blocks cut records anywhere."""
    r = np.random.default_rng(3)
    rows = [(f"read{k}", int(r.choice([0, 16, 256, 4])), f"chr{k % 3 + 1}", int(r.integers(1, 9000)), f"{r.integers(5, 90)}M{r.integers(20, 90)}N{r.integers(5, 90)}M") for k in range(3000)]
    refs = [(f"chr{i}", 10_000) for i in (1, 2, 3)]
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(bam.encoded(rows, refs, 1777))
    want = sorted(rows)
    for size in (1 << 30, 7000, 1234):
        assert sorted(tuple(x) for x in bam.scan_bam(spark, path, size).collect()) == want, size
    assert bam.read_bam(spark, path).count() == sum(f in (0, 16) for _, f, *_ in rows)
    (tmp_path / "b.bam").write_bytes(bam.encoded([], refs))
    assert bam.scan_bam(spark, str(tmp_path / "b.bam")).collect() == []
    assert bam.sample_files([path, str(tmp_path / "b.bam")]) == {"a": path, "b": str(tmp_path / "b.bam")}


def test_transcript_database(spark, tmp_path):
    import sqlite3

    from strandflow.sources.txdb import read_txdb

    path = str(tmp_path / "t.sqlite")
    with sqlite3.connect(path) as c:
        c.executescript("""create table transcript (_tx_id int, tx_name text, tx_chrom text, tx_strand text); create table gene (gene_id text, _tx_id int);
        create table splicing (_tx_id int, exon_rank int, _exon_id int); create table exon (_exon_id int, exon_start int, exon_end int);
        insert into transcript values (1, 'a', 'c', '+'), (2, 'a', 'c', '+'), (3, 'b', 'c', '-'); insert into gene values ('g', 1), ('h', 2);
        insert into exon values (1, 10, 20), (2, 30, 40), (3, 50, 60); insert into splicing values (1, 1, 1), (1, 2, 2), (2, 1, 3), (3, 1, 3);""")
    got = sorted(tuple(r) for r in read_txdb(spark, path).collect())
    assert got == [("c", 10, 20, "+", "g", "a"), ("c", 30, 40, "+", "g", "a"), ("c", 50, 60, "-", "", "b")]


def test_boosting_parts_two_halves():
    """A hundred thousand rows, the first half of one class: the first cut and leaves are those of exact second-order steps."""
    x = np.arange(1, 300_001).reshape(3, -1).T
    m = boosting.fit(x, np.r_[np.ones(50_000), np.zeros(50_000)], rounds=3)
    feature, cut, _, _, _, value = m.trees[0]
    assert feature[0] == 0 and cut[0] == 50_000.5 and sorted(np.round(value[1:3], 6)) == [-0.599952, 0.599952]
    p = m.predict(x)
    assert (p[:50_000] > 0.5).all() and (p[50_000:] < 0.5).all()


def test_boosting_learns_missing_values():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 3))
    y = (x[:, 0] + x[:, 1] > 0) | (r.random(2000) < 0.1)
    x[y & (r.random(2000) < 0.5), 2] = np.nan
    m = boosting.fit(x, y)
    assert np.mean((m.predict(x) > 0.5) == y) > 0.9
    assert np.ptp(boosting.fit(np.ones((50, 2)), np.ones(50), rounds=2).predict(np.ones((3, 2)))) == 0
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(np.zeros((0, 2)), np.zeros(0))


def test_running_sums_and_medians(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("v"))
    got = {r.k: r.upto for r in ordered.cumulated(d, ["k"], upto=F.col("v")).collect()}
    by = {k * 7 % 1000: k % 3 for k in range(1000)}
    assert all(got[k] == sum(by[j] for j in range(k + 1)) for k in (0, 1, 500, 999))
    assert tuple(ordered.median(d, "k").first()) == (1000, 499.5)
    assert tuple(ordered.median(d.filter("k < 5"), "k").first()) == (5, 2.0)
    assert tuple(ordered.median(d.filter("k < 0"), "k").first()) == (0, None)


def test_ranges_of_mixed_widths_meet_once(spark):
    r = np.random.default_rng(5)
    a = [("c", int(s), int(s + w)) for s, w in zip(r.integers(0, 200_000, 300), r.integers(0, 3, 300) * r.integers(1, 60_000, 300), strict=True)]
    b = [("c", int(s), int(s + w)) for s, w in zip(r.integers(0, 200_000, 300), r.integers(0, 3, 300) * r.integers(1, 60_000, 300), strict=True)]
    left, right = spark.createDataFrame(a, "k string, s long, e long"), spark.createDataFrame(b, "k string, rs long, re long")
    for hot in (None, 10):
        got = sorted((x.s, x.e, x.rs, x.re) for x in overlap_join(left, right, ["k"], hot=hot).collect())
        assert got == sorted((s, e, u, v) for _, s, e in a for _, u, v in b if s <= v and u <= e)
        inside = sorted((x.s, x.e, x.rs, x.re) for x in within_join(left, right, ["k"], hot=hot).collect())
        assert inside == sorted((s, e, u, v) for _, s, e in a for _, u, v in b if u <= s and e <= v)


def test_descriptors(spark):
    """Skipped exon, retained intron, shifted splice sites, and terminal exons of their own, on either strand."""
    q = [[(100, 200), (500, 600)], [(100, 400), (500, 600)], [(100, 210), (300, 400), (500, 600)], [(700, 800), (900, 950)]]
    rows = [(i, s, [tuple(r) for r in x], A) for i, x in enumerate(q) for s in "+-"]
    d = spark.createDataFrame(rows, "id int, strand string, x array<struct<s:long,e:long>>, y array<struct<s:long,e:long>>")
    got = {(r.id, r.strand): r for r in compare.described(d, F.col("x"), F.col("y"), F.col("strand"), ["id", "strand"]).collect()}
    assert got[0, "+"].exon_skipping_query == 1 and got[0, "+"].exon_skipping_subject == 0
    assert got[1, "+"].intron_retention_query == 1 and got[1, "+"].intron_retention_subject == 0
    assert (got[2, "+"].exon_5prime, got[2, "+"].exon_3prime) == (0, 0) and not got[2, "+"].alternative_first_exon
    assert got[3, "+"].alternative_first_exon and got[3, "-"].alternative_last_exon and not got[3, "+"].internal_first_exon_query


def test_workflow_from_files_to_counts(spark, tmp_path):
    """Alignments, annotation and genome in files; known transcripts are counted, a novel one is found, files are written."""
    from strandflow import workflow

    size, pos = 6000, "ACGT"
    seq = list("".join(pos[(i * 7 + i // 5) % 4] for i in range(size)))
    known = {"tx1": ("g1", "+", [(101, 300), (501, 700), (1001, 1300)]), "tx2": ("g1", "+", [(101, 300), (1001, 1300)]), "tx3": ("g2", "-", [(3001, 3200), (3501, 3800)])}
    novel = ("+", [(101, 300), (701, 800), (1001, 1300)])
    for strand, x in [*[v[1:] for v in known.values()], novel]:
        for (_, a), (b, _) in zip(x, x[1:], strict=False):
            donor, acceptor = ("GT", "AG") if strand == "+" else ("CT", "AC")
            seq[a : a + 2], seq[b - 3 : b - 1] = donor, acceptor
    (tmp_path / "g.fa").write_text(">c1\n" + "\n".join("".join(seq[i : i + 60]) for i in range(0, size, 60)) + "\n")
    lines = [f'c1\tx\texon\t{s}\t{e}\t.\t{st}\t.\tgene_id "{g}"; transcript_id "{t}";' for t, (g, st, x) in known.items() for s, e in x]
    (tmp_path / "a.gtf").write_text("\n".join(lines) + "\n")

    def sam(name, strand, x):
        cigar = "".join(f"{e - s + 1}M" + (f"{x[i + 1][0] - e - 1}N" if i + 1 < len(x) else "") for i, (s, e) in enumerate(x))
        return f"{name}\t{16 if strand == '-' else 0}\tc1\t{x[0][0]}\t60\t{cigar}\t*\t0\t0\t*\t*"

    reads = [sam(f"{t}_{k}", st, x) for t, n, (st, x) in (("a", 6, known["tx1"][1:]), ("b", 4, known["tx2"][1:]), ("c", 5, known["tx3"][1:]), ("d", 8, novel)) for k in range(n)]
    reads += [sam(f"u{k}", "+", [(5000 + k, 5200)]) for k in range(3)]
    (tmp_path / "s1.sam").write_text("\n".join(reads) + "\n")
    a = workflow.prepare_annotations(spark, str(tmp_path / "a.gtf"))
    assert {r.tx: r.eq for r in a.collect()} == {"tx1": [1], "tx2": [2], "tx3": [3]}
    out = workflow.run(spark, str(tmp_path / "s1.sam"), a, str(tmp_path / "g.fa"), threshold=1.0, track_reads=True, distances=True, output=str(tmp_path))
    ext = {r.tx: r for r in out.annotations.collect()}
    assert set(known) < set(ext) and len(ext) == 4
    (new,) = set(ext) - set(known)
    assert ext[new].gene == "g1" and [tuple(r) for r in ext[new].x] == novel[1] and ext[new].novel_transcript
    counts = {r.tx: r.counts for r in out.counts.collect()}
    assert {t: counts[t] for t in known} == pytest.approx({"tx1": 6, "tx2": 4, "tx3": 5}) and counts[new] == pytest.approx(8)
    maps = {r.read_id: r.equal_matches for r in out.read_maps.collect()}
    assert maps["a_0"] == ["tx1"] and maps["d_3"] == [new]
    assert {r.gene: r.counts for r in workflow.transcript_to_gene_expression(out).collect()} == pytest.approx({"g1": 18, "g2": 5})
    workflow.write_output(out, str(tmp_path / "out"))
    assert gtf.read_gtf(spark, str(tmp_path / "out" / "extended_annotations.gtf")).count() == 10
    head = spark.read.csv(str(tmp_path / "out" / "counts_transcript.txt"), sep="\t", header=True)
    assert head.columns == ["TXNAME", "GENEID", "s1"] and head.count() == 4
    again = workflow.run(spark, str(tmp_path / "s1_readClasses.parquet"), a, threshold=1.0, quant=False)
    assert again.annotations.count() == 4 and again.counts is None


def test_workflow_checks_its_inputs(spark):
    from strandflow import workflow

    a = spark.createDataFrame([], workflow.EMPTY)
    for reads, annotations, sequence in (({}, a, None), ("x.bam", a, None), ({"a": "x.bam", "b": "y.parquet"}, a, "g.fa"), ("x.parquet", a.drop("eq"), None)):
        with pytest.raises(ValueError):
            workflow.run(spark, reads, annotations, sequence)
    with pytest.warns(UserWarning, match="no option"):
        o = workflow.Options().with_(nothing=1, slack=7)
    assert o.slack == 7 and o.exon_distance == 35


def test_stream_counts_as_batch(spark, tmp_path):
    src, n = str(tmp_path / "in"), [0]
    transcripts(spark).unionByName(transcripts(spark)).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = chain_counts(stream).writeStream.outputMode("complete").format("memory").queryName("chains").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    n[0] = spark.sql("select sum(read_count) from chains").first()[0]
    assert n[0] == 6


def _rows(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)
    return cols, sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(c.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pairs_have_all_transcripts_of_a_locus(spark, tmp_path):
    """Two reads of one locus and three transcripts of it (l_orderkey by 10): all six pairs, by each query."""
    keys = [k for k in range(1, 300_000) if (k % 7 % 5, k % 3 == 0, k % 41) == (0, False, 5)]
    reads, tx = [k for k in keys if k % 10][:2], [k for k in keys if k % 10 == 0][:3]
    lines = [(k, n, n + k % 3, n, float(n)) for k in reads + tx for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("splice_compatible", "compare_transcripts", "range_setdiff_width", "parallel_overlap"):
        found = {(r.read_id, r.tx) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert found == {(r, f"tx{t}") for r in reads for t in tx}, name
