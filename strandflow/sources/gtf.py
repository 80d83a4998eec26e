"""GTF, SAM text and tables of counts: reading and writing as DataFrames.

Defined cases: comment lines, lines of fewer than nine fields and features other than exons are skipped; a missing attribute is an empty string;
strand `.` is `*` in tables and `.` in files; empty tables give empty files; missing counts are written as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "seqname string, source string, type string, start long, end long, score string, strand string, frame string, attribute string"


def attribute(name: str) -> Column:
    """A named attribute, quoted or not; empty if it is not there."""
    return F.regexp_extract("attribute", rf'(?:^|[;\s]){name}\s+"?([^";]+)"?', 1)


def parse_gtf(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The exon rows of lines (value): chr, s, e, strand (`.` as `*`), gene, tx, exon_number, and the extra attributes."""
    f = F.split("value", "\t")
    d = lines.filter(~F.col("value").startswith("#")).select(f.alias("f")).filter((F.size("f") >= 9) & (F.get("f", F.lit(2)) == "exon"))
    d = d.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("chr", "source", "type", "s", "e", "score", "strand", "frame", "attribute"))])
    strand = F.when(F.col("strand") == ".", "*").otherwise(F.col("strand"))
    names = [("gene", "gene_id"), ("tx", "transcript_id"), ("exon_number", "exon_number"), *[(x, x) for x in extra if x != "exon_number"]]
    return d.select("chr", F.col("s").try_cast("long").alias("s"), F.col("e").try_cast("long").alias("e"), strand.alias("strand"), *[attribute(a).alias(n) for n, a in names])


def read_gtf(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return parse_gtf(spark.read.text(path), extra)


def lines(tx: DataFrame, source: str = "strandflow") -> DataFrame:
    """tx, at, line: a transcript line and then its exon lines, of rows (tx, gene, chr, strand, x, s, e)."""
    strand = F.when(F.col("strand") == "*", ".").otherwise(F.col("strand"))
    tab = F.lit("\t")

    def line(kind: str, s: Column, e: Column, more: Column) -> Column:
        return F.concat("chr", tab, F.lit(source), tab, F.lit(kind), tab, s.cast("string"), tab, e.cast("string"), F.lit("\t.\t"), strand, F.lit('\t.\tgene_id "'), F.col("gene"), F.lit('"; transcript_id "'), F.col("tx"), F.lit('";'), more)

    n = F.size("x")
    rank = lambda i: F.when(F.col("strand") == "-", n - i).otherwise(i + 1)
    exons = F.transform("x", lambda r, i: line("exon", r["s"], r["e"], F.concat(F.lit(' exon_number "'), rank(i).cast("string"), F.lit('";'))))
    return tx.select("tx", F.posexplode(F.concat(F.array(line("transcript", F.col("s"), F.col("e"), F.lit(""))), exons)).alias("at", "line"))


def write_gtf(tx: DataFrame, path: str) -> None:
    lines(tx).repartitionByRange("tx").sortWithinPartitions("tx", "at").select("line").write.text(path)


def ranges_of_cigar(pos: Column, cigar: Column) -> Column:
    """The ranges of an alignment that starts at pos: N splits them, insertions and clips take no position; ranges of one position go."""
    n, o = (F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(g)) for g in (1, 2))
    ops = F.zip_with(n, o, lambda n, o: F.struct(n.cast("long").alias("n"), o.alias("o")))
    new = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))
    x = F.aggregate(
        ops,
        F.struct(pos.cast("long").alias("at"), pos.cast("long").alias("s"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out")),
        lambda a, y: F.when(y["o"] == "N", F.struct((a["at"] + y["n"]).alias("at"), (a["at"] + y["n"]).alias("s"), F.concat(a["out"], new(a["s"], a["at"] - 1)).alias("out")))
        .when(y["o"].isin("M", "D", "=", "X"), F.struct((a["at"] + y["n"]).alias("at"), a["s"].alias("s"), a["out"].alias("out")))
        .otherwise(a),
        lambda a: F.concat(a["out"], new(a["s"], a["at"] - 1)),
    )
    return F.filter(x, lambda r: r["e"] > r["s"])


def aligned(d: DataFrame) -> DataFrame:
    """read_id, chr, strand, x of alignment rows (read_id, flag, chr, pos, cigar): mapped, primary ones with a range left."""
    d = d.filter("flag & 256 = 0 and flag & 4 = 0 and cigar != '*'").withColumn("x", ranges_of_cigar(F.col("pos"), F.col("cigar")))
    return d.filter(F.size("x") > 0).select("read_id", "chr", F.when(F.expr("flag & 16 != 0"), "-").otherwise("+").alias("strand"), "x")


def parse_sam(lines: DataFrame) -> DataFrame:
    """read_id, chr, strand, x of SAM lines (value)."""
    f = F.split("value", "\t")
    d = lines.filter(~F.col("value").startswith("@")).select(f[0].alias("read_id"), F.get(f, F.lit(1)).try_cast("int").alias("flag"), F.get(f, F.lit(2)).alias("chr"), F.get(f, F.lit(3)).try_cast("long").alias("pos"), F.get(f, F.lit(5)).alias("cigar"))
    return aligned(d)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def wide(counts: DataFrame, keys: list[str], value: str = "counts", samples: list[str] | None = None) -> DataFrame:
    """One row per key with a column for each sample, missing values 0."""
    p = counts.groupBy(*keys).pivot("sample", samples) if samples else counts.groupBy(*keys).pivot("sample")
    return p.agg(F.first(value)).fillna(0)


def write_counts(counts: DataFrame, keys: list[str], path: str, value: str = "counts") -> None:
    """One tab-separated table with a column per sample, missing values 0."""
    wide(counts, keys, value).write.csv(path, sep="\t", header=True)


def write_output(annotations: DataFrame, counts: DataFrame, lost: DataFrame, path: str, prefix: str = "") -> None:
    """The files of a run under path: the annotation as GTF, a table of each measure by transcript, and counts by gene."""
    from strandflow.operators.quantify import gene_expression

    at = f"{path.rstrip('/')}/{prefix}"
    write_gtf(annotations, f"{at}extended_annotations.gtf")
    for name, value in (("counts", "counts"), ("CPM", "cpm"), ("fullLengthCounts", "full_length_counts"), ("uniqueCounts", "unique_counts")):
        write_counts(counts.withColumnsRenamed({"tx": "TXNAME", "gene": "GENEID"}), ["TXNAME", "GENEID"], f"{at}{name}_transcript.txt", value)
    write_counts(gene_expression(counts, lost).withColumnRenamed("gene", "GENEID"), ["GENEID"], f"{at}counts_gene.txt")
