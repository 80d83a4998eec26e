"""Genome sequences: FASTA by index, in chunks of a fixed size, and the bases at given ranges.

Defined cases: records without bases have no chunk; lower-case bases stay as they are; a range beyond its chromosome has the bases that
there are, one without any (or on an unknown chromosome) is null; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of a chunk.
CHUNK = 1 << 16
INDEX = "chr string, length long, offset long, line_bases int, line_bytes int"


def _opened(path: str):
    """A readable, seekable file of whatever file system the path names."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """chr, length, offset, line_bases, line_bytes of each record: from path.fai if that is there, else by one pass over the file,
    which is read line by line in one task."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            try:
                with _opened(f"{path}.fai") as f:
                    rows = [line.split("\t")[:5] for line in f.read().decode().splitlines() if line]
                yield pd.DataFrame([(r[0], *map(int, r[1:])) for r in rows], columns=["chr", "length", "offset", "line_bases", "line_bytes"])
                continue
            except FileNotFoundError:
                pass
            out, at = [], 0
            with _opened(path) as f:
                rest = b""
                while True:
                    block = f.read(1 << 22)
                    lines = (rest + block).split(b"\n")
                    rest = lines.pop() if block else b""
                    for line in lines:
                        at += len(line) + 1
                        bare = line.rstrip(b"\r")
                        if line.startswith(b">"):
                            out.append([line[1:].split(maxsplit=1)[0].decode() if line[1:].strip() else "", 0, at, 0, 0])
                        elif out:
                            if not out[-1][3]:
                                out[-1][3:] = [len(bare), len(line) + 1]
                            out[-1][1] += len(bare)
                    if not block:
                        break
            yield pd.DataFrame(out, columns=["chr", "length", "offset", "line_bases", "line_bytes"])

    return spark.range(1, numPartitions=1).mapInPandas(scan, INDEX)


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """chr, chunk (number from 0), seq: each chunk is read from its own place in the file, so no record is ever held whole."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _opened(path) as f:
            for pdf in batches:
                seqs = []
                for r in pdf.itertuples(index=False):
                    lo, hi = r.chunk * chunk, min(r.length, (r.chunk + 1) * chunk)
                    place = [r.offset + p // r.line_bases * r.line_bytes + p % r.line_bases for p in (lo, hi - 1)]
                    f.seek(place[0])
                    seqs.append(f.read(place[1] - place[0] + 1).replace(b"\n", b"").replace(b"\r", b"").decode())
                yield pd.DataFrame({"chr": pdf["chr"], "chunk": pdf["chunk"], "seq": seqs})

    n = F.ceil(F.col("length") / chunk).cast("long")
    d = fasta_index(spark, path).filter("length > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return d.repartition("chr", "chunk").mapInPandas(read, "chr string, chunk long, seq string")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """chr, length of each record."""
    return fasta_index(spark, path).select("chr", "length")


def sequence_at(df: DataFrame, genome: DataFrame, s: Column, e: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df (chr, ...) with the bases of the plus strand from s to e as column `name`.

    Distinct ranges are looked up once, by the chunks that they touch; no sequence is broadcast."""
    d = df.withColumn("_s", s.cast("long")).withColumn("_e", e.cast("long"))
    r = d.select("chr", "_s", "_e").distinct()
    r = r.withColumn("chunk", F.explode(F.expr(f"sequence((greatest(_s, 1) - 1) div {chunk}, greatest((_e - 1) div {chunk}, (greatest(_s, 1) - 1) div {chunk}))")))
    at = F.greatest(F.col("_s") - F.col("chunk") * chunk, F.lit(1))
    size = F.col("_e") - F.col("chunk") * chunk - at + 1
    part = F.substring("seq", at.cast("int"), F.greatest(F.least(size, F.lit(chunk)), F.lit(0)).cast("int"))
    parts = r.join(genome.withColumn("chunk", F.col("chunk").cast("long")), ["chr", "chunk"]).select("chr", "_s", "_e", F.struct("chunk", part.alias("p")).alias("x"))
    whole = parts.groupBy("chr", "_s", "_e").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "").alias(name))
    return d.join(whole, ["chr", "_s", "_e"], "left").select(*df.columns, name)
