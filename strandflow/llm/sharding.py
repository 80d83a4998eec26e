"""Sharding by size-tiered compaction with versioned manifests.

A shard table is a folder: data/<run>/part-*.parquet are immutable shards, manifests/v<N> is the manifest of version N, a
Parquet table with one row per live shard (path, run, bytes, rows, tier, born). `append` writes the rows as they come, as one run of small
shards, one per task and no shuffle, and commits. A run of up to SMALL bytes is of tier 0, and each further tier is of runs FANOUT times
as large. `compact` merges the runs of each tier that has MIN_RUNS of them, read and coalesced without a shuffle, into one
run of shards of about the target size, until no tier has so many; as runs of a tier are of similar size, a row is rewritten about once a
tier. Replaced runs leave the manifest in the same commit and stay on disk for readers of older versions until `vacuum`. A run is live as a
whole or not at all, so readers open folders: what the driver sees of a table is its runs, some for each tier, never its shards.

A commit writes the new manifest under a name of its own and renames it to v<N>; the rename fails if v<N> is there, so of two
writers one wins, and the other puts its change on top of the new version (a compaction whose runs are gone is given up). That is atomic where the
file system renames folders atomically. Readers see a whole version or none. Tasks that are run again after the
loss of an executor write through the committer of Spark's writer; nothing that is not listed in a manifest is ever read.

`vacuum` deletes what no manifest names that is younger than `keep` seconds or the latest: older manifests, and runs that are older themselves.
A run that a writer has not committed yet is younger as long as writing takes less than `keep`.

Sizes of shards are listed by the engine's own file source, row counts by its file metadata, so no file is opened by the driver.

Defined cases: an empty table is appended as one run without rows and is read back with its columns; nulls, empty and very
long texts, repeated rows and any further columns are stored as they are (columns named like the manifest's do not clash,
because the two never meet in one table); ties in size are ordered by path; a version that does not exist is an error.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.llm.common import shared_dir, table

TARGET = 64 << 20
#: The size of the largest runs of tier 0.
SMALL = 4 << 20
FANOUT = 4
MIN_RUNS = 2
#: Seconds that versions and runs are kept for.
KEEP = 7 * 86_400
MANIFEST = "path string, run string, bytes long, rows long, tier int, born int"


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, codec: str = "zstd"):
        self.spark, self.path, self.target, self.codec = spark, path.rstrip("/"), target, codec

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The latest version; 0 if nothing was committed."""
        fs, at = self._files(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v{v}")

    def _listed(self, folder: str) -> DataFrame:
        """path, bytes, rows of the shards in a folder; the engine lists sizes, and counts rows from the files' metadata."""
        f = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", F.col("length").alias("bytes"))
        n = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        name = F.element_at(F.split("path", "/"), -1)
        return f.withColumn("name", name).join(n.select(name.alias("name"), "rows"), "name", "left").select("path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"))

    def _commit(self, live: DataFrame, version: int) -> int:
        """live becomes version, which must not exist yet."""
        temporary = f"{self.path}/manifests/_{uuid.uuid4().hex}"
        live.coalesce(1).write.parquet(temporary)
        jvm, gw = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        new, at = jvm.org.apache.hadoop.fs.Path(temporary), jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/v{version}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = gw.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(new, at, none)
        except Exception as e:
            if self.version() >= version:
                raise ConflictError(f"version {version} is there already") from e
            raise
        return version

    def _change(self, gone: list[str], new: DataFrame, tries: int = 20) -> int | None:
        """Commits the latest version without the runs gone and with the shards new, on top of whatever others have committed meanwhile;
        None if one of gone is no longer live."""
        for k in range(tries):
            v = self.version()
            live = self.manifest(v)
            if gone and live.filter(F.col("run").isin(gone)).select("run").distinct().count() < len(gone):
                return None
            kept = live.filter(~F.col("run").isin(gone)) if gone else live
            try:
                return self._commit(kept.unionByName(new.withColumn("born", F.lit(v + 1))), v + 1)
            except ConflictError:
                if k == tries - 1:
                    raise
        return None

    def _run(self, df: DataFrame, **options) -> DataFrame:
        """df written as a new run; its shards, as manifest rows without born."""
        run = uuid.uuid4().hex
        folder = f"{self.path}/data/{run}"
        df.write.options(compression=self.codec, **options).parquet(folder)
        shards = self._listed(folder).persist()
        size = shards.agg(F.sum("bytes")).first()[0] or 0
        tier = 0 if size <= SMALL else math.ceil(math.log(size / SMALL, FANOUT))
        return shards.withColumn("run", F.lit(run)).withColumn("tier", F.lit(tier)).select("path", "run", "bytes", "rows", "tier")

    def append(self, df: DataFrame, max_rows: int = 1_000_000) -> int:
        """Writes df as a run of small shards, one or more per task, and commits it beside the live ones."""
        return self._change([], self._run(df, maxRecordsPerFile=max_rows))

    def runs(self, version: int | None = None) -> list:
        """run, tier, bytes, rows of the runs of a version: some for each tier."""
        m = self.manifest(version).groupBy("run").agg(F.max("tier").alias("tier"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("born").alias("born"))
        return m.orderBy("born", "run").collect()

    def compact(self) -> int:
        """Merges tiers that have enough runs, until none has; returns the latest version."""
        while True:
            tiers: dict[int, list] = {}
            for r in self.runs():
                tiers.setdefault(r.tier, []).append(r)
            due = [t for t in sorted(tiers) if len(tiers[t]) >= MIN_RUNS]
            if not due:
                return self.version()
            old = tiers[due[0]]
            whole = self.spark.read.parquet(*[f"{self.path}/data/{r.run}" for r in old])
            new = self._run(whole.coalesce(max(1, math.ceil(sum(r.bytes for r in old) / self.target))))
            self._change([r.run for r in old], new)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        runs = self.runs(version)
        if not runs:
            raise ValueError("there is no such version")
        return self.spark.read.parquet(*[f"{self.path}/data/{r.run}" for r in runs])

    def vacuum(self, keep: float = KEEP) -> int:
        """Deletes the manifests older than keep seconds, but for the latest, and the runs older than that which no other names; returns how
        many runs went."""
        before = (time.time() - keep) * 1000
        fs, at = self._files(f"{self.path}/data")
        # runs first: one that is written from here on is not looked at
        there = [(s.getPath(), s.getModificationTime()) for s in fs.listStatus(at)]
        fs_m, at_m = self._files(f"{self.path}/manifests")
        found = [(s.getPath(), s.getModificationTime()) for s in fs_m.listStatus(at_m)]
        latest = max((int(p.getName()[1:]) for p, _ in found if p.getName()[:1] == "v"), default=0)
        stale = [p for p, t in found if t < before and not (p.getName()[:1] == "v" and int(p.getName()[1:]) >= latest)]
        kept = {p.getName() for p, _ in found} - {p.getName() for p in stale}
        live = {r.run for v in kept if v[:1] == "v" for r in self.runs(int(v[1:]))}
        for p in stale:
            fs_m.delete(p, True)
        gone = [p for p, t in there if t < before and p.getName() not in live]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


#: The shares of a table that arrive one after another, in sixteenths, where a whole table is sharded at once.
ARRIVALS = (8, 4, 2, 1, 1)


def sharded(docs: DataFrame, path: str | None = None, target: int = TARGET) -> tuple[ShardTable, int]:
    """docs in the shard table at path (a new one in the shared folder if None).

    They come in several arrivals of different sizes, dealt by a hash of the row, each row in one of them; the table is compacted after
    every second one and at the end."""
    t = ShardTable(docs.sparkSession, path or shared_dir(docs.sparkSession), target)
    part, lo = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, k in docs.dtypes if not k.startswith("map")]), F.lit(sum(ARRIVALS))), 0
    for k, n in enumerate(ARRIVALS):
        t.append(docs.filter((part >= lo) & (part < lo + n)))
        lo += n
        if k % 2:
            t.compact()
    return t, t.compact()


def placed(t: ShardTable, version: int) -> DataFrame:
    """doc_id, shard (its number in the version's manifest), tier, shard_rows, shard_bytes, version: one row per stored row."""
    m = t.manifest(version)
    name = F.element_at(F.split("path", "/"), -1)
    born, part = F.col("born"), F.regexp_extract("name", r"part-(\d+)", 1)
    rank = F.row_number().over(W.orderBy(born, F.col("tier"), part, "name"))
    m = m.withColumn("name", name).select("name", (rank - 1).alias("shard"), "tier", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    rows = t.read(version).select("doc_id", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
    return rows.join(m, "name").select("doc_id", "shard", "tier", "shard_rows", "shard_bytes", F.lit(version).alias("version"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies after the table was appended and compacted."""
    return placed(*sharded(table(spark, sf_dir, "documents")))


SQL = None
