"""Helpers shared by the training-data operators: the shared folder, tables written to it, and bounded bitmaps."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the bitmap that thins a scan before its shuffle: 1 MB, whatever the input.
BITMAP_BITS = 1 << 23
#: Bits of one cell of Spark's bitmap functions.
CELL_BITS = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders that `written` made in this thread, in order.
_MADE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests, one machine), under a folder of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = tempfile.mkdtemp(prefix="strandflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/strandflow-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost no recomputation.

    The folder stays, as results are read from it lazily; `mark` and `discard` delete what a finished step no longer needs."""
    spark = df.sparkSession
    path = shared_dir(spark)
    _MADE.paths = [*getattr(_MADE, "paths", []), path]
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in this thread's sequence of written folders."""
    return len(getattr(_MADE, "paths", []))


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the folders that this thread wrote since a mark, but for the last `keep` of them."""
    paths = getattr(_MADE, "paths", [])
    end = len(paths) - keep
    for path in paths[since:end]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.paths = paths[:since] + paths[max(end, since) :]


def kept_apart(df: DataFrame, **more) -> DataFrame:
    """df as one struct, row, beside further columns computed from it: no name of df's can clash with one of ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def flagged(docs: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """docs with a boolean column that is true wherever docs[key] is in keys[key], and for few other rows while keys are
    far fewer than BITMAP_BITS.

    docs are narrow frames of our own (see kept_apart), without columns named fl_*. It only thins a scan before a join: a false positive costs a shuffled row, never a result. What is broadcast is a bitmap
    of 1 MB in at most 256 rows, however many keys there are; with very many it lets everything through and the join decides.
    """
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    cells = (
        keys.select(at.alias("fl_at"))
        .groupBy(F.expr(f"fl_at div {CELL_BITS}").alias("fl_cell"))
        .agg(F.expr(f"bitmap_construct_agg(fl_at % {CELL_BITS})").alias("fl_bits"))
    )
    d = docs.withColumn("fl_at", at).withColumn("fl_cell", F.expr(f"fl_at div {CELL_BITS}"))
    d = d.join(F.broadcast(cells), "fl_cell", "left")
    byte = F.conv(F.hex(F.expr(f"substring(fl_bits, cast((fl_at % {CELL_BITS}) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.expr("shiftleft(1, cast(fl_at % 8 as int))")
    return d.withColumn(flag, F.coalesce(byte.bitwiseAND(hit) > 0, F.lit(False))).drop("fl_at", "fl_cell", "fl_bits")
