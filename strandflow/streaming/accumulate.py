"""Read classes of a stream of reads: counts are kept per chain, so batches of reads may come in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import ranges as R


def chain_counts(reads: DataFrame) -> DataFrame:
    """chr, strand, chain, read_count; for a streaming DataFrame in complete or update mode."""
    d = reads.withColumn("g", R.introns(F.col("x"))).filter(F.size("g") > 0)
    chain = F.array_join(F.transform("g", lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",")
    return d.groupBy("chr", "strand", chain.alias("chain")).agg(F.count(F.lit(1)).alias("read_count"))
