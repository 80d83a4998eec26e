"""Cutting lineage: tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir (a temporary folder where that is unset, as in tests). Lineage ends there,
    so an iteration does not recompute its past, and a lost executor costs nothing that was already written."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = tempfile.mkdtemp(prefix="strandflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/strandflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
