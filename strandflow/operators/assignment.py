"""Minimal classes of genes; an empty side of the join gives the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_minimal(observed: DataFrame, members: DataFrame) -> DataFrame:
    """observed (gene, key, nobs) and, with nobs 0, the class of each single transcript (gene, tx), plain and negated."""
    keys = F.array(F.col("tx").cast("string"), (-F.col("tx")).cast("string"))
    least = members.select("gene", F.explode(keys).alias("key")).distinct()
    return observed.join(least, ["gene", "key"], "full").fillna(0, ["nobs"])
