"""Transcript databases in SQLite: exons by transcript with gene names.

Tables: transcript (_tx_id, tx_name, tx_chrom, tx_strand), splicing (_tx_id, exon_rank, _exon_id), exon (_exon_id, exon_start, exon_end), gene
(gene_id, _tx_id). Defined cases: of transcripts of the same name the first is taken; one without a gene has an empty one; of several genes
the first name is taken.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

QUERY = """
with t as (select min(_tx_id) as id, tx_name from transcript group by tx_name),
g as (select _tx_id, min(gene_id) as gene from gene group by _tx_id)
select t.tx_name, coalesce(g.gene, ''), x.tx_chrom, x.tx_strand, e.exon_start, e.exon_end
from t join transcript x on x._tx_id = t.id join splicing s on s._tx_id = t.id join exon e on e._exon_id = s._exon_id left join g on g._tx_id = t.id
"""


def read_txdb(spark: SparkSession, path: str, rows: int = 50_000) -> DataFrame:
    """chr, s, e, strand, gene, tx of each exon. One task reads the file, some rows at a time; nothing passes through the driver."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                cur = c.execute(QUERY)
                while part := cur.fetchmany(rows):
                    yield pd.DataFrame(part, columns=["tx", "gene", "chr", "strand", "s", "e"])[["chr", "s", "e", "strand", "gene", "tx"]]

    return spark.range(1, numPartitions=1).mapInPandas(scan, "chr string, s long, e long, strand string, gene string, tx string")
