"""Substring dedup with fixed-block anchors.

Every window of WINDOW words that occurs twice holds, in each of its texts, a block of BLOCK words that starts at a multiple of
BLOCK; so the blocks are the index, and the rolling windows of BLOCK words of all texts probe it. The exchange of rolling.py answers
which blocks have a probe elsewhere (blocks ask, other windows tell). Around such an anchor, and only there, hits are extended: every
window of WINDOW words that holds an anchor of its text asks in a second exchange, with 64 bits of hash within its bucket's range,
whether it starts anywhere else. What seems to is asked once more, by another hash function of 64 bits from the words' letters on, among
such windows only: two windows pass for equal only if 128 bits of them are. Adjacent repeated windows join to maximal repeats, which are removed.

Nothing is paired: a passage in n texts costs n entries, and a unit sends each hash once. An exchange's rows are its units times its
buckets, so it has no more buckets than give such a row some hashes, however many partitions there are. Texts are keyed by their MD5, so only
the texts with anchors (then those with repeats) are shuffled, to be met by their few places; a bitmap of fixed size thins the
scan before that. Exact copies of at least WINDOW words are removed wholly, whatever else they hold, and one per partition speaks
for them.

Defined cases: null and empty texts have no words; texts of fewer than WINDOW words lose nothing; windows may overlap themselves
(a a a ...); the order and number of copies do not matter, as all of them are removed; rows are kept apart by the row itself;
an empty table gives an empty result; other columns are ignored or carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import flagged, table, written
from strandflow.llm.rolling import ROWS, answers, hits_by_text, runs, to_buckets, word_hashes

WINDOW, BLOCK = 35, 18
#: Bytes of text for each bucket of the hash range; a bucket's hashes, about as many bytes, meet in one task.
BUCKET_BYTES = 64 << 20
#: Hashes of a unit for one bucket, on average at least; with fewer a row costs more than what it carries.
ROW_HASHES = 128
#: Words of a unit; a longer text is a unit of its own.
UNIT_WORDS = 1_500_000
#: Bytes of text that are hashed at a time.
PIECE = 1 << 18


def _units(batches, extra: str | None = None, which: int = 0):
    """(digests, word hashes, words of each text, extra column) of some distinct texts of the partition, unit by unit."""
    seen: set[bytes] = set()
    digests, hashes, counts, more, total = [], [], [], [], 0
    for pdf in batches:
        part, size = [], 0
        ids, values = pdf["digest"].tolist(), pdf[extra].tolist() if extra else [None] * len(pdf)
        texts = pdf["text"].tolist()
        for k, (d, t, x) in enumerate(zip(ids, texts, values, strict=True)):
            key = bytes.fromhex(d)
            if key not in seen:
                if len(seen) > 500_000:  # forgetting only means that a copy speaks again
                    seen.clear()
                seen.add(key)
                part.append(t.encode())
                size += len(part[-1])
                digests.append(key)
                more.append(x)
            if size >= PIECE or (part and k == len(ids) - 1):
                h, n = word_hashes(part, which)
                hashes.append(h)
                counts.append(n)
                total += len(h)
                part, size = [], 0
                if total >= UNIT_WORDS:
                    yield digests, np.concatenate(hashes), np.concatenate(counts), more
                    digests, hashes, counts, more, total = [], [], [], [], 0
    if digests:
        yield digests, np.concatenate(hashes), np.concatenate(counts), more


def _valid(counts: np.ndarray, n: int) -> np.ndarray:
    """Which places start n words of one text."""
    ok = np.ones(int(counts.sum()), bool)
    end = np.cumsum(counts)
    for k in range(1, n):
        at = end - k
        ok[at[counts >= k]] = False
    return ok


def anchors(buckets: int, bits: int):
    def units(batches):
        task = TaskContext.get().partitionId()
        for seq, (digests, h, counts, _) in enumerate(_units(batches)):
            uid = task << 24 | seq
            long = counts >= WINDOW
            first = np.cumsum(counts) - counts
            ok = _valid(counts, BLOCK) & np.repeat(long, counts)
            w = runs(h, BLOCK)
            ok = ok[: len(w)]
            within = np.arange(len(h)) - np.repeat(first, counts)
            block = np.flatnonzero(ok & (within[: len(w)] % BLOCK == 0))
            every = np.sort(w[ok])
            new = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
            uniq = every[new]
            if not len(uniq):
                continue
            n = np.diff(np.r_[np.flatnonzero(new), len(every)])
            at = np.searchsorted(uniq, w[block])
            alone = n[at] == 1
            tell = np.ones(len(uniq), bool)
            tell[at[alone]] = False
            rows = to_buckets(uid, uniq[tell], w[block[alone]], block[alone], buckets, bits)
            rows.append(((task + seq) % buckets, uid, 1, first[long].astype(np.uint32).tobytes(), b"".join(d for d, x in zip(digests, long, strict=True) if x), block[~alone].astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "uid", "kind", "a", "b", "c"])

    return units


def extended(buckets: int, which: int = 0):
    """The windows that hold an anchor ask; with which = 1 those that the places are of, by the other hash function."""

    def units(batches):
        task = TaskContext.get().partitionId()
        for seq, (digests, h, counts, anchor) in enumerate(_units(batches, "places", which)):
            uid = task << 24 | seq
            first = np.cumsum(counts) - counts
            w = runs(h, WINDOW, which)
            at = np.concatenate([np.frombuffer(a, np.uint32).astype(np.int64) + f for a, f in zip(anchor, first, strict=True)])
            if which:
                place = np.sort(at)
            else:
                ok = _valid(counts, WINDOW)[: len(w)]
                near = np.zeros(len(h) + WINDOW + 1, np.int32)
                np.add.at(near, np.maximum(at - (WINDOW - BLOCK), 0), 1)
                np.add.at(near, at + 1, -1)
                place = np.flatnonzero(ok & (np.cumsum(near)[: len(w)] > 0))
            order = np.argsort(w[place], kind="stable")
            s = w[place][order]
            if not len(s):
                continue
            new = np.r_[True, s[1:] != s[:-1]]
            n = np.repeat(size := np.diff(np.r_[np.flatnonzero(new), len(s)]), size)
            alone = n == 1
            rows = to_buckets(uid, s[~alone & new], s[alone], place[order][alone], buckets, 64)
            rows.append(((task + seq) % buckets, uid, 1, first.astype(np.uint32).tobytes(), b"".join(digests), place[order][~alone].astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "uid", "kind", "a", "b", "c"])

    return units


def _places(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(d.hex(), p.astype(np.uint32).tobytes()) for d, p in hits_by_text(rows)], columns=["digest", "places"])


def _asked(units: DataFrame) -> DataFrame:
    """digest, places (binary, 32 bits each, sorted): the hits of each text."""
    told = written(units.groupBy("bucket").applyInPandas(answers, ROWS))
    by_text = told.groupBy("uid").applyInPandas(_places, "digest string, places binary")
    # copies of a text have the same hits; one row speaks for them
    return written(by_text.groupBy("digest").agg(F.max("places").alias("places")))


def bucket_count(size: int, hashes: int, tasks: int, shuffled: int) -> int:
    """Buckets of an exchange of about so many hashes from so many tasks; size is the bytes of all texts, shuffled the shuffle's partitions.

    Several for each of the shuffle's tasks, but with ROW_HASHES in a row: a bucket for each partition from each partition's task
    would be the square of the partitions. What a task can hold goes before."""
    units = tasks + hashes // UNIT_WORDS
    return max(1, -(-size // BUCKET_BYTES), min(4 * shuffled, hashes // (units * ROW_HASHES)))


def repeats(docs: DataFrame) -> DataFrame:
    """digest (MD5 of the text), places: the words at which repeated windows start, of each text that has any; texts that
    are copied wholly may miss places, since copies() has them."""
    spark = docs.sparkSession
    size, last = docs.select(F.octet_length("text").alias("size"), F.spark_partition_id().alias("task")).agg(F.sum("size"), F.max("task")).first()
    size, scanned = size or 0, (last or 0) + 1
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.filter(F.col("text").isNotNull()).select(F.md5("text").alias("digest"), "text")

    def near(found: DataFrame) -> DataFrame:
        return flagged(d, found, "digest", "near").filter("near").drop("near").join(found, "digest")

    def sized(found: DataFrame, each: int) -> int:
        """Buckets where each place of the found ones asks so many hashes; their texts come by a scan or a shuffle."""
        places = (found.agg(F.sum(F.octet_length("places"))).first()[0] or 0) // 4
        return bucket_count(size, each * places, max(scanned, shuffled), shuffled)

    buckets = bucket_count(size, size // 8, scanned, shuffled)  # a word takes about as many bytes as its hash
    found = _asked(d.mapInPandas(anchors(buckets, min(64, 33 + buckets.bit_length())), ROWS))
    found = _asked(near(found).mapInPandas(extended(sized(found, WINDOW - BLOCK + 1)), ROWS))
    return _asked(near(found).mapInPandas(extended(sized(found, 1), 1), ROWS))


def copies(docs: DataFrame) -> DataFrame:
    """digest of each text that several rows have."""
    return docs.filter(F.col("text").isNotNull()).groupBy(F.md5("text").alias("digest")).count().filter("count > 1").select("digest")


def removed(n: int, places: np.ndarray) -> np.ndarray:
    """Which of n words the windows that start at places cover: maximal repeats."""
    edge = np.zeros(n + 1, np.int32)
    edge[places] += 1
    edge[places + WINDOW] -= 1
    return np.cumsum(edge)[:n] > 0


def _kept(batches):
    for pdf in batches:
        rows = []
        for doc_id, text, copied, places in zip(pdf["doc_id"], pdf["text"], pdf["copied"], pdf["places"], strict=True):
            w = text.encode().split() if text is not None else []
            gone = 0
            if copied and len(w) >= WINDOW:
                gone, w, n = len(w), [], len(w)
            elif places is not None:
                n = len(w)
                cut = removed(n, np.frombuffer(places, np.uint32).astype(np.int64))
                gone = int(cut.sum())
                w = [x for x, c in zip(w, cut.tolist(), strict=True) if not c]
            else:
                n = len(w)
            rows.append((doc_id, n, gone, hashlib.sha256(b" ".join(w)).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
        out["doc_id"] = pdf["doc_id"].to_numpy()
        yield out


def deduped(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row of docs."""
    d = docs.select("doc_id", "text", F.md5("text").alias("digest"))
    marks = repeats(docs.select("text")).withColumn("copied", F.lit(False))
    marks = marks.unionByName(copies(docs.select("text")).select("digest", F.lit(None).cast("binary").alias("places"), F.lit(True).alias("copied")))
    marks = written(marks.groupBy("digest").agg(F.max("places").alias("places"), F.max("copied").alias("copied")))
    d = flagged(d, marks, "digest", "marked")
    none = d.filter(~F.col("marked")).select("doc_id", "text", F.lit(False).alias("copied"), F.lit(None).cast("binary").alias("places"))
    some = d.filter("marked").join(marks, "digest", "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "places")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string"
    return none.mapInPandas(_kept, schema).unionByName(some.mapInPandas(_kept, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM m),
x AS (SELECT r, count(*) AS n, list(i) AS at FROM c GROUP BY r),
kept AS (SELECT r, string_agg(t, ' ' ORDER BY i) AS k FROM (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN x USING (r) LEFT JOIN kept USING (r)"""
