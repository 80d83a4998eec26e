"""Token counts by rank-synchronous merging over ragged numpy arrays.

A text is cut at the special strings (one token each, as the library does by default) and by the pre-tokenizer's pattern.
Pre-tokens not met before are merged together: their byte symbols lie in one flat array with a sequence number beside each
symbol; in every round each sequence applies its lowest-ranked pair at all its places, and sequences without a pair leave.
The surviving symbols are counted. Counts of pre-tokens are kept in a bounded dictionary of the worker.

Defined cases: null and empty texts have no bytes and no tokens; a pre-token of any length is one sequence (its rounds shrink
it geometrically for runs); rows, repeated rows and other columns are kept apart by the row itself; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import table

LIMIT = 1024
#: Pre-tokens whose counts a worker keeps, and their greatest length.
KEPT, KEPT_CHARS = 400_000, 64


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """A byte-level BPE vocabulary as sorted arrays of pair keys."""

    def __init__(self, spec: dict, pattern: str):
        import regex

        vocab = spec["model"]["vocab"]
        self.width = max(vocab.values()) + 1
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        new = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int64), new
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.find = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def ranks(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each symbol; a large number where there is none."""
        none = np.iinfo(np.int64).max
        out = np.full(len(sym), none, np.int64)
        if len(sym) > 1:
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[:-1] = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.rank[at], none)
        return out

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        total = np.zeros(len(pieces), np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        none = np.iinfo(np.int64).max
        while len(sym):
            rank = self.ranks(sym, seq)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seq)])
            done = least == none
            total[seq[first[done]]] = size[done]
            hit = (rank == np.repeat(least, size)) & (rank != none)
            # of overlapping places (a a a) the leftmost goes first: every other one of a run of adjacent hits
            at = np.flatnonzero(hit)
            if len(at):
                head = np.r_[True, np.diff(at) != 1]
                start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
                sym[at] = self.new[rank[at]]
            keep = np.repeat(~done, size)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return total

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        cut, known = self.cut, self.known
        found, extra = [], []
        for text in texts:
            parts = [text] if cut is None or not any(s in text for s in self.specials) else cut.split(text)
            extra.append(len(parts) - 1)
            found.append(self.find(parts[0]) if len(parts) == 1 else [x for p in parts for x in self.find(p)])
        new = list(set(chain.from_iterable(found)).difference(known))
        fresh: dict[str, int] = {}
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            fresh.update(zip(part, self.counts([p.encode() for p in part]).tolist(), strict=True))
        known.update(fresh)
        out = [sum(map(known.__getitem__, f)) + e for f, e in zip(found, extra, strict=True)]
        if len(known) > KEPT:
            known.clear()
        for p in new:
            if len(p) > KEPT_CHARS:
                known.pop(p, None)
        return out


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        return RankMerger(json.load(f), public_tokenizers.PATTERN)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. vocabulary: the file of a byte-level vocabulary, present on every machine."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        m, out, part, chars = merger(path), [], [], 0
        for t in texts:
            part.append(t or "")
            chars += len(part[-1])
            if chars > 2_000_000:
                out += m.count(part)
                part, chars = [], 0
        return pd.Series(out + m.count(part), dtype="int64")

    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


SQL = None
