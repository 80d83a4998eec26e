"""Hashes of words and of runs of words for whole batches of texts, in numpy, and packed exchanges of such hashes.

An exchange lets every unit (some texts of one partition) ask which of its hashes occur elsewhere. A unit sends each bucket of
the hash range one row: the hashes that it asks about with their places, and those that it only tells; sorted and stored as
differences, a told hash takes about three bytes. The bucket answers the places. A hash goes out once per unit, so a run of
words that a third of all texts share costs a row's few bytes per unit and not one entry per text. Two hash functions, of other bases and
steps, are independent of each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
U = np.uint64
_M = (1 << 64) - 1
#: Bases of independent hashes of words, and steps of hashes of runs, by number.
BASES, STEPS = (_BASE, 0xA24BAED4963EE407), (_STEP, 0x9FB21C651E98DF25)
_powers = [np.ones(1, U) for _ in BASES]


def powers(n: int, which: int = 0) -> np.ndarray:
    """The first n powers of a base, modulo 2^64."""
    if len(_powers[which]) < n:
        size = max(64, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            p = np.full(size, BASES[which], U)
            p[0] = 1
            _powers[which] = np.multiply.accumulate(p)
    return _powers[which]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(_MIX)
    h = (h ^ (h >> U(29))) * U(_STEP)
    return h ^ (h >> U(32))


def word_hashes(texts: list[bytes], which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word of all texts in order, the number of words of each text). Words are runs of other than white space."""
    b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if not len(texts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    gap = SPACE[b]
    first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(first, ends)])
    if not len(first):
        return np.zeros(0, U), counts
    size = np.flatnonzero(gap & np.r_[False, ~gap[:-1]]) - first
    begin = np.cumsum(size) - size
    letters = b[~gap]
    off = np.arange(len(letters), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    h = np.add.reduceat((letters.astype(U) + U(1)) * powers(int(size.max()), which)[off], begin)
    return mixed(h + size.astype(U)), counts


def runs(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each n consecutive values of h; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U)
    out, done, size, part = None, 0, 1, h
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, done = part, size
            else:
                k = min(len(out), len(part) - done)
                out = out[:k] * U(pow(STEPS[which], size, 1 << 64)) + part[done : done + k]
                done += size
        rest >>= 1
        if rest:
            part = part[: len(part) - size] * U(pow(STEPS[which], size, 1 << 64)) + part[size:]
            size *= 2
    return mixed(out[: len(h) - n + 1])


def pack(v: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences in byte planes, as many planes as the largest needs."""
    if not len(v):
        return b""
    d = np.diff(v, prepend=U(0))
    planes = d.view(np.uint8).reshape(-1, 8)
    k = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([k]) + np.ascontiguousarray(planes[:, :k].T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    k = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(k, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :k] = planes.T
    return np.cumsum(d.view(U).ravel(), dtype=U)


#: kind 0: a told, b asked about, c the places of b; kind 1: a the first place of each text, b their digests, c places known to be hits.
ROWS = "bucket int, uid long, kind int, a binary, b binary, c binary"


def to_buckets(uid: int, tell: np.ndarray, ask: np.ndarray, place: np.ndarray, buckets: int, bits: int) -> list[tuple]:
    """Rows for each bucket. tell: sorted, distinct; ask with place: distinct hashes of which tell has none."""
    order = np.argsort(ask, kind="stable")
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], U)
    cut = U(64 - bits)
    ask, place, rows = ask[order], place[order].astype(np.uint32), []
    te, ae = np.searchsorted(tell, edges), np.searchsorted(ask, edges)
    for i, (t, a) in enumerate(zip(np.split(tell, te), np.split(ask, ae), strict=True)):
        if len(t) or len(a):
            start = 0 if i == 0 else ae[i - 1]
            p = place[start : start + len(a)]
            rows.append((i, uid, 0, pack((t - U((i << 64) // buckets)) >> cut), pack((a - U((i << 64) // buckets)) >> cut), p.tobytes()))
    return rows


def answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's rows: those of kind 1 as they are; for each other one the places whose hash some other entry has."""
    asked = rows[rows["kind"] == 0]
    told, ask = [unpack(x) for x in asked["a"]], [unpack(x) for x in asked["b"]]
    every = np.sort(np.concatenate([*told, *ask])) if len(asked) else np.zeros(0, U)
    out = [(0, u, 1, a, b, c) for u, k, a, b, c in zip(rows["uid"], rows["kind"], rows["a"], rows["b"], rows["c"], strict=True) if k == 1]
    again = every[1:][every[1:] == every[:-1]]
    for uid, q, c in zip(asked["uid"], ask, asked["c"], strict=True):
        if len(q) and len(again):
            at = np.minimum(np.searchsorted(again, q), len(again) - 1)
            hit = np.frombuffer(c, np.uint32)[again[at] == q]
            if len(hit):
                out.append((0, uid, 0, b"", b"", hit.tobytes()))
    return pd.DataFrame(out, columns=["bucket", "uid", "kind", "a", "b", "c"])


def hits_by_text(rows: pd.DataFrame) -> list[tuple[bytes, np.ndarray]]:
    """(digest, sorted places within the text that are hits) for the texts of one unit that have any."""
    whole = rows[rows["kind"] == 1]
    if not len(whole):
        return []
    first = np.frombuffer(whole["a"].iloc[0], np.uint32).astype(np.int64)
    digests = whole["b"].iloc[0]
    places = np.sort(np.concatenate([np.frombuffer(c, np.uint32) for c in rows["c"]]).astype(np.int64))
    of = np.searchsorted(first, places, side="right") - 1
    out = []
    for k in np.unique(of):
        lo, hi = np.searchsorted(of, [k, k + 1])
        out.append((digests[16 * k : 16 * k + 16], places[lo:hi] - first[k]))
    return out
