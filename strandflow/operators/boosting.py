"""Gradient-boosted trees for two classes: logistic loss, second-order gains, histogram splits, missing values sent to the better side.

Fitting runs in numpy on the driver over a bounded sample of labelled rows (MOST_ROWS, drawn by a hash of the row where there are more);
prediction is a Pandas UDF with the trees broadcast.

Defined cases: a feature without two different values is never split on; rows of one class give one leaf a tree; missing features
(null, NaN) follow the side that their training rows gained more on (left without any); no rows at all cannot be fitted (ValueError).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000
BINS = 256


@dataclass
class Booster:
    """Trees as arrays: feature (-1: a leaf), cut (left is below it), missing goes left, children, leaf value (a log-odds)."""

    trees: list[tuple] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        z = np.zeros(len(x))
        for feature, cut, left_missing, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                v = x[inner, f[inner]]
                node = at[inner]
                goes = np.where(np.isnan(v), left_missing[node], v < cut[node])
                at[inner] = np.where(goes, left[node], right[node])
            z += value[at]
        return 1 / (1 + np.exp(-z))


def _cuts(v: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values, or between evenly populated groups of them if there are many."""
    v = np.sort(v[~np.isnan(v)])
    if not len(v):
        return np.zeros(0)
    u = np.unique(v)
    if len(u) > BINS:
        edge = (np.arange(1, BINS) * len(v)) // BINS
        below, above = v[edge - 1], v[edge]
        keep = below < above
        return np.unique((below[keep] + above[keep]) / 2)
    return (u[1:] + u[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.3, depth: int = 6, ridge: float = 1.0, least_weight: float = 1.0) -> Booster:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(y):
        raise ValueError("no rows to fit")
    cuts = [_cuts(c) for c in x.T]
    # bin numbers; the last one is for missing values
    b = np.stack([np.where(np.isnan(c), BINS, np.searchsorted(k, c, side="right")) for c, k in zip(x.T, cuts, strict=True)], 1)
    out, z = Booster(), np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        tree: list[list] = [[-1, 0.0, True, 0, 0, 0.0]]
        open_ = [(0, np.arange(len(y)))]
        for level in range(depth + 1):
            nxt = []
            for node, rows in open_:
                gs, hs = g[rows].sum(), h[rows].sum()
                split = _split(b[rows], g[rows], h[rows], cuts, ridge, least_weight) if level < depth else None
                if split is None:
                    tree[node][5] = -rate * gs / (hs + ridge)
                    z[rows] += tree[node][5]
                    continue
                f, k, missing_left = split
                v = b[rows, f]
                goes = np.where(v == BINS, missing_left, v <= k)
                tree[node] = [f, float(cuts[f][k]), missing_left, len(tree), len(tree) + 1, 0.0]
                tree += [[-1, 0.0, True, 0, 0, 0.0], [-1, 0.0, True, 0, 0, 0.0]]
                nxt += [(len(tree) - 2, rows[goes]), (len(tree) - 1, rows[~goes])]
            open_ = nxt
            if not open_:
                break
        out.trees.append(tuple(np.array(c) for c in zip(*tree, strict=True)))
    return out


def _split(b: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], ridge: float, least: float) -> tuple | None:
    """(feature, last bin on the left, missing values go left) of the greatest gain, or None."""
    best, gs, hs = (1e-9, None), g.sum(), h.sum()
    whole = gs * gs / (hs + ridge)
    for f, k in enumerate(cuts):
        if not len(k):
            continue
        n = BINS + 1
        gb, hb = np.bincount(b[:, f], g, n), np.bincount(b[:, f], h, n)
        lg, lh = np.cumsum(gb[: len(k)]), np.cumsum(hb[: len(k)])
        for missing_left in (True, False):
            a, c = (lg + gb[BINS], lh + hb[BINS]) if missing_left else (lg, lh)
            ok = (c >= least) & (hs - c >= least)
            gain = np.where(ok, a * a / (c + ridge) + (gs - a) ** 2 / (hs - c + ridge) - whole, -1)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), (f, at, missing_left))
            if not hb[BINS]:
                break
    return best[1]


def sampled(df: DataFrame, columns: list[str], most: int = MOST_ROWS) -> pd.DataFrame:
    """The columns of all rows, or of about `most` of them drawn by a hash of the row, in an order of their own."""
    n = df.count()
    d = df.select(*[F.col(c).cast("double") for c in columns])
    if n > most:
        d = d.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return d.toPandas().sort_values(columns, ignore_index=True)


def predicted(model: Booster, *features: Column) -> Column:
    """The probability of each row; models with a column method of their own (rules) are asked for it."""
    if hasattr(model, "column"):
        return model.column(*features)

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict(x.to_numpy(float)))

    return run(F.struct(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)]))
