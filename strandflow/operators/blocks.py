"""Lists of ranges of queries against those of subjects, as arrays: all subjects that a query may meet are at one place.

Queries and subjects are dealt over places: by a key, or by bins of the genome. A query has one place only (the bin of its start, of a
width that is not less than its own), a subject goes to every place with queries that it may reach. So each pair is seen once, filters
over the subjects of a query need no shuffle, and the rows that travel grow with the tables, not with the pairs. Places with many
queries are dealt over parts, to each of which their subjects go; there are at most MOST_PARTS parts more than places.

A task streams through its places: the subjects of one are held (as many as lie over one place), the queries pass in batches. Equal
lists are one row of the arrays (a structure), so pairs are measured once per two structures and written for all that have them.

Defined cases: null lists, keys and strands pair with nothing, nor do ranges with a null bound count; without `empty`, nor do empty lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandflow.operators.staged import written

#: Bits of the widths of bins; the last is wider than any sequence.
LEVELS = (10, 12, 14, 17, 20, 24, 40)
PART, MOST_PARTS = 20_000, 400
#: Pairs of structures measured at once, elements of an array of them, rows of a batch of results.
PAIRS, ELEMENTS, ROWS = 200_000, 300_000, 100_000
_SEP = "\u0001"
#: Codes of strands.
MINUS, ANY = 1, 2


class Far:
    """Where the places of short lists that have no range are put: subjects' nearer than queries', both beyond all positions."""

    def __init__(self, bits: int):
        self.y, self.q, self.end = 1 << bits, 1 << (bits + 1), 1 << (bits + 2)


NEAR, WIDE = Far(28), Far(60)


class Structures:
    """The distinct lists of some rows: n ranges each, s and e as (ranges, structures), minus, code of the strand, and the rows of each."""

    def __init__(self, ids: pa.Array, strand: pa.Array, lists: pa.Array):
        off = lists.offsets.to_numpy().astype(np.int64)
        s, e = (lists.values.field(k).to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64) for k in (0, 1))
        n = np.diff(off)
        k = max(int(n.max()), 1) if len(n) else 1
        at = np.arange(k) < n[:, None]
        rows = np.zeros((len(n), 2 * k + 2), dtype=np.int64)
        rows[:, 0] = n
        rows[:, 1] = pc.fill_null(pc.index_in(strand, pa.array(["+", "-", "*"])), 3).to_numpy(zero_copy_only=False)
        rows[:, 2 : k + 2][at], rows[:, k + 2 :][at] = s, e
        flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
        _, first, of = np.unique(flat, return_index=True, return_inverse=True)
        rows, order = rows[first], np.argsort(of, kind="stable")
        self.ids = ids.take(pa.array(order))
        self.count = np.bincount(of, minlength=len(first))
        self.first = np.cumsum(self.count) - self.count
        self.n, self.strand, self.k = rows[:, 0], rows[:, 1].astype(np.int8), k
        self._s, self._e, self._at = rows[:, 2 : k + 2].T, rows[:, k + 2 :].T, (np.arange(k) < rows[:, :1]).T
        held = self._at.any()
        self.low, self.high = (int(self._s[self._at].min()), int(self._e[self._at].max())) if held else (0, 0)
        self._made: dict = {}

    def __len__(self) -> int:
        return len(self.n)

    def at(self, base: int, far: Far, query: bool) -> "Lists":
        key = (base, far is NEAR)
        if key not in self._made:
            self._made = {key: Lists(self, base, far, far.q if query else far.y)}
        return self._made[key]


class Lists:
    """Structures with positions from base on, in a type that holds them, and what follows from them."""

    def __init__(self, x: Structures, base: int, far: Far, fill: int):
        kind = np.int32 if far is NEAR else np.int64
        self.n, self.strand, self.real = x.n, x.strand, x._at
        self.s = np.where(x._at, x._s - base, fill).astype(kind)
        self.e = np.where(x._at, x._e - base, fill - 1).astype(kind)
        last, all_ = np.maximum(x.n - 1, 0), np.arange(len(x.n))
        ends = [(self.s[0], self.e[0]), (self.s[last, all_], self.e[last, all_])]
        self.span = ends[0][0], ends[1][1]
        self.cs, self.ce = self.s.copy(), self.e.copy()
        self.cs[last, all_], self.ce[last, all_] = self.s[last, all_], self.s[last, all_] + 1
        self.cs[0], self.ce[0] = self.e[0] - 1, self.e[0]
        self.ends = ends

    def end(self, last: bool, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """s, e of the first or last range along the strand."""
        a, b = self.ends[::-1] if last else self.ends
        return np.where(minus, b[0], a[0]), np.where(minus, b[1], a[1])


def of_size(q: Lists, y: Lists, i: np.ndarray, j: np.ndarray, measure: Callable) -> Iterator[tuple[np.ndarray, object]]:
    """For runs of the pairs (i, j) with like numbers of ranges: their places among the pairs, and measure(i, j, kq, ky)."""
    if not len(i):
        return
    steps = np.array([1, 2, 3, 4, 6, 8, 11, 16, 32, 64, 256, 1 << 62])
    if len(i) < 4000:
        runs = [np.arange(len(i))]
    else:
        code = (np.searchsorted(steps, q.n) * 16)[i] + np.searchsorted(steps, y.n)[j]
        order = np.argsort(code.astype(np.int16), kind="stable")
        runs = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
    for run in runs:
        kq, ky = max(int(q.n[i[run]].max()), 1), max(int(y.n[j[run]].max()), 1)
        step = max(ELEMENTS // ((kq + 1) * (ky + 1)), 1)
        for a in range(0, len(run), step):
            at = run[a : a + step]
            yield at, measure(i[at], j[at], kq, ky)


def table(q: Lists, y: Lists, i: np.ndarray, j: np.ndarray, measure: Callable) -> dict[str, np.ndarray]:
    """The columns that measure gives, for all pairs in their order."""
    out: dict[str, np.ndarray] = {}
    for at, got in of_size(q, y, i, j, measure):
        for k, v in got.items():
            if k not in out:
                out[k] = np.empty(len(i), dtype=bool if v.dtype == bool else np.int64)
            out[k][at] = v
    return out


def gaps(s: np.ndarray, e: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s, e of the gaps of lists and which there are."""
    return e[:-1] + 1, s[1:] - 1, real[1:]


def outside(s: np.ndarray, e: np.ndarray, real: np.ndarray, ys: np.ndarray, ye: np.ndarray, far: Far) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of ranges outside others, as (ranges, others + 1, pairs): s, e and which there are."""
    edge = np.full((1, ys.shape[1]), far.end, dtype=ys.dtype)
    fs, fe = np.concatenate([-edge, ye + 1])[None], np.concatenate([ys - 1, edge])[None]
    s, e = s[:, None], e[:, None]
    return np.maximum(s, fs), np.minimum(e, fe), (fs <= e) & (s <= fe) & real[:, None]


def shared(s: np.ndarray, e: np.ndarray, real: np.ndarray, ys: np.ndarray, ye: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of ranges within others, as (ranges, others, pairs): s, e and which there are."""
    s, e, ys, ye = s[:, None], e[:, None], ys[None], ye[None]
    return np.maximum(s, ys), np.minimum(e, ye), (ys <= e) & (s <= ye) & real[:, None]


def total(hit: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.where(hit, w, 0).sum(axis=(0, 1), dtype=np.int64)


def met(q: Structures, y: Structures) -> tuple[Lists, Lists, Far]:
    """Both sides from a common base on."""
    base = y.low
    far = NEAR if max(q.high, y.high) - base < 1 << 27 and min(q.low, y.low) - base > -(1 << 27) else WIDE
    base = base if far is NEAR else 0
    return q.at(base, far, True), y.at(base, far, False), far


def every(q: Structures, y: Structures) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of structures, some queries at a time."""
    step = max(PAIRS // max(len(y), 1), 1)
    for a in range(0, len(q), step):
        n = min(step, len(q) - a)
        yield np.repeat(np.arange(a, a + n), len(y)), np.tile(np.arange(len(y)), n)


def reached(q: Lists, y: Lists, which: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the queries `which` and subjects whose spans meet, those of subjects extended by most; all of a query's at once."""
    order = np.argsort(y.span[0], kind="stable")
    ys, ye = y.span[0][order], y.span[1][order]
    qs, qe = q.span[0][which], q.span[1][which]
    low, high = np.searchsorted(np.maximum.accumulate(ye), qs - most), np.searchsorted(ys, qe + most, "right")
    number = np.maximum(high - low, 0)
    for part in spread(number, PAIRS):
        i, at = expanded(low[part], number[part])
        i = i + part.start
        keep = ye[at] >= qs[i] - most
        i, at = i[keep], at[keep]
        yield which[i], order[at]


def spread(number: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of the rows with at most so many in all, or one row."""
    upto, a = np.cumsum(number), 0
    while a < len(number):
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")), a + 1)
        yield slice(a, b)
        a = b


def expanded(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, number places from first on: the row and the place."""
    row = np.repeat(np.arange(len(number)), number)
    return row, np.arange(len(row)) + (first - (np.cumsum(number) - number))[row]


def written_out(q: Structures, y: Structures, i: np.ndarray, j: np.ndarray, columns: dict[str, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the ids of all rows of the structures of each pair and its columns."""
    for few in spread(y.count[j], ROWS):
        pair, of_y = expanded(y.first[j[few]], y.count[j[few]])
        pair = pair + few.start
        x = i[pair]
        for some in spread(q.count[x], ROWS):
            row, of_q = expanded(q.first[x[some]], q.count[x[some]])
            row = row + some.start
            at = pair[row]
            arrays = [q.ids.take(pa.array(of_q)), y.ids.take(pa.array(of_y[row])), *[pa.array(columns[f.name][at], type=f.type) for f in list(schema)[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _kept(df: DataFrame, x: str, empty: bool) -> DataFrame:
    kept = F.transform(F.filter(x, lambda r: r["s"].isNotNull() & r["e"].isNotNull()), lambda r: F.struct(r["s"].cast("long").alias("s"), r["e"].cast("long").alias("e")))
    return df.withColumn(x, kept).filter(F.col(x).isNotNull() if empty else F.size(x) > 0)


def _parts(q: DataFrame, at: list[str]) -> DataFrame:
    """at, parts: the places of the queries and over how many parts those of each are dealt."""
    n = q.groupBy(*at).agg(F.count(F.lit(1)).alias("c"))
    size = n.agg(F.greatest(F.lit(PART), F.ceil(F.sum("c") / MOST_PARTS)).alias("size"))
    return n.join(F.broadcast(size)).select(*at, F.ceil(F.col("c") / F.col("size")).cast("int").alias("parts"))  # one row


def results(q: DataFrame, y: DataFrame, at: list[str], kernel: Callable, out: StructType) -> DataFrame:
    """The batches that kernel(queries, subjects, schema) gives for each place; q has at, qid, strand, x and y has at, sid, strand, x."""
    q = written(q)
    parts = written(_parts(q, at))
    q = q.join(parts, at).withColumn("part", F.expr("pmod(xxhash64(qid), parts)"))
    y = y.join(parts, at).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))
    place = F.concat_ws(_SEP, *[F.col(c).cast("string") for c in (*at, "part")]).alias("place")
    no_qid, no_sid = F.lit(None).cast(q.schema["qid"].dataType).alias("qid"), F.lit(None).cast(y.schema["sid"].dataType).alias("sid")
    rows = y.select(place, F.lit(False).alias("query"), no_qid, "sid", "strand", "x").union(q.select(place, F.lit(True).alias("query"), "qid", no_sid, "strand", "x"))
    spark = q.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, "place").sortWithinPartitions("place", "query")
    schema = to_arrow_schema(out)
    rows = rows.select(F.concat("place", F.when(F.col("query"), "1").otherwise("0")).alias("place"), "qid", "sid", "strand", "x")
    return rows.mapInArrow(lambda batches: _places(batches, lambda a, b: kernel(a, b, schema)), out)


def by_key(query: DataFrame, subject: DataFrame, keys: list[str], kernel: Callable, out: StructType, empty: bool = False) -> DataFrame:
    """results of the queries (keys, qid, strand, x) and the subjects (keys, sid, strand, y) with equal keys."""
    more = [c for c in ("strand",) if c not in keys]
    q, y = _kept(query.select(*keys, "qid", *more, "x"), "x", empty), _kept(subject.select(*keys, "sid", *more, F.col("y").alias("x")), "x", empty)
    return results(q, y, keys, kernel, out)


def by_place(query: DataFrame, subject: DataFrame, most: int, kernel: Callable, out: StructType) -> DataFrame:
    """results of the queries (qid, chr, strand, x) and the subjects (sid, chr, strand, y) whose spans are at most `most` apart, or farther."""
    q = _kept(query.select("qid", "chr", "strand", "x"), "x", False).filter("strand is not null")
    s, e = F.array_min("x.s"), F.array_max("x.e")
    level = F.coalesce(*[F.when(e - s < 1 << k, k) for k in LEVELS[:-1]], F.lit(LEVELS[-1]))
    q = q.withColumn("lv", level).withColumn("bin", F.expr("shiftright(array_min(x.s), lv)"))
    y = _kept(subject.select("sid", "chr", "strand", F.col("y").alias("x")), "x", False).filter("strand is not null")
    far = most + 1  # cut ranges of one position reach out of the list by one
    y = y.withColumn("lv", F.explode(F.array(*[F.lit(k) for k in LEVELS])))
    y = y.withColumn("bin", F.explode(F.expr(f"sequence(shiftright(array_min(x.s) - {far}, lv) - 1, shiftright(array_max(x.e) + {far}, lv))")))
    return results(q, y, ["chr", "lv", "bin"], kernel, out)


def _places(batches: Iterator[pa.RecordBatch], kernel: Callable) -> Iterator[pa.RecordBatch]:
    """The results of kernel for rows that are sorted by place, subjects first."""
    here, held, subjects = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(0))
        start = 0
        for stop, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            rows, start = batch.slice(start, stop - start), stop
            if key[:-1] != here:
                here, held, subjects = key[:-1], [], None
            if key[-1] == "0":
                held.append(rows)
                continue
            if not held:
                continue
            if subjects is None:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                subjects = Structures(t.column(2), t.column(3), t.column(4))
            yield from kernel(Structures(rows.column(1), rows.column(3), rows.column(4)), subjects)
