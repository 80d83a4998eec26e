"""Near-duplicate groups by improved consistent weighted sampling over TF-IDF shingles.

Shingles are the distinct runs of SHINGLE words of a text (of all its words if it has fewer), weighted by their number in the
text times a damped inverse document frequency, 1 + DAMP ln(1 + N / df). DAMP is small because of the groups of copies: what
thousands of copies share is frequent for that reason alone, and at the usual damping the few words in which they differ would weigh
several times as much, so that no two of them reached THRESHOLD. The same weights, rounded to eighths of an octave, serve for samples and
for comparisons. df is counted over all documents in two rows of 2^DF_BITS counters (8 MB, whatever the input); a counter less
the load that the others lead one to expect estimates a shingle's df, and the smaller estimate counts, so rare shingles stay rare
when every counter is full.

A signature has BANDS x ROWS samples. Sample k of a weighted set is the element and the quantised weight with the least a,
where r, c ~ Gamma(2, 1) and b ~ U(0, 1) depend on the element and k, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The
three variables are quantiles (65,536 of each) chosen by three parts of a hash of element and k; two sets agree in a
sample with a probability of about their weighted Jaccard similarity.

Texts that share a band are compared exactly, by weighted Jaccard similarity: up to GROUP of them, of up to GROUP_SIZE shingles,
in one task, which links what
is similar and not yet joined. In larger bands all are compared with the band's first, and what is not in the largest component
of the band then with a second text of that, a linear number of pairs. Bands in one component are done. All texts of the other
bands, linked or not, stay as possible partners (similarity is not transitive): only pairs within one component are skipped. Up
to REST texts of a band are compared in one task; the texts of larger bands are joined anew on the rarest shingles and the weight
of each text, of which similar texts share one (prefix filtering, exact), and where more than REST texts or REST_SIZE shingles share one,
blocks of them are compared in pairs. Links of THRESHOLD and more are joined to classes: up to FEW_LINKS of them by union-find in one task,
beyond that by min-label propagation with pointer jumping. Copies of a text are one node.

Defined cases: a null text is a class of its own, as is a text without words unless it has exact copies; exact copies are one class
whatever their length; the class id is the least doc_id of the class (null last; null only if all are); of rows with the same
doc_id and text one stays in `representatives`; an empty table gives an empty result; other columns are ignored or carried along,
whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import flagged, kept_apart, table, written
from strandflow.llm.rolling import U, mixed, runs, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
#: The damping of the inverse document frequency.
DAMP = 0.04
DF_BITS, CHUNK = 19, 4096
#: Quantiles of each of a sample's three variables.
QUANTILES = 1 << 16
EIGHTH = np.log(2) / 8
#: Texts of one band, and their shingles, that are compared in one task; larger bands are first compared with one or two of their
#: texts. REST: the same for those of them that are in several components after that.
GROUP, REST = 512, 2048
GROUP_SIZE = REST_SIZE = 2_000_000
#: Links that are joined to classes in one task. Each round of the propagation is some shuffles, whose tasks the driver keeps account of.
FEW_LINKS = 100_000
#: Bytes of text whose signatures are made at a time.
PIECE = 1 << 18


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, numbers in the text, how many there are of each text); hashes are sorted within a text."""
    h, counts = word_hashes(texts)
    out, tf, sizes, at = [], [], np.zeros(len(texts), np.int64), 0
    for k, n in enumerate(counts.tolist()):
        w = runs(h[at : at + n], min(SHINGLE, n)) if n else h[:0]
        at += n
        if len(w):
            w.sort()
            new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            out.append(w[new])
            tf.append(np.diff(np.r_[new, len(w)]))
            sizes[k] = len(new)
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), sizes
    return np.concatenate(out), np.concatenate(tf), sizes


def _pieces(texts: list[str]):
    """(numbers of the texts, shingles of them), some at a time."""
    at, part, size = [], [], 0
    for k, t in enumerate(texts):
        at.append(k)
        part.append(t.encode())
        size += len(part[-1])
        if size >= PIECE or k == len(texts) - 1:
            yield np.array(at), *shingles(part)
            at, part, size = [], [], 0


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The counter of each shingle in either row."""
    return [(h >> U(64 - DF_BITS * (j + 1))).astype(np.int64) & ((1 << DF_BITS) - 1) for j in (0, 1)]


def _frequencies(batches):
    """The counters of a partition: each row counts; equal texts of a batch are cut up once."""
    total = np.zeros((2, 1 << DF_BITS), np.int64)
    for pdf in batches:
        code, first = pd.factorize(pdf["digest"])
        copies = np.bincount(code, minlength=len(first))
        texts = pdf["text"].to_numpy(object)[np.unique(code, return_index=True)[1]].tolist()
        for at, h, _, sizes in _pieces(texts):
            n = np.repeat(copies[at], sizes)
            for row, slot in zip(total, _slots(h), strict=True):
                row += np.bincount(slot, n, 1 << DF_BITS).astype(np.int64)
    rows, total = [], total.ravel()
    for i in range(0, len(total), CHUNK):
        part = total[i : i + CHUNK]
        if part.any():
            planes = part.view(np.uint8).reshape(-1, 8).T[: (int(part.max()).bit_length() + 7) // 8]
            rows.append((i // CHUNK, np.ascontiguousarray(planes).tobytes()))
    yield pd.DataFrame(rows, columns=["chunk", "n"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((CHUNK, 8), np.uint8).view(np.int64).ravel()
    for blob in rows["n"]:
        planes = np.frombuffer(blob, np.uint8).reshape(-1, CHUNK)
        wide = np.zeros((CHUNK, 8), np.uint8)
        wide[:, : len(planes)] = planes.T
        total = total + wide.view(np.int64).ravel()
    return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "n": [total.tobytes()]})


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull()).select(F.md5("text").alias("digest"), "text")


def idf_levels(docs: DataFrame) -> np.ndarray:
    """The weight of one shingle by its counter in either row, in eighths of an octave.

    Counted over all documents; 256 rows of 32 kB come back."""
    texts = texts_of(docs)
    n = texts.mapInPandas(_frequencies, "chunk int, n binary").groupBy("chunk").applyInPandas(_summed, "chunk int, n binary").collect()
    df = np.zeros(2 << DF_BITS, np.int64)
    for r in n:
        df[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.n, np.int64)
    return levels(df.reshape(2, -1), texts.count())


def levels(df: np.ndarray, n: int) -> np.ndarray:
    others = (df.sum(1, keepdims=True) - df) / (df.shape[1] - 1)
    rare = np.log1p(max(1, n) / np.clip(df - others, 1, None))
    return np.rint(np.log(1 + DAMP * rare) / EIGHTH).astype(np.int16)


@lru_cache(maxsize=1)
def variables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of r, 1 / r and ln c for r, c ~ Gamma(2, 1)."""
    x = np.geomspace(1e-4, 50, 1 << 18)
    q = (np.arange(QUANTILES) + 0.5) / QUANTILES
    g = np.interp(q, -np.expm1(-x) - x * np.exp(-x), x)
    return g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)


def signatures(h: np.ndarray, tf: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The samples of each text that has shingles, BANDS x ROWS of 32 bits."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    w = (weights(h, tf, idf) * EIGHTH).astype(np.float32)
    r, inverse, c = variables()
    low = h & U((1 << 24) - 1)
    out = np.empty((len(first), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        z = (h ^ U((0xA24BAED4963EE407 * (k + 1)) & ((1 << 64) - 1))) * U(0x9FB21C651E98DF25)
        z ^= z >> U(32)
        z *= U(0xD6E8FEB86659FD93)
        part = (z ^ (z >> U(29))).view(np.uint16).reshape(-1, 4)
        at, b = part[:, 3], part[:, 1] * np.float32(1 / QUANTILES)
        t = np.floor(w * inverse[at] + b)
        a = (c[part[:, 2]] - r[at] * (t - b + np.float32(1))).view(np.uint32)
        # as sortable bits; then the quantised weight and the element, which settle ties and are what is sampled
        a ^= np.where(a >> 31, np.uint32(0xFFFFFFFF), np.uint32(1 << 31))
        out[:, k] = np.minimum.reduceat(a.astype(U) << U(32) | (t.astype(np.int64) & 0xFF).astype(U) << U(24) | low, first) & U(0xFFFFFFFF)
    return out


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """In eighths of an octave. The rarer of both counters, whose estimate of df is the smaller, gives the level."""
    a, b = _slots(h)
    return np.maximum(idf[0][a], idf[1][b]) + np.rint(np.log(tf) / EIGHTH).astype(np.int64)


def _bands(idf):
    def of(batches):
        seen: set[str] = set()
        for pdf in batches:
            ids, texts = [], []
            for d, t in zip(pdf["digest"].tolist(), pdf["text"].tolist(), strict=True):
                if d not in seen:
                    if len(seen) > 500_000:  # forgetting only means that a copy speaks again
                        seen.clear()
                    seen.add(d)
                    ids.append(bytes.fromhex(d))
                    texts.append(t)
            for at, h, tf, sizes in _pieces(texts):
                if not len(h):
                    continue
                s = signatures(h, tf, sizes, idf.value).astype(U).reshape(-1, BANDS, ROWS)
                key = np.full(s.shape[:2], U(0)) + np.arange(1, BANDS + 1, dtype=U)
                for j in range(ROWS):
                    key = mixed(key * U(0x9E3779B97F4A7C15) + s[:, :, j])
                some = at[sizes > 0]
                yield pd.DataFrame({"key": key.view(np.int64).ravel(), "digest": [ids[x] for x in np.repeat(some, BANDS)], "size": np.repeat(sizes[sizes > 0], BANDS)})

    return of


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    same = ha[at] == hb
    x, y = wa[at[same]], wb[same]
    common = np.minimum(x, y).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, tf, _ = shingles([text.encode()])
    return h, np.exp(weights(h, tf, idf) * EIGHTH)


def _similarities(idf):
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, vector = [], None, None
        for a, b in zip(left, right, strict=True):
            if a is not last and a != last:
                last, vector = a, weighted(a, idf.value)
            out.append(similarity(vector, weighted(b, idf.value)))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(of, "double")


def _linked(idf):
    """Links of the texts of one small group: each pair is compared unless earlier links (or equal labels) already join it, so a
    group of n texts gives at most n - 1 links and loses none between its components. A text of side 0 meets the later ones,
    those of side 1 among them, through the lists of the shingles that several texts have."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "digest"])
        ids = rows["digest"].tolist()
        vectors = [weighted(t, idf.value) for t in rows["text"]]
        total = np.array([w.sum() for _, w in vectors])
        size = np.array([len(h) for h, _ in vectors])
        first = np.cumsum(size) - size
        h, w = np.concatenate([h for h, _ in vectors]), np.concatenate([w for _, w in vectors])
        order = np.argsort(h, kind="stable")  # of equal shingles the texts are in order
        text, weight = np.repeat(np.arange(len(ids)), size)[order], w[order]
        last = np.flatnonzero(np.r_[h[order][1:] != h[order][:-1], True][: len(h)]) + 1
        place, end = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        end[order] = np.repeat(last, np.diff(np.r_[0, last]))
        group, out = pd.factorize(rows["label"])[0], []
        for i in range(min(len(ids) - 1, int((rows["side"] == 0).sum()))):
            open_ = group[i + 1 :] != group[i]
            open_ &= np.minimum(total[i], total[i + 1 :]) >= THRESHOLD * np.maximum(total[i], total[i + 1 :])
            if not open_.any():
                continue
            own = slice(first[i], first[i] + size[i])
            n = end[own] - place[own] - 1
            at = np.repeat(place[own] + 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.bincount(text[at], np.minimum(weight[at], np.repeat(w[own], n)), len(ids))[i + 1 :]
            s = common / np.maximum(total[i] + total[i + 1 :] - common, 1e-300)
            for j in np.flatnonzero(open_ & (s >= THRESHOLD)).tolist():
                old, new = group[i + 1 + j], group[i]
                if old != new:
                    out.append((ids[i], ids[i + 1 + j], float(s[j])))
                    group[group == old] = new
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return of


def _prefixes(idf):
    """The shingles of each text that one of similarity THRESHOLD must share: the rarest ones, until what is left weighs less
    than THRESHOLD of the whole. Similar texts differ in weight by 1 / THRESHOLD at most, so a key also has the class of the
    text's weight, and a text is in its own class and the next."""

    def of(batches):
        for pdf in batches:
            keys, ids, sizes = [], [], []
            for d, t in zip(pdf["digest"], pdf["text"], strict=True):
                h, w = weighted(t, idf.value)
                order = np.lexsort((h, -weights(h, np.ones(len(h)), idf.value)))
                left = w.sum() - np.cumsum(w[order])
                n = min(len(h), int(np.count_nonzero(left >= THRESHOLD * w.sum() * (1 - 1e-9))) + 1)
                if len(h):
                    class_ = int(np.floor(np.log(w.sum()) / -np.log(THRESHOLD)))
                    keys += [mixed(h[order[:n]] + U((c * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))).view(np.int64) for c in (class_, class_ + 1)]
                    ids += [d] * (2 * n)
                    sizes += [len(h)] * (2 * n)
            yield pd.DataFrame({"key": np.concatenate(keys) if keys else np.zeros(0, np.int64), "digest": ids, "size": sizes})

    return of


LINK = "a binary, b binary, similarity double"
TILES = "array<struct<tile:struct<kind:int,i:int,j:int>,side:int>>"


def links(docs: DataFrame) -> DataFrame:
    """a, b, similarity: links between different texts, by the MD5 of each; enough of them to join what is similar."""
    spark = docs.sparkSession
    texts = texts_of(docs)
    idf = spark.sparkContext.broadcast(idf_levels(docs))
    bands = written(texts.mapInPandas(_bands(idf), "key long, digest binary, size long"))

    def shared(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("whole"), F.min("digest").alias("first"), F.max("digest").alias("last"))
        n = written(n.filter("first != last").select("key", ((F.col("n") <= GROUP) & (F.col("whole") <= GROUP_SIZE)).alias("small"), "first"))
        return written(rows.join(n, "key").distinct())

    members = shared(bands)
    wanted = written(members.select("digest").distinct())
    t = texts.withColumn("digest", F.unhex("digest"))
    # one text of each digest that shares a band; copies go before the shuffle
    t = flagged(t, wanted, "digest", "shares").filter("shares").select("digest", "text").mapInPandas(_once, "digest binary, text string")
    known = written(t.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")))
    same, small, large = _similarities(idf), members.filter("small"), members.filter("not small")
    # the same few texts share most of their bands: equal groups are compared once
    groups = small.groupBy("key").agg(F.array_sort(F.collect_set("digest")).alias("g")).select("g").distinct()
    rows = groups.select(F.md5(F.array_join(F.transform("g", F.hex), "")).alias("gid"), F.explode("g").alias("digest"))
    rows = rows.select("gid", "digest", F.col("digest").alias("label"), F.lit(0).alias("side"))
    if large.isEmpty():
        return rows.join(known, "digest").groupBy("gid").applyInPandas(_linked(idf), LINK)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(known.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b")
        pairs = pairs.join(known.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a")
        return written(pairs.select("a", "b", same("ta", "tb").alias("similarity")).filter(F.col("similarity") >= THRESHOLD))

    found = compared(large.filter("digest != first").select(F.col("first").alias("a"), F.col("digest").alias("b")).distinct())
    large = _open(large.select("key", "digest", "size"), components(found))
    # a second one of the largest component meets what is not joined to it
    second = large.filter("label = top").groupBy("key").agg(F.min_by("digest", F.xxhash64("digest")).alias("a"))
    pairs = large.filter("label != top").join(second, "key").select("a", F.col("digest").alias("b")).distinct()
    found = found.unionByName(compared(pairs))
    labels = components(found)
    large = _open(large.select("key", "digest", "size"), labels)
    rest = large.filter(_more(F.col("n"), F.col("whole")))
    if not rest.isEmpty():
        # texts with one very common line: an exact prefix join finds the similar ones among them
        texts_left = known.join(written(rest.select("digest").distinct()), "digest", "left_semi")
        keys = _open(written(texts_left.mapInPandas(_prefixes(idf), "key long, digest binary, size long")), labels)
        large = large.filter(~_more(F.col("n"), F.col("whole"))).unionByName(keys)
    groups = _tiles(large).groupBy("key", "tile").agg(F.array_sort(F.collect_set(F.struct("digest", "label", "side"))).alias("g")).select("g").distinct()
    gid = F.md5(F.array_join(F.transform("g", lambda x: F.concat(F.hex(x["digest"]), x["side"].cast("string"))), ""))
    rows = rows.unionByName(groups.select(gid.alias("gid"), F.explode("g").alias("m")).select("gid", "m.digest", "m.label", "m.side"))
    return rows.join(known, "digest").groupBy("gid").applyInPandas(_linked(idf), LINK).unionByName(found)


def _more(n: Column, size: Column) -> Column:
    """Too many texts, or too long ones, for one task."""
    return (n > REST) | (size > REST_SIZE)


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, digest, size) of keys whose texts are in several components, with the label of each, the number of texts of
    the key, n, and of their shingles, whole, and its largest component: top, of n_top texts and size_top shingles."""
    r = written(rows.distinct().join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest")))
    each = r.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    of = each.groupBy("key").agg(F.sum("c").alias("n"), F.sum("s").alias("whole"), F.count(F.lit(1)).alias("n_labels"), F.max(F.struct("c", "label", "s")).alias("t"))
    of = written(of.filter("n_labels > 1").select("key", "n", "whole", F.col("t.label").alias("top"), F.col("t.c").alias("n_top"), F.col("t.s").alias("size_top")))
    return written(r.join(of, "key"))


def _tiles(rows: DataFrame) -> DataFrame:
    """key, tile, digest, label, side: groups of about REST texts and REST_SIZE shingles at most in which every pair of a key's texts
    meets, but those within its largest component. Texts of side 0 are compared with all of the tile, those of side 1 only with side 0."""
    half, half_size = max(1, REST // 2), max(1, REST_SIZE // 2)
    other = F.col("label") != F.col("top")

    def blocks(n: Column, size: Column) -> Column:
        many = F.greatest(F.ceil(n / half), F.ceil(size / half_size))
        return F.when(_more(F.col("n"), F.col("whole")), many).otherwise(1).cast("int")

    d = rows.withColumn("n_other", blocks(F.col("n") - F.col("n_top"), F.col("whole") - F.col("size_top")))
    d = d.withColumn("n_tops", blocks(F.col("n_top"), F.col("size_top")))
    d = d.withColumn("at", F.pmod(F.xxhash64("digest"), F.when(other, F.col("n_other")).otherwise(F.col("n_tops"))).cast("int"))

    def tile(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j")).alias("tile"), side.cast("int").alias("side"))

    others, tops = F.sequence(F.lit(0), F.col("n_other") - 1), F.sequence(F.lit(0), F.col("n_tops") - 1)
    at = F.col("at")
    # a block of the others meets each block of the others and each of the largest component
    among = F.when(F.col("n_other") > 1, F.transform(others, lambda x: tile(0, F.least(at, x), F.greatest(at, x), F.when(x >= at, 0).otherwise(1))))
    mine = F.concat(F.coalesce(among, F.array().cast(TILES)), F.transform(tops, lambda x: tile(1, at, x, F.lit(0))))
    theirs = F.transform(others, lambda x: tile(1, x, at, F.lit(1)))
    d = d.select("key", "digest", "label", F.explode(F.when(other, mine).otherwise(theirs)).alias("t"))
    return d.select("key", "t.tile", "digest", "label", "t.side")


def _once(batches):
    seen: set[bytes] = set()
    for pdf in batches:
        keep = [d not in seen and not seen.add(d) for d in pdf["digest"]]
        if len(seen) > 500_000:
            seen.clear()
        yield pdf[keep]


def _joined(batches):
    """node, label of few edges: union-find that keeps the least node on top."""
    of: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (up := of.setdefault(x, x)) != x:
            of[x] = x = of[up]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            a, b = top(bytes(a)), top(bytes(b))
            if a != b:
                of[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(of), "label": [top(x) for x in of]})


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of edges (a, b), which are cheap to read again."""
    if edges.count() <= FEW_LINKS:
        return written(edges.select("a", "b").coalesce(1).mapInPandas(_joined, "node binary, label binary"))
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = written(step.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")))
        labels = step.select("node", "label")
        if step.filter("old != label").isEmpty():
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """digest, label, first_id, first_digest, size of each text whose class has several rows: its class, the class's first row
    (of least doc_id) and number of rows."""
    of = written(components(written(links(docs))).select(F.lower(F.hex("node")).alias("digest"), F.lower(F.hex("label")).alias("label")))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("digest"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    each = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    # how often the first row of a text occurs is only asked where a text has several rows
    each = written(each.join(of, "digest", "left").filter("n > 1 or label is not null").select("digest", F.coalesce("label", "digest").alias("label"), "n", "first"))
    groups = each.groupBy("label").agg(F.sum("n").alias("size"), F.min("first").alias("first"))
    firsts = groups.select("label", "size", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    return written(each.select("digest", "label").join(firsts, "label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size: a row for each row."""
    member = classes(docs.select("doc_id", "text"))
    d = docs.select("doc_id", F.md5("text").alias("digest"))
    d = d.join(member.select("digest", "first_id", "size"), "digest", "left")
    alone = F.col("size").isNull()
    return d.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("class_id"), F.coalesce("size", F.lit(1)).alias("class_size"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class, unchanged: the one of least doc_id."""
    member = classes(docs.select("doc_id", "text"))
    d = flagged(kept_apart(docs, digest=F.md5("text")), member.select("digest"), "digest", "shares")
    some = d.filter("shares").join(member.select("digest", "first_id", "first_digest"), "digest", "left")
    free = some.filter("first_digest is null").select("row.*")
    # equal rows are one document: only the few rows that stay of a class with copies meet here
    first = some.filter(F.col("first_digest") == F.col("digest")).filter(F.col("row.doc_id").eqNullSafe(F.col("first_id")))
    first = first.dropDuplicates(["digest"]).select("row.*")
    return d.filter("not shares").select("row.*").unionByName(free).unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = None
