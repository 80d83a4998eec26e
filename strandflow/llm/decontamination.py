"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is 10 consecutive words of an item (all of its words if it has fewer). A document contains a window only if it
contains each of its words; so of the window's words, ordered by rarity (their number of occurrences over all documents), the
rarest alone is a necessary prefix. The document's word positions are joined to the windows on that word; the word's offset in
the window gives the only place where the window can lie (positional bound), which must fit into the document (length bound);
what is left is verified word by word. Frequent words are joined only for windows that have no rarer one.

The windows of the benchmark are broadcast if they have at most BROADCAST_WINDOWS rows (a few MB, counted first); a larger
benchmark is joined by shuffling both sides on the word, with the positions of frequent words dealt over SALTS parts.

Results depend on a text alone, so the hits of equal texts are gathered once, under the hash of the text, and each occurrence
is reduced to the interval that it covers; intervals are bounded by the text's own length.

Defined cases: null and empty texts have no words and no hits; items with a null text or without words have no window; an item
with a null item_id marks words but is not counted or listed in the items; repeated item_ids count once; an empty benchmark or an empty
table leaves everything clean; rows are kept apart by the row itself; other columns are ignored or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import kept_apart, table, written

WINDOW = 10
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 50_000
SALTS = 32


#: The same words before A-Z are made small, as what they hold: the engine's matcher is ten times slower on the complement.
RAW = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Words as they are written."""
    return F.regexp_extract_all(text, F.lit(RAW), F.lit(0))


def small(text: Column) -> Column:
    """A-Z made small, other letters as they are. The engine's lower() does more, and is used for join keys only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, ws: the distinct windows of each item."""
    w = benchmark.select("item_id", words(small(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    w = w.select("item_id", "w", F.explode(starts).alias("i"))
    return w.select("item_id", F.slice("w", F.col("i") + 1, F.lit(size)).alias("ws")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame, tiny: bool) -> DataFrame:
    """word, off, ws, k, first, last: each distinct window under its rarest word, with its text and its outer words.

    Rarity is counted over all documents, for the windows' words only."""
    distinct = windows.select("ws").distinct()
    vocabulary = distinct.select(F.explode("ws").alias("word")).select(F.lower("word").alias("word")).distinct()
    seen = docs.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    # counted first where the vocabulary is shuffled: of a frequent word a few rows a task travel, not one an occurrence
    seen = seen.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n")) if tiny else seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word", "left_semi")
    w = distinct.select("ws", F.posexplode("ws").alias("off", "word")).withColumn("word", F.lower("word")).join(seen, "word", "left")
    # a word that no document has ends the search for its window
    rarest = w.groupBy("ws").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "word")).alias("p")).filter("p.n > 0")
    outer = [F.lower(F.element_at("ws", i)).alias(c) for i, c in ((1, "first"), (-1, "last"))]
    return rarest.select(F.col("p.word").alias("word"), F.col("p.off").alias("off"), "ws", F.array_join("ws", " ").alias("k"), F.size("ws").alias("n"), *outer)


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """digest, s, e, item_id: every occurrence (words s to e, e exclusive) of a window of an item in a text, once per text."""
    windows = written(item_windows(benchmark, size))
    tiny = windows.limit(most + 1).count() <= most
    first = written(prefixes(windows, docs, tiny))
    at = docs.select("text", words(F.col("text")).alias("w")).select("text", "w", F.posexplode("w").alias("pos", "raw")).withColumn("word", F.lower("raw"))
    start = F.col("pos") - F.col("off")
    if tiny:
        hit = at.join(F.broadcast(first), "word")
        near, begin, total, digest = F.col("w"), start, F.size("w"), F.sha2("text", 256)
    else:  # narrow rows travel; the words around a position go along only as far as a window reaches
        part = F.slice("w", F.greatest(F.col("pos") - size + 2, F.lit(1)), F.lit(2 * size - 1))
        far = at.select(F.sha2("text", 256).alias("digest"), "word", "pos", F.size("w").alias("nw"), part.alias("w"), F.greatest(F.col("pos") - size + 1, F.lit(0)).alias("from"))
        far = far.withColumn("salt", F.pmod(F.xxhash64("digest", "pos"), F.lit(SALTS)).cast("int"))
        hit = far.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["word", "salt"])
        near, begin, total, digest = F.col("w"), start - F.col("from"), F.col("nw"), F.col("digest")
    # bounds first, then the outer words, then all of them
    hit = hit.filter((start >= 0) & (start + F.col("n") <= total))
    # (the engine may test them in any order, so none fails on a place that the bounds rule out)
    hit = hit.filter((F.lower(F.get(near, begin)) == F.col("first")) & (F.lower(F.get(near, begin + F.col("n") - 1)) == F.col("last")))
    hit = hit.filter(small(F.array_join(F.slice(near, F.greatest(begin + 1, F.lit(1)), F.col("n")), " ")) == F.col("k"))
    hit = hit.select(digest.alias("digest"), start.alias("s"), (start + F.col("n")).alias("e"), "ws").distinct()
    return hit.join(F.broadcast(windows) if tiny else windows, "ws").select("digest", "s", "e", "item_id")


def covered(found: DataFrame) -> DataFrame:
    """digest, n_hit, items: the number of words inside any occurrence, and the sorted item_ids as strings."""
    runs = F.array_sort(F.collect_set(F.struct("s", "e")))
    g = found.groupBy("digest").agg(runs.alias("runs"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    n = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    return g.select("digest", n.cast("long").alias("n_hit"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs."""
    hits = written(covered(occurrences(docs.select("text"), benchmark.select("item_id", "text"), size, most)))
    d = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(RAW)), F.lit(0)).cast("long").alias("n_words"), F.sha2("text", 256).alias("digest"))
    d = d.join(hits, "digest", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs without any occurrence of a window, unchanged. A null text is clean."""
    hits = written(occurrences(docs.select("text"), benchmark.select("item_id", "text"), size).select("digest").distinct())
    d = kept_apart(docs, digest=F.sha2("text", 256))
    return d.join(hits, "digest", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def ctes(docs: str, p: str = "") -> str:
    """DuckDB's common table expressions, ending in {p}occ: (r, s, e, item_id) over the rows of docs, which has r."""
    token = TOKEN.replace("'", "''")

    def split(text: str) -> str:
        return f"coalesce(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{token}'), [])"

    return f"""
{p}dw AS (SELECT r, {split('text')} AS w FROM {docs}),
{p}iw AS (SELECT item_id, {split('text')} AS w FROM benchmark),
{p}win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM {p}iw WHERE len(w) > 0)),
{p}len AS (SELECT DISTINCT n FROM {p}win),
{p}cand AS (SELECT r, n, s, array_to_string(w[s + 1:s + n], ' ') AS k FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM {p}dw, {p}len WHERE len(w) >= n)),
{p}occ AS (SELECT r, s, s + n AS e, item_id FROM {p}cand JOIN {p}win USING (k, n))"""


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, * FROM documents), {ctes('docs')},
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, e)) AS x FROM occ) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs JOIN dw USING (r) LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""
