"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Base kinds are found by patterns. The method adds the kind markov: runs of 20 or more characters of base 64 or names that
no base span touches and whose log-likelihood ratio, random strings against ordinary identifiers, is above a threshold.
Both models are first-order chains over characters, trained here on labelled samples (`samples`): strings drawn at random from
the alphabets of keys, and identifiers made of ordinary words. The ratio of each bigram is kept as a whole number of
millinats, so sums are exact and the same in any engine; the threshold is the one that best parts held-out samples.

Positions are code points. A pattern's matches and the gaps between them, both from one pattern, give every match's start by
adding lengths, so all is done with string and array functions of the engine. What would grow an array by one element at a time works on
blocks of about the root of its length, so n matches cost n^1.5 small steps at most, and a run of any length is scored in one pass.

Defined cases: null and empty texts have no spans (empty string, its hash); equal spans of several kinds are all listed; texts
of any length are scanned whole; rows are kept apart by the row itself, whatever doc_id is; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import table


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api")).replace(_any_case("api"), _any_case("api") + "_?" + _any_case("key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A longer run starts where a shorter one would, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGNED = 6
#: In the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")

WORDS = """get set user name value index item list map key data node parse build read write file path line text count size total first
last next open close load save find search match update delete insert create remove handle error message request response client server
config option default token stream buffer cache table column row field record query result filter order group join merge split hash sort
start stop begin end time date year month day hour minute second number string integer float double boolean array object class method
function module package import export public private static final return event listener handler manager service factory provider context
session account profile account address street city country customer product price quantity amount balance payment invoice shipping
the and for that with this from have were which their would there been other more some about into than only over such also after most
information international development government management environment performance application relationship understanding communication
responsibility characteristics administration representation particularly unfortunately internationalization straightforward nevertheless
les des est une dans pour que qui sur avec plus par ses mais comme tout fait leur bien sans peut nous vous temps entre monde
der die und das ist von mit den auf sich nicht dem ein eine als auch werden aus hat dass sie nach wird bei einer noch
los las del por con una para como pero sus este entre cuando muy sin sobre tambien hasta hay donde quien desde todo durante
tion ing ent ere han res ver ter ment con pro able ness ship less ful ward wise""".split()


def samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: 1 random, 0 ordinary. The same for every call."""
    r = random.Random(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [digits + lower + upper + "+/", digits + lower + upper, digits + lower + upper + "_-", digits + lower, digits + upper, digits + "ABCDEF"]
    out = []
    for i in range(n):
        a = alphabets[i % len(alphabets)]
        out.append(("".join(r.choice(a) for _ in range(r.randint(20, 64))), 1))
        style, s = i % 6, ""
        size = r.randint(20, 48)
        while len(s) < size:
            w = r.choice(WORDS)
            s += (w.capitalize() if style == 0 else w.upper() + "_" if style == 1 else w + "_" if style == 2 else w + "-" if style == 3 else w + "/" if style == 4 else w)
        if r.random() < 0.2:
            s += str(r.randint(0, 2030))
        if style == 5:
            s = s[0].upper() + s[1:]
        out.append((s.strip("_-/") if r.random() < 0.9 else s, 0))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[tuple[int, ...], int]:
    """(ratio of each pair of ASCII characters in millinats at 128 * first + second, threshold on the sum over a string)."""
    chars = sorted(set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
    counts = [{}, {}]
    data = samples()
    for k, (s, label) in enumerate(data):
        if k % 5:
            for a, b in zip(s, s[1:], strict=False):
                counts[label][a, b] = counts[label].get((a, b), 0) + 1
    table_ = [0] * (128 * 128)
    for a in chars:
        sums = [sum(c.get((a, b), 0) for b in chars) for c in counts]
        for b in chars:
            p = [(c.get((a, b), 0) + 0.5) / (t + 0.5 * len(chars)) for c, t in zip(counts, sums, strict=True)]
            table_[128 * ord(a) + ord(b)] = round(1000 * math.log(p[1] / p[0]))
    held = sorted((score(s, table_), label) for k, (s, label) in enumerate(data) if k % 5 == 0)
    # the least threshold from which on nine hundred and ninety-nine of a thousand held-out ordinary strings stay below
    ordinary = [x for x, label in held if not label]
    return tuple(table_), max(0, ordinary[int(0.999 * (len(ordinary) - 1))])


def score(s: str, table_) -> int:
    return sum(table_[128 * ord(a) + ord(b)] for a, b in zip(s, s[1:], strict=False))


def let(value: Column, f) -> Column:
    """f of a value that is made once, as each use of an expression is evaluated by itself."""
    return F.transform(F.array(value), f)[0]


def blocks(x: Column) -> Column:
    """x cut into about the root of its length many parts; of no elements, none."""
    size = F.ceil(F.sqrt(F.size(x))).cast("int")
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1), lambda k: F.slice(x, k * size + 1, size))).otherwise(F.slice(F.array(x), 1, 0))


SPANS = "array<struct<s:int,e:int,m:string>>"


def spans(text: Column, pattern: str, more: Column | None = None) -> Column:
    """array of struct(s, e, m) for the leftmost non-overlapping matches; m is the match, or what more has at its place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def steps(x: Column) -> Column:
        """The lengths of the gap before each match and of the match, and m."""
        pairs = F.zip_with(x["m"], x["o"], lambda m, o: F.struct(m.alias("m"), o.alias("o")))
        return F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), pairs, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m["m"]).alias("n"), m["o"].alias("o")))

    def placed(block: Column) -> Column:
        """(end, spans) of a block, counted from its own start."""
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
            lambda acc, y: F.struct(
                (acc["at"] + y["g"] + y["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + y["g"]).alias("s"), (acc["at"] + y["g"] + y["n"]).alias("e"), y["o"].alias("m")))).alias("out"),
            ),
        )

    def joined_up(parts: Column) -> Column:
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(let(starts, lambda st: F.transform(parts, lambda x, k: F.transform(x["out"], lambda y: F.struct((y["s"] + st[k]).alias("s"), (y["e"] + st[k]).alias("e"), y["m"].alias("m"))))))

    both = F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g"), (more if more is not None else found).alias("o"))
    every = let(let(let(both, steps), lambda st: F.transform(blocks(st), placed)), joined_up)
    return F.when(F.regexp(text, F.lit(pattern)), every).otherwise(F.array().cast(SPANS))


def ratio(run: Column, table_) -> Column:
    values = F.split(F.lit(",".join(map(str, table_))), ",").cast("array<int>")

    def summed(code: Column) -> Column:
        n = F.size(code) - 1
        pairs = F.zip_with(F.slice(code, F.lit(1), n), F.slice(code, F.lit(2), n), lambda a, b: a * 128 + b + 1)
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, k: acc + F.element_at(values, k))

    return let(F.transform(F.split(run, ""), lambda c: F.ascii(c)), summed)


def untouched(found: Column, base: Column) -> Column:
    """The spans of found, which are in order, that none of base meets; each block of them is compared with what lies along it."""

    def free(block: Column) -> Column:
        near = F.filter(base, lambda x: (x["s"] < F.element_at(block, -1)["e"]) & (x["e"] > block[0]["s"]))
        return let(near, lambda b: F.filter(block, lambda y: ~F.exists(b, lambda x: (x["s"] < y["e"]) & (y["s"] < x["e"]))))

    return F.flatten(F.transform(blocks(found), free))


def marks(found: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    table_, threshold = model()
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    d = d.select(
        "doc_id",
        F.filter(spans(t, ASSIGN, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))), lambda x: F.length(x["m"]) >= LEAST_ASSIGNED).alias("a"),
        spans(t, ACCESS).alias("k"),
        spans(t, HEX).alias("x"),
        F.filter(spans(t, RUN), lambda x: ratio(x["m"], table_) > threshold).alias("r"),
    )
    d = d.withColumn("base", F.concat(marks(F.col("a"), "assign"), marks(F.col("k"), "access"), marks(F.col("x"), "hex")))
    d = d.withColumn("more", marks(untouched(F.col("r"), F.col("base")), "markov"))
    return d.select(
        "doc_id",
        *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("x", "n_hex"))],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_markov"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The same in DuckDB's SQL; the trained table is written into the statement."""
    table_, threshold = model()

    def q(p: str) -> str:
        return p.replace("'", "''")

    def found(kind: int, pattern: str, where: str, group: int = 0) -> str:
        return f"""SELECT r, {kind} AS k, s, e FROM (
    SELECT r, o, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS s, s + length(m[i]) AS e FROM (
        SELECT r, g, m, unnest(o) AS o, generate_subscripts(m, 1) AS i FROM (
            SELECT r, string_split_regex(t, '{q(pattern)}') AS g, regexp_extract_all(t, '{q(pattern)}', 0) AS m, regexp_extract_all(t, '{q(pattern)}', {group}) AS o FROM d))) WHERE {where}"""

    values = ",".join(map(str, table_))
    llr = f"(SELECT list_sum(list_transform(range(1, length(o)), lambda j: v[ascii(o[j]) * 128 + ascii(o[j + 1]) + 1])) FROM w) > {threshold}"
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    text = f"string_agg(([{kinds}])[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
WITH w AS MATERIALIZED (SELECT [{values}] AS v),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({found(0, ASSIGN, f'length(o) >= {LEAST_ASSIGNED}', 2)} UNION ALL {found(1, ACCESS, 'true')} UNION ALL {found(2, HEX, 'true')}),
x AS ({found(3, RUN, llr)}),
f AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
bg AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {text} AS base FROM b GROUP BY r),
ag AS (SELECT r, count(*) FILTER (k = 3) AS n_markov, {text} AS spans FROM (SELECT r, k, s, e FROM b UNION ALL SELECT r, k, s, e FROM f) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_markov, 0) AS n_markov
FROM d LEFT JOIN bg USING (r) LEFT JOIN ag USING (r)"""
