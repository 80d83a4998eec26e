"""Column functions over lists of closed integer ranges (array<struct<s, e>>, ascending and disjoint: the exons of one transcript).

Defined cases: a null list gives null; an empty list has no introns, width 0, lies within anything and meets nothing; a strand other
than `-` (`+`, `*`, null) reads from the left. Ranges of a list are taken to be apart by at least one position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(s: Column, e: Column) -> Column:
    return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))


def introns(x: Column) -> Column:
    """The gaps between consecutive ranges."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda a, b: _range(a["e"] + 1, b["s"] - 1))


def ranks(x: Column, strand: Column) -> Column:
    """Each range with its rank along the strand and from the other end; `*` counts as `+`."""
    n = F.size(x)
    return F.transform(x, lambda r, i: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.when(strand == "-", n - i).otherwise(i + 1).alias("rank"), F.when(strand == "-", i + 1).otherwise(n - i).alias("end_rank")))


def cut_terminals(x: Column) -> Column:
    """The first range keeps its last two positions, the last one its first two; a single one its last two."""
    n = F.size(x)
    return F.transform(x, lambda r, i: F.when(i == 0, _range(r["e"] - 1, r["e"])).when(i == n - 1, _range(r["s"], r["s"] + 1)).otherwise(_range(r["s"], r["e"])))


def extend(x: Column, by: int, length: int) -> Column:
    return F.transform(x, lambda r: _range(F.greatest(r["s"] - by, F.lit(1)), F.least(r["e"] + by, F.lit(length))))


def drop_short(x: Column, least: int) -> Column:
    return F.filter(x, lambda r: r["e"] - r["s"] + 1 >= least)


def first_n(x: Column, strand: Column, n: int) -> Column:
    """The first n ranges along the strand, in ascending order."""
    size = F.size(x)
    k = F.least(F.lit(n), size)
    return F.when(strand == "-", F.slice(x, F.greatest(size - k + 1, F.lit(1)), k)).otherwise(F.slice(x, F.lit(1), k))


def width(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"] + 1)


def common(x: Column, y: Column) -> Column:
    """The number of positions that both lists have; additive because the ranges of a list are disjoint."""
    overlap = lambda a, b: F.greatest(F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]) + 1, F.lit(0))
    return F.aggregate(x, F.lit(0).cast("long"), lambda acc, a: acc + F.aggregate(y, F.lit(0).cast("long"), lambda t, b: t + overlap(a, b)))


def setdiff_width(x: Column, y: Column) -> Column:
    return width(x) - common(x, y)


def setdiff(x: Column, y: Column) -> Column:
    """The ranges of positions that x has and y has not."""
    least, most = F.lit(-(1 << 60)).cast("long"), F.lit(1 << 60).cast("long")
    firsts = F.concat(F.array(least), F.transform(y, lambda b: b["e"] + 1))
    lasts = F.concat(F.transform(y, lambda b: b["s"] - 1), F.array(most))
    free = F.zip_with(firsts, lasts, _range)
    return intersect(x, free)


def intersect(x: Column, y: Column) -> Column:
    """The ranges of positions that both lists have."""
    cut = F.transform(x, lambda a: F.transform(F.filter(y, lambda b: (b["s"] <= a["e"]) & (a["s"] <= b["e"])), lambda b: _range(F.greatest(a["s"], b["s"]), F.least(a["e"], b["e"]))))
    return F.flatten(cut)


def union(x: Column, y: Column) -> Column:
    """The ranges of positions that either list has; touching ranges merge."""
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def add(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = F.coalesce(r["s"] <= last["e"] + 1, F.lit(False))
        kept = F.when(joins, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        return F.concat(kept, F.array(F.when(joins, _range(last["s"], F.greatest(last["e"], r["e"]))).otherwise(_range(r["s"], r["e"]))))

    return F.aggregate(F.array_sort(F.concat(x, y)), none, add)


def contained(x: Column, y: Column) -> Column:
    """Every range of x lies within some range of y."""
    return F.forall(x, lambda a: F.exists(y, lambda b: (b["s"] <= a["s"]) & (a["e"] <= b["e"])))


def meets(a: Column, b: Column) -> Column:
    """Two ranges have a position in common."""
    return (a["s"] <= b["e"]) & (b["s"] <= a["e"])


def first(x: Column, strand: Column) -> Column:
    """The first range along the strand."""
    return F.when(strand == "-", F.try_element_at(x, F.lit(-1))).otherwise(F.try_element_at(x, F.lit(1)))


def last(x: Column, strand: Column) -> Column:
    """The last range along the strand."""
    return F.when(strand == "-", F.try_element_at(x, F.lit(1))).otherwise(F.try_element_at(x, F.lit(-1)))


def fits_strand(a: Column, b: Column) -> Column:
    """Strands that may be the same; `*` fits any."""
    return (a == b) | (a == "*") | (b == "*")


def differences(q: Column, y: Column, most: int) -> Column:
    """struct(unique_query, unique_subject, out_query, out_subject, compatible): positions of q outside y and of y in the gaps of q,
    how many of these pieces have at least `most` positions, and whether none has. With most = 0 any piece counts."""
    both = F.array(F.struct(setdiff(q, y).alias("d"), intersect(y, introns(q)).alias("i")))  # made once, as each use is evaluated by itself

    def told(v: Column) -> Column:
        long = lambda x: F.size(F.filter(x, lambda r: r["e"] - r["s"] + 1 >= most)).cast("long")
        out_q, out_s = long(v["d"]), long(v["i"])
        return F.struct(width(v["d"]).alias("unique_query"), width(v["i"]).alias("unique_subject"), out_q.alias("out_query"), out_s.alias("out_subject"), ((out_q == 0) & (out_s == 0)).alias("compatible"))

    return F.transform(both, told)[0]


def end_differences(a: Column, b: Column, y: Column) -> Column:
    """struct(match, unique_query, unique_subject) of a terminal range a of the query, b of the subject, all of which is y: whether they
    meet, positions of a outside y, and positions outside a of the ranges of y that a meets."""
    one = F.array(a)
    shared = common(one, y)
    met = width(F.filter(y, lambda r: meets(r, a)))
    size = a["e"] - a["s"] + 1
    return F.struct(meets(a, b).alias("match"), (size - shared).alias("unique_query"), (met - shared).alias("unique_subject"))


def compatible(q: Column, s: Column) -> Column:
    """Nothing of the query lies outside the subject, and nothing of the subject lies in the query's gaps."""
    return (setdiff_width(q, s) == 0) & (common(s, introns(q)) == 0)


def from_fragments(start: Column, end: Column, gaps: Column) -> Column:
    """Ranges from outer bounds and the gaps between them."""
    firsts = F.concat(F.array(start.cast("long")), F.transform(gaps, lambda g: g["e"] + 1))
    lasts = F.concat(F.transform(gaps, lambda g: g["s"] - 1), F.array(end.cast("long")))
    return F.zip_with(firsts, lasts, _range)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def letter_count(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


#: Donor and acceptor on the plus strand; the reverse complements mean minus.
MOTIFS = ("GT-AG", "GC-AG", "AT-AC", "AT-AA", "AT-AG", "GT-AA")
_FLIP = str.maketrans("ACGT-", "TGCA-")


def motif_strand(motif: Column) -> Column:
    minus = [m[::-1].translate(_FLIP) for m in MOTIFS]
    return F.when(motif.isin(*MOTIFS), "+").when(motif.isin(*minus), "-").otherwise("*")
