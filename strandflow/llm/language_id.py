"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection.

A text's features are the n-grams of 1 to 4 of its letters within words (word ends included), hashed into BUCKETS rows of an
embedding table; their average goes through a linear softmax over the languages and one further class for what is none of them.
Both layers are trained by stochastic gradient descent in numpy in one task, over a bounded sample of labelled documents:
about PER_LANG documents of each of the MOST_LANGS most frequent languages, chosen by a hash of doc_id. Only features reach that
task (at most BUCKETS numbers a row, however long the text): of the whole text, of some segments of it, and of negatives made
from it, whose letters are shuffled, or drawn evenly from the letters that it has. The driver gets the model, never the sample.

A part of the sample is held back for calibration. It sets the softmax's temperature, which makes the score a probability, and
the rejection threshold on the margin, the log-odds of the best language against none. Held-back texts and segments of known
languages are to be taken. To be rejected are held-back negatives, and the held-back texts of languages that the model does not
know: models are trained with a part of the languages left out, in up to FOLDS turns, and judge these. The threshold is where both
are parted best (each kind of negative counts alike), in the middle between the two where a gap lies, and never above the
REJECT quantile of the whole texts that are to be taken (segments may be keys or numbers).

Prediction is local to a row and reads nothing but the text; embedding and softmax are folded into one score per bucket and
class. Texts are read in pieces of PIECE letters with the n-grams across the seams kept, so memory is bounded by the text.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; null labels are not learned from, nor
are rows with a null doc_id; without any label everything is `und`; ties go to the language first in code point order; other
columns are carried along; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import table

BUCKETS = 1 << 13
DIM = 16
ORDERS = 4
PIECE = 1 << 16
PER_LANG, MOST_LANGS = 300, 500
#: The share of what is to be taken that may be rejected, and in how many turns languages are left out.
REJECT, FOLDS = 0.01, 4
#: Segments of a sampled document that are learned from besides the whole, and their letters.
SEGMENTS, SEGMENT = 3, 60
#: Letters of the longest negatives.
PART_OF_ALL = 600
SALT = 20
#: Kinds of rows of the sample; those from SHUFFLED on are negatives.
WHOLE, PART, SHUFFLED, EVEN = range(4)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def folded(text: str) -> np.ndarray:
    """Small letters as code points, 0 for each run of anything else, 0 at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[c], c, 0).astype(np.uint32)
    c = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    return c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]


def subwords(c: np.ndarray) -> np.ndarray:
    """How often each bucket is hit by the n-grams of c."""
    out = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for start in range(0, len(c), PIECE):
        s = c[start : start + PIECE + ORDERS - 1]
        whole = s != 0
        g, ok, found = s * np.uint32(0x9E3779B1), whole, []
        for n in range(1, ORDERS + 1):
            if n > 1:
                if len(g) < 2:
                    break
                g = g[:-1] * np.uint32(0x85EBCA6B) + s[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
                ok = (whole[:-1] | whole[1:]) if n == 2 else whole[1:-1] if n == 3 else ok[:-1] & whole[n - 2 : -1]
            h = (g ^ (g >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            found.append((h >> shift)[:PIECE][ok[:PIECE]])
        out += np.bincount(np.concatenate(found), minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  #: BUCKETS x (languages and none): embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1.0, float(counts.sum())) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability that it is the text's, rejected)."""
        c = folded(text) if text else np.zeros(0, np.uint32)
        if not self.langs or not c.any():
            return "und", 0.0, True
        z = self.logits(subwords(c).astype(np.float32))
        k = int(np.argmax(z[:-1]))
        p = np.exp((z - z.max()) / self.temperature)
        return self.langs[k], float(p[k] / p.sum()), bool(z[k] - z[-1] < self.threshold)


class Rows:
    """Averaged counts of some rows (buckets, counts), sparse; only some of them at a time are ever dense."""

    def __init__(self, at: list[bytes], n: list[bytes]):
        self.size = np.array([len(a) // 4 for a in at], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.at = np.frombuffer(b"".join(at), np.int32)
        self.value = np.frombuffer(b"".join(n), np.int32).astype(np.float32)
        self.value /= np.repeat(np.add.reduceat(self.value, self.first), self.size)

    def dense(self, which: np.ndarray) -> np.ndarray:
        n = self.size[which]
        begin = np.cumsum(n) - n
        k = np.arange(int(n.sum())) + np.repeat(self.first[which] - begin, n)
        x = np.zeros((len(which), BUCKETS), np.float32)
        x.ravel()[self.at[k] + np.repeat(np.arange(len(which)) * BUCKETS, n)] = self.value[k]
        return x


def fit(rows: Rows, which: np.ndarray, y: np.ndarray, n: int, epochs: int = 10, rate: float = 40.0, batch: int = 64, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) of n classes from some of the rows, of classes y. Stochastic gradient descent over small batches; only a
    batch is ever dense."""
    r = np.random.default_rng(seed)
    e = r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    w, b = r.normal(0, 0.3, (DIM, n)).astype(np.float32), np.zeros(n, np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
            xi = rows.dense(which[i])
            h = xi @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p *= step / len(i)
            dh = p @ w.T
            w -= np.float32(0.02) * (h.T @ p)
            b -= np.float32(0.02) * p.sum(0)
            e -= xi.T @ dh
    return e @ w, b


#: at and n: buckets and counts, 32 bits each, as bytes, so that the task that trains holds no objects for them.
FOUND = "lang string, held boolean, kind int, at binary, n binary"
MODEL = "langs array<string>, table binary, bias binary, temperature double, threshold double"


def shuffled(c: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """The letters of c in another order; words keep their lengths."""
    out, at = c.copy(), np.flatnonzero(c)
    out[at] = c[r.permutation(at)]
    return out


def even(c: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Letters drawn evenly from those of c; words keep their lengths."""
    out, at = c.copy(), np.flatnonzero(c)
    out[at] = r.choice(np.unique(c[at]), len(at))
    return out


def _features(batches):
    for pdf in batches:
        rows = []
        for t, lang, held in zip(pdf["text"], pdf["lang"], pdf["held"], strict=True):
            c = folded(t)
            if not c.any():
                continue
            r = np.random.default_rng(crc32(c.tobytes()))
            parts = [c[s : s + SEGMENT] for s in np.linspace(0, max(0, len(c) - SEGMENT), SEGMENTS, dtype=int)] if len(c) > 2 * SEGMENT else []
            parts = [p for p in parts if p.any()]
            part = parts[0] if parts else c
            kinds = [(WHOLE, c), *[(PART, p) for p in parts], (SHUFFLED, shuffled(c[:PART_OF_ALL], r)), (SHUFFLED, shuffled(part, r)), (EVEN, even(part, r))]
            for kind, x in kinds:
                counts = subwords(x)
                at = np.flatnonzero(counts)
                rows.append((lang, held, kind, at.astype(np.int32).tobytes(), counts[at].astype(np.int32).tobytes()))
        yield pd.DataFrame(rows, columns=["lang", "held", "kind", "at", "n"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _none() -> LanguageModel:
    return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """A model from the labelled rows of docs (doc_id, text, lang) that are not held out."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    if not sizes:
        return _none()
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SALT)), F.lit(1 << 20)) / float(1 << 20)
    held = F.pmod(F.xxhash64("doc_id", F.lit(SALT + 1)), F.lit(4)) == 0
    rows = known.filter(draw < share).select("text", "lang", held.alias("held")).mapInPandas(_features, FOUND)
    found = rows.groupBy().applyInPandas(_fitted, MODEL).collect()
    if not found:
        return _none()
    m = found[0]
    return LanguageModel(list(m["langs"]), np.frombuffer(m["table"], np.float32).reshape(BUCKETS, -1), np.frombuffer(m["bias"], np.float32), m["temperature"], m["threshold"])


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    m = fitted(rows)
    return pd.DataFrame({"langs": [m.langs], "table": [m.table.tobytes()], "bias": [m.bias.tobytes()], "temperature": [m.temperature], "threshold": [m.threshold]})


def fitted(rows: pd.DataFrame) -> LanguageModel:
    """The model of a sample (FOUND), calibrated on its held-back rows; the same whatever the order of the rows."""
    rows = rows.iloc[np.lexsort((rows["at"].map(lambda a: crc32(bytes(a))), rows["kind"], rows["lang"]))]
    langs = sorted(set(rows["lang"]))
    x = Rows(rows.pop("at").tolist(), rows.pop("n").tolist())
    lang = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    kind, held = rows["kind"].to_numpy(), rows["held"].to_numpy(bool)
    made = kind >= SHUFFLED
    learn = ~held if (~held & ~made).any() else np.ones(len(lang), bool)
    check = held if (held & ~made).any() else learn

    def trained(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, bias) from the learnable rows of some languages; the last class is none."""
        number = np.cumsum(some) - 1
        at = np.flatnonzero(learn & some[lang])
        return fit(x, at, np.where(made[at], some.sum(), number[lang[at]]), int(some.sum()) + 1)

    def logits(model: tuple, which: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(which)
        return np.concatenate([x.dense(part) @ model[0] + model[1] for part in np.array_split(at, len(at) // 256 + 1)])

    def margin(z: np.ndarray) -> np.ndarray:
        return z[:, :-1].max(1) - z[:, -1]

    every = np.ones(len(langs), bool)
    m = LanguageModel(langs, *trained(every))
    z = logits((m.table, m.bias), check)
    y, k = np.where(made[check], len(langs), lang[check]), kind[check]
    m.temperature = min((float(t) for t in np.geomspace(0.25, 4, 33)), key=lambda t: _loss(z / t, y))
    refuse = [margin(z[k == i]) for i in (SHUFFLED, EVEN)]
    strange = []
    for f in range(min(FOLDS, len(langs)) if len(langs) > 1 else 0):
        left = np.arange(len(langs)) % FOLDS == f
        strange.append(margin(logits(trained(~left), check & ~made & left[lang])))
    m.threshold = parted(margin(z[k < SHUFFLED]), [*refuse, *([np.concatenate(strange)] if strange else [])], margin(z[k == WHOLE]))
    return m


def parted(take: np.ndarray, refuse: list[np.ndarray], whole: np.ndarray | None = None) -> float:
    """The value that parts what is to be taken (at or above it) from what is to be refused, each kind of which counts alike; not above
    the REJECT quantile of the whole texts among the former."""
    low, weight = np.concatenate(refuse), np.concatenate([np.full(len(r), 1 / (len(refuse) * len(r))) for r in refuse if len(r)])
    at = np.unique(np.r_[take, low])
    lost = np.searchsorted(np.sort(take), at) / len(take)
    order = np.argsort(low)
    caught = np.r_[0, np.cumsum(weight[order])][np.searchsorted(low[order], at)]
    best = int(np.argmax(caught - lost))
    # the cut may lie anywhere between the value below and this one
    middle = float((at[best - 1] + at[best]) / 2) if best else float(at[0])
    return min(middle, float(np.quantile(take if whole is None or not len(whole) else whole, REJECT)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))


def predictor(spark: SparkSession, model: LanguageModel):
    """A function from a text column to struct(lang_pred, score, rejected). The model's size is BUCKETS times the languages."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict


def identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    predict = predictor(docs.sparkSession, model or train(docs))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")


def accepted(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of docs whose language the model takes, unchanged."""
    predict = predictor(docs.sparkSession, model or train(docs))
    return docs.filter(~predict("text")["rejected"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


SQL = None
