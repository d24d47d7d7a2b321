"""Document quality by supervised subword embeddings.

Words and character n-grams (within ``<word>``) are hashed to rows of an
embedding table; a document is the average of its rows, a softmax layer over
the average gives the class. Table and layer are learned together by plain
stochastic gradient descent in numpy, on a bounded sample of labelled rows.

Two rows are common to all texts: one counts a word that repeats the word
before it (the hashed bigram of any word with itself), one stands ``pad``
times in each text, so that a handful of odd n-grams does not decide a short one.

Since the output layer is linear in the average, a trained model scores a
document from one number per distinct word (the sum over its subwords of the
output direction), so whole texts of any length are scored in one pass.

Results by case: null and empty texts have no words and score by the common row
and the bias alone; without labelled rows every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_parts, map_column

CACHE_ENTRIES = 400_000


@dataclass
class Settings:
    rows_per_class: int = 1500  # bound on the labelled sample, per label
    bits: int = 17              # 2**bits rows in the embedding table
    dim: int = 10
    shortest: int = 2           # character n-gram lengths
    longest: int = 4
    pad: int = 40               # the common row's count in each text
    again: int = 20             # a repeated word's count
    epochs: int = 5
    rate: float = 0.4
    seed: int = 7


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(table row, word index) of every subword of every word: the word itself
    and the n-grams of ``<word>``. Rows 0 and 1 are left to the common features."""
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(c)) - np.repeat(start, size)
    # a word's hash: a polynomial in its characters
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    keys, owners = [np.add.reduceat(c * power[place], start)], [np.arange(len(words))]
    key = c + np.uint64(1)
    for n in range(2, s.longest + 1):
        key = key[:-1] * np.uint64(0x100000001B3) + c[n - 1:]
        if n >= s.shortest:
            inside = owner[:-(n - 1)] == owner[n - 1:]
            keys.append((key[inside] << np.uint64(3)) + np.uint64(n))
            owners.append(owner[:-(n - 1)][inside])
    h = np.concatenate(keys) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - s.bits)).astype(np.int64) | 2, np.concatenate(owners)


@dataclass
class Model:
    settings: Settings
    direction: np.ndarray  # per table row: its embedding times the output difference
    bias: float


def bag(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text, and how often each comes."""
    words = (text or "").split()
    rows, count = np.array([0, 1]), np.array([float(s.pad), sum(a == b for a, b in zip(words, words[1:])) * s.again])
    if words:
        distinct = Counter(words)
        sub, owner = subwords(list(distinct), s)
        more, at = np.unique(sub, return_inverse=True)
        rows = np.concatenate([rows, more])
        count = np.concatenate([count, np.bincount(at, np.fromiter(distinct.values(), float)[owner])])
    return rows, count


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Learn the table and the softmax layer; one document per step."""
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2)
    if not texts:
        return Model(s, np.zeros(1 << s.bits, np.float32), 0.0)
    bags = []
    for t in texts:
        rows, part = bag(t, s)
        bags.append((rows, part / part.sum()))
    y = np.asarray(labels)
    share = np.bincount(y, minlength=2) / len(y)
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    steps, total = 0, s.epochs * len(bags)
    for _ in range(s.epochs):
        for i in rng.permutation(len(bags)):
            rate = s.rate * (1 - steps / total)
            steps += 1
            rows, part = bags[i]
            part = part.astype(np.float32)
            mean = part @ table[rows]
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= rate * min(weight[y[i]], 4)
            back = (p @ out).astype(np.float32)
            out -= np.outer(p, mean).astype(np.float32)
            bias -= p
            # each row moves by its count's share; a row's step is scaled by
            # the bag's size so that long texts teach as much as short ones
            table[rows] -= np.outer(part / part.max(), back)
    return Model(s, (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Probability of class 1 of whole texts, with per-word sums remembered."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0)

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.index)
        if len(self.index) + len(new) > CACHE_ENTRIES:
            self.index, new = {}, words
            self.sums, self.sizes = np.zeros(0), np.zeros(0)
        if new:
            names = list(new)
            rows, owner = subwords(names, self.model.settings)
            self.index.update(zip(names, range(len(self.sums), len(self.sums) + len(names))))
            self.sums = np.concatenate([self.sums, np.bincount(owner, self.model.direction[rows], len(names))])
            self.sizes = np.concatenate([self.sizes, np.bincount(owner, minlength=len(names))])

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [(t or "").split() for t in texts]
        self._learn(set().union(*split))
        s, out = self.model.settings, []
        for words in split:
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            again = s.again * int((at[1:] == at[:-1]).sum())
            total = self.sums[at].sum() + s.pad * self.model.direction[0] + again * self.model.direction[1]
            logit = self.model.bias + total / (self.sizes[at].sum() + s.pad + again)
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -60, 60)))))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list, list]:
    """At most ``per_class`` rows of either label, by hash of the id, for the
    driver to learn from, one text of each id. The bound holds whatever the input's size."""
    low = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    ids = None
    for k in (0, 1):
        part = (low.filter(F.col("label") == k).groupBy("doc_id").agg(F.max("label").alias("label"))
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
        ids = part if ids is None else ids.unionByName(part)
    rows = (docs.select("doc_id", "text").filter(F.col("text").isNotNull())
            .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
            .orderBy("doc_id").toPandas())
    return rows["text"].tolist(), [int(x) for x in rows["label"]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings | None = None) -> Model:
    """Learn from at most ``2 * rows_per_class`` labelled rows."""
    s = settings or Settings()
    return train(*labelled_sample(docs, labels, label, s.rows_per_class), s)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append ``out``: the probability of label 1, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    field = next(f for f in docs.schema.fields if f.name == text)

    def make():
        scorer = Scorer(shared.value)
        return lambda col: [col, pa.array(in_parts(col, scorer.scores), pa.float64())]

    return map_column(docs, text, T.StructType([field, T.StructField(out, T.DoubleType())]), make)
