"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel counts common character subsequences of length three, gaps allowed,
each weighted by ``decay`` per skipped character (Lodhi et al. 2002, gaps
limited to ``span``). Words are compared with their borders marked, so an
insult with characters put in, left out or set apart still shares most of its
subsequences with the plain form.

Training is on labelled sentences: only documents carry labels, so a sentence
of a toxic document is a positive example through its most suspicious word,
and each clean document gives its most suspicious word as a negative one
(the witnesses are chosen anew in every round). Words are mapped to kernel
values against landmark words, whitened (Nyström), and separated by a linear
SVM in numpy. A text scores as its worst sentence, a sentence as its worst
word; a logistic curve turns the margin into the 0-1 score.

In the feature space of subsequences the trained SVM is one weight per
subsequence, so a word is scored without visiting the landmarks again.

Results by case: null and empty texts, and texts without a letter, score as
the bias alone; without both labels in the sample every score is 0;
repeated rows score alike; texts are read whole.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_parts, map_column
from .quality import labelled_sample

CACHE_ENTRIES = 100_000
BLOCK = 4096  # words scored at a time

# Digits and signs commonly put for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_SENTENCE = re.compile(r"[.!?]\s+|\n")
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
_INNER = {i: None for i in range(33, 127) if not chr(i).isalpha()} | \
    {ord(a): b for a, b in LOOKALIKES.items()}
CLASSES = 49  # padding, two border marks, letters a-z, 20 classes for other letters


@dataclass
class Settings:
    rows_per_class: int = 1200  # bound on the labelled sample, per label
    landmarks: int = 256
    decay: float = 0.5
    span: int = 4               # most characters a subsequence may stretch over
    longest: int = 24           # longer words are scored in overlapping pieces
    odds: float = 20.0          # how much likelier in toxic documents a suspicious word is
    rounds: int = 4
    epochs: int = 10
    penalty: float = 2e-4
    threshold: float = 0.7
    seed: int = 11


def plain(word: str) -> str:
    """Lower case, outer signs cut, look-alikes read as letters, inner signs dropped."""
    return word.lower().strip(_EDGES).translate(_INNER)


def codes(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of ``^word$`` per word (padded with class 0), and the lengths."""
    cut = [w[:s.longest] for w in words]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    flat = np.where((flat >= 97) & (flat <= 122), flat - 94, 29 + flat % 20)
    out = np.zeros((len(cut), int(n.max(initial=0)) + 2), np.int32)
    out[:, 0] = 1
    row = np.repeat(np.arange(len(cut)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1] = flat
    out[np.arange(len(cut)), n + 1] = 2
    return out, n + 2


def triples(s: Settings) -> list[tuple[int, int, float]]:
    """Offsets of the second and third character, with the weight of the gaps."""
    return [(j, k, s.decay ** (k - 2)) for k in range(2, s.span + 1) for j in range(1, k)]


def subsequence_features(words: list[str], s: Settings):
    """Yield, for each start and gap pattern, (rows, subsequence numbers, weights),
    normalised by the word's length alone (a positive function of one word, so
    products of these features stay a kernel)."""
    c, n = codes(words, s)
    scale = 1 / np.sqrt(np.maximum(length_norm(n, s), 1e-9))
    for j, k, weight in triples(s):
        for i in range(c.shape[1] - k):
            rows = np.nonzero(n > i + k)[0]
            yield rows, (c[rows, i] * CLASSES + c[rows, i + j]) * CLASSES + c[rows, i + k], weight * scale[rows]


def length_norm(n: np.ndarray, s: Settings) -> np.ndarray:
    return sum(np.maximum(n - k, 0) * weight ** 2 for _, k, weight in triples(s))


def feature_rows(words: list[str], s: Settings) -> list[dict[int, float]]:
    rows: list[dict[int, float]] = [{} for _ in words]
    for at, what, weight in subsequence_features(words, s):
        for r, f, x in zip(at.tolist(), what.tolist(), weight.tolist()):
            rows[r][f] = rows[r].get(f, 0.0) + x
    return rows


def kernel(words: list[str], landmarks: list[str], s: Settings) -> np.ndarray:
    """Kernel values of words (rows) against landmarks (columns)."""
    marks = feature_rows(landmarks, s)
    names = {f: i for i, f in enumerate(sorted({f for m in marks for f in m}))}
    dense = np.zeros((len(names) + 1, len(landmarks)), np.float32)
    for j, m in enumerate(marks):
        for f, x in m.items():
            dense[names[f], j] = x
    lookup = np.full(CLASSES ** 3, len(names))
    for f, i in names.items():
        lookup[f] = i
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), BLOCK):
        part = words[at:at + BLOCK]
        bag = np.zeros((len(part), len(names) + 1), np.float32)
        for rows, what, weight in subsequence_features(part, s):
            bag[rows, lookup[what]] += weight  # a row comes once per pattern and start
        out[at:at + BLOCK] = bag @ dense
    return out


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray  # per subsequence
    bias: float
    curve: tuple[float, float]
    landmarks: list[str]

    def margins(self, words: list[str]) -> np.ndarray:
        out, s = np.full(len(words), self.bias), self.settings
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # blocks of like lengths
        for at in range(0, len(words), BLOCK):
            part = order[at:at + BLOCK]
            c, n = codes([words[i] for i in part], s)
            total = np.zeros(len(part), np.float32)
            first, second = c * CLASSES ** 2, c * CLASSES
            for j, k, weight in triples(s):
                width = c.shape[1] - k
                if width > 0:  # subsequences that hold padding weigh nothing
                    total += weight * self.weights[first[:, :width] + second[:, j:j + width] + c[:, k:]].sum(1)
            out[part] += total / np.sqrt(np.maximum(length_norm(n, s), 1e-9))
        return out


def spelled(words: list[str]) -> list[str]:
    """Words written letter by letter: runs of four or more one-letter words."""
    out, at = [], [i for i, w in enumerate(words) if len(w) == 1]
    start = 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] != at[k - 1] + 1:
            if k - start >= 4:
                out.append("".join(words[i] for i in at[start:k]))
            start = k
    return out


def sentences(text: str) -> list[list[str]]:
    """Words per sentence, spelled-out ones joined."""
    parts = (part.split() for part in _SENTENCE.split(text))
    return [words + spelled(words) for words in parts if words]


def words_of(text: str) -> set[str]:
    """All words of a text (its worst sentence holds its worst word, so the
    text's margin is the largest over these)."""
    words = text.split()
    return set(words).union(spelled(words))


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, s: Settings, rng) -> np.ndarray:
    """Linear SVM by stochastic subgradient steps on small batches; the last
    column of ``x`` is the constant. Averaged over the second half."""
    v, total, kept, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    steps = s.epochs * max(1, len(x) // 32)
    p = weight / weight.sum()
    for t in range(steps):
        i = rng.choice(len(x), 32, p=p)
        bad = y[i] * (x[i] @ v) < 1
        rate = 1 / (s.penalty * (t + 400))
        v *= 1 - rate * s.penalty
        v += rate / 32 * (y[i][bad, None] * x[i][bad]).sum(0)
        if 2 * t >= steps:
            total += v
            kept += 1
    return total / max(kept, 1)


def distinct(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """One text of each label's groups of copies in the sample (texts with the same
    smallest hash of five words), else a copied text's chance words look toxic."""
    first = {}
    for t, y in zip(texts, labels):
        w = t.split()
        first.setdefault((y, min(crc32(" ".join(w[i:i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 4)))), (t, y))
    return [t for t, _ in first.values()], [y for _, y in first.values()]


def forms_of(sentence: set[str] | list[str], s: Settings) -> list[str]:
    """The plain words of a sentence; a long one in the overlapping pieces that are scored, too."""
    out = set()
    for f in filter(None, map(plain, sentence)):
        out.update([f] if len(f) <= s.longest else pieces_of(f, s))
    return sorted(out)


def pieces_of(form: str, s: Settings) -> list[str]:
    return [form[at:at + s.longest] for at in range(0, len(form) - s.longest // 2, s.longest // 2)]


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    texts, labels = distinct(texts, labels)
    split = [[forms_of(sent, s) for sent in sentences(t)] for t in texts]
    bags = [sorted({w for sent in doc for w in sent}) for doc in split]
    toxic = [b for b, y in zip(bags, labels) if y == 1 and b]
    clean = [b for b, y in zip(bags, labels) if y == 0 and b]
    toxic_sentences = [sent for doc, y in zip(split, labels) if y == 1 for sent in doc if sent]
    empty = Model(s, np.zeros(CLASSES ** 3, np.float32), -20.0, (1.0, 0.0), [])
    if not toxic or not clean:
        return empty
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)

    seen = sorted(in_toxic)
    t, c = np.array([in_toxic[w] for w in seen]), np.array([in_clean[w] for w in seen])
    odds = dict(zip(seen, ((np.log((t + 0.1) / (len(toxic) + 1)) - np.log((c + 0.5) / (len(clean) + 1)))
                           * np.log1p(t)).tolist()))

    def suspicious(w: str) -> bool:
        return in_toxic[w] >= 3 and in_toxic[w] * len(clean) > s.odds * (in_clean[w] + 0.3) * len(toxic)

    # a toxic document's sentence is toxic if its worst word is suspicious, or the document's worst
    by_sentence = [max(sent, key=odds.__getitem__) for sent in toxic_sentences]
    named = [w for w in by_sentence if suspicious(w)]
    witness = [max(b, key=odds.__getitem__) for b in toxic] + named
    common = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    half = s.landmarks // 2
    suspects = [w for w, _ in sorted(Counter(witness).items(), key=lambda x: (-x[1], x[0]))[:half]]
    others = common[:half // 2] + [str(w) for w in rng.choice(common, min(half - half // 2, len(common)), replace=False)]
    marks = sorted(set(suspects) | set(others))
    values, vectors = np.linalg.eigh(kernel(marks, marks, s).astype(float))
    good = values > 1e-4 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    rows = feature_rows(marks, s)

    def features(words: list[str]) -> np.ndarray:
        x = kernel(words, marks, s).astype(float) @ whiten
        return np.concatenate([x, np.ones((len(x), 1))], 1)

    base = Counter(str(w) for w in rng.choice(common, min(2500, len(common)), replace=False)) + Counter(common[:400])
    letters = "abcdefghijklmnopqrstuvwxyz"
    hard: Counter[str] = Counter()
    model = empty
    flat_t, flat_c = sorted(in_toxic), sorted(in_clean)
    for _ in range(s.rounds):
        pos = Counter(witness)
        # the same words with a character put in; they count for less
        for w in [w for w in pos if len(w) >= 5]:
            for _ in range(2):
                i = int(rng.integers(1, len(w)))
                pos[w[:i] + letters[int(rng.integers(len(letters)))] + w[i:]] += max(1, pos[w] // 4)
        neg = base + hard
        words = list(pos) + list(neg)
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        weight = np.concatenate([np.sqrt(list(pos.values())) / np.sqrt(list(pos.values())).sum(),
                                 np.fromiter(neg.values(), float) / sum(neg.values())])
        v = separate(features(words), y, weight, s, rng)
        alpha = whiten @ v[:-1]
        table = np.zeros(CLASSES ** 3)
        for a, r in zip(alpha, rows):
            for f, x in r.items():
                table[f] += a * x
        model = Model(s, table.astype(np.float32), float(v[-1]), (1.0, 0.0), marks)
        of_t = dict(zip(flat_t, model.margins(flat_t)))
        of_c = dict(zip(flat_c, model.margins(flat_c)))
        witness = [max(b, key=lambda w: of_t[w] + 0.3 * odds[w]) for b in toxic] + named
        for b in clean:  # the words nearest to toxic ones
            hard.update({w: 3 for w in heapq.nlargest(2, b, of_c.__getitem__)})
    # the curve: logistic regression of the label on the largest margin
    top = np.array([max(of_t[w] for w in b) for b in toxic] + [max(of_c[w] for w in b) for b in clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    a, b = 1.0, 0.0
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        w = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean))
        a -= 2.0 * (((p - y) * w * top).sum() + 1e-3 * a / len(y))
        b -= 2.0 * ((p - y) * w).sum()
    model.curve = (float(a), float(b))
    return model


class Scorer:
    """Scores whole texts; margins of words are remembered within a task."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known, new = {}, words
        names, longest = list(new), self.model.settings.longest
        forms = list(map(plain, names))
        margins = self.model.margins(forms)
        for i, f in enumerate(forms):
            if len(f) > longest:  # overlapping pieces of a long word
                margins[i] = self.model.margins(pieces_of(f, self.model.settings)).max()
            elif not f:
                margins[i] = self.model.bias
        self.known.update(zip(names, margins.tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        bags = [words_of(t or "") for t in texts]
        self._learn(set().union(*bags))
        top = [max(map(self.known.__getitem__, b), default=self.model.bias) for b in bags]
        a, b = self.model.curve
        return (1 / (1 + np.exp(-np.clip(a * np.array(top) + b, -60, 60)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings | None = None) -> Model:
    """Learn from the sentences of at most ``2 * rows_per_class`` labelled documents."""
    s = settings or Settings()
    return train(*labelled_sample(docs, labels, label, s.rows_per_class), s)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append ``out``: 0 to 1, higher where the worst sentence is likelier toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    field = next(f for f in docs.schema.fields if f.name == text)

    def make():
        scorer = Scorer(shared.value)
        return lambda col: [col, pa.array(in_parts(col, scorer.scores), pa.float64())]

    return map_column(docs, text, T.StructType([field, T.StructField(out, T.DoubleType())]), make)
