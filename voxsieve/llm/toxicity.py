"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel compares two words by the letter triples that they share in order, with gaps: a triple weighs DECAY to the power
of the stretch it spans, so an insult with inserted characters still resembles the plain one. Words of labelled sentences are
mapped by their kernel values with the landmarks (Nyström), and a linear machine with squared hinge loss is trained on them
as multiple-instance learning: in a toxic text only the word most like an insult must be one. As the machine is linear in
the triples, it is applied as one table of triple weights. A text's score is a logistic function of how many words are that toxic, and of how many there are.

Defined results: null and empty texts hold no word and get the score of a text without any toxic word. Any text is scored
whole; words longer than PIECE letters are scored in overlapping pieces. Repeated rows score alike. Rows of labels without a
matching document, or without a label, teach nothing; with fewer than two kinds of labels every score is the share of toxic
labels (0 if there are none). Columns besides id and text aren't read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, bounded_batches, hash_sample, quoted, released

#: Labelled rows that the machine is fitted on, taken by hash, and the characters up to which a text may be one of them.
FIT_ROWS, FIT_CHARS = 5000, 12_000
LANDMARKS, NEGATIVES = 256, 12_000
DECAY, SPAN, PIECE = 0.6, 7, 24
ROUNDS = 4
#: Letters are numbered into so many codes: 0 stands for anything that isn't a letter or digit, 1 for a word's start, 2 its end.
CODES = 64

_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def _code(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - ord("a") + 4
    if c.isdigit():
        return 3
    if c.isalpha():
        return 30 + ord(c) % (CODES - 30)
    return 0


def units(text: str) -> set[str]:
    """The distinct words of a text, lower-cased and without marks at their ends; spaced-out letters make one word."""
    raw = text.lower().split()
    out, letters = set(), {}
    for w in set(raw):
        if w.isalnum():
            out.add(w)
            one = w
        else:
            out.add(_EDGES.sub("", w))
            one = w if len(w) == 1 else w.strip(".,;:!?\"'()*-_")
        if len(one) == 1 and one.isalnum():
            letters[w] = one
    out.discard("")
    if letters:
        run: list[str] = []
        for w in [*raw, "  "]:
            if w in letters:
                run.append(letters[w])
            elif run:
                if len(run) > 2:
                    out.add("".join(run))
                run = []
    return out


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[at : at + PIECE] for at in range(0, len(word) - PIECE // 2, PIECE // 2)]


class Triples:
    """Places of all triples in a word of so many codes, with their weights."""

    _by_length: dict[int, Triples] = {}

    def __init__(self, n: int):
        spots = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
        self.spots = np.array(spots, np.int64).reshape(-1, 3)
        self.weights = DECAY ** (self.spots[:, 2] - self.spots[:, 0] - 2.0)
        self.norm = math.sqrt(float((self.weights**2).sum())) or 1.0

    @classmethod
    def of(cls, n: int) -> Triples:
        if n not in cls._by_length:
            cls._by_length[n] = cls(n)
        return cls._by_length[n]


_LETTERS: dict[str, int] = {}


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: (which, codes with start and end)."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        letters = "".join([words[k] for k in which])
        for c in set(letters).difference(_LETTERS):
            _LETTERS[c] = _code(c)
        inner = np.fromiter(map(_LETTERS.__getitem__, letters), np.int64, len(letters)).reshape(len(which), n)
        yield which, np.hstack([np.full((len(which), 1), 1), inner, np.full((len(which), 1), 2)])


def features(codes: np.ndarray) -> tuple[np.ndarray, Triples]:
    t = Triples.of(codes.shape[1])
    c = codes[:, t.spots]
    return (c[:, :, 0] * CODES + c[:, :, 1]) * CODES + c[:, :, 2], t


def kernel_columns(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words with landmarks, some landmarks at a time."""
    out = np.zeros((len(words), len(landmarks)))
    for begin in range(0, len(landmarks), 32):
        some = landmarks[begin : begin + 32]
        dense = np.zeros((CODES**3, len(some)), np.float32)
        for which, codes in coded(some):
            f, t = features(codes)
            for column, own in zip(which, f, strict=True):
                np.add.at(dense[:, column], own, t.weights / t.norm)
        for which, codes in coded(words):
            for at in range(0, len(which), 512):
                f, t = features(codes[at : at + 512])
                out[which[at : at + 512], begin : begin + len(some)] = np.einsum("wtl,t->wl", dense[f], t.weights / t.norm)
    return out


@dataclass
class Machine:
    """weights by triple, bias of a word, and the logistic function of what summary() says of a text."""

    weights: np.ndarray
    bias: float
    link: np.ndarray
    rate: float | None = None

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for which, codes in coded(words):
            for at in range(0, len(which), 1024):
                f, t = features(codes[at : at + 1024])
                out[which[at : at + 1024]] = self.weights[f] @ (t.weights / t.norm) + self.bias
        return out

    def score(self, summaries: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(summaries), self.rate)
        return sigmoid(summaries @ self.link)


#: Word values around which insults are counted, the count up to which more make no difference, and the number of words that a
#: short text counts as having.
LEVELS, MOST, SHORT = (0.3, 0.6, 0.85), 4.0, 8


def summary(values: np.ndarray) -> list[float]:
    """Soft counts of a text's words above each level, the logarithm of its number of words, and 1."""
    counts = [min(MOST, float(sigmoid(10 * (values - level)).sum())) for level in LEVELS]
    return [*counts, math.log1p(max(len(values), SHORT)), 1.0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """A linear machine by Newton steps; the last coordinate is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    loss = lambda w: float((weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (penalty * w * w).sum())
    now = loss(w)
    for _ in range(30):
        gap = 1 - y * (x @ w)
        active = gap > 0
        a = x[active] * weight[active, None]
        step = np.linalg.solve(a.T @ x[active] + np.diag(penalty), penalty * w - a.T @ (y[active] * gap[active]))
        size = 1.0
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic function, by Newton steps that never raise the loss."""
    w = np.zeros(x.shape[1])
    loss = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + ridge * (w @ w))
    now = loss(w)
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 2 * ridge * np.eye(len(w)), x.T @ (p - y) + 2 * ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * before:
            break
    return w


def train(texts: Iterable[str], labels: Iterable[int], seed: int = 17) -> Machine:
    """The machine of labelled texts: words are learnt on three quarters of them, the logistic function on the rest."""
    every = [sorted({p for u in units(t) for p in pieces(u)}) for t in texts]
    labels = np.array(list(labels), int)
    nothing = np.zeros(CODES**3, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Machine(nothing, 0.0, np.zeros(5), float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(labels), bool)
    for label in (0, 1):  # some of either label on both sides, where there are two
        own = rng.permutation(np.flatnonzero(labels == label))
        aside[own[: len(own) // 4]] = True
    bags, y = [b for b, x in zip(every, aside, strict=True) if not x], labels[~aside]
    good, bad = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        (bad if label else good).update(bag)
    n_bad, n_good = int(y.sum()), int(len(y) - y.sum())
    # words that are far more frequent in toxic texts, by log odds of their document frequencies
    odds = {w: math.log((n + 0.1) / (n_bad + 1)) - math.log((good[w] + 0.1) / (n_good + 1)) for w, n in bad.items()}
    telling = lambda w: odds[w] * math.sqrt(bad[w])
    marked = sorted((w for w in bad if bad[w] >= 2 and good[w] <= 0.02 * bad[w]), key=lambda w: (-telling(w), w))
    seeds = [w for w in marked if bad[w] >= max(3, n_bad // 150)] or marked[:20] or sorted(bad)[:20]
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0]))]
    calm = common[:NEGATIVES // 2]
    rest = common[NEGATIVES // 2 :]
    calm += [rest[k] for k in rng.permutation(len(rest))[: NEGATIVES // 2]]
    calm_landmarks = [calm[k] for k in rng.permutation(len(calm))[: LANDMARKS - LANDMARKS // 2]]
    landmarks = seeds[: LANDMARKS // 2] + calm_landmarks
    if not landmarks:  # no text has a word
        return Machine(nothing, 0.0, np.zeros(5), float(labels.mean()))
    k = kernel_columns(landmarks, landmarks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-4 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel columns times this are the Nyström features
    toxic_bags = [b for b, label in zip(bags, y, strict=True) if label]
    open_words = sorted({w for b in toxic_bags for w in b if good[w] == 0})
    spare = {w: n for n, w in enumerate(open_words)}
    x_open = kernel_columns(open_words, landmarks) @ root
    positive = [w for w in seeds]
    x_calm = kernel_columns(calm, landmarks) @ root
    hard: list[str] = []
    dense = lambda words: kernel_columns(words, landmarks) @ root
    for _ in range(ROUNDS):
        x_pos = dense(positive)
        x_neg = np.vstack([x_calm, dense(hard)]) if hard else x_calm
        x = np.vstack([x_pos, x_neg])
        side = np.concatenate([np.ones(len(x_pos)), -np.ones(len(x_neg))])
        share = np.where(side > 0, len(side) / (2 * max(1, len(x_pos))), len(side) / (2 * max(1, len(x_neg))))
        w, bias = squared_hinge(x, side, share)
        # each toxic text's highest word is an insult, if any of its words is near to one
        at = x_open @ w + bias
        chosen = set(seeds)
        for bag in toxic_bags:
            own = [spare[u] for u in bag if u in spare]
            if own:
                best = max(own, key=lambda n: at[n])
                if at[best] > 0:
                    chosen.add(open_words[best])
        positive = sorted(chosen)
        machine = Machine(_table(landmarks, root @ w), bias, np.zeros(5))
        known = sorted(good)
        hard = [known[n] for n in np.argsort(-machine.words(known))[: NEGATIVES // 4]]
    judged = np.flatnonzero(aside) if len(set(labels[aside])) == 2 else np.arange(len(labels))
    machine.link = logistic(np.array([summary(machine.words(every[k])) for k in judged]), labels[judged])
    return machine


def _table(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    out = np.zeros(CODES**3)
    for which, codes in coded(landmarks):
        f, t = features(codes)
        for row, own in zip(which, f, strict=True):
            np.add.at(out, own, alpha[row] * t.weights / t.norm)
    return out.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Machine:
    """Train on a bounded sample: of the label rows that teach (a condition on the column id) the first so many by hash, with
    texts of so many characters at most. Label rows that repeat count once, before
    the sample is taken; rows that repeat an id count once, with the first of their texts in order."""
    marks = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(teaches).distinct()
    marks = hash_sample(marks, [F.col("id"), F.col("y")], rows)
    texts = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text")).where(F.length("text") <= chars)
    got = texts.join(F.broadcast(marks), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r.id, r.y, r.text))
    return train([r.text for r in got], [int(r.y > 0) for r in got])


CACHED_WORDS = 150_000
_SCORED: tuple[str, dict[str, float]] = ("", {})


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, word): the score of every text and its most toxic word, null where there is no word. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shared, name = spark.sparkContext.broadcast(machine), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _SCORED
        machine = shared.value
        if _SCORED[0] != name:
            _SCORED = (name, {})
        known = _SCORED[1]
        for batch in batches:
            bags = [units(t) for t in batch.column(1).to_pylist()]
            if len(known) > CACHED_WORDS:
                known.clear()
            new = list(set().union(*bags).difference(known))
            parts = [p for w in new for p in pieces(w)]
            owner = [k for k, w in enumerate(new) for _ in pieces(w)]
            best = np.full(len(new), -np.inf)
            np.maximum.at(best, owner, machine.words(parts))
            known.update(zip(new, best.tolist(), strict=True))
            values = [np.fromiter(map(known.__getitem__, bag), float, len(bag)) for bag in bags]
            scores = machine.score(np.array([summary(v) for v in values]).reshape(len(bags), 5))
            words = [max(bag, key=lambda w: (known[w], w)) if bag else None for bag in bags]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(words, pa.string())], names=["id", "score", "word"])

    return rows.mapInArrow(released(run), f"id {id_type}, score double, word string")
