"""Document quality by nearest-neighbour voting over latent-semantic vectors.

A text is described by its words, the characters that words begin and end with, and how words are formed and repeated: shapes
and tails of words, repeats of the last word, of lines and of words in all. Term counts, damped and weighted by how rare a term is in the fit sample, are reduced by a truncated
singular value decomposition of the labelled sample. The labelled vectors are broadcast (their number is bounded), every
document's cosines with all of them are computed exactly, block by block, and the nearest ones vote with weights that grow
with the cosine.

Defined results: null and empty texts are described by a term of their own and scored like any other; ties among neighbours
at the last place go to the earlier label row by hash. Any text is read whole. Repeated rows score alike. Label rows without
a document or a label teach nothing; without any teaching row every score is 0.5. Columns besides id and text aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, bounded_batches, hash_sample, quoted, released, through

#: Labelled rows that vote, taken by hash, and the characters up to which a text may be one of them.
FIT_ROWS, FIT_CHARS = 4000, 30_000
#: Hashed terms, latent dimensions, voting neighbours, and the power of the cosine that is a neighbour's weight.
TERMS, LATENT, NEIGHBOURS, POWER = 8192, 48, 25, 8
#: From which term on words and characters are hashed; form and words are shares of their own sums.
LEXICAL = 4096
#: Characters up to which a word has one shape; longer words have one for every piece of so many.
PIECE = 64

_RUNS = re.compile(r"(.)\1+")
_KINDS: dict[str, str] = {}


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other signs themselves; runs are shortened."""
    if word.isalpha():  # most words
        if word.islower():
            return "a"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    for c in set(word).difference(_KINDS):
        _KINDS[c] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    return _RUNS.sub(r"\1", "".join(map(_KINDS.__getitem__, word)))


def _term(name: str) -> int:
    return xxhash.xxh32_intdigest(name, 7) % LEXICAL


def _lexical(name: str) -> int:
    return LEXICAL + xxhash.xxh32_intdigest(name, 11) % (TERMS - LEXICAL)


class _Terms(dict):
    """Terms by name, worked out once for the rest of a task."""

    def __init__(self, of: Callable[[str], int | tuple[int, ...]]):
        self.of = of

    def __missing__(self, name: str) -> int | tuple[int, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        got = self[name] = self.of(name)
        return got


#: Names of each kind whose terms are kept.
KNOWN_WORDS = 100_000
_SHAPES = _Terms(lambda s: _term("shape " + s))
_HEADS = _Terms(lambda s: _lexical("<" + s))
_LASTS = _Terms(lambda s: _lexical(s + ">"))
_TAILS = _Terms(lambda s: _term("tail " + shape(s)))
_LENGTHS = [_term(f"length {n}") for n in range(21)]


def _ends(word: str) -> tuple[int, ...]:
    """Terms of a word of any length besides its shape: the word, its first and last characters, its tail's shape and its length."""
    return _lexical(word), _HEADS[word[:3]], _LASTS[word[-3:]], _TAILS[word[-2:]], _LENGTHS[min(len(word), 20)]


_WORD_TERMS = _Terms(lambda word: (_SHAPES[shape(word)], *_ends(word)))


def _level(share: float) -> int:
    return min(9, int(10 * share))


def terms(text: str) -> np.ndarray:
    """Counts of the hashed terms of a text."""
    words = text.split()
    if not words:
        out = np.zeros(TERMS)
        out[_term("no words")] = 1
        return out
    counts = Counter(words)
    short = {w: k for w, k in counts.items() if len(w) <= PIECE} if max(map(len, counts)) > PIECE else counts
    numbers = np.fromiter(chain.from_iterable(map(_WORD_TERMS.__getitem__, short)), np.int64, 6 * len(short))
    out = np.bincount(numbers, np.repeat(np.fromiter(short.values(), float, len(short)), 6), TERMS).astype(float)
    for w in counts.keys() - short.keys() if len(short) < len(counts) else ():
        for at in range(0, len(w), PIECE):
            piece = w[at : at + PIECE]
            out[_term(f"shape {shape(piece)}~")] += counts[w] * len(piece) / PIECE
        for term in _ends(w):
            out[term] += counts[w]
    n, after = len(words), words[1:]
    lines = text.split("\n")
    facts = {
        "word again": sum(map(eq, words, after)) / n,
        "words differ": len(counts) / n,
        "pairs differ": (len(set(zip(words, after, strict=False))) + 1) / n,
        "lines differ": len(set(lines)) / len(lines),
        "top word": max(counts.values()) / n,
    }
    for name, share in facts.items():
        out[_term(f"{name} {_level(share)}")] += max(4, n // 4)
    out[_term(f"size {int(math.log2(n))}")] += max(2, n // 16)
    return out


def matrix(texts: Sequence[str]) -> np.ndarray:
    """Damped shares of the terms, text by term."""
    out = np.empty((len(texts), TERMS), np.float32)
    for k, text in enumerate(texts):
        out[k] = terms(text)
    form, words = out[:, :LEXICAL], out[:, LEXICAL:]
    form *= 100 / np.maximum(1, form.sum(1, keepdims=True))
    words *= 100 / np.maximum(1, words.sum(1, keepdims=True))
    np.log1p(out, out=out)
    return out


@dataclass
class Voters:
    """Weights of the terms, the projection to latent dimensions, and the labelled vectors with their labels."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def unit(z: np.ndarray) -> np.ndarray:
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def project(self, shares: np.ndarray) -> np.ndarray:
        return self.unit((shares * self.weights) @ self.projection)

    def vote(self, texts: list[str], block: int = 256) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors."""
        out = np.full(len(texts), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for at in range(0, len(texts), block):
            cosines = self.project(matrix(texts[at : at + block])) @ self.vectors.T
            near = np.argsort(-cosines, axis=1, kind="stable")[:, :k] if len(self.labels) <= 2 * k else self._nearest(cosines, k)
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0.01).astype(np.float64) ** POWER
            out[at : at + block] = np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1)
        return out

    @staticmethod
    def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
        """Columns of the k highest values of each row; of equal values at the last place the first columns."""
        least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1]
        rank = np.where(cosines > least[:, None], 2, np.where(cosines == least[:, None], 1, 0)).astype(np.int8)
        out = np.empty((len(cosines), k), np.int64)
        for row, own in enumerate(rank):
            above = np.flatnonzero(own == 2)
            out[row] = np.concatenate([above, np.flatnonzero(own == 1)[: k - len(above)]])
        return out


def leading(x: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration."""
    q = np.linalg.qr(x.T @ np.random.default_rng(3).normal(size=(len(x), min(dimensions + 16, *x.shape))).astype(x.dtype))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    small = x @ q
    values, v = np.linalg.eigh((small.T @ small).astype(np.float64))
    top = v[:, ::-1][:, :dimensions][:, values[::-1][:dimensions] > 1e-9 * max(values[-1], 1e-9)]
    return q @ top


def train(texts: list[str], labels: list[int]) -> Voters:
    shares = matrix(texts)
    weights = np.log((1 + len(texts)) / (1 + np.count_nonzero(shares, axis=0))).astype(np.float32) + 0.3
    shares *= weights
    projection = np.zeros((TERMS, LATENT), np.float32)
    if len(texts):
        top = leading(shares, LATENT)
        projection[:, : top.shape[1]] = top
    voters = Voters(weights, projection, np.empty((0, LATENT), np.float32), np.array(labels, float))
    voters.vectors = voters.unit(shares @ projection)
    return voters


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Voters:
    """Fit on a bounded sample: of the label rows that teach (a condition on the column id) the first so many by hash, with
    texts of so many characters at most. Label rows that repeat count once, before
    the sample is taken; rows that repeat an id count once, with the first of their texts in order."""
    marks = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(teaches).distinct()
    marks = hash_sample(marks, [F.col("id"), F.col("y")], rows)
    texts = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text")).where(F.length("text") <= chars)
    got = texts.join(F.broadcast(marks), "id").groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("id")).collect()
    got.sort(key=lambda r: (r.h, r.y, r.text))
    return train([r.text for r in got], [int(r.y > 0) for r in got])


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the score of every text. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.vote(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])
        _WORD_TERMS.clear()

    return rows.mapInArrow(released(run), f"id {id_type}, score double")


def keep(docs: DataFrame, voters: Voters, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts score at least so much. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, at = spark.sparkContext.broadcast(voters), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.vote([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores >= least))
        _WORD_TERMS.clear()

    return through(docs, run)
