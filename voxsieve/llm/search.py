"""Ranked lexical search by MaxScore with bounds on pairs of terms.

A first pass over the documents counts them, their terms and the documents that hold each term of the queries. The second pass
makes an index of each shard (so many bytes of text): postings of the queries' terms with their impacts, the largest impact of
each term, and for chosen pairs of terms the list where both occur with the largest sum of their impacts. Terms of a query are
paired in order of their weight, before any shard is seen.

A document can't score more with a pair than the largest of the pair's joint maximum and the two terms' own maxima, which is
less than the sum of the two maxima wherever the rare terms of a pair don't meet. These bounds, one for each pair, are summed
from the smallest up; the pairs whose sum stays under the query's tenth score so far are passed over, and only documents with
a term of the other pairs are candidates. Passed-over pairs then add to the candidates, from the largest bound down, and those
that can't reach the tenth score any more are dropped at each step. The tenth score is carried from shard to shard of a
task, so later shards skip more. A ranking over the tasks' few survivors merges them. All scores are integers.

Queries lie in the shared folder in slices of bounded text, of which a task holds one at a time; documents aren't shuffled.

Defined results: null and empty texts have no terms and are neither counted nor found. Every query row is ranked for itself,
rows that repeat an id too, and so is every document row. Equal scores go by ascending document id, nulls last. A query
without terms, or with none that occurs, has no rows; with no documents there are none at all. Very long texts are shards of
their own and read whole. Columns besides ids and texts aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, bounded_batches, new_path, quoted, released, tell, told, written
from .words import ALPHANUMERIC, byte_table

#: Bytes of query text in a slice, but for a single longer query, and of document text in a shard, but for a single longer one.
SLICE_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Fixed values of the score.
SCALE, FLOOR, SLOPE, WEIGHT = 1_000_000_000, 10, 90, 1000

_TABLE = byte_table(ALPHANUMERIC)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Queries:
    """A slice of the queries: its vocabulary with weights, each query's terms, and the pairs that they make up.

    A query's units are rows of pairs: two term numbers, the second -1 where a term is left alone.
    """

    names: list[int]
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    pairs: np.ndarray
    units: list[np.ndarray]


def queries_of(numbers: list[int], words: list[bytes], weights: list[int]) -> Queries:
    """From rows (query, term, weight)."""
    vocabulary: dict[bytes, int] = {}
    by_query: dict[int, list[int]] = {}
    heavy: list[int] = []
    for q, word, w in zip(numbers, words, weights, strict=True):
        t = vocabulary.setdefault(word, len(vocabulary))
        if t == len(heavy):
            heavy.append(w)
        by_query.setdefault(q, []).append(t)
    known: dict[tuple[int, int], int] = {}
    units = []
    for own in by_query.values():
        own.sort(key=lambda t: (-heavy[t], t))
        units.append(np.array([known.setdefault((a, b), len(known)) for a, b in zip(own[::2], [*own[1::2], -1], strict=False)], np.int64))
    return Queries(list(by_query), vocabulary, np.array(heavy, np.int64), np.array(list(known), np.int64).reshape(-1, 2), units)


class Index:
    """A shard's postings of the vocabulary: for each term documents in ascending order with their impacts, and maxima.

    most is a term's largest impact; bound is for each pair the most that a document can have of it: the largest of both
    terms' maxima and of the sums on the pair's intersection list.
    """

    def __init__(self, texts: list[list[bytes]], queries: Queries, n_docs: int, n_terms: int):
        number, width = queries.vocabulary.get, len(queries.vocabulary)
        lengths, found = np.fromiter(map(len, texts), np.int64, len(texts)), []
        for d, words in enumerate(texts):
            own = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
            found.append(own[own >= 0] * len(texts) + d)
        at, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
        term, self.docs = np.divmod(at, max(1, len(texts)))
        m = FLOOR + (SLOPE * lengths * n_docs) // max(1, n_terms)
        self.impacts = queries.weights[term] * ((SCALE * times) // (1000 * times + 8 * m[self.docs])) if len(at) else np.empty(0, np.int64)
        self.first = np.searchsorted(term, np.arange(width + 1))
        self.most = np.zeros(width + 1, np.int64)  # the last is that of no term
        np.maximum.at(self.most, term, self.impacts)
        self.n, self.pairs = len(texts), queries.pairs
        self.bound = np.maximum(self.most[queries.pairs[:, 0]], self.most[queries.pairs[:, 1]])
        seen = np.zeros(len(texts), np.int64)
        held = -1
        for p in np.lexsort((queries.pairs[:, 1], queries.pairs[:, 0])).tolist():
            a, b = queries.pairs[p].tolist()
            if b < 0 or not self.most[a] or not self.most[b]:
                continue
            if a != held:
                seen[self.docs[self._of(held)]] = 0
                seen[self.docs[self._of(a)]] = self.impacts[self._of(a)]
                held = a
            both = seen[self.docs[self._of(b)]]
            joint = (both + self.impacts[self._of(b)])[both > 0]
            self.bound[p] = max(self.bound[p], int(joint.max(initial=0)))

    def _of(self, term: int) -> slice:
        return slice(self.first[term], self.first[term + 1]) if term >= 0 else slice(0, 0)

    def best(self, units: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, looked at): those with a score above 0 and of at least least, k or more where there are so many; ties all stay."""
        units = units[self.bound[units] > 0]
        units = units[np.argsort(self.bound[units], kind="stable")]
        reach = np.cumsum(self.bound[units])
        essential = int(np.searchsorted(reach, least, "left"))  # units before it can't make up least together
        score = np.zeros(self.n, np.int64)
        touched = []
        for u in units[essential:].tolist():
            for t in self.pairs[u].tolist():
                own = self._of(t)
                score[self.docs[own]] += self.impacts[own]
                touched.append(self.docs[own])
        candidates = np.unique(np.concatenate(touched)) if touched else np.empty(0, np.int64)
        looked = len(candidates)
        for u in range(essential - 1, -1, -1):
            candidates = candidates[score[candidates] + reach[u] >= least]
            if not len(candidates):
                break
            for t in self.pairs[units[u]].tolist():
                own = self.docs[self._of(t)]
                if len(own):
                    place = np.minimum(np.searchsorted(own, candidates), len(own) - 1)
                    hit = own[place] == candidates
                    score[candidates[hit]] += self.impacts[self._of(t)][place[hit]]
        scores = score[candidates]
        keep = (scores >= least) & (scores > 0)
        candidates, scores = candidates[keep], scores[keep]
        if len(scores) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            candidates, scores = candidates[keep], scores[keep]
        return candidates, scores, looked


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """Ids and the texts' terms, so many bytes of text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        begin = 0
        for k, text in enumerate(batch.column(1).to_pylist()):
            raw = (text or "").encode()
            texts.append(terms(raw))
            size += len(raw)
            if size >= SHARD_BYTES:
                ids.append(batch.column(0).slice(begin, k + 1 - begin))
                yield pa.concat_arrays(ids), texts
                ids, texts, size, begin = [], [], 0, k + 1
        ids.append(batch.column(0).slice(begin))
    if texts:
        yield pa.concat_arrays(ids), texts


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(number, item, term, size): the distinct terms of each query row, and the octets of its text."""
    rows = queries.select(F.monotonically_increasing_id().alias("number"), quoted(id_col).alias("item"), as_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = sorted(set(terms(text.encode())))
                for a in range(0, len(own), 10_000):
                    part = own[a : a + 10_000]
                    at = pa.array([k] * len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(part, pa.binary()), pa.array([len(text)] * len(part), pa.int64())], names=["number", "item", "term", "size"])

    return rows.mapInArrow(released(run), f"number long, item {rows.schema['item'].dataType.simpleString()}, term binary, size long")


def counted(docs: DataFrame, vocabulary_at: str, parts: int) -> DataFrame:
    """(term, df), and with term null the numbers of documents that have terms (df) and of all their terms (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words_in_all, df = 0, 0, {}
        for _, texts in _shards(batches):
            for part in range(parts):
                known = _vocabulary(vocabulary_at, part)
                for words in texts:
                    if part == 0:
                        total += bool(words)
                        words_in_all += len(words)
                    for w in known.intersection(words):
                        df[w] = df.get(w, 0) + 1
                if len(df) > 200_000:
                    yield _counts(df)
                    df = {}
        yield _counts(df)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([total], pa.int64()), pa.array([words_in_all], pa.int64())], names=["term", "df", "n"])

    return docs.mapInArrow(released(run), "term binary, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def _counts(df: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64()), pa.nulls(len(df), pa.int64())], names=["term", "df", "n"])


#: What a Python worker read last from the shared folder.
_LAST: dict = {}


def _vocabulary(at: str, part: int) -> frozenset[bytes]:
    if _LAST.get("vocabulary") != (at, part):
        table = told(at, part, ["term"])
        _LAST.clear()
        _LAST.update(vocabulary=(at, part), known=frozenset(table["term"].to_pylist() if table is not None else ()))
    return _LAST["known"]


def _slice(at: str, part: int) -> Queries:
    if _LAST.get("slice") != (at, part):
        table = told(at, part, ["number", "term", "weight"])
        rows = table.to_pydict() if table is not None else {"number": [], "term": [], "weight": []}
        _LAST.clear()
        _LAST.update(slice=(at, part), queries=queries_of(rows["number"], rows["term"], rows["weight"]))
    return _LAST["queries"]


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(number, item, rank, id, score): the k best documents of each query row; number tells query rows apart."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked, _ = written(_query_terms(queries, query_id_col, query_text_col), "search-queries")
    size = asked.groupBy("number").agg(F.first("size").alias("size")).agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-size // slice_bytes))
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    known_at, asked_at = new_path(spark, "search-terms"), new_path(spark, "search-slices")
    tell(asked.select("term").distinct().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")), known_at)
    counts, _ = written(counted(rows, known_at, parts), "search-counts")
    n_docs, n_terms = counts.where("term is null").select("df", "n").first() or (0, 0)
    logs = F.floor(F.lit(float(WEIGHT)) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    weighted = asked.join(counts.where("term is not null"), "term").select(F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int").alias("part"), "number", "term", logs.alias("weight"))
    tell(weighted, asked_at, "number", "term")
    id_type = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[list, list[int]]] = {}
        for ids, texts in _shards(batches):
            for part in range(parts):
                own = _slice(asked_at, part)
                index = Index(texts, own, n_docs, n_terms)
                for number, units in zip(own.names, own.units, strict=True):
                    held = best.get(number, ([], []))
                    least = min(held[1]) if len(held[1]) >= k else 1
                    found, scores, _ = index.best(units, k, least)
                    if len(found):
                        best[number] = _merged(held, (ids.take(pa.array(found)).to_pylist(), scores.tolist()), k)
        for number in best:
            own_ids, scores = best[number]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(scores), pa.int64()), pa.array(own_ids, ids.type), pa.array(scores, pa.int64())], names=["number", "id", "score"])

    found = rows.mapInArrow(released(run), f"number long, id {id_type.simpleString()}, score long")
    order = W.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.groupBy("number").agg(F.first("item").alias("item"))
    return ranked.join(names, "number").select("number", "item", "rank", "id", "score")


def _merged(a: tuple[list, list[int]], b: tuple[list, list[int]], k: int) -> tuple[list, list[int]]:
    """The k best of both, by score and then id, nulls last."""
    both = sorted(zip([*a[1], *b[1]], [*a[0], *b[0]], strict=True), key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k]
    return [i for _, i in both], [s for s, _ in both]
