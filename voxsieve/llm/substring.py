"""Substring dedup by difference-cover anchors.

Word windows of a length L are compared across documents. Hashes of shorter windows are taken only at the places of a
document that, modulo a period, lie in a difference cover: any two equal stretches of L words, wherever they start, have an
anchor at places that match. Anchors found in two documents are extended: all windows of L words around them are hashed, and
each learns the smallest id of a document that holds it.

The texts themselves are never shuffled. They are read three times in the same chunks (a chunk is a bounded stretch of one
partition's rows). Each pass emits for a chunk every hash once with the least and greatest id, so a hash that is in a third of
all documents still makes at most two rows a chunk; what the chunk must know for the next pass comes back as a table written by
chunk in the shared folder, of which a task reads its own part. A task that runs again reads the same part.

Defined results: null and empty texts have no words and lose none. Windows are judged on the input. A document without an id
neither loses words nor takes any from others. Rows that repeat an id are one document to each other: they don't take words
from each other. Windows that repeat inside one document only are kept. Columns besides id and text aren't read. Ids must be
whole numbers. Windows are compared by 128 bits of hashes of their words' 128-bit hashes; only chance could make different
ones agree. An input whose rows move from one reading to the next raises RuntimeError.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, bounded_batches, new_path, quoted, released, removed, tell, told
from .words import Words, window_hashes

LENGTH = 50
#: Bytes of text in a chunk, but for a single longer document.
CHUNK_BYTES = 8 << 20


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences give every residue, found greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda c: len(missing & ({(c - d) % period for d in cover} | {(d - c) % period for d in cover}))
        best = max((c for c in range(period) if c not in cover), key=gain)
        missing -= {(best - d) % period for d in cover} | {(d - best) % period for d in cover}
        cover.append(best)
    return sorted(cover)


#: The perfect difference set modulo 31; every residue is a difference of just one pair.
PERIOD, COVER = 31, [1, 5, 11, 24, 25, 27]


def plan(length: int) -> tuple[int, list[int], int]:
    """Period, cover and anchor length for windows of so many words; anchors lie wholly in any matching window."""
    if length >= PERIOD + 9:
        return PERIOD, COVER, length - PERIOD + 1
    period = max(1, length // 2)
    return period, difference_cover(period), length - period + 1


class Chunk:
    """Words of a chunk's texts with each word's document and place."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes]):
        self.words = Words(texts)
        counts = np.diff(self.words.first)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.place = np.arange(len(self.words)) - self.words.first[:-1][self.text] if len(texts) else np.empty(0, np.int64)
        self.left = counts[self.text] - self.place  # words from here to the end of the text
        self.id, self.known = ids[self.text], known[self.text]

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every anchor."""
        period, cover, size = plan(length)
        hashes = window_hashes(self.words.hashes[:, 0], size)
        at_cover = np.isin(np.arange(period), cover)
        at = np.flatnonzero((self.left[: len(hashes)] >= size) & at_cover[self.place[: len(hashes)] % period] & self.known[: len(hashes)])
        return at, hashes[at].view(np.int64)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, hash, second hash) of every full window."""
        hashes, second = (window_hashes(self.words.hashes[:, k], length) for k in (0, 1))
        at = np.flatnonzero((self.left[: len(hashes)] >= length) & self.known[: len(hashes)])
        return at, hashes[at].view(np.int64), second[at].view(np.int64)


class Lookup:
    """Membership in a set of 64-bit hashes: a bit table first, then bisection."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted
        self.table = np.zeros(1 << 22, bool)
        self.table[hashes & ((1 << 22) - 1)] = True

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of sought, where in hashes) of those that are there."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.table[sought & ((1 << 22) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, sought[maybe]), len(self.hashes) - 1)
        there = self.hashes[at] == sought[maybe]
        return maybe[there], at[there]


def _least_and_most(keys: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """Each distinct key with its smallest id, and again with its greatest if that differs."""
    order = np.lexsort((ids, *reversed(keys)))
    keys, ids = [k[order] for k in keys], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    last = last[ids[last] != ids[first]] if len(ids) else first
    pick = np.concatenate([first, last])
    return [*(k[pick] for k in keys), ids[pick]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """(chunk, ids, texts); batches have the columns partition, id, text. Chunks depend on the rows' order and sizes alone."""
    n, held, texts, size, part = 0, [], [], 0, 0
    for batch in batches:
        part, begin = batch.column(0)[0].as_py() if len(batch) else part, 0
        for k, text in enumerate(batch.column(2).to_pylist()):
            raw = text.encode()
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                held.append(batch.column(1).slice(begin, k + 1 - begin))
                yield (part << 24) + n, pa.concat_arrays(held), texts
                n, held, texts, size, begin = n + 1, [], [], 0, k + 1
        if begin < len(batch):
            held.append(batch.column(1).slice(begin))
    if texts:
        yield (part << 24) + n, pa.concat_arrays(held), texts


def _open(ids: pa.Array, texts: list[bytes]) -> Chunk:
    return Chunk(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), texts)


def _signature(chunk: int, ids: pa.Array, texts: list[bytes]) -> int:
    """Tells whether a chunk is read again as before."""
    h = xxhash.xxh3_64(repr((chunk, ids.to_pylist(), [len(t) for t in texts])).encode())
    for t in texts:
        h.update(t)
    return h.intdigest() - (1 << 63)


def _told(at: str, chunk: int, signature: int, columns: list[str]) -> list[np.ndarray]:
    """A chunk's rows of what its part was told, its signature put to the test."""
    table = told(at, chunk >> 24, ["signs", *columns], [("chunk", "=", chunk)])
    signs = table["signs"].to_numpy() if table is not None else np.empty(0, bool)
    if [int(x) for x in table["h"].to_numpy()[signs]] != [signature] if len(signs) else True:
        raise RuntimeError("the documents read differently than before: pass a table, not a plan whose rows move")
    return [table[c].to_numpy()[~signs] for c in columns]


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _by_chunk(rows: DataFrame, at: str, *columns: str) -> None:
    """Write what each chunk is told: a folder for each partition, in order of its chunks, in small row groups."""
    tell(rows.select(F.shiftright("chunk", 24).alias("part"), "chunk", F.col("id").isNull().alias("signs"), *columns).distinct(), at, "chunk")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept, starts, ends): kept are the words that stay, joined by single spaces; starts and ends are
    the stretches of words removed.

    docs must read alike each time, as a table does.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.select(quoted(id_col).alias("id")).schema["id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError("substring dedup needs whole-number ids")
    rows = docs.select(F.spark_partition_id().alias("part"), quoted(id_col).cast("long").alias("id"), as_text(text_col).alias("text"))
    shared_anchors, shared_windows = new_path(spark, "anchors"), new_path(spark, "windows")

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in _chunks(batches):
            c = _open(ids, texts)
            at, h = c.anchors(length)
            h, lo = _least_and_most([h], c.id[at])
            yield _batch([h, np.full(len(h), chunk), lo], ["h", "chunk", "id"])
            yield _batch([np.array([_signature(chunk, ids, texts)]), np.array([chunk]), [None]], ["h", "chunk", "id"])

    anchors = rows.mapInArrow(released(find_anchors), "h long, chunk long, id long")
    over = W.partitionBy("h")
    anchors = anchors.select("h", "chunk", "id", F.min("id").over(over).alias("lo"), F.max("id").over(over).alias("hi")).where("lo < hi or id is null").select("h", "chunk", "id")
    _by_chunk(anchors, shared_anchors, "h")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in _chunks(batches):
            c = _open(ids, texts)
            (known,) = _told(shared_anchors, chunk, _signature(chunk, ids, texts), ["h"])
            at, h = c.anchors(length)
            hit = at[Lookup(np.sort(known)).find(h)[0]]
            # windows that hold a shared anchor start at most so many words before it
            edges = np.zeros(len(c.words) + 1, np.int64)
            back = np.minimum(c.place[hit], length - plan(length)[2])
            np.add.at(edges, hit - back, 1)
            np.add.at(edges, hit + 1, -1)
            near = np.cumsum(edges)[:-1] > 0
            at, h, v = c.windows(length)
            keep = near[at]
            h, v, lo = _least_and_most([h[keep], v[keep]], c.id[at[keep]])
            yield _batch([h, v, np.full(len(h), chunk), lo], ["h", "v", "chunk", "id"])
            yield _batch([np.array([_signature(chunk, ids, texts)]), np.array([0]), np.array([chunk]), [None]], ["h", "v", "chunk", "id"])

    windows = rows.mapInArrow(released(extend), "h long, v long, chunk long, id long")
    over = W.partitionBy("h", "v")
    windows = windows.select("h", "v", "chunk", "id", F.coalesce(F.min("id").over(over), F.lit(0)).alias("lo")).where("lo < id or id is null")
    _by_chunk(windows, shared_windows, "h", "v", "lo")
    removed(spark, shared_anchors)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in _chunks(batches):
            c = _open(ids, texts)
            h, v, lo = _told(shared_windows, chunk, _signature(chunk, ids, texts), ["h", "v", "lo"])
            gone = _covered(c, length, h, v, lo)
            n_words, n_removed, kept, starts, ends = [], [], [], [], []
            for k, text in enumerate(texts):
                a, b = c.words.first[k], c.words.first[k + 1]
                mask = gone[a:b]
                n = int(mask.sum())
                n_words.append(int(b - a))
                n_removed.append(n)
                own = text.split()
                kept.append(b" ".join(compress(own, ~mask) if n else own))
                edge = np.diff(mask.astype(np.int8), prepend=0, append=0) if n else np.empty(0, np.int8)
                starts.append(np.flatnonzero(edge == 1))
                ends.append(np.flatnonzero(edge == -1))
            for at in range(0, len(texts), 1000):
                s = slice(at, at + 1000)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids[s], pa.array(n_words[s], pa.int64()), pa.array(n_removed[s], pa.int64()), pa.array(kept[s], pa.binary()).cast(pa.string()), pa.array(starts[s], longs), pa.array(ends[s], longs)],
                    names=["id", "n_words", "n_removed", "kept", "starts", "ends"],
                )

    return rows.mapInArrow(released(cut), "id long, n_words long, n_removed long, kept string, starts array<long>, ends array<long>")


def _covered(c: Chunk, length: int, h: np.ndarray, v: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which words lie in a window that a document with a smaller id holds too."""
    order = np.lexsort((lo, v, h))
    h, v, lo = h[order], v[order], lo[order]
    at, sought, second = c.windows(length)
    which, where = Lookup(h).find(sought)
    taken = np.zeros(len(at), bool)
    while len(which):  # one round, but for different windows of equal first hash
        same = v[where] == second[which]
        taken[which[same]] = lo[where[same]] < c.id[at[which[same]]]
        which, where = which[~same], where[~same] + 1
        inside = where < len(h)
        which, where = which[inside], where[inside]
        more = h[where] == sought[which]
        which, where = which[more], where[more]
    edges = np.zeros(len(c.words) + 1, np.int64)
    start = at[taken]
    edges[start] += 1
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges)[:-1] > 0
