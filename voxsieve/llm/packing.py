"""Token-id output: documents packed into fixed-length rows and written as binary matrices.

The operator takes its ids from a library's coder, as its work is the packing; the package's own coder is in bpe.py.

Each task encodes its own rows and packs them pool by pool, so nothing is shuffled and memory is bounded by the pool. In a
pool, documents longer than a row are split without loss, then the pieces are placed best-fit-decreasing: a segment tree
over the free space finds the fullest row that still takes a piece. Each pool becomes one .npz file with the id matrix, the
cumulative segment lengths of each row and the places where positions start anew at 0. A file's name follows from the task's
partition and is moved into place when complete, so a task that runs again after a loss replaces it by an equal one.

Defined results: a null or empty text has no ids and no piece; repeated rows are packed as often as they occur; an empty
table gives no file. Ties among pieces of equal length keep the order of the rows. A text of any length is read whole and split
into as many pieces as it needs. Other columns aren't read, so their names clash with nothing.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, bounded_batches, quoted, released

ROW_TOKENS, POOL_TOKENS = 2048, 4 << 20


#: Fixed value: the public pattern that splits text before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CODERS: dict[str, tiktoken.Encoding] = {}


def rank_coder(path: str) -> tiktoken.Encoding:
    """The library's coder of a file of ranks, built once per Python worker."""
    if path not in _CODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _CODERS[path] = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


class FreeSpace:
    """A segment tree over 0..capacity that counts the rows with just so much free space."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, space: int, n: int) -> None:
        k = self.leaves + space
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, space: int) -> int:
        """The smallest free space of at least so much that some row has, or -1."""
        count, k = self.count, self.leaves + space
        if count[k]:
            return space
        while k > 1 and (k & 1 or not count[k + 1]):  # up until a filled subtree lies to the right
            k >>= 1
        if k <= 1:
            return -1
        k += 1
        while k < self.leaves:
            k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers; every length must be from 1 to capacity."""
    tree, by_space, rows = FreeSpace(capacity), {}, []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[piece]
        space = tree.least(need)
        if space < 0:
            row, space = len(rows), capacity
            rows.append([])
        else:
            row = by_space[space].pop()
            tree.add(space, -1)
        rows[row].append(piece)
        if space > need:
            by_space.setdefault(space - need, []).append(row)
            tree.add(space - need, 1)
    return rows


def pack_pool(texts_ids: list[np.ndarray], capacity: int, dtype: str, pad: int) -> dict[str, np.ndarray]:
    """Arrays of one pool: ids (rows x capacity), piece_doc, piece_start, cu_seqlens, row_splits (into cu_seqlens) and resets."""
    pieces = [(k, at, min(capacity, len(ids) - at)) for k, ids in enumerate(texts_ids) for at in range(0, len(ids), capacity)]
    rows = best_fit_decreasing([n for _, _, n in pieces], capacity)
    matrix = np.full((len(rows), capacity), pad, dtype)
    docs, starts, ends, splits, resets = [], [], [], [0], []
    for r, row in enumerate(rows):
        at = 0
        ends.append(0)
        for p in row:
            k, start, n = pieces[p]
            matrix[r, at : at + n] = texts_ids[k][start : start + n]
            docs.append(k)
            starts.append(start)
            resets.append(r * capacity + at)
            at += n
            ends.append(at)
        splits.append(len(ends))
    as64 = lambda x: np.array(x, np.int64)
    return {"ids": matrix, "piece_doc": as64(docs), "piece_start": as64(starts), "cu_seqlens": np.array(ends, np.int32), "row_splits": as64(splits), "resets": as64(resets)}


def write_packed(docs: DataFrame, vocabulary: str, out: str, row_tokens: int = ROW_TOKENS, pool_tokens: int = POOL_TOKENS, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with a file of ranks, pack and write; returns one row per file (file, n_rows, n_tokens), to be written or counted once."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    if not isinstance(rows.schema["id"].dataType, T.IntegralType):
        rows = rows.withColumn("id", F.col("id").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_coder(vocabulary)
        dtype = "<u2" if bpe.n_vocab <= 1 << 16 else "<u4"
        store, base = pafs.FileSystem.from_uri(out)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        state: dict = {"ids": [], "of": [], "tokens": 0, "n": 0}

        def flush() -> pa.RecordBatch:
            arrays = pack_pool(state["of"], row_tokens, dtype, pad)
            absent = np.array([i is None for i in state["ids"]], bool)
            names = np.array([("" if isinstance(state["ids"][0], str) else 0) if i is None else i for i in state["ids"]])
            buffer = io.BytesIO()
            np.savez(buffer, doc_ids=names, doc_absent=absent, **arrays)
            file = f"pack-{task.partitionId():06d}-{state['n']:06d}.npz"
            with store.open_output_stream(f"{base}/.{file}.{task.taskAttemptId()}") as f:
                f.write(buffer.getbuffer())
            store.move(f"{base}/.{file}.{task.taskAttemptId()}", f"{base}/{file}")
            report = [[file], [len(arrays["ids"])], [state["tokens"]]]
            state.update(ids=[], of=[], tokens=0, n=state["n"] + 1)
            return pa.RecordBatch.from_arrays([pa.array(report[0], pa.string()), pa.array(report[1], pa.int64()), pa.array(report[2], pa.int64())], names=["file", "n_rows", "n_tokens"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(bpe.encode_ordinary(text), np.uint32)
                if len(ids):
                    state["ids"].append(i)
                    state["of"].append(ids)
                    state["tokens"] += len(ids)
                    if state["tokens"] >= pool_tokens:
                        yield flush()
        if state["of"]:
            yield flush()

    return rows.mapInArrow(released(run), "file string, n_rows long, n_tokens long")


def read_packed(spark: SparkSession, out: str) -> DataFrame:
    """One row per packed row: file, row, ids (binary, unpadded, 32-bit little-endian), doc_ids as strings, starts, cu_seqlens, positions reset at resets."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pack-*.npz").load(out).select("path", "content")
    shape = "file string, row long, ids binary, doc_ids array<string>, starts array<long>, cu_seqlens array<int>, resets array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = np.load(io.BytesIO(memoryview(content.as_buffer())))
                ids, ends, splits, piece_doc, starts, resets = (z[k] for k in ("ids", "cu_seqlens", "row_splits", "piece_doc", "piece_start", "resets"))
                names = [None if gone else str(i) for i, gone in zip(z["doc_ids"].tolist(), z["doc_absent"].tolist(), strict=True)]
                file, capacity = path.rsplit("/", 1)[-1], ids.shape[1]
                columns: list[list] = [[] for _ in range(7)]
                piece = 0
                for r in range(len(ids)):
                    cu = ends[splits[r] : splits[r + 1]]
                    n = len(cu) - 1
                    own = slice(piece, piece + n)
                    for c, v in zip(columns, (file, r, ids[r, : cu[-1]].astype("<u4").tobytes(), [names[k] for k in piece_doc[own]], starts[own].tolist(), cu.tolist(), (resets[own] - r * capacity).tolist()), strict=True):
                        c.append(v)
                    piece += n
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "row", "ids", "doc_ids", "starts", "cu_seqlens", "resets"])

    return files.mapInArrow(released(run), shape)
