"""Benchmark decontamination with suffix arrays over the training text.

The documents of a batch form a shard, whose words make one text; the suffix array is over all of it, in order of the words
from each place on, as deep as a window reaches. Words are numbered by the shard's vocabulary, so words are compared as they
are, not by hashes, and a shard is sorted once. The window from every word of every benchmark item, but for those with words that
the shard hasn't, is searched by bisection, which gives all its occurrences; occurrences of successive windows at successive
words make up the longest verbatim matches. Shards are independent, so nothing of the documents is shuffled.

A window is so many consecutive words of an item; an item with fewer words, but not none, is one window. Words of a document
inside an occurrence of a window are hit. The benchmark lies in the shared folder in slices of bounded text, already as words (an
item is never divided). A task holds one slice at a time and goes through all for each of its shards, so documents are read once
whatever the benchmark's size. Windows are searched in blocks.

Defined results: texts are read whole, a text longer than a shard's bound being a shard of its own. Null and empty texts have no
words; a document without words is never contaminated. Repeated documents are judged alike and kept apart; repeated items count
once by their id; items without an id hit words but aren't listed. With no benchmark nothing is hit; tables without rows give
none. Every occurrence counts, so there are no ties. Columns besides id and text aren't read by find_hits and pass through
remove_contaminated unchanged, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, bounded_batches, new_path, quoted, released, through
from .words import ALPHANUMERIC, byte_table

WINDOW = 13
#: Bytes of benchmark text in a slice, but for a single longer item.
SLICE_BYTES = 8 << 20
#: Bytes of document text that make a shard, but for a single longer document, and windows searched at once.
SHARD_BYTES, SEARCHED = 4 << 20, 1 << 15
#: Times that much make a shard at most, where the benchmark has several slices.
SHARDS_MOST = 4

_TABLE = byte_table(ALPHANUMERIC)


class Benchmark:
    """One slice of the benchmark: its distinct words, its words as places among them, and its windows.

    Windows are numbered over all distinct texts; begin, size, offset and part are a window's first word, number of words, place in
    its text and text; items_of has the names of the items with each text, None for those without.
    """

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        named: dict[bytes, set[str | None]] = {}
        for i, t in zip(ids, texts, strict=True):
            named.setdefault(b" ".join(t.encode().translate(_TABLE).split()), set()).add(i)
        named.pop(b"", None)
        place = defaultdict(count().__next__)
        words = [_numbers(t.split(), place) for t in named]
        items_of = [sorted(n, key=lambda i: (i is None, i or "")) for n in named.values()]
        self._lay_out(list(place), np.concatenate([*words, np.empty(0, np.int32)]), np.array([len(w) for w in words], np.int64), items_of, window)

    def _lay_out(self, vocabulary: list[bytes], numbers: np.ndarray, counts: np.ndarray, items_of: list[list[str | None]], window: int) -> None:
        self.vocabulary, self.numbers, self.counts, self.items_of = vocabulary, numbers, counts, items_of
        sizes = np.minimum(window, counts)
        n = counts - sizes + 1
        self.part = np.repeat(np.arange(len(counts)), n)
        self.offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.size = sizes[self.part]
        self.begin = (np.cumsum(counts) - counts)[self.part] + self.offset

    def row(self) -> dict:
        """What read() makes the slice from: no text is split again."""
        return {"vocabulary": b" ".join(self.vocabulary), "numbers": self.numbers.tobytes(), "counts": self.counts.tobytes(), "items": self.items_of}

    @classmethod
    def read(cls, row: dict, window: int) -> Benchmark:
        own = cls.__new__(cls)
        own._lay_out(row["vocabulary"].split(), np.frombuffer(row["numbers"], np.int32), np.frombuffer(row["counts"], np.int64), row["items"], window)
        return own


class Shard:
    """A shard's words as numbers with their suffix array. first: for each text its first word's place; a 0 closes each text.

    Words are numbered from 1 by the shard's own vocabulary, so that one sorting serves all slices of the benchmark. Where known
    has all words of the benchmark, others are 0 and match nothing, which is less to number and to sort.
    """

    def __init__(self, texts: list[bytes], depth: int, known: Iterable[bytes] | None = None):
        number, end = defaultdict(count(1).__next__), np.zeros(1, np.int32)
        found, counts = [], np.empty(len(texts), np.int64)
        if known is not None:
            number = dict(zip(known, count(1)))
        for k, t in enumerate(texts):
            words = t.translate(_TABLE).split()
            counts[k] = len(words)
            found += [_numbers(words, number) if known is None else np.fromiter(map(number.get, words, repeat(0)), np.int32, len(words)), end]
        self.vocabulary, self.counts, self.depth = dict(number), counts, depth
        self.first = np.cumsum(counts + 1) - (counts + 1)
        text = np.concatenate(found) if found else end
        self.bits = max(1, len(number).bit_length())
        #: Words that one 64-bit key holds.
        self.packed = min(63 // self.bits, depth)
        # the words from each place on, so many in a key
        self.key = np.zeros(len(text), np.int64)
        for k in range(self.packed):
            self.key <<= self.bits  # beyond the end stand zeros
            self.key[: max(0, len(text) - k)] |= text[k:]
        self.order = suffix_array(self.key, self.packed, depth)
        self.sorted = self.key[self.order]

    def words(self, bench: Benchmark) -> np.ndarray:
        """The slice's words as the shard numbers them, 0 for those that it hasn't."""
        return np.fromiter(map(self.vocabulary.get, bench.vocabulary, repeat(0)), np.int32, len(bench.vocabulary))[bench.numbers]

    def _keys(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest key that the group-th so many words of each of these windows can stand for."""
        low = np.zeros(len(begin), np.int64)
        high = low.copy()
        for k in range(group * self.packed, (group + 1) * self.packed):
            inside = k < size
            word = np.where(inside, words[np.minimum(begin + k, len(words) - 1)], 0)
            low = (low << self.bits) | word
            high = (high << self.bits) | np.where(inside, word, (1 << self.bits) - 1)
        return low, high

    def search(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the suffix array each of these windows of words begins and ends to be what suffixes begin with."""
        least, most = self._keys(words, begin, size, 0)
        low, high = np.searchsorted(self.sorted, least, "left"), np.searchsorted(self.sorted, most, "right")
        for group in range(1, -(-self.depth // self.packed)):
            k = np.flatnonzero((low < high) & (size > group * self.packed))
            if not len(k):
                break
            least, most = self._keys(words, begin[k], size[k], group)
            first = self._bisect(low[k], high[k], least, group * self.packed, False)
            low[k], high[k] = first, self._bisect(first, high[k], most, group * self.packed, True)
        return low, high

    def _bisect(self, low: np.ndarray, high: np.ndarray, sought: np.ndarray, ahead: int, beyond: bool) -> np.ndarray:
        """Between low and high the first suffix whose key so many words ahead isn't less than sought (beyond: is greater)."""
        low, high = low.copy(), high.copy()
        while len(k := np.flatnonzero(low < high)):
            middle = (low[k] + high[k]) // 2
            place = self.order[middle] + ahead
            there = np.where(place < len(self.key), self.key[np.minimum(place, len(self.key) - 1)], 0)
            before = there <= sought[k] if beyond else there < sought[k]
            low[k[before]] = middle[before] + 1
            high[k[~before]] = middle[~before]
        return low


def _numbers(words: list[bytes], number: defaultdict) -> np.ndarray:
    """Words as numbers; number gives each new word the next one."""
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def suffix_array(key: np.ndarray, span: int, depth: int) -> np.ndarray:
    """Places in order of the words from there on, so many deep at least. key has the order of the first span words.

    By doubling: each round sorts on twice as many words as the last, until all places differ or the depth is reached.
    """
    n = len(key)
    order = np.argsort(key)
    while span < depth:
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: max(0, n - span)] += rank[span:] + 1
        order = np.argsort(key)
        span *= 2
    return order


def occurrences(shard: Shard, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence of every window in a shard. Windows with words that the shard hasn't need no search."""
    words, places, windows = shard.words(bench), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    lacking = np.append(0, np.cumsum(words == 0))
    able = np.flatnonzero(lacking[bench.begin + bench.size] == lacking[bench.begin])
    for at in range(0, len(able), SEARCHED):
        which = able[at : at + SEARCHED]
        low, high = shard.search(words, bench.begin[which], bench.size[which])
        n = np.maximum(high - low, 0)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        places.append(shard.order[np.repeat(low, n) + nth])
        windows.append(np.repeat(which, n))
    return np.concatenate(places), np.concatenate(windows)


def longest_matches(shard: Shard, bench: Benchmark, at: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Rows (document, word, benchmark text, its word, length): the maximal verbatim matches that the occurrences make up.

    Occurrences of a text's successive windows at successive words are one longer match.
    """
    if not len(at):
        return np.empty((0, 5), np.int64)
    offset, part = bench.offset[window], bench.part[window]
    order = np.lexsort((at, at - offset, part))
    at, offset, part = at[order], offset[order], part[order]
    opens = np.ones(len(at), bool)
    opens[1:] = (np.diff(part) != 0) | (np.diff(at - offset) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at)) - 1
    document = np.searchsorted(shard.first, at[first], "right") - 1
    length = at[last] - at[first] + bench.size[window[order][last]]
    return np.stack([document, at[first] - shard.first[document], part[first], offset[first], length], 1)


def texts_found(shard: Shard, bench: Benchmark, at: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Distinct rows (document, benchmark text) of the occurrences."""
    document = np.searchsorted(shard.first, at, "right") - 1
    both = np.unique(document * len(bench.items_of) + bench.part[window])
    return np.stack(np.divmod(both, max(1, len(bench.items_of))), 1)


def hit_places(shard: Shard, bench: Benchmark, at: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Which places of the shard lie in an occurrence."""
    n = len(shard.key) + 1
    cover = np.bincount(at, minlength=n) - np.bincount(at + bench.size[window], minlength=n)
    return np.cumsum(cover)[:-1] > 0


def _shards(batches: Iterator[pa.RecordBatch], text_at: int, shard_bytes: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """One shard after another: its rows, and their texts as bytes."""
    held, texts, size = [], [], 0
    for batch in batches:
        begin = 0
        for k, text in enumerate(batch.column(text_at).to_pylist()):
            raw = (text or "").encode()
            texts.append(raw)
            size += len(raw)
            if size >= shard_bytes:
                held.append(batch.slice(begin, k + 1 - begin))
                yield pa.Table.from_batches(held), texts
                held, texts, size, begin = [], [], 0, k + 1
        if begin < len(batch):
            held.append(batch.slice(begin))
    if texts:
        yield pa.Table.from_batches(held), texts


class Slices:
    """The benchmark's slices in the shared folder, split into words once. A Python worker keeps the one that it read last.

    Shards are larger where there are several slices, within a bound, so that each is read for more text.
    """

    def __init__(self, items: DataFrame, window: int, slice_bytes: int):
        items = items.distinct()
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.at, self.parts, self.window = new_path(items.sparkSession, "benchmark"), max(1, -(-size // slice_bytes)), window
        self.shard_bytes = SHARD_BYTES * min(self.parts, SHARDS_MOST)
        dealt = items.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(self.parts)))

        def split(key: tuple, rows: pa.Table) -> pa.Table:
            own = Benchmark(rows["id"].to_pylist(), rows["text"].to_pylist(), window).row()
            return pa.Table.from_pylist([{"slice": key[0].as_py(), **own}], schema=_ROW)

        dealt.groupBy("slice").applyInArrow(split, "slice long, vocabulary binary, numbers binary, counts binary, items array<array<string>>").write.partitionBy("slice").parquet(self.at)

    def shard(self, texts: list[bytes]) -> Shard:
        return Shard(texts, self.window, next(self.each()).vocabulary if self.parts == 1 else None)

    def each(self) -> Iterator[Benchmark]:
        """All slices, from the one at hand on."""
        first = _LAST["slice"][1] if _LAST.get("slice", ("",))[0] == self.at else 0
        for k in range(first, first + self.parts):
            k %= self.parts
            if _LAST.get("slice") != (self.at, k):
                _LAST.clear()
                _LAST.update(slice=(self.at, k), bench=self._load(k))
            yield _LAST["bench"]

    def _load(self, k: int) -> Benchmark:
        store, base = pafs.FileSystem.from_uri(f"{self.at}/slice={k}")
        found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        for f in found:
            if f.path.endswith(".parquet"):
                return Benchmark.read(pq.read_table(f.path, filesystem=store, partitioning=None).to_pylist()[0], self.window)
        return Benchmark([], [], self.window)


_LAST: dict = {}
_ROW = pa.schema([("slice", pa.int64()), ("vocabulary", pa.binary()), ("numbers", pa.binary()), ("counts", pa.binary()), ("items", pa.list_(pa.list_(pa.string())))])


def _slices(items: DataFrame, window: int, item_id_col: str, item_text_col: str, slice_bytes: int) -> Slices:
    return Slices(items.select(quoted(item_id_col).cast("string").alias("id"), as_text(item_text_col).alias("text")), window, slice_bytes)


MATCH = "struct<item:string,item_word:bigint,word:bigint,n_words:bigint>"


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES, with_matches: bool = True) -> DataFrame:
    """(id, n_words, n_hit, starts, ends, items, matches) for every document.

    starts and ends are the merged stretches of hit words, items the ids whose windows occur, matches the longest verbatim
    matches with their places in item and document; without matches they are null. Where text repeats itself, matches are as
    many as the pairs of equal stretches; everything else is linear.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    slices = _slices(items, window, item_id_col, item_text_col, slice_bytes)
    match = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for table, texts in _shards(batches, 1, slices.shard_bytes):
            shard = slices.shard(texts)
            counts, first, hit = shard.counts, shard.first, np.zeros(len(shard.key), bool)
            found: list[dict[tuple, None]] = [{} for _ in texts]
            named: list[set[str | None]] = [set() for _ in texts]
            for bench in slices.each():
                at, windows = occurrences(shard, bench)
                for d, text in texts_found(shard, bench, at, windows).tolist():
                    named[d].update(bench.items_of[text])
                for d, word, text, item_word, length in longest_matches(shard, bench, at, windows).tolist() if with_matches else ():
                    found[d].update(dict.fromkeys((name, item_word, word, length) for name in bench.items_of[text]))
                hit |= hit_places(shard, bench, at, windows)
            starts, ends, names, matches = [], [], [], []
            for k, rows_of in enumerate(found):
                edge = np.diff(hit[first[k] : first[k] + counts[k]].astype(np.int8), prepend=0, append=0) if named[k] else np.empty(0, np.int8)
                starts.append(np.flatnonzero(edge == 1))
                ends.append(np.flatnonzero(edge == -1))
                names.append(sorted(i for i in named[k] if i is not None))
                matches.append(None if not with_matches else [dict(zip(("item", "item_word", "word", "n_words"), m, strict=True)) for m in sorted(rows_of, key=lambda m: (m[0] is None, m[0] or "", m[1:]))])
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.append(first, len(hit))])
            columns = [table.column(0).combine_chunks(), pa.array(counts), pa.array(n_hit, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(names, pa.list_(pa.string())), pa.array(matches, pa.list_(match))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_hit", "starts", "ends", "items", "matches"])

    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_hit long, starts array<long>, ends array<long>, items array<string>, matches array<{MATCH}>")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Whether the hit words are at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without the contaminated rows. No shuffle."""
    bounded_batches(docs.sparkSession)
    slices = _slices(items, window, item_id_col, item_text_col, slice_bytes)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _shards(batches, text_at, slices.shard_bytes):
            shard = slices.shard(texts)
            hit = np.zeros(len(shard.key), bool)
            for bench in slices.each():
                hit |= hit_places(shard, bench, *occurrences(shard, bench))
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.append(shard.first, len(hit))])
            bad = (n_hit > 0) & (20 * n_hit >= shard.counts)
            yield from table.filter(pa.array(~bad)).to_batches(max_chunksize=1000)

    return through(docs, run)
