"""BPE encoding and decoding.

Encoding is by backtracking: an Aho-Corasick automaton gives the longest token at each place of a word, and a table of
compatible pairs says whether two neighbouring tokens could both survive the merges. Each place of a word is given up at
most once, so the exact merge result is found in time linear in the word. Decoding gathers bytes through an offset table.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text. Repeated rows are
encoded alike. Columns besides id and text aren't read.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_text, bounded_batches, quoted, released

#: Fixed value: the public pattern that splits text before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Cached chunks per Python worker and generation. A full generation becomes the old one, which the new one refills from as
#: its entries are used; this changes speed only.
CACHE_ENTRIES = 200_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """An exact byte-level BPE coder over a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = {i for i in vocab.values() if i not in set(self.special.values())}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.length = [len(b) for b in self.bytes_of]
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.path, self.spec, self.ready = path, spec, False

    def prepare(self) -> None:
        """Build what encoding needs; decoding does without."""
        vocab, merges, size = self.spec["model"]["vocab"], self.spec["model"]["merges"], len(self.bytes_of)
        self.ready, self.spec = True, None
        id_of = {self.bytes_of[i]: i for i in self.plain}
        # pairs that merge, with the merged token as its own rank; halves of each token under the merges
        self.merged: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(size)]
        for merge in merges:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = vocab[a], vocab[b]
            both = vocab[a + b]
            if (left, right) not in self.merged:
                self.merged[left, right] = both
                if self.halves[both] == (both, both):
                    self.halves[both] = (left, right)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        # the longest token that is a proper prefix of a token, or -1
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in id_of.items():
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((id_of[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in id_of), -1)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(WORDS)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.settled: set[str] = set()  # characters that this Python's Unicode tables know
        self.library = None
        self.cache: dict[str, bytes] = {}  # ids of a space with what follows it, by what follows
        self.old_cache: dict[str, bytes] = {}

    def pair_stands(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left and right leaves exactly these two tokens."""
        known = self.compatible.get((left, right))
        if known is None:
            known = self.compatible[left, right] = self._undisturbed(left, right)
        return known

    def _undisturbed(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges again and again. At each step the tokens that meet at the seam
        # may not merge earlier than the merge just undone; ties go to the left, hence the strictness on one side.
        bound = sys.maxsize
        while True:
            both = self.merged.get((left, right))
            if both is not None and both < bound:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            left_whole, right_whole = inner_left == left, inner_right == right
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right

    def encode_word(self, word: bytes) -> list[int]:
        if not self.ready:
            self.prepare()
        letters = word.decode("latin-1")
        # the longest tokens one after the other are right if all neighbours are compatible
        greedy = [token for _, token in self.automaton.iter_long(letters)]
        known = self.compatible
        for pair in zip(greedy, greedy[1:]):  # noqa: B905
            if not (known[pair] if pair in known else self.pair_stands(*pair)):
                break
        else:
            return greedy
        n, length, shorter, longest_at = len(word), self.length, self.shorter, self.automaton.iter_long
        usable = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, last = 0, greedy[0] if n else -1, -1
        while at < n:
            while token >= 0:
                if usable[at + length[token]]:
                    if last < 0:
                        break
                    pair = (last, token)
                    if known[pair] if pair in known else self.pair_stands(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last = token
                token = next(longest_at(letters, at))[1] if at < n else -1
            elif out:
                usable[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out

    def _pack(self, ids: list[int]) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in ids])

    def _span(self, words: list[str]) -> bytes:
        """Ids of words one by one; a word after one space shares the entry of the chunk that it makes up alone."""
        return b"".join([self._chunk(w[1:], w) if w[0] == " " and len(w) > 1 else self._word(w) for w in words])

    def _word(self, word: str) -> bytes:
        return self._pack(self.encode_word(word.encode("utf-8", "surrogatepass")))

    def _chunk(self, part: str, chunk: str) -> bytes:
        """Ids of a chunk: a space and then part, which neither begins nor ends with a space."""
        ids = self.cache.get(part) or self.old_cache.get(part)
        if ids is None:
            if part.isalpha() or len(words := self.words.findall(chunk)) == 1:
                ids = self._word(chunk)
            else:
                ids = self._span(words)
        if len(part) <= 64:
            if len(self.cache) >= CACHE_ENTRIES:
                self.old_cache, self.cache = self.cache, {}
            self.cache[part] = ids
        return ids

    def _strange(self, text: str) -> bool:
        """Whether a character is newer than this Python's Unicode tables, so that other libraries may class it otherwise."""
        new = set(text) - self.settled
        odd = {c for c in new if unicodedata.category(c) == "Cn"}
        self.settled |= new - odd
        return bool(odd)

    def _library_words(self, text: str) -> list[str]:
        """Words where Unicode versions may differ: taken from the library that reads the vocabulary."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _stretch(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A space between two non-space characters always starts a word, so the chunks between such spaces are encoded
        one by one and kept in a cache. Chunks at other spaces are joined to what follows until the end is a non-space.
        """
        parts = text.split(" ")
        got = list(map(self.cache.get, parts))
        got[0] = None
        k, n, out = 0, len(parts), []
        while k < n:
            if got[k] is not None:
                out.append(got[k])
                k += 1
                continue
            part = parts[k]
            if k and part and not part[-1].isspace() and not part[0].isspace():
                out.append(self._chunk(part, " " + part))
                k += 1
                continue
            j = k
            while j + 1 < n and (not parts[j] or parts[j][-1].isspace()):
                j += 1
            joined = " ".join(parts[k : j + 1])
            out.append(self._span(self.words.findall(joined if k == 0 else " " + joined)))
            k = j + 1
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.ready:
            self.prepare()
        stretch = (lambda t: self._span(self._library_words(t))) if not text.isascii() and self._strange(text) else self._stretch
        if self.stops is None or not any(s in text for s in self.special):
            return stretch(text)
        return b"".join(self._pack([self.special[p]]) if p in self.special else stretch(p) for p in self.stops.split(text) if p)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: each id's piece of the blob lies between two entries of the offset table."""
        ids = np.asarray(ids, np.int64)
        first = self.offsets[ids]
        sizes = self.offsets[ids + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(first - (ends - sizes), sizes) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """The coder of a vocabulary file, built once per Python worker."""
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens): ids hold little-endian unsigned 32-bit integers. No shuffle."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            ids = [bpe.encode_bytes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64())], names=["id", "ids", "n_tokens"]
            )

    return rows.mapInArrow(released(run), f"id {id_type}, ids binary, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds text, the decoded ids, to what encode() returns. No shuffle."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.select("id", "ids", "n_tokens")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(b, "<u4")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["id", "ids", "n_tokens", "text"])

    return rows.mapInArrow(released(run), f"id {id_type}, ids binary, n_tokens long, text string")
