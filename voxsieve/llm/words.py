"""Words of many texts as numbers: 128-bit hashes of each word's bytes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes or values worked on at once.
BLOCK = 1 << 19

def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true in the given ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Whatever isn't a space or one of the controls from tab to carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, a-z and every byte of a non-ASCII character.
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def byte_table(is_word: np.ndarray) -> bytes:
    """For bytes.translate: A-Z to a-z, and whatever is in no word to a space."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if is_word[b] else 32 for b in lower)


class Words:
    """The hashed words of several texts; words are what stands between spaces and the controls from tab to carriage return.

    hashes: a row of two 64-bit numbers for each word; first: for each text the number of its first word, with the word count
    at the end. The texts are worked on in blocks, cut where no word is.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" " * 32, np.uint8)
        text_at = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
        starts, hashes, at, n = [np.empty(0, np.int64)], [np.empty((0, 2), np.uint64)], 0, len(data) - 24
        while at < n:
            size = BLOCK
            while (flags := NOT_SPACE[data[at : min(n, at + size)]]).all():
                size *= 2
            end = at + len(flags) - int(np.argmin(flags[::-1]))
            edges = np.flatnonzero(np.diff(flags[: end - at].view(np.int8), prepend=0, append=0)) + at
            starts.append(edges[::2])
            hashes.append(_hashed(data, edges[::2], edges[1::2] - edges[::2]))
            at = end
        self.hashes = np.concatenate(hashes)
        self.first = np.searchsorted(np.concatenate(starts), text_at)

    def __len__(self) -> int:
        return len(self.hashes)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word: of words up to 24 bytes by mixing eight bytes at a time, of longer ones by a library."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    out = np.empty((len(starts), 2), np.uint64)
    with np.errstate(over="ignore"):
        head = eight[starts] & _MASKS[np.minimum(sizes, 8)]
        length = sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in (0, 1):
            out[:, k] = mixed(mixed(head ^ _SEEDS[k]) + length)
        for skip in (8, 16):
            more = np.flatnonzero(sizes > skip)
            piece = eight[starts[more] + skip] & _MASKS[np.minimum(sizes[more] - skip, 8)]
            for k in (0, 1):
                out[more, k] = _joined(out[more, k], piece)
    raw = data.data
    for w in np.flatnonzero(sizes > 24).tolist():
        h = xxhash.xxh3_128_intdigest(raw[starts[w] : starts[w] + sizes[w]])
        out[w] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of so many values; run k starts at value k.

    Hashes of runs are put together from those of shorter ones, each joint being mixed, so equal hashes of different runs are
    chance alone.
    """
    total = max(0, len(values) - size + 1)
    out = np.empty(total, np.uint64)
    for at in range(0, total, BLOCK):
        runs, span = mixed(values[at : min(at + BLOCK, total) + size - 1]), 1
        n = len(runs) - size + 1
        done, covered = None, 0
        while True:
            if size & span:
                piece = runs[covered : covered + n]
                done = piece if done is None else _joined(done, piece)
                covered += span
            if 2 * span > size:
                break
            runs = _joined(runs[:-span], runs[span:])
            span *= 2
        out[at : at + n] = done
    return out
