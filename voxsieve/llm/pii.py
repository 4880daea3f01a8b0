"""Personal data by a semi-Markov conditional random field beside fixed patterns.

The base are four patterns (email, ip, card, phone), matched leftmost and without overlap for each kind, in time linear in
the text. The field adds what the patterns miss, such as numbers grouped in other ways: a text's stretches around digits and
at-signs are cut into atoms, every stretch of up to MAX_ATOMS atoms that may be an entity is a candidate segment, scored by
features of the whole span (digits, groups, separators, checksums, neighbours) for each kind, and dynamic programming picks
boundaries and kinds together, a label depending on the label before. It is trained by maximum likelihood on
stretches of a bounded sample of documents, labelled by the patterns, and on made-up numbers of both sorts. Segments that
overlap a base span give way to it.

Defined results: a null text is empty and has no spans. Offsets are code points, ends exclusive. Texts are read whole; a very
long one is worked on in blocks of atoms, in time that grows with its length, and holds some 50 bytes for each atom of a zone.
Repeated rows get the same spans. With no document to learn from, the made-up numbers alone are learnt. Columns besides id
and text aren't read.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, bounded_batches, hash_sample, quoted, released

KINDS = ["email", "ip", "card", "phone"]
#: Documents and characters of each that the field may be fitted on; atoms that a segment may have; characters of context.
FIT_ROWS, FIT_CHARS, MAX_ATOMS, CONTEXT = 300, 8000, 16, 40
#: Atoms that are worked on at once.
BLOCK_ATOMS = 2048

# The four patterns of the base, with possessive repeats where that cannot change a match.
_AT_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _AT_HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        # without a match no place up to this sign can begin one
        done = max(done, at + 1)
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, by kind and start."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *s) for s in _addresses(text)]
        for m in _GROUPED.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PLUS.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


_SIGNAL = re.compile(r"[0-9@]+")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
#: Kinds of atoms, as seen from a neighbour too: nothing, digits, letters, space, line break, and signs of interest.
_SIGNS = {"@": 5, ".": 6, "-": 7, "+": 8, "(": 9, ")": 10, ",": 11, ":": 12, "/": 13, "_": 14}
OTHER, N_ATOM_KINDS = 15, 16


def _atom_kind(a: str) -> int:
    c = a[0]
    if "0" <= c <= "9":
        return 1
    if c.isalpha():
        return 2
    if c.isspace():
        return 4 if c in "\r\n" else 3
    return _SIGNS.get(c, OTHER)


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs; no candidate reaches beyond its zone."""
    out: list[list[int]] = []
    for m in _SIGNAL.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass
class Lattice:
    """Candidate segments of one zone: bounds in atoms, feature numbers, and the atoms' places in the text."""

    offsets: list[int]
    starts: np.ndarray
    sizes: np.ndarray
    features: np.ndarray
    gold: list[tuple[int, int, int]] = field(default_factory=list)


#: Feature templates: each has so many buckets.
SIZES = [24, 8, 4, 6, 6, 6, 4, 5, N_ATOM_KINDS * N_ATOM_KINDS, N_ATOM_KINDS, N_ATOM_KINDS, 3, 3, 8, 2048, 1024]
STARTS = np.concatenate([[0], np.cumsum(SIZES)])
N_FEATURES = int(STARTS[-1])


def candidates(words: list[str], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, features) of the candidate segments that begin with one of the atoms from first to last, in their order.

    words are successive atoms. The atom before first and MAX_ATOMS after last must be among them, but at a zone's ends. All
    features come from running sums over the atoms, so the work is the same whatever the segments hold.
    """
    kinds = np.fromiter(map(_atom_kind, words), np.int64, len(words))
    n = len(words)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    length = np.fromiter(map(len, words), np.int64, n)
    is_digit = kinds == 1
    counts = {k: sums(kinds == k) for k in (1, 2, 3, 4, 5, 6, 7, OTHER)}
    digits = sums(np.where(is_digit, length, 0))
    opening, closing = np.isin(kinds, [1, 2, 8, 9]), np.isin(kinds, [1, 2])
    i, s = np.meshgrid(np.arange(first, last), np.arange(1, MAX_ATOMS + 1), indexing="ij")
    i, s = i.ravel(), s.ravel()
    fits = (i + s <= n) & opening[i] & closing[np.minimum(i + s, n) - 1]
    i, s = i[fits], s[fits]
    j = i + s
    inside = lambda k: counts[k][j] - counts[k][i]
    total = digits[j] - digits[i]
    ok = (inside(1) + inside(5) > 0) & (inside(4) == 0) & ((total >= 4) | (inside(5) > 0))
    i, s, j, total = i[ok], s[ok], j[ok], total[ok]
    groups, letters = inside(1), np.minimum(inside(2), 3)
    before = np.where(i > 0, kinds[np.maximum(i - 1, 0)], 0)
    after = np.where(j < n, kinds[np.minimum(j, n - 1)], 0)
    # the digits that a segment holds are a stretch of all the digits; every second one, from its end, counts double in the check
    own = np.frombuffer("".join(w for w, d in zip(words, is_digit.tolist(), strict=True) if d).encode(), np.uint8).astype(np.int64) - 48
    odd = np.arange(len(own)) % 2 == 1
    doubled = 2 * own - 9 * (own > 4)
    by_end = [sums(np.where(odd, own, doubled)), sums(np.where(odd, doubled, own))]  # for an even end, for an odd one
    a, b = digits[i], digits[j]
    luhn_sum = np.where(b % 2 == 0, by_end[0][b] - by_end[0][a], by_end[1][b] - by_end[1][a])
    check = np.where((total >= 16) & (total <= 19) & (letters == 0), 1 + (luhn_sum % 10 == 0), 0)
    small = sums(np.fromiter((d and k < 4 and int(w) <= 255 for w, d, k in zip(words, is_digit.tolist(), length.tolist(), strict=True)), bool, n))
    quads = np.where(groups == 4, 1 + (small[j] - small[i] == 4), 0)
    # an atom's sign in the layout: its digits' number, a for letters, itself otherwise
    code = np.fromiter((ord(w[0]) if k not in (1, 2) else 97 if k == 2 else 48 + min(9, len(w)) for w, k in zip(words, kinds.tolist(), strict=True)), np.int64, n)
    wide = np.concatenate([np.stack([code, np.where(is_digit, length, 0)]), np.zeros((2, MAX_ATOMS), np.int64)], 1)
    windows = np.lib.stride_tricks.sliding_window_view(wide, MAX_ATOMS, 1)[:, first:last]
    powers = np.array([131**p % 2048 for p in range(MAX_ATOMS)], np.int64)
    digest = (np.cumsum(windows[0] * powers, 1) % 2048)[i - first, s - 1]
    longest = np.minimum(7, np.maximum.accumulate(windows[1], 1)[i - first, s - 1])
    groups = np.minimum(groups, 7)
    values = [
        np.minimum(total, 23), groups, np.minimum(inside(5), 3), np.minimum(inside(6), 5), np.minimum(inside(7), 5), np.minimum(inside(3), 5), letters, np.minimum(inside(OTHER), 3) + (kinds[i] == 8),
        kinds[i] * N_ATOM_KINDS + kinds[j - 1], before, after, check, quads, longest, digest, (np.minimum(total, 23) * 37 + groups * 5 + longest) % 1024,
    ]
    values = [np.minimum(v, size - 1) + start for v, size, start in zip(values, SIZES, STARTS, strict=False)]
    return i, s, np.stack(values, 1)


def lattice(text: str, begin: int, end: int) -> Lattice | None:
    """All candidates of a zone at once, for fitting."""
    atoms = [m.span() for m in _ATOM.finditer(text, begin, end)]
    if not atoms:
        return None
    starts, sizes, features = candidates([text[a:b] for a, b in atoms], 0, len(atoms))
    return Lattice([a for a, _ in atoms] + [end], starts, sizes, features) if len(starts) else None


@dataclass
class SemiCrf:
    """Weights by feature and kind, and of each label after each (the last is no entity)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, len(KINDS))))
    follows: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def scores(self, lat: Lattice) -> np.ndarray:
        return self.weights[lat.features].sum(1)

    def entities(self, text: str, begin: int, end: int) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the entities of a zone's best segmentation, in characters.

        The zone goes by in blocks of atoms, each with the candidates that begin in it. What stays of an atom is its place, and
        for each label the length of the segment that ends there and the label before: some 20 bytes.
        """
        none = len(KINDS)
        offsets, came, sizes = array("q"), bytearray(), bytearray()
        atoms = _ATOM.finditer(text, begin, end)
        words: list[str] = []  # of the block, one before it, and those ahead
        at, ahead, over = 0, 0, False  # atoms done, and of words those before the block
        best = np.full(none + 1, -np.inf)
        best[none] = 0.0
        ways = best[:, None] + self.follows
        came += ways.argmax(0).astype(np.uint8).tobytes()
        sizes += bytes(none)
        enter = np.full((MAX_ATOMS + BLOCK_ATOMS + 1, none + 1), -np.inf)  # row MAX_ATOMS is that of the block's begin
        enter[MAX_ATOMS] = ways.max(0)
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, none)))
        alone = [self.follows[none], np.full(none + 1, none, np.uint8).tobytes(), bytes(none)]
        while True:
            while not over and len(words) < ahead + BLOCK_ATOMS + MAX_ATOMS + 1:
                m = next(atoms, None)
                over = m is None
                if m:
                    words.append(m[0])
                    offsets.append(m.start())
            n = min(BLOCK_ATOMS, len(words) - ahead)
            if n <= 0:
                break
            i, s, features = candidates(words, ahead, ahead + n)
            start = np.concatenate([held[0], i - ahead])
            size = np.concatenate([held[1], s])
            score = np.concatenate([held[2], self.weights[features].sum(1)])
            ends = start + size
            order = np.argsort(ends, kind="stable")
            start, size, score, ends = start[order], size[order], score[order], ends[order]
            first = np.searchsorted(ends, np.arange(1, n + 2)).tolist()
            rows = start + MAX_ATOMS
            for t in range(1, n + 1):
                a, b = first[t - 1], first[t]
                stay = enter[MAX_ATOMS + t - 1, none]
                if a == b:
                    enter[MAX_ATOMS + t] = stay + alone[0]
                    came += alone[1]
                    sizes += alone[2]
                    continue
                offers = enter[rows[a:b], :none] + score[a:b]
                which = offers.argmax(0)
                best[:none] = offers.max(0)
                best[none] = stay
                ways = best[:, None] + self.follows
                came += ways.argmax(0).astype(np.uint8).tobytes()
                enter[MAX_ATOMS + t] = ways.max(0)
                sizes += size[a:b][which].astype(np.uint8).tobytes()
            rest = ends > n
            held = (start[rest] - n, size[rest], score[rest])
            enter[: MAX_ATOMS + 1] = enter[n : n + MAX_ATOMS + 1].copy()
            at += n
            drop = ahead + n - 1
            words, ahead = words[drop:], 1
        offsets.append(end)
        # where no segment ends at the last atom, no entity does
        t, y, out = at, int(best.argmax()) if at and a < b else none, []
        while t > 0:
            if y == none:
                t -= 1
                y = came[t * (none + 1) + none]
            else:
                k = sizes[t * none + y]
                out.append((y, offsets[t - k], offsets[t]))
                t -= k
                y = came[t * (none + 1) + y]
        return out[::-1]

    def gradient(self, lat: Lattice, into: np.ndarray, after: np.ndarray) -> float:
        """Adds the gradient of the negative log likelihood of lat.gold; returns that."""
        n, score, none = len(lat.offsets) - 1, self.scores(lat), len(KINDS)
        ends = lat.starts + lat.sizes
        by_end = [[] for _ in range(n + 1)]
        by_start = [[] for _ in range(n + 1)]
        for c, (a, e) in enumerate(zip(lat.starts.tolist(), ends.tolist(), strict=True)):
            by_end[e].append(c)
            by_start[a].append(c)
        fold = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        front = np.full((n + 1, none + 1), -np.inf)
        front[0, none] = 0
        enter = np.empty((n + 1, none + 1))
        for t in range(n + 1):
            if t:
                front[t, none] = enter[t - 1, none]
                if by_end[t]:
                    front[t, :none] = fold(enter[lat.starts[by_end[t]], :none] + score[by_end[t]], 0)
            enter[t] = fold(front[t][:, None] + self.follows, 0)
        rear = np.zeros((n + 1, none + 1))  # after a segment of each label that ends here
        begin = np.full((n + 1, none + 1), -np.inf)  # with a segment of each label that begins here
        for t in range(n - 1, -1, -1):
            begin[t, none] = rear[t + 1, none]
            if by_start[t]:
                begin[t, :none] = fold(score[by_start[t]] + rear[ends[by_start[t]], :none], 0)
            rear[t] = fold(self.follows + begin[t], 1)
        whole = fold(front[n], 0)
        p = np.exp(enter[lat.starts, :none] + score + rear[ends, :none] - whole)
        for t in range(n):
            after += np.exp(front[t][:, None] + self.follows + begin[t] - whole)
        place = {(int(a), int(e)): c for c, (a, e) in enumerate(zip(lat.starts, ends, strict=True))}
        value, t, last = 0.0, 0, none
        for y, a, e in sorted(lat.gold, key=lambda g: g[1]) + [(none, n, n)]:
            while t < a:
                value += self.follows[last, none]
                after[last, none] -= 1
                t, last = t + 1, none
            if y < none:
                c = place[a, e]
                value += self.follows[last, y] + score[c, y]
                after[last, y] -= 1
                p[c, y] -= 1
                t, last = e, y
        np.add.at(into, lat.features.ravel(), np.repeat(p, lat.features.shape[1], 0))
        return float(whole - value)


def _gold(lat: Lattice, spans: list[tuple[int, int, int]]) -> bool:
    """Label a lattice by text spans; false if a span isn't one of its candidates."""
    at = {o: k for k, o in enumerate(lat.offsets)}
    known = {(int(a), int(a + s)) for a, s in zip(lat.starts, lat.sizes, strict=True)}
    last = -1
    for y, a, b in sorted(spans, key=lambda s: s[1]):
        if a < last:
            continue
        pair = (at.get(a), at.get(b))
        if pair not in known:
            return False
        lat.gold.append((y, *pair))
        last = b
    return True


def made_up(rng: random.Random, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Stretches of text with numbers that are personal data and numbers that aren't."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def card(sound: bool) -> str:
        while luhn(d := rng.choice("3456") + digits(15)) != sound:
            pass
        return d

    def grouped(d: str, sign: str) -> str:
        return sign.join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(20, 99)} {a} {b} {c}"])

    address = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    email = lambda: f"{word()}{rng.choice(['', '.', '_'])}{rng.choice([word(), digits(2)])}@{word()}.{rng.choice(['com', 'org', 'example.net'])}"
    calm = [
        lambda: str(rng.randint(1, 10 ** rng.randint(1, 7))), lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(0, 23)}:{digits(2)}",
        lambda: f"{rng.randint(0, 999)}.{digits(2)}", lambda: f"{rng.randint(1, 99)},{digits(3)},{digits(3)}", lambda: f"{rng.randint(1, 99)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1900, 2099)}", lambda: card(False),
        lambda: grouped(card(False), rng.choice("- ")), lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: digits(rng.randint(4, 15)), lambda: f"{digits(3)}-{digits(3)}", lambda: f"@{word()}",
    ]
    marked = [email, address, lambda: rng.choice([card(True), grouped(card(True), rng.choice(" -."))]), phone]
    out = []
    for _ in range(n):
        text, spans = word() + " ", []
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.55:
                y = rng.randrange(4)
                thing = marked[y]()
                spans.append((y, len(text), len(text) + len(thing)))
            else:
                thing = rng.choice(calm)()
            text += thing + rng.choice([" ", ", ", ". "]) + word() + rng.choice([" ", "\n"])
        out.append((text, spans))
    return out


def train(texts: list[str], seed: int = 5, made: int = 500, epochs: int = 12) -> SemiCrf:
    """Fit by stochastic gradients with a step for each weight."""
    rng = random.Random(seed)
    examples = [(t, s) for t, s in made_up(rng, made)]
    examples += [(t, base_spans(t)) for t in texts]
    lattices = []
    for text, spans in examples:
        for a, b in zones(text):
            lat = lattice(text, a, b)
            if lat and len(lat.starts) < 3000 and _gold(lat, [s for s in spans if a <= s[1] and s[2] <= b]):
                lattices.append(lat)
    model = SemiCrf()
    squares, squares_after = np.full_like(model.weights, 1e-6), np.full_like(model.follows, 1e-6)
    for _ in range(epochs):
        rng.shuffle(lattices)
        for at in range(0, len(lattices), 16):
            g, ga = 1e-4 * model.weights, 1e-4 * model.follows
            for lat in lattices[at : at + 16]:
                model.gradient(lat, g, ga)
            squares += g * g
            squares_after += ga * ga
            model.weights -= 0.25 * g / np.sqrt(squares)
            model.follows -= 0.25 * ga / np.sqrt(squares_after)
    return model


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiCrf) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the field's entities that touch no base span."""
    out = []
    starts, ends = _covered(base)
    for a, b in zones(text):
        k, last = bisect_right(ends, a), bisect_left(starts, b)
        if k < last and not any(_SIGNAL.search(text, *gap) for gap in zip([a, *ends[k:last]], [*starts[k:last], b], strict=True) if gap[0] < gap[1]):
            continue  # all that could be an entity is one already
        for y, start, end in model.entities(text, a, b):
            if bisect_right(ends, start) >= bisect_left(starts, end):
                out.append((y, start, end))
    return out


def _covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The starts and ends of the stretches that spans cover."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> SemiCrf:
    """Train on the first so many documents by hash that hold a digit or an at-sign and aren't longer than so many characters."""
    texts = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text")).where((F.length("text") <= chars) & F.col("text").rlike("[0-9@]"))
    return train([r.text for r in hash_sample(texts, [F.col("id"), F.col("text")], rows).collect()])


SPANS = "array<struct<kind:int,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, model: SemiCrf, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id, spans, text): all spans by kind and start; text is the text with spans replaced by their kind, or null if not asked for. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                added = added_spans(text, base, model)
                spans.append([{"kind": y, "start": a, "end": b, "base": own} for y, a, b, own in sorted([*((*s, True) for s in base), *((*s, False) for s in added)])])
                texts.append(redacted(text, base + added) if redact else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(texts, pa.string())], names=["id", "spans", "text"])

    return rows.mapInArrow(released(run), f"id {id_type}, spans {SPANS}, text string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap make one, named by the first."""
    out, at = [], 0
    for y, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[y].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_column(docs: DataFrame, model: SemiCrf, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with each span in the text replaced by its kind in brackets, and the count column, if there is one, counted anew for
    texts that changed. Null texts stay null. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text) if text else []
                spans = base + added_spans(text, base, model) if text else []
                out.append(redacted(text, spans) if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    found = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], F.length(quoted(text_col)).alias("before"))
    kept = found.mapInArrow(released(run), found.schema)
    names = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    if count_col in docs.columns:
        k = docs.columns.index(count_col)
        now = F.length(f"c{at}")
        names[k] = F.when(now != F.col("before"), now.cast(docs.schema[count_col].dataType)).otherwise(F.col(f"c{k}")).alias(count_col)
    return kept.select(*names)
