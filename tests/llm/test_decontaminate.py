import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.oracle import same_rows
from voxsieve.llm import decontaminate, queries, sql


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for j, t in items:
            b = words_of(t)
            n = min(window, len(b))
            if not n:
                continue
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    if j is not None:
                        ids.add(str(j))
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


def test_query_matches_sql(spark, data_dir):
    same_rows(queries.op8_decontaminate(spark, data_dir), data_dir, sql.OP8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    for depth in (1, 5, 64):
        order = decontaminate.suffix_array(np.array(text, np.int64), 1, depth).tolist() if text else []
        assert sorted(order) == list(range(len(text)))
        assert [text[k : k + depth] for k in order] == sorted(text[k : k + depth] for k in range(len(text)))


def test_brute_force_with_odd_rows(spark):
    rng = random.Random(7)
    text = lambda n, v: " ".join(rng.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(k, text(rng.randint(1, 40), 3)) for k in range(8)] + [(8, None), (9, ""), (None, text(20, 2)), (3, text(30, 2)), (11, "z! Y,x"), (12, "é日 7")]
    docs = [(k, text(rng.randint(0, 120), 3)) for k in range(60)] + [(60, None), (61, "..."), (None, items[0][1]), (5, "q Z y X"), (5, "q Z y X"), (62, "É é日 7 é日\u00007"), (63, "w " * 30000 + items[3][1])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, id string").repartition(3).checkpoint()
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(brute(docs, items), key=key)
    for bound in (1 << 20, 150):  # one slice of the benchmark, several slices
        rows = decontaminate.find_hits(frame, bench, slice_bytes=bound).collect()
        assert sorted(((r.id, r.n_words, r.n_hit, list(r.items_)) for r in (_Row(x) for x in rows)), key=key) == want
        for r in rows:
            for m in r.matches:
                own = words_of(next(t for i, t in docs if i == r.id and len(words_of(t)) == r.n_words))
                assert m.item is None or any(words_of(t)[m.item_word : m.item_word + m.n_words] == own[m.word : m.word + m.n_words] for i, t in items if str(i) == m.item)
        clean = sorted((r.doc_id or -1, len(words_of(r.text))) for r in decontaminate.remove_contaminated(frame, bench, slice_bytes=bound).collect())
        assert clean == sorted((i or -1, n) for i, n, hit, _ in want if not (hit and 20 * hit >= n))
    assert decontaminate.find_hits(frame.limit(0), bench).collect() == []
    assert decontaminate.remove_contaminated(frame.limit(0), bench).columns == frame.columns
    assert {r.n_hit for r in decontaminate.find_hits(frame, bench.limit(0)).collect()} == {0}


def test_words_that_polynomial_hashes_confuse(spark):
    """Swapped letters along the parity of set bits: equal under any odd base modulo a power of two."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{k}" for k in range(12))
    docs, items = [(1, f"{head} {a}"), (2, f"{head} {b}")], [("x", f"{head} {b}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_hits(frame, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in got) == [(1, 13, 0, []), (2, 13, 13, ["x"])]


def test_many_slices_read_documents_once(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choices("abcdefghijklmnopq", k=40))) for k in range(300)]
    docs = [(k, " ".join(rng.choices("abcdefghijklmnopq", k=30)) + " " + items[k * 7 % 300][1][: 2 * rng.randint(5, 40)]) for k in range(60)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(frame, bench, slice_bytes=700)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == brute(docs, items)


def test_tiny_shards_equal_brute_force():
    """Shards of 0 to 20 words against vocabularies from one word to thousands."""
    rng = random.Random(3)
    for v in (1, 2, 3, 30, 300, 5000):
        items = [(str(k), " ".join(f"w{x}" for x in rng.choices(range(v), k=n))) for k, n in enumerate((1, 2, 5, 13, 14, 40, v))]
        bench = decontaminate.Benchmark(*map(list, zip(*items, strict=True)), 13)
        for n in range(21):
            for texts in ([" ".join(f"w{x}" for x in rng.choices(range(v + 2), k=n))], [items[k % 7][1].rsplit(" ", 40 - n)[0] for k in range(n % 4)] + [""] * (n % 3)):
                for known in (None, bench.vocabulary):
                    shard = decontaminate.Shard([t.encode() for t in texts], 13, known)
                    at, windows = decontaminate.occurrences(shard, bench)
                    hit = decontaminate.hit_places(shard, bench, at, windows)
                    named = [set() for _ in texts]
                    for d, p in decontaminate.texts_found(shard, bench, at, windows).tolist():
                        named[d].update(bench.items_of[p])
                    got = [(k, int(c), int(hit[a : a + c].sum()), sorted(i)) for k, (a, c, i) in enumerate(zip(shard.first, shard.counts, named, strict=True))]
                    assert got == brute(list(enumerate(texts)), items)


def test_short_items_after_many_words():
    """An item of one word at the end of a slice, where a key holds few words."""
    long = " ".join(f"w{k}" for k in range(9000))
    items = [("a", long), ("b", "x")]
    docs = [(0, long + " x"), (1, "x w1"), (2, "w5 w6"), (3, " ".join(long.split()[20:40]))]
    bench = decontaminate.Benchmark(*map(list, zip(*items, strict=True)), 13)
    read = decontaminate.Benchmark.read(bench.row(), 13)
    assert read.row() == bench.row() and read.begin.tolist() == bench.begin.tolist() and read.size.tolist() == bench.size.tolist()
    shard = decontaminate.Shard([t.encode() for _, t in docs], 13)
    hit = decontaminate.hit_places(shard, read, *decontaminate.occurrences(shard, read))
    assert [int(hit[a : a + c].sum()) for a, c in zip(shard.first, shard.counts, strict=True)] == [n for _, _, n, _ in brute(docs, items)]


def test_each_slice_is_loaded_once_a_shard(spark, monkeypatch):
    """Shards begin with the slice that the last one ended with."""
    items = [(k, " ".join(f"w{k * 40 + j}" for j in range(40))) for k in range(30)]
    slices = decontaminate._slices(spark.createDataFrame(items, "item_id long, text string"), 13, "item_id", "text", 2000)
    loads, load = [], slices._load
    monkeypatch.setattr(slices, "_load", lambda k: loads.append(k) or load(k))
    assert slices.parts > 3
    seen = [sum(len(b.items_of) for b in slices.each()) for _ in range(3)]
    assert seen == [30] * 3 and len(loads) == 3 * slices.parts - 2


def test_a_document_a_partition(spark):
    texts = ["x y", "", None, "x", "q " * 20, "a b c d e f g h i j k l m n", "...", "e d c b a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartitionByRange(8, "doc_id")
    for items in ([(1, "v w x y z")], [(1, "x")], [(1, "a b c d e f g h i j k l m"), (2, "q")], [(1, " ".join(f"w{k}" for k in range(9000)) + " x y")]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        want = brute(list(enumerate(texts)), items)
        for matches in (True, False):
            rows = decontaminate.find_hits(docs, bench, with_matches=matches).collect()
            assert sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in rows) == want
            assert all((r.matches is None) != matches for r in rows)
        assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()) == [k for k, n, hit, _ in want if not (hit and 20 * hit >= n)]


class _Row:
    """items is also a method of rows."""

    def __init__(self, row):
        self.id, self.n_words, self.n_hit, self.items_ = row["id"], row["n_words"], row["n_hit"], row["items"]
