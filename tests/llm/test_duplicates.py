"""SimHash components and substring dedup against brute force."""

import random
import re
import uuid

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.oracle import same_rows
from voxsieve.llm import queries, simhash, sql, substring, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest id reachable by links of two bits at most, by trying every pair."""
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                label[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(prints):
        groups.setdefault(root(k), []).append(i)
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(prints))]


def test_query_matches_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d.doc_id, plain_print(d.text)) for d in docs]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints), strict=True))
    assert sorted(tuple(r) for r in queries.op2_simhash(spark, data_dir).collect()) == want


def test_odd_documents(spark):
    rows = [(5, None), (3, ""), (None, "  "), (7, "a"), (2, "A"), (None, "b c"), (9, "x " * 40_000), (9, "x " * 40_000), (4, "É é É é")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    prints = [(i, plain_print(t)) for i, t in rows]
    want = sorted(((i or -1, f, c or -1) for (i, f), c in zip(prints, plain_components(prints), strict=True)))
    assert sorted((r.id or -1, r.fp % (1 << 64), r.component or -1) for r in simhash.near_duplicates(frame).collect()) == want
    assert sorted(r.doc_id or -1 for r in simhash.keep_first(frame).collect()) == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(frame.limit(0)).collect() == []
    assert simhash.keep_first(frame.limit(0)).columns == frame.columns


def test_links_of_crowded_and_chained_prints(spark, monkeypatch):
    """Balls of near prints, and paths whose ends are far apart, joined or by neighbours."""
    rng = random.Random(11)
    prints = set()
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(60):
            prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        walk = center ^ 0xF0F0
        for _ in range(40):
            walk ^= sum(1 << b for b in rng.sample(range(64), 2))
            prints.add(walk)
    prints = sorted(prints)
    want = plain_components(list(enumerate(prints)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for bound in (1000, 6, 1):
        monkeypatch.setattr(simhash, "JOINED", bound)
        labels = dict(simhash.components(simhash.links(frame)).collect())
        groups = {}
        for k, p in enumerate(signed):
            groups.setdefault(labels.get(p, p), []).append(k)
        found = {k: min(g) for g in groups.values() for k in g}
        assert [found[k] for k in range(len(signed))] == want


def plain_removal(docs, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        if i is not None:
            for k in range(len(w) - length + 1):
                g = tuple(w[k : k + length])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substring_query_matches_sql(spark, data_dir):
    same_rows(queries.op3_substring_dedup(spark, data_dir), data_dir, sql.OP3)


def test_substring_brute_force(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefghijkl") for _ in range(n)] for n in (50, 51, 49, 80, 200, 50)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 60))]
            w += rng.choice(passages)[rng.choice([0, 0, 1]) :]
        docs.append((rng.choice([i, i, None, 7]), rng.choice([" ", "\n", " \t"]).join(w)))
    docs += [(90, None), (91, ""), (92, "É " * 60), (93, "É " * 60), (94, "q " * 20_000), (95, "q " * 70), (96, "n\0l " * 60), (97, "n\0l " * 55)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, h string").repartition(5).checkpoint()
    got = [(-1 if r.id is None else r.id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame).collect()]
    assert sorted(got) == plain_removal(docs, 50)
    assert substring.remove_repeats(frame.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 80))
def test_covers_align_any_two_places(length):
    period, cover, size = substring.plan(length)
    assert size + period - 1 == length and size >= 1
    differences = {(a - b) % period for a in cover for b in cover}
    assert differences == set(range(period))


def test_small_windows_use_a_greedy_cover(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).checkpoint()
    got = sorted((r.id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame, length=7).select("id", "n_words", "n_removed", F.col("kept")).collect())
    assert got == plain_removal(docs, 7)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab \t\n\0", "  ", "a" * 7, "b" * 8, "ab" * 12, "ab" * 13, "é", "a\0", "x" * 700_000]), max_size=9).map("".join), max_size=5))
def test_equal_hashes_are_equal_words(texts):
    raw = [t.encode() for t in texts]
    found = words.Words(raw)
    every = [w for t in raw for w in t.split()]
    assert found.first.tolist() == np.cumsum([0, *(len(t.split()) for t in raw)]).tolist()
    for k in (0, 1):
        number = {}
        assert len(every) == len(found) and all(number.setdefault(w, h) == h for w, h in zip(every, found.hashes[:, k].tolist(), strict=True))
        assert len(set(number.values())) == len(number)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 30))
def test_equal_window_hashes_are_equal_windows(values, size):
    hashes = words.window_hashes(np.array(values, np.uint64), size).tolist()
    windows = [tuple(values[k : k + size]) for k in range(len(values) - size + 1)]
    assert len(hashes) == len(windows) and len(set(hashes)) == len(set(windows)) == len(set(zip(hashes, windows, strict=True)))


def swapped_pair(n=2048):
    """Two words that a polynomial hash with an odd base modulo a power of two can't tell apart."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    head = " ".join(f"w{k}" for k in range(49))
    a, b = swapped_pair()
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {b}"), (4, " ".join("r" + swapped_pair(64)[0])), (5, " ".join("r" + swapped_pair(64)[1]))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept) for r in got) == plain_removal(rows, 50)
    assert [r.n_removed for r in sorted(got)][:3] == [0, 0, 50]


def test_rows_that_move_are_an_error(spark, tmp_path):
    """A plan that gives other rows when it is read again."""
    rows = spark.range(400, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("same words "), 40), F.udf(lambda: uuid.uuid4().hex).asNondeterministic()()).alias("text"))
    with pytest.raises(Exception, match="read differently"):
        substring.remove_repeats(rows).collect()


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(6)
    path = list(range(200))
    edges = list(zip(path, path[1:], strict=False))  # the worst order for hooking
    mixed = rng.sample(range(1000, 1120), 120)
    edges += [tuple(sorted(e)) for e in zip(mixed, mixed[1:], strict=False)]
    edges += [(2000, k) for k in range(2001, 2060)] + [(a, b) for a in range(3000, 3020) for b in range(a + 1, 3020)] + [(3000, 3019)] * 3 + [(-5, 4000)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {k: 0 for k in path} | {k: 1000 for k in mixed} | {k: 2000 for k in range(2000, 2060)} | {k: 3000 for k in range(3000, 3020)} | {-5: -5, 4000: -5}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []
