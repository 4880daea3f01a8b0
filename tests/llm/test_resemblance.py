"""The pipeline's near-duplicate stage against every pair of five-word sets."""

import random

import corpus_pipeline
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_duplicates import LOWER, plain_print
from voxsieve.llm import resemblance


def plain_set(text):
    w = (text or "").translate(LOWER).split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_links(texts):
    sets = [plain_set(t) for t in texts]
    return [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def roots(n, edges):
    label = list(range(n))
    for a, b in edges:
        a, b = sorted((label[a], label[b]))
        label = [a if x == b else x for x in label]
    return label


def texts_of(rng):
    words = [f"w{k}" for k in range(3000)]
    common = rng.choices(words, k=40)
    out = [None, "", " \n", "a", "A", "a b c d", "w1 w2 w3 w4 w5 w6 w7 w8", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "w1 w2 w3 w4 w5 w6 w7 x y"]
    for n in range(25):
        base = rng.choices(words, k=rng.choice([30, 60, 150])) + common * (n % 3)
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    walk = rng.choices(words, k=120)
    for _ in range(30):  # near its neighbours, far from the first
        walk[rng.randrange(120)] = rng.choice(words)
        out.append(" ".join(walk))
    return out


def test_links_connect_what_is_similar(spark, monkeypatch):
    texts = texts_of(random.Random(3))
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = roots(len(texts), plain_links(texts))
    assert len(set(want)) < len(texts)
    for joined in (1000, 2):
        monkeypatch.setattr(resemblance, "JOINED", joined)
        monkeypatch.setattr(resemblance, "MET", 1)
        monkeypatch.setattr(resemblance, "TILE", 3)
        assert roots(len(texts), [(r.a, r.b) for r in resemblance.links(frame).collect()]) == want


def test_stage_drops_edited_copies(spark, data_dir, tmp_path):
    texts = texts_of(random.Random(4))
    frame = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/docs")
    frame = spark.read.parquet(f"{tmp_path}/docs")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    prints = [plain_print(t) for _, t in rows]
    near = [(a, b) for b in range(len(rows)) for a in range(b) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    groups = {}
    for (i, _), g in zip(rows, roots(len(rows), near + plain_links([t for _, t in rows])), strict=True):
        groups.setdefault(g, []).append(-1 if i is None else i)
    want = sorted(min((i for i in g if i >= 0), default=-1) for g in groups.values())
    got = corpus_pipeline.near_dedup(spark, frame, data_dir)
    assert got.columns == frame.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == want


def test_recall_of_the_blocks_by_similarity():
    """How many pairs of each similarity share a block and lie within the distance, the verification left aside."""
    rng = np.random.default_rng(5)
    for share, least in ((0.8, 0.998), (0.85, 0.999), (0.9, 1.0)):
        found, tries = 0, 1000
        for _ in range(tries):
            n = int(rng.integers(40, 400))
            both = int(round(2 * n * share / (1 + share)))
            every = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.int64).astype(np.uint64)
            low = [resemblance.mixed(resemblance.minima(s)) for s in (every[:n], every[n - both :])]
            bits = int(((low[0] ^ low[1]) & np.uint64(1)).sum())
            blocks = np.all([low[0][r :: resemblance.ROWS] == low[1][r :: resemblance.ROWS] for r in range(resemblance.ROWS)], axis=0)
            found += bits <= resemblance.DISTANCE and bool(blocks.any())
        assert found >= least * tries, (share, found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abCD \n", max_size=40), max_size=6))
def test_sets_are_of_five_words(texts):
    sets = list(resemblance.shingle_sets(texts))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    for a, s in zip(texts, sets, strict=True):
        for b, t in zip(texts, sets, strict=True):
            assert len(np.intersect1d(s, t)) == len(plain_set(a) & plain_set(b))
