"""The trained operators: patterns by brute force, held-out accuracy, and odd rows."""

import hashlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import ROOT
from voxsieve.llm import pii, quality, queries, toxicity
from voxsieve.llm.common import fold

MIDDLE = "/root/testdata/sf0.01"


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"a.@+-% 0129()", "b@c.d", "1.2.3.4", "255.", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-0100", "é", "٣", "²", "\n", "@x.y@"]), max_size=30).map("".join))
def test_base_is_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_is_linear_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 50_000, "+1" * 60_000, "@" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def crf():
    return pii.train([])


def test_field_adds_spans_and_leaves_numbers_alone(crf):
    def added(text):
        return [(pii.KINDS[y], text[a:b]) for y, a, b in pii.added_spans(text, pii.base_spans(text), crf)]

    assert added("call (415) 555-0123 now") == [("phone", "(415) 555-0123")]
    assert added("card 4111.1111.1111.1111 ok") == [("card", "4111.1111.1111.1111")]
    assert added("order 123456 on 2021-03-04 at 12:30 for 12.50") == []
    for text in ("", "no numbers", "x" * 5000, "1 " * 3000, "@" * 500, "1\n" * 50):
        for y, a, b in pii.added_spans(text, pii.base_spans(text), crf):
            assert 0 <= a < b <= len(text) and 0 <= y < 4


def test_best_segmentation_is_the_best_of_all(crf):
    rng = random.Random(4)
    for text, _ in pii.made_up(rng, 25):
        for a, b in pii.zones(text):
            lat = pii.lattice(text, a, b)
            if lat is None:
                continue
            score, n = crf.scores(lat), len(lat.offsets) - 1
            best = {}
            for t in range(n - 1, -1, -1):  # best score from t on, after each label, over all ways
                for last in range(5):
                    ways = [crf.follows[last, 4] + best.get((t + 1, 4), 0)]
                    for c in np.flatnonzero(lat.starts == t):
                        ways += [crf.follows[last, y] + score[c, y] + best.get((t + int(lat.sizes[c]), y), 0) for y in range(4)]
                    best[t, last] = max(ways)
            got, t, last = 0.0, 0, 4
            place = {o: k for k, o in enumerate(lat.offsets)}
            for y, i, j in [*[(y, place[i], place[j]) for y, i, j in crf.entities(text, a, b)], (4, n, n)]:
                while t < i:
                    got, t, last = got + crf.follows[last, 4], t + 1, 4
                if y < 4:
                    c = np.flatnonzero((lat.starts == i) & (lat.starts + lat.sizes == j))[0]
                    got, t, last = got + crf.follows[last, y] + score[c, y], j, y
            assert got == pytest.approx(best[0, 4])


def plain_candidates(text, a, b):
    """Segments and features from the words of each segment, one by one."""
    words = [m[0] for m in pii._ATOM.finditer(text, a, b)]
    kinds = [pii._atom_kind(w) for w in words]
    out = []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + pii.MAX_ATOMS) + 1):
            own, of = words[i:j], kinds[i:j]
            runs = [w for w, k in zip(own, of) if k == 1]
            total, at_signs = sum(map(len, runs)), of.count(5)
            if of[0] not in (1, 2, 8, 9) or of[-1] not in (1, 2) or 4 in of or not (runs or at_signs) or not (total >= 4 or at_signs):
                continue
            longest, letters, groups = min(7, max(map(len, runs), default=0)), min(3, of.count(2)), min(7, len(runs))
            check = 1 + pii.luhn("".join(runs)) if 16 <= total <= 19 and not letters else 0
            quads = 1 + all(len(r) < 4 and int(r) <= 255 for r in runs) if len(runs) == 4 else 0
            signs = [str(min(9, len(w))) if k == 1 else "a" if k == 2 else w[0] for w, k in zip(own, of)]
            digest = sum(ord(c) * 131**p for p, c in enumerate(signs)) % 2048
            values = [
                min(total, 23), groups, min(at_signs, 3), min(5, of.count(6)), min(5, of.count(7)), min(5, of.count(3)), letters, min(3, of.count(15)) + (of[0] == 8), of[0] * 16 + of[-1],
                kinds[i - 1] if i else 0, kinds[j] if j < len(words) else 0, check, quads, longest, digest, (min(total, 23) * 37 + groups * 5 + longest) % 1024,
            ]
            out.append((i, j - i, [min(v, n - 1) + int(s) for v, n, s in zip(values, pii.SIZES, pii.STARTS)]))
    return out


ODD_TEXT = st.lists(st.sampled_from(["4111", "1111", "12", "7", "255", "4111111111111111", "00000000000000000000000000", " ", " ", "-", ".", "+", "(", ")", "@", "a", "net", "\n", "²³½", "é", "/", "٣"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(ODD_TEXT)
def test_features_are_those_of_the_words(text):
    for a, b in pii.zones(text):
        lat = pii.lattice(text, a, b)
        got = [] if lat is None else list(zip(lat.starts.tolist(), lat.sizes.tolist(), lat.features.tolist()))
        assert got == plain_candidates(text, a, b)


@settings(max_examples=60, deadline=None)
@given(ODD_TEXT)
def test_blocks_make_no_difference(crf, text):
    whole = [crf.entities(text, *z) for z in pii.zones(text)]
    held = pii.BLOCK_ATOMS
    try:
        for pii.BLOCK_ATOMS in (1, 3, 17):
            assert [crf.entities(text, *z) for z in pii.zones(text)] == whole
    finally:
        pii.BLOCK_ATOMS = held


LONG = """
import random, resource, sys, time
from voxsieve.llm import pii
rng, kind, size = random.Random(3), sys.argv[1], int(sys.argv[2])
crf = pii.train([], made=60, epochs=2)
text, parts, n = "", [], 0
while n < size:
    parts.append(f"mail u{rng.randint(0, 10**6)}@host{rng.randint(0, 99)}.org or " if kind == "addresses" else f"{rng.randint(0, 10 ** rng.randint(1, 9))} ")
    n += len(parts[-1])
text = "".join(parts)
before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
base = pii.base_spans(text)
found = pii.added_spans(text, base, crf)
print(len(base), len(found), time.process_time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


@pytest.mark.parametrize("kind", ["numbers", "addresses"])
def test_long_texts_take_linear_time_and_little_memory(kind):
    def run(size):
        out = subprocess.run([sys.executable, "-c", LONG, kind, str(size)], cwd=ROOT, check=True, capture_output=True, text=True).stdout
        return [float(x) for x in out.split()]

    short, long_ = run(250_000), run(1_000_000)
    assert long_[2] < 6 * short[2] + 2  # seconds of four times the text
    assert long_[3] < 150  # MB; in proportion, under 500 for 3 million characters
    assert long_[0] == pytest.approx(4 * short[0], rel=0.2, abs=4)


def test_gradient_is_the_slope():
    rng = random.Random(8)
    text, spans = next((t, s) for t, s in pii.made_up(rng, 50) if s and len(pii.zones(t)) == 1 and (lat := pii.lattice(t, *pii.zones(t)[0])) and pii._gold(lat, s))
    lat = pii.lattice(text, *pii.zones(text)[0])
    assert pii._gold(lat, spans)
    model = pii.SemiCrf(np.random.default_rng(0).normal(size=(pii.N_FEATURES, 4)) * 0.1, np.random.default_rng(1).normal(size=(5, 5)) * 0.1)
    g, ga = np.zeros_like(model.weights), np.zeros_like(model.follows)
    loss = lambda: model.gradient(lat, np.zeros_like(g), np.zeros_like(ga))
    model.gradient(lat, g, ga)
    for array, slope, places in ((model.weights, g, [(int(lat.features[0, 0]), 1), (int(lat.features[-1, 3]), 3)]), (model.follows, ga, [(4, 4), (4, spans[0][0]), (spans[0][0], 4)])):
        for p in places:
            array[p] += 1e-5
            up = loss()
            array[p] -= 2e-5
            down = loss()
            array[p] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(slope[p], abs=1e-4)


def test_pii_query_and_redaction(spark, data_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_pii(spark, data_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        base = plain_base(text or "")
        told = [f"{pii.KINDS[y]}:{a}:{b}" for y, a, b in base]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(y == k for y, _, _ in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(filter(None, r.spans.split(",")))


def plain_entities(text, model):
    """All ways to cut each zone into segments, scored one by one from the zone's end; (kind, start, end) of the best."""
    out = []
    for a, b in pii.zones(text):
        atoms = [m.span() for m in pii._ATOM.finditer(text, a, b)]
        by_start = {}
        for i, size, features in plain_candidates(text, a, b):
            by_start.setdefault(i, []).append((size, [sum(model.weights[f, y] for f in features) for y in range(4)]))
        best = {(len(atoms), last): (0.0, None) for last in range(5)}
        for t in range(len(atoms) - 1, -1, -1):
            ways = [(best[t + 1, 4][0], 4, 1)] + [(w[y] + best[t + size, y][0], y, size) for size, w in by_start.get(t, ()) for y in range(4)]
            for last in range(5):
                best[t, last] = max(((model.follows[last, y] + w, (y, size)) for w, y, size in ways), key=lambda x: x[0])
        t, last = 0, 4
        while t < len(atoms):
            y, size = best[t, last][1]
            if y < 4:
                out.append((y, atoms[t][0], atoms[t + size - 1][1]))
            t, last = t + size, y
    return out


def test_pii_query_adds_what_the_exhaustive_segmentation_adds(spark, data_dir, tmp_path):
    """Over the given documents, and some with entities that the base patterns miss or meet."""
    rng = random.Random(8)
    own = ["call (415) 555-0123 now", "card 4111.1111.1111.1111 ok, or 4111 1111 1111 1111", "a@b.co or x @ y . zz", "(415) 555-0123 and +1 (415) 555-0123\n10.0.0.1 is 10 . 0 . 0 . 1", *[t for t, _ in pii.made_up(rng, 60)]]
    given = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    given.unionByName(spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(own)], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = pii.fit(frame)
    got = {r.doc_id: r.spans for r in queries.op1_pii(spark, str(tmp_path)).collect()}
    added = 0
    for r in frame.collect():
        base = plain_base(r.text or "")
        more = [(y, a, b) for y, a, b in plain_entities(r.text or "", model) if all(b <= c or d <= a for _, c, d in base)]
        assert got[r.doc_id] == ",".join(f"{pii.KINDS[y]}:{a}:{b}" for y, a, b in sorted([*base, *more]))
        added += len(more)
    assert added


def test_pii_of_odd_rows(spark, crf):
    frame = spark.createDataFrame([(1, None, "k"), (None, "a@b.co 1.2.3.4", None), (2, "", "k"), (2, "é+1 (555) 555-0100", "k")], "doc_id long, text string, spans string")
    rows = pii.find(frame, crf, redact=True).collect()
    assert sorted((r.id or 0, [(s.kind, s.start, s.end) for s in r.spans], r.text) for r in rows) == [(0, [(0, 0, 6), (1, 7, 14)], "[EMAIL] [IP]"), (1, [], ""), (2, [], ""), (2, [(3, 1, 18)], "é[PHONE]")]
    assert pii.find(frame.limit(0), crf).collect() == []
    kept = pii.redact_column(frame, crf)
    assert kept.columns == frame.columns and sorted("-" if r.text is None else r.text for r in kept.collect()) == ["", "-", "[EMAIL] [IP]", "é[PHONE]"]


def held_out(rows, label, sf_dir, spark, share):
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    parts, rest = share
    own = [r for r in rows if r.doc_id in marks and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in rows)
    assert own and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == marks[r.doc_id] for r in own) / len(own)


def test_toxicity_on_held_out_labels(spark):
    rows = queries.op5_toxicity(spark, MIDDLE).collect()
    assert held_out(rows, "toxic", MIDDLE, spark, (5, 0)) > 0.9


def test_quality_on_held_out_labels(spark):
    rows = queries.op10_quality_votes(spark, MIDDLE).collect()
    assert held_out(rows, "quality", MIDDLE, spark, (4, 2)) > 0.95


def test_kernel_machine_is_one_table():
    """The table of triple weights gives what the kernel with the landmarks gives."""
    words = ["idiot", "i.d.i.o.t", "stupid", "thnt", "été", "x", "a1b2", "morronic"]
    alpha = np.random.default_rng(3).normal(size=3)
    machine = toxicity.Machine(toxicity._table(words[:3], alpha), 0.25, np.zeros(5))
    assert np.allclose(machine.words(words), toxicity.kernel_columns(words, words[:3]) @ alpha + 0.25, atol=1e-4)


def test_kernel_tolerates_gaps():
    near = toxicity.kernel_columns(["idxiot", "stuupid", "i d i o t".replace(" ", ".")], ["idiot", "stupid"])
    far = toxicity.kernel_columns(["hello", "window"], ["idiot", "stupid"])
    assert near[0, 0] > 3 * far[:, 0].max() and near[1, 1] > 3 * far[:, 1].max() and near[2, 0] > 0
    assert "idiot" in toxicity.units("You I D I O T, so") and "ab" not in toxicity.units("an a b!")


def test_models_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot idiot"), (3, "plain words here"), (3, "plain words here"), (4, "y" * 5000), (5, "!!! ???")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (9, 1, 1), (None, 0, 1), (4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    every = fold("id", 5) >= 0
    for module in (toxicity, quality):
        for marks in (labels, labels.limit(0)):
            model = module.fit(docs, marks, every)
            rows = module.score(docs, model).collect()
            assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.id == 3}) == 1
            assert module.score(docs.limit(0), model).collect() == []


def test_nearest_columns_keep_ties_in_order():
    cosines = np.array([[0.5, 0.9, 0.5, 0.1, 0.5], [0.2, 0.2, 0.2, 0.2, 0.2]])
    assert [sorted(r) for r in quality.Voters._nearest(cosines, 2).tolist()] == [[0, 1], [0, 1]]


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
    assert spark.range(1).select(F.lit(None).cast("long").alias("id")).select(fold("id", 5).alias("f")).first().f == 0


def test_spelled_out_words_with_marks_are_found():
    for text in ("you i. d. i. o. t. of a man", "you i. d. i. o. t. of no man", "You I, D, I, O, T, of a b", "you i d i o t"):
        assert "idiot" in toxicity.units(text), text
    assert "aaa" in toxicity.units("a a a") and toxicity.units("i. d. no i") == {"i", "d", "no"}


def test_long_words_have_shapes_to_their_end():
    known = quality.terms("a" * 300)
    for odd in ("a" * 150 + "0-" * 50 + "a" * 50, "a" * 200 + "$" * 40 + "a" * 60, "a" * 290 + "#" * 8 + "aa"):
        assert (quality.terms(odd) != known).any()
    assert (quality.terms("a" * 1000) != known).any()
    assert abs(quality.terms("aB" * 160).sum() - (5 + quality.terms("aB").sum() - 1)) < 1e-9


def test_repeated_label_rows_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * (k + 1)) for k in range(5)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(5) for _ in range(1 if k else 60)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    assert len(quality.fit(docs, marks, F.lit(True), rows=5).labels) == 5
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "train", lambda texts, labels: seen.extend(labels))
        toxicity.fit(docs, marks, F.lit(True), rows=5)
    assert sorted(seen) == [0, 0, 0, 1, 1]


def test_quality_query_is_the_plain_vote(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    voters = quality.fit(docs, labels, fold("id", 4) != 2)
    got = {r.doc_id: r.score for r in queries.op10_quality_votes(spark, data_dir).collect()}
    for d in docs.collect():
        own = quality.matrix([d.text or ""])[0] * voters.weights
        z = own @ voters.projection
        cosines = [float(z @ v) / max(float(np.linalg.norm(z)), 1e-9) for v in voters.vectors]
        near = sorted(range(len(cosines)), key=lambda k: (-cosines[k], k))[: quality.NEIGHBOURS]
        weight = [max(cosines[k], 0.01) ** quality.POWER for k in near]
        assert got[d.doc_id] == pytest.approx(sum(w * voters.labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight), abs=1e-3)


def test_words_and_their_ends_count():
    same = [quality.terms(t) for t in ("good plain text", "good other text", "good plain text")]
    assert (same[0] == same[2]).all() and (same[0] != same[1])[quality.LEXICAL :].any()
    assert same[0][quality.LEXICAL :].sum() == 9


def test_leading_vectors_are_those_of_the_decomposition():
    x = np.random.default_rng(2).normal(size=(60, 200)) * np.linspace(3, 0.1, 200)
    got = quality.leading(x, 5, rounds=60)
    want = np.linalg.svd(x)[2][:5].T
    assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-4)
    assert quality.leading(np.zeros((3, 4)), 2).shape[0] == 4


def test_toxicity_query_is_the_plain_kernel(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(docs, labels, fold("id", 5) != 0)
    got = {r.doc_id: r.score for r in queries.op5_toxicity(spark, data_dir).collect()}

    def value(word):
        c = [1, *map(toxicity._code, word), 2]
        spots = [(i, j, k) for i in range(len(c)) for k in range(i + 2, min(len(c), i + toxicity.SPAN)) for j in range(i + 1, k)]
        norm = sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, _, k in spots) ** 0.5 or 1
        return machine.bias + sum(machine.weights[(c[i] * 64 + c[j]) * 64 + c[k]] * toxicity.DECAY ** (k - i - 2) for i, j, k in spots) / norm

    for d in docs.orderBy("doc_id").limit(40).collect():
        values = [max(map(value, toxicity.pieces(w))) for w in toxicity.units(d.text or "")]
        counts = [min(toxicity.MOST, sum(1 / (1 + np.exp(-10 * (v - level))) for v in values)) for level in toxicity.LEVELS]
        x = float(np.dot([*counts, np.log1p(max(len(values), toxicity.SHORT)), 1.0], machine.link)) if machine.rate is None else 0
        assert got[d.doc_id] == pytest.approx(1 / (1 + np.exp(-x)) if machine.rate is None else machine.rate, abs=1e-3)


def test_long_and_clashing_rows_score(spark):
    rows = [(1, "plain words " * 5000, 1), (2, "idiot " + "x" * 60_000, 2), (3, "", 3)]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, id long, word string, score double")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, toxic int, quality int")
    for module in (toxicity, quality):
        got = module.score(docs, module.fit(docs, labels, F.lit(True), chars=100_000)).collect()
        assert sorted(r.id for r in got) == [1, 2, 3]


def test_pii_spans_of_long_texts_and_their_recall(spark, crf):
    """Added spans on numbers that the training text has no form of, and a long text through the frame."""
    rng = random.Random(99)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"reach me on {t} any day" for t in (f"({d(3)}) {d(3)}-{d(4)}" for _ in range(60))]
    texts += [f"ring {d(3)}-{d(3)}-{d(4)}, ask for Ann" for _ in range(60)]
    found = sum(any(y == 3 for y, _, _ in pii.added_spans(t, pii.base_spans(t), crf)) for t in texts)
    assert found >= 0.9 * len(texts)
    frame = spark.createDataFrame([(1, "word " * 40_000 + "a@b.co and (415) 555-0123 end")], "doc_id long, text string")
    (row,) = pii.find(frame, crf).collect()
    assert [(s.kind, s.start) for s in row.spans] == [(0, 200_000), (3, 200_011)]
