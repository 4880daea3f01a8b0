"""BPE against the tokenizers library, and packing against its own definition."""

import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxsieve.llm import bpe, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATH)
SPECIAL = "<|endoftext|>"


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    mine = bpe.coder(PATH).encode(text)
    assert mine.tolist() == ids, repr(text)
    assert bpe.coder(PATH).decode(mine) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aeithnrs 019.,!'\n\t", "  ", "'ll", "é", "日", "\u0085", "\x1c", "　", "😀", "՘", SPECIAL, " the", "tion"]), max_size=40).map("".join))
def test_random_texts_encode_as_the_library(text):
    same(text)


def test_every_code_point_class(spark):
    rng = random.Random(3)
    for _ in range(400):
        same("".join(chr(c) + rng.choice(["", " ", "a", "1"]) for c in (rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]) for _ in range(12))))


def test_long_words_and_repetitions():
    for text in ("a" * 50_000, " " * 9_000 + "x", "ab" * 20_000, "\n" * 5000, "tiontion" * 3000, "!" * 7777):
        same(text)


def test_encode_frame_handles_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "hi there", None), (2, "hi there", "z")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.id or 0, r.n_tokens, r.text) for r in rows) == [(0, 2, "hi there"), (1, 0, ""), (2, 0, ""), (2, 2, "hi there")]
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_query_matches_library(spark, data_dir):
    got = {r.doc_id: r for r in queries.op6_byte_bpe(spark, data_dir).collect()}
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(capacity - n)
    return sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit_decreasing(case):
    capacity, lengths = case
    rows = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(p for row in rows for p in row) == list(range(len(lengths)))
    assert sorted(capacity - sum(lengths[p] for p in row) for row in rows) == plain_best_fit(lengths, capacity)


def test_packing_is_lossless(spark, tmp_path):
    texts = [(k, " ".join(["tion the of"] * (k % 7 * 11))) for k in range(60)] + [(None, "lone"), (5, None), (7, "word " * 500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    out = f"file://{tmp_path}/packed"
    wrote = packing.write_packed(docs, RANKS, out, row_tokens=64, pool_tokens=900).collect()
    rows = packing.read_packed(spark, out).collect()
    assert sum(r.n_rows for r in wrote) == len(rows)
    found = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.cu_seqlens[-1] <= 64 and r.resets == r.cu_seqlens[:-1]
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found.setdefault(d, []).append((start, ids[a:b].tolist()))
    want = {}
    for d, t in texts:
        ids = packing.rank_coder(RANKS).encode_ordinary(t or "")
        for at in range(0, len(ids), 64):
            want.setdefault(None if d is None else str(d), []).append((at, ids[at : at + 64]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.write_packed(docs.limit(0), RANKS, out + "0").collect() == []


def test_packing_query_holds_every_token(spark, data_dir):
    docs = {str(r.doc_id): packing.rank_coder(RANKS).encode_ordinary(r.text or "") for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    seen = {i: 0 for i in docs}
    for r in queries.op4_pack_tokens(spark, data_dir).collect():
        ids = []
        for i, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            ids += docs[str(i)][start : start + b - a]
            seen[str(i)] += b - a
        assert r.n_tokens == len(ids) <= packing.ROW_TOKENS and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert seen == {i: len(t) for i, t in docs.items()}


def test_packing_of_text_ids_repeats_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two", 1), ("a", "one two", 1), (None, "three", 2), ("b", None, 3)], "doc_id string, text string, ids int")
    out = f"file://{tmp_path}/p"
    packing.write_packed(docs, RANKS, out, row_tokens=8).collect()
    held = [i for r in packing.read_packed(spark, out).collect() for i in r.doc_ids]
    assert sorted(held, key=repr) == ["a", "a", None]
