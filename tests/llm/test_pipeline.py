"""The pipeline's stages against what the operators say row by row."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_duplicates import plain_print
from tests.llm.test_resemblance import plain_links, roots
from voxsieve.llm import pii, quality
from voxsieve.llm.common import fold


def test_run_matches_a_plain_version(spark, data_dir):
    frame = spark.read.parquet(f"{data_dir}/documents.parquet")
    voters = quality.fit(frame, spark.read.parquet(f"{data_dir}/labels.parquet"), fold("id", 4) != 2)
    docs = [(r.doc_id, r.text or "") for r in frame.collect()]
    scores = voters.vote([t for _, t in docs])
    docs = [d for d, s in zip(docs, scores, strict=True) if s >= 0.7]
    prints = [plain_print(t) for _, t in docs]
    near = [(a, b) for b in range(len(docs)) for a in range(b) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    groups = {}
    for (i, _), g in zip(docs, roots(len(docs), near + plain_links([t for _, t in docs])), strict=True):
        groups.setdefault(g, []).append(i)
    docs = [d for d in docs if d[0] in {min(g) for g in groups.values()}]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    docs = [d for d, (_, n, hit, _) in zip(docs, brute(docs, items), strict=True) if not (hit and 20 * hit >= n)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, data_dir).collect()}
    assert sorted(got) == sorted(i for i, _ in docs) and 0 < len(got) < frame.count()
    for i, text in docs:
        found = library.decode(np.frombuffer(got[i].ids, "<u4").tolist(), skip_special_tokens=False)
        base = pii.base_spans(text)
        if not pii.zones(text):
            assert found == text
        for _, a, b in base:
            assert text[a:b] not in found


def test_stages_keep_columns_and_take_odd_rows(spark, data_dir, tmp_path):
    rows = [(1, None, "en", None, None), (None, "", None, "s", 0), (None, None, None, None, None), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "call +1 (555) 555-0100 or x@y.zz", "en", "s", 32), (5, "w " * 30_000, "en", "s", 60_000)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, id int, row int, score double, fp long"
    for n, own in enumerate((rows, [])):
        docs = spark.createDataFrame([(*r, 1, 2, 3.0, 4) for r in own], shape)
        for name, stage in corpus_pipeline.STAGES:
            docs.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            out = stage(spark, docs, data_dir)
            assert name == "bpe" or out.schema == docs.schema
            docs = out
        assert docs.count() <= len(own)


def test_which_odd_rows_stay(spark, data_dir):
    """Every stage on rows of its own: nulls, empty and very long texts, repeated rows and ids, one short document."""
    rows = [(1, None), (None, ""), (None, None), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "call +1 (555) 555-0100 or x@y.zz"), (5, "w " * 30_000), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").checkpoint()
    stages = dict(corpus_pipeline.STAGES)
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=order)
    voters = quality.fit(docs, spark.read.parquet(f"{data_dir}/labels.parquet"), fold("id", 4) != 2)
    scores = voters.vote([t or "" for _, t in rows])
    assert found(stages["quality"](spark, docs, data_dir)) == sorted((r for r, s in zip(rows, scores, strict=True) if s >= 0.7), key=order)
    assert found(stages["near_dedup"](spark, docs, data_dir)) == sorted([rows[0], rows[3], rows[5], rows[6], rows[7]], key=order)
    assert found(stages["decontaminate"](spark, docs, data_dir)) == sorted(rows, key=order)
    assert found(stages["pii"](spark, docs, data_dir)) == sorted([r if r[0] != 4 else (4, "call [PHONE] or [EMAIL]") for r in rows], key=order)
    ids = {(r.doc_id, r.n_tokens, len(r.ids)) for r in stages["bpe"](spark, docs, data_dir).collect()}
    assert {(i, n) for i, n, _ in ids if n == 0} == {(1, 0), (None, 0)} and all(size == 4 * n for _, n, size in ids) and {i for i, _, _ in ids} == {None, 1, 3, 4, 5}
    for text in ("x y", "", None):
        one = spark.createDataFrame([(6, text, "en", "s", 3)], docs.schema)
        for name in ("near_dedup", "decontaminate", "pii"):
            assert found(stages[name](spark, one, data_dir)) == [(6, text)]
