import base64
import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tests.llm.oracle import same_rows
from voxsieve.llm import queries, sql, topk, warc


def test_warc_query_matches_sql(spark, data_dir):
    same_rows(queries.op7_warc_revisits(spark, data_dir), data_dir, sql.OP7)


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    nasty = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    pages = [(3, "u3", nasty), (1, "u1\r\nX: y", nasty), (2, None, None), (5, "u5", ""), (None, "n", ""), (7, "u7", "only\r\n\r\nWARC/1.1\r\n"), (None, "m", "lone"), (8, "u8", "twin"), (8, "u8", "twin"), (9, "é", "日本" * 4000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    out = f"file://{tmp_path}/w"
    warc.write_archives(frame, out)
    rows = warc.resolve(warc.read_records(spark, out, with_payload=True)).collect()
    assert len(rows) == len(pages)
    found = sorted((r.page or "", r.type, r.refers_to or "", bytes(r.payload).decode(), r.payload_bytes, r.digest) for r in rows)
    want = []
    for i, _, html in pages:
        body = html or ""
        group = [j for j, _, h in pages if (h or "") == body and j is not None]
        first = min(group, default=None)
        again = first is not None and i != first
        want.append(("" if i is None else str(i), "revisit" if again else "response", str(first) if again else "", body, len(body.encode()), base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()))
    assert found == sorted(want)
    warc.write_archives(frame.limit(0), out + "0")
    assert warc.resolve(warc.read_records(spark, out + "0")).collect() == []


def test_large_archives_keep_every_record(spark, tmp_path):
    """Payloads that end in every beginning of what stands between records, in files of many read buffers."""
    between = "\r\n\r\nWARC/1.1\r\n"
    n = 120_000
    tail = F.concat(*[F.when(F.col("id") % len(between) == k, F.lit(between[:k])).otherwise(F.lit("")) for k in range(len(between))])
    frame = spark.range(n, numPartitions=3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.md5(F.col("id").cast("string").cast("binary")), (F.col("id") % 20 + 5).cast("int")), tail).alias("html"))
    frame.write.parquet(f"{tmp_path}/pages")
    frame = spark.read.parquet(f"{tmp_path}/pages")
    out = f"file://{tmp_path}/w"
    warc.write_archives(frame, out)
    got = warc.read_records(spark, out, with_payload=True).withColumn("html", F.col("payload").cast("string"))
    assert got.agg(F.count("*"), F.countDistinct("record_id"), F.sum("payload_bytes")).first() == (n, n, frame.agg(F.sum(F.octet_length("html"))).first()[0])
    assert got.join(frame, (got.page == frame.page_id.cast("string")) & got.html.eqNullSafe(frame.html)).count() == n


def test_a_payload_of_separators_and_one_long_line(spark, tmp_path):
    pages = [(1, "u", "\r\n\r\nWARC/1.1\r\n" * 100_000), (2, "u", "x" * 9_000_000), (3, "u", "\n"), (4, "u", "\r"), (5, "u", "\r\n\r")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    out = f"file://{tmp_path}/w"
    warc.write_archives(frame, out)
    got = warc.read_records(spark, out, with_payload=True).collect()
    assert sorted((int(r.page), r.url, bytes(r.payload).decode()) for r in got) == pages


def test_records_that_do_not_end_as_they_say_are_an_error():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    lines = lambda raw: raw.removesuffix(b"\n").split(b"\n")
    assert [b for _, b in warc.parsed(lines(record + record))] == [b"abc", b"abc"]
    for bad in (record.replace(b"3", b"2"), record.replace(b"3", b"4"), record[:-4], record + record[:20]):
        with pytest.raises(ValueError):
            list(warc.parsed(lines(bad)))


def test_page_ids_that_repeat_with_other_payloads(spark, tmp_path):
    pages = [(1, "u", "aa"), (1, "u", "bbb"), (1, "w", "bbb"), (2, "v", "bbb"), (3, "w", "aa"), (3, "x", "aa"), (3, "x", "c"), (3, "x", "c")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    frame.write.parquet(f"{tmp_path}/pages")
    out = f"file://{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages"), out)
    rows = warc.resolve(warc.read_records(spark, out, with_payload=True)).collect()
    assert len({r.record_id for r in rows}) == len(pages)
    first = {h: min(i for i, _, g in pages if g == h) for _, _, h in pages}
    want = sorted((i, u, h, "response" if i == first[h] else "revisit", None if i == first[h] else str(first[h])) for i, u, h in pages)
    assert sorted(((int(r.page), r.url, bytes(r.payload).decode(), r.type, r.refers_to) for r in rows), key=repr) == sorted(want, key=repr)


def test_payloads_are_not_shuffled(spark, tmp_path):
    """Shuffled bytes of the headers alone, with broadcasts off."""
    spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("word "), 4000), (F.col("id") % 150).cast("string")).alias("html")).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").alias("page"), "url", F.col("html").cast("binary").alias("payload"))
        warc.find_originals(rows, f"file://{tmp_path}/told")
        plan = warc.with_originals(rows, f"file://{tmp_path}/told")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        told = spark.read.parquet(f"{tmp_path}/told").where("digest is not null")
        assert told.where("digest is not null").select("digest").distinct().count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pages_that_move_are_an_error(spark, tmp_path):
    rows = spark.range(40, numPartitions=2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.udf(lambda: uuid.uuid4().hex).asNondeterministic()().alias("html"))
    with pytest.raises(Exception, match="read differently"):
        warc.write_archives(rows, f"file://{tmp_path}/w")


def test_top_k_query_matches_sql(spark, data_dir):
    same_rows(queries.op9_exact_top_k(spark, data_dir), data_dir, sql.OP9)


@pytest.mark.parametrize("blocks", [(2, 3), (100, 100)])
def test_top_k_of_odd_vectors(spark, blocks):
    rows = [(0, [1.0, -2.0]), (100, [0.5]), (200, None), (300, [math.nan, 1.0]), (400, []), (1, [1.0, -2.0]), (2, [1.0, -2.0]), (2, [1.0, -2.0]), (3, [None, 1.0]), (4, [math.inf]), (None, [9.0, 9.0]), (5, [0.0, 0.0]), (0, [3.0, 1.0]), (100, [4.0, 7.0]), (100, [0.5]), (600, [-1.0, 0.0]), (600, [-1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(frame, F.col("vec_id") % 100 == 0, k=4, query_block=blocks[0], candidate_block=blocks[1]).collect()
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n_row, (i, v) in enumerate(sound):
        if i is not None and i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0) for n_other, (j, w) in enumerate(sound) if n_other != n_row)
            want += [(i, n + 1, None if gone else j, -s) for n, (s, gone, j) in enumerate(scored[:4])]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []
