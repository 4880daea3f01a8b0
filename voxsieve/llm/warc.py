"""WARC archives with revisit resolution.

Pages that carry the same payload are stored once: headers are shuffled by payload digest to find each digest's original,
every other page becomes a revisit record that names it, and all records get fresh headers. Payloads are never shuffled: what
the headers say comes back as a table by reading partition, of which the task that reads the pages again takes its own part.
Reading back joins revisit records to their originals by record id, which restores each page's payload.

Archives are written by Spark's text writer, gzipped as a whole, and read by lines, so one task reads a file as a stream,
whatever its size, and a lost task is simply run again. A record's end is found by its Content-Length; what follows must be
the end of a record, or reading fails.

Defined results: a null payload is the empty payload, a null URL leaves its header out, and line breaks in a URL become
spaces. Of equal payloads (empty ones too) the smallest page id is the original; rows that repeat that id are all responses,
and revisits name one of them. A page id that repeats with another payload belongs to both groups. Null ids come last: they
revisit an original that has an id, and are responses if no row of the group has one. Payloads may hold anything, record
separators included. Record ids are unique. Payloads are taken for equal by their SHA-1. Other columns aren't read. Pages
whose rows move from one reading to the next raise RuntimeError.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, quoted, released, removed, tell, told, written

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP heads of a stored page and of a page whose payload is stored elsewhere.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_END = "\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: Column, digest: Column, row: Column) -> Column:
    """A record's URN: a UUID by name, so that writing the same table again gives the same ids."""
    h = F.md5(F.concat_ws("\n", F.coalesce(page, F.lit("")), digest, row.cast("string")).cast("binary"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


#: For the sum by which a task knows the rows that it read before.
_MODULUS = 1_000_000_007


def find_originals(rows: DataFrame, at: str) -> None:
    """Tell each reading partition the originals of its payloads that occur again, and the number and a sum of its own rows.

    rows has row (its partition's number above 33 bits of place), page, url and payload. A frequent payload is one header a
    partition from the first step on.
    """
    heads = rows.select(F.shiftright("row", 33).alias("part"), "row", "page", "url", F.sha1("payload").alias("digest"))
    place = F.col("row").bitwiseAND((1 << 33) - 1) + 1
    check = F.pmod(F.conv(F.substring("digest", 1, 7), 16, 10).cast("long") * place, F.lit(_MODULUS))
    first = F.min(F.struct(F.col("page").isNull().alias("none"), F.col("page"), F.col("row"), F.col("url"))).alias("first")
    heads, heads_at = written(heads.groupBy("part", "digest").agg(first, F.count("*").alias("n"), F.sum(check).alias("check")), "warc-heads")
    again = heads.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    again, again_at = written(again.select("digest", "first"), "warc-originals")  # so that Spark may split a frequent digest
    found = heads.select("part", "digest").join(again, "digest").select("part", "digest", F.col("first.page").cast("string").alias("o_page"), F.col("first.row").alias("o_row"), F.col("first.url").alias("o_url"), F.lit(0).cast("long").alias("check"))
    own = heads.groupBy("part").agg(F.sum("n").alias("o_row"), F.sum("check").alias("check"))
    own = own.select("part", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("o_page"), "o_row", F.lit(None).cast("string").alias("o_url"), "check")
    tell(found.unionByName(own), at, "digest")
    for path in (heads_at, again_at):
        removed(rows.sparkSession, path)


def with_originals(rows: DataFrame, at: str) -> DataFrame:
    """rows with the base32 digest, and for revisits the original's page, row and URL in place of the payload. No shuffle."""
    spark = rows.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, n, check = None, {}, 0, 0
        want = (0, 0)
        for batch in batches:
            numbers, pages, payloads = (batch.column(k).to_pylist() for k in (0, 1, 3))
            if part is None and numbers:
                part = numbers[0] >> 33
                table = told(at, part, ["digest", "o_page", "o_row", "o_url", "check"])
                for r in table.to_pylist() if table is not None else []:
                    if r["digest"] is None:
                        want = (r["o_row"], r["check"])
                    else:
                        known[r["digest"]] = (r["o_page"], r["o_row"], r["o_url"])
            digests, kept, firsts = [], [], []
            for row, page, payload in zip(numbers, pages, payloads, strict=True):
                raw = hashlib.sha1(payload)
                name = raw.hexdigest()
                n, check = n + 1, check + int(name[:7], 16) * ((row & ((1 << 33) - 1)) + 1) % _MODULUS
                first = known.get(name)
                revisit = first is not None and first[0] != page
                digests.append(base64.b32encode(raw.digest()).decode())
                kept.append(None if revisit else payload)
                firsts.append(first if revisit else (None, None, None))
            o = list(zip(*firsts, strict=True)) or [(), (), ()]
            columns = [*(batch.column(k) for k in (0, 1, 2)), pa.array(kept, pa.binary()), pa.array(digests, pa.string()), pa.array(o[0], pa.string()), pa.array(o[1], pa.int64()), pa.array(o[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "page", "url", "payload", "digest", "o_page", "o_row", "o_url"])
        if (n, check) != want:
            raise RuntimeError("the pages read differently than before: pass a table, not a plan whose rows move")

    return rows.withColumn("page", F.col("page").cast("string")).mapInArrow(released(run), "row long, page string, url string, payload binary, digest string, o_page string, o_row long, o_url string")


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> None:
    """Write one record per page under out, as gzipped WARC files. pages must read alike each time, as a table does."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(quoted(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("page"), F.regexp_replace(quoted(url_col).cast("string"), "[\r\n]+", " ").alias("url"), payload.alias("payload"))
    at = new_path(pages.sparkSession, "warc-told")
    find_originals(rows, at)
    rows = with_originals(rows, at)
    revisit = F.col("payload").isNull()
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("payload").cast("string")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        line("WARC-Record-ID", record_id(F.col("page"), F.col("digest"), F.col("row"))),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("o_page"), F.col("digest"), F.col("o_row")))),
        F.when(revisit, line("WARC-Refers-To-Target-URI", F.col("o_url"))),
        line("X-Page-ID", F.col("page")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block)),
    )
    rows.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("record")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(out)
    removed(pages.sparkSession, at)


def parsed(lines: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in a stream of lines, their line feeds left out. Raises ValueError where one doesn't end as it says."""
    head: list[bytes] = []
    parts: list[bytes] | None = None
    fields: dict[str, str] = {}
    need = have = 0
    for line in lines:
        if parts is None:
            if line != b"\r":
                head.append(line)
                continue
            fields = dict(x.decode().rstrip("\r").split(": ", 1) for x in head[1:] if b": " in x)
            need, have, parts = int(fields["Content-Length"]) + len(RECORD_END), 0, []
            continue
        parts.append(line)
        have += len(line) + 1
        if have >= need:
            block = b"\n".join(parts) + b"\n"
            if have > need or not block.endswith(RECORD_END.encode()):
                raise ValueError(f"record {fields.get('WARC-Record-ID')} doesn't end where its length says")
            yield fields, block[: -len(RECORD_END)]
            head, parts = [], None
    if head or parts is not None:
        raise ValueError("the archive ends inside a record")


def read_records(spark: SparkSession, out: str, with_payload: bool = False) -> DataFrame:
    """The records as stored: record_id, page, type, url, digest (of the payload read, or as the revisit states it), refers, payload_bytes, payload."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(out).select(F.col("value").cast("binary").alias("line"))
    names = ["record_id", "page", "type", "url", "digest", "refers", "payload_bytes", "payload"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return batch

        held = 0
        for fields, block in parsed(line for batch in batches for line in batch.column(0).to_pylist()):
            payload = block.partition(b"\r\n\r\n")[2]
            revisit = fields["WARC-Type"] == "revisit"
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
            rows.append((fields["WARC-Record-ID"], fields.get("X-Page-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"), digest, fields.get("WARC-Refers-To"), None if revisit else len(payload), payload if with_payload and not revisit else None))
            held += len(payload) * with_payload + 300
            if held > 8 << 20:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return lines.mapInArrow(released(run), "record_id string, page string, type string, url string, digest string, refers string, payload_bytes long, payload binary")


def resolve(records: DataFrame) -> DataFrame:
    """Records with each revisit's payload figures and original page taken from the response it refers to."""
    records, _ = written(records, "warc-records")
    kept = records.where("type = 'response'").select(F.col("record_id").alias("k_id"), F.col("page").alias("k_page"), F.col("payload_bytes").alias("k_bytes"), F.col("payload").alias("k_payload"))
    joined = records.where("type = 'revisit'").join(kept, F.col("refers") == F.col("k_id"), "left")
    again = joined.select("record_id", "page", "type", "url", "digest", F.col("k_page").alias("refers_to"), F.col("k_bytes").alias("payload_bytes"), F.col("k_payload").alias("payload"))
    return records.where("type = 'response'").select("record_id", "page", "type", "url", "digest", F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload").unionByName(again)
