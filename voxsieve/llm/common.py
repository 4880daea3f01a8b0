"""Helpers shared by the corpus operators: table reads, lineage cuts and batch limits."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that a Python worker's memory doesn't follow the text length.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches stay small whatever the length of a text. The session's own limits are lowered to these, never raised."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which goes on to other tasks, gives back the memory that it no longer uses."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Lists of the intermediate paths made in each open scratch() block.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/voxsieve-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables that were made inside. What is computed from them must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            removed(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage by a Parquet table in the shared folder; returns the table read back and its path."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tell(rows: DataFrame, at: str, *order: str) -> None:
    """Write what the tasks of a later pass must know: a folder for each value of the column part, in small row groups."""
    rows.repartition("part").sortWithinPartitions("part", *order).write.partitionBy("part").option("parquet.block.size", 1 << 20).parquet(at)


def told(at: str, part: int, columns: list[str], filters: list | None = None) -> pa.Table | None:
    """One part's rows of what tell() wrote, or none. Row groups that the filters rule out are passed over."""
    store, base = pafs.FileSystem.from_uri(f"{at}/part={part}")
    found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    parts = [pq.read_table(f.path, filesystem=store, columns=columns, filters=filters, partitioning=None) for f in found if f.path.endswith(".parquet")]
    return pa.concat_tables(parts) if parts else None


def fold(column: str, parts: int) -> Column:
    """crc32 of the id's text modulo parts; an absent id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def quoted(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(column: str) -> Column:
    """A text column with nulls read as the empty text."""
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def hash_sample(rows: DataFrame, keys: list[Column], size: int) -> DataFrame:
    """The first so many rows by a hash of the keys.

    Rows are thinned by the hash before they are ordered, so that not every task sends so many rows to the driver.
    """
    h = F.xxhash64(*keys)
    thin = rows.count() // (3 * size)
    if thin > 1:
        rows = rows.where(F.pmod(h, F.lit(thin)) == 0)
    return rows.orderBy(F.xxhash64(F.lit(1), h), *keys).limit(size)


def through(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows passed whole through run, which keeps, changes or drops them but not their columns. No shuffle."""
    numbered = rows.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(rows.columns)])
    return numbered.mapInArrow(released(run), numbered.schema).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(rows.columns)])


#: For the sums by which a task knows the rows that it read before.
_MODULUS = 1_000_000_007
PLACE_BITS = 33


def numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): row is the reading partition's number above 33 bits of place in it."""
    return docs.select(F.monotonically_increasing_id().alias("row"), as_text(text_col).alias("text"))


def pick_rows(docs: DataFrame, picked: DataFrame, every: DataFrame, text_col: str) -> DataFrame:
    """docs with the column __row, its numbered() row, for the rows in picked (row). No row of docs is shuffled.

    Each reading partition is told which of its rows are picked. every (row, size) has the octet length of every text as it was
    read before; a partition that reads otherwise now raises RuntimeError.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at, part = new_path(spark, "picked"), F.shiftright("row", PLACE_BITS).alias("part")
    place = F.col("row").bitwiseAND((1 << PLACE_BITS) - 1)
    check = F.sum(F.pmod((F.col("size") + 1) * (place + 1), F.lit(_MODULUS))).alias("check")
    sums = every.groupBy(part).agg(F.lit(None).cast("long").alias("row"), F.count("*").alias("n"), check)
    tell(picked.select(part, "row", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("check")).unionByName(sums), at, "row")
    text_at = docs.columns.index(text_col) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, want, n, check = None, (0, 0), 0, 0
        for batch in batches:
            rows = batch.column(0).to_numpy()
            if wanted is None and len(rows):
                table = told(at, int(rows[0]) >> PLACE_BITS, ["row", "n", "check"])
                own = table.filter(pc.is_null(table["row"])) if table is not None else None
                want = (own["n"][0].as_py(), own["check"][0].as_py()) if own else want
                wanted = np.sort(table["row"].drop_null().to_numpy()) if table is not None else np.empty(0, np.int64)
            sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            n, check = n + len(rows), check + int(((sizes + 1) * ((rows & ((1 << PLACE_BITS) - 1)) + 1) % _MODULUS).sum())
            if len(rows):
                found = np.minimum(np.searchsorted(wanted, rows), max(0, len(wanted) - 1))
                yield batch.filter(pa.array(wanted[found] == rows if len(wanted) else np.zeros(len(rows), bool)))
        if (n, check) != want:
            raise RuntimeError("the documents read differently than before: pass a table, not a plan whose rows move")

    kept = [quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    kept[text_at - 1] = quoted(text_col).cast("string").alias(f"c{text_at - 1}")
    with_row = docs.select(F.monotonically_increasing_id().alias("row"), *kept)
    return with_row.mapInArrow(released(run), with_row.schema).select(F.col("row").alias("__row"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
