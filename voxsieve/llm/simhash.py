"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in two bits at most agree in at least two
blocks, so they share one of six keys of two blocks. Distinct fingerprints are joined on the keys, and the Hamming distance
of each pair is verified. A key with very many fingerprints isn't joined, as that would pair all its members: its members
are linked through their one-bit neighbours, which is exact as well (two fingerprints differ in two bits at most just when
some value is within one bit of both) and linear. Links then grow together to components by hooking and shortcutting.

Defined results: null and empty texts have the fingerprint zero and link like any other. Exact copies share one fingerprint
and are never paired. A component is named by its smallest id; null ids are named too but never name one, unless no row of the
component has an id. Repeated rows are rows of their own. Texts of any length are read whole; an empty table gives no rows.
Columns besides id and text aren't read, so their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, bounded_batches, pick_rows, quoted, released, removed, written

BLOCKS, BLOCK_BITS, DISTANCE = 4, 16, 2
#: Members up to which a key is joined pair by pair; keys with more are linked through neighbours.
JOINED = 64
#: Fixed value: the seed of the shingle hash.
SEED = 42

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' hashes; as a signed number."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, fp, size): one row per document. No shuffle; row numbers the rows of docs as they are read, size is the text's octets."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("id"), as_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pc.binary_length(batch.column(2)).cast(pa.int64())], names=["row", "id", "fp", "size"])

    return rows.mapInArrow(released(run), f"row long, id {id_type}, fp long, size long")


def keyed(prints: DataFrame) -> DataFrame:
    """(fp, pair, key): the six keys of each fingerprint."""
    block = lambda k: F.shiftrightunsigned("fp", BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1)
    keys = [F.struct(F.lit(n).alias("pair"), F.shiftleft(block(a), BLOCK_BITS).bitwiseOR(block(b)).alias("key")) for n, (a, b) in enumerate(combinations(range(BLOCKS), 2))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.key")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect whatever lies within the distance."""
    rows = keyed(prints)
    crowded, _ = written(rows.groupBy("pair", "key").agg(F.count("*").alias("n")).where(F.col("n") > JOINED).select("pair", "key"), "simhash-crowded")
    few = rows.join(crowded, ["pair", "key"], "left_anti")
    other = few.select(F.col("fp").alias("other"), F.col("pair").alias("p2"), F.col("key").alias("k2"))
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    joined = few.join(other, (F.col("pair") == F.col("p2")) & (F.col("key") == F.col("k2")) & (F.col("fp") < F.col("other")) & (differing <= DISTANCE)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = rows.join(crowded, ["pair", "key"], "left_semi").select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    near = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("via"))
    # at most 65 fingerprints are within one bit of a value
    stars = near.groupBy("via").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return joined.unionByName(stars.select("a", F.explode("all").alias("b")).where("a <> b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: the smallest node of its component.

    Each round every node hooks on to the smallest node next to it, labels are followed to their end, and the edges are drawn
    between labels, each once and none within a label, so that a group linked many times over is gone after the first round. At
    least half of the linked labels go each time. Every round is a written table, so its lineage is short.
    """
    spark = edges.sparkSession
    live, live_at = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-edges")
    labels = at = None
    while labels is None or not live.isEmpty():
        up, up_at = _rooted(live)
        low, high = (up.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        between = live.join(low, "a").join(high, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        drawn, drawn_at = written(between, "simhash-edges")
        removed(spark, live_at)
        live, live_at = drawn, drawn_at
        if labels is None:
            labels, at = up, up_at
            continue
        # a label that meets no other any more stays
        above = up.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved, moved_at = written(labels.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "simhash-labels")
        for p in (at, up_at):
            removed(spark, p)
        labels, at = moved, moved_at
    removed(spark, live_at)
    return labels


def _rooted(live: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) and its path: where one comes to from a node by going on to the smallest neighbour, as long as that is smaller."""
    labels, at = written(live.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "simhash-labels")
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped, jumped_at = written(labels.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") < F.col("label")).alias("moved")), "simhash-labels")
        removed(live.sparkSession, at)
        labels, at = jumped.drop("moved"), jumped_at
        if not jumped.where("moved").limit(1).count():
            return labels, at


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, fp, size, component, first_row): component is the smallest id reachable, first_row the row that bears it; size is the text's octets."""
    prints, _ = written(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("first")
    distinct, _ = written(prints.groupBy("fp").agg(first), "simhash-distinct")
    labels = components(links(distinct.select("fp")))
    # only fingerprints with links need a component; the others stand alone with their copies
    linked, _ = written(distinct.join(labels.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    named, _ = written(linked.groupBy("label").agg(F.min("first").alias("named")), "simhash-named")
    of_print = distinct.join(linked.join(named, "label").select(F.col("fp"), "named"), "fp", "left").select("fp", F.coalesce("named", "first").alias("c"))
    of_print, _ = written(of_print, "simhash-components")
    return prints.join(of_print, "fp").select("row", "id", "fp", "size", F.col("c.id").alias("component"), F.col("c.row").alias("first_row"))


def keep_first(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component the row with the smallest id. docs must read alike each time, as a table does."""
    groups, _ = written(near_duplicates(docs, shingle, id_col, text_col).select("row", "size", "first_row"), "simhash-groups")
    return pick_rows(docs, groups.where("row = first_row").select("row"), groups, text_col).drop("__row")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
