"""Conversation prefix trie by truncation peeling.

Every conversation is rebuilt from the opening of a donor and its own later turns. Prefixes are known by 124-bit sums of their
turns' hashes, each mixed with its place, so the prefixes of one conversation come from a running sum, also where it is cut
into chunks. Equal conversations are merged first; a merged one is a class, named by its smallest conversation.

Peeling goes down from the greatest depth. What of a class is deeper than any other class reaches with it is a chain of
nodes with the same members, which needs no grouping: its nodes are read off the class's own turns. Below that, the nodes of
depth d are the groups of what survives from depth d + 1, stripped of its last turn, and of the classes that end at d; one
grouping finds a depth's nodes and adds up children, leaves, members and saved tokens. A depth's nodes are a written table, so
the plan stays short and a lost executor repeats one depth. Depths are as many as the longest beginning that two different
conversations share.

Defined results: null roles and texts are empty; turns of one conversation are ordered by turn (null first), role and text,
and rows that repeat count as often as they stand there. Rows without a conversation id belong to none. Long conversations are
ranked and summed in chunks, so none has to fit into a task. A donor of c is c less what
c divided by a hundred leaves (toward zero). Donors that are absent lend no turns; a conversation may be left
without any and then ends at the root. An empty table has no nodes, not even a root. Columns besides the four aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, quoted, released, removed, written

#: A donor serves so many conversations and lends fewer turns than this; turns of a chunk; ids of a piece of a digest's input.
GROUP, LENT, CHUNK, PIECE = 100, 6, 4096, 1 << 14
#: Turns whose prefixes a node carries down with it; beyond them the next ones are fetched.
CARRIED = 16
#: Four sums of 31-bit hashes tell prefixes apart.
_SUMS = ("k0", "k1", "k2", "k3")
EMPTY = hashlib.sha256().hexdigest()


def _ranked(turns: DataFrame) -> DataFrame:
    """turns with pos: the place of a row in its conversation, from 0, by turn, role and text.

    Rows are range-partitioned by all of these, and counts by part place them, so no conversation has to fit into a task.
    """
    # the last part of the order only tells rows apart that are equal
    turns = turns.withColumn("tie", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    parts, _ = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "trie-rows")
    part = F.shiftright("row", 33)
    sizes = parts.groupBy("conv", part.alias("part")).agg(F.count("*").alias("c"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a conversation in one part only, as nearly all are, is placed by its first row there
    offsets, _ = written(sizes.select("conv", "part", (before - F.col("first")).alias("offset")), "trie-offsets")
    placed = parts.withColumn("part", part).join(offsets, ["conv", "part"])
    return placed.select("conv", (F.col("row") + F.col("offset")).alias("pos"), "role", "text")


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, convs): turns are (conv, depth, role, text), depth from 1; convs (conv, n) has every conversation, turnless ones too.

    A conversation's opening of h turns comes from the first conversation of its hundred; h is the CRC of its id modulo LENT.
    """
    text = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    rows = conversations.select(quoted(id_col).cast("long").alias("conv"), quoted(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv is not null")
    placed, _ = written(_ranked(rows), "trie-turns")
    convs = placed.groupBy("conv").agg(F.count("*").alias("own"))
    donor = F.col("conv") - F.col("conv") % GROUP
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % LENT
    opening = placed.where((F.col("conv") % GROUP == 0) & (F.col("pos") < LENT - 1)).select(F.col("conv").alias("donor"), "pos", "role", "text")
    lends = opening.groupBy("donor").agg(F.count("*").alias("lends"))
    shape = convs.withColumn("donor", donor).withColumn("h", h).join(lends, "donor", "left")
    taken = F.least("h", F.coalesce("lends", F.lit(0)))
    shape, _ = written(shape.select("conv", "donor", "own", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-shapes")
    lent = shape.select("conv", "donor", "taken").join(opening, "donor").where(F.col("pos") < F.col("taken")).select("conv", (F.col("pos") + 1).alias("depth"), "role", "text")
    # own turns meet their conversation's figures by chunk, so a long conversation is spread out
    chunks = shape.select("conv", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("own") - 1, CHUNK))).alias("chunk"))
    own = placed.withColumn("chunk", _div(F.col("pos"), CHUNK)).join(chunks, ["conv", "chunk"]).where(F.col("pos") >= F.col("h"))
    own = own.select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "role", "text")
    return lent.unionByName(own), shape.select("conv", "n")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, size, total, k0 ... k3): the key of each prefix, the code points of its last text and of all its texts."""
    turn = F.md5(F.concat_ws("\0", F.length("role"), "role", "text").cast("binary"))
    digest = F.md5(F.concat_ws(":", F.col("depth"), turn).cast("binary"))
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF).alias(s) for k, s in enumerate(_SUMS)]
    rows = turns.select("conv", "depth", F.length("text").cast("long").alias("size"), *parts).withColumn("chunk", _div(F.col("depth") - 1, CHUNK))
    running = W.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.select("conv", "depth", "chunk", "size", F.sum("size").over(running).alias("total"), *[F.sum(s).over(running).alias(s) for s in _SUMS])
    inside, _ = written(inside, "trie-inside")
    sums = inside.where(F.col("depth") % CHUNK == 0).select("conv", "chunk", "total", *_SUMS)
    upto = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    earlier = sums.select("conv", (F.col("chunk") + 1).alias("chunk"), *[F.sum(s).over(upto).alias(f"before_{s}") for s in ("total", *_SUMS)])
    add = lambda s: (F.col(s) + F.coalesce(f"before_{s}", F.lit(0))).alias(s)
    return inside.join(earlier, ["conv", "chunk"], "left").select("conv", "depth", "size", add("total"), *map(add, _SUMS))


def _digests(members: DataFrame) -> DataFrame:
    """(class, ends): SHA-256 of each class's members in numeric order, comma-joined, as hex.

    Members are range-partitioned and joined in pieces of bounded length; a class's pieces then stream through a hash in order.
    """
    ordered = members.repartitionByRange("class", "conv").sortWithinPartitions("class", "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["class", "first", "piece"])

        for batch in batches:
            for c, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (c != now or len(held) == PIECE):
                    yield flush()
                    held = []
                now = c
                held.append(i)
        if held:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done, ends = [], []
            for c, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != now:
                    if state:
                        done.append(now)
                        ends.append(state.hexdigest())
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(ends, pa.string())], names=["class", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["class", "ends"])

    joined = ordered.select("class", "conv").mapInArrow(released(pieces), "class long, first long, piece string")
    return joined.repartition("class").sortWithinPartitions("class", "first").mapInArrow(released(digests), "class long, ends string")


def build(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row for each node."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations, **columns)
    every, _ = written(prefixes(turns), "trie-prefixes")
    zero = [F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in ("total", *_SUMS)]
    whole = convs.join(every.select("conv", F.col("depth").alias("n"), "total", *_SUMS), ["conv", "n"], "left").select("conv", "n", *zero)
    whole, whole_at = written(whole, "trie-whole")
    classes, _ = written(whole.groupBy("n", *_SUMS).agg(F.min("conv").alias("class"), F.count("*").alias("members"), F.first("total").alias("whole")), "trie-classes")
    ends, _ = written(_digests(whole.join(classes.select("class", "n", *_SUMS), ["n", *_SUMS]).select("class", "conv")), "trie-ends")
    removed(spark, whole_at)
    # the prefixes of one conversation for each class, met by chunk as before
    chunks = classes.where("n > 0").select(F.col("class").alias("conv"), F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("n") - 1, CHUNK))).alias("chunk"))
    paths, _ = written(every.withColumn("chunk", _div(F.col("depth") - 1, CHUNK)).join(chunks, ["conv", "chunk"]), "trie-paths")
    both = paths.groupBy("depth", *_SUMS).agg(F.min("conv").alias("least"), F.max("conv").alias("most")).where("least < most")
    shared, _ = written(paths.join(both.select("depth", *_SUMS), ["depth", *_SUMS], "left_semi").select("conv", "depth", "size", *_SUMS), "trie-shared")
    # of each class the depth to which another goes with it
    reach = shared.groupBy(F.col("conv").alias("class")).agg(F.max("depth").alias("reach"))
    classes = classes.join(reach, "class", "left").join(ends, "class").select("class", "n", "members", "whole", "ends", F.coalesce("reach", F.lit(0)).cast("long").alias("reach"))
    classes, _ = written(classes, "trie-reach")
    chains, _ = written(_chains(paths, classes), "trie-chains")
    nodes, parents = _peeled(shared, classes, chains.where("top").select(F.col("conv").alias("class"), F.col("saved").alias("above")))
    # inside a chain the parent is the class's own node; its first node and all peeled ones hang on peeled ones
    hung = chains.where("top").drop("parent", "top").unionByName(nodes)
    hung = hung.join(parents.select("conv", (F.col("depth") + 1).alias("depth"), "parent"), ["conv", "depth"], "left")
    found = hung.unionByName(chains.where("not top").drop("top"))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    )


def _chains(paths: DataFrame, classes: DataFrame) -> DataFrame:
    """The nodes that one class has to itself: (conv, depth, members, parent, n_children, n_leaves, saved, ends, top)."""
    deep = classes.where("n > reach").withColumnRenamed("class", "conv")
    chunks = deep.withColumn("chunk", F.explode(F.sequence(_div(F.col("reach"), CHUNK), _div(F.col("n") - 1, CHUNK))))
    own = paths.join(chunks, ["conv", "chunk"]).where("depth > reach")
    last = F.col("depth") == F.col("n")
    return own.select(
        "conv", "depth", "members", F.col("conv").alias("parent"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("members") - 1) * (F.col("whole") - F.col("total") + F.col("size"))).alias("saved"), F.when(last, F.col("ends")).alias("ends"), (F.col("depth") == F.col("reach") + 1).alias("top"),
    )


def _peeled(shared: DataFrame, classes: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that several classes share, and the root, from the deepest down; and parents (conv, depth, parent).

    parents has for what came into depth d, from above or as a class that surfaces there, the conversation of its node at d.
    """
    spark, out = shared.sparkSession, new_path(shared.sparkSession, "trie-levels")
    # a class surfaces where another first goes with it: as the child at the foot of its chain, or as one that ends there
    child = (F.col("n") > F.col("reach")).cast("long")
    surfacing = classes.join(tops, "class", "left").select(
        F.col("reach").alias("depth"), F.col("class").alias("conv"), "members", child.alias("n_children"), child.alias("n_leaves"), F.coalesce("above", F.lit(0)).cast("long").alias("saved"), F.when(child == 0, F.col("ends")).alias("ends")
    )
    surfacing, surfacing_at = written(surfacing, "trie-surfacing")
    shapes = {
        "nodes": "conv long, members long, n_children long, n_leaves long, saved long, ends string, path map<long,struct<k0:long,k1:long,k2:long,k3:long,size:long>>",
        "parents": "conv long, parent long",
    }
    deepest, alive = surfacing.agg(F.max("depth")).first()[0], None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        # what lies below, to the next multiple of CARRIED, goes down with a node
        band = shared.where(F.col("depth").between(d - d % CARRIED, d)).groupBy("conv").agg(F.map_from_entries(F.collect_list(F.struct("depth", F.struct(*_SUMS, "size").alias("at")))).alias("path"))
        came = surfacing.where(F.col("depth") == d).drop("depth").join(band, "conv", "left")
        if alive is not None:
            stripped = alive.select("conv", "members", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends"), "path")
            if d % CARRIED == CARRIED - 1:
                stripped = stripped.drop("path").join(band, "conv")
            came = came.unionByName(stripped)
        turn = F.try_element_at("path", F.lit(d).cast("long"))
        key = F.struct(*[F.coalesce(turn[s], F.lit(0)).alias(s) for s in _SUMS])
        came, came_at = written(came.withColumn("key", key).withColumn("size", F.coalesce(turn["size"], F.lit(0))), "trie-came")
        grouped = came.groupBy("key").agg(
            F.min("conv").alias("conv"), F.sum("members").alias("members"), F.sum("n_children").alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
            F.sum("saved").alias("above"), F.max("ends").alias("ends"), F.max("size").alias("size"), F.min_by("path", "conv").alias("path"),
        )
        nodes = grouped.withColumn("saved", F.col("above") + (F.col("members") - 1) * F.col("size")).drop("above", "size")
        nodes, nodes_at = written(nodes, "trie-met")
        came.join(nodes.select("key", F.col("conv").alias("parent")), "key").select("conv", "parent").write.parquet(f"{out}/parents/depth={d}")
        nodes.drop("key").write.parquet(f"{out}/nodes/depth={d}")
        alive = spark.read.schema(shapes["nodes"]).parquet(f"{out}/nodes/depth={d}")
        for at in (came_at, nodes_at):
            removed(spark, at)
    removed(spark, surfacing_at)
    read = lambda name: spark.read.schema(f"{shapes[name]}, depth long").parquet(f"{out}/{name}") if deepest is not None else spark.createDataFrame([], f"{shapes[name]}, depth long")
    return read("nodes").drop("path"), read("parents")
