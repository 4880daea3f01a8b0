"""Near-duplicate vectors by a forest of random-projection trees.

A tree halves the vectors again and again: each level has a random direction, and a node sends what lies before the median of
its sample's projections to the left and the rest to the right. Vectors within a margin of the median spill over to both
sides, so that a close pair is seldom parted, and many trees part different pairs. The levels follow from the number of
vectors; nodes with too few sampled vectors of their own go by the medians of their last ancestor with enough. Every vector is
put into the leaves of every tree, leaves meet in tasks, large ones tile by tile, and cosines are computed there in double
precision: what is linked is exact, and what the forest may miss is a pair that no leaf of any tree holds together.

A pair that shares several leaves counts in the one with the smallest number only, which its vectors' own lists of leaves
tell, so links are counted without a list of pairs. Of each tile's links only a spanning forest leaves the task; components
grow from those. Equal vectors are one class, whose copies count but are compared once.

A pair at the bound of 0.9 in 64 dimensions is parted by one level of one tree with a chance of some 7 in 100 (SPILL), so all
TREES miss one of 100,000 such pairs after 7 levels and one of 23 after 20; closer pairs are missed far less often.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and stand alone; so do
empty ones. Vectors of different lengths never link. Rows that repeat an id are vectors of their own; a component is named by
its smallest id, by null if none of its rows has one; kept is false where the id is null. An empty table gives no rows.
Columns besides id and vector aren't read. A leaf that margins can't split, as of very many different vectors that are all
close, is compared in tiles that grow with the square of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_sample, quoted, released, written
from .simhash import components

COSINE = 0.9
#: Trees; vectors that a leaf shall hold about; margin in standard deviations of a linked pair's projected distance at the bound.
TREES, LEAF, SPILL = 12, 512, 0.25
#: The sample that medians are taken of: vectors, and components of all of them; vectors that a node needs for medians of its own.
SAMPLE_ROWS, SAMPLE_VALUES, OWN = 16384, 4 << 20, 32
#: Vectors of a tile: leaves with more are compared tile by tile.
TILE = 1024


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, without over- or underflow."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


@dataclass
class Forest:
    """directions: dimensions by levels for each tree; medians: for each tree and level those of the 2^k nodes that have their own."""

    directions: list[np.ndarray]
    medians: list[list[np.ndarray]]
    margin: float

    def leaves(self, vectors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors of the forest's dimension, filled with zeros; dim is the length that they had."""
        rows, found = [], []
        for tree, (directions, medians) in enumerate(zip(self.directions, self.medians, strict=True)):
            projected = vectors @ directions
            row, path = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for level, own in enumerate(medians):
                behind = projected[row, level] - own[path >> (level - (len(own).bit_length() - 1))]
                left, right = behind < self.margin, behind >= -self.margin
                row = np.concatenate([row[left], row[right]])
                path = np.concatenate([2 * path[left], 2 * path[right] + 1])
            rows.append(row)
            found.append(_numbered(path, tree, dim, len(medians)))
        return np.concatenate(rows), np.concatenate(found)


def _numbered(path: np.ndarray, tree: int, dim: int, levels: int) -> np.ndarray:
    """One number for each leaf of each tree and dimension."""
    with np.errstate(over="ignore"):
        x = path.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree << 40) + (levels << 32) + dim)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def plant(sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, cosine: float = COSINE, seed: int = 17) -> Forest:
    """A forest for n vectors from a sample of unit vectors."""
    dim, levels = sample.shape[1], max(0, math.ceil(math.log2(max(1, n) / leaf)))
    rng, forest = np.random.default_rng(seed), Forest([], [], spill * math.sqrt((2 - 2 * cosine) / max(1, sample.shape[1])))
    own_levels = max(0, int(math.log2(max(1, len(sample)) / OWN)))
    for _ in range(trees):
        directions = rng.standard_normal((dim, levels))
        directions /= np.maximum(np.sqrt((directions**2).sum(0)), 1e-300)
        projected, medians, sets = sample @ directions, [], [np.arange(len(sample))]
        for level in range(levels):
            at = np.array([np.median(projected[s, level]) if len(s) else 0.0 for s in sets])
            medians.append(at)
            if level < own_levels:
                halves = []
                for s, m in zip(sets, at, strict=True):
                    after = projected[s, level] >= m
                    halves += [half if len(half) >= OWN else s for half in (s[~after], s[after])]
                sets = halves
        forest.directions.append(directions)
        forest.medians.append(medians)
    return forest


def _matrix(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) for each length that occurs."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _in_leaves(classes: DataFrame, forest: Forest, dim: int, with_vectors: bool) -> DataFrame:
    """(leaf, cls) or (leaf, cls, n, unit, lower): every class in each of its leaves; lower has its leaves of smaller number."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, at, vectors in _matrix(batch.column(2)):
                unit = units(vectors)
                row, leaf = shared.value.leaves(np.pad(unit, ((0, 0), (0, dim - own))), own)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                cls = batch.column(0).take(pa.array(at[row]))
                if not with_vectors:
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), cls], names=["leaf", "cls"])
                    continue
                first = np.searchsorted(row, np.arange(len(at)))
                for a in range(0, len(row), 4096):
                    part = slice(a, a + 4096)
                    lower = [leaf[first[r] : a + k] for k, r in enumerate(row[part].tolist())]
                    bytes_of = pa.array([unit[r].tobytes() for r in row[part].tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[part]), cls.slice(a, 4096), batch.column(1).take(pa.array(at[row[part]])), bytes_of, pa.array(lower, pa.list_(pa.int64()))], names=["leaf", "cls", "n", "unit", "lower"])

    rows = classes.select("cls", "n", "v")
    return rows.mapInArrow(released(run), "leaf long, cls long, n long, unit binary, lower array<long>" if with_vectors else "leaf long, cls long")


def tile_links(sides: np.ndarray, units_: np.ndarray, weights: np.ndarray, lower: list[np.ndarray], cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the vectors of a tile: the weight of the links that count here, and a spanning forest of all links here.

    Links are between the two sides, or within the one side if there is only one.
    """
    near = units_ @ units_.T >= cosine
    np.fill_diagonal(near, False)
    if sides.min() != sides.max():
        near &= sides[:, None] != sides[None, :]
    linked = np.flatnonzero(near.any(1))
    edges, seen = [], np.zeros(len(sides), bool)
    for r in linked.tolist():
        if seen[r]:
            continue
        seen[r], front = True, np.array([r])
        while len(front):
            front = np.flatnonzero(near[front].any(0) & ~seen)
            seen[front] = True
            edges += [(r, int(k)) for k in front]
    # a pair that meets in a leaf of smaller number counts there
    if len(linked):
        numbers = np.concatenate([lower[r] for r in linked]).astype(np.int64)
        who = np.repeat(linked, [len(lower[r]) for r in linked])
        order = np.argsort(numbers, kind="stable")
        numbers, who = numbers[order], who[order]
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
            if b - a > 1:
                near[np.ix_(who[a:b], who[a:b])] = False
    return near @ weights, edges


def found_links(classes: DataFrame, forest: Forest, dim: int, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(cls, links, other): links to be added up by class, and with links null edges that connect what is linked."""
    sizes = _in_leaves(classes, forest, dim, False).groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    met, _ = written(sizes, "forest-leaves")
    rows = _in_leaves(classes, forest, dim, True).join(met, "leaf")
    parts = F.ceil(F.col("size") / tile).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("parts", parts)
    # a part of a large leaf meets every other part of it, and itself
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cls", "n", "unit", "lower")
    dealt = rows.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def compared() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            cls = table["cls"].to_numpy()
            by_length: dict[int, list[int]] = {}
            blobs = table["unit"].to_pylist()
            for k, blob in enumerate(blobs):
                by_length.setdefault(len(blob), []).append(k)
            for at in by_length.values():
                own = table["own"].to_numpy()[at]
                if len(at) < 2 or (now[1] != now[2] and own.min() == own.max()):
                    continue
                lower = [np.array(x, np.int64) for x in table["lower"].take(pa.array(at)).to_pylist()]
                weight, edges = tile_links(own, np.frombuffer(b"".join(blobs[k] for k in at)).reshape(len(at), -1), table["n"].to_numpy()[at], lower, cosine)
                ids, some = cls[at], np.flatnonzero(weight)
                a, b = np.array(edges, np.int64).reshape(-1, 2).T
                links = pa.array([*weight[some].tolist(), *[None] * len(a)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[a]])), links, pa.array([*[None] * len(some), *ids[b].tolist()], pa.int64())], names=["cls", "links", "other"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1).astype(np.int64)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a < b:
                    if held and tuple(keys[a]) != now:
                        yield from compared()
                        held.clear()
                    now = tuple(keys[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from compared()

    return dealt.mapInArrow(released(run), "cls long, links long, other long")


def _sound(embedding: Column) -> Column:
    wide = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(embedding.isNotNull() & finite & F.exists(wide, lambda x: x != 0), wide)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept): one row per vector."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, _ = written(vectors.select(quoted(id_col).alias("id"), _sound(quoted(vector_col)).alias("v")), "forest-rows")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes, _ = written(classes.withColumn("cls", F.monotonically_increasing_id()), "forest-classes")
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    sample = hash_sample(classes.select("v"), [F.col("v")], min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dim))).toArrow()["v"].combine_chunks()
    filled = [np.pad(units(v), ((0, 0), (0, dim - own))) for own, _, v in _matrix(sample)]
    forest = plant(np.concatenate(filled) if filled else np.zeros((0, dim)), n, trees, leaf, cosine=cosine)
    found, _ = written(found_links(classes, forest, dim, cosine, tile), "forest-links")
    labels = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct())
    links = found.where("links is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    linked = classes.select("cls", "id").join(labels.withColumnRenamed("node", "cls"), "cls")
    named = linked.join(linked.groupBy("label").agg(F.min("id").alias("named")), "label").select("cls", "named")
    figures = classes.join(links, "cls", "left").join(named.withColumn("with", F.lit(True)), "cls", "left")
    figures = figures.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("with"), F.col("named")).otherwise(F.col("id")).alias("named"), F.lit(True).alias("sound"))
    figures, _ = written(figures, "forest-figures")
    # vectors that take no part don't meet, so the null isn't a hot key
    able = rows.where("v is not null").join(figures, "v").select("id", "n_links", F.col("named").alias("component_id"))
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return able.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
