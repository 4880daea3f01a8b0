"""Documents that resemble each other: sets of word shingles with a Jaccard similarity of at least SIMILARITY.

A fingerprint is cut into blocks so that close pairs share one, blocks are joined, the Hamming distance is verified, and last
the similarity itself on the whole texts. Sign bits of sums, as simhash has them, differ in a seventh of all places at this
similarity, which no block of useful width survives; so a fingerprint's places are minima of HASHES hash functions over the
set, which agree just as often as the sets are similar. A block is ROWS minima; a pair of similarity 0.8 shares none of the
BLOCKS blocks once in 14,000 times. The distance is counted over one bit of each minimum and is generous (a pair of 0.8 is
beyond it once in a million times).

Equal sets are one node. A block's members are compared with its first member. Where members then still lie in different
components, those of small blocks are compared pair by pair, those of others with some neighbours in a random order. Last, in
what large blocks are still divided, all members outside the block's largest component are compared with all members, tile
by tile of bounded size, by an index of the tile's shingles. So a large group of near copies isn't paired with itself, and no link is lost.

Defined results: words as in simhash (white space of ASCII, its capitals as small letters); a text of fewer words than a shingle
is one shingle, a text without words resembles only others without. Null texts count as empty. Shingles are 64-bit hashes of
words' 128-bit hashes, sets are taken for equal by 128 bits. Texts of any length are read whole. Repeated rows resemble each
other and one of them stays; of a component the row with the smallest id does, one without an id only where none has one, and of
rows that tie the one that is read first. Empty tables give empty ones. Columns besides id and text aren't read, but pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, pick_rows, released, written
from .simhash import _LOWER, components, near_duplicates
from .words import Words, mixed, window_hashes

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Blocks of a fingerprint, minima in each, and bits in which fingerprints may differ.
BLOCKS, ROWS, DISTANCE = 24, 5, 28
HASHES = BLOCKS * ROWS
#: Members up to which a block is joined pair by pair, neighbours met in a random order otherwise, and members on a tile's side.
JOINED, MET, TILE = 16, 6, 512
#: Bytes of text hashed at once.
TEXT_BYTES = 2 << 20

_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] | np.uint64(1)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles in order; texts are hashed some at a time."""
    at = 0
    while at < len(texts):
        raw, held = [], 0
        while at < len(texts) and (not raw or held < TEXT_BYTES):
            raw.append(texts[at].encode().translate(_LOWER))
            held += len(raw[-1])
            at += 1
        words = Words(raw)
        hashes = window_hashes(words.hashes[:, 0], size) ^ window_hashes(words.hashes[:, 1], size) if len(words) else np.empty(0, np.uint64)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(hashes[a : b - size + 1])
            else:
                yield np.array([xxhash.xxh3_64_intdigest(words.hashes[a:b].tobytes(), b - a)], np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = SIMILARITY
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(out, (mixed(shingles[at : at + 2048]) * _FACTORS).min(1), out=out)
    return out


def fingerprints(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, size, digest, bits, blocks): of every document the octets of the text, the digest of its set, one bit of each
    minimum as two numbers, and the keys of its blocks."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            digests, low = [], np.empty((n, HASHES), np.uint64)
            for k, s in enumerate(shingle_sets(batch.column(1).to_pylist())):
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                low[k] = minima(s)
            low = mixed(low)
            bits = np.packbits(np.pad((low & np.uint64(1)).astype(np.uint8), ((0, 0), (0, 128 - HASHES))), axis=1).view("<i8")
            keys = np.zeros((n, BLOCKS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(digests, pa.binary()), lists(bits), lists(keys.view(np.int64))], names=["row", "size", "digest", "bits", "blocks"])

    return numbered(docs, text_col).mapInArrow(released(run), "row long, size long, digest binary, bits array<long>, blocks array<long>")


def _near(a: Column, b: Column) -> Column:
    """Whether fingerprints lie within the distance."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1])) <= DISTANCE


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, every: DataFrame, text_col: str) -> DataFrame:
    """The pairs of rows (a, b) whose texts are similar enough. Texts that are in no pair aren't shuffled."""
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    picked = pick_rows(docs.select(docs[f"`{text_col}`"].alias("text")), ends, every, "text")
    texts, _ = written(picked.select(F.col("__row").alias("row"), F.coalesce("text", F.lit("")).alias("text")), "resemblance-texts")
    side = lambda x: texts.select(F.col("row").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for t in pair]
            sets = shingle_sets(texts)
            kept = [similar(x, y) for x, y in zip(sets, sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(released(run), "a long, b long")


def links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b): links among rows of docs, enough of them to connect whatever is similar enough."""
    prints, _ = written(fingerprints(docs, text_col), "resemblance-prints")
    firsts = prints.groupBy("digest").agg(F.min("row").alias("a"), F.count("*").alias("n")).where("n > 1").select("digest", "a")
    firsts, _ = written(firsts, "resemblance-firsts")  # so that Spark may split a frequent set
    marked, _ = written(prints.join(firsts, "digest", "left").select("row", "a", "bits", "blocks"), "resemblance-sets")
    copies = marked.where("row <> a").select("a", F.col("row").alias("b"))
    keys = marked.where("a is null or row = a").select("row", "bits", F.posexplode("blocks").alias("block", "key"))
    shared = keys.groupBy("block", "key").agg(F.min(F.struct("row", "bits")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared, _ = written(shared, "resemblance-blocks")
    members, _ = written(keys.join(shared, ["block", "key"]), "resemblance-members")
    pairs = _ordered(members.where((F.col("row") != F.col("first.row")) & _near(F.col("bits"), F.col("first.bits"))).select(F.col("first.row").alias("a"), F.col("row").alias("b")))
    sizes = prints.select("row", "size")
    star, _ = written(pairs, "resemblance-pairs")
    found, _ = written(verified(star, docs, sizes, text_col), "resemblance-found")
    apart = _apart(members.select("block", "key", "row", "bits", "n"), found)
    if apart.isEmpty():
        return copies.unionByName(found)
    pairs, _ = written(_ordered(_pairs(apart)).join(star, ["a", "b"], "left_anti"), "resemblance-pairs")
    found = found.unionByName(written(verified(pairs, docs, sizes, text_col), "resemblance-found")[0])
    apart = _apart(apart.where(F.col("n") > JOINED).drop("label"), found)
    if apart.isEmpty():
        return copies.unionByName(found)
    return copies.unionByName(found).unionByName(_tiled(apart, docs, sizes, text_col))


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with their component, label, of the blocks whose members aren't all in one."""
    labelled = members.join(components(found).withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    labelled, _ = written(labelled, "resemblance-labelled")
    blocks = labelled.groupBy("block", "key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("block", "key")
    return written(labelled.join(blocks, ["block", "key"], "left_semi"), "resemblance-apart")[0]


def _pairs(apart: DataFrame) -> DataFrame:
    """(a, b) to be tried: of small blocks all members of different components, of others neighbours in a random order."""
    few, many = apart.where(F.col("n") <= JOINED), apart.where(F.col("n") > JOINED)
    side = lambda x: few.select("block", "key", *[F.col(c).alias(f"{x}_{c}") for c in ("row", "bits", "label")])
    each = side("a").join(side("b"), ["block", "key"]).where((F.col("a_row") < F.col("b_row")) & (F.col("a_label") != F.col("b_label")) & _near(F.col("a_bits"), F.col("b_bits")))
    order = Window.partitionBy("block", "key").orderBy(F.xxhash64("block", "row"))
    after = F.array(*[F.lead(F.struct("row", "bits", "label"), k).over(order) for k in range(1, MET + 1)])
    met = many.select("row", "bits", "label", after.alias("after")).select("row", "bits", "label", F.explode("after").alias("next")).where("next is not null")
    met = met.where((F.col("label") != F.col("next.label")) & _near(F.col("bits"), F.col("next.bits")))
    return each.select(F.col("a_row").alias("a"), F.col("b_row").alias("b")).unionByName(met.select(F.col("row").alias("a"), F.col("next.row").alias("b")))


def _tiled(apart: DataFrame, docs: DataFrame, every: DataFrame, text_col: str) -> DataFrame:
    """(a, b): links between components of what is left in large blocks, one for each component that a member is similar to."""
    counts = apart.groupBy("block", "key", "label").agg(F.count("*").alias("c")).groupBy("block", "key").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("n"))
    tiles = lambda c: F.greatest(F.ceil(c / F.lit(TILE)), F.lit(1)).cast("int")
    counts, _ = written(counts.select("block", "key", F.col("main.label").alias("main"), tiles(F.col("n")).alias("m_tiles"), tiles(F.col("n") - F.col("main.c")).alias("o_tiles")), "resemblance-tiles")
    picked = pick_rows(docs.select(docs[f"`{text_col}`"].alias("text")), apart.select("row").distinct(), every, "text")
    texts, _ = written(picked.select(F.col("__row").alias("row"), F.coalesce("text", F.lit("")).alias("text")), "resemblance-texts")
    rows = apart.select("block", "key", "row", "label").join(counts, ["block", "key"])
    own = lambda parts: F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    member = rows.select(F.lit(False).alias("asks"), "block", "key", "row", "label", own("m_tiles").alias("m"), all_of("o_tiles").alias("o"))
    other = rows.where("label <> main").select(F.lit(True).alias("asks"), "block", "key", "row", "label", all_of("m_tiles").alias("m"), own("o_tiles").alias("o"))

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_similar_rows(tile[~tile["asks"]], tile[tile["asks"]]), columns=["a", "b"])

    return member.unionByName(other).join(texts, "row").groupBy("block", "key", "m", "o").applyInPandas(run, "a long, b long")


def _similar_rows(members: pd.DataFrame, others: pd.DataFrame) -> list[tuple[int, int]]:
    """(row of others, row of members) that are similar and of different components; of each component one member."""
    if not len(members) or not len(others):
        return []
    up, down = SIMILARITY
    sets = list(shingle_sets(members["text"].tolist()))
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    rows, labels, out = members["row"].to_numpy(), members["label"].to_numpy(), []
    for row, label, s in zip(others["row"], others["label"], shingle_sets(others["text"].tolist()), strict=True):
        low, high = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = high - low
        at = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(owner[at], minlength=len(sets))
        close = np.flatnonzero((down * both >= up * (sizes + len(s) - both)) & (labels != label))
        out += [(row, int(rows[close[k]])) for k in np.unique(labels[close], return_index=True)[1]]
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay when near-duplicates by simhash and by resemblance are linked: of each group the row with the
    smallest id. docs must read alike each time, as a table does. No document is shuffled that resembles no other."""
    groups, _ = written(near_duplicates(docs, id_col=id_col, text_col=text_col).select("row", "id", "size", "first_row"), "resemblance-groups")
    of_row = lambda x: groups.select(F.col("row").alias(x), F.col("first_row").alias(f"{x}_first"))
    edges = links(docs, text_col).join(of_row("a"), "a").join(of_row("b"), "b").where("a_first <> b_first")
    labels = components(edges.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b")).distinct())
    heads = groups.where("row = first_row").join(labels.withColumnRenamed("node", "row"), "row", "left")
    heads, _ = written(heads.select("row", "id", F.coalesce("label", "row").alias("label")), "resemblance-heads")
    first = heads.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first"))
    return pick_rows(docs, first.select("first.row"), groups, text_col).drop("__row")
