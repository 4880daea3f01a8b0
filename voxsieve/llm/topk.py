"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector is a row of weights by term (its component's number); terms of weight zero aren't stored. Candidates are dealt into
blocks. Each task takes one block of queries and one block of candidates, turns the candidates into postings by term, and
lets every term scatter its weighted postings into the dense score array of each query. Partition selection keeps the k best
of a tile, and a ranking over the tiles' few survivors merges them. All sums are integers.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; an empty vector has score 0
with all others, and vectors of unequal length meet on the terms that both have. A query's own row is left out, and that row
alone: other rows of its id are candidates. Repeated query rows are ranked apart; repeated candidate rows each count. Ties go
to the smaller id, nulls last. A score beyond 64 bits raises OverflowError.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Dense scores held at once.
TILE_CELLS = 4 << 20


def quantised(embedding: Column, factor: int = 1024) -> Column:
    """floor(factor * component) as long; null where the vector takes no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(embedding.isNotNull() & sound, F.transform(wide, lambda x: F.floor(x * F.lit(float(factor)))))


def _matrix(vectors: pd.Series, terms: int) -> np.ndarray:
    """Rows by term; shorter vectors lack the later terms."""
    out = np.zeros((len(vectors), terms), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores of all queries, one term after the other."""
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if top >= 1 << 63:
        raise OverflowError("inner products may exceed 64 bits")
    exact_floats = top < 1 << 53
    total = np.zeros((len(queries), len(candidates)), np.float64 if exact_floats else np.int64)
    for term in range(queries.shape[1]):
        asking = np.flatnonzero(queries[:, term])
        posted = np.flatnonzero(candidates[:, term])
        if not len(asking) or not len(posted):
            continue
        add = np.multiply.outer(queries[asking, term].astype(total.dtype), candidates[posted, term].astype(total.dtype))
        if len(asking) == len(queries) and len(posted) == len(candidates):
            total += add
        else:
            total[np.ix_(asking, posted)] += add
    return total


def best_of_tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query in one tile, of equal scores those of the smaller ids; own is the query's score with itself."""
    if not len(queries) or not len(candidates):
        return pd.DataFrame({"q_row": [], "q_id": [], "c_id": [], "score": [], "own": []})
    terms = max(queries["v"].map(len).max(), candidates["v"].map(len).max())
    q, c = _matrix(queries["v"], terms), _matrix(candidates["v"], terms)
    if int(np.abs(q).max(initial=0)) ** 2 * terms >= 1 << 63:
        raise OverflowError("inner products may exceed 64 bits")
    own = np.einsum("ij,ij->i", q, q)
    q_ids, c_ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
    order = np.argsort(pd.Series(c_ids).rank(method="first", na_option="bottom").to_numpy())  # by id, so that the first of equals is the smaller
    c, c_ids = c[order], c_ids[order]
    step, take, found = max(1, TILE_CELLS // len(c)), min(k, len(c)), []
    for at in range(0, len(q), step):
        total = scores(q[at : at + step], c)
        for row, line in enumerate(total):
            least = np.partition(line, len(line) - take)[len(line) - take]
            above, level = np.flatnonzero(line > least), np.flatnonzero(line == least)
            keep = np.concatenate([above, level[: take - len(above)]])
            found.append(pd.DataFrame({"q_row": queries["row"].iloc[at + row], "q_id": q_ids[at + row], "c_id": c_ids[keep], "score": line[keep].astype(np.int64), "own": own[at + row]}))
    return pd.concat(found)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row over all other rows.

    Both sides are dealt into blocks of bounded size; the number of tiles is the number of query blocks times the number of
    candidate blocks, and a row is copied once for each block of the other side.
    """
    rows = vectors.select(quoted(id_col).alias("id"), quantised(quoted(vector_col)).alias("v"), is_query.alias("asks")).where("v is not null")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-asked // query_block))
    deal = lambda df, parts: df.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    queries = deal(rows.where("asks"), q_blocks).select("row", "id", "v", F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    candidates = deal(rows, c_blocks).select("id", "v", F.col("block").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    id_type = rows.schema["id"].dataType.simpleString()
    tiles = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(lambda q, c: best_of_tile(q, c, k + 1), f"q_row long, q_id {id_type}, c_id {id_type}, score long, own long")
    best = W.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("c_id").asc_nulls_last())
    ranked = tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    # the query's own row is one with its id and its score with itself; which one of several makes no difference to the result
    itself = F.when(F.col("c_id").eqNullSafe(F.col("q_id")) & (F.col("score") == F.col("own")), F.col("rank"))
    ranked = ranked.withColumn("itself", F.coalesce(F.min(itself).over(W.partitionBy("q_row")), F.lit(k + 1)))
    kept = ranked.where(F.col("rank") != F.col("itself")).withColumn("rank", F.col("rank") - (F.col("rank") > F.col("itself")).cast("int"))
    return kept.select(F.col("q_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("c_id").alias("vec_id"), "score")
