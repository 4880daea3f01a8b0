import math

import numpy as np
import pytest

from tests.llm.oracle import same_rows
from voxsieve.llm import forest, queries, sql


def brute(rows, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for size in {len(v) for (_, v), o in zip(rows, ok) if o}:
        at = [k for k in range(n) if ok[k] and len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in at], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    name = [None] * n
    seen = np.zeros(n, bool)
    for k in range(n):
        if not seen[k]:
            group, front = [], [k]
            seen[k] = True
            while front:
                group += front
                new = near[front].any(0) & ~seen
                seen |= new
                front = np.flatnonzero(new).tolist()
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                name[j] = least
    return near, [(i, int(near[k].sum()), name[k], i is not None and i == name[k]) for k, (i, _) in enumerate(rows)]


def groups(n, seed, noise):
    """Vectors in groups of several sizes around centres, and lone ones."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 10, 64))
    x = centres[rng.integers(0, len(centres), n) ** 2 % len(centres)] + noise * rng.standard_normal((n, 64))
    lone = rng.random(n) < 0.5
    x[lone] = rng.standard_normal((int(lone.sum()), 64))
    return x.astype(np.float32)


key = lambda r: tuple((x is None, x or 0) for x in r)


def test_query_matches_sql(spark, data_dir):
    same_rows(queries.op12_vector_forest(spark, data_dir), data_dir, sql.OP12)


def test_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [rng.standard_normal(8).tolist() for _ in range(5)]
    rows = [(k, base[k % 5] if k % 3 else (np.array(base[k % 5]) * 10.0 ** (k % 7 * 40 - 120)).tolist()) for k in range(40)]
    rows += [(100, None), (101, [0.0] * 8), (102, [-0.0] * 8), (103, []), (104, [1.0, None] * 4), (105, [math.nan] * 8), (106, [math.inf] + [0.0] * 7), (107, [1.0]), (108, [2.0]), (109, [-3.0]), (None, base[0]), (None, [1.0] * 8), (None, None), (3, base[0]), (3, base[0]), (110, [5e-324] * 8)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, id string, n int").repartition(3)
    got = sorted((tuple(r) for r in forest.near_vectors(frame).collect()), key=key)
    assert got == sorted(brute(rows)[1], key=key)
    assert forest.near_vectors(frame.limit(0)).collect() == []


@pytest.mark.parametrize("noise,least", [(0.2, 0.999), (0.33, 0.95)])
def test_recall_of_small_leaves_and_tiles(spark, noise, least):
    """Many levels and tiles: links found are links, and nearly all are found; at noise 0.33 cosines lie about the bound."""
    x = groups(3000, 5, noise)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    near, want = brute(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r[0]: tuple(r) for r in forest.near_vectors(frame, leaf=48, tile=20).collect()}
    assert len(got) == len(rows) and near.sum() > 2000
    assert all(got[i][1] <= n for i, n, _, _ in want)
    found = sum(r[1] for r in got.values()) / near.sum()
    assert found >= least
    if noise == 0.2:
        assert sum(got[r[0]] == r for r in want) >= 0.995 * len(want)


def test_links_are_counted_once_whatever_leaves_a_pair_shares():
    rng = np.random.default_rng(1)
    u = forest.units(rng.standard_normal((1, 16)) + 0.05 * rng.standard_normal((9, 16)))
    sides, weights = np.zeros(9, np.int64), np.arange(1, 10)
    free = [np.empty(0, np.int64)] * 9
    weight, edges = forest.tile_links(sides, u, weights, free, 0.9)
    assert weight.tolist() == [45 - w for w in range(1, 10)] and len(edges) == 8
    met = [np.array([5])] * 3 + free[3:]  # the first three have met in a leaf of smaller number
    weight, edges = forest.tile_links(sides, u, weights, met, 0.9)
    assert weight.tolist()[:3] == [39, 39, 39] and weight.tolist()[3] == 41 and len(edges) == 8
    sides[:4] = 1
    weight, edges = forest.tile_links(sides, u, weights, free, 0.9)
    assert weight.tolist()[0] == 35 and weight.tolist()[8] == 10
