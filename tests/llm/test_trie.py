import hashlib
import random
import zlib

import pytest

from tests.llm.oracle import same_rows
from voxsieve.llm import queries, sql, trie


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ended = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[1], r[0]))


def test_query_matches_sql(spark, data_dir):
    same_rows(queries.op11_prefix_trie(spark, data_dir), data_dir, sql.OP11)


@pytest.mark.parametrize("chunk,carried,piece", [(4096, 16, 16384), (3, 2, 2)])
def test_odd_rows_equal_brute_force(spark, monkeypatch, chunk, carried, piece):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "CARRIED", carried)
    monkeypatch.setattr(trie, "PIECE", piece)
    rng = random.Random(chunk)
    rows = []
    for c in [*range(12), *range(95, 112), 200, 201, -100, -7, 350]:
        for k in range(rng.choice([0, 1, 2, 3, 7, 9])):
            rows.append((c, rng.choice([k, k, None]), rng.choice(["user", "a", None]), rng.choice(["é日\U0001f600", "x", "", None])))
    for c in (500, 501, 502, 507):  # longer ones, alike up to a late turn
        rows += [(c, k, "u", f"t{k}") for k in range(8)] + [(c, 8 + k, "u", "end") for k in range(c % 3)]
    rows += [rows[0]] * 3 + [(None, 1, "user", "nobody")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth int").repartition(3)
    assert got(trie.build(frame)) == brute(rows)


def test_no_conversation_has_no_root(spark):
    assert trie.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    lone = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert trie.build(lone).collect() == []


def test_one_conversation_of_many_turns_is_one_chain(spark):
    rows = [(7, k, "u", "x" * (k % 5)) for k in range(6000)]
    found = got(trie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    h = zlib.crc32(b"7") % 6
    assert len(found) == 6001 - h and all(r[3:6] == (1, int(r[1] < 6000 - h), 1) for r in found)
