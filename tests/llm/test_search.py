import math
import random
import re
from collections import Counter

from tests.llm.oracle import same_rows
from voxsieve.llm import queries, search, sql


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(size for _, _, size in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for j, text in items:
        found = []
        for i, c, size in counts:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(j, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return out


key = lambda r: tuple((x is None, x or 0) for x in r)


def got(frame):
    return sorted(((r.item, r["rank"], r.id, r.score) for r in frame.collect()), key=key)


def test_query_matches_sql(spark, data_dir):
    same_rows(queries.op13_ranked_search(spark, data_dir), data_dir, sql.OP13)


def test_odd_rows_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=n))
    docs = [(k, text(rng.randint(1, 60))) for k in range(300)] + [(k % 7, "w1 w2 w59 w58") for k in range(40)]
    docs += [(None, "w59 w58"), (None, "w59"), (400, None), (401, ""), (402, ". _ -"), (403, "W59_w58\u0000w57 \u00e9T\u00e9 \u65e5\u672c"), (404, "w5 " * 40_000)]
    items = [(k, text(rng.choice([1, 2, 3, 9, 40]))) for k in range(25)] + [(30, None), (31, "..."), (32, "nowhere else"), (33, "\u00e9t\u00e9 \u65e5\u672c W58"), (None, "w59 w58 w1"), (3, "w59 w58 w57 w56")]
    frame = spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, number string, score int").repartition(3).checkpoint()
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string")
    want = sorted(brute(docs, items, 10), key=key)
    for shard, piece in ((8 << 20, 4 << 20), (700, 4 << 20), (700, 150)):  # one shard, many, and many slices of queries
        monkeypatch.setattr(search, "SHARD_BYTES", shard)
        assert got(search.top_documents(frame, bench, slice_bytes=piece)) == want
    assert got(search.top_documents(frame, bench, k=1)) == sorted(brute(docs, items, 1), key=key)
    assert search.top_documents(frame.limit(0), bench).collect() == []
    assert search.top_documents(frame, bench.limit(0)).collect() == []


def test_pair_bounds_skip_more_than_term_maxima():
    """Bounds hold for every document, and with them fewer documents are looked at than with the terms' own maxima."""
    rng = random.Random(1)
    names = [b"t%d" % k for k in range(12)]
    # few documents hold a heavy term and none two of them; most hold one light term
    texts = [[names[k // 40 % 6]] * (k % 40 == 0) + [names[6 + rng.randrange(6)]] + [b"calm"] * rng.randint(0, 9) for k in range(3000)]
    asked = search.queries_of([0] * 12, names, [9000 - 10 * k if k < 6 else 3000 - k for k in range(12)])
    index = search.Index(texts, asked, 3000, sum(map(len, texts)))
    units = asked.units[0]
    tight = index.bound[units].copy()
    assert [(asked.vocabulary[names[a]], asked.vocabulary[names[a + 1]]) for a in range(0, 12, 2)] == [tuple(p) for p in index.pairs[units].tolist()]
    for u, (a, b) in zip(units, index.pairs[units].tolist(), strict=True):
        of = lambda t: dict(zip(index.docs[index._of(t)].tolist(), index.impacts[index._of(t)].tolist(), strict=True))
        one, two = of(a), of(b)
        assert index.bound[u] == max(one.get(d, 0) + two.get(d, 0) for d in {*one, *two})
    plain = index.best(units, 10, 1)
    least = int(min(plain[1]))
    exact = index.best(units, 10, least)
    index.bound = index.most[index.pairs[:, 0]] + index.most[index.pairs[:, 1]]
    loose = index.best(units, 10, least)
    assert sorted(exact[1]) == sorted(plain[1]) == sorted(loose[1])
    assert (tight <= index.bound[units]).all() and exact[2] < loose[2] <= plain[2]
