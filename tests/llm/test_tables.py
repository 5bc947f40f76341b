"""Top-n and co-occurrence against brute force, with hot groups and awkward input."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from linkloom.llm import cooccurrence as C
from linkloom.llm import topn as T

EDGE = "id long, source_id long, target_id long, link_type string"
NODE = "id long, path string, seen_at timestamp, n_links long"


def test_top_backlinks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 60), 1 if rng.random() < 0.5 else rng.choice([None, 2, 3, 4]), "tag") for i in range(3000)]
    rows += rows[:100] + [(None, 1, 1, "tag"), (9000, None, 1, "tag"), (9001, 5, 77, "tag")]
    paths = {i: (None if i % 7 == 0 else f"p{i % 5}") for i in range(0, 55)}
    nodes = spark.createDataFrame([(i, p, None, 0) for i, p in paths.items()] + [(1, paths[1], None, 0)], NODE)
    monkeypatch.setattr(T, "HEAVY_ROWS", 20)  # then some targets are heavy and salted, others not
    count = collections.Counter((t, s) for i, s, t, _ in {r[0]: r for r in rows if r[0] is not None}.values() if s is not None and t is not None)
    want = set()
    for t in {t for t, _ in count}:
        order = sorted(((-n, paths.get(s) is None, paths.get(s) or "", s) for (u, s), n in count.items() if u == t))
        want |= {(t, i + 1, x[3]) for i, x in enumerate(order[:10])}
    items = T.link_counts(spark.createDataFrame(rows, EDGE), nodes).cache()
    for heavy in (20, 10**6):  # all ways give the same
        got = T.top_n_per_group(items, "target_id", T.backlink_order(), 10, "source_id", heavy_rows=heavy)
        assert {(r.target_id, r.pos, r.source_id) for r in got.collect()} == want


def test_top_of_nothing_and_clashing_names(spark):
    df = spark.createDataFrame([("g", 1, "count"), (None, 2, "x"), ("g", 3, "salts"), ("g", 3, "salts")], "g string, v int, count string")
    got = T.top_n_per_group(df, "g", [F.col("v").desc(), F.col("count")], 2, "v", heavy_rows=1)
    assert sorted((r.g, r.v, r.pos) for r in got.collect()) == [("g", 3, 1), ("g", 3, 2)]
    assert T.top_n_per_group(df.limit(0), "g", [F.col("v")], 2, "v").count() == 0


def test_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(b, rng.choice([None, *range(12), 1 << 50])) for b in range(300) for _ in range(rng.randint(0, 6))]
    rows += [(1000, x) for x in range(40)] + [(1001, x) for x in range(8)] + [(None, 3)] + rows[:50]  # one basket too large
    monkeypatch.setattr(C, "RECORD_BLOCK", 64)
    monkeypatch.setattr(C, "PENDING", 50)
    baskets = collections.defaultdict(set)
    for b, x in rows:
        if b is not None and x is not None:
            baskets[b].add(x)
    baskets = {b: x for b, x in baskets.items() if len(x) <= 8}
    alone = collections.Counter(x for s in baskets.values() for x in s)
    both = collections.Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame([(b, x, "junk") for b, x in rows], "basket long, item long, a string")
    got = {(r.a_id, r.b_id): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in C.pair_counts(df, "basket", "item", 8, 3).collect()}
    assert got == {p: (n, alone[p[0]], alone[p[1]], len(baskets)) for p, n in both.items() if n >= 3}


def test_no_pairs(spark):
    df = spark.createDataFrame([], "s long, t long")
    assert C.pair_counts(df, "s", "t").count() == 0
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "s long, t long")
    assert C.pair_counts(df, "s", "t", least=1).count() == 0
