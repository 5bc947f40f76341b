import json
import random

import pytest

from linkloom import runtime
from linkloom.cli import run
from linkloom.sources import render
from linkloom.sources.store import Conflict, Store
from linkloom.streaming import feed


def test_cli(spark, tmp_path):
    (tmp_path / "A.md").write_text("[[B]] #t\n[[Gone]]")
    (tmp_path / "B.md").write_text("")
    at = ["--vault", str(tmp_path)]
    with pytest.raises(FileNotFoundError):
        run(spark, ["stats", *at])
    assert run(spark, ["build", *at]) == ""
    assert json.loads(run(spark, ["stats", *at, "--format", "json", "--fields", "notes_total,edges_total"])) == {"notes_total": 2, "edges_total": 3}
    text = run(spark, ["query", *at, "--name", "B", "--fields", "backlinks"])
    assert text == "entry:\n  type: note\n  name: B\n  path: B.md\n  exists: true\nbacklinks:\n- type: note\n  name: A\n  path: A.md\n  exists: true"
    text = run(spark, ["query", *at, "--phantom", "gone", "--fields", "twohop,snippet", "--include-snippet", "1"])
    assert text == 'entry:\n  type: phantom\n  name: Gone\ntwohop:\n- via: note: A.md\n  targets:\n  - tag: #t\n  - note: B.md\nsnippet:\n- source: A.md\n  lines: 1-2\n  content:\n  - "[[B]] #t"\n  - "[[Gone]]"'
    shown = json.loads(run(spark, ["query", *at, "--phantom", "gone", "--fields", "snippet", "--include-snippet", "1", "--format", "json"]))
    assert shown == {"entry": {"type": "phantom", "name": "Gone"}, "snippet": [{"source": "A.md", "lines": "1-2", "content": ["[[B]] #t", "[[Gone]]"]}]}
    assert json.loads(run(spark, ["diagnose", *at, "--format", "json"])) == {"basename_conflicts": [], "asset_basename_conflicts": [], "phantoms": ["Gone"]}
    assert json.loads(run(spark, ["repair", *at, "--format", "json", "--dry-run"])) == {"rewritten": [], "skipped": []}
    for bad in (["stats", *at, "--format", "xml"], ["stats", *at, "--fields", "nope"]):
        with pytest.raises(ValueError):
            run(spark, bad)


def test_layout():
    shown = {"rewritten": [{"file": "a.md", "old": "[[x]]", "new": '[["y"]]'}], "skipped": [], "moved": [{"from": "a", "to": "b"}], "paths": ["p", "q"]}
    assert render.as_text(shown) == 'rewritten:\n- file: a.md\n  old: "[[x]]"\n  new: "[[\\"y\\"]]"\nmoved:\n- from: a\n  to: b\npaths:\n- p\n- q'
    assert json.loads(render.as_json(shown, True)) == shown and "skipped" not in json.loads(render.as_json(shown, False))
    with pytest.raises(ValueError, match="unknown stats field: x"):
        render.parse_fields("a, x", ["a"], "stats")


def test_feed(spark, tmp_path):
    log = tmp_path / "log"
    store = Store(spark, f"file://{tmp_path}/store")

    def push(*rows):
        spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], feed.CHANGES).coalesce(1).write.mode("append").parquet(str(log))
        q = feed.follow(spark.readStream.schema(feed.CHANGES).parquet(str(log)), store, f"{tmp_path}/cp")
        q.awaitTermination()
        g = store.read()
        return sorted(r.node_key for r in g.nodes.collect()), sorted((r.src_key, r.dst_key, r.raw_link) for r in g.edges.collect())

    nodes, edges = push((1, "put", "A.md", None, "[[x]]", 1), (2, "put", "A.md", None, "[[B]]", 2), (3, "put", "d/C.md", None, "[[A]]", 1))
    assert nodes == ["note:path:A.md", "note:path:d/C.md", "phantom:name:b"]
    nodes, edges = push((4, "put", "B.md", None, "#t", 1), (5, "move", "A.md", "n/A2.md"))
    assert nodes == ["note:path:B.md", "note:path:d/C.md", "note:path:n/A2.md", "tag:name:#t"]
    assert ("note:path:d/C.md", "note:path:n/A2.md", "[[n/A2]]") in edges and ("note:path:n/A2.md", "note:path:B.md", "[[B]]") in edges
    nodes, edges = push((6, "delete", "B.md"), (None, "put", "z.md", None, "", 1))
    assert nodes == ["note:path:d/C.md", "note:path:n/A2.md", "phantom:name:b"]


def test_moves_in_one_batch(spark, caplog):
    def rows(*r):
        return spark.createDataFrame([(*x, *[None] * (6 - len(x))) for x in r], feed.CHANGES)

    g = feed.applied(feed.empty(spark), rows((1, "put", "A.md", None, "", 1), (2, "put", "B.md", None, "", 2), (3, "put", "D.md", None, "", 3)))
    g = feed.applied(feed._cut(g), rows((4, "move", "B.md", "C.md"), (5, "move", "A.md", "B.md"), (6, "move", "D.md", "C.md")))
    assert {r.path: r.mtime for r in feed.stage(g.nodes, "nodes").collect()} == {"B.md": 1, "C.md": 2, "D.md": 3}
    assert "1 moves can't be made: D.md -> C.md" in caplog.text


def rows_of(spark, *r):
    return spark.createDataFrame([(*x, *[None] * (6 - len(x))) for x in r], feed.CHANGES)


def shown(g):
    return sorted(r.node_key for r in g.nodes.collect()), sorted((r.src_key, r.dst_key, r.raw_link) for r in g.edges.collect())


def test_links_within_a_moved_note_follow(spark):
    g = feed.applied(feed.empty(spark), rows_of(spark, (1, "put", "d/A.md", None, "[[./B]] [x](../C.md#h) [[D]]", 1), (2, "put", "d/B.md", None, "", 1), (3, "put", "C.md", None, "", 1), (4, "put", "D.md", None, "", 1)))
    g = feed.applied(feed._cut(g), rows_of(spark, (5, "move", "d/A.md", "e/f/A.md")))
    assert shown(g)[1] == [("note:path:e/f/A.md", "note:path:C.md", "[x](../../C.md#h)"), ("note:path:e/f/A.md", "note:path:D.md", "[[D]]"), ("note:path:e/f/A.md", "note:path:d/B.md", "[[../../d/B]]")]


@pytest.mark.parametrize("seed", [1])
def test_one_batch_or_many(spark, seed):
    """The changes of a batch give the graph that they give one by one."""
    rng = random.Random(seed)
    paths = ["A.md", "d/B.md", "C.md", "e/D.md"]
    rows = [(i + 1, "put", p, None, " ".join(f"[[{n}]]" for n in rng.sample(["A", "B", "C", "D", "X"], 2)), i) for i, p in enumerate(paths[:3])]
    for i in range(4, 8):
        a, b = rng.sample(paths, 2)
        rows.append(rng.choice([(i, "put", a, None, f"[[{rng.choice('ABCDX')}]]", i), (i, "move", a, b), (i, "delete", a)]))
    many = feed.empty(spark)
    for r in rows:
        many = feed._cut(feed.applied(many, rows_of(spark, r)))
    assert shown(feed.applied(feed.empty(spark), rows_of(spark, *rows))) == shown(many)


def test_a_batch_counts_once_whatever_else_is_published(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    store.publish(feed.applied(feed.empty(spark), rows_of(spark, (1, "put", "A.md", None, "", 1))))  # a store that a build has published to
    log = tmp_path / "log"

    def push(*rows):
        rows_of(spark, *rows).coalesce(1).write.mode("append").parquet(str(log))
        q = feed.follow(spark.readStream.schema(feed.CHANGES).parquet(str(log)), store, f"{tmp_path}/cp")
        q.awaitTermination()

    staged = set(runtime._STAGED)
    push((2, "put", "Z.md", None, "[[A]]", 1))
    assert {r.path for r in store.read().nodes.collect()} == {"A.md", "Z.md"}
    real = Store.publish

    def dies(self, g, batch=None):
        real(self, g, batch)
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:  # death between the publish and the stream's own note of the batch
        m.setattr(Store, "publish", dies)
        with pytest.raises(Exception):
            push((3, "move", "Z.md", "Y.md"))
    n = store.current()
    push((4, "put", "Z.md", None, "", 1))
    assert {r.path for r in store.read().nodes.collect()} == {"A.md", "Y.md", "Z.md"} and store.current() == n + 1
    assert set(runtime._STAGED) == staged  # what the batches staged is gone


def test_two_writers(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    g = store.publish(feed.applied(feed.empty(spark), rows_of(spark, (1, "put", "A.md", None, "", 1))))
    real, other = Store._lock, Store(spark, f"file://{tmp_path}/store")

    def late(self):
        monkeypatch.setattr(Store, "_lock", real)
        other.publish(g)  # while the first writes its tables
        real(self)

    monkeypatch.setattr(Store, "_lock", late)
    with pytest.raises(Conflict):
        store.publish(g)
    assert store.current() == 2 and g.nodes.count() == 1  # readers keep what they began with
