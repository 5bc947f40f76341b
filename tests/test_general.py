"""Key counts by array blocks and incremental selection, against brute force and with awkward input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import hotkeys as H
from linkloom.operators import incremental as I

EDGE = "id long, source_id long, target_id long, link_type string, n string, key string"


def test_counts_with_a_hot_key(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, 7 if rng.random() < 0.4 else rng.randint(-50, 50), rng.choice([None, 1, 2, 3, 1 << 40]), rng.choice(["wikilink", "tag", None]), "x", "y") for i in range(4000)]
    rows += rows[:500] + [(None, 1, 1, "tag", "x", "y")]  # repeated rows, a row without an id
    df = spark.createDataFrame(rows, EDGE)
    monkeypatch.setattr(H, "CHUNK_ROWS", 300)
    want, content = collections.Counter(), collections.Counter()
    for i, s, t, kind, *_ in {r[0]: r for r in rows if r[0] is not None}.values():
        for role, k in (("source", s), ("target", t)):
            if k is not None:
                want[role, k] += 1
                content[role, k] += kind == "wikilink"
    got = {(r.key_role, r.node_id): (r.n_edges, r.n_content) for r in H.key_counts(df).collect()}
    assert got == {k: (n, content[k]) for k, n in want.items()}
    heavy = {(r.key_role, r.node_id) for r in H.heavy_keys(df).collect()}
    assert heavy == {k for k, n in want.items() if n * 100 >= 4000}


def test_counts_of_nothing(spark):
    df = spark.createDataFrame([], EDGE)
    assert H.key_counts(df).count() == 0 and H.heavy_keys(df).count() == 0
    df = spark.createDataFrame([(1, None, None, None, None, None)], EDGE)
    assert H.key_counts(df).count() == 0 and H.heavy_keys(df).count() == 0


def test_sums_and_prefix(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, -3), (None, 9)], "k long, v int")
    got = {tuple(r) for r in H.dense_key_aggregate(df, {"a": "k"}, ["v"], prefix="p_").collect()}
    assert got == {("a", 1, 2, 5), ("a", 2, 1, -3)}


NODES = "id long, type string, path string, mtime long, seen_at timestamp"


def ts(s):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=s)


def test_pending_files(spark):
    nodes = spark.createDataFrame(
        [
            (1, "note", "a", 5, ts(1)), (1, "note", "a", 4, ts(0)), (1, "note", "a", 5, ts(1)),  # the latest row counts, once
            (2, "note", "b", 5, ts(1)),  # only a failed run knows it
            (3, "asset", "c", 9, ts(1)),  # older than recorded
            (4, "note", "d", None, ts(1)),  # unknown time
            (5, "tag", None, None, ts(1)), (6, "note", "e", 7, ts(1)), (None, "note", "f", 1, ts(1)), (7, "note", None, 1, ts(1)),
        ],
        NODES,
    )
    runs = spark.createDataFrame([(1, ts(2), ts(3), "ok"), (2, ts(4), None, "killed"), (3, ts(5), ts(6), "ok"), (4, ts(7), ts(8), "failed")], "run_id long, started_at timestamp, finished_at timestamp, status string")
    log = spark.createDataFrame(
        [(1, "a", 4, ts(3)), (3, "a", 5, ts(5)), (4, "b", 5, ts(7)), (1, "c", 9, ts(3)), (3, "c", 10, ts(5)), (3, "d", 1, ts(5)), (1, "e", 1, ts(9)), (3, "e", 7, ts(4)), (3, "e", 7, ts(4)), (3, None, 1, ts(5)), (99, "b", 5, ts(5))],
        "run_id long, path string, mtime long, logged_at timestamp",
    )
    assert sorted(r.node_id for r in I.pending_files(nodes, runs, log).collect()) == [2, 3, 4, 7]
    assert I.open_since(runs).first()[0] == ts(4)  # the killed run may still be writing
    none = runs.filter("status = 'none'")
    assert I.open_since(none).first()[0] is None
    assert I.pending_files(nodes, none, log).count() == 6
    assert I.pending_files(nodes.limit(0), runs, log.limit(0)).count() == 0


class Jobs:
    """Output in one folder a run, as a job would overwrite it, and a death at a chosen step."""

    def __init__(self, spark, tmp_path):
        self.journal = I.Journal(spark, f"file://{tmp_path}/j")
        self.spark, self.out, self.handed, self.dies = spark, {}, [], ""

    def rows(self, *p):
        return self.spark.createDataFrame(list(p), "path string, mtime long, key string")

    def work(self, df, run):
        if self.dies == "before":
            raise RuntimeError("power cut")
        self.handed.append(run)
        self.out[run] = sorted(((r.path, r.mtime) for r in df.collect()), key=str)
        if self.dies == "after":
            raise RuntimeError("power cut")

    def run(self, *rows, **kw):
        self.journal.run(self.rows(*rows), "path", "mtime", self.work, **kw)

    def committed(self):
        return sorted((x for run in self.journal.committed() for x in self.out.get(run, [])), key=str)


@pytest.mark.parametrize("step", ["todo", "before", "after", "ledger", "ok"])
def test_journal_survives_a_crash(spark, tmp_path, monkeypatch, step):
    j = Jobs(spark, tmp_path)
    j.run(("a", 1, "x"), ("b", 1, "x"))
    real_create = I.Journal._create
    with monkeypatch.context() as m:
        j.dies = step
        if step == "todo":
            m.setattr(I.Journal, "_finish", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
        if step == "ledger":
            real_lit = F.lit
            m.setattr(I.F, "lit", lambda x: (_ for _ in ()).throw(RuntimeError("power cut")) if isinstance(x, str) and x == "00000002" else real_lit(x))
        if step == "ok":
            m.setattr(I.Journal, "_create", lambda self, name, body: (_ for _ in ()).throw(RuntimeError("power cut")) if name.endswith(".ok") else real_create(self, name, body))
        with pytest.raises(RuntimeError):
            j.run(("a", 2, "x"), ("b", 1, "x"))
    j.dies = ""
    j.run(("a", 2, "x"), ("b", 1, "x"), ("c", 1, "x"))
    assert j.committed() == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]  # nothing twice, nothing left out
    j.run(("a", 2, "x"), ("c", 1, "x"))
    assert j.out[j.journal.committed()[-1]] == []
    j.run(("a", 1, "x"))  # a version that went back is a change too
    assert j.out[j.journal.committed()[-1]] == [("a", 1)]


def test_journal_takes_one_run_at_a_time(spark, tmp_path, monkeypatch):
    j = Jobs(spark, tmp_path)

    def nested(df, run):
        with pytest.raises(I.Busy):
            j.run(("z", 1, "x"))
        j.work(df, run)

    j.journal.run(j.rows(("a", 1, "x"), (None, 1, "x"), ("n", None, "x")), "path", "mtime", nested)
    assert len(j.handed) == 1
    # a run whose lease was taken can't commit, and the one that took it has its records
    monkeypatch.setattr(I.Journal, "LEASE_SECONDS", 0)

    def slow(df, run):
        import time

        j.work(df, run)
        time.sleep(1.1)
        j.run(("b", 1, "x"))

    with pytest.raises(Exception):  # what it was given is gone
        j.journal.run(j.rows(("b", 1, "x")), "path", "mtime", slow)
    monkeypatch.undo()
    j.run(("b", 1, "x"))
    assert j.out[j.journal.committed()[-1]] == []
    assert [x for x in j.committed() if x[0] == "b"] == [("b", 1)]


def test_journal_settles_and_rereads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I.Journal, "SETTLE_RUNS", 2)
    j = Jobs(spark, tmp_path)
    for k in range(5):
        j.run(("a", k, "x"), ("b", 0, "x"), ("b", 1, "x"))  # two versions of a key in one run are both processed
    assert j.committed() == [*(("a", k) for k in range(5)), ("b", 0), ("b", 1)]
    assert len(j.journal._names("ledger")) <= 4 and len(j.journal._names("settled")) <= 2
    runs = spark.createDataFrame([(1, ts(1), ts(2)), (2, ts(3), None), (3, ts(5), ts(6))], "run_id long, started_at timestamp, finished_at timestamp")
    rows = spark.createDataFrame([("p", 1, ts(1)), ("q", 1, ts(4)), ("r", 1, None)], "path string, mtime long, at timestamp")
    other = I.Journal(spark, f"file://{tmp_path}/k")
    got = []
    take = lambda df, run: got.append(sorted(r.path for r in df.collect()))
    other.run(rows.limit(0), "path", "mtime", take, "at", runs)
    other.run(rows, "path", "mtime", take, "at", runs)  # only from the oldest transaction that was open at the run before
    other.run(rows, "path", "mtime", take, "at", runs, full=True)
    assert got == [[], ["q", "r"], ["p"]]
