"""Processing of only new or changed records, over a ledger of what successful runs have recorded.

Two rules keep a run exact, whatever earlier runs left behind:

* reread from the oldest transaction open at the last successful run, never from that run's own end: a run that was
  still open then may have written, or may yet write, anything since it began;
* drop the overlap by an anti-join of (key, version) pairs against the ledger of successful runs, so that nothing is
  processed twice and nothing depends on clocks.

:func:`open_since` gives the first, :func:`pending_records` the second; :class:`Journal` runs jobs by them, with the ledger
on disk.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.runtime import table

OK = "ok"


def open_since(runs: DataFrame) -> DataFrame:
    """One row (``open_from`` timestamp): the start of the oldest run that was open when the last successful run began.

    Open is a run without an end, or one that ended no earlier than the last successful run began; that run itself is
    one of them. Runs whose end isn't known stay open for ever, as nobody can say that they have stopped writing.
    Null if no run was successful: then everything is to be read.
    """
    last = runs.filter(F.col("status") == OK).agg(F.max("run_id").alias("r"), F.max_by("started_at", "run_id").alias("t")).select("r", "t")
    return (
        runs.select("run_id", "started_at", "finished_at")
        .join(F.broadcast(last), (F.col("run_id") <= F.col("r")) & (F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("t"))))
        .agg(F.min("started_at").alias("open_from"))
    )


def ledger_state(log: DataFrame, runs: DataFrame, key: str = "path", version: str = "mtime") -> DataFrame:
    """(key, version) as the last row of a successful run has it: highest ``run_id``, then latest ``logged_at``.

    Rows of unsuccessful and unknown runs and rows without a key don't count. Of rows that tie in run and time, the
    one with the greatest version counts. Runs are as few as the runs of an indexer (one row each), so that side is
    left to the planner's size check for a broadcast.
    """
    good = runs.filter(F.col("status") == OK).select("run_id").distinct()
    rows = log.filter(F.col(key).isNotNull()).select("run_id", F.col(key).alias("key"), F.col(version).alias("version"), "logged_at")
    order = F.struct("run_id", "logged_at", "version")
    return rows.join(good, "run_id", "left_semi").groupBy("key").agg(F.max(order).alias("last")).select("key", F.col("last.version").alias("version"))


def latest_rows(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The row of each key with the latest ``at``; of rows that tie, the one with the greatest ``columns``. Null keys give none."""
    order = F.struct(F.col(at).alias("_at"), *columns)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def pending_records(rows: DataFrame, ledger: DataFrame, key: str, version: str) -> DataFrame:
    """The rows whose (key, version) pair isn't the ledger's state of the key.

    A row with a null key or version is always pending: nothing proves that it was processed. Repeated rows stay
    repeated; rows keep all their columns, and a clash of their names with the ledger's does no harm.
    """
    state = ledger.select(F.col("key").alias("__key"), F.col("version").alias("__version"))
    return rows.join(state, (rows[key] == state["__key"]) & (rows[version] == state["__version"]), "left_anti")


def settled_and_reread(rows: DataFrame, at: str, open_from: DataFrame) -> DataFrame:
    """Mark each row with ``reread``: recorded since ``open_from`` (or at an unknown time, or nothing is settled)."""
    return rows.join(F.broadcast(open_from)).withColumn("reread", F.col("open_from").isNull() | F.col(at).isNull() | (F.col(at) >= F.col("open_from"))).drop("open_from")


def pending_files(nodes: DataFrame, runs: DataFrame, log: DataFrame) -> DataFrame:
    """(node_id, reread) of every note and asset that the next run must process.

    ``reread`` tells whether the row falls in the window that begins with the oldest transaction open at the last
    successful run. Rows from before it are held against the ledger all the same: rows come late, and runs that broke
    off leave holes of any age, which a window alone would miss.
    """
    files = nodes.filter(F.col("type").isin("note", "asset")).withColumn("at", F.col("seen_at"))
    files = latest_rows(files, "id", "seen_at", ["path", "mtime", "at"])
    missing = pending_records(files, ledger_state(log, runs), "path", "mtime")
    return settled_and_reread(missing, "at", open_since(runs)).select(F.col("id").alias("node_id"), "reread")


class Busy(RuntimeError):
    """Another run holds the journal's lease."""


class Journal:
    """A processed ledger on shared storage, by which a job can be run again and again, and can die at any point.

    ``base`` holds the ``LEASE`` of the one run that is at work, ``runs/<n>.start`` and ``runs/<n>.ok`` markers,
    ``todo/<n>`` with what run n was given, ``ledger/<n>-<owner>`` with what it has processed, and ``settled/<n>`` with the state
    after all runs up to n. A run

    1. takes the lease, which a thread renews; that of a dead run can be taken after ``LEASE_SECONDS``,
    2. takes a number by creating the start marker, which only one can,
    3. writes the pending records down: those whose (key, version) isn't in the state of the ledger,
    4. hands them to ``work`` with the run's id; the work must be idempotent for one id, such as overwriting one folder,
    5. writes the (key, version) pairs to the ledger and then creates the ``ok`` marker, if the lease is still its own.

    A run that died is taken up first by the next one, under its own id and with the records that it wrote down, so what
    it may have put out is overwritten and not repeated. So each record version is committed by exactly one run id. A
    record without a version is pending in every run, as nothing can tell that it hasn't changed; one without a key too.
    Every ``SETTLE_RUNS`` runs the ledger is compacted, so no more than twice as many parts are read.

    With ``at`` (a timestamp column of the records) and ``transactions`` (run_id, started_at, finished_at, status of those
    who write them) a run reads only what was recorded since the oldest transaction that was open at the run before it,
    or at an unknown time. That is enough where no record carries a time from before its transaction began; otherwise
    ``full=True``, the default without them, holds all records against the ledger, which is exact.
    """

    LEASE_SECONDS, SETTLE_RUNS = 120, 16

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- files

    def _at(self, name: str):
        return self._path(f"{self.base}/{name}")

    def _create(self, name: str, body: dict) -> bool:
        """Write a file that isn't there yet; False if it is."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # py4j wraps what the file system raises
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(body, default=str).encode()))
        out.close()
        return True

    def _body(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "{}")
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _whole(self, folder: str) -> bool:
        return self._fs.exists(self._at(f"{folder}/_SUCCESS"))

    def _marked(self, kind: str) -> list[str]:
        return [n.removesuffix(f".{kind}") for n in self._names("runs") if n.endswith(f".{kind}")]

    # ---- the lease

    @contextmanager
    def _lease(self) -> Iterator[str]:
        owner = uuid.uuid4().hex
        if not self._create("LEASE", {"owner": owner}):
            at = self._at("LEASE")
            if self._fs.exists(at) and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 <= self.LEASE_SECONDS:
                raise Busy(f"a run is at work in {self.base}")
            self._fs.delete(at, False)
            if not self._create("LEASE", {"owner": owner}):
                raise Busy(f"a run is at work in {self.base}")
        ended = threading.Event()

        def renew() -> None:
            while not ended.wait(max(1, self.LEASE_SECONDS / 4)):
                if self._holds(owner):
                    self._fs.setTimes(self._at("LEASE"), int(time.time() * 1000), -1)

        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            yield owner
        finally:
            ended.set()
            keeper.join()
            if self._holds(owner):
                self._fs.delete(self._at("LEASE"), False)

    def _holds(self, owner: str) -> bool:
        return self._fs.exists(self._at("LEASE")) and self._body("LEASE").get("owner") == owner

    # ---- the ledger

    def committed(self) -> list[str]:
        return self._marked("ok")

    def ledger(self) -> DataFrame | None:
        """(key, version, run): the pairs that the last committed run of each key has processed. Null if nothing is committed."""
        settled = [n for n in self._names("settled") if self._whole(f"settled/{n}")]
        last = settled[-1] if settled else ""
        parts = [f"{self.base}/ledger/{self._body(f'runs/{n}.ok')['ledger']}" for n in self.committed() if n > last] + [f"{self.base}/settled/{n}" for n in settled[-1:]]
        if not parts:
            return None
        rows = self.spark.read.parquet(*parts)
        newest = rows.groupBy(F.col("key").alias("k")).agg(F.max("run").alias("r"))
        return rows.join(newest, (F.col("key") == F.col("k")) & (F.col("run") == F.col("r"))).select("key", "version", "run")

    def settle(self) -> None:
        """Put the ledger into one table. What it replaces is deleted by the next call, so that readers can end."""
        done, known = self.committed(), self._names("settled")
        if not done or done[-1] in known and self._whole(f"settled/{done[-1]}"):
            return
        self.ledger().distinct().write.mode("overwrite").parquet(f"{self.base}/settled/{done[-1]}")
        for n in known[:-1]:
            self._fs.delete(self._at(f"settled/{n}"), True)
        for n in self._names("ledger"):
            if known and n[:8] <= known[-1]:
                self._fs.delete(self._at(f"ledger/{n}"), True)

    # ---- runs

    def run(self, rows: DataFrame, key: str, version: str, work: Callable[[DataFrame, str], None], at: str | None = None, transactions: DataFrame | None = None, full: bool | None = None) -> str:
        """Process what is pending, after what a dead run left; the id of the run. Raises :class:`Busy` while another is at work."""
        with self._lease() as owner:
            for left in sorted(set(self._marked("start")) - set(self.committed())):
                if self._whole(f"todo/{left}"):
                    self._finish(left, owner, key, version, work)
                # a run that wrote nothing down has put nothing out; its number is used up
            n = int((self._marked("start") or ["0"])[-1]) + 1
            body = {"reread_from": self._open_from(transactions)} if transactions is not None else {}
            while not self._create(f"runs/{n:08d}.start", body):
                n += 1
            run = f"{n:08d}"
            if transactions is not None and at is not None and not full:
                since = next((b for m in reversed(self.committed()) if (b := self._body(f"runs/{m}.start").get("reread_from"))), None)
                if since is not None:
                    rows = rows.filter(F.col(at).isNull() | (F.col(at) >= F.lit(since).cast("timestamp_ntz" if rows.schema[at].dataType.typeName() == "timestamp_ntz" else "timestamp")))
            ledger = self.ledger()
            todo = rows if ledger is None else pending_records(rows, ledger, key, version)
            todo.write.mode("overwrite").parquet(f"{self.base}/todo/{run}")  # one reading of rows that may change
            self._finish(run, owner, key, version, work)
            if len([m for m in self._names("ledger")]) >= self.SETTLE_RUNS:
                self.settle()
            return run

    @staticmethod
    def _open_from(transactions: DataFrame) -> str | None:
        """The start of the oldest transaction that is open now; if none is, that of the last one."""
        got = transactions.agg(F.min(F.when(F.col("finished_at").isNull(), F.col("started_at"))).cast("string"), F.max("started_at").cast("string")).first()
        return got[0] or got[1]

    def _finish(self, run: str, owner: str, key: str, version: str, work: Callable[[DataFrame, str], None]) -> None:
        todo = self.spark.read.parquet(f"{self.base}/todo/{run}")
        work(todo, run)
        pairs = todo.select(F.col(key).alias("key"), F.col(version).alias("version"), F.lit(run).alias("run")).filter("key is not null and version is not null").distinct()
        part = f"{run}-{owner}"  # a run that lost its lease without knowing writes elsewhere
        pairs.write.mode("overwrite").parquet(f"{self.base}/ledger/{part}")
        if not self._holds(owner) or not self._create(f"runs/{run}.ok", {"ledger": part}):
            raise Busy(f"run {run} lost its lease to another, which takes it up")
        self._fs.delete(self._at(f"todo/{run}"), True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pending_files(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "index_runs"), table(spark, sf_dir, "run_log"))
    return found.select("node_id")
