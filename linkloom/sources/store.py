"""Snapshots of a graph on shared storage, published by swapping one pointer."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from linkloom.operators.graph import Graph
from linkloom.schema import EDGES, NODES

#: Seconds for which a snapshot that no longer counts is kept for those who began to read it, and after which a lock is taken for a dead writer's.
KEPT_SECONDS, LOCK_SECONDS = 3600, 120


class NoIndex(FileNotFoundError):
    pass


class Conflict(RuntimeError):
    """Another writer has published since the graph was read that a publish builds on."""


@dataclass(frozen=True)
class State:
    """What the pointer says: the number and folder of the snapshot that counts, and the last batch of each stream that it holds."""

    number: int
    folder: str
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """``base`` holds ``snapshots/<folder>/nodes`` and ``/edges`` and the file ``CURRENT`` that names the one that counts.

    Edges are written sorted by target, so that Parquet's statistics let a lookup by ``dst_key`` skip most of them.
    A writer that dies leaves the pointer where it was. Every writer has a folder of its own; of two that build on one
    snapshot the second to swap the pointer raises :class:`Conflict`. Readers keep the snapshot they began with for
    ``KEPT_SECONDS`` after it ceased to count.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> State | None:
        at = self._path(f"{self.base}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            got = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return State(**got)

    def current(self) -> int | None:
        got = self.state()
        return got and got.number

    def read(self) -> Graph:
        got = self.state()
        if got is None:
            raise NoIndex(f"index not found in {self.base}: build it first")
        return self._graph(got.folder)

    def _graph(self, folder: str) -> Graph:
        at = f"{self.base}/snapshots/{folder}"
        return Graph(self.spark.read.schema(NODES).parquet(f"{at}/nodes"), self.spark.read.schema(EDGES).parquet(f"{at}/edges"))

    def publish(self, g: Graph, batch: tuple[str, int] | None = None) -> Graph:
        """Make ``g`` the graph that counts. ``batch`` (stream, number) is kept with it, in the same swap of the pointer."""
        before = self.state()
        folder = uuid.uuid4().hex
        at = f"{self.base}/snapshots/{folder}"
        g.nodes.write.parquet(f"{at}/nodes")
        g.edges.repartitionByRange("dst_key").sortWithinPartitions("dst_key", "occ_ord").write.parquet(f"{at}/edges")
        batches = {**(before.batches if before else {}), **(dict([batch]) if batch else {})}
        self._lock()
        try:
            if self.state() != before:
                self._fs.delete(self._path(at), True)
                raise Conflict(f"another writer has published to {self.base}")
            self._swap(State((before.number if before else 0) + 1, folder, batches))
        finally:
            self._fs.delete(self._path(f"{self.base}/LOCK"), False)
        self._clean(folder, before.folder if before else "")
        return self._graph(folder)

    def _lock(self) -> None:
        """Wait for the lock file; it is held for the time of the swap only."""
        at = self._path(f"{self.base}/LOCK")
        while True:
            try:
                self._fs.create(at, False).close()
                return
            except Exception as e:  # py4j wraps what the file system raises
                if not self._fs.exists(at):
                    if "AlreadyExists" not in str(e):
                        raise
                    continue
                if time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > LOCK_SECONDS:
                    self._fs.delete(at, False)
                time.sleep(0.2)

    def _swap(self, state: State) -> None:
        fresh = self._path(f"{self.base}/CURRENT.new")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(vars(state)).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kinds = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._path(f"{self.base}/CURRENT")), kinds)

    def _clean(self, *kept: str) -> None:
        """Delete snapshots that no one reads any more, those of dead writers included."""
        for s in self._fs.listStatus(self._path(f"{self.base}/snapshots")):
            if s.getPath().getName() not in kept and time.time() - s.getModificationTime() / 1000 > KEPT_SECONDS:
                self._fs.delete(s.getPath(), True)
