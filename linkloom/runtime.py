"""Session helpers that every operator shares: the shared folder, staged tables, shipping of the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession

_STAGED: dict[str, SparkSession] = {}
_SHIPPED: set[str] = set()
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local, a temporary folder of this machine is set; on a cluster
    without the setting this raises, as no folder of one machine would do there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="linkloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it again.

    Cuts the lineage, so that a lost executor costs a reread and not a recomputation, and lets several branches of a
    plan start from one result. The table is deleted at the end of the :func:`scope` it was made in, or else when the
    driver's Python ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/linkloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _STAGED[at] = spark
    if (mine := _SCOPE.get()) is not None:
        mine.append(at)
    return spark.read.schema(df.schema).parquet(at)


class Rows(Sequence):
    """What ``show`` makes of the rows of a staged table, in the order of some columns. They are fetched a partition at a time when they are gone through."""

    def __init__(self, rows: DataFrame, by: list[str], show: Callable[[Row], object]):
        self._rows, self._by, self._show = rows, by, show

    def __iter__(self) -> Iterator[object]:
        return map(self._show, self._rows.orderBy(*self._by).toLocalIterator())

    def __len__(self) -> int:
        return self._rows.count()

    def __bool__(self) -> bool:
        return not self._rows.isEmpty()

    def __getitem__(self, i: int | slice) -> object:
        return list(self)[i]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Sequence) and list(self) == list(other)

    __hash__ = None

    def __repr__(self) -> str:
        return f"<rows of {', '.join(self._rows.columns)}>"


def _drop(at: str) -> None:
    spark = _STAGED.pop(at)
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have gone first
        pass


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged within are deleted at the end: for jobs of a driver that lives long, such as the batches of a stream."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        for at in _SCOPE.get():
            _drop(at)
        _SCOPE.reset(token)


@atexit.register
def _drop_staged() -> None:
    for at in list(_STAGED):
        _drop(at)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one figure by which the cluster says how finely to split."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it, wherever they were started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="linkloom-ship-"), "linkloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as the session has cores, hashed on ``key``.

    Moves data only where the input has fewer splits than that, so never on a large table.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, key)
