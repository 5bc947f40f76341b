"""Vault folders: listing, reading and all-or-nothing writing of changed texts, all by tasks, so that the driver holds neither paths nor texts."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.globs import check_globs
from linkloom.runtime import partitions, ship, stage

DATA_DIR, CONFIG = ".linkloom", "linkloom.yaml"


@dataclass
class Config:
    build_excludes: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    exclude_tags: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, vault: str) -> Config:
        """No file is an empty configuration; a broken one is an error."""
        at = Path(vault, CONFIG)
        if not at.exists():
            return cls()
        import yaml

        try:
            raw = yaml.safe_load(at.read_text()) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"can't read {CONFIG}: {e}") from e
        build, ex = raw.get("build") or {}, raw.get("exclude") or {}
        return cls(build.get("exclude_paths") or [], ex.get("paths") or [], ex.get("tags") or [])


def _entries(vault: str, hidden: bool = True, data: bool = False, below: str = "") -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of all below a folder, one after the other, in no order; ``data`` takes in the data folder."""
    todo = [below]
    while todo:
        at = todo.pop()
        try:
            inside = os.scandir(os.path.join(vault, at))
        except OSError:
            continue
        with inside:
            for e in inside:
                folder, path = e.is_dir(), f"{at}/{e.name}" if at else e.name
                if folder and not data and path == DATA_DIR or not hidden and e.name.startswith("."):
                    continue
                if folder and not e.is_symlink():
                    todo.append(path)
                yield path, folder


def _listed(spark: SparkSession, vault: str, hidden: bool, data: bool, keeps: Callable[[str, bool], bool]) -> DataFrame:
    """(path) of what is below ``vault``, listed once by one task, which holds names of folders only."""
    ship(spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in (r for b in batches for r in range(b.num_rows)):
            some: list[str] = []
            for path, folder in _entries(vault, hidden, data):
                if keeps(path, folder):
                    some.append(path)
                if len(some) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(some)], names=["path"])
                    some = []
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])

    rows = spark.range(1, numPartitions=1).mapInArrow(walk, "path string")
    return stage(rows.repartition(partitions(spark)), "listed")


def _without(excludes: list[str]) -> Callable[[str], bool]:
    check_globs(excludes)
    tests = [re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), re.S) for p in excludes]
    return lambda path: not any(t.fullmatch(path) for t in tests)


def notes_in(spark: SparkSession, vault: str, excludes: list[str] = ()) -> DataFrame:
    """(path) of all ``.md`` files, hidden ones too; only the data folder is left out."""
    kept = _without(list(excludes))
    return _listed(spark, vault, True, False, lambda p, folder: not folder and p.lower().endswith(".md") and kept(p))


def assets_in(spark: SparkSession, vault: str, excludes: list[str] = ()) -> DataFrame:
    """(path) of all other files, hidden files and folders left out."""
    kept = _without(list(excludes))
    return _listed(spark, vault, False, False, lambda p, folder: not folder and not p.lower().endswith(".md") and kept(p))


def everything(spark: SparkSession, vault: str) -> DataFrame:
    """(path) of all that a path can lead to: files and folders, hidden, excluded and empty ones and the data folder included."""
    return _listed(spark, vault, True, True, lambda p, folder: True)


def assets_below(vault: str, folder: str) -> list[str]:
    """The files below ``folder`` that aren't notes, in walk order; hidden ones and those in hidden folders left out."""
    folder = folder.rstrip("/")
    if any(not part or part.startswith(".") for part in folder.split("/")):
        return []
    return sorted((p for p, inner in _entries(vault, hidden=False, below=folder) if not inner and not p.lower().endswith(".md")), key=lambda p: p.split("/"))


def ranked(paths: DataFrame, order: Column | None = None) -> DataFrame:
    """(path, walk_ord) of ``paths``, each of which comes once, numbered from 0 in an order: that of a walk, else ``order``."""
    spark, low = paths.sparkSession, (1 << 33) - 1
    rows = paths.select("path", (F.split("path", "/") if order is None else order).alias("by")).repartitionByRange(partitions(spark), "by").sortWithinPartitions("by")
    rows = stage(rows.select("path", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("i")), "ranked")
    starts, top = [], 0
    for r in rows.groupBy("part").count().orderBy("part").collect():  # as many as the session has partitions
        starts.append((r.part, top))
        top += r["count"]
    return rows.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").select("path", (F.col("start") + F.col("i")).alias("walk_ord"))


def first_other_file(vault: str, folder: str) -> str | None:
    """The first file below ``folder`` that isn't a note, hidden ones aside."""
    inside = assets_below(vault, folder)
    return inside[0] if inside else None


def mtime(vault: str, path: str) -> int:
    return int(os.stat(os.path.join(vault, path)).st_mtime)


def _mtime(at: str) -> int | None:
    try:
        return int(os.stat(at).st_mtime)
    except OSError:
        return None


def mtimes(vault: str, paths: DataFrame) -> DataFrame:
    """``paths`` (path) with ``now``, the time of each file, null if it isn't there."""
    ship(paths.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([_mtime(os.path.join(vault, p)) for p in b.column("path").to_pylist()], pa.int64())], names=["path", "now"])

    return paths.select("path").mapInArrow(look, "path string, now long")


def read_notes(spark: SparkSession, vault: str, paths: list[str] | DataFrame, first: int = 0) -> DataFrame:
    """(path, content, mtime, walk_ord, raw) of notes, a list or (path, walk_ord), read where the tasks run; ``vault`` must be
    reachable from there. ``raw`` has the bytes of a note that isn't UTF-8, else null."""
    ship(spark)
    listed = paths.select("path", "walk_ord") if isinstance(paths, DataFrame) else spark.createDataFrame([(p, i + first) for i, p in enumerate(paths)], "path string, walk_ord long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, times, raw = [], [], []
            for p in b.column("path").to_pylist():
                at = os.path.join(vault, p)
                with open(at, "rb") as f:
                    data = f.read()
                texts.append(data.decode("utf-8", "replace"))
                raw.append(None if texts[-1].encode() == data else data)
                times.append(int(os.stat(at).st_mtime))
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), pa.array(texts, pa.string()), pa.array(times, pa.int64()), b.column("walk_ord"), pa.array(raw, pa.binary())], names=["path", "content", "mtime", "walk_ord", "raw"]
            )

    return listed.mapInArrow(read, "path string, content string, mtime long, walk_ord long, raw binary")


def asset_files(vault: str, assets: DataFrame) -> DataFrame:
    """(path, mtime, walk_ord) of ``assets`` (path, walk_ord)."""
    return assets.join(mtimes(vault, assets), "path").select("path", F.col("now").alias("mtime"), "walk_ord")


def _done(rows: DataFrame, do: Callable[[dict], None]) -> str | None:
    """Do something for each row, in the tasks; what went wrong, if anything did. The first failure ends a task's share."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: list[str] = []
        for b in batches:
            for part in (b.slice(i, 100) for i in range(0, b.num_rows, 100)):
                for r in part.to_pylist() if not bad else ():
                    try:
                        do(r)
                    except OSError as e:
                        bad.append(str(e))
                        break
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["bad"])

    return rows.mapInArrow(work, "bad string").agg(F.min("bad")).first()[0]


def write_all(vault: str, texts: DataFrame, old: DataFrame) -> None:
    """Write every text (path, content) over the note that is there, or none: all of ``old`` is put back if one fails. Permissions stay.

    What ``texts`` is made of mustn't change with the files, as a task that is run again makes its texts again.
    """

    def write(r: dict) -> None:
        with open(os.path.join(vault, r["path"]), "r+b") as f:
            f.write(r["content"].encode())
            f.truncate()

    try:
        if bad := _done(texts.select("path", "content"), write):
            raise OSError(bad)
    except Exception:
        restore(vault, old)
        raise


def restore(vault: str, old: DataFrame) -> None:
    """Put the texts of a staged table (path, content, raw) back."""

    def write(r: dict) -> None:
        try:
            Path(vault, r["path"]).write_bytes(r["content"].encode() if r["raw"] is None else r["raw"])
        except OSError:
            pass

    _done(old.select("path", "content", "raw"), write)


def create(vault: str, files: DataFrame) -> None:
    """Files (path, content) with the folders they lie in; what is there is written over."""

    def write(r: dict) -> None:
        at = os.path.join(vault, r["path"])
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8", newline="") as f:
            f.write(r["content"])

    if bad := _done(files.select("path", "content"), write):
        raise OSError(bad)


def copy(spark: SparkSession, vault: str, to: str) -> None:
    """All files of a vault, its index included, with their times."""

    def one(r: dict) -> None:
        a, b = os.path.join(vault, r["path"]), os.path.join(to, r["path"])
        if not os.path.isdir(a):
            os.makedirs(os.path.dirname(b), exist_ok=True)
            shutil.copy2(a, b)

    if bad := _done(everything(spark, vault), one):
        raise OSError(bad)


def remove(vault: str, paths: DataFrame) -> None:
    """Files that go, if they are there."""
    if bad := _done(paths.select("path"), lambda r: Path(vault, r["path"]).unlink(missing_ok=True)):
        raise OSError(bad)


def remove_empty_folders(vault: str, paths: list[str]) -> None:
    """Folders of ``paths`` that are empty now go, and those above them likewise."""
    for p in paths:
        up = os.path.dirname(p)
        while up:
            try:
                os.rmdir(os.path.join(vault, up))
            except OSError:
                break
            up = os.path.dirname(up)
