"""A graph kept up to date from a stream of changes, batch by batch.

A change is (seq long, op string, path string, to_path string, content string, mtime long) with the operations ``put``,
``delete`` and ``move``. A batch is cut wherever a move shares a path with another change, so that chains of moves are
made in order of ``seq``; between two cuts only the last change of each path counts. A move that can't be made, as its file
isn't there or its destination is taken, is logged as a warning. Links within a moved note follow it as those to it do. Each
batch is applied to the snapshot that the one before it left and is published by one pointer swap, together with the
stream's id and the batch's number; so a batch that is handed over again after a failure is left out, whatever else has
been published to the store. What a batch stages is deleted at its end.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions import links
from linkloom.operators import graph as G
from linkloom.operators import rewrite as R
from linkloom.operators.resolve import note_key
from linkloom.runtime import scope, stage
from linkloom.sources.store import Store

log = logging.getLogger(__name__)
#: Moves that can't be made which a warning names; it counts all.
NAMED = 20

CHANGES = "seq long, op string, path string, to_path string, content string, mtime long"


def last_changes(changes: DataFrame) -> DataFrame:
    """The change of each path with the highest ``seq``; rows without a path or number don't count."""
    rows = changes.filter("path is not null and seq is not null and op in ('put', 'delete', 'move')")
    return rows.groupBy("path").agg(F.max_by(F.struct("op", "to_path", "content", "mtime", "seq"), "seq").alias("c")).select("path", "c.*")


def conflicts(changes: DataFrame) -> DataFrame:
    """(prev, seq) of changes that follow each other on a path, as source or destination, if one of them is a move."""
    move = F.col("op") == "move"
    rows = changes.filter("path is not null and seq is not null and op in ('put', 'delete', 'move')")
    touched = rows.select("seq", move.alias("move"), F.explode(F.when(move & F.col("to_path").isNotNull(), F.array("path", "to_path")).otherwise(F.array("path"))).alias("at"))
    touched = touched.groupBy("at", "seq").agg(F.max("move").alias("move"))
    w = Window.partitionBy("at").orderBy("seq")
    return touched.select(F.lag("seq").over(w).alias("prev"), "seq", (F.col("move") | F.lag("move").over(w)).alias("either")).filter("either and prev is not null").select("prev", "seq")


def _cut(g: G.Graph) -> G.Graph:
    """The graph as tables, so that the plans of the steps don't pile up."""
    return G.Graph(stage(g.nodes, "nodes"), stage(g.edges, "edges"))


def applied(g: G.Graph, changes: DataFrame) -> G.Graph:
    """``g`` after a batch, part by part: each ends before the first change that conflicts with one in it."""
    changes = stage(changes, "batch")
    clash = stage(conflicts(changes), "conflicts")
    part, rest = changes, clash
    while (end := rest.agg(F.min("seq")).first()[0]) is not None:
        g = _cut(_applied(g, part.filter(F.col("seq") < end)))
        part, rest = changes.filter(F.col("seq") >= end), clash.filter(F.col("prev") >= end)
    return _applied(g, part)


def written_links(g: G.Graph, sources: DataFrame) -> DataFrame:
    """The links of the notes ``sources`` (path), read again from their raw form, as extraction gives them."""
    src = g.nodes.filter("type = 'note' and exists_flag").join(sources, "path", "left_semi").select(F.col("node_key").alias("src_key"), F.col("path").alias("src_path"), F.col("node_ord").alias("walk_ord"))
    raw, line = F.col("raw_link"), F.col("line_start")
    own = g.edges.filter(F.col("link_type").isin("wikilink", "markdown")).join(src, "src_key")
    read = F.when(F.col("link_type") == "wikilink", links.wikilinks(raw, line)).otherwise(links.markdown_links(raw, line))
    return own.withColumn("o", F.try_element_at(read, F.lit(1))).filter("o is not null").select("src_path", "o.target", "o.is_basename", "o.is_relative", "link_type", "raw_link", "o.subpath", "line_start", "line_end", "walk_ord", "occ_ord")


def _refused(moves: DataFrame, made: DataFrame) -> None:
    """Warn of the moves that weren't made."""
    lost = moves.filter("from_path <> to_path").join(made, ["from_path", "to_path"], "left_anti")
    if n := lost.count():
        log.warning("%d moves can't be made: %s", n, ", ".join(f"{r.from_path} -> {r.to_path}" for r in lost.orderBy("from_path").limit(NAMED).collect()))


def _applied(g: G.Graph, changes: DataFrame) -> G.Graph:
    """``g`` after changes without conflicts: moves first, then new and changed notes, then what is gone. Links that escape or are unclear end in phantoms."""
    last = stage(last_changes(changes), "changes")
    wanted = last.filter("op = 'move'").select(F.col("path").alias("from_path"), F.coalesce("to_path", F.lit("")).alias("to_path"))
    known = g.nodes.filter("exists_flag and path is not null").select(F.col("path").alias("from_path"))
    moved = wanted.filter("to_path <> ''").join(known, "from_path", "left_semi").dropDuplicates(["to_path"])
    free = g.nodes.filter("exists_flag and path is not null").select(F.col("path").alias("to_path"))
    moved = stage(moved.join(free, "to_path", "left_anti").select("from_path", "to_path"), "moved")
    _refused(wanted, moved)
    if moved.limit(1).collect():
        inside = R.moved_outgoing_plan(g, written_links(g, moved.select(F.col("from_path").alias("path"))), moved, batch=True)
        g = _cut(G.renamed(G.relinked(g, stage(R.move_plan(g, moved).unionByName(inside), "plan")), moved))
    old = g.nodes.filter("type = 'note'").select("path", F.col("node_ord").alias("walk_ord"))
    top = (old.agg(F.max("walk_ord")).first()[0] or 0) + 1
    puts = last.filter("op = 'put' and content is not null").join(old, "path", "left").withColumn("walk_ord", F.coalesce("walk_ord", F.lit(top) + F.col("seq")))
    puts = stage(puts.select("path", "content", "mtime", "walk_ord"), "puts")
    gone = last.filter("op = 'delete'").select("path", F.col("seq").alias("pos"))
    went = moved.filter(F.lower("to_path").endswith(".md")).join(old.select(F.col("path").alias("to_path"), F.col("walk_ord").alias("ord")), "to_path").select(F.col("to_path").alias("path"), "ord")
    fresh = puts.join(old.select("path"), "path", "left_anti").select("path", F.col("walk_ord").alias("ord")).unionByName(went)
    universe = old.join(gone.select("path"), "path", "left_anti").unionByName(puts.select("path", "walk_ord").join(old.select("path"), "path", "left_anti"))
    g = _cut(G.refreshed(g, puts, stage(universe, "universe"), check=False))
    g = _cut(G.promoted(g, fresh)[0])
    g, _ = G.removed(g, gone.select(note_key(F.col("path")).alias("node_key"), "pos"))
    return g


def empty(spark: SparkSession) -> G.Graph:
    from linkloom.schema import EDGES, NODES

    return G.Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id by which Spark knows the stream of a checkpoint, whatever was in its place before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


def follow(changes: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes to a store, all that is there now, in order of the batches."""

    def batch(rows: DataFrame, number: int) -> None:
        spark, state = rows.sparkSession, store.state()
        stream = stream_id(spark, checkpoint)
        if state is not None and state.batches.get(stream, -1) >= number:
            return  # published before the stream could note it
        with scope():
            g = empty(spark) if state is None else store.read()
            store.publish(applied(g, rows), (stream, number))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
