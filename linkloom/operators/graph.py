"""The graph: building it from files, and changing it as whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.paths import file_name, note_name
from linkloom.operators.extract import occurrences
from linkloom.operators.resolve import asset_key, link_errors, note_key, phantom_key, resolved
from linkloom.runtime import stage
from linkloom.schema import EDGE_COLUMNS, NODE_COLUMNS

_ASSETS, _REST = 1 << 40, 1 << 41


class LinkError(ValueError):
    """Links that leave the vault or could mean several files."""


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def notes(self) -> DataFrame:
        """(path, walk_ord) of the existing notes, as the resolver wants them."""
        return self.nodes.filter("type = 'note' and exists_flag").select("path", F.col("node_ord").alias("walk_ord"))

    def assets(self) -> DataFrame:
        return self.nodes.filter("type = 'asset' and exists_flag").select("path", F.col("node_ord").alias("walk_ord"))


def format_errors(errors: list[str]) -> str:
    hint = "\nhint: use path links or rename files, so that each bare name means one file" if any(e.startswith("ambiguous") for e in errors) else ""
    return (errors[0] if len(errors) == 1 else "\n".join(f"- {e}" for e in errors)) + hint


def note_nodes(notes: DataFrame) -> DataFrame:
    p = F.col("path")
    return notes.select(note_key(p).alias("node_key"), F.lit("note").alias("type"), note_name(p).alias("name"), p, F.lit(True).alias("exists_flag"), "mtime", F.col("walk_ord").alias("node_ord"))


def asset_nodes(assets: DataFrame) -> DataFrame:
    p = F.col("path")
    return assets.select(asset_key(p).alias("node_key"), F.lit("asset").alias("type"), file_name(p).alias("name"), p, F.lit(True).alias("exists_flag"), "mtime", (F.lit(_ASSETS) + F.col("walk_ord")).alias("node_ord"))


def edge_rows(res: DataFrame) -> DataFrame:
    return res.select(EDGE_COLUMNS)


def named_nodes(res: DataFrame) -> DataFrame:
    """The tags and phantoms that resolved occurrences point to, each in the spelling that comes first."""
    named = F.when(F.col("dst_key").startswith("tag:name:"), F.col("target")).when(F.col("dst_key").startswith("phantom:name:"), F.col("spelled"))
    order = F.struct("walk_ord", "occ_ord")
    first = res.select("dst_key", named.alias("name"), "walk_ord", "occ_ord").filter("name is not null").groupBy("dst_key").agg(F.min_by("name", order).alias("name"), F.min("walk_ord").alias("o"))
    kind = F.substring_index("dst_key", ":", 1)
    return first.select(
        F.col("dst_key").alias("node_key"), kind.alias("type"), "name", F.lit(None).cast("string").alias("path"), F.lit(False).alias("exists_flag"),
        F.lit(None).cast("long").alias("mtime"), (F.lit(_REST) + F.col("o")).alias("node_ord"),
    )


def build(notes: DataFrame, assets: DataFrame, check: bool = True) -> Graph:
    """The graph of ``notes`` (path, content, mtime, walk_ord) and ``assets`` (path, mtime, walk_ord).

    Raises :class:`LinkError` for the first few bad links, before anything is written; ``check=False`` takes links that
    escape or are ambiguous as phantoms instead. Notes are read once, so that nodes and edges are of one state.
    """
    notes = stage(notes, "notes")
    res = stage(resolved(occurrences(notes), notes, assets), "resolved")
    if check and (errors := link_errors(res)):
        raise LinkError(format_errors(errors))
    nodes = note_nodes(notes).unionByName(asset_nodes(assets)).unionByName(named_nodes(res))
    return Graph(nodes.select(NODE_COLUMNS), edge_rows(res))


def without_orphans(g: Graph) -> Graph:
    """Tags, phantoms and assets that no edge points to go."""
    pointed = g.edges.select(F.col("dst_key").alias("node_key")).distinct()
    kept = g.nodes.filter("type = 'note'").unionByName(g.nodes.filter("type <> 'note'").join(pointed, "node_key", "left_semi"))
    return Graph(kept.select(NODE_COLUMNS), g.edges)


def upserted(nodes: DataFrame, new: DataFrame, replace: bool) -> DataFrame:
    """``nodes`` with ``new`` by key: new rows win if ``replace``, else old ones do. A replaced node keeps its place."""
    new = new.dropDuplicates(["node_key"])
    if not replace:
        return nodes.unionByName(new.join(nodes.select("node_key"), "node_key", "left_anti").select(NODE_COLUMNS))
    old = nodes.select("node_key", F.col("node_ord").alias("old_ord"))
    placed = new.join(old, "node_key", "left").withColumn("node_ord", F.coalesce("old_ord", "node_ord")).select(NODE_COLUMNS)
    return nodes.join(new.select("node_key"), "node_key", "left_anti").select(NODE_COLUMNS).unionByName(placed)


def incoming_counts(edges: DataFrame) -> DataFrame:
    """(dst_key, n): edges from other nodes."""
    return edges.filter("src_key <> dst_key").groupBy("dst_key").agg(F.count("*").alias("n"))


def removed(g: Graph, gone: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after ``gone`` (node_key, pos) are taken away one after the other, and (node_key, path, phantomed).

    A file becomes a phantom if another note that is still there at its turn links to it: one that isn't taken away, or
    is at a later place. Links to it then go to the phantom of its name, which may exist already.
    """
    at = F.col("pos")
    taken = gone.select("node_key", "pos")
    src = taken.select(F.col("node_key").alias("src_key"), F.col("pos").alias("src_pos"))
    hit = g.edges.filter("src_key <> dst_key").join(taken.withColumnRenamed("node_key", "dst_key"), "dst_key").join(src, "src_key", "left").filter(F.col("src_pos").isNull() | (F.col("src_pos") > at))
    alive = hit.select(F.col("dst_key").alias("node_key")).distinct().withColumn("phantomed", F.lit(True))
    facts = g.nodes.join(taken, "node_key").join(alive, "node_key", "left").select("node_key", "path", "name", "pos", F.coalesce("phantomed", F.lit(False)).alias("phantomed"), "node_ord")
    remap = facts.filter("phantomed").select("node_key", phantom_key(F.col("name")).alias("new_key"))
    edges = g.edges.join(taken.select(F.col("node_key").alias("src_key")), "src_key", "left_anti")
    edges = edges.join(remap.withColumnRenamed("node_key", "dst_key"), "dst_key", "left").withColumn("dst_key", F.coalesce("new_key", "dst_key")).select(EDGE_COLUMNS)
    born = facts.filter("phantomed").select(
        phantom_key(F.col("name")).alias("node_key"), F.lit("phantom").alias("type"), "name", F.lit(None).cast("string").alias("path"),
        F.lit(False).alias("exists_flag"), F.lit(None).cast("long").alias("mtime"), "node_ord",
    )
    nodes = g.nodes.join(taken.select("node_key"), "node_key", "left_anti").select(NODE_COLUMNS)
    return without_orphans(Graph(upserted(nodes, born, replace=False), edges)), facts.select("node_key", "path", "pos", "phantomed")


def refreshed(g: Graph, notes: DataFrame, universe: DataFrame, check: bool = True) -> Graph:
    """The graph with ``notes`` (path, content, mtime, walk_ord) extracted and resolved anew among the notes ``universe`` (path, walk_ord)."""
    notes = stage(notes, "notes")
    res = stage(resolved(occurrences(notes), universe, g.assets()), "resolved")
    if check and (errors := link_errors(res, 1)):
        raise LinkError(errors[0])
    nodes = upserted(upserted(g.nodes, note_nodes(notes), replace=True), named_nodes(res), replace=False)
    kept = g.edges.join(notes.select(note_key(F.col("path")).alias("src_key")), "src_key", "left_anti").select(EDGE_COLUMNS)
    return Graph(nodes, kept.unionByName(edge_rows(res)))


def promoted(g: Graph, added: DataFrame, assets: bool = False) -> tuple[Graph, DataFrame]:
    """Phantoms that ``added`` (path, ord), notes or ``assets``, now have a file for give way to it; and (path, phantom) of these files.

    Of files that share a name the one at the root takes over, else the first. All links to the phantom move to it.
    """
    name, key = (file_name(F.col("path")), asset_key(F.col("path"))) if assets else (note_name(F.col("path")), note_key(F.col("path")))
    order = F.struct((~F.col("path").contains("/")).cast("int").alias("root"), (-F.col("ord")).alias("o"))
    best = added.groupBy(phantom_key(name).alias("dst_key")).agg(F.max_by("path", order).alias("path"))
    known = g.nodes.filter("type = 'phantom'").select(F.col("node_key").alias("dst_key"))
    change = best.join(known, "dst_key", "left_semi").select("dst_key", "path", key.alias("new_key"))
    edges = g.edges.join(change.select("dst_key", "new_key"), "dst_key", "left").withColumn("dst_key", F.coalesce("new_key", "dst_key")).select(EDGE_COLUMNS)
    nodes = g.nodes.join(change.select(F.col("dst_key").alias("node_key")), "node_key", "left_anti").select(NODE_COLUMNS)
    return Graph(nodes, edges), change.select("path", F.col("dst_key").alias("phantom"))


def relinked(g: Graph, plan: DataFrame) -> Graph:
    """The graph with raw links as a plan of rewrites has them; the plan's ``file`` and ``occ_ord`` name an edge."""
    new = plan.select(note_key(F.col("file")).alias("src_key"), "occ_ord", "new_link").dropDuplicates(["src_key", "occ_ord"])
    edges = g.edges.join(new, ["src_key", "occ_ord"], "left").withColumn("raw_link", F.coalesce("new_link", "raw_link")).select(EDGE_COLUMNS)
    return Graph(g.nodes, edges)


def renamed(g: Graph, moved: DataFrame) -> Graph:
    """The graph with files at their new paths (from_path, to_path); edges follow the keys."""
    kind = F.col("type")
    to = moved.select(F.col("from_path").alias("path"), "to_path")
    facts = g.nodes.filter("exists_flag and type in ('note', 'asset')").join(to, "path").select(
        "node_key", F.when(kind == "note", note_key(F.col("to_path"))).otherwise(asset_key(F.col("to_path"))).alias("new_key"), "type",
        F.when(kind == "note", note_name(F.col("to_path"))).otherwise(file_name(F.col("to_path"))).alias("name"), F.col("to_path").alias("path"), "exists_flag", "mtime", "node_ord",
    )
    keys = facts.select("node_key", "new_key")
    nodes = g.nodes.join(keys.select("node_key"), "node_key", "left_anti").select(NODE_COLUMNS).unionByName(facts.drop("node_key").withColumnRenamed("new_key", "node_key").select(NODE_COLUMNS))
    edges = g.edges.join(keys.select(F.col("node_key").alias("src_key"), F.col("new_key").alias("s")), "src_key", "left").withColumn("src_key", F.coalesce("s", "src_key"))
    edges = edges.join(keys.select(F.col("node_key").alias("dst_key"), F.col("new_key").alias("d")), "dst_key", "left").withColumn("dst_key", F.coalesce("d", "dst_key"))
    return Graph(nodes, edges.select(EDGE_COLUMNS))
