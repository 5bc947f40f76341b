"""Queries of the graph operators over the tables, each with SQL that gets the same rows without this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.globs import Excludes
from linkloom.functions.paths import file_name, folder, note_name_key
from linkloom.operators import extract, query, resolve, rewrite
from linkloom.operators import graph as G
from linkloom.operators.incremental import latest_rows
from linkloom.plans import projection
from linkloom.runtime import stage, table
from linkloom.schema import EDGE_COLUMNS, NODE_COLUMNS

EXCLUDED = Excludes.merged(["assets/*", "inbox/*"], ["#idea"])


def graph_of(spark: SparkSession, sf_dir: str) -> G.Graph:
    """The tables as a graph: the latest row of each node, each edge once, edges without a target left out."""
    nodes = latest_rows(table(spark, sf_dir, "nodes"), "id", "seen_at", NODE_COLUMNS).select(NODE_COLUMNS)
    edges = table(spark, sf_dir, "edges").filter("id is not null and dst_key is not null and src_key is not null").dropDuplicates(["id"])
    return G.Graph(nodes, edges.withColumn("subpath", F.coalesce("subpath", F.lit(""))).select(EDGE_COLUMNS))


def _hub(g: G.Graph, side: str, prefix: str) -> str:
    """The key with most edges on a side, of those with a prefix; the least of equal ones."""
    top = g.edges.filter(F.col(side).startswith(prefix)).groupBy(side).count().orderBy(F.col("count").desc(), side).limit(1).collect()
    return top[0][0] if top else ""


def _occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occurrences, repeated rows once."""
    return table(spark, sf_dir, "occurrences").distinct()


def _files(g: G.Graph) -> tuple[DataFrame, DataFrame]:
    kind = lambda t: g.nodes.filter(F.col("type") == t).select("path", F.col("node_ord").alias("walk_ord"))
    return kind("note"), kind("asset")


def _doc_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("walk_ord"))


def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.stats(graph_of(spark, sf_dir))


def basename_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.conflicts(graph_of(spark, sf_dir), "note")


def asset_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets as if all had one name beside their extension: which share a name."""
    g = graph_of(spark, sf_dir)
    path = F.concat(folder(F.col("path")), F.lit("/attachment"), F.regexp_extract("path", r"[.][^./]*\z", 0))
    same = g.nodes.filter("type = 'asset'").withColumn("path", path).withColumn("name", file_name(F.col("path")))
    return query.conflicts(G.Graph(same, g.edges), "asset")


def phantoms_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.phantoms(graph_of(spark, sf_dir))


def backlinks_of_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    return query.backlinks(g, _hub(g, "dst_key", "note:"))


def outgoing_of_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    return query.outgoing(g, _hub(g, "src_key", "note:"))


def leaf_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.note_tags(graph_of(spark, sf_dir))


def twohop_of_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    return query.two_hop(g, _hub(g, "dst_key", "tag:")).select("via_key", "via_pos", "pos", "target_key")


def twohop_of_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    return query.two_hop(g, _hub(g, "src_key", "note:"), ex=EXCLUDED).select("via_key", "via_pos", "pos", "target_key")


def twohop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every note and every node it links to, the first ten other notes that link there too."""
    return query.two_hop_all(graph_of(spark, sf_dir).edges.select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst")))


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_key, dst_key) of all links of the order notes, extracted from their text and resolved."""
    return _order_links(spark, sf_dir, extract.KINDS)


def _order_links(spark: SparkSession, sf_dir: str, kinds: frozenset[str]) -> DataFrame:
    notes = projection.order_notes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.format_string("orders/%d.md", "o_orderkey").alias("path"), F.col("o_orderkey").alias("walk_ord"))
    universe = orders.unionByName(projection.other_notes(spark, sf_dir).select("path", "walk_ord"))
    return resolve.resolved(extract.occurrences(notes, kinds=kinds), universe, projection.no_assets(spark)).select("src_key", "dst_key")


def projected_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build of all projected notes, as figures."""
    notes = projection.order_notes(spark, sf_dir).unionByName(projection.other_notes(spark, sf_dir))
    g = G.build(notes, projection.no_assets(spark), check=False)
    return query.stats(G.Graph(stage(g.nodes, "nodes"), stage(g.edges, "edges")))


def twohop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order and part of it, the first ten other orders with that part: text to links to two hops."""
    links = _order_links(spark, sf_dir, extract.LINKS).filter(F.col("dst_key").startswith("note:path:parts/"))
    number = lambda c: F.regexp_extract(c, r"(\d+)\.md\z", 1).cast("long")
    pairs = links.select(number("src_key").alias("src"), number("dst_key").alias("dst")).distinct()
    return query.two_hop_all(stage(pairs, "order-parts"))  # both sides of the join start from it


def exclude_paths_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir).nodes.filter(EXCLUDED.keeps_path(F.col("path"))).select("node_key")


def exclude_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    return g.nodes.filter("type = 'tag'").filter(EXCLUDED.keeps_tag(F.col("name"))).select("node_key")


def exclude_vias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir).nodes.filter(EXCLUDED.keeps_via(F.col("type"), F.col("name"), F.col("path"))).select("node_key")


def _doc_links(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    occ = extract.occurrences(_doc_notes(spark, sf_dir), kinds=frozenset({kind}))
    return occ.select(F.col("src_path").cast("long").alias("doc_id"), F.col("line_start").cast("long").alias("line"), "raw_link", "target", "subpath")


def doc_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_links(spark, sf_dir, "wikilink")


def doc_markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_links(spark, sf_dir, "markdown")


def nested_tag_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_links(spark, sf_dir, "tag").select("doc_id", "line", "target")


def frontmatter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_links(spark, sf_dir, "frontmatter").select("doc_id", "line", "target")


def head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.heads(_doc_notes(spark, sf_dir), 3).select(F.col("path").cast("long").alias("doc_id"), "pos", "line")


def snippet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around every wikilink of the documents, one line before and after."""
    notes = _doc_notes(spark, sf_dir)
    occ = extract.occurrences(notes, kinds=frozenset({"wikilink"})).select(F.col("target").alias("dst_key"), F.col("src_path").alias("source"), "line_start", "line_end", "occ_ord")
    return query.snippets(occ, notes, 1).select(F.col("source").cast("long").alias("doc_id"), F.col("dst_key").alias("target"), "line_start", "line_end", F.array_join("lines", "\n").alias("lines"))


def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, assets = _files(graph_of(spark, sf_dir))
    found = resolve.resolved(_occ(spark, sf_dir), notes, assets)
    return found.filter("not escaping").select("src_path", "occ_ord", "raw_link", "dst_key", "ambiguous")


def ambiguous_links_first5(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, assets = _files(graph_of(spark, sf_dir))
    found = resolve.resolved(_occ(spark, sf_dir), notes, assets).select("src_path", "raw_link", "walk_ord", "occ_ord", "target", "escaping", "ambiguous").distinct()
    return resolve.first_errors(found).select("src_path", "raw_link", "walk_ord", "occ_ord")


def root_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name of every note means: the one note, the one at the root, or nothing."""
    names = resolve.note_names(_files(graph_of(spark, sf_dir))[0])
    return names.select("key", F.col("n").alias("n_files"), F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("root")).alias("means"))


def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    return g.nodes.join(G.without_orphans(g).nodes.select("node_key"), "node_key", "left_anti").select("node_key")


def incoming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.incoming_counts(graph_of(spark, sf_dir).edges)


def delete_phantomize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the folder ``inbox`` taken away in the order of their place: which are still linked to, and so stay as phantoms."""
    g = graph_of(spark, sf_dir)
    gone = g.nodes.filter(F.col("path").startswith("inbox/")).select("node_key", F.col("node_ord").alias("pos"))
    return G.removed(g, gone)[1].select("path", "phantomed")


def add_promote_phantom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note in ``archive`` for the name of every phantom: which takes over which."""
    g = graph_of(spark, sf_dir)
    added = g.nodes.filter("type = 'phantom'").filter(~F.col("name").contains("/")).select(F.concat(F.lit("archive/"), "name", F.lit(".md")).alias("path"), F.col("node_ord").alias("ord"))
    return G.promoted(g, added)[1]


def add_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second note for every name in ``recipes``: the bare links to the first that must become paths."""
    g = graph_of(spark, sf_dir)
    added = g.nodes.filter((F.col("type") == "note") & F.col("path").startswith("recipes/")).select(F.concat(F.lit("archive/"), "name", F.lit(".md")).alias("path")).distinct()
    return rewrite.add_plan(g, added)[0].select("file", "raw_link", "new_link", "occ_ord")


def movedir_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder ``recipes`` moved to ``kitchen``: how links in all other notes change."""
    g = graph_of(spark, sf_dir)
    moved = g.nodes.filter(F.col("type").isin("note", "asset") & F.col("path").startswith("recipes/")).select(F.col("path").alias("from_path"), F.regexp_replace("path", r"\Arecipes/", "kitchen/").alias("to_path"))
    return rewrite.move_plan(g, moved).select("file", "raw_link", "new_link", "occ_ord")


def moved_outgoing_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders that sort before ``n`` moved one level down: how links in their own notes change."""
    g = graph_of(spark, sf_dir)
    moved = g.nodes.filter(F.col("type").isin("note", "asset") & F.col("path").contains("/") & (F.col("path") < "n")).select(F.col("path").alias("from_path"), F.concat(F.lit("old/"), "path").alias("to_path"))
    return rewrite.moved_outgoing_plan(g, _occ(spark, sf_dir), moved, batch=True).select("file", "raw_link", "new_link", "occ_ord")


def simplify_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.simplify_plan(_occ(spark, sf_dir), *_files(graph_of(spark, sf_dir)))[0].select("file", "raw_link", "new_link", "occ_ord")


def simplify_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.simplify_plan(_occ(spark, sf_dir), *_files(graph_of(spark, sf_dir)))[1]


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.repair_plan(_occ(spark, sf_dir), _files(graph_of(spark, sf_dir))[0])[0].select("file", "raw_link", "new_link", "occ_ord")


def repair_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan when all files of the tables, assets too, are on disk: links to them are left alone."""
    g = graph_of(spark, sf_dir)
    return rewrite.repair_plan(_occ(spark, sf_dir), _files(g)[0], g.nodes.filter("path is not null").select("path"))[0].select("file", "raw_link", "new_link", "occ_ord")


def repair_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links as paths into a folder that is gone: those whose name several notes have."""
    link = F.col("link_type").isin("wikilink", "markdown") & (F.col("target") != "")
    lost = table(spark, sf_dir, "occurrences").withColumn("target", F.when(link, F.concat(F.lit("gone/"), file_name(F.col("target")))).otherwise(F.col("target")))
    lost = lost.withColumn("is_relative", F.lit(False)).withColumn("is_basename", F.lit(False)).distinct()
    return rewrite.repair_plan(lost, _files(graph_of(spark, sf_dir))[0])[1]


def convert_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.convert_plan(_occ(spark, sf_dir), _files(graph_of(spark, sf_dir))[0], "markdown").select("file", "raw_link", "new_link", "occ_ord")


def convert_to_wikilink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.convert_plan(_occ(spark, sf_dir), _files(graph_of(spark, sf_dir))[0], "wikilink").select("file", "raw_link", "new_link", "occ_ord")


def disambiguate_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare links to the busiest note as paths to it."""
    g = graph_of(spark, sf_dir)
    path = _hub(g, "dst_key", "note:").removeprefix("note:path:")
    key = spark.range(1).select(note_name_key(F.lit(path))).first()[0]
    return rewrite.disambiguate_plan(g, key, path).select("file", "raw_link", "new_link", "occ_ord")


_NAMES = """stats_counts basename_conflicts asset_conflicts phantoms_list backlinks_of_hub outgoing_of_hub leaf_tags twohop_of_tag twohop_of_note
twohop_all order_links projected_stats twohop_orders exclude_paths_nullsafe exclude_tags exclude_vias doc_wikilinks doc_markdown_links nested_tag_expansion
frontmatter_tags head_lines snippet_lines resolve_priority ambiguous_links_first5 root_priority orphans_anti incoming_counts delete_phantomize
add_promote_phantom add_rewrites movedir_rewrites moved_outgoing_rewrites simplify_plan simplify_skipped repair_plan repair_on_disk repair_skipped convert_to_markdown
convert_to_wikilink disambiguate_hub""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
