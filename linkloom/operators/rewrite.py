"""Plans of text rewrites: which raw links change to what, as tables. Nothing here touches a file.

Every plan has (file, raw_link, new_link, link_type, line, occ_ord), where ``file`` is the note whose text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import links
from linkloom.functions.paths import asset_name_key, escapes, file_name, is_root, lower, note_name, note_name_key, vault_path, without_ext, without_md
from linkloom.operators.graph import Graph
from linkloom.operators.resolve import asset_names, asset_paths, name_counts, note_names, note_paths

PLAN = ["file", "raw_link", "new_link", "link_type", "line", "occ_ord"]


def _links(occ: DataFrame) -> DataFrame:
    return occ.filter(F.col("link_type").isin("wikilink", "markdown"))


def _plan(rows: DataFrame, new: Column) -> DataFrame:
    out = rows.withColumn("new_link", new).filter((F.col("new_link") != F.col("raw_link")) & (F.col("new_link") != ""))
    return out.select(F.col("src_path").alias("file"), "raw_link", "new_link", "link_type", F.col("line_start").alias("line"), "occ_ord")


def _scoped(occ: DataFrame, files: DataFrame | None) -> DataFrame:
    return occ if files is None else occ.join(files.select(F.col("path").alias("src_path")), "src_path", "left_semi")


def convert_plan(occ: DataFrame, notes: DataFrame, to: str, files: DataFrame | None = None) -> DataFrame:
    """Markdown links as wikilinks or the other way. For the former ``occ`` should hold links into the own note too."""
    if to == "wikilink":
        return _plan(_scoped(occ, files).filter("link_type = 'markdown'"), links.as_wikilink(F.col("raw_link")))
    if to != "markdown":
        raise ValueError(f"invalid format: {to!r} (must be wikilink or markdown)")
    rows = _scoped(occ, files).filter("link_type = 'wikilink'")
    target = links.raw_target(F.col("raw_link"), F.lit("wikilink"))
    known = notes.select(lower(F.regexp_replace(file_name(F.col("path")), r"\.md\z", "")).alias("note_name")).distinct()
    rows = rows.withColumn("note_name_", lower(file_name(target))).join(known, F.col("note_name_") == F.col("note_name"), "left")
    note = ~links.has_ext(target) | lower(target).endswith(".md") | F.col("note_name").isNotNull()
    return _plan(rows, links.as_markdown(F.col("raw_link"), note))


def _path_links(occ: DataFrame) -> DataFrame:
    rows = _links(occ).filter((F.col("target") != "") & ~F.col("is_basename"))
    way = vault_path(F.col("src_path"), F.col("target"), F.col("is_relative"))
    return rows.withColumn("way", way).withColumn("key", lower(F.col("way"))).withColumn("escaping", escapes(F.col("src_path"), F.col("target"), F.col("is_basename"), F.col("is_relative")))


def simplify_plan(occ: DataFrame, notes: DataFrame, assets: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Path links that can be bare names: the plan, and (file, raw_link, basename, candidates) of those that would be ambiguous.

    A link is left alone if it leads nowhere or out of the vault, if the name would lead to another file at the root,
    or, for an asset, if a note has the same name.
    """
    col = F.col
    rows = _scoped(_path_links(occ), files).filter("not escaping")
    np, ap = note_paths(notes), asset_paths(assets)
    exact = np.select("key", col("path").alias("p0"))
    md = np.filter(col("key").endswith(".md")).select(F.regexp_replace("key", r"\.md\z", "").alias("key"), col("path").alias("p1"))
    rows = rows.join(exact, "key", "left").join(md, "key", "left").join(ap.select("key", col("path").alias("p2")), "key", "left")
    rows = rows.withColumn("found", F.coalesce("p0", "p1", "p2")).filter("found is not null").withColumn("asset", col("p0").isNull() & col("p1").isNull())
    name = F.when(col("asset"), asset_name_key(col("found"))).otherwise(note_name_key(col("found")))
    nn = note_names(notes).select(col("key").alias("nk"), col("n").alias("nn"), col("root").alias("nroot"))
    an = asset_names(assets).select(col("key").alias("ak"), col("n").alias("an"), col("root").alias("aroot"))
    rows = rows.withColumn("nk", name).join(nn, "nk", "left").withColumn("ak", name).join(an, "ak", "left")
    rows = rows.filter(~(col("asset") & col("nn").isNotNull()))
    n, root = F.when(col("asset"), col("an")).otherwise(col("nn")), F.when(col("asset"), col("aroot")).otherwise(col("nroot"))
    free = (n == 1) | (root == col("found"))
    plan = _plan(rows.filter(free), links.pointed_at(col("raw_link"), col("link_type"), file_name(col("found"))))
    stuck = rows.filter(~F.coalesce(free, F.lit(False)) & root.isNull()).select(
        col("src_path").alias("file"), "raw_link", "asset", "nk", F.when(col("asset"), file_name(col("found"))).otherwise(note_name(col("found"))).alias("basename")
    )
    stuck = stuck.dropDuplicates(["file", "raw_link"])
    many = notes.select(F.lit(False).alias("asset"), note_name_key(col("path")).alias("nk"), "path").unionByName(assets.select(F.lit(True).alias("asset"), asset_name_key(col("path")).alias("nk"), "path"))
    shared = many.join(stuck.select("asset", "nk").distinct(), ["asset", "nk"], "left_semi").groupBy("asset", "nk").agg(F.sort_array(F.collect_list("path")).alias("candidates"))
    return plan, stuck.join(shared, ["asset", "nk"]).select("file", "raw_link", "basename", "candidates")


def broken(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Path links (from ``_path_links``) with ``is_broken``: no note has the path, as it is or with ``.md``."""
    keys = notes.select(lower(F.col("path")).alias("key")).distinct()
    both = keys.unionByName(keys.filter(F.col("key").endswith(".md")).select(F.regexp_replace("key", r"\.md\z", "").alias("key"))).distinct()
    return rows.join(both.withColumn("there", F.lit(True)), "key", "left").withColumn("is_broken", F.col("there").isNull()).drop("there")


def repair_plan(occ: DataFrame, notes: DataFrame, on_disk: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Broken and escaping path links as bare names: the plan, and the broken links that several notes could be meant by.

    ``on_disk`` (path) lists what is there although it isn't indexed, files and folders: links to it are left alone.
    """
    col = F.col
    rows = broken(_path_links(occ), notes).filter(col("escaping") | col("is_broken"))
    if on_disk is not None:
        there = on_disk.select(col("path").alias("way_")).distinct()
        also = there.filter(lower(col("way_")).endswith(".md")).select(without_md(col("way_")).alias("way_"))
        shown = there.unionByName(also).distinct().withColumn("shown", F.lit(True))
        rows = rows.join(shown, col("way") == col("way_"), "left").filter(col("escaping") | col("shown").isNull())
    name = file_name(col("target"))
    known = name_counts(notes, lower(without_md(file_name(col("path"))))).select(col("key").alias("nk"), "n")
    rows = rows.withColumn("basename", name).withColumn("nk", lower(name)).join(known, "nk", "left")
    stuck = ~col("escaping") & (F.coalesce("n", F.lit(0)) >= 2)
    plan = _plan(rows.filter(~stuck), links.pointed_at(col("raw_link"), col("link_type"), F.concat("basename", F.lit(".md"))))
    skipped = rows.filter(stuck).select(col("src_path").alias("file"), "raw_link", "basename", "nk").dropDuplicates(["file", "raw_link"])
    files = notes.select(lower(without_md(file_name(col("path")))).alias("nk"), "path").join(skipped.select("nk").distinct(), "nk", "left_semi")
    shared = files.groupBy("nk").agg(F.sort_array(F.collect_list("path")).alias("candidates"))
    return plan, skipped.join(shared, "nk").select("file", "raw_link", "basename", "candidates")


def disambiguate_target(candidates: list[str], name: str, target: str | None) -> str:
    """The note meant by ``name`` among those that have it."""
    if not candidates:
        raise ValueError(f"no note found with basename: {name}")
    if target:
        for c in candidates:
            if c in (target, target if target.lower().endswith(".md") else f"{target}.md"):
                return c
        raise ValueError(f"target not found among candidates: {target}")
    if len(candidates) > 1:
        raise ValueError(f"multiple candidates for basename {name}, a target is required: {', '.join(sorted(candidates))}")
    return candidates[0]


def disambiguate_scan_plan(occ: DataFrame, notes: DataFrame, name_key: str, target: str, files: DataFrame | None = None) -> DataFrame:
    """Bare links by a name, and broken path links that end in it, as paths to ``target``; without an index."""
    col = F.col
    rows = _scoped(_links(occ), files).filter((col("src_path") != target) & (note_name_key(col("target")) == name_key))
    bare = rows.filter("is_basename").select("src_path", "raw_link", "link_type", "line_start", "occ_ord")
    lost = broken(_path_links(rows), notes).filter("is_broken").select("src_path", "raw_link", "link_type", "line_start", "occ_ord")
    both = bare.unionByName(lost)
    return _plan(both, links.pointed_at(col("raw_link"), col("link_type"), F.lit(target)))


def _edge_links(g: Graph) -> DataFrame:
    """Links between nodes with the path of the source, which must exist."""
    src = g.nodes.filter("exists_flag").select(F.col("node_key").alias("src_key"), F.col("path").alias("src_path"))
    return _links(g.edges).join(src, "src_key")


def disambiguate_plan(g: Graph, name_key: str, target: str, files: DataFrame | None = None) -> DataFrame:
    """As the scan, over the index: bare links to ``target``, and all links to the phantom of its name."""
    col = F.col
    ghost = F.concat(F.lit("phantom:name:"), F.lit(name_key))
    rows = _edge_links(g).filter(((col("dst_key") == f"note:path:{target}") & links.is_bare_raw(col("raw_link"), col("link_type"))) | (col("dst_key") == ghost))
    rows = _scoped(rows.filter(col("src_path") != target), files)
    return _plan(rows, links.pointed_at(col("raw_link"), col("link_type"), F.lit(target)))


def add_plan(g: Graph, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What adding notes (path) does to links that are there: (plan of bare links that must become paths, bare links that would be ambiguous).

    The first are those to a note that alone had the name and isn't at the root. The second are those to a phantom whose
    name several of the added notes have, none at the root.
    """
    col = F.col
    old = note_names(g.notes()).select("key", col("n").alias("old_n"), "one")
    new = added.groupBy(note_name_key(col("path")).alias("key")).agg(F.count("*").alias("new_n"), F.max(is_root(col("path")).cast("int")).alias("new_root"))
    both = new.join(old, "key", "left").withColumn("old_n", F.coalesce("old_n", F.lit(0))).filter(col("old_n") + col("new_n") > 1)
    shared = both.filter((col("old_n") == 1) & ~is_root(col("one"))).select(F.concat(F.lit("note:path:"), "one").alias("dst_key"), "one")
    ghost = both.filter((col("old_n") == 0) & (col("new_root") == 0)).select(F.concat(F.lit("phantom:name:"), "key").alias("dst_key"))
    bare = _edge_links(g).filter(links.is_bare_raw(col("raw_link"), col("link_type")))
    return _plan(bare.join(shared, "dst_key"), links.pointed_at(col("raw_link"), col("link_type"), col("one"))), bare.join(ghost, "dst_key").select("src_path", "raw_link")


def _names_after(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """(type, key, n, pre_root, post_root): the names of files before and after a move (from_path, to_path)."""
    col = F.col
    files = nodes.filter("exists_flag and type in ('note', 'asset')").select("type", "path")
    after = files.join(moved.select(col("from_path").alias("path"), "to_path"), "path", "left").withColumn("new", F.coalesce("to_path", "path"))
    key = lambda p: F.when(col("type") == "asset", asset_name_key(p)).otherwise(note_name_key(p))
    post = after.groupBy("type", key(col("new")).alias("key")).agg(F.count("*").alias("n"), F.max(F.when(is_root(col("new")), col("new"))).alias("post_root"), F.max("new").alias("one"))
    pre = files.groupBy("type", key(col("path")).alias("key")).agg(F.max(F.when(is_root(col("path")), col("path"))).alias("pre_root"))
    return post.join(pre, ["type", "key"], "left")


def move_plan(g: Graph, moved: DataFrame) -> DataFrame:
    """How links of notes that stay must change when files move (from_path, to_path): both to what moves and, where its
    new name is now shared, bare links to other files of that name.

    Links to a moved file: paths always change; a bare name changes if the name did, or if it is shared now and no file
    at the root had and keeps it.
    """
    col = F.col
    mv = moved.select(col("from_path"), col("to_path"))
    to = g.nodes.filter("exists_flag and type in ('note', 'asset')").select(col("node_key").alias("dst_key"), "type", "name", "path").join(mv.withColumnRenamed("from_path", "path"), "path", "left")
    names = _names_after(g.nodes, mv).filter("n > 1 and not (pre_root is not null and post_root is not null)").select("type", "key").withColumn("unsafe", F.lit(True))
    new_key = F.when(col("type") == "asset", asset_name_key(F.coalesce("to_path", "path"))).otherwise(note_name_key(F.coalesce("to_path", "path")))
    old_key = F.when(col("type") == "asset", asset_name_key(col("path"))).otherwise(note_name_key(col("path")))
    to = to.withColumn("key", new_key).withColumn("old_key", old_key).join(names, ["type", "key"], "left")
    # names that a moved file has now: only these can make other bare links unsafe
    arrived = to.filter("to_path is not null").select("type", "key").distinct().withColumn("arrived", F.lit(True))
    to = to.join(arrived, ["type", "key"], "left").withColumn("unsafe", F.coalesce("unsafe", F.lit(False)))
    to = to.filter(col("to_path").isNotNull() | (col("arrived") & col("unsafe")))
    rows = _edge_links(g).join(mv.select(col("from_path").alias("src_path")), "src_path", "left_anti").join(to.select("dst_key", "path", "to_path", "key", "old_key", "unsafe"), "dst_key")
    bare = links.is_bare_raw(col("raw_link"), col("link_type"))
    change = F.when(col("to_path").isNotNull(), ~bare | (col("key") != col("old_key")) | col("unsafe")).otherwise(bare & col("unsafe"))
    return _plan(rows.filter(change), links.pointed_at(col("raw_link"), col("link_type"), F.coalesce("to_path", "path")))


def moved_outgoing_plan(g: Graph, occ: DataFrame, moved: DataFrame, batch: bool) -> DataFrame:
    """How the links within moved notes must change; ``occ`` are their occurrences, under their old paths.

    Bare names change if they would mean another file now. Relative links are counted from the new place, to the new
    place of what moved along. Path links from the root change with their target only when a folder moves (``batch``).
    """
    col = F.col
    mv = moved.select("from_path", "to_path")
    src = _links(occ).join(mv.select(col("from_path").alias("src_path"), col("to_path").alias("new_src")), "src_path")
    # where a bare or path link led before the move; only the edges of what moves are looked at
    own = g.edges.join(mv.select(F.concat(F.lit("note:path:"), "from_path").alias("src_key")), "src_key", "left_semi")
    was = own.join(g.nodes.filter("path is not null").select(col("node_key").alias("dst_key"), col("path").alias("was")), "dst_key")
    was = was.select(F.regexp_replace("src_key", r"\Anote:path:", "").alias("src_path"), "raw_link", "was").groupBy("src_path", "raw_link").agg(F.min("was").alias("was"))
    where = src.filter("not is_relative and target <> ''").join(was, ["src_path", "raw_link"]).join(mv.select(col("from_path").alias("was"), col("to_path").alias("went")), "was", "left").withColumn("now", F.coalesce("went", "was"))
    names = _names_after(g.nodes, mv).filter("type = 'note'").select("key", "n", "one", "post_root")
    bare = where.filter("is_basename").withColumn("key", note_name_key(col("target"))).join(names, "key", "left")
    lands = F.when(col("n") == 1, col("one")).otherwise(col("post_root"))
    bare = bare.filter(col("n").isNotNull() & (lands.isNull() | (lands != col("now"))))
    plans = _plan(bare, links.pointed_at(col("raw_link"), col("link_type"), col("now")))
    if batch:
        plans = plans.unionByName(_plan(where.filter("not is_basename and went is not null"), links.pointed_at(col("raw_link"), col("link_type"), col("now"))))
    rel = src.filter("is_relative").withColumn("aim", vault_path(col("src_path"), links.raw_target(col("raw_link"), col("link_type")), F.lit(True)))
    if batch:
        a = mv.select(col("from_path").alias("aim"), col("to_path").alias("aim0"))
        b = mv.filter(col("from_path").endswith(".md")).select(without_ext(col("from_path")).alias("aim"), F.regexp_replace("to_path", r"\.md\z", "").alias("aim1"))
        rel = rel.join(a, "aim", "left").join(b, "aim", "left").withColumn("aim", F.coalesce("aim0", "aim1", "aim"))
    return plans.unionByName(_plan(rel, links.relative_again(col("raw_link"), col("link_type"), col("new_src"), col("aim"))))


def applied(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, content): the texts of the notes that a plan changes, outside code spans, line by line.

    A line's rewrites are made in the order of the links; a rewrite whose raw link isn't on its line changes nothing.
    """
    col = F.col
    todo = plan.groupBy(col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("line", "occ_ord", "raw_link", "new_link"))).alias("todo"))

    def line(text: Column, i: Column) -> Column:
        mine = F.filter("todo", lambda t: t["line"] == i + 1)
        return F.aggregate(mine, text, lambda x, t: links.replaced_outside_code(x, t["raw_link"], t["new_link"]))

    rows = notes.join(todo, "path")
    return rows.select("path", F.array_join(F.transform(F.split("content", "\n", -1), line), "\n").alias("content"))
