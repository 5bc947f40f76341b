"""Resolution: every occurrence to exactly one node, by one join with a table of names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.paths import asset_name_key, escapes, file_name, is_root, lower, note_name_key, vault_path, without_ext, without_md

#: How many mistakes in links a build reports.
MOST_ERRORS = 5


def note_key(path: Column) -> Column:
    return F.concat(F.lit("note:path:"), path)


def asset_key(path: Column) -> Column:
    return F.concat(F.lit("asset:path:"), path)


def phantom_key(name: Column) -> Column:
    return F.concat(F.lit("phantom:name:"), lower(name))


def tag_key(name: Column) -> Column:
    return F.concat(F.lit("tag:name:"), lower(name))


def name_counts(files: DataFrame, key: Column) -> DataFrame:
    """(key, n, one, root): how many files share a name, one of them, and the one at the root if there is one. Of several
    at the root, which differ in case only, the last in walk order counts."""
    rows = files.select(key.alias("key"), "path", "walk_ord")
    root = F.when(is_root(F.col("path")), F.col("path"))
    order = F.struct("walk_ord", "path")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.max_by("path", order).alias("one"), F.max_by(root, F.when(root.isNotNull(), order)).alias("root"))


def note_names(notes: DataFrame) -> DataFrame:
    return name_counts(notes, note_name_key(F.col("path")))


def asset_names(assets: DataFrame) -> DataFrame:
    return name_counts(assets, asset_name_key(F.col("path")))


def note_paths(notes: DataFrame) -> DataFrame:
    """(key, path): each note by its path with and without extension; of notes that share a key the last in walk order has it."""
    p = F.col("path")
    keys = notes.select(F.explode(F.array_distinct(F.array(lower(p), lower(without_ext(p))))).alias("key"), "path", "walk_ord")
    return keys.groupBy("key").agg(F.max_by("path", F.struct("walk_ord", "path")).alias("path"))


def asset_paths(assets: DataFrame) -> DataFrame:
    return assets.select(lower(F.col("path")).alias("key"), "path", "walk_ord").groupBy("key").agg(F.max_by("path", F.struct("walk_ord", "path")).alias("path"))


def targets(notes: DataFrame, assets: DataFrame) -> DataFrame:
    """(space, key, dst_key, ambiguous): the one node that a bare name (space ``name``) or a path (space ``path``) stands for.

    Names: a note if it alone has the name, else the note at the root, else an asset likewise. Paths: a note as written,
    then with ``.md``, then an asset. A name that several files have and none at the root is ambiguous.
    """
    nn, an = note_names(notes), asset_names(assets)
    one = F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("root"))
    names = nn.select("key", F.lit(0).alias("rank"), note_key(one).alias("dst"), ((F.col("n") > 1) & F.col("root").isNull()).alias("many")).unionByName(
        an.select("key", F.lit(1).alias("rank"), asset_key(one).alias("dst"), ((F.col("n") > 1) & F.col("root").isNull()).alias("many"))
    )
    by_name = names.groupBy("key").agg(F.min_by("dst", F.when(F.col("dst").isNotNull(), F.col("rank"))).alias("dst_key"), F.min_by("many", "rank").alias("ambiguous"))
    np, ap = note_paths(notes), asset_paths(assets)
    cut = np.filter(F.col("key").endswith(".md")).select(F.regexp_replace("key", r"\.md\z", "").alias("key"), F.lit(1).alias("rank"), note_key(F.col("path")).alias("dst"))
    paths = np.select("key", F.lit(0).alias("rank"), note_key(F.col("path")).alias("dst")).unionByName(cut).unionByName(ap.select("key", F.lit(2).alias("rank"), asset_key(F.col("path")).alias("dst")))
    by_path = paths.groupBy("key").agg(F.min_by("dst", "rank").alias("dst_key"))
    return by_name.select(F.lit("name").alias("space"), "key", "dst_key", "ambiguous").unionByName(by_path.select(F.lit("path").alias("space"), "key", "dst_key", F.lit(False).alias("ambiguous")))


def probed(occ: DataFrame) -> DataFrame:
    """``occ`` with what to look up: ``space`` and ``key`` (null for tags and links into the own note), ``spelled`` for a phantom, ``escaping``."""
    col = F.col
    link = col("link_type").isin("wikilink", "markdown") & (col("target") != "")
    path = vault_path(col("src_path"), col("target"), col("is_relative"))
    return (
        occ.withColumn("space", F.when(link, F.when(col("is_basename"), F.lit("name")).otherwise(F.lit("path"))))
        .withColumn("spelled", F.when(col("is_basename"), col("target")).otherwise(without_md(file_name(path))))
        .withColumn("key", F.when(link, lower(F.when(col("is_basename"), col("target")).otherwise(path))))
        .withColumn("escaping", F.coalesce(link & escapes(col("src_path"), col("target"), col("is_basename"), col("is_relative")), F.lit(False)))
    )


def resolved(occ: DataFrame, notes: DataFrame, assets: DataFrame) -> DataFrame:
    """Occurrences with ``src_key``, ``dst_key`` and ``ambiguous``; what no file answers to is a phantom.

    The table of names and paths has a few rows per file. Whether it is broadcast is left to the planner's size check;
    names that very many links share are split by adaptive skew handling.
    """
    col = F.col
    looked = probed(occ).join(targets(notes, assets), ["space", "key"], "left")
    tag = col("link_type").isin("tag", "frontmatter")
    dst = F.when(tag, tag_key(col("target"))).when(col("space").isNull(), note_key(col("src_path"))).otherwise(F.coalesce(col("dst_key"), phantom_key(col("spelled"))))
    return looked.select(*occ.columns, "spelled", "escaping", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), note_key(col("src_path")).alias("src_key"), dst.alias("dst_key"))


def first_errors(resolved_: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """The first mistakes in walk order: links out of the vault, and ambiguous names."""
    return resolved_.filter(F.col("escaping") | F.col("ambiguous")).orderBy("walk_ord", "occ_ord", "src_path", "raw_link").limit(most)


def link_errors(resolved_: DataFrame, most: int = MOST_ERRORS) -> list[str]:
    bad = first_errors(resolved_, most)
    return [f"link escapes vault: {r.raw_link} in {r.src_path}" if r.escaping else f"ambiguous link: {r.target} in {r.src_path}" for r in bad.collect()]
