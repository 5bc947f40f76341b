"""Top N items of every group by a hot-cold split.

Exact group sizes send each group one way: light groups go through an ordinary window, heavy groups are salted, sorted
by range, cut to N per (group, salt) and merged. Both use the same order, so the tie rule is the same on either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators.hotkeys import distinct_edges
from linkloom.operators.incremental import latest_rows
from linkloom.runtime import partitions, stage, table

#: A group is heavy if it has more rows than this, at every size of the input.
HEAVY_ROWS = 20_000
#: Up to this many heavy groups their list is broadcast (16 bytes each); a longer one is left to the planner's size check.
MOST_HEAVY = 100_000


def top_n_per_group(items: DataFrame, group: str, order: list[Column], n: int, spread: str, heavy_rows: int = HEAVY_ROWS, rank: str = "pos") -> DataFrame:
    """The first ``n`` rows of each ``group`` in ``order``, numbered from 1 in the column ``rank``.

    ``spread`` is a column by whose hash a heavy group is salted. ``order`` must settle all ties for the result to be
    defined; rows that tie in all of it are interchangeable. A null group is no group and gives no row. Repeated rows
    take a place each. An empty input gives an empty result; other columns are passed through. ``items`` is read three
    times, so it should be a table or staged.
    """
    spark = items.sparkSession
    items = items.filter(F.col(group).isNotNull())
    g, salts, salt = F.col(group), "__salts", "__salt"
    heavy = stage(items.groupBy(group).count().filter(F.col("count") > heavy_rows).select(group, F.ceil(F.col("count") / F.lit(heavy_rows)).cast("long").alias(salts)), "heavy-groups")
    split = items.join(F.broadcast(heavy) if heavy.limit(MOST_HEAVY + 1).count() <= MOST_HEAVY else heavy, group, "left")
    cut = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    light = split.filter(F.col(salts).isNull()).drop(salts).withColumn(rank, cut).filter(F.col(rank) <= n)
    inner = F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))
    salted = split.filter(F.col(salts).isNotNull()).withColumn(salt, F.pmod(F.xxhash64(F.col(spread)), F.col(salts)))
    runs = salted.repartitionByRange(partitions(spark), g, F.col(salt)).withColumn("__rn", inner).filter(F.col("__rn") <= n)
    merged = runs.drop(salts, salt, "__rn").withColumn(rank, cut).filter(F.col(rank) <= n)
    return light.unionByName(merged)


def link_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target_id, source_id, n_links, path) of each linked pair; ``path`` is the source's, null if it has none or no row."""
    pairs = distinct_edges(edges).filter("source_id is not null and target_id is not null").groupBy("target_id", "source_id").agg(F.count("*").alias("n_links"))
    paths = latest_rows(nodes, "id", "seen_at", ["path"]).withColumnRenamed("id", "source_id")
    return pairs.join(paths, "source_id", "left").select("target_id", "source_id", "n_links", "path")


def backlink_order() -> list[Column]:
    return [F.col("n_links").desc(), F.col("path").asc_nulls_last(), F.col("source_id").asc()]


def top_backlinks(edges: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` sources with most links to each target; ties by the source's path in byte order, null last, then by id."""
    items = stage(link_counts(edges, nodes), "link-counts")
    return top_n_per_group(items, "target_id", backlink_order(), n, "source_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_backlinks(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes")).select("target_id", "pos", "source_id")


P2_SQL = """
WITH e AS (SELECT id, max(source_id) s, max(target_id) t FROM edges WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT t AS target_id, s AS source_id, count(*) n FROM e WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
n AS (SELECT id, arg_max(path, seen_at) AS path FROM nodes WHERE path IS NOT NULL GROUP BY id),
r AS (SELECT p.target_id, p.source_id,
      row_number() OVER (PARTITION BY p.target_id ORDER BY p.n DESC, n.path ASC NULLS LAST, p.source_id) pos
      FROM p LEFT JOIN n ON n.id = p.source_id)
SELECT target_id, CAST(pos AS INTEGER) AS pos, source_id FROM r WHERE pos <= 10
"""
