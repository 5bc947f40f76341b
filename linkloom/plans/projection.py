"""A vault made of relational rows: notes composed as Markdown, so that the whole pipeline runs on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.runtime import partitions, table


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, mtime, walk_ord): one note per order with a link per line item to its part, its supplier and the customer.

    Parts and customers have notes; suppliers haven't, so links to them end in phantoms.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", F.format_string("[p](/parts/%d.md)\n[[suppliers/%d]]", "l_partkey", "l_suppkey").alias("x"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "x"))).alias("xs"))
    )
    body = F.array_join(F.transform("xs", lambda x: x["x"]), "\n")
    text = F.concat(F.format_string("[[customers/%d]]\n", "o_custkey"), F.coalesce(F.concat(body, F.lit("\n")), F.lit("")), F.lit("#status/"), "o_orderstatus")
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    notes = rows.select(F.format_string("orders/%d.md", "o_orderkey").alias("path"), text.alias("content"), F.lit(0).cast("long").alias("mtime"), F.col("o_orderkey").alias("walk_ord"))
    # the rows are small but what is done with them isn't: as many parts as the session asks for, not as few as the bytes suggest
    return notes.repartition(max(partitions(spark), spark.sparkContext.defaultParallelism), "path")


def other_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of customers, with their segment as a tag, and of parts, with their brand in the frontmatter."""
    top = 1 << 32
    cust = table(spark, sf_dir, "customer").select(
        F.format_string("customers/%d.md", "c_custkey").alias("path"), F.concat(F.lit("#segment/"), F.lower("c_mktsegment")).alias("content"), (F.lit(top) + F.col("c_custkey")).alias("walk_ord")
    )
    part = table(spark, sf_dir, "part").select(
        F.format_string("parts/%d.md", "p_partkey").alias("path"),
        F.concat(F.lit("---\ntags: [brand/"), F.regexp_replace("p_brand", "[^0-9A-Za-z]", "-"), F.lit("]\n---\n")).alias("content"),
        (F.lit(2 * top) + F.col("p_partkey")).alias("walk_ord"),
    )
    both = cust.unionByName(part)
    return both.select("path", "content", F.lit(0).cast("long").alias("mtime"), "walk_ord")


def no_assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, mtime long, walk_ord long")
