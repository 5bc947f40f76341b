"""All registered queries outside the text subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.plans import general, links, links_sql, vaults

QUERIES = {**links.QUERIES, **vaults.QUERIES, **general.QUERIES}
SQL = {**links_sql.SQL, **vaults.SQL, **general.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.twohop_orders(spark, sf_dir)
