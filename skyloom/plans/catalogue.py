"""Registered queries, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.plans import graphs, more, tables

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join two catalogs on their id, filter by ranges and classes, order, limit, project to 3-D."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .filter(
            F.col("o_totalprice").between(1000, 400000)
            & F.col("c_acctbal").between(0, 9000)
            & (F.col("c_mktsegment") == "BUILDING")
            & F.col("o_orderstatus").isin("O", "F")
        )
        .orderBy("o_orderkey")
        .limit(1000)
    )
    ra = F.radians(F.pmod(F.col("o_totalprice"), F.lit(360.0)))
    dec = F.radians(F.col("c_acctbal") / 100.0 - 45.0)
    return joined.select(
        F.col("o_orderkey"),
        F.round(F.cos(dec) * F.cos(ra), 6).alias("x"),
        F.round(F.cos(dec) * F.sin(ra), 6).alias("y"),
        F.round(F.sin(dec), 6).alias("z"),
    )


JOIN_FILTER_PROJECT = """
SELECT o_orderkey, round(cos(d) * cos(a), 6) AS x, round(cos(d) * sin(a), 6) AS y, round(sin(d), 6) AS z
FROM (
  SELECT o_orderkey, radians(o_totalprice % 360.0) AS a, radians(c_acctbal / 100.0 - 45.0) AS d
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_totalprice BETWEEN 1000 AND 400000 AND c_acctbal BETWEEN 0 AND 9000
    AND c_mktsegment = 'BUILDING' AND o_orderstatus IN ('O', 'F')
  ORDER BY o_orderkey LIMIT 1000)
"""


def queries() -> dict[str, Query]:
    found = {"s08_join_filter_project": join_filter_project}
    return found | {name: f for name, (f, _) in {**tables.QUERIES, **graphs.QUERIES, **more.QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    found = {"s08_join_filter_project": JOIN_FILTER_PROJECT}
    return found | {name: sql for name, (_, sql) in {**tables.QUERIES, **graphs.QUERIES, **more.QUERIES}.items() if sql}
