"""Fixture views over the driver tables: one text for Spark SQL and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_point": """
        SELECT o_orderkey AS id, CAST((o_orderkey*7919)%20011 AS DOUBLE) AS x,
               CAST((o_orderkey*104729)%20021 AS DOUBLE) AS y,
               CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS label,
               o_totalprice AS score, CAST(o_custkey%10 AS INT) AS realiz
        FROM {orders}""",
    "v_pixel": """
        SELECT 'acct' AS raster, CAST(floor(c_custkey/40.0) AS INT) AS r, CAST(c_custkey%40 AS INT) AS c,
               CASE WHEN c_acctbal<0 THEN CAST(-9999.0 AS DOUBLE) ELSE c_acctbal END AS value FROM {customer}
        UNION ALL
        SELECT 'price', CAST(floor(p_partkey/40.0) AS INT), CAST(p_partkey%40 AS INT), p_retailprice FROM {part}""",
    "v_zone": """
        SELECT n_nationkey AS zone_id,
               CAST((n_nationkey*3571)%20000-(300+40*n_regionkey) AS DOUBLE) AS x1,
               CAST((n_nationkey*6007)%20000-(300+40*n_regionkey) AS DOUBLE) AS y1,
               CAST((n_nationkey*3571)%20000+(300+40*n_regionkey) AS DOUBLE) AS x2,
               CAST((n_nationkey*6007)%20000+(300+40*n_regionkey) AS DOUBLE) AS y2 FROM {nation}""",
    "v_parcel": """
        SELECT c_custkey AS zone_id, CAST((c_custkey*3571)%20000-(5+c_custkey%7) AS DOUBLE) AS x1, CAST((c_custkey*6007)%20000-(5+c_custkey%11) AS DOUBLE) AS y1,
               CAST((c_custkey*3571)%20000+(5+c_custkey%7) AS DOUBLE) AS x2, CAST((c_custkey*6007)%20000+(5+c_custkey%11) AS DOUBLE) AS y2 FROM {customer}""",
    "v_pred": """
        SELECT event_id AS id, CAST(user_id%10 AS INT) AS realiz, event_type AS model,
               CASE WHEN (event_id*7919)%7=0 OR value>300 THEN 1 ELSE 0 END AS label,
               value/500.0 AS probability FROM {events}""",
    "v_comp": """
        SELECT event_id AS id, CAST(user_id%10 AS INT) AS realiz,
               CASE WHEN event_id%2=0 THEN 'validation' ELSE 'test' END AS part,
               CASE WHEN (event_id*7919)%7=0 OR value>300 THEN 1 ELSE 0 END AS label,
               value/500.0 AS p_a, CAST((event_id*104729)%1009 AS DOUBLE)/1009.0 AS p_b,
               (value%50.0)/50.0 AS p_c FROM {events}""",
    "v_metric": """
        SELECT CAST(user_id%10 AS INT) AS realiz, event_type AS model, avg(value/500.0) AS metric
        FROM {events} GROUP BY CAST(user_id%10 AS INT), event_type""",
    "v_member": """
        SELECT CAST(user_id%10 AS INT) AS member, CAST(event_id%500 AS INT) AS cell, avg(value)/500.0 AS probability
        FROM {events} GROUP BY CAST(user_id%10 AS INT), CAST(event_id%500 AS INT)""",
}
TABLES = ("orders", "customer", "part", "nation", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name]
    frames = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **frames)


def with_views(body: str, *names: str) -> str:
    """SQL text of ``body`` with the named views as leading CTEs."""
    plain = {t: t for t in TABLES}
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)
    return f"WITH {ctes}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().lstrip('+')}"
