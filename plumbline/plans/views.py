"""Observations, grids and nodes made from the test tables; the SQL means the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import table

#: Views by name; {events} and the like stand for tables, {obs_ter} for another view.
VIEWS = {
    "obs_air": """
SELECT event_id AS obs_id, event_type AS project, user_id AS line, CAST(rn AS BIGINT) AS seq, 36e0 + 1e-2 * rn AS lat, -109e0 + 1e-2 * rn AS lon, 15e2 + value AS h, 9795e2 + value AS g
FROM (SELECT event_id, event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM {events}) t""",
    "obs_ter": """
SELECT c_custkey AS obs_id, c_mktsegment AS project, 36e0 + 3e0 * ((c_custkey * 7919) % 10007) / 10007e0 AS lat, -109e0 + 6e0 * ((c_custkey * 104729) % 10009) / 10009e0 AS lon,
  15e2 + 1e3 * ((c_custkey * 31) % 997) / 997e0 AS h, 9795e2 + c_acctbal / 1e2 AS g FROM {customer}""",
    "model_signal": """
SELECT obs_id, 2e1 * sin(radians(lat * 1e1)) AS ggm, 5e0 * cos(radians(lon * 2e1)) AS topo_low, 8e0 * cos(radians(lon * 2e1 + 3e0)) AS topo_high, 1e0 * sin(radians(lon * 5e1)) AS ertm FROM {obs_ter}""",
    "grid": """
SELECT CAST(floor(p_partkey / 4e1) AS INT) AS r, CAST(p_partkey % 40 AS INT) AS c, 355e-1 + 25e-2 * floor(p_partkey / 4e1) AS lat, -1095e-1 + 25e-2 * (p_partkey % 40) AS lon, p_retailprice AS value FROM {part}""",
    "nodes": """
SELECT s_suppkey AS node_id, 36e0 + 3e0 * ((s_suppkey * 37) % 101) / 101e0 AS lat, -109e0 + 6e0 * ((s_suppkey * 53) % 103) / 103e0 AS lon, s_acctbal * 1e-9 AS beta FROM {supplier}""",
    "sigma_prior": """
SELECT DISTINCT event_type AS project, 1e0 + length(event_type) / 1e1 AS sigma2 FROM {events} WHERE event_type <> 'error'""",
    "norm_history": """
SELECT s_suppkey AS iter, exp(-4e0 + 1e-1 * s_suppkey) + 1e-1 AS res_norm, exp(3e0 - 1e-1 * s_suppkey) + 1e-1 AS sol_norm FROM {supplier}""",
}
TABLES = {"obs_air": "events", "obs_ter": "customer", "grid": "part", "nodes": "supplier", "sigma_prior": "events", "norm_history": "supplier"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    if name == "model_signal":
        return spark.sql(VIEWS[name], obs_ter=view(spark, sf_dir, "obs_ter"))
    return spark.sql(VIEWS[name], **{TABLES[name]: table(spark, sf_dir, TABLES[name])})


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL: the query after the views that it names, as common table expressions."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in [*TABLES.values(), 'obs_ter']})})" for n in names]
    body = query.strip()
    recursive = body.startswith("WITH RECURSIVE")
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)
    return f"{head}, {body[15 if recursive else 5:]}" if body.startswith("WITH ") else f"{head} {body}"
