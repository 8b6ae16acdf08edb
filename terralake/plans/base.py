"""Registry of runnable queries, and the level-shaped views they read.

The views map the given tables onto levels (about 1500 orders, 150 customers and 10 suppliers make one
level) and use every row.  Their SQL is valid in Spark and in other engines alike, so that the same
text feeds the independent SQL twin of each query.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {
    # heights on 50 x 30 cells of 10 m, some missing in h_nd, wet where low
    "fx_raster": """
        SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id,
          CAST((o_orderkey % 1500) % 50 AS INT) AS px, CAST(FLOOR((o_orderkey % 1500) / 50) AS INT) AS pz,
          CAST(ROUND(o_totalprice / 1000) AS INT) AS h,
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(ROUND(o_totalprice / 1000) AS INT) END AS h_nd,
          o_totalprice <= 320000 AS wet
        FROM {orders}""",
    "fx_layers": """
        SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id, 'base' AS layer, 2 AS priority, 50 AS width, 30 AS height,
          CAST(0 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS z0, CAST(500 AS DOUBLE) AS x1, CAST(300 AS DOUBLE) AS z1,
          CAST(MIN(ROUND(o_totalprice / 1000)) AS DOUBLE) AS v_min, CAST(MAX(ROUND(o_totalprice / 1000)) AS DOUBLE) AS v_max
        FROM {orders} GROUP BY CAST(FLOOR(o_orderkey / 1500) AS BIGINT)""",
    # finer raster, 50 x 30 cells of 5 m inside the level
    "fx_detail": """
        SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id,
          CAST((o_orderkey % 1500) % 50 AS INT) AS px, CAST(FLOOR((o_orderkey % 1500) / 50) AS INT) AS pz,
          CAST(o_custkey % 400 AS DOUBLE) AS v
        FROM {orders}""",
    "fx_detail_layers": """
        SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id, 'detail' AS layer, 1 AS priority, 50 AS width, 30 AS height,
          CAST(100 AS DOUBLE) AS x0, CAST(60 AS DOUBLE) AS z0, CAST(350 AS DOUBLE) AS x1, CAST(210 AS DOUBLE) AS z1,
          CAST(MIN(o_custkey % 400) AS DOUBLE) AS v_min, CAST(MAX(o_custkey % 400) AS DOUBLE) AS v_max
        FROM {orders} GROUP BY CAST(FLOOR(o_orderkey / 1500) AS BIGINT)""",
    "fx_rgb": """
        SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id,
          CAST((o_orderkey % 1500) % 50 AS INT) AS px, CAST(FLOOR((o_orderkey % 1500) / 50) AS INT) AS pz,
          CAST((o_orderkey * 7 + o_custkey) % 256 AS INT) AS r, CAST((o_orderkey * 13 + o_custkey * 3) % 256 AS INT) AS g,
          CAST((o_orderkey * 29 + o_custkey * 5) % 256 AS INT) AS b, CAST((o_orderkey * 31) % 256 AS INT) AS a
        FROM {orders}""",
    "fx_pools": """
        SELECT CAST(p_partkey AS INT) AS pool_idx,
          CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN 'oak_tree_a' WHEN 1 THEN 'hedge_b' WHEN 2 THEN 'grass_c'
            WHEN 3 THEN 'house_d' WHEN 4 THEN 'stone_wall_e' WHEN 5 THEN 'rock_f' WHEN 6 THEN 'wreck_g'
            WHEN 7 THEN 'dirt_road_h' WHEN 8 THEN 'port_crane_i' ELSE p_name END AS name
        FROM {part}""",
    # the last pools have no dimension row
    "fx_instances": """
        SELECT CAST(FLOOR(l_orderkey / 1500) AS BIGINT) AS map_id, CAST(l_partkey + l_linenumber * 5 AS INT) AS pool_idx,
          CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 5000 AS DOUBLE) / 10 AS x,
          CAST(ROUND(l_quantity * 10) AS DOUBLE) AS y,
          CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 3000 AS DOUBLE) / 10 AS z
        FROM {lineitem}""",
    "fx_observers": """
        SELECT CAST(s_suppkey % 10 AS BIGINT) AS observer, CAST(FLOOR(s_suppkey / 10) AS BIGINT) AS map_id,
          CAST((s_suppkey * 37) % 500 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 300 AS DOUBLE) AS z
        FROM {supplier}""",
    "fx_zones": """
        SELECT CAST(s_suppkey AS BIGINT) AS zone_id, CAST(FLOOR(s_suppkey / 10) AS BIGINT) AS map_id,
          CASE CAST(FLOOR(s_suppkey / 2) AS BIGINT) % 2 WHEN 0 THEN '01_dom' ELSE 'bttl_a' END AS mission,
          CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'capture' WHEN 1 THEN 'spawn' WHEN 2 THEN 'spawn_zone' ELSE 'battle' END AS kind,
          CASE WHEN s_suppkey % 7 < 4 THEN 'hardcore' ELSE 'arcade' END AS mode,
          's_t' || CAST(1 + s_suppkey % 3 AS STRING) || '_area_' || CAST(s_suppkey % 31 AS STRING) AS name,
          CAST((s_suppkey * 41) % 500 AS DOUBLE) AS x, CAST((s_suppkey * 29) % 300 AS DOUBLE) AS z,
          CASE WHEN s_suppkey % 15 = 0 THEN NULL ELSE CAST(10 + s_suppkey % 40 AS DOUBLE) END AS radius,
          CASE WHEN s_suppkey % 5 >= 3 THEN CAST(20 + s_suppkey % 60 AS DOUBLE) END AS hx,
          CASE WHEN s_suppkey % 5 >= 3 THEN CAST(15 + s_suppkey % 45 AS DOUBLE) END AS hz
        FROM {supplier}""",
    "fx_cells": """
        SELECT CAST(FLOOR(c_custkey / 150) AS BIGINT) AS map_id, CAST(c_custkey % 150 AS INT) AS cell,
          CAST((c_custkey % 150) % 15 AS INT) AS tx, CAST(FLOOR((c_custkey % 150) / 15) AS INT) AS tz,
          CASE WHEN c_custkey % 10 = 7 THEN 255 ELSE CAST(c_custkey % 6 AS INT) END AS det0,
          CASE WHEN c_custkey % 4 = 0 THEN 255 ELSE CAST((c_custkey * 3) % 8 AS INT) END AS det1,
          CAST((c_custkey * 5) % 9 AS INT) AS det2, 255 AS det3, CAST((c_custkey * 7) % 11 AS INT) AS det4,
          CASE WHEN c_custkey % 3 = 0 THEN 255 ELSE 5 END AS det5, CAST(190 + c_custkey % 30 AS INT) AS det6,
          c_acctbal > 0 AS populated, c_acctbal > 5000 AS has_tex2
        FROM {customer}""",
    # 200 landclasses per level; every 13th is an ocean
    "fx_lcs": """
        SELECT CAST(FLOOR(p_partkey / 200) AS BIGINT) AS map_id, CAST(p_partkey % 200 AS INT) AS lc_idx, CAST(p_partkey AS BIGINT) AS ord,
          CASE WHEN p_partkey % 13 = 5 THEN 'deep_ocean_' || CAST(p_size AS STRING) ELSE REPLACE(p_name, ' ', '_') || '_' || CAST(p_partkey % 7 AS STRING) END AS name,
          CASE CAST(p_size % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN LOWER(p_type) || '_tex*'
            ELSE REPLACE(p_name, ' ', '_') END AS texture,
          CASE WHEN p_partkey % 3 = 0 THEN 'detail_' || LOWER(p_type) || '_tex_d' END AS d_r,
          CASE WHEN p_partkey % 4 = 1 THEN 'detail_' || REPLACE(p_name, ' ', '_') END AS d_g,
          CASE WHEN p_partkey % 5 = 2 THEN LOWER(p_brand) END AS d_b,
          CASE WHEN p_partkey % 6 = 3 THEN CAST(p_size * 8 AS DOUBLE) END AS size_m
        FROM {part}""",
    # texture names a level's own packs hold
    "fx_store": """
        SELECT DISTINCT CAST(FLOOR(l_orderkey / 1500) AS BIGINT) AS map_id,
          CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN REPLACE(p_name, ' ', '_') WHEN 1 THEN LOWER(p_type) || '_tex_d'
            ELSE REPLACE(p_name, ' ', '_') || '_' || CAST(p_partkey % 7 AS STRING) || '_tex_d' END AS name
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fx_spans": """
        SELECT user_id AS file, CAST((event_id * 37) % 10000 AS BIGINT) AS "start",
          CAST((event_id * 37) % 10000 + 1 + FLOOR(value) AS BIGINT) AS "end"
        FROM {events}""",
    "fx_builds": """
        SELECT event_id, user_id AS map_id, event_id % 20 AS run, event_type <> 'error' AS ok, value AS seconds, ts,
          CASE WHEN event_type = 'error' THEN REPLACE(REPEAT('step ' || CAST(event_id AS STRING) || '~', CAST(1 + event_id % 6 AS INT)), '~', CHR(10)) END AS error
        FROM {events}""",
    "fx_deltas": """
        SELECT CAST(FLOOR(o_orderkey / 50) AS BIGINT) AS block, CAST(o_orderkey % 50 AS INT) AS i, CAST(o_custkey % 256 AS INT) AS d
        FROM {orders}""",
    # entries of texture packs, five packs per level
    "fx_entries": """
        SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id,
          'pack_' || CAST(CAST(FLOOR(o_orderkey / 1500) AS BIGINT) * 5 + o_orderkey % 5 AS STRING) AS pack,
          CAST(o_orderkey % 5 AS INT) AS pack_priority, CAST(FLOOR((o_orderkey % 1500) / 5) AS INT) AS entry_idx,
          CASE WHEN o_custkey % 97 = 0 THEN '' ELSE 'tex_' || CAST(o_custkey % 120 AS STRING) END AS name,
          CASE WHEN o_orderstatus = 'F' THEN 'DXT5' ELSE 'DXT1' END AS fmt,
          CAST(512 * (1 + o_custkey % 4) AS INT) AS w, CAST(512 * (1 + o_orderkey % 3) AS INT) AS h
        FROM {orders}""",
    "fx_maps": """
        SELECT CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'avg_' WHEN 1 THEN 'air_' WHEN 2 THEN 'avn_' WHEN 3 THEN 'arcade_'
            WHEN 4 THEN '' ELSE 'old_' END || LOWER(c_mktsegment) || '_' || CAST(c_custkey AS STRING) AS name,
          c_custkey AS id, c_acctbal AS bal, c_acctbal > -800 AS success
        FROM {customer}""",
}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where plain SQL can express it, its SQL twin."""
    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"{name} is taken")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return fn

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def with_views(body: str) -> str:
    """Put the definitions of the used views in front of a query."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    plain = {t: t for t in TABLES}
    parts = [f"{v} AS ({VIEWS[v].format(**plain)})" for v in used]
    body = body.strip()
    recursive = "RECURSIVE " if body[:14].upper().startswith("WITH RECURSIVE") else ""
    if body[:4].upper() == "WITH":
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + rest
    return "WITH " + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = VIEWS[name].replace('"start"', "`start`").replace('"end"', "`end`")
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
