"""Queries over mission zones, missions and placed objects."""

from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import instances as obj
from ..operators import sampling, zones
from .base import query, table, view
from .q_names import _POOL_CATEGORY, OCCLUDES, STYLE_VIEWER

# ---- modes and extents -----------------------------------------------------------------------

_MODES = """
m AS (SELECT map_id, mission, kind, CASE WHEN bool_or(mode = 'arcade') THEN 'arcade' ELSE 'hardcore' END AS mode FROM fx_zones GROUP BY ALL)
"""


@query("preferred_mode", f"WITH {_MODES} SELECT * FROM m")
def preferred_mode(spark, sf):
    return zones.preferred_mode(view(spark, sf, "fx_zones"))


_COUNTS = _MODES + """,
n AS (SELECT z.map_id, z.mission, z.kind, count(*) AS n FROM fx_zones z JOIN m USING (map_id, mission, kind, mode) GROUP BY ALL)
"""


@query("mode_count", f"WITH {_COUNTS} SELECT * FROM n")
def mode_count(spark, sf):
    return zones.mode_count(view(spark, sf, "fx_zones"))


@query("mission_summary", f"""
WITH {_COUNTS}, s AS (SELECT map_id, mission, CAST(coalesce(sum(n) FILTER (kind = 'battle'), 0) AS BIGINT) AS battles,
  CAST(coalesce(sum(n) FILTER (kind = 'capture'), 0) AS BIGINT) AS captures, CAST(coalesce(sum(n) FILTER (kind IN ('spawn', 'spawn_zone')), 0) AS BIGINT) AS spawns FROM n GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY mission) AS ordinal FROM s""")
def mission_summary(spark, sf):
    return zones.mission_summary(view(spark, sf, "fx_zones"))


_BOXES = _MODES + """,
b AS (SELECT z.*, CASE kind WHEN 'battle' THEN abs(hx) WHEN 'capture' THEN greatest(abs(coalesce(radius, 30)), 30) ELSE 0 END AS ex,
    CASE kind WHEN 'battle' THEN abs(hz) WHEN 'capture' THEN greatest(abs(coalesce(radius, 30)), 30) ELSE 0 END AS ez
  FROM fx_zones z JOIN m USING (map_id, mission, kind, mode)),
battle AS (SELECT map_id, mission, min(x - ex) AS x0, min(z - ez) AS z0, max(x + ex) AS x1, max(z + ez) AS z1 FROM b WHERE kind = 'battle' GROUP BY ALL),
whole AS (SELECT map_id, mission, min(x - ex) AS x0, min(z - ez) AS z0, max(x + ex) AS x1, max(z + ez) AS z1 FROM b GROUP BY ALL)
"""


@query("battle_extent", f"WITH {_BOXES} SELECT * FROM battle")
def battle_extent(spark, sf):
    return zones.battle_extent(view(spark, sf, "fx_zones"))


@query("mission_extent", f"WITH {_BOXES} SELECT * FROM whole")
def mission_extent(spark, sf):
    return zones.mission_extent(view(spark, sf, "fx_zones"))


# tank zones of every third level, corners not in order
_TANK = """
SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id, CAST(MIN(o_custkey % 50) AS DOUBLE) + 300 AS tx0, CAST(200 AS DOUBLE) AS tz0, CAST(120 AS DOUBLE) AS tx1, CAST(40 AS DOUBLE) AS tz1
FROM {orders} GROUP BY CAST(FLOOR(o_orderkey / 1500) AS BIGINT)"""


@query("crop_rect", f"""
WITH {_BOXES}, t AS ({_TANK.format(orders='orders')}),
w AS (SELECT whole.map_id, whole.mission, coalesce(battle.x0, least(tx0, tx1), whole.x0) AS x0, coalesce(battle.z0, least(tz0, tz1), whole.z0) AS z0,
  coalesce(battle.x1, greatest(tx0, tx1), whole.x1) AS x1, coalesce(battle.z1, greatest(tz0, tz1), whole.z1) AS z1, l.x0 AS sx0, l.z0 AS sz0, l.x1 AS sx1, l.z1 AS sz1, l.width * 10 AS w, l.height * 10 AS h
  FROM whole LEFT JOIN battle USING (map_id, mission) LEFT JOIN t USING (map_id) JOIN fx_layers l USING (map_id)),
c AS (SELECT *, greatest(x0, sx0) AS a0, greatest(z0, sz0) AS b0, least(x1, sx1) AS a1, least(z1, sz1) AS b1 FROM w),
v AS (SELECT *, least(a0, a1) AS vx0, least(b0, b1) AS vz0, greatest(a0, a1) AS vx1, greatest(b0, b1) AS vz1 FROM c),
p AS (SELECT *, CAST(trunc((vx0 - sx0) / (sx1 - sx0) * w) AS BIGINT) AS p0, CAST(trunc((vx1 - sx0) / (sx1 - sx0) * w) AS BIGINT) AS p1,
  CAST(trunc((vz0 - sz0) / (sz1 - sz0) * h) AS BIGINT) AS q0, CAST(trunc((vz1 - sz0) / (sz1 - sz0) * h) AS BIGINT) AS q1 FROM v)
SELECT map_id, mission, p1 - p0 > 32 AND q1 - q0 > 32 AS cropped, CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN vx0 ELSE sx0 END AS x0,
  CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN vz0 ELSE sz0 END AS z0, CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN vx1 ELSE sx1 END AS x1,
  CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN vz1 ELSE sz1 END AS z1, CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN p0 ELSE 0 END AS px0,
  CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN q0 ELSE 0 END AS pz0, CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN p1 ELSE w END AS px1,
  CASE WHEN p1 - p0 > 32 AND q1 - q0 > 32 THEN q1 ELSE h END AS pz1 FROM p""")
def crop_rect(spark, sf):
    tank = spark.sql(_TANK, orders=table(spark, sf, "orders"))
    tank = tank.withColumn("r", geo.rect("tx0", "tz0", "tx1", "tz1")).select("map_id", *[F.col(f"r.{c}").alias(f"t{c}") for c in ("x0", "z0", "x1", "z1")])
    sources = view(spark, sf, "fx_layers").withColumn("width", F.col("width") * 10).withColumn("height", F.col("height") * 10)
    return zones.crop_rect(view(spark, sf, "fx_zones"), tank, sources)


@query("points_in_zones", """
SELECT i.map_id, zone_id, kind, count(*) AS n, CAST(sum(pool_idx) AS BIGINT) AS pools
FROM fx_instances i JOIN fx_zones s ON i.map_id = s.map_id
WHERE CASE WHEN hx IS NOT NULL THEN abs(i.x - s.x) <= hx AND abs(i.z - s.z) <= hz
  ELSE (i.x - s.x) * (i.x - s.x) + (i.z - s.z) * (i.z - s.z) <= radius * radius END
GROUP BY ALL""")
def points_in_zones(spark, sf):
    hits = zones.points_in_zones(view(spark, sf, "fx_instances"), view(spark, sf, "fx_zones"))
    return hits.groupBy("map_id", "zone_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("pool_idx").alias("pools"))


# ---- mission files ---------------------------------------------------------------------------

_FILES = """
SELECT CONCAT('f', p_partkey) AS file, LOWER(p_brand) AS folder, p_partkey % 3 = 0 AS air,
  CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'template_' WHEN 1 THEN '' WHEN 2 THEN 'x_' ELSE LOWER(p_brand) || '_' END || REPLACE(p_name, ' ', '_') || '_' || LOWER(p_type) AS stem
FROM {part}"""
_MAPS = """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'air_' || CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' WHEN 2 THEN 'red' WHEN 3 THEN 'economy' WHEN 4 THEN 'b' ELSE LOWER(c_mktsegment) END
  ELSE 'avg_brand#' || CAST(c_custkey % 30 AS STRING) END AS map_id, c_custkey AS seq
FROM {customer}"""
_FILES_SQL, _MAPS_SQL = _FILES.format(part="part"), _MAPS.format(customer="customer")


@query("missions_for_maps", f"""
WITH f AS ({_FILES_SQL}), m AS (SELECT DISTINCT map_id, substr(map_id, 5) AS suffix, starts_with(map_id, 'air_') AS air FROM ({_MAPS_SQL}))
SELECT m.map_id, f.file, f.stem FROM m JOIN f ON m.air = f.air AND NOT starts_with(f.stem, 'template_')
WHERE CASE WHEN m.air THEN contains(f.stem, m.suffix) ELSE f.folder = m.suffix AND starts_with(f.stem, m.suffix || '_') END""")
def missions_for_maps(spark, sf):
    files = spark.sql(_FILES, part=table(spark, sf, "part"))
    maps = spark.sql(_MAPS, customer=table(spark, sf, "customer")).select("map_id").distinct()
    return zones.missions_for_maps(maps, files)


_DOCS = """
SELECT file, CASE CAST(LENGTH(stem) % 9 AS INT) WHEN 8 THEN '{{"units": ' WHEN 7 THEN '{{}}' ELSE
  '{{"units":{{"area_squad":[{{"name":"t1_spawn","tm":[[1,0,0],[0,1,0],[0,0,1],[5,0,6]]}}]}},"areas":{{"t1_capture_area_1":{{"tm":[[3,0,4],[0,1,0],[0,0,1],[5,0,6]]}},"hardcore_battle_area":{{"tm":[[3,0,4],[0,1,0],[6,0,8],[9,0,9]]}}}}}}' END AS text
FROM {files}"""


@query("map_missions", f"""
WITH f AS ({_FILES_SQL}), m AS (SELECT DISTINCT map_id, substr(map_id, 5) AS suffix, starts_with(map_id, 'air_') AS air FROM ({_MAPS_SQL})),
x AS (SELECT m.map_id, f.file, length(f.stem) % 9 AS kind FROM m JOIN f ON m.air = f.air AND NOT starts_with(f.stem, 'template_')
  WHERE CASE WHEN m.air THEN contains(f.stem, m.suffix) ELSE f.folder = m.suffix AND starts_with(f.stem, m.suffix || '_') END)
SELECT map_id, file, CASE WHEN kind < 7 THEN 1 ELSE 0 END::BIGINT AS battles, CASE WHEN kind < 7 THEN 1 ELSE 0 END::BIGINT AS captures, CASE WHEN kind < 7 THEN 1 ELSE 0 END::BIGINT AS spawns
FROM x""")
def map_missions(spark, sf):
    """Files found for every map, their documents parsed and their zones counted; broken documents have none."""
    files = spark.sql(_FILES, part=table(spark, sf, "part"))
    maps = spark.sql(_MAPS, customer=table(spark, sf, "customer")).select("map_id").distinct()
    return zones.map_missions(maps, files, spark.sql(_DOCS, files=files)).select("map_id", "file", "battles", "captures", "spawns")


@query("order_missions", f"""
WITH f AS ({_FILES_SQL}) SELECT folder AS map_id, stem AS label, file, row_number() OVER (PARTITION BY folder ORDER BY stem, file) AS ordinal FROM f""")
def order_missions(spark, sf):
    f = spark.sql(_FILES, part=table(spark, sf, "part"))
    return zones.order_missions(f.select(F.col("folder").alias("map_id"), F.col("stem").alias("label"), "file"))


@query("spawn_semijoin", """
WITH s AS (SELECT DISTINCT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations WHERE role = 'assistant'),
a AS (SELECT c.conv_id, turn, split_part(text, ' ', 1) AS name FROM conversations c WHERE role <> 'assistant')
SELECT a.conv_id AS file, turn, a.name, s.word IS NOT NULL AS member FROM a LEFT JOIN s ON a.conv_id = s.conv_id AND a.name = s.word""")
def spawn_semijoin(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "file")
    squads = c.filter("role = 'assistant'").select("file", F.split("text", " ").alias("squad_members"))
    areas = c.filter("role <> 'assistant'").select("file", "turn", F.substring_index("text", " ", 1).alias("name"))
    return zones.spawn_semijoin(areas, squads).select("file", "turn", "name", "member")


@query("union_zones", """
WITH z AS (SELECT map_id, mission, kind, zone_id, x, z, CASE WHEN mission = 'bttl_a' THEN 'bttl' ELSE 'other' END AS mk FROM fx_zones)
SELECT map_id, mission, kind, zone_id, x, z FROM z WHERE kind <> 'spawn' OR mk <> 'bttl'
UNION ALL SELECT map_id, mission, 'spawn', zone_id, x, z FROM z WHERE kind = 'spawn_zone' AND mk = 'bttl'""")
def union_zones(spark, sf):
    z = view(spark, sf, "fx_zones").withColumn("mission_kind", names.mission_kind(F.concat(F.lit("m_"), F.col("mission"))))
    parts = {k: z.filter(F.col("kind") == k).drop("kind") for k in ("spawn", "spawn_zone", "capture", "battle")}
    out = zones.union_zones(parts["spawn"], parts["spawn_zone"], parts["capture"], parts["battle"])
    return out.select("map_id", "mission", "kind", "zone_id", "x", "z")


# ---- objects ---------------------------------------------------------------------------------

OBJECTS_SQL = f"""
pc AS (SELECT pool_idx, name, {_POOL_CATEGORY} AS category FROM fx_pools),
o0 AS (SELECT i.*, p.name, coalesce(p.category, 'other') AS category FROM fx_instances i LEFT JOIN pc p USING (pool_idx)),
o1 AS (SELECT map_id, pool_idx, x, y, z, coalesce(name, '') AS name, category FROM o0),
o AS (SELECT *, {STYLE_VIEWER} AS style FROM o1)
"""


def pools(spark, sf):
    return view(spark, sf, "fx_pools").withColumn("category", names.pool_category("name"))


def objects(spark, sf):
    return obj.instances_with_pool(view(spark, sf, "fx_instances"), obj.styled_pools(pools(spark, sf)))


@query("instances_with_pool", f"WITH {OBJECTS_SQL} SELECT map_id, pool_idx, x, y, z, name, category FROM o0")
def instances_with_pool(spark, sf):
    return obj.instances_with_pool(view(spark, sf, "fx_instances"), pools(spark, sf)).select("map_id", "pool_idx", "x", "y", "z", "name", "category")


@query("pool_counts", f"""
WITH {OBJECTS_SQL}, n AS (SELECT pool_idx, count(*) AS n FROM fx_instances GROUP BY pool_idx)
SELECT pc.pool_idx, pc.name, pc.category, coalesce(n.n, 0) AS n FROM pc LEFT JOIN n USING (pool_idx)""")
def pool_counts(spark, sf):
    return obj.pool_counts(view(spark, sf, "fx_instances"), pools(spark, sf)).select("pool_idx", "name", "category", "n")


@query("style_counts", f"WITH {OBJECTS_SQL} SELECT map_id, style, count(*) AS n FROM o GROUP BY ALL ORDER BY map_id, style")
def style_counts(spark, sf):
    return obj.style_counts(objects(spark, sf))


@query("density_grid", f"""
WITH {OBJECTS_SQL}, s AS (SELECT map_id, style, CAST(least(floor((x - 60) / 380 * 8), 7) AS INT) + 1 AS "column", CAST(least(floor((270 - z) / 240 * 8), 7) AS INT) AS "row"
  FROM o WHERE x BETWEEN 60 AND 440 AND z BETWEEN 30 AND 270)
SELECT map_id, style, "column", "row", chr(65 + "row") || "column" AS label, count(*) AS n FROM s GROUP BY ALL""")
def density_grid(spark, sf):
    views = view(spark, sf, "fx_layers").select(
        "map_id", F.lit(60.0).alias("x0"), F.lit(30.0).alias("z0"), F.lit(440.0).alias("x1"), F.lit(270.0).alias("z1")
    )
    return zones.density_grid(objects(spark, sf), views, 8)


GRIDS_SQL = """
b AS (SELECT map_id, min(x) - 8 AS x0, min(z) - 8 AS z0, greatest(1, max(x) - min(x) + 16) AS w, greatest(1, max(z) - min(z) + 16) AS h FROM occ0 GROUP BY map_id),
g AS (SELECT map_id, x0, z0, greatest(1, w / {n}, h / {n}) AS cell, w, h FROM b),
gd AS (SELECT map_id, x0, z0, cell, CAST(greatest(1, ceil(w / cell)) AS INT) AS cols, CAST(greatest(1, ceil(h / cell)) AS INT) AS rows FROM g)
"""
OCC_SQL = f"""
occ0 AS (SELECT map_id, x, z, y + CASE category WHEN 'building' THEN 16 WHEN 'infrastructure' THEN 14 WHEN 'debris' THEN 10 WHEN 'earthwork' THEN 8 WHEN 'other' THEN 8 ELSE 6 END AS top,
  CASE WHEN style = 'building' THEN 4.0 ELSE 3.0 END AS radius FROM o WHERE {OCCLUDES}),
{GRIDS_SQL}
"""
OCC_TAIL = """
c AS (SELECT a.map_id, CAST(floor((x - x0) / cell) AS INT) AS cx, CAST(floor((z - z0) / cell) AS INT) AS cz, CAST(greatest(1, ceil(radius / cell)) AS INT) AS reach, top, cols, rows
  FROM occ0 a JOIN gd ON a.map_id = gd.map_id),
d AS (SELECT *, unnest(generate_series(-reach, reach)) AS dx FROM c), e AS (SELECT *, unnest(generate_series(-reach, reach)) AS dz FROM d),
occ AS (SELECT map_id, CAST(cx + dx AS INT) AS gx, CAST(cz + dz AS INT) AS gz, max(top) AS top FROM e
  WHERE dx * dx + dz * dz <= reach * reach AND cx + dx >= 0 AND cx + dx < cols AND cz + dz >= 0 AND cz + dz < rows AND top > 0 GROUP BY ALL)
"""


@query("build_occupancy", f"WITH {OBJECTS_SQL}, {OCC_SQL.format(n='4096')}, {OCC_TAIL} SELECT map_id, gx, gz, top FROM occ")
def build_occupancy(spark, sf):
    return obj.build_occupancy(objects(spark, sf))[0]


@query("occupancy_grids", f"WITH {OBJECTS_SQL}, {OCC_SQL.format(n='128')} SELECT * FROM gd")
def occupancy_grids(spark, sf):
    return obj.occupancy_grids(obj.occluders(objects(spark, sf)), 128)


@query("instances_with_ground", """
WITH s AS (SELECT i.*, r.h AS ground FROM fx_instances i JOIN fx_raster r ON r.map_id = i.map_id
  AND r.px = least(greatest(floor(x / 500 * 50), 0), 49) AND r.pz = least(greatest(floor(z / 300 * 30), 0), 29)),
g AS (SELECT s.*, v_min, v_max, CASE WHEN abs(y - ground) > 120 THEN ground ELSE y END AS fixed FROM s JOIN fx_layers l ON l.map_id = s.map_id)
SELECT map_id, pool_idx, x, z, CAST(ground AS DOUBLE) AS ground, CAST(fixed AS DOUBLE) AS y, round(least(greatest((fixed - v_min) / (v_max - v_min), 0), 1), 8) AS h_norm FROM g""")
def instances_with_ground(spark, sf):
    fixed = sampling.instances_with_ground(view(spark, sf, "fx_instances"), base_raster(spark, sf), view(spark, sf, "fx_layers"))
    return fixed.select("map_id", "pool_idx", "x", "z", "ground", "y", F.round("h_norm", 8).alias("h_norm"))


def base_raster(spark, sf):
    return view(spark, sf, "fx_raster").select("map_id", F.lit("base").alias("layer"), "px", "pz", F.col("h").cast("double").alias("v"))
