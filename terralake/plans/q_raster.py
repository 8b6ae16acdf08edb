"""Queries over height rasters, sampling and line of sight."""

from pyspark.sql import functions as F

from ..operators import instances as obj
from ..operators import raster, sampling, scans, viewshed
from .base import query, table, view
from .q_zones import GRIDS_SQL, OBJECTS_SQL, OCC_SQL, OCC_TAIL, base_raster, objects, pools

# ---- statistics and packing ------------------------------------------------------------------


@query("raster_stats", """
WITH w AS (SELECT map_id, min(h) AS lo, max(h) AS hi FROM fx_raster GROUP BY map_id),
q AS (SELECT r.map_id, lo, hi, CAST(trunc((h - lo) / greatest(hi - lo, 0.0001) * 65535.0) AS INT) AS q FROM fx_raster r JOIN w USING (map_id))
SELECT map_id, min(q) AS min, max(q) AS max, round(avg(q), 1) AS mean, round(CAST(min(lo) AS DOUBLE), 1) AS height_min_m, round(CAST(min(hi) AS DOUBLE), 1) AS height_max_m FROM q GROUP BY map_id""")
def raster_stats(spark, sf):
    return raster.raster_stats(base_raster(spark, sf)).drop("layer")


@query("world_heights", """
SELECT r.map_id, px, pz, round(h * ((v_max - v_min) / 65535.0) + v_min, 8) AS v FROM fx_raster r JOIN fx_layers l ON l.map_id = r.map_id""")
def world_heights(spark, sf):
    w = raster.world_heights(base_raster(spark, sf), view(spark, sf, "fx_layers"))
    return w.select("map_id", "px", "pz", F.round("v", 8).alias("v"))


@query("pack_tiles", """
SELECT map_id, CAST(px // 16 AS INT) AS tx, CAST(pz // 16 AS INT) AS tz, CAST(least(16, 50 - px // 16 * 16) AS INT) AS w, CAST(least(16, 30 - pz // 16 * 16) AS INT) AS h,
  string_agg(coalesce(CAST(h_nd AS VARCHAR), '-'), ',' ORDER BY pz, px) AS data FROM fx_raster GROUP BY ALL""")
def pack_tiles(spark, sf):
    r = view(spark, sf, "fx_raster").select("map_id", F.lit("base").alias("layer"), "px", "pz", F.col("h_nd").alias("v"))
    tiles = raster.pack_tiles(r, view(spark, sf, "fx_layers"), 16)
    data = F.transform("data", lambda v: F.coalesce(v.cast("int").cast("string"), F.lit("-")))
    return tiles.select("map_id", "tx", "tz", "w", "h", F.array_join(data, ",").alias("data"))


@query("unpack_tiles", "SELECT map_id, px, pz, CAST(h_nd AS DOUBLE) AS v FROM fx_raster")
def unpack_tiles(spark, sf):
    r = view(spark, sf, "fx_raster").select("map_id", F.lit("base").alias("layer"), "px", "pz", F.col("h_nd").alias("v"))
    return raster.unpack_tiles(raster.pack_tiles(r, view(spark, sf, "fx_layers"), 16), 16).drop("layer")


@query("write_raster", "SELECT map_id, px, pz, CAST(h AS DOUBLE) AS v FROM fx_raster")
def write_raster(spark, sf):
    from ..session import scratch_path
    from ..sources.sinks import write_raster as write

    path = scratch_path(spark, "raster")
    write(raster.pack_tiles(base_raster(spark, sf), view(spark, sf, "fx_layers"), 16), path)
    return raster.unpack_tiles(spark.read.parquet(path), 16).drop("layer")


@query("write_instances", """
SELECT map_id, pool_idx, round(x * 10) / 10 AS x, round(y * 10) / 10 AS y, round(z * 10) / 10 AS z FROM fx_instances""")
def write_instances(spark, sf):
    from ..session import scratch_path
    from ..sources.sinks import write_instances as write

    path = scratch_path(spark, "instances")
    write(view(spark, sf, "fx_instances"), path)
    back = spark.read.parquet(path)
    return back.select(F.col("map_id").cast("long").alias("map_id"), "pool_idx", *[F.round(F.col(c).cast("double"), 1).alias(c) for c in "xyz"])


# ---- neighbourhoods --------------------------------------------------------------------------


@query("neighbors", """
WITH o(dx, dz) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1))
SELECT r.map_id, r.px, r.pz, o.dx, o.dz, n.h AS neighbor FROM fx_raster r CROSS JOIN o LEFT JOIN fx_raster n ON n.map_id = r.map_id AND n.px = r.px + o.dx AND n.pz = r.pz + o.dz""")
def neighbors(spark, sf):
    return raster.neighbors(view(spark, sf, "fx_raster"), [(-1, 0), (1, 0), (0, -1), (0, 1)], "h")


@query("box_mean", """
SELECT a.map_id, a.px, a.pz, CAST(sum(b.h) // count(*) AS BIGINT) AS mean
FROM fx_raster a JOIN fx_raster b ON a.map_id = b.map_id AND abs(a.px - b.px) <= 3 AND abs(a.pz - b.pz) <= 3 GROUP BY ALL""")
def box_mean(spark, sf):
    out = raster.box_mean(view(spark, sf, "fx_raster").select("map_id", "px", "pz", "h"), 3, "h", "mean", side=16)
    return out.select("map_id", "px", "pz", "mean")


@query("gradient_normals", """
WITH g AS (SELECT map_id, px, pz, -(lead(h) OVER x - lag(h) OVER x) / 2.0 AS gx, -(lead(h) OVER z - lag(h) OVER z) / 2.0 AS gz FROM fx_raster
  WINDOW x AS (PARTITION BY map_id, pz ORDER BY px), z AS (PARTITION BY map_id, px ORDER BY pz)),
n AS (SELECT *, sqrt(gx * gx + gz * gz + 1) AS m, px BETWEEN 1 AND 48 AND pz BETWEEN 1 AND 28 AS inner_cell FROM g)
SELECT map_id, px, pz, CASE WHEN inner_cell THEN CAST(trunc((gx / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS nr,
  CASE WHEN inner_cell THEN CAST(trunc((gz / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS ng, CASE WHEN inner_cell THEN CAST(trunc((1 / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS nb FROM n""")
def gradient_normals(spark, sf):
    return raster.gradient_normals(base_raster(spark, sf), view(spark, sf, "fx_layers"), 1.0, side=16).select("map_id", "px", "pz", "nr", "ng", "nb")


@query("gradient_normals_metres", """
WITH g AS (SELECT map_id, px, pz, -(lead(h) OVER x - lag(h) OVER x) / 20.0 AS gx, -(lead(h) OVER z - lag(h) OVER z) / 20.0 AS gz FROM fx_raster
  WINDOW x AS (PARTITION BY map_id, pz ORDER BY px), z AS (PARTITION BY map_id, px ORDER BY pz)),
n AS (SELECT *, sqrt(gx * gx + gz * gz + 1) AS m, px BETWEEN 1 AND 48 AND pz BETWEEN 1 AND 28 AS inner_cell FROM g)
SELECT map_id, px, pz, CASE WHEN inner_cell THEN CAST(trunc((gx / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS nr,
  CASE WHEN inner_cell THEN CAST(trunc((gz / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS ng, CASE WHEN inner_cell THEN CAST(trunc((1 / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS nb FROM n""")
def gradient_normals_metres(spark, sf):
    layers = view(spark, sf, "fx_layers").withColumn("cell_size", F.lit(10.0))
    return raster.gradient_normals(base_raster(spark, sf), layers, "cell_size").select("map_id", "px", "pz", "nr", "ng", "nb")


# ---- filling ---------------------------------------------------------------------------------


@query("pyramid_level", """
SELECT map_id, CAST(px // 2 AS INT) AS px, CAST(pz // 2 AS INT) AS pz, round(avg(h_nd), 8) AS v FROM fx_raster WHERE px // 2 < 25 AND pz // 2 < 15 GROUP BY ALL""")
def pyramid_level(spark, sf):
    r = view(spark, sf, "fx_raster").select("map_id", "px", "pz", F.col("h_nd").alias("v"))
    return raster.pyramid_level(r, view(spark, sf, "fx_layers")).withColumn("v", F.round("v", 8))


def _fill_sql(before: str = "", source: str = "fx_raster") -> str:
    """All levels of the filling for 50 x 30 cells: 25x15, 12x7, 6x3, 3x1."""
    dims = [(50, 30), (25, 15), (12, 7), (6, 3), (3, 1)]
    ctes = [before] if before else []
    ctes.append(f"l0 AS (SELECT map_id, px, pz, CAST(h_nd AS DOUBLE) AS v FROM {source})")
    for i in range(1, len(dims)):
        w, h = dims[i]
        ctes.append(f"l{i} AS (SELECT map_id, px // 2 AS px, pz // 2 AS pz, avg(v) AS v FROM l{i - 1} WHERE px // 2 < {w} AND pz // 2 < {h} GROUP BY ALL)")
    last = f"l{len(dims) - 1}"
    for k in range(3):  # a row of three cells is complete after at most two rounds
        near = f"(SELECT avg(n.v) FROM {last} n WHERE n.map_id = c.map_id AND abs(n.px - c.px) + abs(n.pz - c.pz) = 1)"
        ctes.append(f"s{k} AS (SELECT map_id, px, pz, coalesce(v, {near}) AS v FROM {last} c)")
        last = f"s{k}"
    ctes.append(f"f{len(dims) - 1} AS (SELECT map_id, px, pz, coalesce(v, 0) AS v FROM {last})")
    for i in range(len(dims) - 2, -1, -1):
        (fw, fh), (cw, ch) = dims[i], dims[i + 1]
        ctes.append(f"""c{i} AS (SELECT *, greatest((px + 0.5) / {fw} * {cw} - 0.5, 0)::DOUBLE AS cx, greatest((pz + 0.5) / {fh} * {ch} - 0.5, 0)::DOUBLE AS cz FROM l{i}),
k{i} AS (SELECT *, least(CAST(floor(cx) AS INT), {cw - 1}) AS x0, least(CAST(floor(cz) AS INT), {ch - 1}) AS z0 FROM c{i}),
f{i} AS (SELECT k.map_id, k.px, k.pz, coalesce(k.v, a.v * (1 - (cx - x0)) * (1 - (cz - z0)) + b.v * (cx - x0) * (1 - (cz - z0)) + c.v * (1 - (cx - x0)) * (cz - z0) + d.v * (cx - x0) * (cz - z0)) AS v
  FROM k{i} k JOIN f{i + 1} a ON a.map_id = k.map_id AND a.px = x0 AND a.pz = z0 JOIN f{i + 1} b ON b.map_id = k.map_id AND b.px = least(x0 + 1, {cw - 1}) AND b.pz = z0
  JOIN f{i + 1} c ON c.map_id = k.map_id AND c.px = x0 AND c.pz = least(z0 + 1, {ch - 1}) JOIN f{i + 1} d ON d.map_id = k.map_id AND d.px = least(x0 + 1, {cw - 1}) AND d.pz = least(z0 + 1, {ch - 1}))""")
    return "WITH " + ",\n".join(ctes) + "\nSELECT map_id, px, pz, round(v, 6) AS v FROM f0"


@query("fill_nodata", _fill_sql())
def fill_nodata(spark, sf):
    r = view(spark, sf, "fx_raster").select("map_id", "px", "pz", F.col("h_nd").alias("v"))
    return raster.fill_nodata(r, view(spark, sf, "fx_layers")).withColumn("v", F.round("v", 6))


# ---- resampling ------------------------------------------------------------------------------


@query("resample_nearest", """
WITH t AS (SELECT map_id, unnest(generate_series(0, 72)) AS px FROM fx_layers), c AS (SELECT *, unnest(generate_series(0, 40)) AS pz FROM t)
SELECT c.map_id, CAST(c.px AS INT) AS px, CAST(c.pz AS INT) AS pz, CAST(r.h AS DOUBLE) AS v FROM c JOIN fx_raster r ON r.map_id = c.map_id
  AND r.px = least(CAST(trunc((c.px + 0.5) * (50 / 73)) AS INT), 49) AND r.pz = least(CAST(trunc((c.pz + 0.5) * (30 / 41)) AS INT), 29)""")
def resample_nearest(spark, sf):
    return raster.resample(base_raster(spark, sf), view(spark, sf, "fx_layers"), 73, 41).drop("layer")


@query("resample_bilinear", """
WITH t AS (SELECT map_id, unnest(generate_series(0, 72)) AS px FROM fx_layers), c AS (SELECT *, unnest(generate_series(0, 40)) AS pz FROM t),
f AS (SELECT *, px / 73.0::DOUBLE * 50 AS fx, pz / 41.0::DOUBLE * 30 AS fz FROM c), k AS (SELECT *, CAST(floor(fx) AS INT) AS x0, CAST(floor(fz) AS INT) AS z0 FROM f)
SELECT k.map_id, CAST(k.px AS INT) AS px, CAST(k.pz AS INT) AS pz,
  round(a.h * (1 - (fx - x0)) * (1 - (fz - z0)) + b.h * (fx - x0) * (1 - (fz - z0)) + c.h * (1 - (fx - x0)) * (fz - z0) + d.h * (fx - x0) * (fz - z0), 6) AS v
FROM k JOIN fx_raster a ON a.map_id = k.map_id AND a.px = x0 AND a.pz = z0 JOIN fx_raster b ON b.map_id = k.map_id AND b.px = least(x0 + 1, 49) AND b.pz = z0
  JOIN fx_raster c ON c.map_id = k.map_id AND c.px = x0 AND c.pz = least(z0 + 1, 29) JOIN fx_raster d ON d.map_id = k.map_id AND d.px = least(x0 + 1, 49) AND d.pz = least(z0 + 1, 29)""")
def resample_bilinear(spark, sf):
    r = raster.resample(base_raster(spark, sf), view(spark, sf, "fx_layers"), 73, 41, "bilinear")
    return r.select("map_id", "px", "pz", F.round("v", 6).alias("v"))


@query("resample_mean", """
SELECT map_id, least(CAST(trunc((px + 0.5) / 50 * 7) AS INT), 6) AS px, least(CAST(trunc((pz + 0.5) / 30 * 4) AS INT), 3) AS pz, round(avg(h), 6) AS v FROM fx_raster GROUP BY ALL""")
def resample_mean(spark, sf):
    r = raster.resample(base_raster(spark, sf), view(spark, sf, "fx_layers"), 7, 4, "mean")
    return r.select("map_id", "px", "pz", F.round("v", 6).alias("v"))


# detail 100..350 x 60..210 m on 50 x 30 cells of 10 m: window 10..35 x 6..21, feather min(16, 6, 3) = 3
@query("overlay_detail", """
WITH w AS (SELECT *, least(px - 10, 34 - px, pz - 6, 20 - pz) AS dist, (px - 10) / 25 * 50 AS fx, (pz - 6) / 15 * 30 AS fz FROM fx_raster WHERE px >= 10 AND px < 35 AND pz >= 6 AND pz < 21),
k AS (SELECT *, CAST(floor(fx) AS INT) AS x0, CAST(floor(fz) AS INT) AS z0 FROM w),
s AS (SELECT k.*, a.v * (1 - (fx - x0)) * (1 - (fz - z0)) + b.v * (fx - x0) * (1 - (fz - z0)) + c.v * (1 - (fx - x0)) * (fz - z0) + d.v * (fx - x0) * (fz - z0) AS d
  FROM k JOIN fx_detail a ON a.map_id = k.map_id AND a.px = x0 AND a.pz = z0 JOIN fx_detail b ON b.map_id = k.map_id AND b.px = least(x0 + 1, 49) AND b.pz = z0
  JOIN fx_detail c ON c.map_id = k.map_id AND c.px = x0 AND c.pz = least(z0 + 1, 29) JOIN fx_detail d ON d.map_id = k.map_id AND d.px = least(x0 + 1, 49) AND d.pz = least(z0 + 1, 29))
SELECT map_id, px, pz, CAST(h AS DOUBLE) AS v FROM fx_raster WHERE NOT (px >= 10 AND px < 35 AND pz >= 6 AND pz < 21)
UNION ALL SELECT map_id, px, pz, round(CASE WHEN dist < 3 THEN h * (1 - (dist + 1) / 4) + d * ((dist + 1) / 4) ELSE d END, 6) FROM s""")
def overlay_detail(spark, sf):
    out = raster.overlay_detail(
        base_raster(spark, sf), view(spark, sf, "fx_detail"), view(spark, sf, "fx_layers"), view(spark, sf, "fx_detail_layers")
    )
    return out.withColumn("v", F.round("v", 6))


@query("crop", """
SELECT map_id, px - 7 AS px, pz - 4 AS pz, CAST(h AS DOUBLE) AS v FROM fx_raster WHERE px >= 7 AND px < 33 AND pz >= 4 AND pz < 25""")
def crop(spark, sf):
    rects = view(spark, sf, "fx_layers").select("map_id", F.lit(77.0).alias("rx0"), F.lit(41.0).alias("rz0"), F.lit(335.0).alias("rx1"), F.lit(259.0).alias("rz1"))
    return raster.crop(base_raster(spark, sf), view(spark, sf, "fx_layers"), rects).drop("layer")


@query("flip_vertical", "SELECT map_id, px, 29 - pz AS pz, CAST(h AS DOUBLE) AS v FROM fx_raster")
def flip_vertical(spark, sf):
    return raster.flip_vertical(base_raster(spark, sf), view(spark, sf, "fx_layers")).drop("layer")


# ---- triangles -------------------------------------------------------------------------------

_TRIS = """
SELECT CAST(FLOOR(s_suppkey / 10) AS BIGINT) AS map_id, s_suppkey AS tri_id, CAST((s_suppkey * 37) % 500 AS DOUBLE) AS x0, CAST(s_suppkey % 60 AS DOUBLE) AS y0, CAST((s_suppkey * 53) % 300 AS DOUBLE) AS z0,
  CAST((s_suppkey * 91 + 130) % 500 AS DOUBLE) AS x1, CAST((s_suppkey * 3) % 80 AS DOUBLE) AS y1, CAST((s_suppkey * 17 + 60) % 300 AS DOUBLE) AS z1,
  CAST((s_suppkey * 11 + 310) % 500 AS DOUBLE) AS x2, CAST((s_suppkey * 7) % 90 AS DOUBLE) AS y2, CAST((s_suppkey * 29 + 170) % 300 AS DOUBLE) AS z2
FROM {supplier}"""


@query("rasterize_triangles", f"""
WITH t AS ({_TRIS.format(supplier='supplier')}), d AS (SELECT *, (x1 - x0) * (z2 - z0) - (z1 - z0) * (x2 - x0) AS det FROM t),
c AS (SELECT d.*, r.px, r.pz, (r.px + 0.5) / 50 * 500 - x0 AS dx, (r.pz + 0.5) / 30 * 300 - z0 AS dz FROM d JOIN fx_raster r ON r.map_id = d.map_id WHERE abs(det) >= 1e-12),
u AS (SELECT *, (dx * (z2 - z0) - dz * (x2 - x0)) * (1 / det) AS u, ((x1 - x0) * dz - (z1 - z0) * dx) * (1 / det) AS v FROM c)
SELECT map_id, px, pz, round(max(y0 + u * (y1 - y0) + v * (y2 - y0)), 6) AS h FROM u WHERE u >= 0 AND v >= 0 AND u + v <= 1 GROUP BY ALL""")
def rasterize_triangles(spark, sf):
    tris = spark.sql(_TRIS, supplier=table(spark, sf, "supplier"))
    return raster.rasterize_triangles(tris, view(spark, sf, "fx_layers"), (50, 30), side=16).withColumn("h", F.round("h", 6))


@query("filled_mesh", _fill_sql(f"""
u AS (SELECT r.map_id, r.px, r.pz, max(CASE WHEN a >= 0 AND b >= 0 AND a + b <= 1 THEN y0 + a * (y1 - y0) + b * (y2 - y0) END) AS h_nd FROM fx_raster r
  LEFT JOIN (SELECT d.*, q.px, q.pz, ((q.px + 0.5) / 50 * 500 - x0) AS dx, ((q.pz + 0.5) / 30 * 300 - z0) AS dz, (dx * (z2 - z0) - dz * (x2 - x0)) * (1 / det) AS a, ((x1 - x0) * dz - (z1 - z0) * dx) * (1 / det) AS b
    FROM (SELECT *, (x1 - x0) * (z2 - z0) - (z1 - z0) * (x2 - x0) AS det FROM ({_TRIS.format(supplier='supplier')})) d JOIN fx_raster q USING (map_id) WHERE abs(det) >= 1e-12) k
  ON k.map_id = r.map_id AND k.px = r.px AND k.pz = r.pz GROUP BY ALL)""", "u"))
def filled_mesh(spark, sf):
    """A mesh becomes a raster, and what no triangle covers is filled."""
    tris = spark.sql(_TRIS, supplier=table(spark, sf, "supplier"))
    layers = view(spark, sf, "fx_layers")
    mesh = raster.rasterize_triangles(tris, layers, (50, 30), side=16).withColumnRenamed("h", "v")
    return raster.fill_nodata(mesh, layers.drop("layer")).withColumn("v", F.round("v", 6))


# ---- sampling --------------------------------------------------------------------------------

_LAYERED = """
pl AS (SELECT i.*, CASE WHEN x BETWEEN 100 AND 350 AND z BETWEEN 60 AND 210 THEN 'detail' ELSE 'base' END AS layer FROM fx_instances i)
"""


def both_layers(spark, sf):
    detail = view(spark, sf, "fx_detail").select("map_id", F.lit("detail").alias("layer"), "px", "pz", "v")
    return (
        base_raster(spark, sf).unionByName(detail),
        view(spark, sf, "fx_layers").unionByName(view(spark, sf, "fx_detail_layers")),
    )


@query("sample_layers", f"""
WITH {_LAYERED}, s AS (SELECT *, CASE layer WHEN 'detail' THEN floor((x - 100) / 250 * 49 + 0.5) ELSE floor(x / 500 * 49 + 0.5) END AS px,
  CASE layer WHEN 'detail' THEN floor((z - 60) / 150 * 29 + 0.5) ELSE floor(z / 300 * 29 + 0.5) END AS pz FROM pl)
SELECT s.map_id, s.pool_idx, s.x, s.z, s.layer, CASE s.layer WHEN 'detail' THEN d.v ELSE CAST(r.h AS DOUBLE) END AS h
FROM s LEFT JOIN fx_raster r ON r.map_id = s.map_id AND r.px = s.px AND r.pz = s.pz LEFT JOIN fx_detail d ON d.map_id = s.map_id AND d.px = s.px AND d.pz = s.pz""")
def sample_layers(spark, sf):
    rasters, layers = both_layers(spark, sf)
    return sampling.sample_layers(view(spark, sf, "fx_instances"), rasters, layers).select("map_id", "pool_idx", "x", "z", "layer", "h")


@query("sample_tiles", f"""
WITH {_LAYERED}, s AS (SELECT *, CASE layer WHEN 'detail' THEN floor((x - 100) / 250 * 50) ELSE floor(x / 500 * 50) END AS px,
  CASE layer WHEN 'detail' THEN floor((z - 60) / 150 * 30) ELSE floor(z / 300 * 30) END AS pz FROM pl)
SELECT s.map_id, s.pool_idx, s.x, s.z, s.layer, CASE s.layer WHEN 'detail' THEN d.v ELSE CAST(r.h AS DOUBLE) END AS h
FROM s LEFT JOIN fx_raster r ON r.map_id = s.map_id AND r.px = least(s.px, 49) AND r.pz = least(s.pz, 29) LEFT JOIN fx_detail d ON d.map_id = s.map_id AND d.px = least(s.px, 49) AND d.pz = least(s.pz, 29)""")
def sample_tiles(spark, sf):
    rasters, layers = both_layers(spark, sf)
    tiles = raster.pack_tiles(rasters, layers, 16)
    return sampling.sample_tiles(view(spark, sf, "fx_instances"), tiles, layers, "cell", side=16).select("map_id", "pool_idx", "x", "z", "layer", "h")


@query("probe", """
WITH b AS (SELECT i.map_id, pool_idx, x, z, 'base' AS layer, CAST(least(floor(x / 500 * 50), 49) AS INT) AS px, CAST(least(floor(z / 300 * 30), 29) AS INT) AS pz FROM fx_instances i),
d AS (SELECT map_id, pool_idx, x, z, 'detail' AS layer, CASE WHEN x BETWEEN 100 AND 350 AND z BETWEEN 60 AND 210 THEN CAST(least(floor((x - 100) / 250 * 50), 49) AS INT) END AS px,
  CASE WHEN x BETWEEN 100 AND 350 AND z BETWEEN 60 AND 210 THEN CAST(least(floor((z - 60) / 150 * 30), 29) AS INT) END AS pz FROM fx_instances)
SELECT b.map_id, pool_idx, x, z, b.layer, b.px, b.pz, CAST(r.h AS DOUBLE) AS raw, round(v_min + r.h / 65535.0 * (v_max - v_min), 8) AS h
FROM b JOIN fx_layers l ON l.map_id = b.map_id LEFT JOIN fx_raster r ON r.map_id = b.map_id AND r.px = b.px AND r.pz = b.pz
UNION ALL SELECT d.map_id, pool_idx, x, z, d.layer, d.px, d.pz, r.v, round(v_min + r.v / 65535.0 * (v_max - v_min), 8)
FROM d JOIN fx_detail_layers l ON l.map_id = d.map_id LEFT JOIN fx_detail r ON r.map_id = d.map_id AND r.px = d.px AND r.pz = d.pz""")
def probe(spark, sf):
    rasters, layers = both_layers(spark, sf)
    p = sampling.probe(view(spark, sf, "fx_instances"), rasters, layers)
    return p.select("map_id", "pool_idx", "x", "z", "layer", "px", "pz", "raw", F.round("h", 8).alias("h"))


def _grids(spark, sf):
    return view(spark, sf, "fx_layers").select("map_id", F.lit(15).alias("cols"), F.lit(10).alias("rows"), "x0", "z0", "x1", "z1")


@query("point_lookup", """
SELECT i.map_id, pool_idx, x, z, c.cell, c.det0 FROM fx_instances i LEFT JOIN fx_cells c ON c.map_id = i.map_id
  AND c.tx = least(greatest(floor(x / (500.0 / 15)), 0), 14) AND c.tz = least(greatest(floor(z / (300.0 / 10)), 0), 9)
WHERE i.map_id IN (SELECT map_id FROM fx_layers)""")
def point_lookup(spark, sf):
    cells = view(spark, sf, "fx_cells").select("map_id", "tx", "tz", "cell", "det0")
    return sampling.point_lookup(view(spark, sf, "fx_instances"), cells, _grids(spark, sf)).select("map_id", "pool_idx", "x", "z", "cell", "det0")


@query("tile_highlight", """
WITH t AS (SELECT map_id, pool_idx, x, z, CAST(floor(x / (500.0 / 15)) AS INT) AS tx, CAST(floor(z / (300.0 / 10)) AS INT) AS tz FROM fx_instances)
SELECT map_id, pool_idx, x, z, tx, tz, round(tx * (500 / 15), 6) AS x0, round((tz + 1) * 30.0::DOUBLE, 6) AS z1, round((tx + 0.5) * (500 / 15), 6) AS cx, round((tz + 0.5) * 30.0::DOUBLE, 6) AS cz FROM t""")
def tile_highlight(spark, sf):
    t = sampling.tile_highlight(view(spark, sf, "fx_instances"), _grids(spark, sf))
    return t.select("map_id", "pool_idx", "x", "z", "tx", "tz", *[F.round(f"tile.{c}", 6).alias(c) for c in ("x0", "z1", "cx", "cz")])


@query("clearance", """
SELECT i.map_id, pool_idx, x, z, y, CAST(r.h AS DOUBLE) AS ground, CAST(greatest(0, 20 - (y - r.h)) AS DOUBLE) AS lift
FROM fx_instances i JOIN fx_raster r ON r.map_id = i.map_id AND r.px = floor(x / 500 * 49 + 0.5) AND r.pz = floor(z / 300 * 29 + 0.5)""")
def clearance(spark, sf):
    c = sampling.clearance(view(spark, sf, "fx_instances"), base_raster(spark, sf), view(spark, sf, "fx_layers"))
    return c.select("map_id", "pool_idx", "x", "z", "y", "ground", "lift")


# ---- line of sight ---------------------------------------------------------------------------

RAYS, STEP, RANGE = viewshed.RAYS, viewshed.STEP_M, viewshed.RANGE_M  # 360 rays, 4 m, 1,500 m
N_STEPS = int(RANGE // STEP)

_SIGHT = f"""
eyes AS (SELECT o.*, r.h + 5.0 AS eye FROM fx_observers o JOIN fx_raster r ON r.map_id = o.map_id AND r.px = floor(o.x / 500 * 49 + 0.5) AND r.pz = floor(o.z / 300 * 29 + 0.5)),
ra AS (SELECT *, unnest(generate_series(0, {RAYS - 1})) AS ray FROM eyes), st AS (SELECT *, unnest(generate_series(0, {N_STEPS - 1})) AS step FROM ra),
w AS (SELECT observer, map_id, ray, step, x AS ox, z AS oz, eye, (step + 1) * {STEP}::DOUBLE AS dist, cos(ray / {RAYS}.0::DOUBLE * 2 * pi()) AS dx, sin(ray / {RAYS}.0::DOUBLE * 2 * pi()) AS dz FROM st),
pos AS (SELECT *, ox + dx * dist AS x, oz + dz * dist AS z FROM w),
sam AS (SELECT p.*, CAST(coalesce(r.h, l.v_min) AS DOUBLE) AS h FROM pos p JOIN fx_layers l ON l.map_id = p.map_id LEFT JOIN fx_raster r ON r.map_id = p.map_id AND r.px = floor(p.x / 500 * 49 + 0.5) AND r.pz = floor(p.z / 300 * 29 + 0.5)),
sl AS (SELECT *, (h - eye) / dist AS slope FROM sam),
seen AS (SELECT *, coalesce(max(slope) OVER (PARTITION BY map_id, observer, ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e10) AS before FROM sl)
"""


@query("viewshed", f"""
WITH {_SIGHT} SELECT map_id, observer, count(*) AS steps, count(*) FILTER (slope >= before) AS visible, CAST(sum(CASE WHEN slope >= before THEN ray * step ELSE 0 END) AS BIGINT) AS mark FROM seen GROUP BY map_id, observer""")
def viewshed_terrain(spark, sf):
    lines = viewshed.sight(view(spark, sf, "fx_observers"), base_raster(spark, sf), view(spark, sf, "fx_layers"), RAYS, RANGE, STEP, values=("seen",))
    return viewshed.ray_counts(lines).groupBy("map_id", "observer").agg(
        F.sum("steps").alias("steps"), F.sum("visible").alias("visible"), F.sum(F.col("ray") * F.col("mark")).alias("mark"),
    )


@query("running_max_slope", f"WITH {_SIGHT} SELECT map_id, observer, ray, step, round(before, 6) AS max_before FROM seen")
def running_max_slope(spark, sf):
    """The largest slope before a step changes seldom: stretches of steps that share it are rounded once and become rows in the result."""
    lines = viewshed.sight(view(spark, sf, "fx_observers"), base_raster(spark, sf), view(spark, sf, "fx_layers"), RAYS, RANGE, STEP, values=("records",))
    records = lines.select("map_id", "observer", "ray", F.explode("records").alias("_r")).select("map_id", "observer", "ray", "_r", F.round("_r.before", 6).alias("max_before"))
    return records.select("map_id", "observer", "ray", F.explode(F.sequence("_r.step", "_r.upto")).alias("step"), "max_before")


@query("sticky_block", """
SELECT map_id, px, pz, max(CASE WHEN h > 480 THEN 1 ELSE 0 END) OVER (PARTITION BY map_id, pz ORDER BY px) = 1 AS hidden FROM fx_raster""")
def sticky_block(spark, sf):
    r = view(spark, sf, "fx_raster").withColumn("blocked", F.col("h") > 480)
    return scans.sticky_block(r, ("map_id", "pz"), "px").select("map_id", "px", "pz", "hidden")


_BLOCKED = f"""
{OBJECTS_SQL}, {OCC_SQL.format(n='4096')}, {OCC_TAIL}, {_SIGHT},
sub AS (SELECT s.*, unnest(generate_series(0, CAST(least(greatest(ceil({STEP} / greatest(0.5, cell)), 1), 8) AS INT) - 1)) AS c, least(greatest(ceil({STEP} / greatest(0.5, cell)), 1), 8) AS n, x0 AS gx0, z0 AS gz0, cell
  FROM seen s JOIN gd ON gd.map_id = s.map_id WHERE slope >= before),
tt AS (SELECT *, (dist - {STEP}) + {STEP} * ((c + 0.5) / n) AS t FROM sub),
hit AS (SELECT tt.map_id, tt.observer, tt.ray, min(step) AS hidden_from FROM tt JOIN occ ON occ.map_id = tt.map_id AND occ.gx = floor((ox + dx * t - gx0) / cell) AND occ.gz = floor((oz + dz * t - gz0) / cell)
  WHERE top > 0 AND top > eye + before * t GROUP BY ALL),
los AS (SELECT s.*, s.slope >= s.before AND (hidden_from IS NULL OR step < hidden_from) AS visible FROM seen s LEFT JOIN hit USING (map_id, observer, ray))
"""


def blocked_lines(spark, sf, placed=None):
    """Lines of sight over the terrain, and the steps from which objects hide them."""
    occ, grids = obj.build_occupancy(objects(spark, sf) if placed is None else placed, packed=True)
    lines = viewshed.sight(view(spark, sf, "fx_observers"), base_raster(spark, sf), view(spark, sf, "fx_layers"), RAYS, RANGE, STEP, values=None).cut()
    return lines, viewshed.blocked_from(lines, occ, grids)


def _marked(lines, hits):
    return viewshed.ray_counts(lines, hits).groupBy("map_id", "observer").agg(
        F.sum("visible").alias("visible"), F.sum(F.col("ray") * F.col("mark")).alias("mark"))


@query("viewshed_objects", f"""
WITH {_BLOCKED} SELECT map_id, observer, count(*) FILTER (visible) AS visible, CAST(sum(CASE WHEN visible THEN ray * step ELSE 0 END) AS BIGINT) AS mark FROM los GROUP BY map_id, observer""")
def viewshed_objects(spark, sf):
    return _marked(*blocked_lines(spark, sf))


_REPAIRED = """
WITH fx_ground AS (SELECT i.map_id, i.pool_idx, i.x, i.z, CASE WHEN i.y IS NULL OR abs(i.y - r.h) > 120 THEN r.h ELSE i.y END AS y
  FROM fx_instances i JOIN fx_raster r ON r.map_id = i.map_id AND r.px = least(greatest(floor(i.x / 500 * 50), 0), 49) AND r.pz = least(greatest(floor(i.z / 300 * 30), 0), 29)), """


@query("viewshed_repaired", _REPAIRED + _BLOCKED.replace("FROM fx_instances i LEFT JOIN pc", "FROM fx_ground i LEFT JOIN pc").strip() + """
SELECT map_id, observer, count(*) FILTER (visible) AS visible, CAST(sum(CASE WHEN visible THEN ray * step ELSE 0 END) AS BIGINT) AS mark FROM los GROUP BY map_id, observer""")
def viewshed_repaired(spark, sf):
    """Object heights are repaired from the ground, become an occupancy grid, and hide what is behind them."""
    layers = view(spark, sf, "fx_layers")
    grounded = sampling.instances_with_ground(view(spark, sf, "fx_instances"), base_raster(spark, sf), layers).select("map_id", "pool_idx", "x", "y", "z")
    return _marked(*blocked_lines(spark, sf, obj.instances_with_pool(grounded, obj.styled_pools(pools(spark, sf)))))


@query("viewshed_packed", f"""
WITH {_SIGHT} SELECT map_id, observer, ray, count(*) FILTER (slope >= before) AS visible FROM seen GROUP BY ALL""")
def viewshed_packed(spark, sf):
    tiles = raster.pack_tiles(base_raster(spark, sf), view(spark, sf, "fx_layers"))
    lines = viewshed.sight(view(spark, sf, "fx_observers"), tiles, view(spark, sf, "fx_layers"), RAYS, RANGE, STEP, packed=True, values=("seen",))
    return viewshed.ray_counts(lines).select("map_id", "observer", "ray", "visible")


@query("viewshed_area", f"""
WITH {_BLOCKED}, los_edge AS (SELECT map_id, observer, ray, step, h, visible, lead(h) OVER q AS h_out, lead(visible) OVER q AS v_out FROM los WINDOW q AS (PARTITION BY map_id, observer, ray ORDER BY step)),
los_pair AS (SELECT a.*, b.h AS h2, b.visible AS v2, b.h_out AS h2_out, b.v_out AS v2_out FROM los_edge a JOIN los_edge b ON a.map_id = b.map_id AND a.observer = b.observer AND a.step = b.step AND b.ray = (a.ray + 1) % {RAYS})
SELECT map_id, observer, count(*) FILTER (step = 0 AND visible AND v2) AS caps, count(*) FILTER (v_out AND v2_out) AS visible_patches,
  count(*) FILTER (v_out IS NOT NULL AND NOT (v_out AND v2_out) AND least(h, h_out, h2, h2_out) > 40.25) AS hidden_patches FROM los_pair GROUP BY map_id, observer""")
def viewshed_area(spark, sf):
    return viewshed.area_of_lines(*blocked_lines(spark, sf), water=40.0)
