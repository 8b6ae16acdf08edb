"""Queries over colour rasters, water and flooding."""

from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import catalog, flood, raster, terrain
from .base import query, table, view
from .q_names import cells_with_det

# ---- flooding --------------------------------------------------------------------------------

_FLOOD = """
f(map_id, px, pz) AS (SELECT map_id, px, pz FROM fx_raster WHERE wet AND (px IN (0, 49) OR pz IN (0, 29))
  UNION SELECT r.map_id, r.px, r.pz FROM f JOIN fx_raster r ON r.map_id = f.map_id AND r.wet AND abs(r.px - f.px) + abs(r.pz - f.pz) = 1)
"""


def wet_cells(spark, sf):
    return view(spark, sf, "fx_raster").filter("wet").select("map_id", "px", "pz")


@query("flood_from_border", f"WITH RECURSIVE {_FLOOD} SELECT map_id, px, pz FROM f")
def flood_from_border(spark, sf):
    return flood.flood_from_border(wet_cells(spark, sf), view(spark, sf, "fx_layers"), tile=8)


_CELLS = """
ratio AS (SELECT map_id, CAST(px // 10 AS INT) AS tx, CAST(pz // 6 AS INT) AS tz, avg(CAST(wet AS INT)) AS ratio FROM fx_raster GROUP BY ALL)
"""


@query("cell_water_ratio", f"WITH {_CELLS} SELECT map_id, tx, tz, round(ratio, 8) AS ratio, ratio >= 0.7 AS override FROM ratio")
def cell_water_ratio(spark, sf):
    return flood.cell_water_ratio(view(spark, sf, "fx_raster"), 10, 6, share=0.7).withColumn("ratio", F.round("ratio", 8))


@query("union_mask", f"""
WITH {_CELLS} SELECT map_id, px, pz FROM fx_raster WHERE wet AND (px IN (0, 49) OR pz IN (0, 29))
UNION SELECT r.map_id, px, pz FROM fx_raster r JOIN ratio q ON q.map_id = r.map_id AND q.tx = px // 10 AND q.tz = pz // 6 WHERE wet AND ratio >= 0.7""")
def union_mask(spark, sf):
    edge = wet_cells(spark, sf).filter("px in (0, 49) or pz in (0, 29)")
    over = flood.cell_water_ratio(view(spark, sf, "fx_raster"), 10, 6, share=0.7)
    return flood.union_mask(edge, wet_cells(spark, sf), over, 10, 6)


@query("water_mask", f"""
WITH RECURSIVE {_FLOOD}, {_CELLS}, m AS (SELECT map_id, px, pz FROM f UNION SELECT r.map_id, px, pz FROM fx_raster r JOIN ratio q ON q.map_id = r.map_id AND q.tx = px // 10 AND q.tz = pz // 6 WHERE wet AND ratio >= 0.08),
p AS (SELECT map_id, cell, tx, tz FROM fx_cells WHERE populated AND tx < 5 AND tz < 5)
SELECT m.map_id, m.px, m.pz FROM m LEFT JOIN p ON p.map_id = m.map_id AND p.tx = m.px // 10 AND p.tz = m.pz // 6 LEFT JOIN ratio q ON q.map_id = m.map_id AND q.tx = m.px // 10 AND q.tz = m.pz // 6
WHERE p.map_id IS NULL OR q.ratio >= 0.08""")
def water_mask(spark, sf):
    cells = view(spark, sf, "fx_cells").select("map_id", "tx", "tz", F.col("populated").alias("protected"))
    pixels = view(spark, sf, "fx_raster").select("map_id", "px", "pz", "wet")
    return flood.water_mask(pixels, view(spark, sf, "fx_layers"), cells, 10, 6, flood_tile=8)


@query("water_mask_open", f"""
WITH RECURSIVE w AS (SELECT map_id, px, pz, wet AND h BETWEEN 100 AND 100 + map_id % 7 * 3 AS wet2 FROM fx_raster),
f2(map_id, px, pz) AS (SELECT map_id, px, pz FROM w WHERE wet2 AND (px IN (0, 49) OR pz IN (0, 29))
  UNION SELECT r.map_id, r.px, r.pz FROM f2 JOIN w r ON r.map_id = f2.map_id AND r.wet2 AND abs(r.px - f2.px) + abs(r.pz - f2.pz) = 1),
s AS (SELECT map_id, avg(CAST(wet2 AS INT)) AS share FROM w GROUP BY map_id)
SELECT * FROM f2 UNION ALL SELECT w.map_id, px, pz FROM w JOIN s USING (map_id) WHERE wet2 AND share < 0.05 AND map_id NOT IN (SELECT map_id FROM f2)""")
def water_mask_open(spark, sf):
    pixels = view(spark, sf, "fx_raster").select(
        "map_id", "px", "pz", (F.col("wet") & F.col("h").between(F.lit(100), 100 + F.col("map_id") % 7 * 3)).alias("wet")
    )
    return flood.water_mask(pixels, view(spark, sf, "fx_layers"), flood_tile=16)


@query("water_candidates", """
SELECT r.map_id, px, pz FROM fx_raster r JOIN fx_layers l ON l.map_id = r.map_id WHERE v_max > v_min AND v_min <= 150 AND h <= 150 - (v_max - v_min) / 255""")
def water_candidates(spark, sf):
    r = view(spark, sf, "fx_raster").select("map_id", "px", "pz", F.col("h").alias("v"))
    layers = view(spark, sf, "fx_layers")
    return flood.water_candidates(r, layers, layers.select("map_id", F.lit(150.0).alias("water_level")))


# ---- light, seams, tint ----------------------------------------------------------------------


@query("hillshade", """
WITH n AS (SELECT map_id, px, pz, CAST((r * 3 + g) % 256 AS INT) AS nr, CAST((g * 5 + b) % 256 AS INT) AS ng, CAST((b * 7 + r) % 256 AS INT) AS nb FROM fx_rgb),
v AS (SELECT c.*, -(nr / 255.0::DOUBLE * 2 - 1) AS x, -(ng / 255.0::DOUBLE * 2 - 1) AS y, nb / 255.0::DOUBLE * 2 - 1 AS z FROM fx_rgb c JOIN n USING (map_id, px, pz)),
s AS (SELECT *, 0.5::DOUBLE + 0.5::DOUBLE * least(greatest((x * cos(radians(50)) * sin(radians(30)) + y * cos(radians(50)) * cos(radians(30)) + z * sin(radians(50))) / greatest(sqrt(x * x + y * y + z * z), 1e-6), 0), 1) AS s FROM v)
SELECT map_id, px, pz, CAST(trunc(least(r * s, 255)) AS INT) AS r, CAST(trunc(least(g * s, 255)) AS INT) AS g, CAST(trunc(least(b * s, 255)) AS INT) AS b FROM s""")
def hillshade(spark, sf):
    rgb = view(spark, sf, "fx_rgb").drop("a")
    n = view(spark, sf, "fx_rgb").select(
        "map_id", "px", "pz", ((F.col("r") * 3 + F.col("g")) % 256).alias("nr"), ((F.col("g") * 5 + F.col("b")) % 256).alias("ng"), ((F.col("b") * 7 + F.col("r")) % 256).alias("nb")
    )
    return terrain.hillshade(rgb, n).select("map_id", "px", "pz", "r", "g", "b")


# tiles of 10 x 9 pixels with a border of 3
_BAND = """
s AS (SELECT *, (px >= 10 AND px % 10 <= {d}) OR ((px // 10 + 1) * 10 < 50 AND 10 - px % 10 <= {d}) OR (pz >= 9 AND pz % 9 <= {d}) OR ((pz // 9 + 1) * 9 < 30 AND 9 - pz % 9 <= {d}) AS band,
  least(px % 10, 10 - px % 10, pz % 9, 9 - pz % 9) AS d FROM fx_rgb)
"""


@query("seam_cells", f"WITH {_BAND.format(d=2)} SELECT map_id, px, pz FROM s WHERE band")
def seam_cells(spark, sf):
    return terrain.seam_cells(view(spark, sf, "fx_rgb").select("map_id", "px", "pz"), view(spark, sf, "fx_layers"), 10, 9, 2)


@query("feather_seams", f"""
WITH {_BAND.format(d=2)}, m AS (SELECT a.map_id, a.px, a.pz, sum(b.r) // count(*) AS mr, sum(b.g) // count(*) AS mg, sum(b.b) // count(*) AS mb
  FROM s a JOIN fx_rgb b ON a.map_id = b.map_id AND abs(a.px - b.px) <= 3 AND abs(a.pz - b.pz) <= 3 WHERE a.band AND a.d < 3 GROUP BY ALL)
SELECT s.map_id, s.px, s.pz, CASE WHEN mr IS NULL THEN r ELSE CAST(round(r + (mr - r) * sqrt(1 - d / 3.0::DOUBLE)) AS INT) END AS r,
  CASE WHEN mr IS NULL THEN g ELSE CAST(round(g + (mg - g) * sqrt(1 - d / 3.0::DOUBLE)) AS INT) END AS g, CASE WHEN mr IS NULL THEN b ELSE CAST(round(b + (mb - b) * sqrt(1 - d / 3.0::DOUBLE)) AS INT) END AS b
FROM s LEFT JOIN m USING (map_id, px, pz)""")
def feather_seams(spark, sf):
    rgb = view(spark, sf, "fx_rgb").select("map_id", "px", "pz", "r", "g", "b")
    return terrain.feather_seams(rgb, view(spark, sf, "fx_layers"), 10, 9, 3)


@query("tint_water", """
SELECT map_id, px, pz, CASE WHEN b > 128 THEN CAST((r * 30 + 13 * 70) // 100 AS INT) ELSE r END AS r, CASE WHEN b > 128 THEN CAST((g * 30 + 79 * 70) // 100 AS INT) ELSE g END AS g,
  CASE WHEN b > 128 THEN CAST((b * 30 + 139 * 70) // 100 AS INT) ELSE b END AS b FROM fx_rgb""")
def tint_water(spark, sf):
    rgb = view(spark, sf, "fx_rgb").select("map_id", "px", "pz", "r", "g", "b")
    return terrain.tint_water(rgb, rgb.filter("b > 128"))


@query("tint_water_tactical", """
SELECT map_id, px, pz, CASE WHEN b > 128 THEN CAST(round(r * 0.55::DOUBLE + 18 * 0.45::DOUBLE) AS INT) ELSE r END AS r,
  CASE WHEN b > 128 THEN CAST(round(g * 0.55::DOUBLE + 86 * 0.45::DOUBLE) AS INT) ELSE g END AS g, CASE WHEN b > 128 THEN CAST(round(b * 0.55::DOUBLE + 145 * 0.45::DOUBLE) AS INT) ELSE b END AS b FROM fx_rgb""")
def tint_water_tactical(spark, sf):
    rgb = view(spark, sf, "fx_rgb").select("map_id", "px", "pz", "r", "g", "b")
    return terrain.tint_water(rgb, rgb.filter("b > 128"), terrain.MAP_WATER_COLOR, 0.45, "nearest").select("map_id", "px", "pz", "r", "g", "b")


# grey picture, blurred in rows and columns with a cut-off at three sigma
@query("pseudo_height", """
WITH g AS (SELECT map_id, px, pz, (r * 2126 + g * 7152 + b * 722) // 10000 AS v FROM fx_rgb),
x AS (SELECT a.map_id, a.px, a.pz, sum(b.v * exp(-((a.px - b.px) ^ 2) / 8.0)) / sum(exp(-((a.px - b.px) ^ 2) / 8.0)) AS v FROM g a JOIN g b ON a.map_id = b.map_id AND a.pz = b.pz AND abs(a.px - b.px) <= 6 GROUP BY ALL),
z AS (SELECT a.map_id, a.px, a.pz, sum(b.v * exp(-((a.pz - b.pz) ^ 2) / 8.0)) / sum(exp(-((a.pz - b.pz) ^ 2) / 8.0)) AS v FROM x a JOIN x b ON a.map_id = b.map_id AND a.px = b.px AND abs(a.pz - b.pz) <= 6 GROUP BY ALL)
SELECT map_id, px, pz, round(v) AS v, true AS pseudo FROM z""")
def pseudo_height(spark, sf):
    return terrain.pseudo_height(view(spark, sf, "fx_rgb"), sigma=2.0).select("map_id", "px", "pz", "v", "pseudo")


# ---- mosaics and painting --------------------------------------------------------------------

# 150 tiles of 5 x 2 pixels per level; every other tile is one cell off
_TILE_PX = """
SELECT map_id, CAST(1 + FLOOR((pz * 50 + px) / 10) AS INT) AS tile, CAST(px % 5 AS INT) AS x, CAST(FLOOR(((pz * 50 + px) % 10) / 5) AS INT) AS y, r, g, b, a FROM {rgb}"""
_TILE_PX_SQL = _TILE_PX.format(rgb="fx_rgb")


def tile_pixels(spark, sf):
    return spark.sql(_TILE_PX, rgb=view(spark, sf, "fx_rgb"))


@query("mosaic", f"""
WITH t AS ({_TILE_PX_SQL}), c AS (SELECT *, tile - 1 + tile % 2 * 15 AS cell FROM t),
p AS (SELECT map_id, tile, CAST(cell % 15 * 5 + x AS INT) AS px, CAST(cell // 15 * 2 + y AS INT) AS pz, r, g, b FROM c WHERE cell // 15 < 10),
top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY map_id, px, pz ORDER BY tile DESC) = 1),
w AS (SELECT map_id, unnest(generate_series(0, 74)) AS px FROM fx_layers), canvas AS (SELECT map_id, CAST(px AS INT) AS px, CAST(unnest(generate_series(0, 19)) AS INT) AS pz FROM w)
SELECT map_id, px, pz, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM canvas LEFT JOIN top USING (map_id, px, pz)""")
def mosaic(spark, sf):
    t = tile_pixels(spark, sf)
    mapping = t.select("map_id", "tile").distinct().withColumn("cell", F.col("tile") - 1 + F.col("tile") % 2 * 15)
    grids = view(spark, sf, "fx_layers").select("map_id", F.lit(15).alias("cols"), F.lit(10).alias("rows"))
    return terrain.mosaic(t, mapping, grids, 5, 2)


_MATERIALS = """
SELECT map_id, lc_idx, name, CASE WHEN lc_idx % 9 = 4 THEN NULL ELSE 'tex_' || CAST(lc_idx % 200 AS STRING) END AS texture, CAST(8 + lc_idx % 17 AS DOUBLE) AS scale_x, CAST(8 + lc_idx % 23 AS DOUBLE) AS scale_y,
  CASE WHEN lc_idx % 2 = 1 THEN 'tex_' || CAST(lc_idx + 3 + CASE WHEN lc_idx % 6 = 1 THEN 1000000 ELSE 0 END AS STRING) END AS t_r, CASE WHEN lc_idx % 4 = 1 THEN 'tex_' || CAST(lc_idx + 5 AS STRING) END AS t_k, CAST(1 + lc_idx % 5 AS DOUBLE) AS d_scale, texture AS authored
FROM {lcs}"""
_TEXTURES = """
SELECT 'tex_' || CAST(vec_id AS STRING) AS texture, CAST(i % 8 AS INT) AS sx, CAST(FLOOR(i / 8) AS INT) AS sy,
  CAST(FLOOR((CAST(e AS DOUBLE) + 1) * 127) AS INT) AS r, CAST(FLOOR((CAST(e AS DOUBLE) + 1) * 90) AS INT) AS g, CAST(FLOOR((CAST(e AS DOUBLE) + 1) * 60) AS INT) AS b
FROM {texels}"""
_TEXTURES_SQL = _TEXTURES.format(texels="(SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
_MATERIALS_SQL = _MATERIALS.format(lcs="fx_lcs")


def materials(spark, sf):
    m = spark.sql(_MATERIALS, lcs=view(spark, sf, "fx_lcs"))
    none = F.lit(None).cast("string")
    return m.withColumn("ocean", names.is_ocean_lc("name")).withColumn(
        "detail_textures", F.array("t_r", none, none, "t_k")
    ).withColumn("detail_scales", F.array(*["d_scale"] * 4))


def textures(spark, sf):
    raw = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    t = spark.sql(_TEXTURES, texels=raw)
    return t, t.groupBy("texture").agg((F.max("sx") + 1).alias("tw"), (F.max("sy") + 1).alias("th"))


@query("sample_tiled_texture", f"""
WITH t AS ({_TEXTURES_SQL}), m AS ({_MATERIALS_SQL}), p AS (SELECT map_id, px, pz, CAST((px + pz * 3) % 200 AS INT) AS lc_idx FROM fx_raster),
q AS (SELECT p.*, m.texture, CAST(trunc(px / scale_x * 8) AS INT) % 8 AS sx, CAST(trunc(pz / scale_y * 8) AS INT) % 8 AS sy FROM p JOIN m USING (map_id, lc_idx))
SELECT q.map_id, px, pz, t.r, t.g, t.b FROM q LEFT JOIN t ON t.texture = q.texture AND t.sx = q.sx AND t.sy = q.sy""")
def sample_tiled_texture(spark, sf):
    p = view(spark, sf, "fx_raster").select("map_id", "px", "pz", ((F.col("px") + F.col("pz") * 3) % 200).alias("lc_idx"), F.col("px").alias("gx"), F.col("pz").alias("gy"))
    pts = p.join(materials(spark, sf).select("map_id", "lc_idx", "texture", "scale_x", "scale_y"), ["map_id", "lc_idx"])
    return terrain.sample_tiled_texture(pts, *textures(spark, sf)).select("map_id", "px", "pz", "r", "g", "b")


_SINGLE = f"""
m AS ({_MATERIALS_SQL}), si AS (SELECT map_id, cell, list_distinct(list_filter([det0, det1, det2, det3], lambda v: v < 200)) AS ids FROM fx_single),
single AS (SELECT si.map_id, cell, CASE WHEN len(ids) = 1 AND (m.t_r IS NOT NULL OR m.t_k IS NOT NULL) THEN ids[1] END AS single_lc FROM si LEFT JOIN m ON m.map_id = si.map_id AND m.lc_idx = ids[1])
"""
_SINGLE_CELLS = "fx_single AS (SELECT map_id, cell, tx, tz, det0, CASE WHEN cell % 3 = 0 THEN det0 ELSE det1 END AS det1, CASE WHEN cell % 3 = 0 THEN 255 ELSE det2 END AS det2, det3, det4, det5, det6, populated, has_tex2 FROM fx_cells)"


def single_cells(spark, sf):
    c = view(spark, sf, "fx_cells")
    c = c.withColumn("det1", F.when(F.col("cell") % 3 == 0, F.col("det0")).otherwise(F.col("det1")))
    c = c.withColumn("det2", F.when(F.col("cell") % 3 == 0, 255).otherwise(F.col("det2")))
    return c.withColumn("det", F.array(*[f"det{i}" for i in range(7)])).drop(*[f"det{i}" for i in range(7)])


@query("single_lc_detail_mix", f"WITH {_SINGLE_CELLS}, {_SINGLE} SELECT map_id, cell, CAST(single_lc AS INT) AS single_lc FROM single")
def single_lc_detail_mix(spark, sf):
    return terrain.single_lc_detail_mix(single_cells(spark, sf), materials(spark, sf)).select("map_id", "cell", "single_lc")


_M = "18446744073709551616::UHUGEINT"


def _noise_sql(chan: int) -> str:
    """Noise of one channel for a 64-bit seed column ``seed`` and pixel px, pz."""
    h0 = f"xor(xor(xor(xor(seed, (px::UBIGINT << 32)), pz::UBIGINT), {chan << 56}::UBIGINT), 11400714819323198485::UBIGINT)"
    h1 = f"(xor({h0}, {h0} >> 33))"
    h2 = f"((({h1})::UHUGEINT * 18397679294719823053::UHUGEINT) % {_M})::UBIGINT"
    h3 = f"(xor({h2}, {h2} >> 33))"
    h4 = f"((({h3})::UHUGEINT * 14181476777654086739::UHUGEINT) % {_M})::UBIGINT"
    return f"CAST(128 + trunc((CAST(xor({h4}, {h4} >> 33) % 256 AS INT) - 128) * 24 / 128.0) AS INT)"


_SEED = f"list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(string_split(coalesce(nullif(trim(mm.authored), ''), nullif(trim(mm.name), ''), 'lc'), ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_M})::UBIGINT"


@query("synth_tile", f"""
WITH t AS ({_TEXTURES_SQL}), m AS ({_MATERIALS_SQL}), x AS (SELECT map_id, tx, tz, det0, unnest(generate_series(0, 5)) AS x FROM fx_cells), y AS (SELECT *, unnest(generate_series(0, 3)) AS y FROM x),
p AS (SELECT map_id, det0, CAST(tx * 6 + x AS INT) AS px, CAST(tz * 4 + y AS INT) AS pz FROM y),
mm AS (SELECT p.*, m.lc_idx, m.texture, m.authored, m.name, CAST(trunc(px / scale_x * 8) AS INT) % 8 AS sx, CAST(trunc(pz / scale_y * 8) AS INT) % 8 AS sy FROM p LEFT JOIN m ON m.map_id = p.map_id AND m.lc_idx = p.det0),
q AS (SELECT mm.*, {_SEED} AS seed FROM mm)
SELECT q.map_id, px, pz, CASE WHEN lc_idx IS NULL THEN 20 ELSE coalesce(t.r, {_noise_sql(0)}) END AS r, CASE WHEN lc_idx IS NULL THEN 60 ELSE coalesce(t.g, {_noise_sql(1)}) END AS g,
  CASE WHEN lc_idx IS NULL THEN 120 ELSE coalesce(t.b, {_noise_sql(2)}) END AS b FROM q LEFT JOIN t ON t.texture = q.texture AND t.sx = q.sx AND t.sy = q.sy""")
def synth_tile(spark, sf):
    return terrain.synth_tile(cells_with_det(spark, sf), materials(spark, sf), *textures(spark, sf), 6, 4)


def _splat_sql(tw: int, th: int, cells: str = "TRUE") -> str:
    """Splat blending with tiles of tw x th pixels, of some terrain cells."""
    single = _SINGLE_CELLS[:-1] + f" WHERE {cells})"
    return f"""
WITH {single}, t AS ({_TEXTURES_SQL}), m AS (SELECT * REPLACE (CASE WHEN t_r IN (SELECT texture FROM t) THEN t_r END AS t_r, CASE WHEN t_k IN (SELECT texture FROM t) THEN t_k END AS t_k) FROM ({_MATERIALS_SQL})), oc AS (SELECT map_id, lc_idx FROM fx_lcs WHERE starts_with(lower(name), 'ocean') OR contains(lower(name), '_ocean')),
si AS (SELECT c.map_id, cell, list_distinct(list_filter([det0, CASE WHEN o1.lc_idx IS NOT NULL AND bo.lc_idx IS NULL THEN 255 ELSE det1 END, CASE WHEN o2.lc_idx IS NOT NULL AND bo.lc_idx IS NULL THEN 255 ELSE det2 END, det3], lambda v: v < 200)) AS ids
  FROM fx_single c LEFT JOIN oc bo ON bo.map_id = c.map_id AND bo.lc_idx = det0 LEFT JOIN oc o1 ON o1.map_id = c.map_id AND o1.lc_idx = det1 LEFT JOIN oc o2 ON o2.map_id = c.map_id AND o2.lc_idx = det2),
single AS (SELECT si.map_id, cell, CASE WHEN len(ids) = 1 AND (m.t_r IS NOT NULL OR m.t_k IS NOT NULL) THEN ids[1] END AS single_lc FROM si LEFT JOIN m ON m.map_id = si.map_id AND m.lc_idx = ids[1]),
sp AS ({_TILE_PX_SQL}), al AS (SELECT map_id, tile, min(a) < 255 AS alpha FROM sp GROUP BY ALL),
cx AS (SELECT c.*, s.single_lc, CASE WHEN populated THEN cell + 1 END AS idx, bo.lc_idx IS NOT NULL AS base_ocean FROM fx_single c LEFT JOIN single s USING (map_id, cell) LEFT JOIN oc bo ON bo.map_id = c.map_id AND bo.lc_idx = c.det0),
xx AS (SELECT *, unnest(generate_series(0, {tw} - 1)) AS x FROM cx), px AS (SELECT *, unnest(generate_series(0, {th} - 1)) AS y FROM xx),
w AS (SELECT p.*, CAST(tx * {tw} + p.x AS INT) AS px, CAST(tz * {th} + p.y AS INT) AS pz, s1.r AS r1, s1.g AS g1, CASE WHEN a1.alpha THEN s1.a ELSE 0 * s1.a END AS al1, s2.r AS r2, s2.g AS g2, CASE WHEN a2.alpha THEN s2.a ELSE 0 * s2.a END AS al2
  FROM px p LEFT JOIN sp s1 ON s1.map_id = p.map_id AND s1.tile = idx AND s1.x = least(CAST(trunc((p.x + 0.5) * 5 / {tw}) AS INT), 4) AND s1.y = least(CAST(trunc((p.y + 0.5) * 2 / {th}) AS INT), 1)
  LEFT JOIN al a1 ON a1.map_id = p.map_id AND a1.tile = idx
  LEFT JOIN sp s2 ON has_tex2 AND s2.map_id = p.map_id AND s2.tile = idx + 1 AND s2.x = least(CAST(trunc((p.x + 0.5) * 5 / {tw}) AS INT), 4) AND s2.y = least(CAST(trunc((p.y + 0.5) * 2 / {th}) AS INT), 1)
  LEFT JOIN al a2 ON has_tex2 AND a2.map_id = p.map_id AND a2.tile = idx + 1),
parts AS (SELECT map_id, px, pz, det0, single_lc, base_ocean, r1 IS NOT NULL AS tiled, unnest([0, 1, 2, 3, 4, 5, 6]) AS slot, unnest([det0, det1, det2, det3, det4, det5, det6]) AS lc,
  unnest([least(greatest(255 - r1 - g1 - al1, 0), 255), g1, r1, al1, g2, r2, al2]) AS weight FROM w),
ok AS (SELECT p.* FROM parts p LEFT JOIN oc ON oc.map_id = p.map_id AND oc.lc_idx = p.lc WHERE tiled AND weight > 0 AND lc < 200 AND (slot = 0 OR base_ocean OR oc.lc_idx IS NULL)),
base AS (SELECT DISTINCT map_id, px, pz, det0 FROM parts), fall AS (SELECT b.map_id, px, pz, det0 AS lc, 1 AS weight, -1 AS slot, NULL AS single_lc FROM base b ANTI JOIN ok USING (map_id, px, pz)),
pick AS (SELECT map_id, px, pz, weight, slot, CASE WHEN slot <= 3 THEN single_lc END AS mix, CASE WHEN slot <= 3 THEN coalesce(single_lc, lc) ELSE lc END AS lc_idx FROM ok
  UNION ALL SELECT map_id, px, pz, weight, slot, NULL, CASE WHEN lc < 200 THEN lc END FROM fall),
mm AS (SELECT k.*, m.name, m.authored, m.texture, m.scale_x, m.scale_y, CASE WHEN mix IS NOT NULL THEN CASE slot WHEN 0 THEN t_k WHEN 2 THEN t_r END END AS dt, d_scale FROM pick k LEFT JOIN m ON m.map_id = k.map_id AND m.lc_idx = k.lc_idx),
co AS (SELECT mm.*, t.r AS tr, t.g AS tg, t.b AS tb, {_SEED} AS seed FROM mm LEFT JOIN t ON t.texture = coalesce(dt, mm.texture)
  AND t.sx = CAST(trunc(px / CASE WHEN dt IS NULL THEN scale_x ELSE d_scale END * 8) AS INT) % 8 AND t.sy = CAST(trunc(pz / CASE WHEN dt IS NULL THEN scale_y ELSE d_scale END * 8) AS INT) % 8),
nn AS (SELECT *, lc_idx IS NOT NULL AND tr IS NULL AS noisy FROM co)
SELECT map_id, px, pz, CAST(coalesce(sum(CASE WHEN noisy THEN {_noise_sql(0)} ELSE tr END * weight) FILTER (lc_idx IS NOT NULL) // sum(weight) FILTER (lc_idx IS NOT NULL), 20) AS INT) AS r,
  CAST(coalesce(sum(CASE WHEN noisy THEN {_noise_sql(1)} ELSE tg END * weight) FILTER (lc_idx IS NOT NULL) // sum(weight) FILTER (lc_idx IS NOT NULL), 60) AS INT) AS g,
  CAST(coalesce(sum(CASE WHEN noisy THEN {_noise_sql(2)} ELSE tb END * weight) FILTER (lc_idx IS NOT NULL) // sum(weight) FILTER (lc_idx IS NOT NULL), 120) AS INT) AS b
FROM nn GROUP BY map_id, px, pz"""


@query("splat_blend", _splat_sql(6, 4))
def splat_blend(spark, sf):
    cells = single_cells(spark, sf).withColumn("export_idx", F.when(F.col("populated"), F.col("cell") + 1))
    splats = tile_pixels(spark, sf).select("map_id", "tile", F.col("x").alias("sx"), F.col("y").alias("sz"), "r", "g", "b", "a")
    return terrain.splat_blend(cells, splats, materials(spark, sf), *textures(spark, sf), 6, 4)


# a level of 5 x 5 terrain cells of 10 x 6 pixels: its canvas is as large as the height raster
_PAINTED = f"""
paint AS ({_splat_sql(10, 6, "tx < 5 AND tz < 5").strip()}),
band AS (SELECT *, (px >= 10 AND px % 10 <= 1) OR ((px // 10 + 1) * 10 < 50 AND 10 - px % 10 <= 1) OR (pz >= 6 AND pz % 6 <= 1) OR ((pz // 6 + 1) * 6 < 30 AND 6 - pz % 6 <= 1) AS band,
  least(px % 10, 10 - px % 10, pz % 6, 6 - pz % 6) AS d FROM paint),
mean AS (SELECT a.map_id, a.px, a.pz, sum(b.r) // count(*) AS mr, sum(b.g) // count(*) AS mg, sum(b.b) // count(*) AS mb
  FROM band a JOIN paint b ON a.map_id = b.map_id AND abs(a.px - b.px) <= 2 AND abs(a.pz - b.pz) <= 2 WHERE a.band AND a.d < 2 GROUP BY ALL),
soft AS (SELECT s.map_id, s.px, s.pz, CASE WHEN mr IS NULL THEN r ELSE CAST(round(r + (mr - r) * sqrt(1 - d / 2.0::DOUBLE)) AS INT) END AS r,
  CASE WHEN mr IS NULL THEN g ELSE CAST(round(g + (mg - g) * sqrt(1 - d / 2.0::DOUBLE)) AS INT) END AS g, CASE WHEN mr IS NULL THEN b ELSE CAST(round(b + (mb - b) * sqrt(1 - d / 2.0::DOUBLE)) AS INT) END AS b
  FROM band s LEFT JOIN mean m USING (map_id, px, pz)),
gr AS (SELECT map_id, px, pz, -(lead(h) OVER x - lag(h) OVER x) / 2.0 AS gx, -(lead(h) OVER z - lag(h) OVER z) / 2.0 AS gz FROM fx_raster
  WINDOW x AS (PARTITION BY map_id, pz ORDER BY px), z AS (PARTITION BY map_id, px ORDER BY pz)),
gm AS (SELECT *, sqrt(gx * gx + gz * gz + 1) AS m, px BETWEEN 1 AND 48 AND pz BETWEEN 1 AND 28 AS inner_cell FROM gr),
nm AS (SELECT map_id, px, pz, CASE WHEN inner_cell THEN CAST(trunc((gx / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS nr,
  CASE WHEN inner_cell THEN CAST(trunc((gz / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS ng, CASE WHEN inner_cell THEN CAST(trunc((1 / m * 0.5 + 0.5) * 255.0) AS INT) ELSE 0 END AS nb FROM gm),
fa AS (SELECT c.*, nr IS NULL AS dark, -(nr / 255.0::DOUBLE * 2 - 1) AS x, -(ng / 255.0::DOUBLE * 2 - 1) AS y, nb / 255.0::DOUBLE * 2 - 1 AS z FROM soft c LEFT JOIN nm USING (map_id, px, pz)),
sh AS (SELECT *, CASE WHEN dark THEN 1 ELSE 0.5::DOUBLE + 0.5::DOUBLE * least(greatest((x * cos(radians(50)) * sin(radians(30)) + y * cos(radians(50)) * cos(radians(30)) + z * sin(radians(50))) / greatest(sqrt(x * x + y * y + z * z), 1e-6), 0), 1) END AS s FROM fa),
lit AS (SELECT map_id, px, pz, CAST(trunc(least(r * s, 255)) AS INT) AS r, CAST(trunc(least(g * s, 255)) AS INT) AS g, CAST(trunc(least(b * s, 255)) AS INT) AS b FROM sh),
lo AS (SELECT l.map_id, l.px, l.pz, coalesce(v_max > v_min AND v_min <= 150 AND h <= 150 - (v_max - v_min) / 255, FALSE) AS wet
  FROM lit l LEFT JOIN fx_raster r ON r.map_id = l.map_id AND r.px = l.px AND r.pz = l.pz LEFT JOIN fx_layers y ON y.map_id = l.map_id),
fl(map_id, px, pz) AS (SELECT map_id, px, pz FROM lo WHERE wet AND (px IN (0, 49) OR pz IN (0, 29))
  UNION SELECT r.map_id, r.px, r.pz FROM fl f JOIN lo r ON r.map_id = f.map_id AND r.wet AND abs(r.px - f.px) + abs(r.pz - f.pz) = 1),
ra AS (SELECT map_id, CAST(px // 10 AS INT) AS tx, CAST(pz // 6 AS INT) AS tz, avg(CAST(wet AS INT)) AS ratio FROM lo GROUP BY ALL),
wm AS (SELECT map_id, px, pz FROM fl UNION SELECT r.map_id, px, pz FROM lo r JOIN ra q ON q.map_id = r.map_id AND q.tx = px // 10 AND q.tz = pz // 6 WHERE wet AND ratio >= 0.08),
dry AS (SELECT map_id, tx, tz FROM fx_cells WHERE tx < 5 AND tz < 5 AND (populated OR coalesce(det0, 255) <> 255)),
mk AS (SELECT m.map_id, m.px, m.pz FROM wm m LEFT JOIN dry p ON p.map_id = m.map_id AND p.tx = m.px // 10 AND p.tz = m.pz // 6
  LEFT JOIN ra q ON q.map_id = m.map_id AND q.tx = m.px // 10 AND q.tz = m.pz // 6 WHERE p.map_id IS NULL OR q.ratio >= 0.08)
"""


@query("painted_level", f"""
WITH RECURSIVE {_PAINTED.strip()}
SELECT l.map_id, l.px, l.pz, CASE WHEN k.map_id IS NOT NULL THEN CAST((r * 30 + 13 * 70) // 100 AS INT) ELSE r END AS r, CASE WHEN k.map_id IS NOT NULL THEN CAST((g * 30 + 79 * 70) // 100 AS INT) ELSE g END AS g,
  CASE WHEN k.map_id IS NOT NULL THEN CAST((b * 30 + 139 * 70) // 100 AS INT) ELSE b END AS b FROM lit l LEFT JOIN mk k USING (map_id, px, pz)""")
def painted_level(spark, sf):
    """Splats, seams, light and water of whole levels, one after the other."""
    cells = single_cells(spark, sf).filter("tx < 5 AND tz < 5").withColumn("export_idx", F.when(F.col("populated"), F.col("cell") + 1))
    splats = tile_pixels(spark, sf).select("map_id", "tile", F.col("x").alias("sx"), F.col("y").alias("sz"), "r", "g", "b", "a")
    heights = view(spark, sf, "fx_raster").select("map_id", "px", "pz", F.col("h").alias("v"))
    layers = view(spark, sf, "fx_layers")
    wet = flood.water_candidates(heights, layers, layers.select("map_id", F.lit(150.0).alias("water_level")))
    normals = raster.gradient_normals(heights, layers, 1.0, side=16)
    return terrain.painted_level(cells, splats, materials(spark, sf), *textures(spark, sf), normals, wet, 10, 6, border=2, flood_tile=8)
