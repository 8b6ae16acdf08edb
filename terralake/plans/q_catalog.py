"""Queries over landclasses, textures, tiles, indexes, byte ranges and build results."""

from pyspark.sql import functions as F

from ..functions import names
from ..operators import audit, catalog
from ..operators.scans import delta_decode, first_match, head_per_group
from ..session import scratch_path
from ..sources import readers, sinks
from .base import query, table, view
from .q_names import CANDIDATES_SQL, cells_with_det, details

# ---- ordered resolution ----------------------------------------------------------------------

_PATHS = ", ".join(f"replace(replace('{p}', '{{map}}', name), '{{suffix}}', suffix)" for p in names.PACK_CANDIDATES)


@query("first_existing", f"""
WITH m AS (SELECT name, CASE WHEN contains(name, '_') THEN substr(name, instr(name, '_') + 1) ELSE name END AS suffix FROM fx_maps),
c AS (SELECT name AS map_id, unnest([{_PATHS}]) AS path, generate_subscripts([{_PATHS}], 1) - 1 AS rank FROM m),
f AS (SELECT DISTINCT CASE CAST(id % 5 AS INT) WHEN 0 THEN 'content/' || name WHEN 1 THEN 'hq_content/hq_tex_avg_' || substr(name, instr(name, '_') + 1) WHEN 2 THEN 'levels/' || name || '-hq'
  WHEN 3 THEN 'hq_content/hq_tex_' || name ELSE 'elsewhere/' || name END || '.dxp.bin' AS path FROM fx_maps)
SELECT map_id, min(rank) AS rank, arg_min(path, rank) AS path FROM c SEMI JOIN f USING (path) GROUP BY map_id""")
def first_existing(spark, sf):
    m = view(spark, sf, "fx_maps")
    files = m.select(F.expr(
        "CASE CAST(id % 5 AS INT) WHEN 0 THEN 'content/' || name WHEN 1 THEN 'hq_content/hq_tex_avg_' || substr(name, instr(name, '_') + 1)"
        " WHEN 2 THEN 'levels/' || name || '-hq' WHEN 3 THEN 'hq_content/hq_tex_' || name ELSE 'elsewhere/' || name END || '.dxp.bin'"
    ).alias("path"))
    wanted = m.select(F.col("name").alias("map_id"), names.pack_candidates("name").alias("paths"))
    return catalog.first_existing(files, wanted)


@query("resolve_textures", f"""
WITH {CANDIDATES_SQL}, h AS (SELECT r.map_id, lc_idx, arg_min(candidate, rank) AS resolved, CAST(min(rank) AS INT) AS first_rank FROM first_rank r
  JOIN fx_store s ON s.map_id = r.map_id AND s.name = r.candidate GROUP BY ALL)
SELECT l.map_id, l.lc_idx, h.resolved FROM fx_lcs l LEFT JOIN h USING (map_id, lc_idx)""")
def resolve_textures(spark, sf):
    return catalog.resolve_textures(details(view(spark, sf, "fx_lcs")), view(spark, sf, "fx_store")).drop("rank")


_WANTED = CANDIDATES_SQL + ", w AS (SELECT DISTINCT map_id, candidate AS name FROM first_rank)"


@query("missing_names", f"WITH {_WANTED} SELECT * FROM w ANTI JOIN fx_store USING (map_id, name)")
def missing_names(spark, sf):
    wanted = catalog.wanted_names(details(view(spark, sf, "fx_lcs")))
    return catalog.missing_names(wanted, view(spark, sf, "fx_store"))


_INDEX = "ix AS (SELECT name, min((pack, entry_idx)) AS src FROM fx_entries2 GROUP BY name)"
_ENTRIES2 = """
fx_entries2 AS (SELECT 'pack_' || (p_partkey % 17) AS pack, CAST(p_partkey AS INT) AS entry_idx, CASE WHEN p_partkey % 2 = 0 THEN 'detail_' || lower(p_type) || '_tex_d' ELSE replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '_tex_d' ELSE '' END END AS name FROM part)
"""


def _packs(spark, sf):
    return table(spark, sf, "part").select(
        F.concat(F.lit("pack_"), (F.col("p_partkey") % 17).cast("string")).alias("pack"), F.col("p_partkey").cast("int").alias("entry_idx"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'detail_' || lower(p_type) || '_tex_d' ELSE replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '_tex_d' ELSE '' END END").alias("name"),
    )


@query("resolve_from_index", f"WITH {_WANTED}, {_ENTRIES2}, {_INDEX} SELECT map_id, name, src[1] AS pack, src[2] AS entry_idx FROM w JOIN ix USING (name)")
def resolve_from_index(spark, sf):
    wanted = catalog.wanted_names(details(view(spark, sf, "fx_lcs")))
    found, _ = catalog.resolve_from_index(wanted, catalog.build_texture_index(_packs(spark, sf)))
    return found.select("map_id", "name", "pack", "entry_idx")


@query("unresolved_names", f"WITH {_WANTED}, {_ENTRIES2} SELECT DISTINCT name FROM w ANTI JOIN fx_entries2 USING (name) ORDER BY name")
def unresolved_names(spark, sf):
    wanted = catalog.wanted_names(details(view(spark, sf, "fx_lcs")))
    return catalog.resolve_from_index(wanted, catalog.build_texture_index(_packs(spark, sf)))[1]


@query("build_texture_index", """
SELECT name, min(pack) AS pack, CAST(arg_min(entry_idx, (pack, entry_idx)) AS INT) AS entry_idx FROM fx_entries WHERE name <> '' GROUP BY name""")
def build_texture_index(spark, sf):
    return catalog.build_texture_index(view(spark, sf, "fx_entries"))


@query("dedupe_names", """
SELECT pack, entry_idx, CASE WHEN rn = 1 THEN name ELSE name || '_' || (rn - 1) END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY pack, name ORDER BY entry_idx) AS rn FROM fx_entries)""")
def dedupe_names(spark, sf):
    return catalog.dedupe_names(view(spark, sf, "fx_entries"), chunk=64).select("pack", "entry_idx", "unique_name")


@query("first_wins_across_packs", """
SELECT map_id, name, pack, pack_priority, entry_idx FROM fx_entries QUALIFY row_number() OVER (PARTITION BY map_id, name ORDER BY pack_priority, entry_idx) = 1""")
def first_wins_across_packs(spark, sf):
    return catalog.first_wins_across_packs(view(spark, sf, "fx_entries").select("map_id", "name", "pack", "pack_priority", "entry_idx"))


@query("first_match", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1""")
def first_match_query(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return first_match(o, ["o_custkey"], ["o_orderpriority", "o_orderkey"])


@query("head_per_group", """
SELECT file, "start", "end" FROM (SELECT DISTINCT file, "start", "end" FROM fx_spans) QUALIFY row_number() OVER (PARTITION BY file ORDER BY "start", "end") <= 10""")
def head_per_group_query(spark, sf):
    return head_per_group(view(spark, sf, "fx_spans").distinct(), ["file"], ["start", "end"], 10)


# ---- landclasses -----------------------------------------------------------------------------


@query("merge_landclasses", """
WITH f AS (SELECT map_id, name, min(ord) AS ord,
  coalesce(arg_min(texture, ord) FILTER (trim(texture) <> ''), (SELECT texture FROM fx_lcs q WHERE q.ord = min(l.ord))) AS texture,
  arg_min(d_r, ord) FILTER (d_r IS NOT NULL) AS r, arg_min(d_g, ord) FILTER (d_g IS NOT NULL) AS g, arg_min(d_b, ord) FILTER (d_b IS NOT NULL) AS b,
  arg_min(size_m, ord) FILTER (size_m IS NOT NULL) AS size_m, arg_min('own_' || ord, ord) FILTER (ord % 3 = 1) AS own FROM fx_lcs l GROUP BY map_id, name)
SELECT map_id, name, ord, texture, r, g, b, size_m, own, coalesce(detail_sizes, size_m) AS detail_size FROM (SELECT *, size_m AS detail_sizes FROM f)""")
def merge_landclasses(spark, sf):
    lcs = details(view(spark, sf, "fx_lcs")).withColumn("size", F.when(F.col("size_m").isNotNull(), F.array("size_m", "size_m")))
    own = F.when(F.col("ord") % 3 == 1, F.create_map(F.lit("own_key"), F.concat(F.lit("own_"), F.col("ord").cast("string"))))
    lcs = lcs.withColumn("details", F.map_concat(F.col("details"), F.coalesce(own, F.create_map().cast("map<string,string>"))))
    merged = catalog.merge_landclasses(lcs.withColumn("detail_sizes", F.col("size")))
    pick = {k: F.try_element_at("details", F.lit(k.upper())) for k in "rgb"}
    return merged.select("map_id", "name", "ord", "texture", *[v.alias(k) for k, v in pick.items()], F.get("size", F.lit(0)).alias("size_m"),
                         F.try_element_at("details", F.lit("own_key")).alias("own"), F.get("detail_sizes", F.lit(0)).alias("detail_size"))


@query("index_by_name", "SELECT map_id, name, max(lc_idx) AS lc_idx, (SELECT texture FROM fx_lcs q WHERE q.map_id = l.map_id AND q.name = l.name AND q.lc_idx = max(l.lc_idx)) AS t FROM fx_lcs l GROUP BY map_id, name")
def index_by_name(spark, sf):
    lcs = view(spark, sf, "fx_lcs").select("map_id", "lc_idx", "name", "texture")
    return catalog.index_by_name(lcs).select("map_id", "name", "lc_idx", F.col("texture").alias("t"))


_REFS = """
u AS (SELECT map_id, cell, tx, tz, unnest([det0, det1, det2, det3, det4, det5, det6]) AS lc_idx, unnest([0, 1, 2, 3, 4, 5, 6]) AS slot FROM fx_cells),
refs AS (SELECT * FROM u WHERE lc_idx <> 255)
"""


@query("cell_landclasses", f"""
WITH {_REFS} SELECT r.map_id, cell, ['Base', 'R', 'G', 'B', 'G2', 'R2', 'A2'][slot + 1] AS channel, r.lc_idx, name,
  array_to_string(list_filter([d_r, d_g, d_b], lambda s: s IS NOT NULL), '|') AS details
FROM refs r JOIN fx_lcs l ON l.map_id = r.map_id AND l.lc_idx = r.lc_idx""")
def cell_landclasses(spark, sf):
    found = catalog.cell_landclasses(cells_with_det(spark, sf), details(view(spark, sf, "fx_lcs")))
    return found.select("map_id", "cell", "channel", "lc_idx", "name", F.array_join("detail_names", "|").alias("details"))


@query("lc_reference_audit", f"""
WITH {CANDIDATES_SQL}, h AS (SELECT DISTINCT r.map_id, lc_idx FROM first_rank r JOIN fx_store s ON s.map_id = r.map_id AND s.name = r.candidate), {_REFS},
st AS (SELECT l.map_id, l.lc_idx, h.lc_idx IS NOT NULL AS ok, CASE WHEN trim(texture) <> '' THEN trim(texture) ELSE trim(name) END AS label FROM fx_lcs l LEFT JOIN h USING (map_id, lc_idx)),
lost AS (SELECT map_id, label, min(lc_idx) AS seen FROM st WHERE NOT ok GROUP BY ALL),
named AS (SELECT map_id, string_agg(label, '|' ORDER BY seen) AS missing_names FROM (SELECT * FROM lost QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY seen) <= 16) GROUP BY map_id),
n AS (SELECT map_id, count(*) AS ref_total, count(*) FILTER (lc_idx >= 200) AS ref_invalid FROM refs GROUP BY map_id),
t AS (SELECT map_id, count(*) FILTER (ok) AS resolved, count(*) FILTER (NOT ok) AS missing FROM st GROUP BY map_id)
SELECT map_id, coalesce(ref_total, 0) AS ref_total, coalesce(ref_invalid, 0) AS ref_invalid, coalesce(resolved, 0) AS resolved, coalesce(missing, 0) AS missing, missing_names
FROM n FULL JOIN t USING (map_id) LEFT JOIN named USING (map_id)""")
def lc_reference_audit(spark, sf):
    lcs = details(view(spark, sf, "fx_lcs"))
    resolved = catalog.resolve_textures(lcs, view(spark, sf, "fx_store"))
    out = catalog.lc_reference_audit(cells_with_det(spark, sf), lcs, resolved)
    return out.withColumn("missing_names", F.array_join("missing_names", "|"))


@query("extend_landclasses", f"""
WITH {_REFS}, x AS (SELECT map_id, max(lc_idx) AS top FROM refs GROUP BY map_id),
p AS (SELECT x.map_id, unnest(generate_series(200, top)) AS lc_idx FROM x WHERE top >= 200)
SELECT map_id, CAST(lc_idx AS INT) AS lc_idx, name, texture, false AS padded FROM fx_lcs
UNION ALL SELECT p.map_id, CAST(p.lc_idx AS INT), 'lc_' || p.lc_idx, l.texture, true FROM p LEFT JOIN fx_lcs l ON l.map_id = p.map_id AND l.lc_idx = 0""")
def extend_landclasses(spark, sf):
    lcs = view(spark, sf, "fx_lcs").withColumn("size", F.when(F.col("size_m").isNotNull(), F.array("size_m", "size_m"))).select("map_id", "lc_idx", "name", "texture", "size")
    return catalog.extend_landclasses(lcs, cells_with_det(spark, sf)).select("map_id", "lc_idx", "name", "texture", "padded")


# ---- tiles -----------------------------------------------------------------------------------

EXPORT_SQL = """
ex AS (SELECT *, CASE WHEN populated THEN CAST(1 + coalesce(sum(CASE WHEN populated THEN CASE WHEN has_tex2 THEN 2 ELSE 1 END ELSE 0 END)
  OVER (PARTITION BY map_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) END AS export_idx FROM fx_cells)
"""


@query("assign_export_index", f"WITH {EXPORT_SQL} SELECT map_id, cell, export_idx FROM ex")
def assign_export_index(spark, sf):
    return catalog.assign_export_index(view(spark, sf, "fx_cells"), chunk=32).select("map_id", "cell", "export_idx")


_TILES = "SELECT CAST(FLOOR(o_orderkey / 1500) AS BIGINT) AS map_id, CAST(o_orderkey % 1500 AS INT) AS tile FROM {orders}"


def tile_mapping(spark, sf, strict):
    tiles = spark.sql(_TILES, orders=table(spark, sf, "orders"))
    cells = catalog.assign_export_index(view(spark, sf, "fx_cells"), chunk=32)
    grids = view(spark, sf, "fx_layers").select("map_id", F.lit(15).alias("cols"), F.lit(10).alias("rows"))
    return catalog.tile_mapping(tiles, cells, grids, strict)


_MAPPED = f"""
WITH {EXPORT_SQL}, t AS ({_TILES.format(orders='orders')}),
j AS (SELECT t.map_id, t.tile, coalesce(ex.cell, t.tile - 1) AS cell, ex.cell IS NOT NULL AS claimed FROM t LEFT JOIN ex ON ex.map_id = t.map_id AND ex.export_idx = t.tile WHERE t.tile <> 0)
SELECT map_id, tile, CAST(cell AS INT) AS cell, CAST(cell % 15 AS INT) AS tx, CAST(cell // 15 AS INT) AS tz FROM j WHERE cell // 15 < 10"""


@query("tile_mapping", _MAPPED + " AND claimed")
def tile_mapping_strict(spark, sf):
    return tile_mapping(spark, sf, True)


@query("tile_mapping_lax", _MAPPED)
def tile_mapping_lax(spark, sf):
    return tile_mapping(spark, sf, False)


@query("protected_cells", f"WITH {EXPORT_SQL} SELECT map_id, cell, export_idx IS NOT NULL OR det0 <> 255 AS protected FROM ex")
def protected_cells(spark, sf):
    cells = catalog.assign_export_index(cells_with_det(spark, sf))
    return catalog.protected_cells(cells).select("map_id", "cell", "protected")


@query("tile_fill_audit", """
SELECT map_id, count(*) AS cells, count(*) FILTER (populated) AS populated, avg(CAST(populated AS INT)) >= 0.9 AS accepted FROM fx_cells GROUP BY map_id""")
def tile_fill_audit(spark, sf):
    return catalog.tile_fill_audit(view(spark, sf, "fx_cells"), 0.9)


@query("order_tiles", f"WITH t AS ({_TILES.format(orders='orders')}) SELECT * FROM t ORDER BY map_id, tile")
def order_tiles(spark, sf):
    return catalog.order_tiles(spark.sql(_TILES, orders=table(spark, sf, "orders")))


@query("order_landclasses", "SELECT map_id, name, lc_idx FROM fx_lcs ORDER BY map_id, name")
def order_landclasses(spark, sf):
    return catalog.order_landclasses(view(spark, sf, "fx_lcs").select("map_id", "name", "lc_idx"))


# ---- textures --------------------------------------------------------------------------------

# one texture of 64 texels per vector; every third looks like a packed normal map
_TEXELS = """
SELECT vec_id, CAST(FLOOR(vec_id / 50) AS BIGINT) AS map_id, i,
  CASE WHEN vec_id % 3 = 0 THEN CAST(FLOOR((CAST(e AS DOUBLE) + 1) * 5) AS INT) ELSE CAST(FLOOR((CAST(e AS DOUBLE) + 1) * 127) AS INT) END AS r,
  CASE WHEN vec_id % 3 = 0 THEN CAST(FLOOR(225 + (CAST(e AS DOUBLE) + 1) * 10) AS INT) ELSE CAST(FLOOR((CAST(e AS DOUBLE) + 1) * 90) AS INT) END AS b,
  CAST(FLOOR((CAST(e AS DOUBLE) + 1) * 100) AS INT) AS a
FROM {texels}"""
_TEXELS_SQL = _TEXELS.format(texels="(SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
_STATS = f"st AS (SELECT map_id, map_id || '_' || vec_id AS name, avg(r) AS r_mean, avg(b) AS b_mean, stddev_pop(a) AS a_std FROM ({_TEXELS_SQL}) GROUP BY ALL)"


def texel_stats(spark, sf):
    raw = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    px = spark.sql(_TEXELS, texels=raw).withColumn("name", F.concat(F.col("map_id").cast("string"), F.lit("_"), F.col("vec_id").cast("string")))
    return catalog.texture_channel_stats(px)


@query("texture_channel_stats", f"""
WITH {_STATS} SELECT map_id, name, round(r_mean, 6) AS r_mean, round(b_mean, 6) AS b_mean, round(a_std, 6) AS a_std, r_mean < 10 AND b_mean > 220 AND a_std > 3 AS normal FROM st""")
def texture_channel_stats(spark, sf):
    s = catalog.is_normalmap(texel_stats(spark, sf))
    return s.select("map_id", "name", *[F.round(c, 6).alias(c) for c in ("r_mean", "b_mean", "a_std")], "normal")


@query("pick_overview", f"""
WITH {_STATS}, c AS (SELECT vec_id, CAST(FLOOR(vec_id / 50) AS BIGINT) AS map_id, CAST(FLOOR(vec_id / 50) AS BIGINT) || '_' || vec_id AS name, CASE WHEN vec_id % 2 = 0 OR label % 2 = 0 THEN 'DXT5' ELSE 'DXT1' END AS fmt,
  512 * (1 + label % 3) AS w, CASE WHEN vec_id % 100 < 50 AND vec_id % 3 > 0 THEN 512 ELSE 2048 END AS h FROM embeddings),
j AS (SELECT c.*, fmt = 'DXT5' AND r_mean < 10 AND b_mean > 220 AND a_std > 3 AS normal FROM c LEFT JOIN st USING (map_id, name) WHERE w >= 1024 AND h >= 1024)
SELECT map_id, min(name) FILTER (NOT normal) AS colormap, CASE WHEN count(*) FILTER (NOT normal) = 0 THEN min(name) FILTER (normal) END AS normalmap FROM j GROUP BY map_id""")
def pick_overview(spark, sf):
    e = table(spark, sf, "embeddings")
    textures = e.select(
        F.floor(F.col("vec_id") / 50).alias("map_id"), F.concat(F.floor(F.col("vec_id") / 50).cast("string"), F.lit("_"), F.col("vec_id").cast("string")).alias("name"),
        F.when((F.col("vec_id") % 2 == 0) | (F.col("label") % 2 == 0), "DXT5").otherwise("DXT1").alias("fmt"), (512 * (1 + F.col("label") % 3)).alias("w"),
        F.when((F.col("vec_id") % 100 < 50) & (F.col("vec_id") % 3 > 0), 512).otherwise(2048).alias("h"),
    )
    return catalog.pick_overview(textures, texel_stats(spark, sf))


@query("dedupe_materials", """
WITH m AS (SELECT doc_id AS map_id, source || '_' || lang AS name, sha256(text) AS sha FROM documents),
c AS (SELECT name, sha, min(map_id) AS first FROM m GROUP BY ALL), p AS (SELECT name, arg_min(sha, (first, sha)) AS plain FROM c GROUP BY name)
SELECT map_id, name, CASE WHEN sha = plain THEN name ELSE name || '_' || sha END AS store_name FROM m JOIN p USING (name)""")
def dedupe_materials(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("map_id"), F.concat_ws("_", "source", "lang").alias("name"), F.col("text").alias("body"))
    return catalog.dedupe_materials(d).select("map_id", "name", "store_name")


# ---- map index -------------------------------------------------------------------------------


@query("map_summary", """
WITH m AS (SELECT DISTINCT map_id FROM fx_raster), l AS (SELECT map_id, count(*) AS n FROM fx_lcs GROUP BY map_id), s AS (SELECT map_id, count(*) AS n FROM fx_store GROUP BY map_id)
SELECT m.map_id, coalesce(l.n, 0) AS landclasses, coalesce(s.n, 0) AS materials FROM m LEFT JOIN l USING (map_id) LEFT JOIN s USING (map_id)""")
def map_summary(spark, sf):
    maps = view(spark, sf, "fx_layers").select("map_id")
    return catalog.map_summary(maps, view(spark, sf, "fx_lcs"), view(spark, sf, "fx_store"))


@query("upsert_index", """
WITH cur AS (SELECT name, bal, id + 1 AS pos FROM fx_maps WHERE success), upd AS (SELECT name, -bal AS bal FROM fx_maps WHERE bal > 3000 OR NOT success),
fresh AS (SELECT u.* FROM upd u ANTI JOIN cur USING (name))
SELECT cur.name, CAST(pos AS BIGINT) AS pos, CASE WHEN upd.name IS NOT NULL THEN upd.bal ELSE cur.bal END AS bal FROM cur LEFT JOIN upd USING (name)
UNION ALL SELECT name, CAST((SELECT max(pos) FROM cur) + row_number() OVER (ORDER BY name) AS BIGINT), bal FROM fresh""")
def upsert_index(spark, sf):
    m = view(spark, sf, "fx_maps")
    cur = m.filter("success").select("name", "bal", (F.col("id") + 1).alias("pos"))
    upd = m.filter("bal > 3000 OR NOT success").select("name", (-F.col("bal")).alias("bal"))
    return catalog.upsert_index(cur, upd)


@query("rebuild_index", """
SELECT c.name, c.bal FROM fx_maps c WHERE success AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.id) ORDER BY c.name""")
def rebuild_index(spark, sf):
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    maps = view(spark, sf, "fx_maps").join(have, "id", "left_semi").select("name")
    return catalog.rebuild_index(maps, view(spark, sf, "fx_maps").filter("success").select("name", "bal"), "name")


@query("order_maps", "SELECT name AS map_id FROM fx_maps ORDER BY name")
def order_maps(spark, sf):
    return catalog.order_maps(view(spark, sf, "fx_maps").select(F.col("name").alias("map_id")))


@query("write_manifest", """
WITH l AS (SELECT map_id, string_agg('{"layer":"' || layer || '","width":' || width || ',"height":' || height || ',"world_extent":[0.0,0.0,500.0,300.0]}', ',') AS layers FROM fx_layers GROUP BY map_id),
c AS (SELECT map_id, string_agg('{"lc_idx":' || lc_idx || ',"name":"' || name || '","texture":' || coalesce('"' || texture || '"', 'null') || '}', ',' ORDER BY lc_idx) AS lcs FROM fx_lcs GROUP BY map_id),
z AS (SELECT DISTINCT map_id FROM fx_zones)
SELECT l.map_id, '{"mapName":' || l.map_id || ',"layers":[' || layers || '],"landclasses":' || coalesce('[' || lcs || ']', 'null') || ',"hasMissions":' || CASE WHEN z.map_id IS NULL THEN 'false' ELSE 'true' END || '}' AS manifest
FROM l LEFT JOIN c USING (map_id) LEFT JOIN z USING (map_id)""")
def write_manifest(spark, sf):
    return sinks.assemble_manifests(
        view(spark, sf, "fx_layers").select("map_id"), layers=view(spark, sf, "fx_layers"), landclasses=view(spark, sf, "fx_lcs"),
        missions=view(spark, sf, "fx_zones"),
    )


@query("height_source", """
SELECT id, CASE WHEN bal % 5 > 2 THEN 'height' WHEN bal > 0 THEN 'tiles' END AS file,
  CASE WHEN bal % 5 > 2 THEN CASE WHEN id % 3 = 0 THEN 'heights' ELSE 'coords' END WHEN bal > 0 THEN 'coords' END AS extent_from FROM fx_maps""")
def height_source(spark, sf):
    def box(name, when):
        return F.when(when, F.struct(F.lit(name).alias("origin")))

    m = view(spark, sf, "fx_maps").select(
        "id", F.when(F.col("bal") % 5 > 2, "height").alias("height"), F.when(F.col("bal") > 0, "tiles").alias("tiles"), F.lit(None).cast("string").alias("none"),
        box("heights", F.col("id") % 3 == 0).alias("hx"), box("coords", F.lit(True)).alias("mx"), box("grid", F.lit(False)).alias("gx"),
    )
    main = catalog.main_source("none", "none", "tiles", "gx", "hx", "mx")
    return m.select("id", catalog.height_source("height", "hx", "mx", main).alias("s")).select("id", "s.file", F.col("s.extent.origin").alias("extent_from"))


@query("manifest_round_trip", """
WITH l AS (SELECT map_id, count(*) AS n FROM fx_layers GROUP BY map_id), c AS (SELECT map_id, count(*) AS n FROM fx_lcs GROUP BY map_id),
p AS (SELECT map_id, count(DISTINCT pool_idx) AS n, count(*) AS i FROM fx_instances GROUP BY map_id)
SELECT CAST(l.map_id AS VARCHAR) AS map_id, CAST(l.n AS INT) AS layers, CAST(coalesce(c.n, 0) AS INT) AS landclasses, CAST(coalesce(p.n, 0) AS INT) AS pools, coalesce(p.i, 0) AS "instanceCount",
  EXISTS (SELECT 1 FROM fx_zones z WHERE z.map_id = l.map_id) AS "hasMissions", false AS "has_heightmap", false AS "has_terrainPaint", false AS "has_colormap"
FROM l LEFT JOIN c USING (map_id) LEFT JOIN p USING (map_id)""")
def manifest_round_trip(spark, sf):
    """Manifests are written, read back and summed up."""
    layers = view(spark, sf, "fx_layers")
    pools = view(spark, sf, "fx_instances").groupBy("map_id", "pool_idx").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "manifests")
    sinks.write_manifest(layers.select("map_id"), path, layers=layers, landclasses=view(spark, sf, "fx_lcs"), missions=view(spark, sf, "fx_zones"),
                         pools=pools.withColumns({"name": F.lit("pool"), "category": F.lit("other")}))
    return readers.manifest_summary(readers.read_manifest_lines(spark, path))


@query("main_source", """
SELECT id, CASE WHEN bal % 3 > 1 THEN 'paint' WHEN bal % 2 > 1 THEN 'colormap' WHEN bal > 0 THEN 'tiles' END AS file,
  CASE WHEN bal % 3 > 1 OR (bal % 2 <= 1 AND bal > 0) THEN CASE WHEN id % 2 = 0 THEN 'grid' ELSE 'coords' END WHEN bal % 2 > 1 THEN CASE WHEN id % 3 = 0 THEN 'heights' ELSE 'coords' END END AS extent_from
FROM fx_maps""")
def main_source(spark, sf):
    def box(name, when):
        return F.when(when, F.struct(F.lit(name).alias("origin")))

    m = view(spark, sf, "fx_maps").withColumns({
        "paint": F.when(F.col("bal") % 3 > 1, "paint"), "colormap": F.when(F.col("bal") % 2 > 1, "colormap"),
        "tiles": F.when(F.col("bal") > 0, "tiles"), "grid": box("grid", F.col("id") % 2 == 0), "heights": box("heights", F.col("id") % 3 == 0),
        "coords": box("coords", F.lit(True)),
    })
    src = catalog.main_source("paint", "colormap", "tiles", "grid", "heights", "coords")
    return m.select("id", src["file"].alias("file"), src["extent"]["origin"].alias("extent_from"))


# ---- byte ranges and builds ------------------------------------------------------------------


@query("merge_intervals", """
WITH p AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM p)
SELECT file, min("start") AS "start", max("end") AS "end" FROM i GROUP BY file, island""")
def merge_intervals(spark, sf):
    return audit.merge_intervals(view(spark, sf, "fx_spans"), chunk=512)


@query("gaps", """
WITH t AS (SELECT file, 9500 + file AS total FROM fx_spans GROUP BY file), s AS (SELECT file, "start", least("end", total) AS "end", total FROM fx_spans JOIN t USING (file) WHERE least("end", total) > "start"),
p AS (SELECT file, total, coalesce(max("end") OVER (PARTITION BY file ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, "start" AS b FROM s
  UNION ALL SELECT file, total, coalesce((SELECT max("end") FROM s WHERE s.file = t.file), 0), total FROM t)
SELECT file, CAST(a AS BIGINT) AS "start", CAST(b AS BIGINT) AS "end", CAST(b - a AS BIGINT) AS bytes, round((b - a) * 100.0 / total, 2)::DOUBLE AS percent FROM p WHERE b > a""")
def gaps(spark, sf):
    s = view(spark, sf, "fx_spans")
    totals = s.groupBy("file").agg((F.lit(9500) + F.first("file")).alias("total"))
    return audit.gaps(s, totals, chunk=512)


@query("delta_decode", """
SELECT block, i, CAST(sum(d) OVER (PARTITION BY block ORDER BY i) % 256 AS INT) AS run,
  CAST(sum(d * 513) OVER (PARTITION BY block ORDER BY i) % 65536 AS INT) AS wide FROM fx_deltas""")
def delta_decode_query(spark, sf):
    d = delta_decode(view(spark, sf, "fx_deltas"), ["block"], "i", "d", 256, chunk=16).withColumn("d2", F.col("d") * 513)
    return delta_decode(d, ["block"], "i", "d2", 65536, "wide", chunk=16).select("block", "i", "run", "wide")


@query("latest_result", """
SELECT map_id, ok, seconds, event_id FROM fx_builds QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_result(spark, sf):
    return audit.latest_result(view(spark, sf, "fx_builds").select("map_id", "ok", "seconds", "event_id", "ts")).drop("ts")


@query("build_summary", """
WITH d AS (SELECT run, count(*) AS completed, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, sum(seconds) AS elapsed FROM fx_builds GROUP BY run),
t AS (SELECT run, run * 50 + 1 AS total FROM (SELECT unnest(generate_series(0, 24)) AS run)),
j AS (SELECT t.run, t.total, coalesce(completed, 0) AS completed, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, elapsed FROM t LEFT JOIN d USING (run))
SELECT run, total, completed, succeeded, failed, round(elapsed, 4) AS elapsed, round(completed * 100.0 / total, 6)::DOUBLE AS percent,
  CASE WHEN completed > 0 THEN round(elapsed / completed * (total - completed), 3) END AS eta FROM j""")
def build_summary(spark, sf):
    totals = spark.range(25).select(F.col("id").alias("run"), (F.col("id") * 50 + 1).alias("total"))
    s = audit.build_summary(view(spark, sf, "fx_builds"), ["run"], totals)
    return s.select("run", "total", "completed", "succeeded", "failed", F.round("elapsed", 4).alias("elapsed"), F.round("percent", 6).alias("percent"), F.round("eta", 3).alias("eta"))


@query("failure_report", """
WITH e AS (SELECT event_id, map_id, string_split(error, chr(10)) AS l FROM fx_builds WHERE NOT ok)
SELECT event_id, map_id, array_to_string(CASE WHEN len(l) > 3 THEN list_append(l[1:3], '... (' || (len(l) - 3) || ' more lines)') ELSE l END, '|') AS lines FROM e""")
def failure_report(spark, sf):
    return audit.failure_report(view(spark, sf, "fx_builds")).select("event_id", "map_id", F.array_join("error_lines", "|").alias("lines"))


@query("rank_layers", """
SELECT c_nationkey AS map_id, CASE WHEN bool_or(c_custkey % 5 = 0 AND c_nationkey % 4 < 2) AND bool_or(c_custkey % 5 = 1 AND c_nationkey % 2 = 0) THEN 'mesh+detail'
  WHEN bool_or(c_custkey % 5 = 0 AND c_nationkey % 4 < 2) THEN 'mesh' WHEN bool_or(c_custkey % 5 = 1 AND c_nationkey % 2 = 0) THEN 'detail' ELSE 'pseudo' END AS source FROM customer GROUP BY 1""")
def rank_layers(spark, sf):
    from ..operators.raster import rank_layers as rank

    c = table(spark, sf, "customer")
    source = F.when((F.col("c_custkey") % 5 == 0) & (F.col("c_nationkey") % 4 < 2), "mesh").when(
        (F.col("c_custkey") % 5 == 1) & (F.col("c_nationkey") % 2 == 0), "detail").otherwise("pseudo")
    return rank(c.select(F.col("c_nationkey").alias("map_id"), source.alias("source")))


# ---- materials -------------------------------------------------------------------------------


@query("landclass_materials", f"""
WITH {CANDIDATES_SQL}, h AS (SELECT r.map_id, lc_idx, arg_min(candidate, rank) AS resolved FROM first_rank r JOIN fx_store s ON s.map_id = r.map_id AND s.name = r.candidate GROUP BY ALL),
dk AS (SELECT map_id, lc_idx, unnest([0, 1, 2]) AS slot, unnest([trim(d_r), trim(d_g), trim(d_b)]) AS raw FROM fx_lcs),
dl AS (SELECT map_id, lc_idx, slot, list_filter([raw, CASE WHEN starts_with(raw, 'detail_') THEN substr(raw, 8) END,
  CASE WHEN starts_with(raw, 'detail_') THEN substr(raw, 8) || '_tex_d' END, CASE WHEN NOT suffix(raw, '_tex_d') THEN raw || '_tex_d' END], lambda s: s IS NOT NULL AND s <> '') AS c FROM dk WHERE raw IS NOT NULL),
du AS (SELECT map_id, lc_idx, slot, unnest(c) AS candidate, generate_subscripts(c, 1) AS rank FROM dl),
dd AS (SELECT u.map_id, lc_idx, slot, arg_min(candidate, rank) AS name FROM du u JOIN fx_store s ON s.map_id = u.map_id AND s.name = u.candidate GROUP BY ALL),
sc AS (SELECT *, 2.0::DOUBLE + map_id % 3 AS mx, greatest(greatest(coalesce(size_m, 256), 8) / (2.0::DOUBLE + map_id % 3), 8) AS sx, greatest(greatest(coalesce(size_m * 2, 256), 8) / 4.0::DOUBLE, 8) AS sy FROM fx_lcs)
SELECT l.map_id, l.lc_idx, h.resolved AS texture, round(sx, 9) AS scale_x, round(sy, 9) AS scale_y, concat_ws('|', coalesce(d0.name, '-'), coalesce(d1.name, '-'), coalesce(d2.name, '-'), '-') AS details,
  round(CASE WHEN l.lc_idx % 4 = 1 THEN greatest(greatest(l.lc_idx % 7 + 0.5::DOUBLE, 1) / mx, 1) ELSE sx END, 9) AS s0, round(sx, 9) AS s1, round(CASE WHEN l.lc_idx % 4 = 1 THEN greatest(40 / mx, 1) ELSE sx END, 9) AS s2,
  starts_with(lower(l.name), 'ocean') OR contains(lower(l.name), '_ocean') AS ocean
FROM sc l LEFT JOIN h USING (map_id, lc_idx) LEFT JOIN dd d0 ON d0.map_id = l.map_id AND d0.lc_idx = l.lc_idx AND d0.slot = 0
LEFT JOIN dd d1 ON d1.map_id = l.map_id AND d1.lc_idx = l.lc_idx AND d1.slot = 1 LEFT JOIN dd d2 ON d2.map_id = l.map_id AND d2.lc_idx = l.lc_idx AND d2.slot = 2""")
def landclass_materials(spark, sf):
    lcs = details(view(spark, sf, "fx_lcs")).withColumns({
        "size": F.when(F.col("size_m").isNotNull(), F.array(F.col("size_m"), F.col("size_m") * 2)),
        "detail_sizes": F.when(F.col("lc_idx") % 4 == 1, F.array(F.col("lc_idx") % 7 + F.lit(0.5), F.lit(None).cast("double"), F.lit(40.0))),
    })
    canvas = lcs.select("map_id").distinct().select("map_id", (F.lit(2.0) + F.col("map_id") % 3).alias("mpp_x"), F.lit(4.0).alias("mpp_z"))
    m = catalog.landclass_materials(lcs, view(spark, sf, "fx_store"), canvas)
    shown = F.array_join(F.transform("detail_textures", lambda d: F.coalesce(d, F.lit("-"))), "|")
    return m.select("map_id", "lc_idx", "texture", F.round("scale_x", 9).alias("scale_x"), F.round("scale_y", 9).alias("scale_y"), shown.alias("details"),
                    *[F.round(F.col("detail_scales")[i], 9).alias(f"s{i}") for i in range(3)], "ocean")


_STORED = """
SELECT map_id, CASE CAST(length(name) % 5 AS INT) WHEN 0 THEN CONCAT(CAST(map_id AS STRING), '_', name, '_', CAST(length(name) AS STRING)) WHEN 1 THEN CONCAT('tile_', name)
  WHEN 2 THEN CONCAT(name, '_NA16') WHEN 3 THEN CONCAT(CAST(map_id AS STRING), '_', name) ELSE name END AS name FROM {store}"""
_STORED_SQL = _STORED.format(store="fx_store")


@query("select_materials", f"""
WITH s AS ({_STORED_SQL}) SELECT map_id, name FROM s
WHERE NOT (starts_with(name, CAST(map_id AS VARCHAR) || '_') AND regexp_matches(regexp_extract(name, '[^_]*$'), '^[+]?[0-9]+$')) AND NOT starts_with(name, 'tile_') AND NOT suffix(lower(name), '_na16')""")
def select_materials(spark, sf):
    return catalog.select_materials(spark.sql(_STORED, store=view(spark, sf, "fx_store")))
