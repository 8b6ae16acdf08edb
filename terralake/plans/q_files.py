"""Queries over file contents: the contents are derived from table rows, then read back."""

from pyspark.sql import functions as F

from ..session import content_batches
from ..sources import binary, readers
from . import encoders as enc
from .base import query, table, view

# ---- listings and JSON documents -------------------------------------------------------------

_LISTED = """
SELECT 'root/levels/' || REPLACE(url, '/', '_') || CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '.bin' WHEN 1 THEN '.dxp.bin' WHEN 2 THEN '.bin' ELSE '.blkx' END AS path FROM {pages}"""


@query("level_names", f"""
WITH f AS (SELECT path, split_part(path, '/', 3) AS n FROM ({_LISTED.format(pages='pages')}))
SELECT left(n, length(n) - 4) AS map_id, path FROM f WHERE suffix(n, '.bin') AND NOT suffix(n, '.dxp.bin') ORDER BY 1""")
def level_names(spark, sf):
    return readers.level_names(spark.sql(_LISTED, pages=table(spark, sf, "pages")))


_META = """
SELECT p_partkey AS map_id, CASE CAST(p_partkey % 11 AS INT) WHEN 10 THEN '{{"mapCoord0": [1, 2], "water_level": 3' ELSE
  '{{"water_level": ' || CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN '[' || CAST(p_size AS STRING) || ', 7]' WHEN 2 THEN 'null' ELSE '"5"' END
  || CASE WHEN p_partkey % 3 = 0 THEN ', "mapCoord0": [-' || CAST(p_size AS STRING) || '.5, -20], "mapCoord1": [' || CAST(p_size AS STRING) || ', 40.25, 9]' ELSE '' END
  || CASE WHEN p_partkey % 5 < 3 THEN ', "tankMapCoord0": [1, 2]' ELSE '' END || CASE WHEN p_partkey % 7 < 4 THEN ', "tankMapCoord1": [3, ' || CAST(p_size AS STRING) || '], "tankGridSize": [8]' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN ', "latitude": ' || CAST(p_size AS STRING) ELSE '' END || ', "stars": {{"latitude": 12.5, "longitude": -' || CAST(p_size AS STRING) || '}}'
  || ', "customLevelMap": "' || p_name || '"}}' END AS text
FROM {part}"""


@query("read_level_meta", """
SELECT p_partkey AS map_id, CASE WHEN b THEN NULL WHEN p_partkey % 4 < 2 THEN CAST(p_size AS DOUBLE) END AS water_level,
  CASE WHEN NOT b AND p_partkey % 3 = 0 THEN -p_size - 0.5::DOUBLE ELSE -32768 END AS x0, CASE WHEN NOT b AND p_partkey % 3 = 0 THEN 60.25::DOUBLE ELSE 65536 END AS size_z,
  CASE WHEN NOT b AND p_partkey % 5 < 3 AND p_partkey % 7 < 4 THEN CAST(p_size AS DOUBLE) END AS tank_z1, CASE WHEN NOT b AND p_partkey % 5 < 3 AND p_partkey % 7 < 4 THEN 8.0::DOUBLE END AS grid,
  CASE WHEN b THEN NULL WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 12.5::DOUBLE END AS latitude, CASE WHEN NOT b THEN CAST(-p_size AS DOUBLE) END AS longitude, CASE WHEN NOT b THEN p_name END AS custom
FROM (SELECT *, p_partkey % 11 = 10 AS b FROM part)""")
def read_level_meta(spark, sf):
    m = readers.parse_level_meta(spark.sql(_META, part=table(spark, sf, "part")))
    return m.select(
        "map_id", "water_level", m.coord0[0].alias("x0"), m.map_size[1].alias("size_z"), F.col("tank_zone.coord1")[1].alias("tank_z1"),
        F.col("tank_zone.grid_size").alias("grid"), "latitude", "longitude", F.col("custom_level_map").alias("custom"),
    )


def _mission_doc(v):
    """Two squads and three areas per zone row, some of them malformed."""
    tm = F.format_string("[[%d.0,0,0.0],[0,1,0],[0.0,0,4.0],[%d.5,1,%d.0]]", F.col("zone_id") % 50, F.col("x").cast("long"), F.col("z").cast("long"))
    bad = F.when(F.col("zone_id") % 6 == 0, F.lit("[[1,2]]")).otherwise(tm)
    squads = F.format_string(
        '[{"name":"%s_spawn","tm":%s,"props":{"squad_members":["zone_%d","other"]}},{"name":"KillArea_spawn","tm":%s,"props":{"squad_members":["hidden"]}}]',
        F.col("name"), bad, F.col("zone_id") % 4, tm,
    )
    squads = F.when(F.col("zone_id") % 9 == 8, F.lit('{"name":"x"}')).otherwise(squads)
    areas = F.format_string('{"zone_%d":{"tm":%s},"hardcore_battle_area_1":{"tm":%s},"t1_capture_area_%d":{"tm":%s},"briefing_t1_resp":{"tm":%s}}',
                            F.col("zone_id") % 3, tm, tm, F.col("zone_id") % 30, bad, tm)
    return F.format_string('{"units":{"area_squad":%s},"areas":%s}', squads, areas)


@query("read_missions", """
WITH b AS (SELECT *, CASE WHEN zone_id % 4 = 3 THEN 'bttl' ELSE 'other' END AS mk, zone_id % 6 = 0 AS bad, zone_id % 9 = 8 AS nosq, CAST(floor(x) AS BIGINT) + 0.5::DOUBLE AS wx, floor(z)::DOUBLE AS wz FROM fx_zones),
z AS (
  SELECT zone_id, mk, 'spawn' AS kind, name || '_spawn' AS name, wx AS x, wz AS z, NULL::DOUBLE AS ext, NULL AS label FROM b WHERE mk <> 'bttl' AND NOT bad AND NOT nosq
  UNION ALL SELECT zone_id, mk, kk, 'briefing_t1_resp', wx, wz, NULL, NULL FROM b, (VALUES ('spawn'), ('spawn_zone')) k(kk) WHERE mk = 'bttl'
  UNION ALL SELECT zone_id, mk, 'spawn_zone', 'briefing_t1_resp', wx, wz, NULL, NULL FROM b WHERE mk <> 'bttl'
  UNION ALL SELECT zone_id, mk, 'spawn_zone', 'zone_' || zone_id % 3, wx, wz, NULL, NULL FROM b WHERE mk <> 'bttl' AND NOT bad AND NOT nosq AND zone_id % 3 = zone_id % 4
  UNION ALL SELECT zone_id, mk, 'battle', 'hardcore_battle_area_1', wx, wz, zone_id % 50, NULL FROM b
  UNION ALL SELECT zone_id, mk, 'capture', 't1_capture_area_' || zone_id % 30, wx, wz, zone_id % 50, chr(CAST(65 + greatest(zone_id % 30 - 1, 0) % 26 AS INT)) FROM b WHERE mk <> 'bttl' AND NOT bad),
m AS (SELECT *, unnest(CASE WHEN contains(name, 'hardcore') THEN ['hardcore'] ELSE ['arcade', 'hardcore'] END) AS mode FROM z)
SELECT zone_id, mk AS mission_kind, kind, name, mode, x, z, ext, label FROM m""")
def read_missions(spark, sf):
    z = view(spark, sf, "fx_zones")
    files = z.select(
        "map_id", F.col("zone_id").alias("file"), F.when(F.col("zone_id") % 4 == 3, "Area_BTTL_1").otherwise("area_dom").alias("stem"),
        F.lit("area").alias("suffix"), _mission_doc(z).alias("text"),
    )
    out = readers.parse_missions(files)
    return out.select(F.col("file").alias("zone_id"), "mission_kind", "kind", "name", "mode", "x", "z", F.coalesce("radius", "hx").alias("ext"), "label")


@query("read_manifests", """
SELECT name AS map_id, bal AS water, CAST(id % 7 AS DOUBLE) AS lo, CASE WHEN id % 3 = 0 THEN 'p.png' END AS paint, id % 2 = 0 AS missions FROM fx_maps WHERE id % 5 <> 4""")
def read_manifests(spark, sf):
    m = view(spark, sf, "fx_maps")
    doc = F.format_string(
        '{"mapName":"%s","waterLevel":%s,"heightmap":{"height_min_m":%d.0},"terrainPaint":%s,"hasMissions":%s}', F.col("name"), F.col("bal").cast("string"), F.col("id") % 7,
        F.when(F.col("id") % 3 == 0, '{"file":"p.png"}').otherwise("null"), F.when(F.col("id") % 2 == 0, "true").otherwise("false"),
    )
    broken = F.when(F.col("id") % 5 == 4, F.lit('{"mapName": "cut')).otherwise(doc)
    out = readers.parse_manifests(m.select(F.col("name").alias("map_id"), broken.alias("text")))
    return out.select("map_id", F.col("waterLevel").alias("water"), F.col("heightmap.height_min_m").alias("lo"), F.col("terrainPaint.file").alias("paint"), F.col("hasMissions").alias("missions"))


# ---- object records and pictures -------------------------------------------------------------


def _vectors(spark, sf):
    content_batches(spark)
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "file")


@query("read_instances", """
SELECT vec_id AS file, CAST(i AS BIGINT) AS idx, CAST(i AS INT) AS pool_idx, round(embedding[3 * i + 1]::DOUBLE, 7) AS x, round(embedding[3 * i + 2]::DOUBLE, 7) AS y, round(embedding[3 * i + 3]::DOUBLE, 7) AS z
FROM (SELECT *, unnest(generate_series(0, 20)) AS i FROM embeddings)""")
def read_instances(spark, sf):
    files = _vectors(spark, sf).select("file", enc.records14("embedding").alias("content"))
    out = binary.parse_instances(files)
    return out.select("file", "idx", "pool_idx", *[F.round(F.col(c).cast("double"), 7).alias(c) for c in "xyz"])


@query("read_instances_legacy", """
SELECT vec_id AS file, CAST(i AS BIGINT) AS idx, round(embedding[2 * i + 1]::DOUBLE, 7) AS x, NULL::DOUBLE AS y, round(embedding[2 * i + 2]::DOUBLE, 7) AS z
FROM (SELECT *, unnest(generate_series(0, 31)) AS i FROM embeddings) WHERE i < 10 + label""")
def read_instances_legacy(spark, sf):
    v = _vectors(spark, sf)
    out = binary.parse_instances(v.select("file", enc.records10("embedding").alias("content")), 10, v.select("file", (F.col("label") + 10).alias("n")))
    return out.select("file", "idx", *[F.round(F.col(c).cast("double"), 7).alias(c) for c in "xyz"])


# ---- block chains ----------------------------------------------------------------------------

_LINES = """
l AS (SELECT doc_id AS file, string_split(text, chr(10)) AS ls FROM documents),
li AS (SELECT file, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM l)
"""
_CHAIN = _LINES + """,
ch AS (SELECT file, i, n, strlen(line) + 4 AS len, CAST(i % 4 AS INT) AS flags, CASE WHEN i = n - 1 AND file % 3 = 0 THEN 'EnND' WHEN i % 2 = 0 THEN 'tex.' ELSE 'lnd2' END AS tag FROM li),
po AS (SELECT *, CAST(12 + coalesce(sum(len + 4) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM ch)
"""


def containers(spark, sf, encode):
    """One container per document, with a part per line of its text."""
    content_batches(spark)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file"), encode("doc_id", "text").alias("content"))


@query("scan_blocks", f"""
WITH {_CHAIN} SELECT file, CAST(i AS INT) AS idx, pos, CAST(len AS BIGINT) AS len, flags, tag FROM po""")
def scan_blocks(spark, sf):
    return binary.parse_blocks(containers(spark, sf, enc.chain_of)).withColumn("tag", F.decode("tag", "utf-8"))


@query("tag_summary", f"""
WITH {_CHAIN} SELECT file, tag, count(*) AS blocks, CAST(sum(len) AS BIGINT) AS bytes, string_agg(DISTINCT CAST(flags AS VARCHAR), ',' ORDER BY CAST(flags AS VARCHAR)) AS flags FROM po GROUP BY GROUPING SETS ((file, tag), (file))""")
def tag_summary(spark, sf):
    from ..operators.audit import tag_summary as summary

    s = summary(binary.parse_blocks(containers(spark, sf, enc.chain_of)).withColumn("tag", F.decode("tag", "utf-8")))
    return s.withColumn("flags", F.array_join(F.col("flags").cast("array<string>"), ","))


# ---- textures --------------------------------------------------------------------------------


@query("scan_texture_records", f"""
WITH {_LINES}, po AS (SELECT *, strlen(line) AS size, CAST(3 + coalesce(sum(strlen(line) + 35) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM li)
SELECT file, pos, CAST(pos + 32 + size AS BIGINT) AS "end", CASE i % 3 WHEN 0 THEN 'DXT1' WHEN 1 THEN '21' ELSE 'BC7 ' END AS fmt, CAST(i * 7 AS BIGINT) AS flags, CAST(i % 4096 AS INT) AS w, CAST((i + 5) % 4096 AS INT) AS h,
  CAST(i % 12 AS INT) AS levels, CAST(size AS BIGINT) AS mem_sz, CAST(CASE WHEN i % 5 = 0 THEN 0 ELSE size END AS BIGINT) AS packed_sz FROM po""")
def scan_texture_records(spark, sf):
    return binary.parse_texture_records(containers(spark, sf, enc.textures_of)).drop("bpp")


@query("scan_pack_directory", f"""
WITH {_LINES} SELECT file, CAST(i AS INT) AS entry_idx, CASE WHEN nm = '' THEN printf('tex_%04d', i) ELSE nm END AS name, CAST(i % 4096 AS INT) AS w, CAST(strlen(line) AS BIGINT) AS body_size, line_md5
FROM (SELECT *, split_part(replace(replace(raw, '*', ''), '?', '_'), '$', 1) AS nm, md5(line) AS line_md5 FROM (SELECT *, CASE i % 3 WHEN 0 THEN split_part(line, ' ', 1) || '*' WHEN 1 THEN 'a?' || i || '$x' ELSE '$' || i END AS raw FROM li)) WHERE i % 7 <> 6""")
def scan_pack_directory(spark, sf):
    files = containers(spark, sf, enc.pack_of)
    found = binary.parse_pack_directory(files).join(files, "file")
    body = F.expr("substring(content, cast(body_offset + 1 as int), cast(body_size as int))")
    return found.select("file", "entry_idx", "name", "w", "body_size", F.md5(body).alias("line_md5"))


# ---- terrain cells ---------------------------------------------------------------------------


@query("scan_tile_cells", f"""
WITH {_LINES}, c AS (SELECT *, strlen(line) % 3 <> 0 AND strlen(line) > 0 AS p FROM li)
SELECT file, CAST(i AS INT) AS cell, CAST(i % 250 AS INT) AS d0, CAST((i * 3 + 1) % 256 AS INT) AS d6, p AS populated, p AND strlen(line) % 2 = 0 AS has_tex2, CAST(n AS INT) AS cols, 32.0::DOUBLE AS cell_size
FROM c QUALIFY avg(CAST(p AS INT)) OVER (PARTITION BY file) >= 0.02 AND file % 8 <> 7""")
def scan_tile_cells(spark, sf):
    out = binary.parse_tile_cells(containers(spark, sf, enc.cells_of))
    return out.select("file", "cell", F.col("det")[0].alias("d0"), F.col("det")[6].alias("d6"), "populated", "has_tex2", "cols", "cell_size")


# ---- files on disk ---------------------------------------------------------------------------

_LISTING = """
SELECT DISTINCT p_size % 3 = 0 AS air, LOWER(REPLACE(p_brand, '#', '_')) AS folder, CONCAT(LOWER(REPLACE(p_brand, '#', '_')), '_', CAST(p_size AS STRING)) AS stem,
  CASE WHEN p_size % 7 = 0 THEN '.txt' ELSE '.blkx' END AS ending FROM {part}"""


@query("mission_files", f"WITH f AS ({_LISTING.format(part='part')}) SELECT air, folder, stem FROM f WHERE ending = '.blkx'")
def mission_files(spark, sf):
    """Mission files written below a ground and an air folder, then listed."""
    from ..session import scratch_path

    root = scratch_path(spark, "missions")
    found = spark.sql(_LISTING, part=table(spark, sf, "part"))
    path = F.concat(F.lit(root + "/"), F.when(F.col("air"), "air").otherwise("ground"), F.lit("/"), "folder", F.lit("/"), "stem", "ending")
    enc.write_files(found.select(path.alias("path"), F.lit("{}").cast("binary").alias("content")))
    listed = readers.mission_files(spark, f"{root}/ground", [f"{root}/air"])
    return listed.select("air", "folder", "stem")


@query("scan_block_files", f"""
WITH {_CHAIN} SELECT file, CAST(i AS INT) AS idx, pos, CAST(len AS BIGINT) AS len, flags, tag FROM po WHERE file % 5 = 0""")
def scan_block_files(spark, sf):
    """Every fifth container as a file, read back by the byte-range reader."""
    from ..session import scratch_path

    root = scratch_path(spark, "containers")
    files = containers(spark, sf, enc.chain_of).filter("file % 5 = 0")
    enc.write_files(files.select(F.concat(F.lit(root + "/"), F.col("file").cast("string"), F.lit(".bin")).alias("path"), "content"))
    found = binary.scan_blocks(spark, root)
    return found.select(F.regexp_extract("file", "([0-9]+)[.]bin$", 1).cast("long").alias("file"), "idx", "pos", "len", "flags", F.decode("tag", "utf-8").alias("tag"))
