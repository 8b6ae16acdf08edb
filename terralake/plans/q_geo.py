"""Queries over coordinates, packed numbers and JSON fields."""

from pyspark.sql import functions as F

from ..functions import codec, geo, names
from .base import query, table, view


def extent():
    return geo.rect(0.0, 0.0, 500.0, 300.0)


# rectangles of residues, corners in any order
_RECTS = """
SELECT o_orderkey AS id, CAST((o_orderkey * 7) % 500 AS DOUBLE) AS ax0, CAST((o_orderkey * 11) % 300 AS DOUBLE) AS az0,
  CAST((o_custkey * 3) % 500 AS DOUBLE) AS ax1, CAST((o_custkey * 5) % 300 AS DOUBLE) AS az1,
  CAST((o_orderkey * 13) % 500 AS DOUBLE) AS bx0, CAST((o_orderkey * 17) % 300 AS DOUBLE) AS bz0,
  CAST((o_custkey * 19) % 500 AS DOUBLE) AS bx1, CAST((o_custkey * 23) % 300 AS DOUBLE) AS bz1
FROM {orders}"""


@query("rectangles", f"""
WITH r AS ({_RECTS.format(orders='orders')}),
n AS (SELECT id, ax0 AS x, bz1 AS z, least(ax0, ax1) AS ax0, least(az0, az1) AS az0, greatest(ax0, ax1) AS ax1, greatest(az0, az1) AS az1,
  least(bx0, bx1) AS bx0, least(bz0, bz1) AS bz0, greatest(bx0, bx1) AS bx1, greatest(bz0, bz1) AS bz1 FROM r),
c AS (SELECT *, greatest(ax0, bx0) AS cx0, greatest(az0, bz0) AS cz0, least(ax1, bx1) AS cx1, least(az1, bz1) AS cz1 FROM n)
SELECT id, x BETWEEN bx0 AND bx1 AND z BETWEEN bz0 AND bz1 AS inside,
  bx1 >= ax0 AND bx0 <= ax1 AND bz1 >= az0 AND bz0 <= az1 AS touching,
  least(cx0, cx1) AS x0, least(cz0, cz1) AS z0, greatest(cx0, cx1) AS x1, greatest(cz0, cz1) AS z1 FROM c""")
def rectangles(spark, sf):
    r = spark.sql(_RECTS, orders=table(spark, sf, "orders"))
    r = r.withColumn("a", geo.rect("ax0", "az0", "ax1", "az1")).withColumn("b", geo.norm_rect(F.struct(
        F.col("bx0").alias("x0"), F.col("bz0").alias("z0"), F.col("bx1").alias("x1"), F.col("bz1").alias("z1"))))
    c = geo.clip("a", "b")
    return r.select(
        "id", geo.in_rect("ax0", "bz1", "b").alias("inside"), geo.intersects("a", "b").alias("touching"),
        *[c[k].alias(k) for k in ("x0", "z0", "x1", "z1")],
    )


@query("cell_of", """
SELECT map_id, pool_idx, x, z,
  CAST(least(greatest(floor((x + 20) / 500 * 49 + 0.5), 0), 49) AS INT) AS node_x, CAST(least(greatest(floor((z - 30) / 300 * 29 + 0.5), 0), 29) AS INT) AS node_z,
  CAST(least(greatest(floor((x + 20) / 500 * 50), 0), 49) AS INT) AS cell_x, CAST(least(greatest(floor((z - 30) / 300 * 30), 0), 29) AS INT) AS cell_z,
  CASE WHEN floor((x + 20) / (500.0 / 15)) BETWEEN 0 AND 14 THEN CAST(floor((x + 20) / (500.0 / 15)) AS INT) END AS tile_x,
  CASE WHEN floor((z - 30) / (300.0 / 10)) BETWEEN 0 AND 9 THEN CAST(floor((z - 30) / (300.0 / 10)) AS INT) END AS tile_z
FROM fx_instances""")
def cell_of(spark, sf):
    e = geo.rect(-20.0, 30.0, 480.0, 330.0)
    node = geo.cell_of("x", "z", e, 50, 30, "node")
    cell = geo.cell_of("x", "z", e, 50, 30, "cell")
    tile = geo.cell_of("x", "z", e, 15, 10, "tile", "null")
    return view(spark, sf, "fx_instances").select(
        "map_id", "pool_idx", "x", "z", node["px"].alias("node_x"), node["pz"].alias("node_z"),
        cell["px"].alias("cell_x"), cell["pz"].alias("cell_z"), tile["px"].alias("tile_x"), tile["pz"].alias("tile_z"),
    )


@query("cell_center", """
SELECT map_id, px, pz, round(-250 + (px + 0.5) / 50 * 500, 6) AS x, round(-150 + (pz + 0.5) / 30 * 300, 6) AS z FROM fx_raster""")
def cell_center(spark, sf):
    return view(spark, sf, "fx_raster").select(
        "map_id", "px", "pz", F.round(geo.cell_center("px", -250.0, 250.0, 50), 6).alias("x"),
        F.round(geo.cell_center("pz", -150.0, 150.0, 30), 6).alias("z"),
    )


@query("scene_coordinates", """
SELECT map_id, pool_idx, x, z, round(x - 250, 6) AS sx, round(-(z - 150) * (500.0 / 300), 6) AS sz, x AS back_x, z AS back_z FROM fx_instances""")
def scene_coordinates(spark, sf):
    i = view(spark, sf, "fx_instances").withColumn("s", geo.world_to_scene("x", "z", extent()))
    back = geo.scene_to_world("s.x", "s.z", extent())
    return i.select(
        "map_id", "pool_idx", "x", "z", F.round("s.x", 6).alias("sx"), F.round("s.z", 6).alias("sz"),
        F.round(back["x"], 6).alias("back_x"), F.round(back["z"], 6).alias("back_z"),
    )


@query("grid_square", """
SELECT map_id, pool_idx, x, z, CASE WHEN x BETWEEN 50 AND 450 AND z BETWEEN 20 AND 280 THEN
    chr(CAST(65 + least(floor((280 - z) / 260 * 12), 11) AS INT)) || CAST(CAST(least(floor((x - 50) / 400 * 12), 11) AS INT) + 1 AS VARCHAR) END AS square
FROM fx_instances""")
def grid_square(spark, sf):
    n = geo.grid_count(F.lit(12.0))
    sq = geo.grid_square("x", "z", geo.rect(50.0, 20.0, 450.0, 280.0), n)
    return view(spark, sf, "fx_instances").select("map_id", "pool_idx", "x", "z", sq["label"].alias("square"))


@query("grid_arithmetic", """
SELECT p_partkey, CAST(CASE WHEN p_partkey = 0 THEN 16 ELSE ceil(sqrt(p_partkey)) END AS INT) AS side,
  CAST(least(greatest(floor(8192 / greatest(p_size, p_partkey % 90, 1)), 64), 512) AS INT) AS cell_px,
  CAST(CASE WHEN p_size % 5 = 0 THEN 1024 ELSE least(greatest(round(greatest(p_size, 20) * (p_retailprice / (p_size % 5))) * 2, 512), 4096) END AS INT) AS resolution,
  CASE WHEN p_size BETWEEN 2 AND 64 THEN p_size ELSE 10 END AS squares,
  CAST(CASE WHEN p_size % 3 > 0 THEN (p_partkey % 9 - 4) * (p_size % 3) END AS DOUBLE) AS x0, CAST(CASE WHEN p_size % 3 > 0 THEN (p_partkey % 9 - 4) * (p_size % 3) + 16 * (p_size % 3) END AS DOUBLE) AS x1
FROM part""")
def grid_arithmetic(spark, sf):
    p = table(spark, sf, "part")
    e = geo.grid_extent(F.col("p_partkey") % 9 - 4, F.lit(0), F.lit(16), F.lit(16), F.col("p_size") % 3)
    return p.select(
        "p_partkey", geo.infer_grid("p_partkey").alias("side"), geo.cell_px("p_size", (F.col("p_partkey") % 90)).alias("cell_px"),
        geo.mesh_resolution(F.col("p_size"), F.lit(20), F.col("p_retailprice"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 5).otherwise(F.lit(None))).alias("resolution"),
        geo.grid_count("p_size").alias("squares"), e["x0"].alias("x0"), e["x1"].alias("x1"),
    )


@query("dist3d", """
SELECT map_id, pool_idx, x, y, z, round(sqrt((x - 250) * (x - 250) + (z - 150) * (z - 150) + (y - 10) * (y - 10)), 6) AS dist FROM fx_instances""")
def dist3d(spark, sf):
    d = geo.dist3d(250.0, 150.0, 10.0, "x", "z", "y")
    return view(spark, sf, "fx_instances").select("map_id", "pool_idx", "x", "y", "z", F.round(d, 6).alias("dist"))


# transforms as JSON; some rows or cells are missing
_TM = """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 6 AS INT)
  WHEN 0 THEN '[[3.0,0.0,4.0],[0,1,0],[6.0,0.0,8.0],[' || CAST(o_custkey AS STRING) || '.5,1.0,' || CAST(o_orderkey AS STRING) || '.25]]'
  WHEN 1 THEN '[[3.0,0.0,4.0],[0,1,0],[6.0,0.0,8.0]]'
  WHEN 2 THEN '[[5.0,0.0],[0,1,0],[6.0,0.0,8.0],[1.0,2.0,3.0]]'
  WHEN 3 THEN '[[' || CAST(o_custkey AS STRING) || '.0,9.0,0.0],[0,1,0],[0.0,0.0,' || CAST(o_orderkey AS STRING) || '.0],[1.0,2.0]]'
  WHEN 4 THEN '[]' ELSE '[[0.0,1.0,2.5],[1,1,1],[2.5,1.0,0.0],[' || CAST(o_custkey AS STRING) || ',7,-' || CAST(o_orderkey AS STRING) || ']]' END AS tm
FROM {orders}"""


@query("transforms", f"""
WITH t AS ({_TM.format(orders='orders')}), m AS (SELECT id, from_json(tm, '[["DOUBLE"]]') AS tm FROM t),
r AS (SELECT id, CASE WHEN len(tm) >= 4 AND len(tm[4]) >= 3 THEN tm[4] END AS p, CASE WHEN len(tm[1]) >= 3 THEN tm[1] END AS a, CASE WHEN len(tm[3]) >= 3 THEN tm[3] END AS c FROM m)
SELECT id, p[1] AS x, p[3] AS z, round(sqrt(a[1] * a[1] + a[3] * a[3]), 6) AS radius,
  CASE WHEN c IS NOT NULL THEN round(sqrt(a[1] * a[1] + a[3] * a[3]), 6) END AS hx, CASE WHEN a IS NOT NULL THEN round(sqrt(c[1] * c[1] + c[3] * c[3]), 6) END AS hz FROM r""")
def transforms(spark, sf):
    t = spark.sql(_TM, orders=table(spark, sf, "orders")).withColumn("m", F.from_json("tm", "array<array<double>>"))
    pos, half = geo.tm_position("m"), geo.tm_half_size("m")
    return t.select(
        "id", pos["x"].alias("x"), pos["z"].alias("z"), F.round(geo.tm_radius("m"), 6).alias("radius"),
        F.round(half["hx"], 6).alias("hx"), F.round(half["hz"], 6).alias("hz"),
    )


@query("water_predicates", """
SELECT r.map_id, r.px, r.pz, v_max > v_min AND v_min <= 140 AND h <= 140 - (v_max - v_min) / 255 AS wet, round(least(greatest((140 - v_min) / (v_max - v_min), 0), 1), 9) AS fraction
FROM fx_raster r JOIN fx_layers l ON r.map_id = l.map_id""")
def water_predicates(spark, sf):
    from ..operators.scans import join_dim

    r = join_dim(view(spark, sf, "fx_raster"), view(spark, sf, "fx_layers").select("map_id", "v_min", "v_max"), ["map_id"], ["px", "pz"], "inner")
    return r.select(
        "map_id", "px", "pz", geo.is_water_height("h", 140.0, F.col("v_min"), F.col("v_max")).alias("wet"),
        F.round(geo.water_fraction(140.0, F.col("v_min"), F.col("v_max")), 9).alias("fraction"),
    )


@query("is_water_color", "SELECT map_id, px, pz, b > r + 12 AND b >= g - 6 AND r + g + b < 360 AS wet FROM fx_rgb")
def is_water_color(spark, sf):
    return view(spark, sf, "fx_rgb").select("map_id", "px", "pz", geo.is_water_color("r", "g", "b").alias("wet"))


_ROB = ", ".join(str(v) for v in geo.ROBINSON_X)
_ROBY = ", ".join(str(v) for v in geo.ROBINSON_Y)


@query("robinson", f"""
WITH p AS (SELECT c_custkey AS id, c_acctbal / 55.0 - 80 AS lat, (c_custkey * 37) % 400 - 200.0 AS lon FROM customer),
c AS (SELECT id, least(greatest(lat, -90), 90) AS la, least(greatest(lon, -180), 180) AS lo, [{_ROB}] AS tx, [{_ROBY}] AS ty FROM p),
i AS (SELECT *, CAST(least(floor(abs(la) / 5), 17) AS INT) AS i FROM c),
f AS (SELECT *, (abs(la) - i * 5) / 5 AS f FROM i)
SELECT id, round(0.4725 + (tx[i + 1] + f * (tx[i + 2] - tx[i + 1])) * (lo / 180) * 0.5, 8) AS nx,
  round(0.5 - CASE WHEN la >= 0 THEN 1 ELSE -1 END * (ty[i + 1] + f * (ty[i + 2] - ty[i + 1])) * 0.5, 8) AS ny FROM f""")
def robinson(spark, sf):
    at = geo.robinson(F.col("c_acctbal") / 55.0 - 80, (F.col("c_custkey") * 37) % 400 - 200.0)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.round(at["nx"], 8).alias("nx"), F.round(at["ny"], 8).alias("ny")
    )


@query("sun_vector", """
SELECT event_id, round(sin(radians(a)) * cos(radians(e)), 8) AS x, round(sin(radians(e)), 8) AS y, round(cos(radians(a)) * cos(radians(e)), 8) AS z
FROM (SELECT event_id, value AS a, least(greatest(value - 20, 0), 90) AS e FROM events)""")
def sun_vector(spark, sf):
    s = geo.sun_vector(F.col("value"), F.col("value") - 20)
    return table(spark, sf, "events").select("event_id", *[F.round(s[k], 8).alias(k) for k in "xyz"])


@query("lc_scale", """
SELECT map_id, lc_idx, greatest(coalesce(size_m, 256), 8) AS sx, round(greatest(greatest(coalesce(size_m, 256), 8) / 2.5, 8), 6) AS px
FROM fx_lcs""")
def lc_scale(spark, sf):
    size = F.when(F.col("size_m").isNotNull(), F.array("size_m", "size_m"))
    return view(spark, sf, "fx_lcs").select(
        "map_id", "lc_idx", geo.lc_scale(size)["sx"].alias("sx"), F.round(geo.lc_scale(size, 2.5)["sy"], 6).alias("px")
    )


# ---- packed numbers --------------------------------------------------------------------------

_WORDS = "SELECT o_orderkey AS id, (o_orderkey * 2654435761 + o_custkey * 40503) % 4294967296 AS word FROM {orders}"


@query("packed_words", f"""
WITH w AS ({_WORDS.format(orders='orders')})
SELECT id, CAST(word % 1073741824 AS BIGINT) AS len, CAST(word // 1073741824 AS INT) AS flags,
  CAST((word // 1073741824) * 1024 + word % 1024 AS BIGINT) AS idx, CAST((word // 1024) % 1048576 AS BIGINT) AS count,
  CASE CAST((word % 256) // 32 AS INT) WHEN 0 THEN 'none' WHEN 1 THEN 'zstd' WHEN 2 THEN 'lzma' WHEN 3 THEN 'oodle' WHEN 4 THEN 'zlib' ELSE 'unknown' END AS compression
FROM w""")
def packed_words(spark, sf):
    w = spark.sql(_WORDS, orders=table(spark, sf, "orders"))
    lf, e = codec.unpack_len_flags("word"), codec.unpack_entry("word")
    return w.select(
        "id", lf["len"].alias("len"), lf["flags"].alias("flags"), e["idx"].alias("idx"), e["count"].alias("count"),
        codec.compression_of(F.col("word") % 256).alias("compression"),
    )


@query("supported_texture", """
SELECT map_id, pack, entry_idx, fmt_x, fmt_x IN ('DXT1', 'DXT5', 'BC7 ', '26', '21', '50') AS supported
FROM (SELECT *, CASE entry_idx % 5 WHEN 0 THEN fmt WHEN 1 THEN 'BC7 ' WHEN 2 THEN '21' WHEN 3 THEN 'DXT3' ELSE 'ATI2' END AS fmt_x FROM fx_entries)""")
def supported_texture(spark, sf):
    fmt = F.expr("CASE entry_idx % 5 WHEN 0 THEN fmt WHEN 1 THEN 'BC7 ' WHEN 2 THEN '21' WHEN 3 THEN 'DXT3' ELSE 'ATI2' END")
    return view(spark, sf, "fx_entries").withColumn("fmt_x", fmt).select(
        "map_id", "pack", "entry_idx", "fmt_x", codec.supported_texture("fmt_x").alias("supported")
    )


@query("dequantize", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((q * (2048.0 / 32767.0) + 512) * 10) / 10 AS x,
  round((q * 70000.0 * 2048.0 / 65536 / 32767 + 512) * 10) / 10 AS wide_x, CAST(CASE WHEN d <> 0 THEN d ELSE 8192 END AS DOUBLE) AS y_size
FROM (SELECT *, (l_partkey * 31 + l_suppkey * 7) % 65536 - 32768 AS q, CAST(l_quantity AS INT) % 5 AS d FROM lineitem)""")
def dequantize(spark, sf):
    q = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 7) % 65536 - 32768
    li = table(spark, sf, "lineitem").withColumn("q", q)
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", codec.dequantize("q", 2048.0, 512.0).alias("x"),
        codec.dequantize(F.col("q") * 70000.0, 2048.0, 512.0, wide=True).alias("wide_x"),
        codec.vertical_size(F.col("l_quantity").cast("int") % 5).alias("y_size"),
    )


@query("quantize_u16", """
SELECT r.map_id, px, pz, CAST(trunc(least(greatest((h - v_min) / greatest(v_max - v_min, 0.0001) * 65535.0, 0), 65535)) AS INT) AS q,
  round(h * ((v_max - v_min) / 65535.0) + v_min, 6) AS metres, CAST(h + ((px * 5) % 256 * pz + 127) // 255 AS BIGINT) AS block_value
FROM fx_raster r JOIN fx_layers l ON r.map_id = l.map_id""")
def quantize_u16(spark, sf):
    from ..operators.scans import join_dim

    r = join_dim(view(spark, sf, "fx_raster"), view(spark, sf, "fx_layers").select("map_id", "v_min", "v_max"), ["map_id"], ["px", "pz"], "inner")
    return r.select(
        "map_id", "px", "pz", codec.quantize_u16("h", "v_min", "v_max").alias("q"),
        F.round(codec.height_from_u16("h", F.col("v_max") - F.col("v_min"), "v_min"), 6).alias("metres"),
        codec.block_value("h", F.col("pz"), (F.col("px") * 5) % 256).alias("block_value"),
    )


@query("normal_from_dxt5nm", """
WITH n AS (SELECT map_id, px, pz, a / 127.5 - 1 AS x, g / 127.5 - 1 AS y FROM fx_rgb),
z AS (SELECT *, sqrt(greatest(0, 1 - x * x - y * y)) AS z FROM n)
SELECT map_id, px, pz, 255 - CAST(trunc(least(greatest((x * 0.5 + 0.5) * 255.0, 0), 255)) AS INT) AS r,
  255 - CAST(trunc(least(greatest((y * 0.5 + 0.5) * 255.0, 0), 255)) AS INT) AS g, CAST(trunc(least(greatest((z * 0.5 + 0.5) * 255.0, 0), 255)) AS INT) AS b FROM z""")
def normal_from_dxt5nm(spark, sf):
    n = codec.normal_from_dxt5nm("g", "a", inverted=True)
    return view(spark, sf, "fx_rgb").select("map_id", "px", "pz", *[n[c].alias(c) for c in "rgb"])


_M64 = "18446744073709551616::UHUGEINT"


@query("fnv1a64", f"""
SELECT p_partkey, CAST(list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_M64}) AS DECIMAL(20, 0)) AS hash FROM part""")
def fnv1a64(spark, sf):
    return table(spark, sf, "part").select("p_partkey", codec.fnv1a64("p_name").alias("hash"))


@query("noise_byte", f"""
WITH s AS (SELECT map_id, px, pz, xor(xor(xor((map_id * 7919)::UBIGINT, (px::UBIGINT << 32)), pz::UBIGINT), 11400714819323198485::UBIGINT) AS h FROM fx_raster),
a AS (SELECT map_id, px, pz, xor(h, h >> 33) AS h FROM s),
b AS (SELECT map_id, px, pz, ((h::UHUGEINT * 18397679294719823053::UHUGEINT) % {_M64})::UBIGINT AS h FROM a),
c AS (SELECT map_id, px, pz, xor(h, h >> 33) AS h FROM b),
d AS (SELECT map_id, px, pz, ((h::UHUGEINT * 14181476777654086739::UHUGEINT) % {_M64})::UBIGINT AS h FROM c),
e AS (SELECT map_id, px, pz, xor(h, h >> 33) AS h FROM d)
SELECT map_id, px, pz, CAST(128 + trunc((CAST(h % 256 AS INT) - 128) * 24 / 128.0) AS INT) AS noise FROM e""")
def noise_byte(spark, sf):
    return view(spark, sf, "fx_raster").select(
        "map_id", "px", "pz", codec.noise_byte((F.col("map_id") * 7919).cast("decimal(20,0)"), "px", "pz", 0).alias("noise")
    )


@query("json_fields", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k + 1 WHEN 2 THEN NULL ELSE NULL END AS level,
  CASE WHEN event_id % 3 = 0 THEN CAST(k AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) END AS pair
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)""")
def json_fields(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    level = F.expr("CASE event_id % 4 WHEN 0 THEN concat('', k) WHEN 1 THEN concat('[', k + 1, ', 9]') WHEN 2 THEN concat('\"', k, '\"') ELSE 'null' END")
    pair = F.expr("CASE event_id % 3 WHEN 0 THEN concat('[', k, '.0, ', event_id, ', 3]') WHEN 1 THEN concat('[', k, ']') ELSE '[\"a\", 1]' END")
    j = e.withColumn("doc", F.concat(F.lit('{"level": '), level, F.lit(', "pair": '), pair, F.lit("}")))
    v = codec.vec2("doc", "$.pair")
    text = F.concat(v[0].cast("string"), F.lit(","), v[1].cast("long").cast("string"))
    return j.select("event_id", codec.num_or_first("doc", "$.level").alias("level"), text.alias("pair"))


@query("printable_strings", """
SELECT doc_id, CAST(len(s) AS INT) AS found, array_to_string(s, '|') AS texts
FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7e]{6,}')[1:12] AS s FROM documents)""")
def printable_strings(spark, sf):
    found = codec.printable_strings(F.encode("text", "utf-8"))
    d = table(spark, sf, "documents").select("doc_id", found.alias("s"))
    return d.select("doc_id", F.size("s").alias("found"), F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("texts"))
