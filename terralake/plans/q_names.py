"""Queries over names, labels and classification rules."""

from pyspark.sql import functions as F

from ..functions import codec, geo, names
from .base import query, table, view


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_CATEGORY = (
    "CASE WHEN name LIKE 'avg\\_%' ESCAPE '\\' THEN 'avg' WHEN name LIKE 'air\\_%' ESCAPE '\\' THEN 'air' "
    "WHEN name LIKE 'avn\\_%' ESCAPE '\\' THEN 'avn' WHEN name LIKE 'arcade\\_%' ESCAPE '\\' THEN 'arcade' ELSE 'other' END"
)
_DISPLAY = (
    "list_aggregate(list_transform(string_split(replace(regexp_replace(name, '^(avg|air|avn|arcade)_', ''), '_', ' '), ' '), "
    "lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"
)


@query("map_category", f"""
SELECT name, {_CATEGORY} AS category,
  CASE {_CATEGORY} WHEN 'avg' THEN 'Ground' WHEN 'air' THEN 'Air' WHEN 'avn' THEN 'Naval' WHEN 'arcade' THEN 'Arcade' ELSE 'Classic' END AS label
FROM fx_maps""")
def map_category(spark, sf):
    c = names.map_category("name")
    return view(spark, sf, "fx_maps").select("name", c.alias("category"), names.category_label(c).alias("label"))


@query("display_name", f"SELECT name, {_DISPLAY} AS display FROM fx_maps")
def display_name(spark, sf):
    return view(spark, sf, "fx_maps").select("name", names.display_name("name").alias("display"))


@query("gallery", f"""
SELECT name, {_DISPLAY} AS display FROM fx_maps
WHERE success AND {_CATEGORY} = 'air' AND (contains(lower(name), 'ery 1') OR contains(lower({_DISPLAY}), 'ery 1'))""")
def gallery(spark, sf):
    found = names.gallery(view(spark, sf, "fx_maps"), "air", "ery 1")
    return found.select("name", names.display_name("name").alias("display"))


@query("map_suffix", """
SELECT name, CASE WHEN contains(name, '_') THEN substr(name, instr(name, '_') + 1) ELSE name END AS suffix FROM fx_maps""")
def map_suffix(spark, sf):
    return view(spark, sf, "fx_maps").select("name", names.map_suffix("name").alias("suffix"))


def _pool_case(n: str) -> str:
    rules = " ".join(f"WHEN {_any(n, words)} THEN '{cat}'" for cat, words in names.POOL_RULES)
    return f"CASE {rules} ELSE 'other' END"


_POOL_CATEGORY = _pool_case("lower(name)")


@query("pool_category", f"SELECT pool_idx, name, {_POOL_CATEGORY} AS category FROM fx_pools")
def pool_category(spark, sf):
    return view(spark, sf, "fx_pools").select("pool_idx", "name", names.pool_category("name").alias("category"))


_EARTH, _DEBRIS = _any("lower(name)", names.STYLE_EARTHWORK), _any("lower(name)", names.STYLE_DEBRIS)
_BUILDING = _any("lower(name)", names.STYLE_BUILDING)
_ROAD = f"regexp_matches(lower(name), '(^|[^a-z])({'|'.join(names.STYLE_ROAD)})([^a-z]|$)')"
_TAIL = f"WHEN category = 'debris' AND {_EARTH} THEN 'earthwork' WHEN category = 'debris' AND {_DEBRIS} THEN 'debris' ELSE category END"
STYLE_VIEWER = f"CASE WHEN {_BUILDING} THEN 'building' WHEN {_ROAD} THEN 'road' {_TAIL}"
STYLE_MAP = (
    f"CASE WHEN category = 'tree' OR contains(lower(name), 'tree') THEN 'tree' WHEN {_any('lower(name)', names.STYLE_VEGETATION)} THEN 'vegetation' "
    f"WHEN {_BUILDING} THEN 'building' WHEN {_any('lower(name)', names.STYLE_ROAD)} THEN 'road' {_TAIL}"
)
OCCLUDES = f"(style = 'building' OR category = 'building' OR {_any('lower(name)', names.OCCLUDER_WORDS)})"


@query("render_style", f"""
WITH c AS (SELECT pool_idx, name, {_POOL_CATEGORY} AS category FROM fx_pools)
SELECT pool_idx, {STYLE_VIEWER} AS viewer, {STYLE_MAP} AS map_style FROM c""")
def render_style(spark, sf):
    c = view(spark, sf, "fx_pools").withColumn("category", names.pool_category("name"))
    return c.select(
        "pool_idx", names.render_style("category", "name").alias("viewer"),
        names.render_style("category", "name", "map").alias("map_style"),
    )


@query("is_occluder", f"""
WITH c AS (SELECT pool_idx, name, {_POOL_CATEGORY} AS category FROM fx_pools),
s AS (SELECT *, {STYLE_VIEWER} AS style FROM c)
SELECT pool_idx, name, {OCCLUDES} AS occludes FROM s""")
def is_occluder(spark, sf):
    c = view(spark, sf, "fx_pools").withColumn("category", names.pool_category("name"))
    s = c.withColumn("style", names.render_style("category", "name"))
    return s.select("pool_idx", "name", names.is_occluder("category", "name", "style").alias("occludes"))


@query("team_of", """
SELECT zone_id, CASE WHEN list_has_any(string_split_regex(lower(name), '[^a-z0-9]+'), ['t1', 'team1']) THEN 1
  WHEN list_has_any(string_split_regex(lower(name), '[^a-z0-9]+'), ['t2', 'team2']) THEN 2 ELSE 0 END AS team FROM fx_zones""")
def team_of(spark, sf):
    return view(spark, sf, "fx_zones").select("zone_id", names.team_of("name").alias("team"))


# file stems and area names made from part names
_STEMS = """
SELECT p_partkey AS id,
  CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Small_BTTL_' WHEN 1 THEN 'small_' ELSE '' END || REPLACE(p_name, ' ', '_') AS stem,
  CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'briefing_t1_resp_' WHEN 1 THEN 'bttl_t2_capture_area_' WHEN 2 THEN 'Team_Spawn_' WHEN 3 THEN 'spawn_KillArea_'
    WHEN 4 THEN 'dom_capture_zone_' WHEN 5 THEN 'flag_area_' WHEN 6 THEN 'hardcore_battle_area_' WHEN 7 THEN 'BattleArea' ELSE 'x_resp_' END
    || CAST(p_size AS STRING) AS area
FROM {part}"""


def _stems(spark, sf):
    return spark.sql(_STEMS, part=table(spark, sf, "part"))


_STEMS_SQL = _STEMS.format(part="part")


@query("mission_kinds", f"""
WITH s AS ({_STEMS_SQL}), k AS (SELECT *, lower(area) AS a, CASE WHEN contains(lower(stem), '_bttl') THEN 'bttl' ELSE 'other' END AS kind FROM s)
SELECT id, kind,
  CASE WHEN kind = 'bttl' THEN starts_with(a, 'briefing_t') AND contains(a, '_resp')
    ELSE NOT contains(a, 'killarea') AND (contains(a, 'spawn') OR contains(a, 'resp')) END AS spawn,
  CASE WHEN kind = 'bttl' THEN starts_with(a, 'bttl_t1_capture_area') OR starts_with(a, 'bttl_t2_capture_area')
    ELSE contains(a, 'capture_area') OR contains(a, 'flag_area') OR contains(a, 'capture_zone') END AS capture,
  contains(a, 'battle_area') OR contains(a, 'battlearea') AS battle
FROM k""")
def mission_kinds(spark, sf):
    k = _stems(spark, sf).withColumn("kind", names.mission_kind("stem"))
    return k.select(
        "id", "kind", names.is_spawn("area", "kind").alias("spawn"),
        names.is_capture("area", "kind").alias("capture"), names.is_battle("area").alias("battle"),
    )


@query("expand_modes", f"""
WITH s AS ({_STEMS_SQL})
SELECT id, area, 'hardcore' AS mode FROM s UNION ALL SELECT id, area, 'arcade' FROM s WHERE NOT contains(lower(area), 'hardcore')""")
def expand_modes(spark, sf):
    return names.expand_modes(_stems(spark, sf).select("id", "area"), "area")


@query("mission_label", f"""
WITH s AS ({_STEMS_SQL})
SELECT id, CASE WHEN starts_with(lower(stem), 'small_') THEN substr(lower(stem), 7) ELSE lower(stem) END AS label FROM s""")
def mission_label(spark, sf):
    return _stems(spark, sf).select("id", names.mission_label("stem", F.lit("Small")).alias("label"))


_LABELS = """
SELECT p_partkey AS id, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN CAST(p_size AS STRING) || '_' WHEN 1 THEN '' ELSE '07 - ' END
  || CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'bttl' WHEN 1 THEN 'DOM' WHEN 2 THEN 'conq_' WHEN 3 THEN 'dbldom-' WHEN 4 THEN 'ctf' WHEN 5 THEN 'as ' ELSE 'zz_' END
  || CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN '_a' WHEN 2 THEN '_a_b' ELSE '-x y' END AS label
FROM {part}"""


@query("mission_full_name", f"""
WITH l AS ({_LABELS.format(part='part')}),
t AS (SELECT id, label, regexp_replace(lower(trim(label)), '^[0-9]+[-_ ]*', '') AS token FROM l),
p AS (SELECT *, list_filter(string_split_regex(token, '[-_ ]+'), lambda s: s <> '') AS parts FROM t),
d(k, v) AS (VALUES ('bttl', 'Battle'), ('dbttl', 'Double Battle'), ('dbttla', 'Double Battle A'), ('dbttlb', 'Double Battle B'), ('conq', 'Conquest'),
  ('dom', 'Domination'), ('ctf', 'Capture the Flag'), ('as', 'Assault'), ('ash', 'Ashes'), ('dbldom', 'Double Domination'))
SELECT id, CASE WHEN label = '' THEN 'Mission' WHEN w.v IS NOT NULL THEN w.v
  WHEN h.v IS NOT NULL THEN h.v || CASE WHEN len(parts) > 1 THEN ' ' || array_to_string(parts[2:], ' ') ELSE '' END
  ELSE trim(label) END AS full_name
FROM p LEFT JOIN d w ON w.k = p.token LEFT JOIN d h ON h.k = p.parts[1]""")
def mission_full_name(spark, sf):
    labels = spark.sql(_LABELS, part=table(spark, sf, "part"))
    return labels.select("id", names.mission_full_name("label").alias("full_name"))


@query("numeric_label", """
SELECT zone_id, CASE WHEN regexp_matches(name, '_[0-9]') THEN
  chr(CAST(65 + greatest(CAST(regexp_extract(name, '_([0-9]+)', 1) AS BIGINT) - 1, 0) % 26 AS INT)) END AS letter FROM fx_zones""")
def numeric_label(spark, sf):
    return view(spark, sf, "fx_zones").select("zone_id", names.numeric_label("name").alias("letter"))


@query("grid_row_label", """
SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr(CAST(65 + p_partkey AS INT))
  WHEN p_partkey < 702 THEN chr(CAST(65 + p_partkey // 26 - 1 AS INT)) || chr(CAST(65 + p_partkey % 26 AS INT))
  ELSE chr(CAST(65 + (p_partkey // 26 - 1) // 26 - 1 AS INT)) || chr(CAST(65 + (p_partkey // 26 - 1) % 26 AS INT)) || chr(CAST(65 + p_partkey % 26 AS INT)) END AS label
FROM part""")
def grid_row_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.grid_row_label("p_partkey").alias("label"))


_TEX = """
SELECT p_partkey AS id, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN p_name || '*' WHEN 1 THEN 'a*' || p_name || '$x$y' WHEN 2 THEN REPLACE(p_name, ' ', '?') ELSE 'detail_' || p_name || '_tex_d' END AS raw
FROM {part}"""


@query("sanitize_texture_name", f"""
WITH t AS ({_TEX.format(part='part')})
SELECT id, split_part(replace(replace(raw, '*', ''), '?', '_'), '$', 1) AS name,
  regexp_replace(regexp_replace(raw, '_tex_d$', ''), '^detail_', '') AS short FROM t""")
def sanitize_texture_name(spark, sf):
    t = spark.sql(_TEX, part=table(spark, sf, "part"))
    return t.select("id", names.sanitize_texture_name("raw").alias("name"), names.texture_name_short("raw").alias("short"))


def details(df):
    """The detail columns of the landclass view as one map."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("R", "d_r"), ("G", "d_g"), ("B", "d_b"))])
    return df.withColumn("details", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))).drop("d_r", "d_g", "d_b")


CANDIDATES_SQL = """
c AS (SELECT map_id, lc_idx, trim(name) AS n, replace(trim(coalesce(texture, '')), '*', '') AS t, d_r, d_g, d_b, trim(name) AS name_key, texture, name FROM fx_lcs),
cand AS (SELECT *, list_filter([
  CASE WHEN t <> n THEN t END, n, CASE WHEN n <> '' THEN n || '_tex_d' END,
  d_r, CASE WHEN starts_with(d_r, 'detail_') THEN substr(d_r, 8) END,
  d_g, CASE WHEN starts_with(d_g, 'detail_') THEN substr(d_g, 8) END,
  d_b, CASE WHEN starts_with(d_b, 'detail_') THEN substr(d_b, 8) END], lambda s: s IS NOT NULL AND s <> '') AS raw FROM c),
ranked AS (SELECT map_id, lc_idx, unnest(raw) AS candidate, generate_subscripts(raw, 1) - 1 AS rank FROM cand),
first_rank AS (SELECT map_id, lc_idx, candidate, min(rank) AS rank FROM ranked GROUP BY ALL)
"""


@query("texture_candidates", f"""
WITH {CANDIDATES_SQL}
SELECT map_id, lc_idx, string_agg(candidate, '|' ORDER BY rank) AS candidates FROM first_rank GROUP BY map_id, lc_idx""")
def texture_candidates(spark, sf):
    lcs = details(view(spark, sf, "fx_lcs"))
    found = names.texture_candidates("name", "texture", "details")
    return lcs.select("map_id", "lc_idx", F.array_join(found, "|").alias("candidates"))


@query("detail_candidates", f"""
WITH t AS ({_TEX.format(part='part')}), l AS (SELECT id, list_filter([raw,
  CASE WHEN starts_with(raw, 'detail_') THEN substr(raw, 8) END, CASE WHEN starts_with(raw, 'detail_') THEN substr(raw, 8) || '_tex_d' END,
  CASE WHEN NOT suffix(raw, '_tex_d') THEN raw || '_tex_d' END], lambda s: s IS NOT NULL AND s <> '') AS c FROM t)
SELECT id, array_to_string(c, '|') AS candidates FROM l""")
def detail_candidates(spark, sf):
    t = spark.sql(_TEX, part=table(spark, sf, "part"))
    return t.select("id", F.array_join(names.detail_candidates("raw"), "|").alias("candidates"))


@query("distinct_candidates", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY doc_id, w)
SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM f GROUP BY doc_id""")
def distinct_candidates(spark, sf):
    words = F.array_distinct(F.split("text", " "))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ")).alias("digest")
    )


@query("sanitize_det", """
WITH o AS (SELECT map_id, lc_idx FROM fx_lcs WHERE starts_with(lower(name), 'ocean') OR contains(lower(name), '_ocean')),
d AS (SELECT map_id, cell, unnest([det0, det1, det2, det3, det4, det5, det6]) AS v, unnest([0, 1, 2, 3, 4, 5, 6]) AS slot, det0 FROM fx_cells),
j AS (SELECT d.*, o.lc_idx IS NOT NULL AS wet, b.lc_idx IS NOT NULL AS base_wet FROM d
  LEFT JOIN o ON o.map_id = d.map_id AND o.lc_idx = d.v LEFT JOIN o b ON b.map_id = d.map_id AND b.lc_idx = d.det0)
SELECT map_id, cell, string_agg(CAST(CASE WHEN NOT base_wet AND slot > 0 AND v <> 255 AND wet THEN 255 ELSE v END AS VARCHAR), ',' ORDER BY slot) AS det
FROM j GROUP BY map_id, cell""")
def sanitize_det(spark, sf):
    from ..operators.scans import join_dim

    ocean = view(spark, sf, "fx_lcs").groupBy("map_id").agg(
        F.collect_set(F.when(names.is_ocean_lc("name"), F.col("lc_idx"))).alias("ocean")
    )
    joined = join_dim(cells_with_det(spark, sf), ocean, ["map_id"], ["cell"], "left")
    return joined.select("map_id", "cell", F.array_join(names.sanitize_det("det", "ocean").cast("array<string>"), ",").alias("det"))


def cells_with_det(spark, sf):
    return view(spark, sf, "fx_cells").withColumn("det", F.array(*[f"det{i}" for i in range(7)])).drop(*[f"det{i}" for i in range(7)])


@query("format_metres", """
SELECT event_id, CASE WHEN v <= 0 THEN '-- m' WHEN v >= 1000 THEN printf('%.2f km', v / 1000) ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) || ' m' END AS viewer,
  CASE WHEN v <= 0 THEN '-- M' WHEN v >= 1000 THEN printf('%.2f KM', v / 1000) WHEN v >= 100 THEN CAST(CAST(round(v) AS BIGINT) AS VARCHAR) || ' M' ELSE printf('%.1f M', v) END AS tactical
FROM (SELECT event_id, value * 7.1237 - 20 AS v FROM events)""")
def format_metres(spark, sf):
    v = table(spark, sf, "events").select("event_id", (F.col("value") * 7.1237 - 20).alias("v"))
    return v.select("event_id", geo.format_metres("v").alias("viewer"), geo.format_metres("v", "tactical").alias("tactical"))


@query("format_bytes", """
SELECT l_orderkey, l_linenumber, n, CASE WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0) || ' (' || n || ' B)'
  WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0) || ' (' || n || ' B)' ELSE n || ' B' END AS label
FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS n FROM lineitem)""")
def format_bytes(spark, sf):
    n = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("long").alias("n"))
    return n.withColumn("label", codec.format_bytes("n"))
