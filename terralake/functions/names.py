"""Names: map categories, object pools, mission kinds, labels and texture names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._col import ColumnOrName, alternatives, col, num

# ---- fixed values: results depend on these exact words and on their order -------------------

MAP_PREFIXES = ["avg", "air", "avn", "arcade"]
CATEGORY_LABELS = {
    "avg": "Ground",
    "air": "Air",
    "avn": "Naval",
    "arcade": "Arcade",
    "other": "Classic",
}

# Object pool categories, first match wins.
POOL_RULES = [
    ("tree", ["tree", "palm"]),
    ("bush", ["bush", "shrub", "hedge"]),
    ("vegetation", ["grass", "weed", "flower", "plant", "fern", "reed"]),
    ("building", [
        "house", "building", "build", "barn", "church", "mosque", "palace", "castle", "tower",
        "factory", "warehouse", "hangar", "bunker", "shelter", "pillbox", "barrack", "hospital",
        "school", "shop", "hotel", "station", "industrial", "admin", "fortress", "courtyard",
    ]),
    ("infrastructure", [
        "fence", "wall", "gate", "column", "lattice", "embankment", "lamppost", "pole", "sign",
        "rail", "bridge", "road", "pipe", "wire", "cable",
    ]),
    ("rock", ["rock", "stone", "boulder", "cliff"]),
    ("debris", [
        "debris", "wreck", "ruin", "rubble", "crater", "sandbag", "hedgehog", "barbed", "trench",
    ]),
]

STYLE_VEGETATION = ["tree", "bush", "shrub", "grass", "reed", "fern", "vegetation"]
STYLE_BUILDING = [
    "container", "warehouse", "hangar", "building", "house", "shed", "garage", "barrack",
    "port_crane", "crane", "terminal", "tower", "bunker", "fort", "wall", "bridge", "pillbox",
    "blockhouse", "castle", "church", "mosque", "factory", "plant", "station", "depot", "yard",
    "dock", "pier",
]
STYLE_ROAD = [
    "road", "street", "highway", "asphalt", "pavement", "runway", "taxiway", "track", "path",
]
STYLE_EARTHWORK = ["trench", "ditch", "foxhole", "earthwork", "embankment"]
STYLE_DEBRIS = ["wreck", "ruin", "rubble", "debris", "hedgehog", "barbed"]
OCCLUDER_WORDS = [
    "container", "warehouse", "hangar", "building", "house", "shed", "garage", "barrack", "tower",
    "fort", "bunker", "pillbox", "blockhouse", "castle", "church", "mosque", "factory", "plant",
    "station", "depot", "yard",
]

MISSION_NAMES = {
    "bttl": "Battle",
    "dbttl": "Double Battle",
    "dbttla": "Double Battle A",
    "dbttlb": "Double Battle B",
    "conq": "Conquest",
    "dom": "Domination",
    "ctf": "Capture the Flag",
    "as": "Assault",
    "ash": "Ashes",
    "dbldom": "Double Domination",
}

DETAIL_KEYS = ["R", "G", "B", "K"]

# ---- maps ------------------------------------------------------------------------------------


def map_category(name: ColumnOrName) -> Column:
    c = col(name)
    out = F.when(c.startswith(MAP_PREFIXES[0] + "_"), MAP_PREFIXES[0])
    for prefix in MAP_PREFIXES[1:]:
        out = out.when(c.startswith(prefix + "_"), prefix)
    return out.otherwise("other")


def category_label(category: ColumnOrName) -> Column:
    c = col(category)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, label in CATEGORY_LABELS.items():
        out = out.when(c == key, label)
    return out


def title_words(text: ColumnOrName) -> Column:
    """Capitalise every word start; unlike ``initcap`` the rest of a word keeps its case."""
    pieces = F.split(col(text), r"(?<=\W)(?=\w)")
    up = F.transform(pieces, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s))))
    return F.array_join(up, "")


def display_name(name: ColumnOrName) -> Column:
    bare = F.regexp_replace(col(name), "^" + alternatives(MAP_PREFIXES) + "_", "")
    return title_words(F.translate(bare, "_", " "))


def map_suffix(name: ColumnOrName) -> Column:
    """Text after the first underscore, or the whole name."""
    c = col(name)
    at = F.instr(c, "_")
    return F.when(at > 0, c.substr(at + 1, F.length(c))).otherwise(c)


def gallery(index: DataFrame, category: str = "all", search: str | None = None) -> DataFrame:
    """Maps not marked as failed, optionally of one category and matching a search text."""
    out = index
    if "success" in index.columns:
        out = out.filter(F.coalesce(F.col("success"), F.lit(True)))
    if category and category != "all":
        out = out.filter(map_category("name") == category)
    if search:
        q = search.lower()
        out = out.filter(
            F.lower("name").contains(q) | F.lower(display_name("name")).contains(q)
        )
    return out


# ---- objects ---------------------------------------------------------------------------------


def pool_category(name: ColumnOrName) -> Column:
    n = F.lower(col(name))
    out = None
    for category, words in POOL_RULES:
        hit = n.rlike(alternatives(words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")


def render_style(category: ColumnOrName, name: ColumnOrName, dialect: str = "viewer") -> Column:
    """Drawing style of an object. The two dialects differ in rule order and in word boundaries."""
    cat = F.coalesce(col(category), F.lit("other"))
    n = F.lower(F.coalesce(col(name), F.lit("")))
    building = n.rlike(alternatives(STYLE_BUILDING))
    earthwork = (cat == "debris") & n.rlike(alternatives(STYLE_EARTHWORK))
    debris = (cat == "debris") & n.rlike(alternatives(STYLE_DEBRIS))
    if dialect == "viewer":
        road = n.rlike("(^|[^a-z])" + alternatives(STYLE_ROAD) + "([^a-z]|$)")
        head = F.when(building, "building")
    elif dialect == "map":
        road = n.rlike(alternatives(STYLE_ROAD))
        green = (cat == "tree") | n.rlike(alternatives(STYLE_VEGETATION))
        tree = (cat == "tree") | n.contains("tree")
        head = F.when(green & tree, "tree").when(green, "vegetation").when(building, "building")
    else:
        raise ValueError(f"unknown dialect {dialect!r}")
    return head.when(road, "road").when(earthwork, "earthwork").when(debris, "debris").otherwise(cat)


def is_occluder(category: ColumnOrName, name: ColumnOrName, style: ColumnOrName) -> Column:
    cat = F.coalesce(col(category), F.lit("other"))
    n = F.lower(F.coalesce(col(name), F.lit("")))
    return (col(style) == "building") | (cat == "building") | n.rlike(alternatives(OCCLUDER_WORDS))


# ---- missions --------------------------------------------------------------------------------


def team_of(name: ColumnOrName) -> Column:
    tokens = F.split(F.lower(col(name)), "[^a-z0-9]+")
    first = F.arrays_overlap(tokens, F.array(F.lit("t1"), F.lit("team1")))
    second = F.arrays_overlap(tokens, F.array(F.lit("t2"), F.lit("team2")))
    return F.when(first, 1).when(second, 2).otherwise(0).cast("int")


def mission_kind(stem: ColumnOrName) -> Column:
    return F.when(F.lower(col(stem)).contains("_bttl"), "bttl").otherwise("other")


def is_squad_spawn(name: ColumnOrName) -> Column:
    n = F.lower(F.coalesce(col(name), F.lit("")))
    return ~n.contains("killarea") & (n.contains("spawn") | n.contains("resp"))


def is_spawn(name: ColumnOrName, kind: ColumnOrName, member: ColumnOrName | bool = False) -> Column:
    """Spawn area by name; ``member`` marks areas that an accepted squad refers to."""
    n = F.lower(col(name))
    named = F.lit(member) if isinstance(member, bool) else F.coalesce(col(member), F.lit(False))
    briefing = n.startswith("briefing_t") & n.contains("_resp")
    other = named | is_squad_spawn(name)
    return F.when(col(kind) == "bttl", briefing).otherwise(other)


def is_capture(name: ColumnOrName, kind: ColumnOrName) -> Column:
    n = F.lower(col(name))
    bttl = n.startswith("bttl_t1_capture_area") | n.startswith("bttl_t2_capture_area")
    other = n.contains("capture_area") | n.contains("flag_area") | n.contains("capture_zone")
    return F.when(col(kind) == "bttl", bttl).otherwise(other)


def is_battle(name: ColumnOrName) -> Column:
    n = F.lower(col(name))
    return n.contains("battle_area") | n.contains("battlearea")


def modes_of(name: ColumnOrName) -> Column:
    hard = F.lower(col(name)).contains("hardcore")
    return F.when(hard, F.array(F.lit("hardcore"))).otherwise(
        F.array(F.lit("arcade"), F.lit("hardcore"))
    )


def expand_modes(df: DataFrame, name: str = "name", out: str = "mode") -> DataFrame:
    """One row per game mode the named entity takes part in."""
    return df.withColumn(out, F.explode(modes_of(name)))


def mission_label(stem: ColumnOrName, suffix: ColumnOrName) -> Column:
    lower = F.lower(col(stem))
    prefix = F.concat(F.lower(col(suffix)), F.lit("_"))
    return F.when(
        lower.startswith(prefix), lower.substr(F.length(prefix) + 1, F.length(lower))
    ).otherwise(lower)


def mission_full_name(label: ColumnOrName) -> Column:
    c = col(label)
    raw = F.trim(c)
    token = F.regexp_replace(F.lower(raw), r"^\d+[_\-\s]*", "")
    parts = F.filter(F.split(token, r"[_\-\s]+"), lambda s: s != "")
    table = F.create_map(*[F.lit(v) for kv in MISSION_NAMES.items() for v in kv])
    whole = F.try_element_at(table, token)
    head = F.try_element_at(table, F.get(parts, F.lit(0)))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.when(F.size(parts) > 1, F.concat(head, F.lit(" "), F.array_join(rest, " "))).otherwise(head)
    return (
        F.when(c.isNull() | (c == ""), "Mission")
        .when(whole.isNotNull(), whole)
        .when(head.isNotNull(), named)
        .otherwise(raw)
    )


def numeric_label(name: ColumnOrName) -> Column:
    """Letter for the first ``_<digits>`` part: 1 is A, 26 is Z, 27 is A again."""
    digits = F.regexp_extract(col(name), r"_(\d+)", 1)
    n = digits.try_cast("long")
    letter = F.char(F.lit(65) + F.pmod(F.greatest(n - 1, F.lit(0)), F.lit(26)))
    return F.when(n.isNotNull(), letter)


# ---- grid labels -----------------------------------------------------------------------------


def grid_row_label(row: ColumnOrName | int) -> Column:
    """0 is A, 25 is Z, 26 is AA, 702 is AAA."""
    i = num(row).cast("long")

    def letter(v: Column) -> Column:
        return F.char(F.lit(65) + F.pmod(v, F.lit(26)))

    # each further letter stands for what is left of the number; a long has up to 14
    left, label = i, letter(i)
    for _ in range(13):
        left = F.floor(left / 26) - 1
        label = F.concat(F.when(left >= 0, letter(left)).otherwise(""), label)
    return F.when(i >= 0, label)


# ---- textures --------------------------------------------------------------------------------


def sanitize_texture_name(name: ColumnOrName) -> Column:
    return F.substring_index(F.translate(F.translate(col(name), "*", ""), "?", "_"), "$", 1)


def texture_candidates(name: ColumnOrName, texture: ColumnOrName, details: ColumnOrName) -> Column:
    """Names to look up for a landclass, best first and without repeats."""
    n = F.trim(F.coalesce(col(name), F.lit("")))
    tex = F.translate(F.trim(F.coalesce(col(texture), F.lit(""))), "*", "")
    d = col(details)
    found = [
        F.when(tex != n, tex),
        n,
        F.when(n != "", F.concat(n, F.lit("_tex_d"))),
    ]
    for key in DETAIL_KEYS:
        v = F.try_element_at(d, F.lit(key))
        found += [v, F.when(v.startswith("detail_"), v.substr(F.lit(8), F.length(v)))]
    return F.array_distinct(F.filter(F.array(*found), lambda s: s.isNotNull() & (s != "")))


def detail_candidates(name: ColumnOrName) -> Column:
    n = F.trim(F.coalesce(col(name), F.lit("")))
    short = F.when(n.startswith("detail_"), n.substr(F.lit(8), F.length(n)))
    found = F.array(
        n,
        short,
        F.concat(short, F.lit("_tex_d")),
        F.when((n != "") & ~n.endswith("_tex_d"), F.concat(n, F.lit("_tex_d"))),
    )
    return F.array_distinct(F.filter(found, lambda s: s.isNotNull() & (s != "")))


def texture_name_short(name: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(col(name), "_tex_d$", ""), "^detail_", "")


def is_ocean_lc(name: ColumnOrName) -> Column:
    n = F.lower(F.coalesce(col(name), F.lit("")))
    return n.startswith("ocean") | n.contains("_ocean")


def sanitize_det(det: ColumnOrName, ocean_ids: ColumnOrName) -> Column:
    """Without an ocean base, ocean ids in the other slots become 255 (none).

    ``ocean_ids`` is the array of ocean landclass ids of the level (at most 255 entries).
    """
    d, ocean = col(det), F.coalesce(col(ocean_ids), F.array().cast("array<int>"))
    base = F.array_contains(ocean, F.get(d, F.lit(0)))
    cleaned = F.transform(
        d, lambda v, i: F.when((i > 0) & (v != 255) & F.array_contains(ocean, v), F.lit(255)).otherwise(v)
    )
    return F.when(base, d).otherwise(cleaned)


# ---- files -----------------------------------------------------------------------------------

# Where the texture packs of a map may be, most preferred first.
PACK_CANDIDATES = [
    "levels/{map}.dxp.bin",
    "levels/hq_tex_{map}.dxp.bin",
    "levels/{map}-hq.dxp.bin",
    "hq_content/{map}.dxp.bin",
    "hq_content/hq_tex_{map}.dxp.bin",
    "content/{map}.dxp.bin",
    "hq_content/hq_tex_landscape_extra.dxp.bin",
    "content/landscape_extra.dxp.bin",
    "hq_content/hq_tex_avg_{suffix}.dxp.bin",
    "hq_content/hq_tex_{suffix}.dxp.bin",
]


def pack_candidates(map_id: ColumnOrName) -> Column:
    """Array of pack paths to try for a map, in order of preference."""
    m = col(map_id)
    filled = F.transform(
        F.array(*[F.lit(p) for p in PACK_CANDIDATES]),
        lambda p: F.replace(F.replace(p, F.lit("{map}"), m), F.lit("{suffix}"), map_suffix(m)),
    )
    return filled
