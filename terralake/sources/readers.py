"""Reading levels, metadata, missions and manifests.

Every reader has a ``parse_*`` twin that works on a table of file contents, so that contents may come
from files, from a table or from a stream alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import json_number, num_or_first, vec2
from ..functions.geo import tm_half_size, tm_position, tm_radius
from ..functions.names import (
    is_battle,
    is_capture,
    is_spawn,
    is_squad_spawn,
    mission_kind,
    mission_label,
    modes_of,
    numeric_label,
    team_of,
)

# ---- fixed values ----------------------------------------------------------------------------
LEVEL_SUFFIX = ".bin"
PACK_SUFFIX = ".dxp.bin"
MISSION_SUFFIX = ".blkx"
DEFAULT_COORD = 32768.0

MISSION_SCHEMA = (
    "units struct<area_squad: array<struct<name: string, tm: array<array<double>>,"
    " props: struct<squad_members: array<string>>>>>,"
    " areas map<string, struct<tm: array<array<double>>>>"
)

_LAYER = "struct<file: string, width: int, height: int, world_extent: array<double>, height_min_m: double, height_max_m: double>"
MANIFEST_SCHEMA = (
    "mapName string, mapCoord0 array<double>, mapCoord1 array<double>, mapSize array<double>,"
    " waterLevel double, averageGroundLevel double, customLevelMap string,"
    " tankZone struct<coord0: array<double>, coord1: array<double>, gridSize: double>,"
    " location struct<latitude: double, longitude: double>,"
    f" heightmap {_LAYER}, colormap struct<file: string, width: int, height: int>,"
    f" terrainPaint struct<file: string, width: int, height: int>, tileGrid {_LAYER},"
    " layers array<struct<layer: string, width: int, height: int, world_extent: array<double>>>,"
    " landclasses array<struct<lc_idx: int, name: string, texture: string>>,"
    " pools array<struct<pool_idx: int, name: string, category: string, count: bigint>>, instanceCount bigint, poolCount bigint,"
    f" normalMap {_LAYER}, heightmapDetail {_LAYER}, tiles array<struct<index: int, file: string>>,"
    " materials array<struct<name: string, file: string>>, sun struct<azimuth: double, elevation: double>,"
    " hasMissions boolean"
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Paths and sizes below a folder; file contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(root).select("path", F.col("length").alias("bytes"))


# ---- levels ----------------------------------------------------------------------------------


def level_names(files: DataFrame) -> DataFrame:
    """Levels among file paths: ``*.bin`` without texture packs, by name."""
    named = files.select("path", file_name(F.col("path")).alias("_name"))
    level = F.col("_name").endswith(LEVEL_SUFFIX) & ~F.col("_name").endswith(PACK_SUFFIX)
    stem = F.col("_name").substr(F.lit(1), F.length("_name") - len(LEVEL_SUFFIX))
    return named.filter(level).select(stem.alias("map_id"), "path").orderBy("map_id")


def discover_levels(spark: SparkSession, root: str) -> DataFrame:
    levels = level_names(list_files(spark, root, "*" + LEVEL_SUFFIX))
    if levels.isEmpty():
        raise FileNotFoundError(f"no levels below {root}")
    return levels


# ---- level metadata --------------------------------------------------------------------------


def parse_level_meta(files: DataFrame, text: str = "text") -> DataFrame:
    """Level settings from JSON documents (``map_id`` and the text); broken JSON counts as empty."""
    d = files.withColumn("_doc", F.when(F.try_parse_json(text).isNotNull(), F.col(text)).otherwise("{}"))
    low = F.array(F.lit(-DEFAULT_COORD), F.lit(-DEFAULT_COORD))
    high = F.array(F.lit(DEFAULT_COORD), F.lit(DEFAULT_COORD))
    t0, t1 = vec2("_doc", "$.tankMapCoord0"), vec2("_doc", "$.tankMapCoord1")

    def place(key: str) -> Column:
        return F.coalesce(json_number("_doc", f"$.{key}"), json_number("_doc", f"$.stars.{key}"))

    zone = F.when(
        t0.isNotNull() & t1.isNotNull(),
        F.struct(t0.alias("coord0"), t1.alias("coord1"), num_or_first("_doc", "$.tankGridSize").alias("grid_size")),
    )
    out = d.withColumns({
        "coord0": F.coalesce(vec2("_doc", "$.mapCoord0"), low),
        "coord1": F.coalesce(vec2("_doc", "$.mapCoord1"), high),
        "water_level": num_or_first("_doc", "$.water_level"),
        "average_ground_level": num_or_first("_doc", "$.average_ground_level"),
        "custom_level_map": F.get_json_object("_doc", "$.customLevelMap"),
        "tank_zone": zone,
        "latitude": place("latitude"),
        "longitude": place("longitude"),
    })
    return out.withColumn("map_size", F.zip_with("coord1", "coord0", lambda b, a: b - a)).drop("_doc", text)


def read_level_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).select(
        stem_of(F.col("_metadata.file_path")).alias("map_id"), F.col("value").alias("text")
    )
    return parse_level_meta(raw)


# ---- missions --------------------------------------------------------------------------------


def parse_missions(files: DataFrame, text: str = "text") -> DataFrame:
    """Zones of mission documents (``map_id, file, stem, suffix`` and the text).

    All zones of a document are derived inside its own row and exploded once: no join, no shuffle. A document
    without zones keeps one row whose zone columns are null.
    """
    doc = files.withColumn("_doc", F.from_json(F.col(text), MISSION_SCHEMA)).filter(F.col("_doc").isNotNull())
    doc = doc.withColumn("mission_kind", mission_kind("stem")).withColumn("mission", mission_label("stem", "suffix"))
    doc = doc.withColumn("_squads", F.filter(
        F.coalesce(F.col("_doc.units.area_squad"), F.array().cast("array<struct<name:string,tm:array<array<double>>,props:struct<squad_members:array<string>>>>")),
        lambda s: is_squad_spawn(s["name"]) & tm_position(s["tm"]).isNotNull(),
    ))
    members = F.flatten(F.transform("_squads", lambda s: F.coalesce(s["props"]["squad_members"], F.array().cast("array<string>"))))
    doc = doc.withColumn("_members", members).withColumn("_areas", F.map_entries(
        F.coalesce(F.col("_doc.areas"), F.create_map().cast("map<string,struct<tm:array<array<double>>>>"))
    ))
    kind = F.col("mission_kind")
    none = F.lit(None).cast("double")

    def zone(label: str, name: Column, tm: Column, radius: Column = none, half: Column | None = None,
             letter: Column | None = None, team: Column | None = None) -> Column:
        at = tm_position(tm)
        return F.struct(
            F.lit(label).alias("kind"), F.coalesce(name, F.lit("")).alias("name"),
            (team if team is not None else F.lit(None).cast("int")).alias("team"),
            at["x"].alias("x"), at["z"].alias("z"), radius.alias("radius"),
            (half["hx"] if half is not None else none).alias("hx"), (half["hz"] if half is not None else none).alias("hz"),
            (letter if letter is not None else F.lit(None).cast("string")).alias("label"),
        )

    def placed(a: Column) -> Column:
        return tm_position(a["value"]["tm"]).isNotNull()

    squad_spawns = F.transform("_squads", lambda s: zone("spawn", s["name"], s["tm"], team=team_of(F.coalesce(s["name"], F.lit("")))))

    def spawn_zones(label: str) -> Column:
        hits = F.filter("_areas", lambda a: is_spawn(a["key"], kind, F.array_contains("_members", a["key"])) & placed(a))
        return F.transform(hits, lambda a: zone(label, a["key"], a["value"]["tm"], team=team_of(a["key"])))

    captures = F.transform(
        F.filter("_areas", lambda a: is_capture(a["key"], kind) & placed(a) & tm_radius(a["value"]["tm"]).isNotNull()),
        lambda a: zone("capture", a["key"], a["value"]["tm"], radius=tm_radius(a["value"]["tm"]),
                       letter=numeric_label(F.lower(a["key"]))),
    )
    battles = F.transform(
        F.filter("_areas", lambda a: is_battle(a["key"]) & placed(a) & tm_half_size(a["value"]["tm"]).isNotNull()),
        lambda a: zone("battle", a["key"], a["value"]["tm"], half=tm_half_size(a["value"]["tm"])),
    )
    spawns = F.when(kind == "bttl", spawn_zones("spawn")).otherwise(squad_spawns)
    every = F.concat(spawns, spawn_zones("spawn_zone"), captures, battles)
    rows = doc.select("map_id", "file", "mission", "mission_kind", F.explode_outer(every).alias("_z"))
    return rows.select("map_id", "file", "mission", "mission_kind", "_z.*").withColumn("mode", F.explode_outer(modes_of("name")))


def read_missions(spark: SparkSession, root: str | list[str], recursive: bool = True) -> DataFrame:
    """Zones of all mission files below one or more folders; a file's folder names its map suffix."""
    reader = spark.read.option("pathGlobFilter", "*" + MISSION_SUFFIX)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    path = F.col("_metadata.file_path")
    raw = reader.text(root, wholetext=True).select(
        parent_name(path).alias("map_id"), path.alias("file"), stem_of(path).alias("stem"),
        parent_name(path).alias("suffix"), F.col("value").alias("text"),
    )
    return parse_missions(raw.filter(~F.lower("stem").startswith("template_")))


def mission_files(spark: SparkSession, ground_root: str | None, air_roots: list[str]) -> DataFrame:
    """Files offered to ``missions_for_maps``: ground folders and all air folders, recursively."""
    def listed(root: str, air: bool) -> DataFrame:
        return list_files(spark, root, "*" + MISSION_SUFFIX, recursive=True).select(
            F.col("path").alias("file"), parent_name(F.col("path")).alias("folder"),
            stem_of(F.col("path")).alias("stem"), F.lit(air).alias("air"),
        )

    parts = [listed(r, True) for r in air_roots] + ([listed(ground_root, False)] if ground_root else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- manifests -------------------------------------------------------------------------------


def parse_manifests(files: DataFrame, text: str = "text") -> DataFrame:
    """Manifest documents as rows; unreadable ones are dropped."""
    doc = F.from_json(F.col(text), MANIFEST_SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    parsed = files.withColumn("_m", doc).filter(F.col("_m").isNotNull() & F.col("_m._broken").isNull())
    return parsed.select("map_id", "_m.*").drop("_broken")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All ``manifest.json`` below a folder; a manifest's folder names its map."""
    path = F.col("_metadata.file_path")
    raw = (
        spark.read.option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true")
        .text(root, wholetext=True).select(parent_name(path).alias("map_id"), F.col("value").alias("text"))
    )
    return parse_manifests(raw)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Manifests written as JSON lines; the document names its map."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.mapName").alias("map_id"), F.col("value").alias("text"))
    return parse_manifests(lines)


def manifest_summary(manifests: DataFrame) -> DataFrame:
    """Numbers of layers, landclasses and pools, and what a map has, from its manifest."""
    return manifests.select(
        "map_id", *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("int").alias(c) for c in ("layers", "landclasses", "pools")],
        F.coalesce("instanceCount", F.lit(0)).cast("long").alias("instanceCount"), F.coalesce("hasMissions", F.lit(False)).alias("hasMissions"),
        *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("heightmap", "terrainPaint", "colormap")],
    )
