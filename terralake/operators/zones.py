"""Mission zones: modes, extents, membership of points, and which mission files serve a map.

Zone table: ``map_id, mission, kind, name, mode, team, x, z, radius, hx, hz, label`` with kind one of
``spawn``, ``spawn_zone``, ``capture``, ``battle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._col import clamp, trunc_long
from ..functions.geo import grid_column, grid_label, grid_row, in_rect
from ..functions.names import map_suffix
from ..session import cut
from .scans import join_dim, ordinal, shuffled

MISSION = ["map_id", "mission"]
MIN_CAPTURE_RADIUS = 30.0


def mission_key(zones: DataFrame) -> list[str]:
    """What tells missions apart: map and label, and the file where the table has it, as two files may share a label."""
    return [*MISSION, *(["file"] if "file" in zones.columns else [])]


def union_zones(spawns: DataFrame, spawn_zones: DataFrame, captures: DataFrame, battles: DataFrame) -> DataFrame:
    """One table from the four kinds; battle missions use their spawn zones as spawns as well.

    The inputs carry ``mission_kind`` (``bttl`` or ``other``).
    """
    own = spawns.filter("mission_kind <> 'bttl'").withColumn("kind", F.lit("spawn"))
    borrowed = spawn_zones.filter("mission_kind = 'bttl'").withColumn("kind", F.lit("spawn"))
    parts = [
        own, borrowed, spawn_zones.withColumn("kind", F.lit("spawn_zone")),
        captures.withColumn("kind", F.lit("capture")), battles.withColumn("kind", F.lit("battle")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _has(mode: str) -> Column:
    return F.max(F.when(F.col("mode") == mode, True).otherwise(False))


def preferred_mode(zones: DataFrame, selected: str = "merged") -> DataFrame:
    """Mode whose zones are shown, per mission and kind."""
    arcade = _has("arcade")
    if selected == "merged":
        mode = F.when(arcade, "arcade").when(_has("hardcore"), "hardcore").otherwise("arcade")
    elif selected == "hardcore":
        mode = F.when(arcade, "arcade").otherwise("hardcore")
    else:
        mode = F.lit(selected)
    return zones.groupBy(*mission_key(zones), "kind").agg(mode.alias("mode"))


def mode_count(zones: DataFrame) -> DataFrame:
    """Zones in the preferred mode, per mission and kind, in one aggregation."""
    arcade, hard = F.count_if(F.col("mode") == "arcade"), F.count_if(F.col("mode") == "hardcore")
    return zones.groupBy(*mission_key(zones), "kind").agg(F.when(arcade > 0, arcade).otherwise(hard).alias("n"))


def mission_summary(zones: DataFrame) -> DataFrame:
    """Battle, capture and spawn counts per mission, with its number in label order; missions without zones count as well."""
    counts = mode_count(zones)

    def total(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))

    summed = counts.groupBy(*mission_key(zones)).agg(
        total("battle").alias("battles"), total("capture").alias("captures"),
        total("spawn", "spawn_zone").alias("spawns"),
    )
    return ordinal(summed, ["map_id"], mission_key(zones)[1:])


def order_missions(missions: DataFrame) -> DataFrame:
    """Number the missions of a map by label, then by file."""
    return ordinal(missions, ["map_id"], ["label", "file"])


def _kind_boxes(zones: DataFrame) -> DataFrame:
    """Bounding box per mission and kind in its preferred mode, without joining back."""
    r = F.greatest(F.abs(F.coalesce("radius", F.lit(MIN_CAPTURE_RADIUS))), F.lit(MIN_CAPTURE_RADIUS))
    ex = F.when(F.col("kind") == "battle", F.abs("hx")).when(F.col("kind") == "capture", r).otherwise(0.0)
    ez = F.when(F.col("kind") == "battle", F.abs("hz")).when(F.col("kind") == "capture", r).otherwise(0.0)
    sized = zones.withColumn("_ex", ex).withColumn("_ez", ez)
    arcade = F.col("mode") == "arcade"

    def pick(fn, value: Column) -> Column:
        return F.when(_has("arcade"), fn(F.when(arcade, value))).otherwise(
            fn(F.when(F.col("mode") == "hardcore", value))
        )

    return sized.groupBy(*mission_key(zones), "kind").agg(
        pick(F.min, F.col("x") - F.col("_ex")).alias("x0"), pick(F.min, F.col("z") - F.col("_ez")).alias("z0"),
        pick(F.max, F.col("x") + F.col("_ex")).alias("x1"), pick(F.max, F.col("z") + F.col("_ez")).alias("z1"),
    ).filter(F.col("x0").isNotNull() & F.col("z0").isNotNull())


def battle_extent(zones: DataFrame) -> DataFrame:
    """Bounding box of the battle areas per mission; missions without any are absent."""
    return _kind_boxes(zones.filter("kind = 'battle'")).drop("kind")


def mission_extent(zones: DataFrame) -> DataFrame:
    """Bounding box of battle areas, capture circles and spawn points per mission."""
    return _kind_boxes(zones).groupBy(*mission_key(zones)).agg(
        F.min("x0").alias("x0"), F.min("z0").alias("z0"), F.max("x1").alias("x1"), F.max("z1").alias("z1")
    )


def crop_rect(zones: DataFrame, maps: DataFrame, sources: DataFrame, min_px: int = 32) -> DataFrame:
    """Part of the source picture to show per mission.

    First known of battle extent, tank zone (``maps``: ``map_id, tx0, tz0, tx1, tz1``) and mission
    extent, clipped to the source (``sources``: ``map_id, x0, z0, x1, z1, width, height``).  Too small
    a part falls back to the whole source.
    """
    corners = ["x0", "z0", "x1", "z1"]
    battle = battle_extent(zones).select(*mission_key(zones), *[F.col(c).alias(f"b_{c}") for c in corners])
    whole = mission_extent(zones).select(*mission_key(zones), *[F.col(c).alias(f"m_{c}") for c in corners])
    src = sources.select("map_id", "width", "height", *[F.col(c).alias(f"s_{c}") for c in corners])
    zone = maps.select("map_id", *[F.col(f"t{c}").alias(f"t_{c}") for c in corners])
    joined = whole.join(battle, mission_key(zones), "left").join(zone, "map_id", "left").join(src, "map_id")
    want = {c: F.coalesce(F.col(f"b_{c}"), F.col(f"t_{c}"), F.col(f"m_{c}")) for c in corners}
    a0, b0 = F.greatest(want["x0"], F.col("s_x0")), F.greatest(want["z0"], F.col("s_z0"))
    a1, b1 = F.least(want["x1"], F.col("s_x1")), F.least(want["z1"], F.col("s_z1"))
    view = {
        "x0": F.least(a0, a1), "z0": F.least(b0, b1), "x1": F.greatest(a0, a1), "z1": F.greatest(b0, b1),
    }

    def pixel(value: Column, axis: str, size: str) -> Column:
        lo, hi = F.col(f"s_{axis}0"), F.col(f"s_{axis}1")
        n = F.col(size).cast("double")
        return trunc_long(clamp((value - lo) / F.greatest(hi - lo, F.lit(1e-6)) * n, F.lit(0.0), n))

    sized = joined.select(
        *MISSION, *[view[c].alias(f"v_{c}") for c in corners], *[f"s_{c}" for c in corners], "width", "height"
    )
    pixels = sized.withColumns({
        "px0": pixel(F.col("v_x0"), "x", "width"), "px1": pixel(F.col("v_x1"), "x", "width"),
        "pz0": pixel(F.col("v_z0"), "z", "height"), "pz1": pixel(F.col("v_z1"), "z", "height"),
    })
    big = (F.col("px1") - F.col("px0") > min_px) & (F.col("pz1") - F.col("pz0") > min_px)
    return pixels.select(
        *MISSION, big.alias("cropped"),
        *[F.when(big, F.col(f"v_{c}")).otherwise(F.col(f"s_{c}")).alias(c) for c in corners],
        F.when(big, F.col("px0")).otherwise(0).alias("px0"), F.when(big, F.col("pz0")).otherwise(0).alias("pz0"),
        F.when(big, F.col("px1")).otherwise(F.col("width")).cast("long").alias("px1"),
        F.when(big, F.col("pz1")).otherwise(F.col("height")).cast("long").alias("pz1"),
    )


def points_in_zones(points: DataFrame, zones: DataFrame, bucket: float = 64.0, salts: int = 8) -> DataFrame:
    """Pairs of points and the zones that contain them (borders included).

    Zones with ``hx, hz`` are boxes, the others circles with ``radius``.  Both sides meet in square
    buckets by an equi-join, followed by the exact test.  Buckets come in levels, each twice as wide as the one before: a
    zone lies in the level where it spans at most two buckets each way, so no zone makes more than four rows per salt, and
    a point looks once into every level in use (the driver reads these few numbers).  Points of one bucket are spread
    over ``salts`` groups, since a third of all points may lie in one place; zones are repeated instead.
    """
    ex = F.when(F.col("hx").isNotNull(), F.abs("hx")).otherwise(F.abs("radius"))
    ez = F.when(F.col("hz").isNotNull(), F.abs("hz")).otherwise(F.abs("radius"))
    width = F.greatest(2 * F.greatest(ex, ez) / bucket, F.lit(1.0))
    sized = zones.filter(ex.isNotNull() & ez.isNotNull()).withColumn("_level", F.ceil(F.log2(width)).cast("int"))
    levels = [r[0] for r in sized.select("_level").distinct().collect()]

    def at(value: Column) -> Column:
        return F.floor(value / (F.lit(float(bucket)) * F.pow(F.lit(2.0), F.col("_level"))))

    def cells(p: str, e: Column) -> Column:
        return F.sequence(at(F.col(p) - e), at(F.col(p) + e))

    z = (
        sized.withColumn("_bx", F.explode(cells("x", ex))).withColumn("_bz", F.explode(cells("z", ez)))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .withColumnsRenamed({"x": "zone_x", "z": "zone_z", "name": "zone_name"})
    )
    p = points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    p = p.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")))
    p = p.withColumn("_bx", at(F.col("x"))).withColumn("_bz", at(F.col("z")))
    dx, dz = F.col("x") - F.col("zone_x"), F.col("z") - F.col("zone_z")
    box = F.col("hx").isNotNull() & (F.abs(dx) <= F.abs("hx")) & (F.abs(dz) <= F.abs("hz"))
    circle = F.col("hx").isNull() & (dx * dx + dz * dz <= F.col("radius") * F.col("radius"))
    return p.join(z, ["map_id", "_level", "_bx", "_bz", "_salt"]).filter(box | circle).drop("_level", "_bx", "_bz", "_salt")


def missions_for_maps(maps: DataFrame, files: DataFrame, gram: int = 4) -> DataFrame:
    """Mission files (``file, folder, stem, air``) of every map.

    Ground maps: files in the folder named like the map's suffix whose stem starts with it.  Air maps:
    files below the air folders whose stem contains the suffix (and thereby also the full name's end).
    The substring test is made an equi-join by the first ``gram`` letters of the suffix.  The maps are written first: then their size is known,
    and few of them are sent to the files, whose many grams aren't shuffled.  Files are never broadcast.
    """
    m = cut(maps.select("map_id", F.lower("map_id").alias("_map"), F.lower(map_suffix("map_id")).alias("_suffix"),
                        map_suffix("map_id").alias("_folder")), "maps")
    f = files.withColumn("_stem", F.lower("stem")).filter(~F.col("_stem").startswith("template_"))
    is_air = F.col("_map").startswith("air_")
    ground = (
        join_dim(f.filter(~F.col("air")).withColumn("_folder", F.col("folder")), m.filter(~is_air), ["_folder"], ["file"], "inner")
        .filter(F.col("_stem").startswith(F.concat(F.col("_suffix"), F.lit("_"))))
    )
    air_maps = m.filter(is_air & (F.col("_suffix") != "")).withColumn("_gram", F.substring("_suffix", 1, gram))
    starts = F.sequence(F.lit(1), F.length("_stem"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(gram)), lambda n: F.col("_stem").substr(i, n)
    ))))
    air_files = f.filter(F.col("air") & (F.length("_stem") > 0)).withColumn("_gram", F.explode(grams))
    air = join_dim(air_files, air_maps, ["_gram"], ["file"], "inner").filter(F.col("_stem").contains(F.col("_suffix")))
    wanted = ["map_id", "file", "stem"]
    return ground.select(*wanted).unionByName(air.select(*wanted))


def map_missions(maps: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """Missions of every map from its files: those that belong to it are found, parsed and counted (``mission_summary`` by map, label and file).

    ``files`` as for ``missions_for_maps``, ``documents`` holds ``file, text``. A file may serve several maps; its text is joined to each.
    """
    from ..sources.readers import parse_missions

    found = missions_for_maps(maps, files).join(shuffled(documents.select("file", "text")), "file")
    return mission_summary(parse_missions(found.withColumn("suffix", map_suffix("map_id"))))


def spawn_semijoin(areas: DataFrame, squads: DataFrame) -> DataFrame:
    """Mark areas (``file, name``) that an accepted squad of the same file lists in ``squad_members``."""
    members = squads.select("file", F.explode("squad_members").alias("name")).distinct().withColumn("member", F.lit(True))
    return areas.join(members, ["file", "name"], "left").withColumn("member", F.coalesce("member", F.lit(False)))


def density_grid(instances: DataFrame, views: DataFrame, n: int = 10) -> DataFrame:
    """Objects per grid square and style inside a view per map."""
    v = views.select("map_id", F.struct("x0", "z0", "x1", "z1").alias("_view"))
    seen = join_dim(instances, v, ["map_id"], ["x", "z"], "inner").filter(in_rect("x", "z", "_view"))
    counted = seen.groupBy(
        "map_id", grid_column("x", "_view", n).alias("_column"), grid_row("z", "_view", n).alias("row"), "style"
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "map_id", (F.col("_column") + 1).alias("column"), "row", grid_label("_column", "row").alias("label"), "style", "n"
    )
