"""Landclasses, textures, tiles, materials and the map index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lc_scale
from ..functions.names import DETAIL_KEYS, detail_candidates, is_ocean_lc, texture_candidates
from .scans import CHUNK, first_match, head_per_group, join_dim, join_keyed, running_sum

NO_LANDCLASS = 255
CLASS_SALTS = 2  # no key has more rows than a level has cells, and there may be about as many landclasses as cells
DET_SLOTS = ["Base", "R", "G", "B", "G2", "R2", "A2"]

# ---- ordered resolution ----------------------------------------------------------------------


def first_existing(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """First candidate path per map that exists; ``candidates`` holds an array ``paths`` per map."""
    asked = candidates.select("map_id", F.posexplode("paths").alias("rank", "path"))
    return first_match(asked.join(files.select("path").distinct(), "path", "left_semi"), ["map_id"], ["rank"])


def _wanted(landclasses: DataFrame) -> DataFrame:
    found = texture_candidates("name", "texture", "details")
    return landclasses.select("map_id", "lc_idx", F.posexplode(found).alias("rank", "candidate"))


def resolve_textures(landclasses: DataFrame, store: DataFrame) -> DataFrame:
    """First candidate name of each landclass that the map's store (``map_id, name``) holds."""
    asked = _wanted(landclasses)
    have = store.select("map_id", F.col("name").alias("candidate")).distinct()
    best = first_match(asked.join(have, ["map_id", "candidate"], "left_semi"), ["map_id", "lc_idx"], ["rank"])
    return landclasses.select("map_id", "lc_idx").join(best, ["map_id", "lc_idx"], "left").select(
        "map_id", "lc_idx", F.col("candidate").alias("resolved"), "rank"
    )


def landclass_materials(landclasses: DataFrame, store: DataFrame, canvas: DataFrame) -> DataFrame:
    """What ``terrain.splat_blend`` paints a landclass with: textures that exist, and their periods in output pixels.

    ``landclasses``: ``map_id, lc_idx, name, texture, details, size, detail_sizes``; ``store``: ``map_id, name``, the textures a map can use; ``canvas``:
    ``map_id, mpp_x, mpp_z``, metres per output pixel (1 where unknown). The base texture is the first candidate in the store, and so is each of the four detail textures (R, G, B, K).
    Periods are metres: at least 8 pixels for the base, at least 1 for details, which take the base period where they have no size of their own.
    """
    base = resolve_textures(landclasses, store).select("map_id", "lc_idx", "resolved")
    named = landclasses.select("map_id", "lc_idx", F.posexplode(F.array(*[F.try_element_at("details", F.lit(k)) for k in DETAIL_KEYS])).alias("slot", "_n"))
    asked = named.filter(F.col("_n").isNotNull()).select("map_id", "lc_idx", "slot", F.posexplode(detail_candidates("_n")).alias("rank", "candidate"))
    have = store.select("map_id", F.col("name").alias("candidate")).distinct()
    best = first_match(asked.join(have, ["map_id", "candidate"], "left_semi"), ["map_id", "lc_idx", "slot"], ["rank"])
    details = best.groupBy("map_id", "lc_idx").agg(F.map_from_entries(F.collect_list(F.struct("slot", "candidate"))).alias("_d"))
    sized = join_dim(landclasses, canvas.select("map_id", "mpp_x", "mpp_z"), ["map_id"], ["lc_idx"], "left")
    joined = sized.join(base, ["map_id", "lc_idx"], "left").join(details, ["map_id", "lc_idx"], "left")
    metres = lc_scale("size")
    pixel = lambda axis: F.greatest(F.coalesce(F.col(f"mpp_{axis}"), F.lit(1.0)), F.lit(1e-6))
    scale_x = F.greatest(metres["sx"] / pixel("x"), F.lit(8.0))
    own = [F.get("detail_sizes", F.lit(i)) for i in range(4)]
    periods = [F.when(d.isNotNull(), F.greatest(F.greatest(d, F.lit(1.0)) / pixel("x"), F.lit(1.0))).otherwise(scale_x) for d in own]
    return joined.select(
        "map_id", "lc_idx", "name", F.col("resolved").alias("texture"), F.col("texture").alias("authored"),
        scale_x.alias("scale_x"), F.greatest(metres["sy"] / pixel("z"), F.lit(8.0)).alias("scale_y"),
        F.array(*[F.try_element_at("_d", F.lit(i)) for i in range(4)]).alias("detail_textures"), F.array(*periods).alias("detail_scales"),
        is_ocean_lc("name").alias("ocean"),
    )


def select_materials(store: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Textures of a map's store (``map_id, name``) that are kept as materials, in order.

    Left out are terrain tiles (the map's name and a number, or ``tile_``) and the normal maps ``_na16``; with ``allowed`` (``map_id, name``) all others as well.
    """
    last = F.element_at(F.split("name", "_"), -1)
    tile = F.col("name").startswith(F.concat(F.col("map_id").cast("string"), F.lit("_"))) & last.rlike("^[+]?[0-9]+$")
    kept = store.filter(~(tile | F.col("name").startswith("tile_") | F.lower("name").endswith("_na16")))
    if allowed is not None:
        kept = kept.join(allowed.select("map_id", "name").distinct(), ["map_id", "name"], "left_semi")
    return kept.orderBy("map_id", "name")


def wanted_names(landclasses: DataFrame) -> DataFrame:
    return _wanted(landclasses).select("map_id", F.col("candidate").alias("name")).distinct()


def missing_names(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Wanted names (``map_id, name``) the map's own store does not hold."""
    return wanted.join(store.select("map_id", "name"), ["map_id", "name"], "left_anti")


def resolve_from_index(wanted: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names found in the global index with their source, and the names found nowhere, in order.

    Many maps ask for the same shared texture, so wanted rows are spread over a repeated index.
    """
    resolved = join_dim(wanted, index, ["name"], ["map_id"], "inner")
    unresolved = wanted.select("name").distinct().join(index.select("name"), "name", "left_anti").orderBy("name")
    return resolved, unresolved


def build_texture_index(directories: DataFrame) -> DataFrame:
    """One source per texture name: the lowest pack path, then the lowest entry."""
    return (
        directories.filter(F.col("name") != "").groupBy("name")
        .agg(F.min(F.struct("pack", "entry_idx")).alias("_src")).select("name", "_src.pack", "_src.entry_idx")
    )


def dedupe_names(entries: DataFrame, pack: str = "pack", order: str = "entry_idx", name: str = "name",
                 out: str = "unique_name", chunk: int = CHUNK) -> DataFrame:
    """Number repeats of a name inside a pack: name, name_1, name_2, ..."""
    seen = running_sum(entries, [pack, name], order, F.lit(1), "_seen", inclusive=False, chunk=chunk)
    label = F.when(F.col("_seen") == 0, F.col(name)).otherwise(
        F.concat(F.col(name), F.lit("_"), F.col("_seen").cast("string"))
    )
    return seen.withColumn(out, label).drop("_seen")


def first_wins_across_packs(entries: DataFrame) -> DataFrame:
    """One entry per map and name: the pack with the lowest priority number, then the lowest entry."""
    return first_match(entries, ["map_id", "name"], ["pack_priority", "entry_idx"])


# ---- landclasses -----------------------------------------------------------------------------


def merge_landclasses(landclasses: DataFrame) -> DataFrame:
    """One landclass per name, taking each property from the first entry that has it.

    Details are merged key by key, whatever their keys; ``ord`` gives the original order.
    """
    def first(value: Column, known: Column) -> Column:
        return F.min_by(value, F.when(known, F.col("ord")))

    texture = F.col("texture")
    blank = F.coalesce(F.trim(texture) == "", F.lit(True))
    picks = [
        F.min("ord").alias("ord"),
        F.coalesce(first(texture, ~blank), F.min_by(texture, "ord")).alias("texture"),
        first(F.col("size"), F.col("size").isNotNull()).alias("size"),
        first(F.col("detail_sizes"), F.col("detail_sizes").isNotNull()).alias("detail_sizes"),
    ]
    named = landclasses.filter(F.col("name") != "")
    entries = named.select("map_id", "name", "ord", F.explode("details").alias("k", "v")).filter(F.col("v").isNotNull())
    firsts = entries.groupBy("map_id", "name", "k").agg(F.min_by("v", "ord").alias("v"))
    details = firsts.groupBy("map_id", "name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("details")
    )
    merged = named.groupBy("map_id", "name").agg(*picks)
    return join_keyed(merged, details, ["map_id", "name"], "left").withColumn(
        "details", F.coalesce("details", F.create_map().cast("map<string,string>"))
    )


def index_by_name(landclasses: DataFrame) -> DataFrame:
    """Lookup table by name; of repeated names the last one stays."""
    rest = [c for c in landclasses.columns if c not in ("map_id", "name")]
    return (
        landclasses.groupBy("map_id", "name").agg(F.max_by(F.struct(*rest), "lc_idx").alias("_lc"))
        .select("map_id", "name", "_lc.*")
    )


def det_references(cells: DataFrame) -> DataFrame:
    """One row per cell and used landclass slot."""
    refs = cells.select(
        *[c for c in cells.columns if c != "det"], F.posexplode("det").alias("slot", "lc_idx")
    )
    return refs.filter((F.col("lc_idx") != NO_LANDCLASS) & (F.col("slot") < len(DET_SLOTS)))


def cell_landclasses(cells: DataFrame, landclasses: DataFrame) -> DataFrame:
    """Landclasses of every terrain cell by channel, with their detail textures in R, G, B, K order."""
    channel = F.element_at(F.array(*[F.lit(s) for s in DET_SLOTS]), F.col("slot") + 1)
    details = F.filter(
        F.array(*[F.try_element_at(F.col("details"), F.lit(k)) for k in DETAIL_KEYS]),
        lambda s: s.isNotNull() & (s != ""),
    )
    lc = landclasses.select("map_id", "lc_idx", "name", "details")
    joined = join_dim(det_references(cells), lc, ["map_id", "lc_idx"], ["tx", "tz"], "inner", CLASS_SALTS)
    return joined.withColumn("channel", channel).withColumn("detail_names", details).drop("details")


def lc_reference_audit(cells: DataFrame, landclasses: DataFrame, resolved: DataFrame, keep: int = 16) -> DataFrame:
    """Per map: landclass references, invalid ones, resolved and missing textures, first missing names."""
    n = landclasses.groupBy("map_id").agg(F.count(F.lit(1)).alias("_n"))
    refs = join_dim(det_references(cells), n, ["map_id"], ["tx", "tz"], "left")
    counted = refs.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("ref_total"),
        F.count_if(F.col("lc_idx") >= F.coalesce("_n", F.lit(0))).alias("ref_invalid"),
    )
    label = F.coalesce(
        F.when(F.trim("texture") != "", F.trim("texture")), F.when(F.trim("name") != "", F.trim("name")), F.lit("lc")
    )
    state = landclasses.select("map_id", "lc_idx", label.alias("label")).join(
        resolved.select("map_id", "lc_idx", "resolved"), ["map_id", "lc_idx"], "left"
    )
    textures = state.groupBy("map_id").agg(
        F.count_if(F.col("resolved").isNotNull()).alias("resolved"),
        F.count_if(F.col("resolved").isNull()).alias("missing"),
    )
    lost = state.filter(F.col("resolved").isNull()).groupBy("map_id", "label").agg(F.min("lc_idx").alias("at"))
    named = head_per_group(lost, ["map_id"], ["at"], keep).groupBy("map_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("missing_names")
    )
    # a map may have landclasses that no cell uses, and cells without any landclass
    every = counted.join(textures, "map_id", "full").fillna(0, ["ref_total", "ref_invalid", "resolved", "missing"])
    return every.join(named, "map_id", "left")


def extend_landclasses(landclasses: DataFrame, cells: DataFrame) -> DataFrame:
    """Add stand-ins ``lc_i`` for ids that cells use beyond the known landclasses.

    They take texture and size from landclass 0.  Ids are single bytes, so at most 255 are added.
    """
    used = det_references(cells).groupBy("map_id").agg(F.max("lc_idx").alias("_max"))
    known = landclasses.groupBy("map_id").agg((F.max("lc_idx") + 1).alias("_n"))
    first = landclasses.filter("lc_idx = 0").select("map_id", "texture", "size")
    gap = used.join(known, "map_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter("_max >= _n")
    extra = gap.withColumn("lc_idx", F.explode(F.sequence(F.col("_n"), F.col("_max")))).join(first, "map_id", "left")
    padded = extra.select(
        "map_id", F.col("lc_idx").cast("int"), F.concat(F.lit("lc_"), F.col("lc_idx").cast("string")).alias("name"),
        "texture", "size",
    )
    return landclasses.withColumn("padded", F.lit(False)).unionByName(
        padded.withColumn("padded", F.lit(True)), allowMissingColumns=True
    )


# ---- tiles -----------------------------------------------------------------------------------


def assign_export_index(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Number the tiles of populated cells in cell order; a second texture takes a number as well."""
    step = F.when(F.col("populated"), F.when(F.col("has_tex2"), 2).otherwise(1)).otherwise(0)
    counted = running_sum(cells, ["map_id"], "cell", step, "_before", inclusive=False, chunk=chunk)
    return counted.withColumn(
        "export_idx", F.when(F.col("populated"), (F.col("_before") + 1).cast("int"))
    ).drop("_before")


def tile_mapping(tiles: DataFrame, cells: DataFrame, grids: DataFrame, strict: bool = True) -> DataFrame:
    """Cell of every exported tile (``map_id, tile``); tile 0 and tiles beyond the grid are dropped.

    Tiles no cell claims are second textures: dropped when ``strict``, else put at ``tile - 1``.
    """
    claimed = cells.filter(F.col("export_idx").isNotNull()).select("map_id", F.col("export_idx").alias("tile"), "cell")
    joined = tiles.filter("tile <> 0").join(claimed, ["map_id", "tile"], "inner" if strict else "left")
    placed = joined.withColumn("cell", F.coalesce("cell", F.col("tile") - 1))
    sized = join_dim(placed, grids.select("map_id", "cols", "rows"), ["map_id"], ["tile"], "inner")
    return sized.filter(F.floor(F.col("cell") / F.col("cols")) < F.col("rows")).select(
        *tiles.columns, "cell",
        (F.col("cell") % F.col("cols")).cast("int").alias("tx"), F.floor(F.col("cell") / F.col("cols")).cast("int").alias("tz"),
    )


def protected_cells(cells: DataFrame) -> DataFrame:
    """Mark cells that the water mask must leave alone: with a tile or with a base landclass."""
    base = F.get(F.col("det"), F.lit(0))
    return cells.withColumn("protected", F.col("export_idx").isNotNull() | (base != NO_LANDCLASS))


def tile_fill_audit(cells: DataFrame, min_fill: float = 0.02) -> DataFrame:
    """Share of populated cells per map; maps below the limit are not accepted."""
    fill = F.avg(F.col("populated").cast("double"))
    return cells.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("populated").alias("populated"), (fill >= min_fill).alias("accepted")
    )


# ---- textures --------------------------------------------------------------------------------


def texture_channel_stats(pixels: DataFrame, keys: tuple[str, ...] = ("map_id", "name")) -> DataFrame:
    return pixels.groupBy(*keys).agg(
        F.avg("r").alias("r_mean"), F.avg("b").alias("b_mean"), F.stddev_pop("a").alias("a_std")
    )


def is_normalmap(stats: DataFrame) -> DataFrame:
    """Mark textures whose channels look like a packed normal map."""
    flag = (F.col("r_mean") < 10) & (F.col("b_mean") > 220) & (F.col("a_std") > 3)
    return stats.withColumn("normal", flag)


def pick_overview(textures: DataFrame, stats: DataFrame, min_side: int = 1024) -> DataFrame:
    """Overview picture per map: first large colour texture by name, else the first normal map."""
    named = F.col("name").startswith(F.concat(F.col("map_id").cast("string"), F.lit("_")))
    large = textures.filter(named & (F.col("w") >= min_side) & (F.col("h") >= min_side))
    judged = large.join(is_normalmap(stats).select("map_id", "name", "normal"), ["map_id", "name"], "left")
    normal = (F.col("fmt") == "DXT5") & F.coalesce("normal", F.lit(False))
    picked = judged.groupBy("map_id").agg(
        F.min(F.when(~normal, F.col("name"))).alias("colormap"), F.min(F.when(normal, F.col("name"))).alias("normalmap")
    )
    return picked.withColumn("normalmap", F.when(F.col("colormap").isNull(), F.col("normalmap")))


def dedupe_materials(materials: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """Shared store name per material: other content under a taken name gets a hash suffix.

    The content of the first map (then the lowest hash) keeps the plain name.
    """
    hashed = materials.withColumn("sha", F.sha2(F.col(body).cast("binary"), 256))
    contents = hashed.groupBy(name, "sha").agg(F.min("map_id").alias("_first"))
    plain = contents.groupBy(name).agg(F.min_by("sha", F.struct("_first", "sha")).alias("_plain"))
    joined = join_dim(hashed, plain, [name], ["sha"], "inner")
    store = F.when(F.col("sha") == F.col("_plain"), F.col(name)).otherwise(
        F.concat(F.col(name), F.lit("_"), F.col("sha"))
    )
    return joined.withColumn("store_name", store).drop("_plain")


# ---- map index -------------------------------------------------------------------------------


def map_summary(maps: DataFrame, landclasses: DataFrame, materials: DataFrame) -> DataFrame:
    """Landclass and material counts next to each map."""
    lc = landclasses.groupBy("map_id").agg(F.count(F.lit(1)).alias("landclasses"))
    mat = materials.groupBy("map_id").agg(F.count(F.lit(1)).alias("materials"))
    joined = maps.join(lc, "map_id", "left").join(mat, "map_id", "left")
    return joined.fillna(0, ["landclasses", "materials"])


def upsert_index(current: DataFrame, updates: DataFrame, key: str = "name", position: str = "pos") -> DataFrame:
    """Replace entries in place, append new ones after the last in key order.

    Only genuinely new keys are numbered; existing entries keep their position. A null key is a key like any other.
    """
    from .scans import join_keyed, ordinal

    cur = current.select(key, F.struct(*[c for c in current.columns if c != key]).alias("_old"))
    new = updates.select(key, F.struct(*[c for c in updates.columns if c != key]).alias("_new"))
    values = [c for c in current.columns if c not in (key, position)]
    kept = join_keyed(cur, new, [key], "left").select(
        key, F.col(f"_old.{position}").cast("long").alias(position),
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values],
    )
    fresh = join_keyed(updates, current.select(key), [key], "left_anti").withColumn("_all", F.lit(0))
    # a global aggregate is a single row, whatever the size of the index
    last = current.agg(F.coalesce(F.max(position), F.lit(0)).cast("long").alias("_last")).withColumn("_all", F.lit(0))
    added = ordinal(fresh, ["_all"], [key], "_n").join(F.broadcast(last), "_all").select(
        key, (F.col("_last") + F.col("_n")).cast("long").alias(position), *values
    )
    return kept.unionByName(added)


def rebuild_index(maps: DataFrame, manifests: DataFrame, key: str = "map_id") -> DataFrame:
    """Index of all listed maps that have a readable manifest, in order."""
    return maps.select(key).distinct().join(manifests, key).orderBy(key)


def order_maps(maps: DataFrame) -> DataFrame:
    return maps.orderBy("map_id")


def order_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy("map_id", "tile")


def order_landclasses(landclasses: DataFrame) -> DataFrame:
    return landclasses.orderBy("map_id", "name")


def main_source(paint: str, colormap: str, tiles: str, grid_extent: str, height_extent: str, map_extent: str) -> Column:
    """Picture and world extent that stand for a map: paint, else colour map, else tile mosaic.

    The colour map covers the height raster, the other two the tile grid; the map's own corners are
    used where those are unknown.
    """
    gridded = F.coalesce(F.col(grid_extent), F.col(map_extent))
    heights = F.coalesce(F.col(height_extent), F.col(map_extent))

    def source(file: str, extent: Column) -> Column:
        return F.when(F.col(file).isNotNull(), F.struct(F.col(file).alias("file"), extent.alias("extent")))

    return F.coalesce(source(paint, gridded), source(colormap, heights), source(tiles, gridded))


def height_source(height_file: str, height_extent: str, map_extent: str, fallback: Column) -> Column:
    """The height raster with its extent, else the main source."""
    extent = F.coalesce(F.col(height_extent), F.col(map_extent))
    own = F.when(F.col(height_file).isNotNull(), F.struct(F.col(height_file).alias("file"), extent.alias("extent")))
    return F.coalesce(own, fallback)
