"""Colour rasters: splat blending, lighting, seams, mosaics, water tint, stand-in heights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions._col import clamp, floor_long, trunc_long
from ..functions.codec import fnv1a64, noise_rgb, seed_bits
from ..functions.names import sanitize_det
from ..session import cut
from .raster import _keys, _layers_for, _tile_keys, box_sums, dense_array, with_halo
from .catalog import CLASS_SALTS
from .scans import fan_out, join_dim, shuffled

# ---- fixed values ----------------------------------------------------------------------------
WATER_COLOR = (20, 60, 120)
TINT_COLOR = (13, 79, 139)
MAP_WATER_COLOR = (18, 86, 145)
LUMA = (0.2126, 0.7152, 0.0722)
DETAIL_SLOTS = (3, 1, 0, 2)  # which of the R, G, B, K detail textures each weight slot shows

RGB = ("r", "g", "b")


def byte_range(c: Column) -> Column:
    return clamp(c, 0, 255).cast("int")


# ---- lighting --------------------------------------------------------------------------------


def hillshade(rgb: DataFrame, normals: DataFrame, azimuth: float = 30.0, elevation: float = 50.0,
              strength: float = 0.5) -> DataFrame:
    """Shade colours by the angle between the sun and the normals (nr, ng, nb)."""
    el, az = math.radians(min(max(elevation, 0.0), 90.0)), math.radians(azimuth)
    sun = (math.cos(el) * math.sin(az), math.cos(el) * math.cos(az), math.sin(el))
    power = min(max(strength, 0.0), 1.0)
    keys = _keys(rgb)
    joined = rgb.join(shuffled(normals.select(*keys, "px", "pz", "nr", "ng", "nb")), [*keys, "px", "pz"])
    x, y, z = -(F.col("nr") / 255.0 * 2 - 1), -(F.col("ng") / 255.0 * 2 - 1), F.col("nb") / 255.0 * 2 - 1
    mag = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-6))
    diffuse = clamp((x * sun[0] + y * sun[1] + z * sun[2]) / mag, 0.0, 1.0)
    lit = joined.withColumn("_shade", (1.0 - power) + power * diffuse)
    return lit.withColumns({c: trunc_long(clamp(F.col(c) * F.col("_shade"), 0.0, 255.0)).cast("int") for c in RGB}).drop(
        "_shade", "nr", "ng", "nb"
    )


# ---- splat blending --------------------------------------------------------------------------


def noise_seed(landclasses: DataFrame) -> Column:
    """Bits of the seed of a landclass's noise: hash of its authored texture (column ``authored``, where there is one), else its name, else ``lc``."""
    named = [F.col(c) for c in ("authored", "name") if c in landclasses.columns]
    return seed_bits(fnv1a64(F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in named], F.lit("lc"))))


def known_details(landclasses: DataFrame, sizes: DataFrame) -> DataFrame:
    """``landclasses`` whose ``detail_textures`` hold only names in the store; a missing detail shows the base texture instead."""
    rest = [c for c in landclasses.columns if c != "detail_textures"]
    asked = landclasses.select("map_id", "lc_idx", F.posexplode("detail_textures").alias("at", "texture")).filter(F.col("texture").isNotNull())
    have = join_dim(asked, sizes.select("texture").distinct(), ["texture"], ["map_id", "lc_idx"], "left_semi")
    found = have.groupBy("map_id", "lc_idx").agg(F.map_from_entries(F.collect_list(F.struct("at", "texture"))).alias("_have"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.try_element_at("_have", i))
    return landclasses.join(shuffled(found), ["map_id", "lc_idx"], "left").select(*rest, slots.alias("detail_textures"))


def sample_tiled_texture(points: DataFrame, textures: DataFrame, sizes: DataFrame, seed: str | None = None) -> DataFrame:
    """Texel of a repeating texture at output pixel (gx, gy) with periods (scale_x, scale_y) in pixels.

    ``textures`` holds texels (``texture, sx, sy, r, g, b``) and ``sizes`` their dimensions
    (``texture, tw, th``). Points whose texture is unknown show the noise of the column ``seed``; their colours are null
    where there is no seed.
    """
    sized = join_dim(points, sizes, ["texture"], ["gx", "gy"], "left")

    def at(g: str, scale: str, n: str) -> Column:
        return (trunc_long(F.col(g) / F.greatest(F.col(scale), F.lit(1.0)) * F.col(n)) % F.col(n)).cast("int")

    placed = sized.withColumn("sx", at("gx", "scale_x", "tw")).withColumn("sy", at("gy", "scale_y", "th"))
    found = placed.join(textures.select("texture", "sx", "sy", *RGB), ["texture", "sx", "sy"], "left").drop(
        "sx", "sy", "tw", "th"
    )
    if seed is None:
        return found
    noisy = F.col("r").isNull() & F.col(seed).isNotNull()
    shown = found.filter(noisy).withColumn("_noise", noise_rgb(seed, "gx", "gy"))
    shown = shown.withColumns({c: F.col(f"_noise.{c}") for c in RGB}).drop("_noise")
    return found.filter(~noisy).unionByName(shown)


def single_lc_detail_mix(cells: DataFrame, landclasses: DataFrame) -> DataFrame:
    """Landclass whose detail textures a cell shows, else null.

    That is the case when all known ids of the first four slots agree and this landclass has any
    detail texture (``detail_textures``, an array of four names in R, G, B, K order).
    """
    lcs = landclasses.groupBy("map_id").agg(
        (F.max("lc_idx") + 1).alias("_n"),
        F.collect_set(F.when(F.exists("detail_textures", lambda t: t.isNotNull()), F.col("lc_idx"))).alias("_detailed"),
    )
    joined = join_dim(cells, lcs, ["map_id"], ["tx", "tz"], "left")
    known = F.array_distinct(F.filter(F.slice("det", 1, 4), lambda i: i < F.col("_n")))
    only = F.get(known, F.lit(0))
    single = (F.size(known) == 1) & F.array_contains("_detailed", only)
    return joined.withColumn("single_lc", F.when(single, only).cast("int")).drop("_n", "_detailed")


def paint_pixels(cells: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Output pixels of every terrain cell; rows are spread out before they are split into pixels."""
    rows = cells.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(tile_h - 1))))
    return fan_out(rows, "map_id", "tx", "tz", "_y").withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(tile_w - 1)))).withColumns({
        "px": (F.col("tx") * tile_w + F.col("_x")).cast("int"), "pz": (F.col("tz") * tile_h + F.col("_y")).cast("int"),
    })


def splat_arrays(splats: DataFrame) -> DataFrame:
    """One row per splat tile (``map_id, tile``): width ``sw``, height ``sh``, whether its alpha counts, and its pixels as an array of packed bytes."""
    packed = F.col("r") + F.shiftleft(F.col("g"), 8) + F.shiftleft(F.col("a"), 16)
    tiles = splats.groupBy("map_id", "tile").agg(
        (F.max("sx") + 1).alias("sw"), (F.max("sz") + 1).alias("sh"), (F.min("a") < 255).alias("alpha"),
        F.array_sort(F.collect_list(F.struct("sz", "sx", packed.cast("int").alias("v")))).alias("_p"),
    )
    placed = tiles.withColumn("_at", F.transform("_p", lambda c: F.struct((c["sz"] * F.col("sw") + c["sx"]).alias("at"), c["v"].alias("v"))))
    return placed.select("map_id", "tile", "sw", "sh", "alpha", dense_array(F.col("_at"), F.col("sw") * F.col("sh"), "int").alias("splat"))


def texture_arrays(textures: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per texture: ``texture, tw, th``, its texels as an array of packed bytes (null where one is missing), and whether any is."""
    packed = F.col("r") + F.shiftleft(F.col("g"), 8) + F.shiftleft(F.col("b"), 16)
    texels = textures.groupBy("texture").agg(F.array_sort(F.collect_list(F.struct("sy", "sx", packed.cast("int").alias("v")))).alias("_p"))
    placed = sizes.select("texture", "tw", "th").join(texels, "texture", "left").withColumn(
        "_at", F.coalesce(F.transform("_p", lambda c: F.struct((c["sy"] * F.col("tw") + c["sx"]).cast("int").alias("at"), c["v"].alias("v"))),
                          F.array().cast("array<struct<at:int,v:int>>")))
    n = F.col("tw") * F.col("th")
    holes = (F.size("_at") < n) | F.exists("_at", lambda c: c["v"].isNull())
    return placed.select("texture", "tw", "th", dense_array(F.col("_at"), n, "int").alias("texels"), holes.alias("holes"))


def _texel_at() -> Column:
    """Place in ``texels`` that output pixel (px, pz) shows, with periods (scale_x, scale_y) in pixels."""
    def along(p: str, scale: str, n: str) -> Column:
        return trunc_long(F.col(p) / F.greatest(F.col(scale), F.lit(1.0)) * F.col(n)) % F.col(n)

    return (along("pz", "scale_y", "th") * F.col("tw") + along("px", "scale_x", "tw")).cast("int")


def splat_weights() -> list[Column]:
    """Weight of each slot from the splat columns of both tiles; negative rest weights become 0."""
    r, g, a = F.col("s1_r"), F.col("s1_g"), F.col("s1_a")
    weights = [clamp(255 - r - g - a, 0, 255), g, r, a, F.col("s2_g"), F.col("s2_r"), F.col("s2_a")]
    return [w.cast("int") for w in weights]


def splat_blend(cells: DataFrame, splats: DataFrame, landclasses: DataFrame, textures: DataFrame, sizes: DataFrame,
                tile_w: int, tile_h: int) -> DataFrame:
    """Painted terrain: landclass textures mixed by the splat weights of every output pixel.

    ``cells``: ``map_id, tx, tz, det, export_idx, has_tex2``; ``splats``: ``map_id, tile, sx, sz, r, g,
    b, a``; ``landclasses``: ``map_id, lc_idx, name, texture, scale_x, scale_y, detail_textures,
    detail_scales`` and, for noise, ``authored``.  Cells without a tile show their base landclass, pixels without any landclass the
    water colour.

    Splat tiles and textures are arrays, fetched once per cell and slot; the pixels of a cell are made next to them and read both by position, so
    no pixel takes part in a join.
    """
    landclasses = known_details(landclasses, sizes).withColumn("_seed", noise_seed(landclasses))
    ocean = landclasses.groupBy("map_id").agg(
        (F.max("lc_idx") + 1).cast("int").alias("_lcs"),
        F.collect_set(F.when(F.col("ocean"), F.col("lc_idx"))).alias("_ocean"),
    )
    clean = join_dim(cells, ocean, ["map_id"], ["tx", "tz"], "left").withColumn("det", sanitize_det("det", "_ocean"))
    mixed = single_lc_detail_mix(clean.drop("_ocean"), landclasses)
    tiles = splat_arrays(splats)
    second = F.when(F.col("has_tex2"), F.col("export_idx") + 1)
    for prefix, index in (("s1", F.col("export_idx")), ("s2", second)):
        own = tiles.select("map_id", "tile", F.struct("sw", "sh", "alpha", "splat").alias(prefix))
        mixed = mixed.withColumn("tile", index).join(shuffled(own), ["map_id", "tile"], "left").drop("tile")
    known = lambda i: F.coalesce(F.get(F.col("det"), i) < F.col("_lcs"), F.lit(False))
    celled = mixed.withColumn("_ok", F.array(*[known(F.lit(i)) for i in range(7)])).withColumn("slot", F.explode(F.sequence(F.lit(-1), F.lit(6))))
    mix = F.col("slot").between(0, 3) & F.col("single_lc").isNotNull()
    lc = F.get(F.col("det"), F.greatest(F.col("slot"), F.lit(0)))
    slots = celled.filter((F.col("slot") < 0) | (F.col("s1").isNotNull() & F.get(F.col("_ok"), F.col("slot")))).select(
        "map_id", "tx", "tz", "slot", "s1", "s2", "_ok", F.when(mix, F.col("single_lc")).otherwise(F.when(lc < F.col("_lcs"), lc)).alias("lc_idx"), mix.alias("_mix"))
    shown = join_dim(
        slots, landclasses.select("map_id", "lc_idx", "_seed", "texture", "scale_x", "scale_y", "detail_textures", "detail_scales"),
        ["map_id", "lc_idx"], ["tx", "tz"], "left", CLASS_SALTS,
    )
    pick = F.element_at(F.array(*[F.lit(s) for s in DETAIL_SLOTS]), F.greatest(F.col("slot"), F.lit(0)) % 4 + 1)
    detail = F.when(F.col("_mix"), F.get(F.col("detail_textures"), pick))
    scale = F.when(detail.isNotNull(), F.get(F.col("detail_scales"), pick))
    textured = join_dim(shown.select(
        "map_id", "tx", "tz", "slot", "s1", "s2", "_ok", "lc_idx", F.when(F.col("lc_idx").isNotNull(), F.col("_seed")).alias("_seed"),
        F.coalesce(detail, F.col("texture")).alias("texture"),
        F.coalesce(scale, F.col("scale_x")).alias("scale_x"), F.coalesce(scale, F.col("scale_y")).alias("scale_y"),
    ), texture_arrays(textures, sizes), ["texture"], ["map_id", "tx", "tz"], "left")

    rows = fan_out(textured, "map_id", "tx", "tz").withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(tile_h - 1))))
    pixels = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(tile_w - 1)))).withColumns({
        "px": (F.col("tx") * tile_w + F.col("_x")).cast("int"), "pz": (F.col("tz") * tile_h + F.col("_y")).cast("int"),
    })

    def nearest(p: str, n: str, size: int) -> Column:
        return F.least(trunc_long((F.col(p) + 0.5) * F.col(n) / size), F.col(n) - 1)

    for s in ("s1", "s2"):
        at = nearest("_y", f"{s}.sh", tile_h) * F.col(f"{s}.sw") + nearest("_x", f"{s}.sw", tile_w)
        pixels = pixels.withColumn(f"_{s}", F.get(F.col(f"{s}.splat"), at.cast("int"))).withColumns({
            f"{s}_r": F.col(f"_{s}").bitwiseAND(255), f"{s}_g": F.shiftright(f"_{s}", 8).bitwiseAND(255),
            f"{s}_a": F.when(F.col(f"{s}.alpha"), F.shiftright(f"_{s}", 16)).otherwise(F.col(f"_{s}") * 0),
        })
    weights = splat_weights()
    tiled, some, own = F.col("s1_r").isNotNull(), F.lit(False), F.lit(None).cast("int")
    for i, w in enumerate(weights):
        some = some | (F.coalesce(w > 0, F.lit(False)) & F.get(F.col("_ok"), F.lit(i)))
        own = F.when(F.col("slot") == i, w).otherwise(own)
    weight = F.when(F.col("slot") < 0, F.when(tiled & some, 0).otherwise(1)).otherwise(F.when(tiled, own))
    # rows of weight 0 stay: a filter on the weight would be pushed into, and repeat, all that it is computed from
    seen = pixels.withColumn("weight", F.when(F.col("lc_idx").isNotNull(), weight))

    at = _texel_at()
    drawn = seen.withColumn("_t", F.get(F.col("texels"), at)).withColumns({
        "r": F.col("_t").bitwiseAND(255), "g": F.shiftright("_t", 8).bitwiseAND(255), "b": F.shiftright("_t", 16).bitwiseAND(255)})
    # noise is Python's: only rows of a texture that is unknown, or lacks texels, are sent there
    maybe = F.col("_seed").isNotNull() & F.coalesce(F.col("holes"), F.lit(True))
    columns = ["map_id", "px", "pz", "weight", *RGB]
    noisy = drawn.filter(maybe).withColumn("_noise", noise_rgb("_seed", "px", "pz"))
    noisy = noisy.withColumns({c: F.coalesce(F.col(c), F.col(f"_noise.{c}")) for c in RGB})
    total = F.sum("weight")
    return drawn.filter(~maybe).select(columns).unionByName(noisy.select(columns)).groupBy("map_id", "px", "pz").agg(*[
        F.when(total > 0, byte_range(floor_long(F.sum(F.col(c) * F.col("weight")) / total)))
        .otherwise(WATER_COLOR[i]).cast("int").alias(c)
        for i, c in enumerate(RGB)
    ])


def synth_tile(cells: DataFrame, landclasses: DataFrame, textures: DataFrame, sizes: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Cells shown by their base landclass alone: its texture, or noise where it has none. Without a landclass they keep the water colour.

    As in ``splat_blend`` a cell fetches its landclass and texture before its pixels are made, so no pixel takes part in a join.
    """
    based = cells.select("map_id", "tx", "tz", F.get(F.col("det"), F.lit(0)).alias("lc_idx"))
    seeded = landclasses.select("map_id", "lc_idx", "texture", "scale_x", "scale_y", noise_seed(landclasses).alias("_seed"))
    shown = join_dim(based, seeded, ["map_id", "lc_idx"], ["tx", "tz"], "left", CLASS_SALTS)
    textured = join_dim(shown, texture_arrays(textures, sizes), ["texture"], ["map_id", "tx", "tz"], "left")
    rows = fan_out(textured, "map_id", "tx", "tz").withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(tile_h - 1))))
    pixels = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(tile_w - 1)))).withColumns({
        "px": (F.col("tx") * tile_w + F.col("_x")).cast("int"), "pz": (F.col("tz") * tile_h + F.col("_y")).cast("int"),
    })
    drawn = pixels.withColumn("_t", F.get(F.col("texels"), _texel_at())).withColumns({
        "r": F.col("_t").bitwiseAND(255), "g": F.shiftright("_t", 8).bitwiseAND(255), "b": F.shiftright("_t", 16).bitwiseAND(255)})
    maybe = F.col("_seed").isNotNull() & F.coalesce(F.col("holes"), F.lit(True))
    columns = ["map_id", "px", "pz", *RGB]
    noisy = drawn.filter(maybe).withColumn("_noise", noise_rgb("_seed", "px", "pz"))
    noisy = noisy.withColumns({c: F.coalesce(F.col(c), F.col(f"_noise.{c}")) for c in RGB})
    return drawn.filter(~maybe).select(columns).unionByName(noisy.select(columns)).select("map_id", "px", "pz", *[
        F.coalesce(F.col(c), F.lit(WATER_COLOR[i])).cast("int").alias(c) for i, c in enumerate(RGB)
    ])


# ---- seams -----------------------------------------------------------------------------------


def _near_seam(axis: str, size: str, tile: int, reach: int) -> Column:
    """Within ``reach`` pixels of an inner tile border along one axis."""
    p, part = F.col(axis), F.col(axis) % tile
    after = (p >= tile) & (part <= reach)
    before = ((F.floor(p / tile) + 1) * tile < F.col(size)) & (tile - part <= reach)
    return after | before


def seam_cells(rgb: DataFrame, layers: DataFrame, tile_w: int, tile_h: int, reach: int) -> DataFrame:
    """Cells in the vertical and horizontal bands around tile borders, each once."""
    sized = _layers_for(rgb, layers, "width", "height")
    near = _near_seam("px", "width", tile_w, reach) | _near_seam("pz", "height", tile_h, reach)
    return sized.filter(near).drop("width", "height")


def feather_seams(rgb: DataFrame, layers: DataFrame, tile_w: int, tile_h: int, border: int = 10) -> DataFrame:
    """Blend a band around tile borders with its local mean; all other cells pass through unshuffled."""
    if border == 0 or tile_w <= 2 * border or tile_h <= 2 * border:
        return rgb
    sized = _layers_for(rgb, layers, "width", "height")
    band = _near_seam("px", "width", tile_w, border - 1) | _near_seam("pz", "height", tile_h, border - 1)

    def away(axis: str, tile: int) -> Column:
        part = F.col(axis) % tile
        return F.least(part, tile - part)

    dist = F.least(away("px", tile_w), away("pz", tile_h))
    touched = band & (dist < border)
    plain = sized.filter(~touched).drop("width", "height")
    reach = 2 * border - 1
    around = _near_seam("px", "width", tile_w, reach) | _near_seam("pz", "height", tile_h, reach)
    sums = box_sums(sized.filter(around), border, RGB).filter(touched)
    alpha = F.sqrt(1.0 - dist / float(border))

    def blend(c: str) -> Column:
        mean = F.floor(F.col(f"sum_{c}") / F.col("n_box"))
        return byte_range(F.round(F.col(c) + (mean - F.col(c)) * alpha))

    softened = sums.withColumns({c: blend(c) for c in RGB}).drop(
        "width", "height", "n_box", *[f"sum_{c}" for c in RGB]
    )
    return plain.unionByName(softened.select(*plain.columns))


# ---- mosaics ---------------------------------------------------------------------------------


def mosaic(tiles: DataFrame, mapping: DataFrame, grids: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Tile pixels (``map_id, tile, x, y, r, g, b``) at their place in the level.

    ``mapping`` says which cell a tile fills. Where two tiles meet, the later tile wins; pixels without a tile are black.
    """
    placed = join_dim(tiles, mapping.select("map_id", "tile", "cell"), ["map_id", "tile"], ["x", "y"], "inner")
    grid = join_dim(placed, grids.select("map_id", "cols", "rows"), ["map_id"], ["tile", "x", "y"], "inner")
    gx, gz = F.col("cell") % F.col("cols"), F.floor(F.col("cell") / F.col("cols"))
    at = grid.filter(gz < F.col("rows")).select(
        "map_id", "tile", (gx * tile_w + F.col("x")).cast("int").alias("px"), (gz * tile_h + F.col("y")).cast("int").alias("pz"), *RGB
    )
    top = at.groupBy("map_id", "px", "pz").agg(F.max_by(F.struct(*RGB), "tile").alias("_c"))
    rows = grids.select("map_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("tz"))
    canvas = paint_pixels(rows.withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))), tile_w, tile_h).select("map_id", "px", "pz")
    return canvas.join(top, ["map_id", "px", "pz"], "left").select(
        "map_id", "px", "pz", *[F.coalesce(F.col(f"_c.{c}"), F.lit(0)).alias(c) for c in RGB]
    )


def tint_water(rgb: DataFrame, mask: DataFrame, color: tuple[int, int, int] = TINT_COLOR, alpha: float = 0.7,
               rounding: str = "truncate") -> DataFrame:
    """Mix a colour into the masked cells."""
    keys = _keys(rgb)
    flagged = rgb.join(
        shuffled(mask.select(*[k for k in keys if k in mask.columns], "px", "pz").withColumn("_wet", F.lit(True))),
        [*[k for k in keys if k in mask.columns], "px", "pz"], "left",
    )

    def mix(i: int, c: str) -> Column:
        if rounding == "truncate":
            share = round(alpha * 100)
            new = F.floor((F.col(c) * (100 - share) + color[i] * share) / 100)
        else:
            new = F.round(F.col(c) * (1.0 - alpha) + color[i] * alpha)
        return F.when(F.col("_wet"), byte_range(new)).otherwise(F.col(c)).cast("int")

    return flagged.withColumns({c: mix(i, c) for i, c in enumerate(RGB)}).drop("_wet")


# ---- a level from its parts ------------------------------------------------------------------


def painted_level(cells: DataFrame, splats: DataFrame, materials: DataFrame, textures: DataFrame, sizes: DataFrame, normals: DataFrame,
                  wet: DataFrame, tile_w: int, tile_h: int, border: int = 10, sun: tuple[float, float, float] = (30.0, 50.0, 0.5),
                  flood_tile: int = 64) -> DataFrame:
    """Colours of whole levels: splats blended, seams softened, lit by the normals, water tinted.

    ``cells``, ``splats``, ``textures`` and ``sizes`` as for ``splat_blend``, ``materials`` from ``catalog.landclass_materials``; ``normals`` (``map_id, px, pz, nr, ng, nb``)
    and ``wet`` (``map_id, px, pz``, cells low enough to be water) on the canvas, whose size follows from the cells. Cells that are populated or have a base landclass are
    protected from water. A canvas cell without a normal is not lit, which an inner join would lose.
    """
    from .flood import water_mask

    columns = ["map_id", "px", "pz", *RGB]
    canvas = cells.groupBy("map_id").agg(
        ((F.max("tx") + 1) * tile_w).cast("int").alias("width"), ((F.max("tz") + 1) * tile_h).cast("int").alias("height"))
    painted = cut(splat_blend(cells, splats, materials, textures, sizes, tile_w, tile_h), "painted")
    soft = feather_seams(painted, canvas, tile_w, tile_h, border).select(columns)
    facing = soft.select("map_id", "px", "pz").join(shuffled(normals.select("map_id", "px", "pz", "nr", "ng", "nb")), ["map_id", "px", "pz"])
    lit = cut(hillshade(soft, facing, *sun).select(columns).unionByName(
        soft.join(shuffled(normals.select("map_id", "px", "pz")), ["map_id", "px", "pz"], "left_anti").select(columns)), "lit")
    flagged = lit.select("map_id", "px", "pz").join(shuffled(wet.select("map_id", "px", "pz", F.lit(True).alias("wet"))), ["map_id", "px", "pz"], "left")
    guarded = cells.select("map_id", "tx", "tz", (F.col("export_idx").isNotNull() | (F.coalesce(F.get("det", F.lit(0)), F.lit(255)) != 255)).alias("protected"))
    mask = water_mask(flagged.withColumn("wet", F.coalesce("wet", F.lit(False))), canvas, guarded, tile_w, tile_h, flood_tile)
    return tint_water(lit, mask).select(columns)


# ---- stand-in heights ------------------------------------------------------------------------


def luma(r="r", g="g", b="b") -> Column:
    return F.floor((F.col(r) * 2126 + F.col(g) * 7152 + F.col(b) * 722) / 10000).cast("int")


def gaussian_blur(raster: DataFrame, sigma: float = 5.0, v: str = "v", side: int = 256) -> DataFrame:
    """Separable Gaussian in tiles with a halo (one shuffle); weights are renormalised at the border."""
    radius = max(1, math.ceil(3 * sigma))
    tiled = with_halo(raster, radius, side)
    keys = _tile_keys(raster)

    def smooth(df: DataFrame, fixed: str, axis: str) -> DataFrame:
        w = W.partitionBy(*keys, fixed).orderBy(axis).rangeBetween(-radius, radius)
        near = F.collect_list(F.struct(F.col(axis).alias("p"), F.col(v).alias("v"))).over(w)
        weight = lambda p: F.exp(-F.pow((p - F.col(axis)).cast("double"), 2) / (2 * sigma * sigma))
        top = F.aggregate("_near", F.lit(0.0), lambda acc, s: acc + s["v"] * weight(s["p"]))
        low = F.aggregate("_near", F.lit(0.0), lambda acc, s: acc + weight(s["p"]))
        return df.withColumn("_near", near).withColumn(v, top / low).drop("_near")

    return smooth(smooth(tiled, "pz", "px"), "px", "pz").filter("core").drop("hx", "hz", "core")


def pseudo_height(rgb: DataFrame | None = None, normals: DataFrame | None = None, sigma: float = 5.0,
                  layers: DataFrame | None = None) -> DataFrame:
    """Stand-in heights: grey of the colour map, else the blue of the normal map, else a flat 128."""
    if rgb is not None:
        grey = rgb.select(*_keys(rgb), "px", "pz", luma().cast("double").alias("v"))
    elif normals is not None:
        grey = normals.select(*_keys(normals), "px", "pz", F.col("nb").cast("double").alias("v"))
    elif layers is not None:
        from .raster import target_cells

        flat = target_cells(layers, 512, 512).drop("width", "height")
        return flat.withColumn("v", F.lit(128.0)).withColumn("pseudo", F.lit(True))
    else:
        raise ValueError("give colours, normals or layers")
    return gaussian_blur(grey, sigma).withColumn("v", F.round("v")).withColumn("pseudo", F.lit(True))
