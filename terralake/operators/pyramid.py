"""Filling of missing cells from pyramids of block means, in arrays of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SMALLEST = 4  # a pyramid ends at a level that fits a grid of this size
HALO = 2
WHOLE = 256  # a layer of at most so many columns and rows is one array


def coarser(v):
    """Mean of the known cells of each 2 x 2 block; an odd last row or column is dropped, NaN is unknown (numpy array)."""
    import numpy as np

    h, w = v.shape
    part = v[:max(h // 2 * 2, 1), :max(w // 2 * 2, 1)]
    known = ~np.isnan(part)

    def fold(m):
        m = m[0::2] + m[1::2] if m.shape[0] > 1 else m
        return m[:, 0::2] + m[:, 1::2] if m.shape[1] > 1 else m

    total, n = fold(np.where(known, part, 0.0)), fold(known.astype(int))
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def fill_smallest(v):
    """Spread known values over a grid of at most 4 x 4 cells to their neighbours, six times; 0 where a grid knows none."""
    import numpy as np

    for _ in range(6):
        around = np.full((4, *v.shape), np.nan)
        around[0, :, 1:], around[1, :, :-1], around[2, 1:], around[3, :-1] = v[:, :-1], v[:, 1:], v[:-1], v[1:]
        known = ~np.isnan(around)
        n = known.sum(axis=0)
        total = sum(np.where(k, a, 0.0) for k, a in zip(known, around))
        v = np.where(np.isnan(v) & (n > 0), total / np.maximum(n, 1), v)
    return np.nan_to_num(v)


def finer(v, coarse, size: tuple[int, int], coarse_size: tuple[int, int], at: tuple[int, int] = (0, 0), coarse_at: tuple[int, int] = (0, 0)):
    """``v`` with its missing cells taken from the filled level below, bilinearly.

    ``v`` may be a part of its level (``size`` is the width and height of the whole one) that begins at cell ``at``; cells beyond the level stay NaN.
    """
    import numpy as np

    (w, h), (cw, ch) = size, coarse_size
    px, pz = np.arange(v.shape[1]) + at[0], np.arange(v.shape[0]) + at[1]

    def place(p, n: int, cn: int, start: int):
        f = np.maximum((p + 0.5) / n * cn - 0.5, 0.0)
        low = np.clip(np.floor(f).astype(int), 0, cn - 1)
        return f - low, low - start, np.minimum(low + 1, cn - 1) - start

    ok_x, ok_z = (px >= 0) & (px < w), (pz >= 0) & (pz < h)
    fx, x0, x1 = place(px[ok_x], w, cw, coarse_at[0])
    fz, z0, z1 = place(pz[ok_z], h, ch, coarse_at[1])
    fz = fz[:, None]
    value = (coarse[np.ix_(z0, x0)] * (1 - fx) * (1 - fz) + coarse[np.ix_(z0, x1)] * fx * (1 - fz)
             + coarse[np.ix_(z1, x0)] * (1 - fx) * fz + coarse[np.ix_(z1, x1)] * fx * fz)
    out = v.copy()
    own = out[np.ix_(ok_z, ok_x)]
    out[np.ix_(ok_z, ok_x)] = np.where(np.isnan(own), value, own)
    return out


def halves(size: tuple[int, int], times: int = 1) -> tuple[int, int]:
    for _ in range(times):
        size = max(size[0] // 2, 1), max(size[1] // 2, 1)
    return size


def fill_whole(v):
    """Fill a whole layer (numpy array)."""
    levels = [v]
    while max(levels[-1].shape) > SMALLEST:
        levels.append(coarser(levels[-1]))
    full = fill_smallest(levels.pop())
    for level in reversed(levels):
        full = finer(level, full, level.shape[::-1], full.shape[::-1])
    return full


def _cells(v, at: tuple[int, int], size: tuple[int, int]):
    """Positions and values of the cells of an array that lie in the layer."""
    import numpy as np

    pz, px = np.divmod(np.arange(v.size), v.shape[1])
    px, pz = px + at[0], pz + at[1]
    inside = (px >= 0) & (px < size[0]) & (pz >= 0) & (pz < size[1])
    return px[inside].astype("int32"), pz[inside].astype("int32"), v.reshape(-1)[inside]


def _fill_layers(keys: Sequence[str], v: str):
    def run(group):
        import numpy as np
        import pandas as pd

        w, h = int(group["width"].iloc[0]), int(group["height"].iloc[0])
        grid = np.full((h, w), np.nan)
        known = group[group[v].notna()]
        grid[known["pz"].astype(int), known["px"].astype(int)] = known[v]
        px, pz, value = _cells(fill_whole(grid), (0, 0), (w, h))
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(px) for k in keys}, "px": px, "pz": pz, v: value})

    return run


def _levels(side: int) -> list[int]:
    """Sides of the levels of a tile, down to the width of the halo."""
    out = [side]
    while out[-1] > HALO:
        out.append(out[-1] // 2)
    return out


def _tile_pyramids(batches: Iterator, side: int):
    """Pyramid of every tile (``tx, tz, w, h, data``): its levels for itself, their border strips for its neighbours, the last level for the coarse raster."""
    import numpy as np
    import pandas as pd

    sides = _levels(side)
    for pdf in batches:
        rows = []
        for tx, tz, w, h, data, width, height in zip(*(pdf[c] for c in ("tx", "tz", "w", "h", "data", "width", "height"))):
            grid = np.full((side, side), np.nan)
            if data is not None:
                grid[:h, :w] = np.asarray(data, dtype="float64").reshape(h, w)
            levels = [grid]
            for k in range(1, len(sides)):
                level, (lw, lh) = coarser(levels[-1]), halves((width, height), k)
                level[max(0, lh - tz * sides[k]):], level[:, max(0, lw - tx * sides[k]):] = np.nan, np.nan  # odd rows and columns are dropped
                levels.append(level)
            for dz in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    part = [level[_strip(dz, s), _strip(dx, s)] for level, s in zip(levels[:-1], sides)]
                    rows.append((tx + dx, tz + dz, -dx, -dz, np.concatenate([p.reshape(-1) for p in part])))
            last = sides[-1]
            rows.append((tx * last, tz * last, None, None, levels[-1].reshape(-1)))
        out = pd.DataFrame(rows, columns=["tx", "tz", "dx", "dz", "data"])
        own = pdf.drop(columns=["tx", "tz", "w", "h", "data"]).loc[pdf.index.repeat(10)].reset_index(drop=True)
        yield pd.concat([own, out.astype({"dx": "Int32", "dz": "Int32"})], axis=1)


def _strip(d: int, side: int) -> slice:
    """Part of an axis that a neighbour in direction ``d`` needs: all of it, or the cells within its halo."""
    return slice(None) if d == 0 else slice(0, HALO) if d < 0 else slice(side - HALO, side)


def _fill_tiles(keys: Sequence[str], v: str, side: int):
    def run(group):
        import numpy as np
        import pandas as pd

        sides = _levels(side)
        tx, tz, size = int(group["tx"].iloc[0]), int(group["tz"].iloc[0]), (int(group["width"].iloc[0]), int(group["height"].iloc[0]))
        levels = [np.full((s + 2 * HALO,) * 2, np.nan) for s in sides]
        filled = group["dx"].isna()
        for dx, dz, data in zip(*(group.loc[~filled, c] for c in ("dx", "dz", "data"))):
            at = 0
            for level, s in zip(levels[:-1], sides):
                rows, columns = (slice(HALO, HALO + s) if d == 0 else slice(0, HALO) if d < 0 else slice(HALO + s, None) for d in (int(dz), int(dx)))
                part = level[rows, columns]
                part[:] = np.asarray(data[at:at + part.size]).reshape(part.shape)
                at += part.size
        last = sides[-1]
        for cx, cz, value in zip(*(group.loc[filled, c] for c in ("cx", "cz", "value"))):
            levels[-1][int(cz) - tz * last + HALO, int(cx) - tx * last + HALO] = value
        full = levels[-1]
        for k in range(len(sides) - 2, -1, -1):
            at, below = ((tx * sides[i] - HALO, tz * sides[i] - HALO) for i in (k, k + 1))
            full = finer(levels[k], full, halves(size, k), halves(size, k + 1), at, below)
        px, pz, value = _cells(full[HALO:-HALO, HALO:-HALO], (tx * side, tz * side), size)
        return pd.DataFrame({**{c: [group[c].iloc[0]] * len(px) for c in keys}, "px": px, "pz": pz, v: value})

    return run


def fill_layers(known: DataFrame, dims: DataFrame, v: str, side: int = 64, whole: int = WHOLE) -> DataFrame:
    """All cells of every layer: known ones as they are, missing ones from a pyramid of block means.

    ``known`` holds the known cells (``<keys>, px, pz, <v>``) and ``dims`` the ``width`` and ``height`` of every layer by the same keys. Layers of up to ``whole``
    cells a side are filled as one array each. Larger ones are cut into tiles of ``side`` cells (a power of two): one shuffle brings the cells of a tile together,
    the pyramid of each tile is built at once, and its last level joins a raster 1/32 the size, which is filled in the same way. A second
    shuffle brings each tile its neighbours' border cells of all levels and the filled coarse cells around it, and it is filled from the coarsest level down.
    """
    from .raster import pack_tiles
    from .scans import join_keyed

    keys = [c for c in dims.columns if c not in ("width", "height")]
    kinds = {**dict(dims.dtypes)}
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    cells = f"{named}, px int, pz int, {v} double"
    small = dims.filter(F.greatest("width", "height") <= whole)
    of_small = join_keyed(small, known.select(*keys, "px", "pz", v), keys, "left")
    out = of_small.groupBy(*keys).applyInPandas(_fill_layers(keys, v), cells)
    large = dims.filter(F.greatest("width", "height") > whole)
    if large.isEmpty():
        return out

    places = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / side).cast("int"))
    tiles = large.select("*", F.explode(places("height")).alias("tz")).select("*", F.explode(places("width")).alias("tx"))
    packed = pack_tiles(join_keyed(known.select(*keys, "px", "pz", v), large, keys), large, side, v, "double", keys)
    rows = join_keyed(tiles, packed.select(*keys, "tx", "tz", "data"), [*keys, "tx", "tz"], "left").select(
        *keys, "width", "height", "tx", "tz", F.least(F.lit(side), F.col("width") - F.col("tx") * side).cast("int").alias("w"),
        F.least(F.lit(side), F.col("height") - F.col("tz") * side).cast("int").alias("h"), "data")
    parts = f"{named}, width int, height int, tx int, tz int, dx int, dz int, data array<double>"
    pyramids = cut(rows.mapInPandas(lambda batches: _tile_pyramids(batches, side), parts), "pyramids")

    last = _levels(side)[-1]
    factor = side // last
    coarse = pyramids.filter("dx IS NULL").select(*keys, "tx", "tz", F.posexplode("data").alias("_i", v)).select(
        *keys, (F.col("tx") + F.col("_i") % last).cast("int").alias("px"), (F.col("tz") + F.floor(F.col("_i") / last)).cast("int").alias("pz"), v,
    ).filter(F.col(v).isNotNull() & ~F.isnan(v))
    coarse_dims = large.select(*keys, *[F.greatest(F.floor(F.col(n) / factor), F.lit(1)).cast("int").alias(n) for n in ("width", "height")])
    below = fill_layers(coarse, coarse_dims, v, side, whole)

    # a coarse cell serves the tiles whose halo it lies in
    around = lambda p: F.explode(F.sequence(
        F.ceil((F.col(p) - last - HALO + 1) / last).cast("int"), F.floor((F.col(p) + HALO) / last).cast("int")))
    spread = below.withColumn("tx", around("px")).withColumn("tz", around("pz")).select(
        *keys, "tx", "tz", F.lit(None).cast("int").alias("dx"), F.lit(None).cast("int").alias("dz"), F.lit(None).cast("array<double>").alias("data"),
        F.col("px").alias("cx"), F.col("pz").alias("cz"), F.col(v).alias("value"))
    strips = pyramids.filter("dx IS NOT NULL").select(
        *keys, "tx", "tz", "dx", "dz", "data", F.lit(None).cast("int").alias("cx"), F.lit(None).cast("int").alias("cz"), F.lit(None).cast("double").alias("value"))
    wanted = join_keyed(strips.unionByName(spread), large, keys).filter(
        (F.col("tx") >= 0) & (F.col("tz") >= 0) & (F.col("tx") * side < F.col("width")) & (F.col("tz") * side < F.col("height")))
    return out.unionByName(wanted.groupBy(*keys, "tx", "tz").applyInPandas(_fill_tiles(keys, v, side), cells))
