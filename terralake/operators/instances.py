"""Placed objects: pools, styles and the occupancy grid used for line of sight."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_occluder, render_style
from ..session import cut
from .scans import fan_out, join_dim

# ---- fixed values: object heights by pool category (metres), 6 for any other category --------
OCCLUDER_HEIGHT = {"building": 16, "infrastructure": 14, "debris": 10, "earthwork": 8, "other": 8}
OTHER_HEIGHT = 6
BUILDING_RADIUS, OTHER_RADIUS = 4.0, 3.0
GRID_MARGIN = 8.0
MAX_GRID = 4096
OCC_TILE = 64
POOL_SALTS = 8  # pools may be many, so they are repeated less often than other dimensions


def _pool_keys(pools: DataFrame) -> list[str]:
    return [k for k in ("map_id", "pool_idx") if k in pools.columns]


def styled_pools(pools: DataFrame, dialect: str = "viewer") -> DataFrame:
    """Pools with their drawing style and whether they hide a line of sight.

    Both depend on the pool alone, so the name patterns run once per pool and not once per object.
    """
    styled = pools.withColumn("style", render_style("category", "name", dialect))
    return styled.withColumn("occludes", is_occluder("category", "name", "style"))


def instances_with_pool(instances: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool columns next to each object; objects of unknown pools have category and style ``other``."""
    keys = _pool_keys(pools)
    joined = join_dim(instances, pools, keys, ["x", "z"], "left", POOL_SALTS)
    for c, missing in (("category", "other"), ("style", "other"), ("occludes", False)):
        if c in pools.columns:
            joined = joined.withColumn(c, F.coalesce(F.col(c), F.lit(missing)))
    return joined


def pool_counts(instances: DataFrame, pools: DataFrame) -> DataFrame:
    """Objects per pool of the dimension, zero for unused pools."""
    keys = _pool_keys(pools)
    counts = instances.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return pools.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def style_counts(instances: DataFrame) -> DataFrame:
    """Objects per style and level, in order of the style's name."""
    return instances.groupBy("map_id", "style").agg(F.count(F.lit(1)).alias("n")).orderBy("map_id", "style")


def occluders(instances: DataFrame) -> DataFrame:
    """Objects that can hide a line of sight, with the height of their top and their radius."""
    height = None
    for category, metres in OCCLUDER_HEIGHT.items():
        hit = F.col("category") == category
        height = F.when(hit, metres) if height is None else height.when(hit, metres)
    height = height.otherwise(OTHER_HEIGHT)
    radius = F.when(F.col("style") == "building", BUILDING_RADIUS).otherwise(OTHER_RADIUS)
    return instances.filter("occludes").select(
        "map_id", "x", "z", (F.col("y") + height).alias("top"), radius.alias("radius")
    )


def occupancy_grids(objects: DataFrame, max_cells: int = MAX_GRID) -> DataFrame:
    """Origin, cell size and dimensions of the occupancy grid per level."""
    box = objects.groupBy("map_id").agg(
        (F.min("x") - GRID_MARGIN).alias("x0"), (F.min("z") - GRID_MARGIN).alias("z0"),
        (F.max("x") + GRID_MARGIN).alias("x1"), (F.max("z") + GRID_MARGIN).alias("z1"),
    )
    w, h = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("z1") - F.col("z0"))
    sized = box.withColumn("_w", w).withColumn("_h", h)
    cell = F.greatest(F.lit(1.0), F.col("_w") / max_cells, F.col("_h") / max_cells)
    return sized.withColumn("cell", cell).select(
        "map_id", "x0", "z0", "cell",
        F.greatest(F.lit(1), F.ceil(F.col("_w") / F.col("cell"))).cast("int").alias("cols"),
        F.greatest(F.lit(1), F.ceil(F.col("_h") / F.col("cell"))).cast("int").alias("rows"),
    )


def build_occupancy(instances: DataFrame, max_cells: int = MAX_GRID, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Highest object top per grid cell (``map_id, gx, gz, top``), and the grids.

    ``instances`` carries ``category, style, occludes`` and a repaired ``y``.  Occluders are written once, since their extent gives the grid they are put on.
    They are first reduced to one per cell and radius, so that crowded places do not multiply.  These few rows are shuffled by
    tile (with those just outside it), and the disks are spread and merged within each tile.
    ``packed`` gives tiles instead of cells, see ``_stamp``.
    """
    objects = cut(occluders(instances), "occluders")
    grids = cut(occupancy_grids(objects, max_cells), "grids")
    placed = join_dim(objects, grids, ["map_id"], ["x", "z"], "inner")
    centred = (
        placed.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / F.col("cell")).cast("int"))
        .withColumn("cz", F.floor((F.col("z") - F.col("z0")) / F.col("cell")).cast("int"))
        .withColumn("reach", F.greatest(F.lit(1), F.ceil(F.col("radius") / F.col("cell"))).cast("int"))
        .groupBy("map_id", "cx", "cz", "reach", "cols", "rows").agg(F.max("top").alias("top"))
    )
    return _spread(centred, packed), grids


def occupancy_tiles(occ: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells of ``build_occupancy`` as its tiles."""
    sized = join_dim(occ, grids.select("map_id", "cols", "rows"), ["map_id"], ["gx", "gz"], "inner")
    return _spread(sized.select("map_id", F.col("gx").alias("cx"), F.col("gz").alias("cz"), F.lit(0).alias("reach"), "cols", "rows", "top"), True)


def _spread(centred: DataFrame, packed: bool) -> DataFrame:
    """Cells or tiles from disks ``map_id, cx, cz, reach, cols, rows, top``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def tiles(axis: str):
        ends = F.array(F.col(axis) - F.col("reach"), F.col(axis) + F.col("reach"))
        return F.explode(F.array_distinct(F.transform(ends, lambda p: F.floor(p / OCC_TILE).cast("int"))))

    tiled = centred.withColumn("top", F.col("top").cast("double")).filter(F.col("top") > 0).withColumn("tx", tiles("cx")).withColumn("tz", tiles("cz")).filter(
        F.col("tx").between(0, F.floor((F.col("cols") - 1) / OCC_TILE)) & F.col("tz").between(0, F.floor((F.col("rows") - 1) / OCC_TILE)))
    level = f"map_id {dict(centred.dtypes)['map_id']}"
    kinds = f"{level}, tx int, tz int, tops array<double>, data binary" if packed else f"{level}, gx int, gz int, top double"
    schema = to_arrow_schema(centred.sparkSession.createDataFrame([], kinds).schema)
    names = ["map_id", "tx", "tz", "cx", "cz", "reach", "cols", "rows", "top"]
    return fan_out(tiled.select(*names), "map_id", "tx", "tz").sortWithinPartitions("map_id", "tx", "tz").mapInArrow(
        lambda batches: _stamp(batches, schema, OCC_TILE), kinds)


def _whole_tiles(batches):
    """Rows sorted by tile, in batches that hold all rows of their tiles, and where each tile begins."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kept = None
    for batch in itertools.chain(batches, (None,)):
        rows = kept if batch is None else batch if kept is None else pa.concat_batches([kept, batch])
        if rows is None or not rows.num_rows:
            continue
        fresh = np.ones(rows.num_rows, bool)
        if rows.num_rows > 1:
            moved = [pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False) for c in range(3)]
            fresh[1:] = np.logical_or.reduce(moved)
        first = np.flatnonzero(fresh)
        if batch is not None:
            # the last tile may go on in the next batch
            kept, rows, first = rows.slice(int(first[-1])), rows.slice(0, int(first[-1])), first[:-1]
        if len(first):
            yield rows, first


def _stamp(batches, schema, side: int):
    """Disks of objects, sorted by tile, become cells (``gx, gz, top``) or tiles, as the schema says.

    A tile has the different heights of its objects in order (``tops``) and a number per cell, row by row: 0 for none, else the place of its highest top
    among them, counted from 1 (``data``, 16 bits each, low byte first).  Disks reach a few cells beyond the tile, which bounds their number well below 2^16.
    """
    import numpy as np
    import pyarrow as pa

    for rows, first in _whole_tiles(batches):
        column = {name: rows.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(rows.schema.names) if name != "map_id"}
        tiles = len(first)
        of = np.repeat(np.arange(tiles), np.diff(np.append(first, rows.num_rows)))
        # places of the tops among the different ones of their tile
        order = np.lexsort((column["top"], of))
        top, own = column["top"][order], of[order]
        new = np.append(True, (own[1:] != own[:-1]) | (top[1:] != top[:-1]))
        tops, edge = top[new], np.searchsorted(own[new], np.arange(tiles + 1))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - edge[own]
        highest = np.zeros(tiles * side * side, np.uint16)
        x0, z0 = column["tx"].astype(np.int64) * side, column["tz"].astype(np.int64) * side
        w, h = np.minimum(side, column["cols"] - x0), np.minimum(side, column["rows"] - z0)
        for reach in np.unique(column["reach"]).tolist():
            on = np.flatnonzero(column["reach"] == reach)
            span = np.arange(-reach, reach + 1)
            dx, dz = (v.reshape(-1) for v in np.meshgrid(span, span))
            dx, dz = (v[dx * dx + dz * dz <= reach * reach] for v in (dx, dz))
            x, z = ((column[c][on] - o[on])[:, None] + d for c, o, d in (("cx", x0, dx), ("cz", z0, dz)))
            inside = (x >= 0) & (x < w[on][:, None]) & (z >= 0) & (z < h[on][:, None])
            at = of[on][:, None] * (side * side) + z * w[on][:, None] + x
            np.maximum.at(highest, at[inside], np.broadcast_to(rank[on][:, None], at.shape)[inside].astype(np.uint16))
        if "data" in schema.names:
            cells = (w * h)[first]
            made = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tops)),
                    pa.array([highest[i * side * side:i * side * side + n].astype("<u2").tobytes() for i, n in enumerate(cells.tolist())], schema.field("data").type)]
            keys = [rows.column(c).take(pa.array(first)).cast(schema.field(c).type) for c in range(3)]
        else:
            full = np.flatnonzero(highest)
            tile, cell = full // (side * side), full % (side * side)
            at = first[tile]
            keys = [rows.column(0).take(pa.array(at))]
            made = [pa.array((o[at] + v).astype(np.int32)) for o, v in ((x0, cell % w[at]), (z0, cell // w[at]))] + [pa.array(tops[edge[tile] + highest[full].astype(np.int64) - 1])]
        yield pa.record_batch([*keys, *made], schema=schema)
