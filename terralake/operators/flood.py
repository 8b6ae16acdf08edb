"""Which masked cells are connected to the border of their raster, and the water mask built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import is_water_color, is_water_height
from ..session import cut
from .scans import SALTS, fan_out, join_dim, join_keyed, shuffled

_COMPONENT = "map_id {id}, px int, pz int, comp long"


def _label_sorted(pdf, side: int):
    """Connected parts of all tiles in a frame sorted by tile, row and column.

    A part is named after its first cell (pz * 2^32 + px). All tiles are handled at once: neighbours
    are found by their sorted keys, then labels are hooked to the smaller one and shortened.
    """
    import numpy as np

    x, z = pdf["px"].to_numpy().astype("int64"), pdf["pz"].to_numpy().astype("int64")
    tile = _tile_number(pdf, side)
    key = (tile * (side + 1) + z % side) * (side + 1) + x % side
    n = len(key)
    at = np.arange(n)
    right = at[:-1][key[1:] == key[:-1] + 1]
    found = np.searchsorted(key, key + side + 1)
    down = at[(found < n) & (key[np.minimum(found, n - 1)] == key + side + 1) & (z % side < side - 1)]
    a, b = np.concatenate([right, down]), np.concatenate([right + 1, found[down]])
    label = at.copy()
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        shorter = label[label]
        while (shorter != label).any():
            label, shorter = shorter, shorter[shorter]
    return pdf[["map_id", "px", "pz"]].assign(comp=z[label] * (1 << 32) + x[label])


def _tile_number(pdf, side: int):
    """Running number of the tile each row belongs to."""
    import numpy as np

    columns = [pdf["map_id"].to_numpy(), pdf["px"].to_numpy() // side, pdf["pz"].to_numpy() // side]
    new = np.zeros(len(pdf), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new).astype("int64")


def _label_batches(batches, side: int):
    """Label whole tiles; the last tile of a batch may go on in the next one and waits for it."""
    import pandas as pd

    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf) == 0:
            continue
        tile = _tile_number(pdf, side)
        whole = tile < tile[-1]
        rest = pdf[~whole].reset_index(drop=True)
        if whole.any():
            yield _label_sorted(pdf[whole].reset_index(drop=True), side)
    if rest is not None and len(rest):
        yield _label_sorted(rest, side)


def label_tiles(mask: DataFrame, side: int = 64) -> DataFrame:
    """Component of every masked cell within its own tile.

    Tiles are spread by hash over a fixed number of partitions and sorted; Python then works on whole
    Arrow batches of tiles and never holds more than a batch and one tile (side x side cells).
    """
    kind = dict(mask.dtypes)["map_id"]
    tx, tz = F.floor(F.col("px") / side), F.floor(F.col("pz") / side)
    tiled = (
        fan_out(mask.select("map_id", "px", "pz"), "map_id", tx, tz)
        .sortWithinPartitions("map_id", tz, tx, "pz", "px")
    )
    return tiled.mapInPandas(lambda batches: _label_batches(batches, side), _COMPONENT.format(id=kind))


def seam_edges(cells: DataFrame, side: int) -> DataFrame:
    """Pairs of components that touch across a tile border; only cells on such borders take part."""
    def pairs(axis: str, other: str) -> DataFrame:
        low = cells.filter(F.col(axis) % side == side - 1).select(
            "map_id", (F.col(axis) + 1).alias(axis), other, F.col("comp").alias("a")
        )
        high = cells.filter(F.col(axis) % side == 0).select("map_id", axis, other, F.col("comp").alias("b"))
        return low.join(shuffled(high), ["map_id", axis, other]).select("map_id", "a", "b")

    return pairs("px", "pz").unionByName(pairs("pz", "px"))


def _stars(keys, a, b):
    """Every node of some edges that isn't the smallest of its part, and that smallest one: a spanning forest of stars (numpy arrays)."""
    import numpy as np

    key, node = np.concatenate([keys, keys]), np.concatenate([a, b])
    order = np.lexsort((node, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(node[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    key, node = key[order][fresh], node[order][fresh]
    x, y = number[:len(a)], number[len(a):]
    label = np.arange(len(node))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        if not apart.any():
            break
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        shorter = label[label]
        while (shorter != label).any():
            label, shorter = shorter, shorter[shorter]
    inner = label != np.arange(len(node))
    return key[inner], node[inner], node[label[inner]]


def _contract_batches(batches, held: int):
    import numpy as np
    import pandas as pd

    rest: list = []

    def forest():
        pdf = pd.concat(rest, ignore_index=True)
        codes, names = pd.factorize(pdf["map_id"], use_na_sentinel=False)
        key, node, root = _stars(codes.astype(np.int64), pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        return pd.DataFrame({"map_id": names.take(key), "a": node, "b": root})

    for pdf in batches:
        rest.append(pdf)
        if sum(map(len, rest)) >= held:
            rest = [forest()]
            if len(rest[0]) >= held // 2:
                yield rest[0]
                rest = []
    if rest:
        yield forest()


def contract_edges(edges: DataFrame, held: int = 1 << 21) -> DataFrame:
    """Edges (``map_id, a, b``) as a spanning forest of stars per task, the higher end in ``a``: what parts a task's own edges connect is settled
    before anything is shuffled. About ``held`` edges are in memory at once."""
    kind = dict(edges.dtypes)["map_id"]
    return edges.select("map_id", "a", "b").mapInPandas(lambda batches: _contract_batches(batches, held), f"map_id {kind}, a long, b long")


def component_roots(edges: DataFrame, max_rounds: int = 64, most: int = 1 << 18, salts: int = SALTS) -> DataFrame:
    """Smallest component reachable from every component that has an edge (``map_id, a, root``).

    A round contracts the edges of every task to a forest, brings the edges of a node together and contracts again. Nodes with one lower neighbour
    and no higher one are then set aside with it: they can't connect anything. The others go into the next round, where the higher end of every edge
    first moves to the lowest neighbour of the lower end (the large-star step of Kiveris et al., 2014), which keeps the number of rounds
    logarithmic. That join is spread over ``salts``, since a root may be the lower end of most edges; it has a row per inner node on its other side.
    At most ``most`` edges are left to one task. What was set aside takes its roots from the later rounds, latest first.

    Every round is written to the shared folder.
    """
    active, aside, roots = edges, [], None
    for _ in range(max_rounds):
        current = cut(contract_edges(contract_edges(active).repartition("map_id", "a")), "edges")
        ends = current.select("map_id", F.col("a").alias("node"), F.col("b").alias("low"), F.lit(False).alias("lower")).unionByName(
            current.select("map_id", F.col("b").alias("node"), F.lit(None).cast("long").alias("low"), F.lit(True).alias("lower")))
        nodes = cut(ends.groupBy("map_id", "node").agg(F.min("low").alias("low"), F.count("low").alias("n"), F.max("lower").alias("lower")), "nodes")
        aside.append(nodes.filter("n = 1 AND NOT lower").select("map_id", F.col("node").alias("a"), F.col("low").alias("b")))
        inner = nodes.filter("n > 1 OR (n = 1 AND lower)").select("map_id", F.col("node").alias("a"), "low")
        active = join_keyed(current, shuffled(inner.select("map_id", "a")), ["map_id", "a"], "left_semi")
        left = inner.limit(most + 1).count() and active.limit(most + 1).count()
        if not left:
            break
        if left <= most:
            roots = cut(contract_edges(active.repartition(1)).withColumnRenamed("b", "root"), "roots")
            break
        lowest = inner.select("map_id", F.col("a").alias("b"), "low")
        active = join_dim(active, lowest, ["map_id", "b"], ["a"], "left", salts).select("map_id", "a", F.coalesce("low", "b").alias("b"))
    else:
        raise RuntimeError("components did not settle")
    for leaves in reversed(aside):
        if roots is None:
            roots = leaves.withColumnRenamed("b", "root")
        else:
            above = roots.select("map_id", F.col("a").alias("b"), "root")
            found = join_dim(leaves, above, ["map_id", "b"], ["a"], "left", salts).select("map_id", "a", F.coalesce("root", "b").alias("root"))
            roots = roots.unionByName(found)
    return roots


def flood_from_border(mask: DataFrame, layers: DataFrame, tile: int = 64) -> DataFrame:
    """Masked cells 4-connected to the raster border through masked cells.

    ``mask`` holds the masked cells only (``map_id, px, pz``); ``layers`` one size per map. Parts and roots grow with the levels and are never broadcast.
    """
    cells = cut(label_tiles(mask, tile), "components")
    roots = component_roots(seam_edges(cells, tile))
    sized = join_dim(cells, layers.select("map_id", "width", "height"), ["map_id"], ["px", "pz"], "inner")
    border = (
        (F.col("px") == 0) | (F.col("px") == F.col("width") - 1)
        | (F.col("pz") == 0) | (F.col("pz") == F.col("height") - 1)
    )
    parts = (
        sized.groupBy("map_id", "comp").agg(F.max(border).alias("seed"))
        .join(shuffled(roots.withColumnRenamed("a", "comp")), ["map_id", "comp"], "left")
        .withColumn("root", F.coalesce("root", "comp"))
    )
    reached = parts.groupBy("map_id", "root").agg(F.max("seed").alias("hit")).filter("hit")
    wet = parts.join(shuffled(reached.select("map_id", "root")), ["map_id", "root"], "left_semi").select("map_id", "comp")
    return cells.join(shuffled(wet), ["map_id", "comp"], "left_semi").select("map_id", "px", "pz")


# ---- water mask ------------------------------------------------------------------------------


def water_candidates(raster: DataFrame, layers: DataFrame, water: DataFrame, levels: int = 255) -> DataFrame:
    """Cells low enough to be water; ``water`` holds ``map_id, water_level``.

    Maps whose lowest point lies above the water are dropped before their cells are read.
    """
    usable = (
        layers.select("map_id", "v_min", "v_max").join(water, "map_id")
        .filter((F.col("v_max") > F.col("v_min")) & (F.col("v_min") <= F.col("water_level")))
    )
    return join_dim(raster, usable, ["map_id"], ["px", "pz"], "inner").filter(
        is_water_height("v", "water_level", F.col("v_min"), F.col("v_max"), levels)
    ).select("map_id", "px", "pz")


def water_color_candidates(rgb: DataFrame) -> DataFrame:
    return rgb.filter(is_water_color("r", "g", "b")).select("map_id", "px", "pz")


def cell_water_ratio(mask: DataFrame, tile_w: int, tile_h: int, wet: str = "wet", share: float = 0.08) -> DataFrame:
    """Share of wet pixels per terrain cell, and whether that makes the cell water."""
    tx, tz = F.floor(F.col("px") / tile_w).cast("int"), F.floor(F.col("pz") / tile_h).cast("int")
    return (
        mask.groupBy("map_id", tx.alias("tx"), tz.alias("tz"))
        .agg(F.avg(F.col(wet).cast("double")).alias("ratio"))
        .withColumn("override", F.col("ratio") >= share)
    )


def union_mask(reached: DataFrame, candidates: DataFrame, overrides: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Reached cells, and candidates inside cells that count as water."""
    tx, tz = F.floor(F.col("px") / tile_w).cast("int"), F.floor(F.col("pz") / tile_h).cast("int")
    inside = candidates.withColumn("tx", tx).withColumn("tz", tz).join(
        shuffled(overrides.filter("override").select("map_id", "tx", "tz")), ["map_id", "tx", "tz"], "left_semi"
    )
    return reached.select("map_id", "px", "pz").unionByName(inside.select("map_id", "px", "pz")).distinct()


def water_mask(pixels: DataFrame, layers: DataFrame, cells: DataFrame | None = None, tile_w: int = 64,
               tile_h: int = 64, flood_tile: int = 64) -> DataFrame:
    """Cells to paint as water.

    ``pixels`` holds every cell of the raster with a flag ``wet`` (candidate); ``cells`` the terrain
    grid (``map_id, tx, tz, protected``).  With a terrain grid, cells with enough candidates count as
    water even where the border is not reached, and protected cells stay dry otherwise.  Without one,
    maps the border flood never enters keep their candidates only if these are under 5 %.
    """
    candidates = pixels.filter("wet").select("map_id", "px", "pz")
    reached = flood_from_border(candidates, layers, flood_tile)
    if cells is None:
        share = pixels.groupBy("map_id").agg(F.avg(F.col("wet").cast("double")).alias("share"))
        dry = share.filter("share < 0.05").join(
            reached.select("map_id").distinct(), "map_id", "left_anti"
        ).select("map_id")
        few = join_dim(candidates, dry, ["map_id"], ["px", "pz"], "inner").select("map_id", "px", "pz")
        return reached.unionByName(few)
    ratio = cut(cell_water_ratio(pixels, tile_w, tile_h), "ratio")
    merged = union_mask(reached, candidates, ratio, tile_w, tile_h)
    tx, tz = F.floor(F.col("px") / tile_w).cast("int"), F.floor(F.col("pz") / tile_h).cast("int")
    kept_dry = cells.filter("protected").select("map_id", "tx", "tz").join(
        shuffled(ratio.filter("override").select("map_id", "tx", "tz")), ["map_id", "tx", "tz"], "left_anti"
    )
    return merged.withColumn("tx", tx).withColumn("tz", tz).join(
        shuffled(kept_dry), ["map_id", "tx", "tz"], "left_anti"
    ).select("map_id", "px", "pz")
