"""Writing tables: objects, rasters, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_instances(instances: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Object table by level, positions rounded to 0.1 m.

    The rows are rebalanced by level at run time: small levels share tasks, and a large one is split by its size.
    """
    rounded = instances.withColumns({
        c: (F.round(F.col(c).cast("double") * 10) / 10).cast("float") for c in ("x", "y", "z")
    })
    rounded.hint("rebalance", "map_id").write.mode(mode).partitionBy("map_id").parquet(path)


def write_raster(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tile table, clustered by map and position so that readers skip files by their statistics."""
    ordered = tiles.repartitionByRange("map_id", "tz", "tx").sortWithinPartitions("map_id", "tz", "tx")
    ordered.write.mode(mode).partitionBy("layer").parquet(path)


def assemble_manifests(maps: DataFrame, layers: DataFrame | None = None, landclasses: DataFrame | None = None,
                       pools: DataFrame | None = None, missions: DataFrame | None = None) -> DataFrame:
    """One nested JSON document per map.

    Only short lists are nested (layers, landclasses, pools: at most a few hundred per map).
    """
    out = maps
    if layers is not None:
        row = F.struct("layer", "width", "height", F.array("x0", "z0", "x1", "z1").alias("world_extent"))
        out = out.join(layers.groupBy("map_id").agg(F.array_sort(F.collect_list(row)).alias("layers")), "map_id", "left")
    if landclasses is not None:
        row = F.struct("lc_idx", "name", "texture")
        out = out.join(landclasses.groupBy("map_id").agg(F.array_sort(F.collect_list(row)).alias("landclasses")), "map_id", "left")
    if pools is not None:
        row = F.struct("pool_idx", "name", "category", F.col("n").alias("count"))
        nested = pools.groupBy("map_id").agg(
            F.sum("n").alias("instanceCount"), F.count(F.lit(1)).alias("poolCount"),
            F.array_sort(F.collect_list(row)).alias("pools"),
        )
        out = out.join(nested, "map_id", "left")
    if missions is not None:
        has = missions.select("map_id").distinct().withColumn("hasMissions", F.lit(True))
        out = out.join(has, "map_id", "left").withColumn("hasMissions", F.coalesce("hasMissions", F.lit(False)))
    fields = [c for c in out.columns if c != "map_id"]
    body = F.to_json(F.struct(F.col("map_id").alias("mapName"), *fields), {"ignoreNullFields": "false"})
    return out.select("map_id", body.alias("manifest"))


def write_manifest(maps: DataFrame, path: str, mode: str = "overwrite", **tables: DataFrame) -> None:
    """Write the documents as JSON lines, one per map; ``readers.read_manifest_lines`` reads them back."""
    assemble_manifests(maps, **tables).select(F.col("manifest").alias("value")).write.mode(mode).text(path)
