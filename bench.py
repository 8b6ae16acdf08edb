"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed with all result columns computed (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "viewshed", "viewshed_packed", "viewshed_objects", "sample_layers", "sample_tiles", "points_in_zones",
    "flood_from_border", "water_mask", "fill_nodata", "overlay_detail", "gradient_normals", "box_mean",
    "feather_seams", "hillshade", "splat_blend", "mosaic", "rasterize_triangles", "build_occupancy",
    "density_grid", "resolve_textures", "lc_reference_audit", "assign_export_index", "merge_intervals",
    "delta_decode", "mission_summary", "missions_for_maps", "read_missions", "read_instances", "scan_blocks",
]


def units(name: str, spark) -> int | None:
    """Rows a query works through, for a rate next to the seconds."""
    count = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count()
    if name.startswith("viewshed"):
        return count("supplier") * 360 * 375  # observers x rays x steps
    if name in ("sample_layers", "sample_tiles", "points_in_zones", "build_occupancy", "density_grid"):
        return count("lineitem")
    if name == "splat_blend":
        return count("customer") * 24  # pixels
    if name in ("flood_from_border", "water_mask", "fill_nodata", "overlay_detail", "gradient_normals", "box_mean",
                "feather_seams", "hillshade", "mosaic", "delta_decode"):
        return count("orders")
    return None


def main() -> None:
    from terralake.plans import all_queries
    from terralake.session import build_session

    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    picked = sys.argv[1:] or HEADLINE
    seconds, rates = {}, {}
    for name in picked:
        def run() -> float:
            start = time.perf_counter()
            registered[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        run()
        seconds[name] = round(run(), 3)
        n = units(name, spark)
        if n:
            rates[name] = round(n / seconds[name])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
