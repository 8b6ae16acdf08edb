"""Hand-made grids."""

import math
import random
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralake.operators import flood, raster, sampling, scans, terrain, viewshed

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def cells(spark, grid, map_id=0):
    rows = [(map_id, x, z, None if v is None else float(v)) for z, row in enumerate(grid) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "map_id long, px int, pz int, v double")


def layer(spark, w, h, extent=(0.0, 0.0, 100.0, 100.0), lo=0.0, hi=100.0, map_id=0, name="base", priority=2):
    return spark.createDataFrame(
        [(map_id, name, priority, w, h, *extent, lo, hi)],
        "map_id long, layer string, priority int, width int, height int, x0 double, z0 double, x1 double, z1 double, v_min double, v_max double",
    )


def as_grid(df, w, h, v="v"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["pz"], r["px"]] = np.nan if r[v] is None else r[v]
    return out


def test_plane_normals(spark):
    n = raster.gradient_normals(cells(spark, [[0, 2, 4]] * 3), layer(spark, 3, 3)).collect()
    by = {(r.px, r.pz): (r.nr, r.ng, r.nb) for r in n}
    m = (4 + 1) ** 0.5
    assert by[1, 1] == (int((-2 / m * 0.5 + 0.5) * 255), 127, int((1 / m * 0.5 + 0.5) * 255))
    assert all(v == (0, 0, 0) for k, v in by.items() if k != (1, 1))


def fill_by_hand(grid):
    """Straight reading of the filling rule on a small array."""
    if np.isnan(grid).all():
        return np.zeros_like(grid)
    levels = [grid.copy()]
    while max(levels[-1].shape) > 4:
        g = levels[-1]
        h, w = max(g.shape[0] // 2, 1), max(g.shape[1] // 2, 1)
        nxt = np.full((h, w), np.nan)
        for z in range(h):
            for x in range(w):
                block = g[2 * z:2 * z + 2, 2 * x:2 * x + 2]
                if not np.isnan(block).all():
                    nxt[z, x] = np.nanmean(block)
        levels.append(nxt)
    g = levels[-1]
    for _ in range(4 * max(g.shape)):
        snap = g.copy()
        for z in range(g.shape[0]):
            for x in range(g.shape[1]):
                near = [snap[b, a] for a, b in ((x - 1, z), (x + 1, z), (x, z - 1), (x, z + 1)) if 0 <= a < g.shape[1] and 0 <= b < g.shape[0]]
                near = [n for n in near if not np.isnan(n)]
                if np.isnan(snap[z, x]) and near:
                    g[z, x] = sum(near) / len(near)
    g[np.isnan(g)] = 0
    for i in range(len(levels) - 2, -1, -1):
        fine, coarse = levels[i], levels[i + 1]
        for z in range(fine.shape[0]):
            for x in range(fine.shape[1]):
                if not np.isnan(fine[z, x]):
                    continue
                cx = max((x + 0.5) / fine.shape[1] * coarse.shape[1] - 0.5, 0)
                cz = max((z + 0.5) / fine.shape[0] * coarse.shape[0] - 0.5, 0)
                x0, z0 = min(int(cx), coarse.shape[1] - 1), min(int(cz), coarse.shape[0] - 1)
                x1, z1 = min(x0 + 1, coarse.shape[1] - 1), min(z0 + 1, coarse.shape[0] - 1)
                fx, fz = cx - x0, cz - z0
                fine[z, x] = (coarse[z0, x0] * (1 - fx) * (1 - fz) + coarse[z0, x1] * fx * (1 - fz)
                              + coarse[z1, x0] * (1 - fx) * fz + coarse[z1, x1] * fx * fz)
    return levels[0]


@pytest.mark.parametrize("side, known", [(4, 1), (8, 5), (20, 9), (5, 0)])
def test_fill_matches_the_rule(spark, side, known):
    rng = np.random.default_rng(side)
    grid = np.full((side, side), np.nan)
    for _ in range(known):
        grid[rng.integers(side), rng.integers(side)] = rng.integers(1, 50)
    want = fill_by_hand(grid.copy())
    data = [[None if np.isnan(v) else v for v in row] for row in grid]
    got = as_grid(raster.fill_nodata(cells(spark, data), layer(spark, side, side)), side, side)
    assert np.allclose(got, want)
    assert np.allclose(got[~np.isnan(grid)], grid[~np.isnan(grid)])


def test_fill_of_layers_with_different_depths(spark):
    a = [[1.0 if (x, z) == (0, 0) else None for x in range(3)] for z in range(3)]
    b = [[float(x) if z == 7 else None for x in range(12)] for z in range(12)]
    both = cells(spark, a, 1).unionByName(cells(spark, b, 2))
    sizes = layer(spark, 3, 3, map_id=1).unionByName(layer(spark, 12, 12, map_id=2))
    out = raster.fill_nodata(both, sizes)
    assert np.allclose(as_grid(out.filter("map_id = 1"), 3, 3), 1.0)
    want = fill_by_hand(np.array([[np.nan if v is None else v for v in r] for r in b]))
    assert np.allclose(as_grid(out.filter("map_id = 2"), 12, 12), want)


def test_triangle_edges_and_degenerate(spark):
    t = spark.createDataFrame(
        [(0, 1, 0.0, 1.0, 0.0, 4.0, 1.0, 0.0, 0.0, 1.0, 4.0), (0, 2, 0.0, 9.0, 0.0, 2.0, 9.0, 2.0, 4.0, 9.0, 4.0)],
        "map_id long, tri_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double",
    )
    got = {(r.px, r.pz): r.h for r in raster.rasterize_triangles(t, layer(spark, 4, 4, (0.0, 0.0, 4.0, 4.0)), (4, 4), side=2).collect()}
    assert set(got) == {(x, z) for x in range(4) for z in range(4) if x + z <= 3}  # x + z = 3 lies on the edge
    assert set(got.values()) == {1.0}
    higher = t.filter("tri_id = 1").withColumn("tri_id", F.lit(3).cast("long")).withColumns({c: F.lit(5.0) for c in ("y0", "y1", "y2")})
    got = raster.rasterize_triangles(t.unionByName(higher), layer(spark, 4, 4, (0.0, 0.0, 4.0, 4.0)), (4, 4)).agg(F.min("h")).first()[0]
    assert got == 5.0


LAKE = ["#####", "#...#", "#.#.#", "#...#", "#####"]


def mask_of(spark, rows, wet="#", map_id=0):
    found = [(map_id, x, z) for z, row in enumerate(rows) for x, c in enumerate(row) if c == wet]
    return spark.createDataFrame(found, "map_id long, px int, pz int")


@pytest.mark.parametrize("tile", [1, 2, 64])
def test_lake_is_not_reached(spark, tile):
    got = {(r.px, r.pz) for r in flood.flood_from_border(mask_of(spark, LAKE), layer(spark, 5, 5), tile).collect()}
    assert (2, 2) not in got and len(got) == 16


def flood_by_hand(grid):
    h, w = grid.shape
    todo = [(x, z) for z in range(h) for x in range(w) if grid[z, x] and (x in (0, w - 1) or z in (0, h - 1))]
    seen = set(todo)
    while todo:
        x, z = todo.pop()
        for a, b in ((x - 1, z), (x + 1, z), (x, z - 1), (x, z + 1)):
            if 0 <= a < w and 0 <= b < h and grid[b, a] and (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return seen


@SLOW
@given(st.integers(0, 10**6), st.sampled_from([2, 3, 5, 8]))
def test_flood_matches_brute_force(spark, seed, tile):
    grid = np.random.default_rng(seed).random((13, 17)) < 0.6
    rows = ["".join("#" if v else "." for v in r) for r in grid]
    got = {(r.px, r.pz) for r in flood.flood_from_border(mask_of(spark, rows), layer(spark, 17, 13), tile).collect()}
    assert got == flood_by_hand(grid)


def test_snake_needs_few_rounds(spark):
    """One winding channel through all tiles: its length must not set the number of rounds."""
    rows = []
    for z in range(31):
        rows.append("#" * 31 if z % 2 == 0 else ("." * 30 + "#" if z % 4 == 1 else "#" + "." * 30))
    tiles = flood.label_tiles(mask_of(spark, rows), 2)
    roots = flood.component_roots(flood.seam_edges(tiles, 2), max_rounds=9, most=0)
    assert roots.select("root").distinct().count() == 1


def random_edges():
    """Chains, stars, sparse random graphs and nodes with many lower neighbours, on three maps of which one has no name."""
    rng = random.Random(1)
    for m in (None, 1, 2):
        yield from ((m, i + 1, i) for i in range(120))
        yield from ((m, 1000 + i, 1000) for i in range(1, 200))
        yield from ((m, 2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(160))
        yield from ((m, 5000 + i, 4000 + i % 7) for i in range(40))
        yield from ((m, 7000, 6000 + i) for i in range(60))


@pytest.mark.parametrize("most", [0, 20, 1 << 18])
def test_components_in_rounds_or_in_one_task(spark, most):
    edges = list(random_edges())
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for m, a, b in edges:
        x, y = sorted((root((m, a)), root((m, b))), key=lambda n: n[1])
        above[y] = x
    got = flood.component_roots(spark.createDataFrame(edges, "map_id long, a long, b long").repartition(5), most=most, salts=3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*n, root(n)[1]) for n in list(above) if root(n) != n), key=repr)


def test_contraction_leaves_a_forest(spark):
    """All cells of a lake touch each other many times; what a task passes on is at most one edge per node."""
    edges = spark.range(3000).selectExpr("1L AS map_id", "id % 50 + 1 AS a", "(id * 7 + id div 50) % 50 AS b").coalesce(1)
    assert flood.contract_edges(edges).count() == 50
    assert flood.contract_edges(edges, held=64).count() <= 50 * (3000 // 64)


def test_water_override_and_protection(spark):
    # the lake of one cell is 1/25 of its terrain cell: no override at 8 %, dry when protected
    pixels = mask_of(spark, LAKE).withColumn("wet", F.lit(True)).unionByName(mask_of(spark, LAKE, ".").withColumn("wet", F.lit(False)))
    cell = spark.createDataFrame([(0, 0, 0, True)], "map_id long, tx int, tz int, protected boolean")
    got = flood.water_mask(pixels, layer(spark, 5, 5), cell, 5, 5)
    assert got.count() == 17  # 17 of 25 wet: the whole cell counts as water
    small = mask_of(spark, [".....", ".....", "..#..", ".....", "....."])
    dry = small.withColumn("wet", F.lit(True)).unionByName(
        mask_of(spark, ["#####", "#####", "##.##", "#####", "#####"]).withColumn("wet", F.lit(False)))
    assert flood.water_mask(dry, layer(spark, 5, 5), cell, 5, 5).count() == 0  # 4 % and never reached
    assert flood.water_mask(dry, layer(spark, 5, 5), cell, 3, 3).count() == 1  # 11 % of a smaller cell
    assert flood.water_mask(dry, layer(spark, 5, 5)).count() == 1  # no terrain grid: under 5 %
    edge = mask_of(spark, ["#....", ".....", ".....", ".....", "....."]).withColumn("wet", F.lit(True)).unionByName(
        mask_of(spark, [".####", "#####", "#####", "#####", "#####"]).withColumn("wet", F.lit(False)))
    assert flood.water_mask(edge, layer(spark, 5, 5), cell, 5, 5).count() == 0  # reached, but protected and only 4 %
    free = cell.withColumn("protected", F.lit(False))
    assert flood.water_mask(edge, layer(spark, 5, 5), free, 5, 5).count() == 1


# ---- line of sight ---------------------------------------------------------------------------


def observe(spark, grid, occ=None, grids=None, rays=4, extent=None, at=(0.0, 0.0), eye=5.0, step=10.0, reach=60.0):
    h, w = len(grid), len(grid[0])
    extent = extent or (0.0, 0.0, (w - 1) * 10.0, max((h - 1) * 10.0, 1.0))
    obs = spark.createDataFrame([(1, 0, *at)], "observer long, map_id long, x double, z double")
    v = viewshed.viewshed(obs, cells(spark, grid).withColumn("layer", F.lit("base")), layer(spark, w, h, extent), occ, grids,
                          rays=rays, range_m=reach, step_m=step, eye_m=eye)
    return {(r.ray, r.step): r.visible for r in v.collect()}


def test_wall_hides_what_is_behind(spark):
    seen = observe(spark, [[0, 0, 30, 0, 0, 0, 0]] * 2)
    assert [seen[0, s] for s in range(6)] == [True, True, False, False, False, False]


def test_equal_slope_stays_visible(spark):
    seen = observe(spark, [[0, 5, 5, 5, 5, 5, 5]] * 2)
    assert all(seen[0, s] for s in range(6))


def occupancy(spark, x, top):
    occ = spark.createDataFrame([(0, int(x), 0, float(top))], "map_id long, gx int, gz int, top double")
    return occ, spark.createDataFrame([(0, 0.0, 0.0, 1.0, 100, 100)], "map_id long, x0 double, z0 double, cell double, cols int, rows int")


def test_object_before_the_first_step_blocks_the_ray(spark):
    seen = observe(spark, [[0] * 7] * 2, *occupancy(spark, 4, 0.5))
    assert not any(seen[0, s] for s in range(6))


def test_object_behind_a_hill_does_not_block(spark):
    free = observe(spark, [[0, 0, 30, 0, 0, 0, 200]] * 2)
    seen = observe(spark, [[0, 0, 30, 0, 0, 0, 200]] * 2, *occupancy(spark, 34, 10))
    assert free == seen and seen[0, 5]


def test_a_higher_eye_sees_no_less_on_flat_ground(spark):
    low, high = (observe(spark, [[0] * 7] * 7, eye=e, rays=8) for e in (1.0, 20.0))
    assert all(high[k] or not low[k] for k in low)


# ---- invariance ------------------------------------------------------------------------------


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    data = cells(spark, rng.integers(0, 99, (9, 11)).tolist())
    sizes = layer(spark, 11, 9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        box = raster.box_mean(data, 2, side=4)
        total = scans.running_sum(data.withColumn("i", F.expr("pz * 11 + px")), ["map_id"], "i", "v", "s", chunk=8)
        out.append((sorted(map(tuple, box.collect())), sorted(map(tuple, total.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


@SLOW
@given(st.integers(1, 9), st.integers(1, 11), st.integers(1, 5), st.integers(0, 999))
def test_pack_and_unpack(spark, h, w, side, seed):
    grid = np.random.default_rng(seed).integers(-9, 9, (h, w)).tolist()
    data = cells(spark, [[None if v == 0 else v for v in r] for r in grid]).withColumn("layer", F.lit("base"))
    back = raster.unpack_tiles(raster.pack_tiles(data, layer(spark, w, h), side), side)
    assert sorted(map(repr, back.select(data.columns).collect())) == sorted(map(repr, data.collect()))


def test_salted_join_equals_plain_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    facts = spark.range(500).select((F.col("id") % 3).alias("map_id"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "map_id long, name string")
    got = scans.join_dim(facts, dim, ["map_id"], ["id"])
    assert "_salt" in got._jdf.queryExecution().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, facts.join(dim, "map_id", "left").collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_outside_rules(spark):
    data = cells(spark, [[1, 2], [3, 4]]).withColumn("layer", F.lit("base"))
    p = spark.createDataFrame([(0, 150.0, 50.0)], "map_id long, x double, z double")
    got = {o: sampling.sample_layers(p, data, layer(spark, 2, 2, lo=-7.0), outside=o).first()["h"] for o in ("null", "clamp", "min")}
    assert got == {"null": None, "clamp": 4.0, "min": -7.0}


def test_flat_stand_in(spark):
    flat = terrain.pseudo_height(layers=layer(spark, 4, 4).select("map_id", "layer", "width", "height"))
    assert flat.count() == 512 * 512 and flat.agg(F.max("v"), F.min("v")).first() == (128.0, 128.0)


def test_line_of_sight_queries_run_the_whole_size(spark):
    from terralake.plans import q_raster

    assert (q_raster.RAYS, q_raster.N_STEPS, q_raster.STEP) == (360, 375, 4.0)
    rng = np.random.default_rng(4)
    grid = rng.integers(0, 40, (30, 40)).astype(float)
    grid[10:12, 20:30] = 90
    extent = (0.0, 0.0, 2000.0, 1500.0)
    obs = spark.createDataFrame([(1, 0, 900.5, 700.25)], "observer long, map_id long, x double, z double")
    v = viewshed.viewshed(obs, cells(spark, grid).withColumn("layer", F.lit("base")), layer(spark, 40, 30, extent), rays=q_raster.RAYS, range_m=q_raster.RANGE, step_m=q_raster.STEP)
    got = v.select("ray", "step", "visible").toPandas()
    seen = np.zeros((360, 375), bool)
    seen[got["ray"], got["step"]] = got["visible"]
    dist = (np.arange(375) + 1) * 4.0
    angle = np.arange(360)[:, None] / 360.0 * 2 * np.pi
    at = lambda x, z: (np.floor(x / 2000 * 39 + 0.5).astype(int), np.floor(z / 1500 * 29 + 0.5).astype(int))
    px, pz = at(900.5 + np.cos(angle) * dist, 700.25 + np.sin(angle) * dist)
    inside = (px >= 0) & (px < 40) & (pz >= 0) & (pz < 30)
    h = np.where(inside, grid[pz.clip(0, 29), px.clip(0, 39)], 0.0)
    ex, ez = at(np.array(900.5), np.array(700.25))
    slope = (h - (grid[ez, ex] + 5.0)) / dist
    before = np.concatenate([np.full((360, 1), -1e10), np.maximum.accumulate(slope, 1)[:, :-1]], 1)
    assert len(got) == 360 * 375 and (seen != (slope >= before)).sum() <= 20  # cosines may differ in the last bit


# ---- packed tiles ----------------------------------------------------------------------------


def big_raster(spark, side, layer_name="base"):
    return spark.range(side * side).select(
        F.lit(0).cast("long").alias("map_id"), F.lit(layer_name).alias("layer"), (F.col("id") % side).cast("int").alias("px"),
        F.floor(F.col("id") / side).cast("int").alias("pz"), ((F.col("id") * 7919) % 1009).cast("double").alias("v"),
    )


@pytest.mark.parametrize("step", [1, 3])
def test_packing_takes_linear_time(spark, step):
    """A dense (or every third cell of a) raster of 1024 x 1024 cells, 256 tiles of 64 x 64: well under 50 ms a tile."""
    cells_ = big_raster(spark, 1024).filter(F.expr(f"(px + pz * 1024) % {step} = 0"))
    start = time.perf_counter()
    sums = raster.pack_tiles(cells_, layer(spark, 1024, 1024)).agg(
        F.count(F.lit(1)), F.sum(F.size("data")), F.sum(F.aggregate("data", F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))))).first()
    assert time.perf_counter() - start < 256 * 0.05
    assert tuple(sums) == (256, 1 << 20, cells_.agg(F.sum("v")).first()[0])


def test_points_without_a_cell_are_dealt_over_all_tasks(spark):
    """No null key reaches the shuffle of the cell join, and points outside the raster don't meet in one partition."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    points = spark.range(4000).select(F.lit(0).cast("long").alias("map_id"), (F.col("id") + 1000.0).alias("x"), F.lit(-5.0).alias("z"))
    found = sampling.sample_layers(points, big_raster(spark, 8), layer(spark, 8, 8), outside="null")
    sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    keys = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2 * 4000 / len(sizes) and len(sizes) == 4
    assert "coalesce(px" in keys.replace(" ", "") or "_px" in keys


def test_points_without_a_layer_have_no_cell(spark):
    """Outside all layers, or on a map without layers, a point has no cell; it is not the raster's cell (0, 0)."""
    points = spark.createDataFrame([(0, 0.0, 0.0), (0, 500.0, -5.0), (7, 0.0, 0.0)], "map_id long, x double, z double")
    for outside, far in (("null", (None, None, None)), ("clamp", ("base", 7, 0)), ("min", ("base", None, None))):
        found = sampling.sample_layers(points, big_raster(spark, 8), layer(spark, 8, 8), outside=outside)
        cells = {(r["map_id"], r["x"]): (r["layer"], r["px"], r["pz"]) for r in found.collect()}
        assert cells == {(0, 0.0): ("base", 0, 0), (0, 500.0): far, (7, 0.0): (None, None, None)}


def sight_by_hand(obs, layers, grids, rays, steps, step_m, side=None):
    """Heights by layer priority with nodes; lowest height of the last layer where none has a cell."""
    def height(x, z):
        for name, (x0, z0, x1, z1), lo in layers:
            grid = grids[name]
            if x0 <= x <= x1 and z0 <= z <= z1 or name == layers[-1][0]:
                h, w = grid.shape
                px, pz = int(np.floor((x - x0) / (x1 - x0) * (w - 1) + 0.5)), int(np.floor((z - z0) / (z1 - z0) * (h - 1) + 0.5))
                return grid[pz, px] if 0 <= px < w and 0 <= pz < h else lo
    out = {}
    for o, x, z in obs:
        eye = height(x, z) + 5.0
        for ray in range(rays):
            before = -1e10
            for step in range(steps):
                d = (step + 1) * step_m
                h = height(x + np.cos(ray / rays * 2 * np.pi) * d, z + np.sin(ray / rays * 2 * np.pi) * d)
                if np.isnan(h):
                    out[o, ray, step] = (None, None)
                    continue
                slope = (h - eye) / d
                out[o, ray, step] = (h, bool(slope >= before))
                before = max(before, slope)
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_rays_over_two_layers_with_holes(spark, packed):
    rng = np.random.default_rng(8)
    grids = {"base": rng.integers(0, 60, (70, 90)).astype(float), "detail": rng.integers(0, 90, (20, 30)).astype(float)}
    grids["base"][30:34, 40:60] = np.nan
    extents = {"base": (0.0, 0.0, 900.0, 700.0), "detail": (100.0, 100.0, 250.0, 200.0)}
    layers = layer(spark, 30, 20, extents["detail"], name="detail", priority=1).unionByName(layer(spark, 90, 70, extents["base"], lo=-3.0))
    data = None
    for name, grid in grids.items():
        part = cells(spark, [[None if np.isnan(v) else v for v in row] for row in grid.tolist()]).withColumn("layer", F.lit(name))
        data = part if data is None else data.unionByName(part)
    obs = [(1, 151.5, 160.25), (2, 880.0, 690.0), (3, 5000.0, 5000.0)]
    observers = spark.createDataFrame([(o, 0, x, z) for o, x, z in obs], "observer long, map_id long, x double, z double")
    rasters = raster.pack_tiles(data, layers) if packed else data
    got = viewshed.viewshed(observers, rasters, layers, rays=24, range_m=1000.0, step_m=10.0, packed=packed).collect()
    want = sight_by_hand(obs, [(n, extents[n], lo) for n, lo in (("detail", 0.0), ("base", -3.0))], grids, 24, 100, 10.0)
    assert {(r["observer"], r["ray"], r["step"]): (r["h"], r["visible"]) for r in got} == want
    assert all(abs(r["x"] - obs[r["observer"] - 1][1] - np.cos(r["ray"] / 24 * 2 * np.pi) * (r["step"] + 1) * 10) < 1e-6 for r in got)


def test_samples_outside_take_no_part_in_the_join(spark):
    """An observer in a corner: only crossed tiles are asked for, one row each, with as many cells as samples inside."""
    observers = spark.createDataFrame([(1, 0, 1.0, 1.0, 9.0), (2, 0, -9000.0, 0.0, 9.0)], "observer long, map_id long, x double, z double, eye double")
    placed = observers.join(sampling.layer_list(layer(spark, 100, 100, (0.0, 0.0, 1000.0, 1000.0))), "map_id")
    kind = "observer long, map_id long, x double, z double, eye double, fill double, layer string, tx int, tz int, lo double, hi double, first array<int>, n array<int>, cell array<int>"
    schema = viewshed._arrow(spark.createDataFrame([], kind))
    asked = placed.mapInArrow(lambda b: viewshed._walk_rays(b, schema, 360, 375, 4.0, "node", "min", 64), kind).collect()
    mine = [r for r in asked if r["observer"] == 1]
    assert sorted((r["tx"], r["tz"]) for r in mine) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    inside = sum(len(r["cell"]) for r in mine)
    assert inside == sum(sum(r["n"]) for r in mine) < 360 * 375 / 3
    assert [len(r["cell"]) for r in asked if r["observer"] == 2] == [0]


# ---- pyramids by tile ------------------------------------------------------------------------


@pytest.mark.parametrize("size, side, whole", [((37, 53), 8, 4), ((64, 64), 8, 8), ((101, 19), 16, 4), ((5, 70), 4, 2)])
def test_tiles_fill_like_whole_layers(spark, size, side, whole):
    from terralake.operators import pyramid

    w, h = size
    rng = np.random.default_rng(w * h)
    grids = {7: rng.integers(0, 500, (h, w)).astype(float), None: np.full((h, w), np.nan)}
    grids[7][rng.random((h, w)) < 0.6] = np.nan
    grids[7][h // 4:h // 2 + 3, : w // 2] = np.nan  # a hole larger than a tile
    grids[None][h - 1, w - 1] = 5.0
    rows = [(m, int(x), int(z), float(g[z, x])) for m, g in grids.items() for z, x in zip(*np.nonzero(~np.isnan(g)))]
    known = spark.createDataFrame(rows, "map_id long, px int, pz int, v double")
    dims = spark.createDataFrame([(m, w, h) for m in grids], "map_id long, width int, height int")
    got = pyramid.fill_layers(known, dims, "v", side, whole).collect()
    assert len(got) == 2 * w * h
    for m, g in grids.items():
        out = np.full((h, w), np.nan)
        for r in got:
            if r["map_id"] == m:
                out[r["pz"], r["px"]] = r["v"]
        assert np.allclose(out, pyramid.fill_whole(g), rtol=1e-12, atol=1e-9)


def test_box_sums_do_not_grow_with_the_radius(spark):
    """Sums equal numpy's for small and large windows; nulls are left out."""
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 99, (23, 31)).astype(float)
    grid[rng.random(grid.shape) < 0.2] = np.nan
    data = cells(spark, [[None if np.isnan(v) else v for v in row] for row in grid.tolist()])
    for radius in (1, 10):
        for r in raster.box_sums(data, radius, ["v"], 16).collect():
            near = grid[max(0, r["pz"] - radius):r["pz"] + radius + 1, max(0, r["px"] - radius):r["px"] + radius + 1]
            assert r["n_box"] == near.size and r["sum_v"] == (np.nansum(near) if (~np.isnan(near)).any() else None)


def test_large_dimension_is_never_broadcast(spark, tmp_path):
    """A dimension that is small as a file, and smaller still once columns are left out, is not sent to the driver as 32 copies."""
    spark.range(200000).select(F.col("id").alias("pool_idx"), F.lit("same").alias("name")).coalesce(1).write.parquet(str(tmp_path / "dim"))
    dim = spark.read.parquet(str(tmp_path / "dim"))
    facts = spark.range(1000).select((F.col("id") % 7).alias("pool_idx"), "id")
    joined = scans.join_dim(facts, dim.withColumn("more", F.concat("name", "name")), ["pool_idx"], ["id"])
    assert "Broadcast" not in joined.select("id")._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000


def test_row_labels_have_as_many_letters_as_they_need(spark):
    from terralake.functions import names

    got = spark.createDataFrame([(0,), (26,), (701,), (702,), (18277,), (18278,), (475254,), (-1,), (None,)], "n long").select(names.grid_row_label("n"))
    assert [r[0] for r in got.collect()] == ["A", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "AAAAA", None, None]


def test_files_of_missions_are_never_broadcast(spark, tmp_path):
    """A table that is small as a file sends neither its rows nor their many grams to the driver; the maps go to the files instead."""
    from terralake.operators import zones

    spark.range(300).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("x").alias("folder"), F.lit("x_town_dom").alias("stem"),
                            (F.col("id") % 2 == 0).alias("air")).write.parquet(str(tmp_path / "files"))
    maps = spark.createDataFrame([("air_town",), ("avg_x",)], "map_id string")
    found = zones.missions_for_maps(maps, spark.read.parquet(str(tmp_path / "files")))
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 300


def test_masks_and_parts_are_never_broadcast(spark, tmp_path):
    """Cells, tiles and parts that are few here, but as many as the levels have, don't go to the driver in any step of a painted level."""
    grid = spark.range(900).select(F.lit(0).cast("long").alias("map_id"), (F.col("id") % 30).cast("int").alias("px"), F.floor(F.col("id") / 30).cast("int").alias("pz"))
    grid.withColumn("wet", F.col("px") < 20).withColumns({c: F.lit(9) for c in ("r", "g", "b", "nr", "ng", "nb")}).write.parquet(str(tmp_path / "grid"))
    cells = spark.read.parquet(str(tmp_path / "grid"))
    wet = cells.filter("wet").select("map_id", "px", "pz")
    over = flood.cell_water_ratio(cells, 10, 6)
    steps = {
        "union": flood.union_mask(wet, wet, over, 10, 6), "tint": terrain.tint_water(cells.select("map_id", "px", "pz", "r", "g", "b"), wet),
        "shade": terrain.hillshade(cells.select("map_id", "px", "pz", "r", "g", "b"), cells.select("map_id", "px", "pz", "nr", "ng", "nb")),
        "seams": flood.seam_edges(wet.withColumn("comp", F.lit(1).cast("long")), 8),
    }
    for name, step in steps.items():
        assert "Broadcast" not in step._jdf.queryExecution().executedPlan().toString(), name
    assert steps["union"].count() == 600 and steps["tint"].count() == 900


def test_areas_and_counts_of_arrays_equal_those_of_rows(spark):
    """Unknown heights, hidden rays and two observers; as arrays no step becomes a row, nor does it in the query of slopes."""
    import random

    from terralake.plans import all_queries

    rng, rays, steps = random.Random(3), 6, 7
    lines = [(0, o, r, [rng.choice([None, 1.0, 5.0, 9.0]) for _ in range(steps)], [rng.choice([None, True, True, False]) for _ in range(steps)])
             for o in range(2) for r in range(rays)]
    lines = spark.createDataFrame(lines, "map_id long, observer long, ray int, h array<double>, seen array<boolean>").repartition(3)
    hits = spark.createDataFrame([(0, 0, 2, 3), (0, 1, 5, 0)], "map_id long, observer long, ray int, hidden_from int")
    rows = lines.join(hits, ["map_id", "observer", "ray"], "left").select(
        "*", F.posexplode(F.arrays_zip("h", "seen")).alias("step", "_s")).select(
        "map_id", "observer", "ray", "step", F.col("_s.h").alias("h"),
        (F.col("_s.seen") & (F.col("hidden_from").isNull() | (F.col("step") < F.col("hidden_from")))).alias("visible"))
    for water in (None, 2.0):
        got = viewshed.area_of_lines(lines, hits, water).select("map_id", "observer", "caps", "visible_patches", "hidden_patches")
        assert sorted(got.collect()) == sorted(viewshed.viewshed_area(rows, rays, water).collect())
    counted = rows.groupBy("map_id", "observer", "ray").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("visible").alias("visible"), F.sum(F.when(F.col("visible"), F.col("step")).otherwise(0)).alias("mark"))
    assert sorted(viewshed.ray_counts(lines, hits).collect()) == sorted(counted.collect())
    plan = all_queries()["running_max_slope"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "before" in plan


def test_heights_are_handed_over_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(viewshed, "SAMPLES_PER_BATCH", 4)
    names = ["observer", "map_id", "x", "z", "eye", "fill", "first", "n", "cell", "data", "lo", "hi"]
    row = [1, 0, 0.0, 0.0, 5.0, None, [0], [3], [0, 1, 1], [2.0, None], None, None]
    batch = pa.record_batch([pa.array([v] * 5, pa.list_(pa.int32()) if n in ("first", "n", "cell") else None) for n, v in zip(names, row)], names=names)
    kinds = pa.schema([*[(n, batch.schema.field(n).type) for n in names[:8]], ("v", pa.list_(pa.float64()))])
    parts = list(viewshed._look_up([batch], kinds, None))
    assert [p.num_rows for p in parts] == [2, 2, 1]
    assert [repr(v) for p in parts for v in p.column(8).to_pylist()] == ["[2.0, nan, nan]"] * 5


def test_bilinear_sends_every_target_once(spark):
    """Corners across block borders, at the edge, missing and null; targets aren't multiplied by their four corners, nor grouped afterwards."""
    w, h, out_w, out_h = 70, 35, 90, 41
    grid = np.random.default_rng(5).normal(size=(h, w)).round(3)
    gone, null = {(33, 31), (69, 34)}, {(32, 32), (0, 0)}
    rows = [(0, x, z, None if (x, z) in null else float(grid[z, x])) for z in range(h) for x in range(w) if (x, z) not in gone]
    source = spark.createDataFrame(rows, "map_id long, px int, pz int, v double")
    layers = spark.createDataFrame([(0, w, h), (1, 3, 3)], "map_id long, width int, height int")
    found = raster.resample(source, layers, out_w, out_h, "bilinear")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") == 1 and "_c.qx" not in plan
    got = {(r["map_id"], r["px"], r["pz"]): r["v"] for r in found.collect()}
    assert len(got) == 2 * out_w * out_h and all(v is None for (m, _, _), v in got.items() if m == 1)
    lost = gone | null
    for (m, px, pz), v in got.items():
        if m == 0:
            fx, fz = px / out_w * w, pz / out_h * h
            x0, z0 = int(fx), int(fz)
            corners = [(x, z) for z in (z0, min(z0 + 1, h - 1)) for x in (x0, min(x0 + 1, w - 1))]
            if lost & set(corners):
                assert v is None
            else:
                a, b, c, d = (grid[z, x] for x, z in corners)
                assert v == pytest.approx(a * (1 - fx + x0) * (1 - fz + z0) + b * (fx - x0) * (1 - fz + z0) + c * (1 - fx + x0) * (fz - z0) + d * (fx - x0) * (fz - z0), abs=1e-9)


# ---- views: lines of sight as one row per observer ----------------------------------------------


def seeing(spark, values=None, seed=11):
    """Three observers (one twice, one far outside) over two layers with holes and unknown heights."""
    rng = np.random.default_rng(seed)
    base = [[None if rng.random() < 0.05 else float(rng.integers(0, 60)) for _ in range(90)] for _ in range(70)]
    detail = rng.integers(0, 90, (20, 30)).astype(float).tolist()
    layers = layer(spark, 30, 20, (100.0, 100.0, 250.0, 200.0), name="detail", priority=1).unionByName(layer(spark, 90, 70, (0.0, 0.0, 900.0, 700.0), lo=-3.0))
    data = cells(spark, base).withColumn("layer", F.lit("base")).unionByName(cells(spark, detail).withColumn("layer", F.lit("detail")))
    obs = [(1, 0, 151.5, 160.25), (2, 0, 880.0, 690.0), (2, 0, 880.0, 690.0), (3, 0, 5000.0, 5000.0)]
    observers = spark.createDataFrame(obs, "observer long, map_id long, x double, z double")
    return viewshed.sight(observers, data, layers, 24, 1000.0, 10.0, values=values)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_views_equal_those_of_rows_and_no_step_becomes_one(spark):
    from terralake.plans import all_queries

    views = seeing(spark)
    hits = spark.createDataFrame([(0, 1, r, r % 7) for r in range(0, 24, 3)] + [(0, 2, 23, 0), (5, 1, 0, 0)], "map_id long, observer long, ray int, hidden_from int")
    for hidden in (None, hits):
        want = sorted(viewshed.ray_counts(views.lines(("seen",)), hidden).collect())
        got = viewshed.ray_counts(views, hidden)
        assert sorted(got.collect()) == want and len(want) == 3 * 24
        assert "posexplode" not in plan_of(got)
    plan = plan_of(all_queries()["viewshed_objects"](spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in plan and "array<boolean>" not in plan


def test_occupancy_tiles_hold_the_highest_top_of_every_cell(spark):
    """Disks across tile borders and beyond the grid, negative tops and a crowded cell; tiles as well as cells, also from cells."""
    from terralake.operators import instances

    rng = np.random.default_rng(3)
    rows = [(m, "building" if i % 3 else "other", "building" if i % 2 else "tree", i % 5 > 0, float(rng.integers(0, 1500)) / 10, float(rng.integers(-20, 30)), float(rng.integers(0, 900)) / 10)
            for m in (0, 7) for i in range(300)] + [(0, "other", "tree", True, 64.0, float(i), 64.0) for i in range(40)]
    objects = spark.createDataFrame(rows, "map_id long, category string, style string, occludes boolean, x double, y double, z double")
    occ, grids = instances.build_occupancy(objects)
    tiles, _ = instances.build_occupancy(objects, packed=True)
    size = {g["map_id"]: g for g in grids.collect()}
    want = {}
    for m, category, style, occludes, x, y, z in rows:
        if occludes:
            g, top = size[m], y + {"building": 16, "other": 8}[category]
            cx, cz, reach = math.floor((x - g["x0"]) / g["cell"]), math.floor((z - g["z0"]) / g["cell"]), math.ceil((4.0 if style == "building" else 3.0) / g["cell"])
            for dx in range(-reach, reach + 1):
                for dz in range(-reach, reach + 1):
                    at = (m, cx + dx, cz + dz)
                    if dx * dx + dz * dz <= reach * reach and 0 <= at[1] < g["cols"] and 0 <= at[2] < g["rows"] and top > 0:
                        want[at] = max(want.get(at, top), top)
    assert {(r["map_id"], r["gx"], r["gz"]): r["top"] for r in occ.collect()} == want and occ.count() == len(want)
    side = instances.OCC_TILE
    for packed in (tiles, instances.occupancy_tiles(occ, grids)):
        got = {}
        for r in packed.collect():
            w = min(side, size[r["map_id"]]["cols"] - r["tx"] * side)
            for i, mark in enumerate(np.frombuffer(r["data"], "<u2").tolist()):
                if mark:
                    got[r["map_id"], r["tx"] * side + i % w, r["tz"] * side + i // w] = r["tops"][mark - 1]
        assert got == want
    assert packed.groupBy("map_id", "tx", "tz").count().filter("count > 1").count() == 0


def test_objects_are_placed_once(spark):
    """Extent, occupancy and grid come from occluders that were written, not from the tables time and again."""
    from terralake.plans import all_queries

    for name in ("viewshed_repaired", "viewshed_objects"):
        assert "l_orderkey" not in plan_of(all_queries()[name](spark, "/root/testdata/sf0.001")), name


def test_records_are_stretches_of_the_largest_slope_before(spark):
    from terralake.plans import all_queries

    lines = {(r["observer"], r["ray"]): r for r in seeing(spark, ("before", "records")).collect()}
    assert len(lines) == 3 * 24
    for r in lines.values():
        steps = [(s, x["before"]) for x in r["records"] for s in range(x["step"], x["upto"] + 1)]
        assert steps == list(enumerate(r["before"])) and all(a["before"] < b["before"] for a, b in zip(r["records"], r["records"][1:]))
    plan = plan_of(all_queries()["running_max_slope"](spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in plan and "records" in plan


def test_areas_of_views_equal_those_of_arrays_and_only_met_cells_travel(spark):
    from terralake.plans import all_queries

    views = seeing(spark)
    hits = spark.createDataFrame([(0, 1, r, r % 7) for r in range(0, 24, 3)] + [(0, 2, 23, 0)], "map_id long, observer long, ray int, hidden_from int")
    for water in (None, 2.0):
        names = ["map_id", "observer", "caps", "visible_patches", "hidden_patches"]
        got = sorted(viewshed.area_of_lines(views, hits, water).select(*names).collect())
        assert got == sorted(viewshed.area_of_lines(views.lines(), hits, water).select(*names).collect()) and len(got) == 3
    held = {r["observer"]: sum(len(t["v"]) for t in r["tiles"]) for r in views.df.collect()}
    assert held[3] == 0 and all(0 < held[o] < 24 * 100 for o in (1, 2))
    plan = plan_of(all_queries()["viewshed_area"](spark, "/root/testdata/sf0.001"))
    assert "CoGroup" not in plan and "array<boolean>" not in plan
