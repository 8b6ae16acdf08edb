"""Keys: nothing is lost to a null, and nothing crosses from one map into another."""

import pytest
from pyspark.errors import PySparkException

from terralake.operators import catalog, raster, scans, viewshed, zones


def test_null_keys_keep_their_running_values(spark):
    rows = spark.createDataFrame([(None, 0, 2), (None, 1, 3), ("a", 0, 5), ("a", 70000, 1)], "part string, i long, v int")
    got = sorted((r["part"] or "", r["i"], r["s"]) for r in scans.running_sum(rows, ["part"], "i", "v", "s").collect())
    assert got == [("", 0, 2), ("", 1, 5), ("a", 0, 5), ("a", 70000, 6)]
    top = sorted((r["part"] or "", r["i"], r["m"]) for r in scans.running_max(rows, ["part"], "i", "v", "m").collect())
    assert top == [("", 0, 2), ("", 1, 3), ("a", 0, 5), ("a", 70000, 5)]
    numbered = scans.ordinal(rows.select("part", "i"), ["part"], ["i"]).collect()
    assert sorted((r["part"] or "", r["i"], r["ordinal"]) for r in numbered) == [("", 0, 1), ("", 1, 2), ("a", 0, 1), ("a", 70000, 2)]


def test_a_null_place_in_the_order_stops_the_job(spark):
    rows = spark.createDataFrame([("a", None, 2)], "part string, i long, v int")
    with pytest.raises(PySparkException):
        scans.running_sum(rows, ["part"], "i", "v", "s").collect()


def test_names_without_a_pack_are_numbered_too(spark):
    entries = spark.createDataFrame([(None, 0, "x"), (None, 1, "x"), ("p", 0, None)], "pack string, entry_idx int, name string")
    got = sorted((r["pack"] or "", r["entry_idx"], r["unique_name"]) for r in catalog.dedupe_names(entries).collect())
    assert got == [("", 0, "x"), ("", 1, "x_1"), ("p", 0, None)]


def test_observers_of_two_maps_do_not_mix(spark):
    def cells(map_id, wall):
        return [(map_id, "base", x, 0, 50.0 if x == wall else 0.0) for x in range(20)]

    rasters = spark.createDataFrame(cells(1, None) + cells(2, 4), "map_id long, layer string, px int, pz int, v double")
    layers = spark.createDataFrame(
        [(m, "base", 1, 20, 1, 0.0, 0.0, 19.0, 1.0, 0.0, 50.0) for m in (1, 2)],
        "map_id long, layer string, priority int, width int, height int, x0 double, z0 double, x1 double, z1 double, v_min double, v_max double")
    observers = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0)], "observer long, map_id long, x double, z double")
    los = viewshed.viewshed(observers, rasters, layers, rays=1, range_m=15.0, step_m=1.0)
    seen = {(r["map_id"], r["step"]): r["visible"] for r in los.collect()}
    assert len(seen) == 30 and all(seen[1, s] for s in range(15))
    assert seen[2, 3] and not any(seen[2, s] for s in range(4, 15))


def test_details_with_keys_of_their_own_are_merged(spark):
    rows = [(1, "lc", 0, None, {"R": "a", "own": None}, None), (1, "lc", 1, "t", {"own": "b", "R": "c"}, [2.0, 2.0]), (1, "bare", 2, "u", None, None)]
    lcs = spark.createDataFrame(rows, "map_id long, name string, ord int, texture string, details map<string,string>, size array<double>").withColumn("detail_sizes", scans.F.col("size"))
    got = {r["name"]: r for r in catalog.merge_landclasses(lcs).collect()}
    assert got["lc"]["details"] == {"R": "a", "own": "b"} and got["lc"]["texture"] == "t" and got["bare"]["details"] == {}


def test_maps_without_used_slots_are_audited(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, [255] * 7)], "map_id long, cell int, tx int, tz int, det array<int>")
    lcs = spark.createDataFrame([(1, 0, "grass", None)], "map_id long, lc_idx int, name string, texture string")
    missing = spark.createDataFrame([(1, 0, None)], "map_id long, lc_idx int, resolved string")
    got = catalog.lc_reference_audit(cells, lcs, missing).collect()
    assert [(r["map_id"], r["ref_total"], r["missing"], r["missing_names"]) for r in got] == [(1, 0, 1, ["grass"])]


def test_two_files_with_one_label_stay_apart(spark):
    rows = [(1, "dom", "f1", "battle", "arcade"), (1, "dom", "f2", "battle", "arcade"), (1, "dom", "f2", "capture", "arcade"), (1, "empty", "f3", None, None)]
    table = spark.createDataFrame(rows, "map_id long, mission string, file string, kind string, mode string")
    got = sorted((r["mission"], r["file"], r["battles"], r["captures"], r["ordinal"]) for r in zones.mission_summary(table).collect())
    assert got == [("dom", "f1", 1, 0, 1), ("dom", "f2", 1, 1, 2), ("empty", "f3", 0, 0, 3)]


def test_a_huge_zone_makes_few_rows(spark):
    points = spark.createDataFrame([(1, i, float(i * 900 - 65000), 10.0) for i in range(145)], "map_id long, p int, x double, z double")
    table = spark.createDataFrame(
        [(1, "big", 0.0, 0.0, None, 65000.0, 65000.0), (1, "dot", 100.0, 10.0, 1.0, None, None), (1, "point", -65000.0, 10.0, 0.0, None, None)],
        "map_id long, name string, x double, z double, radius double, hx double, hz double")
    got = zones.points_in_zones(points, table)
    assert sorted((r["zone_name"], r["p"]) for r in got.collect()) == sorted([("big", i) for i in range(145) if abs(i * 900 - 65000) <= 65000] + [("point", 0)] + [("dot", i) for i in range(145) if abs(i * 900 - 65100) <= 1])


def test_absent_cells_are_filled(spark):
    layers = spark.createDataFrame([(1, 8, 8), (2, 5, 3)], "map_id long, width int, height int")
    few = spark.createDataFrame([(1, x, 2, 7.0) for x in range(5)], "map_id long, px int, pz int, v double")
    got = raster.fill_nodata(few, layers).collect()
    assert sorted((r["map_id"], r["px"], r["pz"]) for r in got) == [(1, x, z) for x in range(8) for z in range(8)] + [(2, x, z) for x in range(5) for z in range(3)]
    assert {r["v"] for r in got if r["map_id"] == 1} == {7.0} and {r["v"] for r in got if r["map_id"] == 2} == {0.0}
    assert raster.complete_cells(few, layers).filter("v IS NULL").count() == 64 + 15 - 5


def test_spans_of_a_file_without_a_name(spark):
    from terralake.operators import audit

    spans = spark.createDataFrame([(f, *s) for f in (None, "a") for s in [(0, 5), (3, 9), (9, 10), (20, 30), (22, 25), (40, 41)]], "file string, start long, end long")
    totals = spark.createDataFrame([(None, 50), ("a", 50), ("empty", 4)], "file string, total long")
    for chunk in (4, 1 << 16):
        merged = {(r["file"], r["start"], r["end"]) for r in audit.merge_intervals(spans, chunk).collect()}
        assert merged == {(f, *s) for f in (None, "a") for s in [(0, 10), (20, 30), (40, 41)]}
        free = {(r["file"], r["start"], r["end"]) for r in audit.gaps(spans, totals, chunk).collect()}
        assert free == {(f, *s) for f in (None, "a") for s in [(10, 20), (30, 40), (41, 50)]} | {("empty", 0, 4)}


def test_an_entry_without_a_name_is_updated_once(spark):
    current = spark.createDataFrame([("a", 1, 10), (None, 2, 20)], "name string, pos long, value int")
    updates = spark.createDataFrame([(None, 21), ("b", 30)], "name string, value int")
    got = catalog.upsert_index(current, updates)
    again = catalog.upsert_index(got, updates)
    want = [("a", 1, 10), (None, 2, 21), ("b", 3, 30)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) == sorted(map(tuple, again.collect()), key=repr)
