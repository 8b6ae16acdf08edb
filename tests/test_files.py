"""Readers and sinks on real files written by the test."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralake.operators import zones
from terralake.plans.encoders import png16
from terralake.sources import binary, readers, sinks
from terralake.streaming import jobs


def test_discover_levels(spark, tmp_path):
    for name in ("b.bin", "a.bin", "a.dxp.bin", "c.blkx"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.map_id for r in readers.discover_levels(spark, str(tmp_path)).collect()] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "only.dxp.bin").write_bytes(b"x")
        readers.discover_levels(spark, str(tmp_path / "none"))


def test_level_meta_from_files(spark, tmp_path):
    (tmp_path / "avg_x.blkx").write_text('{"water_level": [4, 5], "mapCoord0": [0, 1], "mapCoord1": [10, 21]}')
    (tmp_path / "bad.blkx").write_text('{"water_level": ')
    rows = {r.map_id: r for r in readers.read_level_meta(spark, str(tmp_path)).collect()}
    assert rows["avg_x"].water_level == 4.0 and rows["avg_x"].map_size == [10.0, 20.0] and rows["avg_x"].tank_zone is None
    assert rows["bad"].coord0 == [-32768.0, -32768.0] and rows["bad"].water_level is None


@pytest.mark.parametrize("stride", [14, 10])
def test_records_with_torn_tail(spark, tmp_path, stride):
    level = tmp_path / "lvl"
    level.mkdir()
    one = struct.pack("<Hfff", 7, 1.5, 2.5, 3.5) if stride == 14 else struct.pack("<Hff", 7, 1.5, 3.5)
    (level / "objects.bin").write_bytes(one * 3 + one[:5])
    rows = binary.read_instances(spark, str(level / "objects.bin"), stride).orderBy("idx").collect()
    assert [(r.map_id, r.idx, r.pool_idx, r.x, r.y, r.z) for r in rows] == [
        ("lvl", i, 7, 1.5, 2.5 if stride == 14 else None, 3.5) for i in range(3)]


def test_png_keeps_all_bits(spark, tmp_path):
    level = tmp_path / "lvl"
    level.mkdir()
    grid = np.array([[0, 256, 257, 65535], [1, 2, 3, 4]])
    (level / "heightmap.png").write_bytes(png16(grid))
    rows = binary.read_raster_png16(spark, str(level / "heightmap.png")).collect()
    assert {(r.px, r.pz): r.v for r in rows} == {(x, z): int(grid[z, x]) for z in range(2) for x in range(4)}
    assert rows[0].map_id == "lvl" and rows[0].layer == "heightmap"


def block(tag, body, flags=0):
    return struct.pack("<I4s", (len(body) + 4) | flags << 30, tag) + body


def test_block_chain_stop_rules(spark):
    start = b"DBLD" + bytes(8)
    end = start + block(b"tex.", b"abc", 2) + block(b"DNE.", b"") + block(b"more", b"x")
    bad = start + block(b"tex.", b"abc") + struct.pack("<I4s", 3, b"oops") + b"tail"
    df = spark.createDataFrame([("end", end), ("bad", bad)], "file string, content binary")
    got = sorted((r.file, r.idx, r.pos, r.len, r.flags, bytes(r.tag)) for r in binary.parse_blocks(df).collect())
    assert got == [("bad", 0, 12, 7, 0, b"tex."), ("end", 0, 12, 7, 2, b"tex."), ("end", 1, 23, 4, 0, b"DNE.")]


GROUND = {
    "units": {"area_squad": [
        {"name": "t1_spawn_a", "tm": [[1, 0, 0], [0, 1, 0], [0, 0, 1], [10, 0, 20]], "props": {"squad_members": ["zone_x"]}},
        {"name": "t2_KillArea_spawn", "tm": [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 2]]},
        {"name": "t2_resp", "tm": [[1, 0], [2]]},
    ]},
    "areas": {
        "zone_x": {"tm": [[3, 0, 4], [0, 1, 0], [0, 0, 1], [5, 0, 6]]},
        "hardcore_capture_area_2": {"tm": [[3, 0, 4], [0, 1, 0], [0, 0, 1], [7, 0, 8]]},
        "battle_area": {"tm": [[3, 0, 4], [0, 1, 0], [6, 0, 8], [9, 0, 9]]},
        "plain": {"tm": [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1]]},
    },
}


def test_missions_from_files(spark, tmp_path):
    for name, doc in {"ardennes_dom": GROUND, "template_x": GROUND}.items():
        d = tmp_path / "ardennes"
        d.mkdir(exist_ok=True)
        (d / f"{name}.blkx").write_text(json.dumps(doc))
    (tmp_path / "ardennes" / "ardennes_broken.blkx").write_text('{"units": ')
    (tmp_path / "ardennes" / "ardennes_bttl_1.blkx").write_text(json.dumps({
        "units": {"area_squad": {"name": "no list"}},
        "areas": {"briefing_t1_resp_a": {"tm": GROUND["areas"]["plain"]["tm"]}, "zone_x": GROUND["areas"]["zone_x"]},
    }))
    got = {(r.mission, r.kind, r.name, r["mode"]): r for r in readers.read_missions(spark, str(tmp_path)).collect()}
    assert {k for k in got if k[0] == "dom"} == {
        ("dom", "spawn", "t1_spawn_a", "arcade"), ("dom", "spawn", "t1_spawn_a", "hardcore"),
        ("dom", "spawn_zone", "zone_x", "arcade"), ("dom", "spawn_zone", "zone_x", "hardcore"),
        ("dom", "capture", "hardcore_capture_area_2", "hardcore"),
        ("dom", "battle", "battle_area", "arcade"), ("dom", "battle", "battle_area", "hardcore"),
    }
    cap, bat = got["dom", "capture", "hardcore_capture_area_2", "hardcore"], got["dom", "battle", "battle_area", "arcade"]
    assert (cap.radius, cap.label, cap.x, cap.z) == (5.0, "B", 7.0, 8.0) and (bat.hx, bat.hz) == (5.0, 10.0)
    assert {k[1:3] for k in got if k[0] == "bttl_1"} == {("spawn", "briefing_t1_resp_a"), ("spawn_zone", "briefing_t1_resp_a")}


def test_mission_file_listing(spark, tmp_path):
    for rel in ("tanks/alps/alps_dom.blkx", "planes/deep/x_alps_ctf.blkx", "planes/template_alps.blkx", "planes/readme.txt"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("{}")
    files = readers.mission_files(spark, str(tmp_path / "tanks"), [str(tmp_path / "planes")])
    maps = spark.createDataFrame([("avg_alps",), ("air_alps",)], "map_id string")
    got = sorted((r.map_id, r.stem) for r in zones.missions_for_maps(maps, files).collect())
    assert got == [("air_alps", "x_alps_ctf"), ("avg_alps", "alps_dom")]


def test_manifests_from_files(spark, tmp_path):
    for name, text in (("a", '{\n "mapName": "a",\n "waterLevel": null}'), ("b", "{")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    rows = readers.read_manifests(spark, str(tmp_path)).collect()
    assert [(r.map_id, r.mapName, r.waterLevel) for r in rows] == [("a", "a", None)]


def test_write_manifest(spark, tmp_path):
    maps = spark.createDataFrame([(1, None), (2, 3.5)], "map_id long, waterLevel double")
    pools = spark.createDataFrame([(1, 0, "oak", "tree", 4)], "map_id long, pool_idx int, name string, category string, n long")
    sinks.write_manifest(maps, str(tmp_path / "m"), pools=pools)
    docs = {d["mapName"]: d for d in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect())}
    assert docs[1]["waterLevel"] is None and docs[1]["instanceCount"] == 4 and docs[2]["pools"] is None


def test_index_batches_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = lambda rows: spark.createDataFrame(rows, "name string, seq long, value int")
    jobs.apply_batch(batch([("b", 1, 10), ("a", 2, 20), ("b", 3, 30)]), 0, path)
    for _ in range(2):
        jobs.apply_batch(batch([("c", 1, 1), ("a", 2, 2)]), 1, path)
    got = sorted((r.pos, r.name, r.value) for r in jobs.read_index(spark, path).collect())
    assert got == [(1, "a", 2), (2, "b", 30), (3, "c", 1)]


def test_stream_index_over_files(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "index")
    for day in range(3):
        spark.range(4).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"), F.lit(day).cast("long").alias("seq"),
                              (F.col("id") * 10 + day).alias("value")).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("name string, seq long, value long").option("maxFilesPerTrigger", 2).parquet(str(src))
    jobs.stream_index(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    index = jobs.read_index(spark, path)
    assert sorted(r.name for r in index.collect()) == ["m0", "m1", "m2", "m3"]


def test_columns_at_the_edges(spark):
    from terralake.functions import codec, geo, names

    row = spark.range(1).select(
        names.grid_row_label(25).alias("z"), names.grid_row_label(26).alias("aa"), names.numeric_label(F.lit("x_27")).alias("n"),
        names.mission_full_name(F.lit("")).alias("m"), geo.format_metres(F.lit(None).cast("double")).alias("f"),
        names.display_name(F.lit("avg_el-alamein")).alias("d"), codec.format_bytes(F.lit(2048)).alias("b"),
        codec.block_value(F.lit(10), F.lit(255), F.lit(128)).alias("v"), codec.unpack_entry(F.lit(0xC0000405)).alias("e"),
    ).first()
    assert tuple(row)[:8] == ("Z", "AA", "A", "Mission", "-- m", "El-Alamein", "2.00 KiB (2048 B)", 138)
    assert tuple(row.e) == (3 * 1024 + 5, 1)


# ---- files of any size -----------------------------------------------------------------------


def test_large_files_are_read_in_ranges(spark, tmp_path):
    """A sparse file of 3 GB is planned as ranges; records at its ends come out with their numbers."""
    big = tmp_path / "lvl" / "objects.bin"
    big.parent.mkdir()
    n = (3 << 30) // 14
    with big.open("wb") as f:
        f.write(struct.pack("<Hfff", 1, 1.0, 2.0, 3.0))
        f.seek((n - 1) * 14)
        f.write(struct.pack("<Hfff", 65535, 4.0, 5.0, 6.0) + b"torn")
    assert binary.level_files(spark, "instances14", str(big)).rdd.getNumPartitions() == 24
    whole = binary.LevelFilesReader({"kind": "instances14", "paths": json.dumps([str(big)]), "rangebytes": str(1 << 27), "minfill": "0"},
                                    binary.level_files(spark, "instances14", str(big)).schema)
    parts = [p.parts[0] for p in whole.partitions()]
    assert parts[0][1] == 0 and parts[-1][2] == n * 14 + 4 and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    first, last = (list(whole._rows(*parts[i])) for i in (0, -1))
    assert first[0]["idx"][0] == 0 and first[0]["x"][0] == 1.0 and last[-1]["idx"][-1] == n - 1 and last[-1]["pool_idx"][-1] == 65535


@pytest.mark.parametrize("step", [14, 20, 33, 1000])
def test_ranges_of_any_size_give_the_same_records(spark, tmp_path, step):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "objects.bin").write_bytes(b"".join(struct.pack("<Hfff", i, i, 0, 0) for i in range(50)))
    rows = binary.read_instances(spark, str(tmp_path / "*" / "objects.bin"), range_bytes=step).collect()
    assert sorted((r.map_id, r.idx, r.pool_idx) for r in rows) == [("a", i, i) for i in range(50)]


def test_texture_ranges_skip_records_inside_others(spark, tmp_path):
    head = lambda size: struct.pack("<4s4sIHHB3xH2xII", b"DDSx", b"DXT1", 0, 4, 4, 1, 32, size, 0)
    inner = head(3) + b"abc"
    data = b".." + head(len(inner)) + inner + b"DDS" + head(5) + b"DDSx!" + head(1 << 20) + b"end"
    (tmp_path / "t.bin").write_bytes(data)
    want = [(r["pos"], r["end"]) for r in binary._records(data)]
    for step in (7, 64, 1 << 20):
        got = binary.scan_texture_records(spark, str(tmp_path / "t.bin"), step).orderBy("pos").collect()
        assert [(r.pos, r.end) for r in got] == want and len(want) == 2


def test_a_broken_file_is_a_row(spark, tmp_path):
    start = b"DBLD" + bytes(8)
    (tmp_path / "good.bin").write_bytes(start + block(b"tex.", b"abc") + block(b"END.", b""))
    (tmp_path / "gone.bin").write_bytes(start)
    (tmp_path / "locked.bin").write_bytes(start)
    reader = binary.LevelFilesReader({"kind": "blocks", "paths": json.dumps([str(tmp_path)]), "rangebytes": "1", "minfill": "0"},
                                     binary.level_files(spark, "blocks", str(tmp_path)).schema)
    parts = [(path, *rest) for p in reader.partitions() for path, *rest in p.parts]
    (tmp_path / "gone.bin").unlink()
    rows = [r for b in reader.read(binary.FileRange(parts)) for r in b.to_pylist()]
    assert sorted((r["file"].rsplit("/", 1)[1], r["idx"], (r["error"] or "").split(":")[0]) for r in rows if r["idx"] is not None) == [("good.bin", 0, ""), ("good.bin", 1, "")]
    assert [(r["file"].rsplit("/", 1)[1], r["error"].split(":")[0]) for r in rows if r["error"]] == [("gone.bin", "FileNotFoundError")]
    failed = binary.failed_files(spark.createDataFrame(rows, "file string, idx int, pos long, len long, flags int, tag binary, error string"))
    assert [(r.map_id, r.ok) for r in failed.collect()] == [("gone.bin", False)]
    with pytest.raises(Exception, match="none.bin"):
        binary.scan_blocks(spark, str(tmp_path / "none.bin")).collect()


def test_headers_are_read_without_bodies(spark, tmp_path):
    """Blocks whose bodies are 1 GB holes: three headers are all that is read."""
    path = tmp_path / "holes.bin"
    with path.open("wb") as f:
        f.write(b"DBLD" + bytes(8))
        for _ in range(3):
            f.write(struct.pack("<I4s", (900 << 20) + 4, b"lnd2"))
            f.seek(900 << 20, 1)
        f.write(block(b"END.", b""))
    got = binary.scan_blocks(spark, str(path)).orderBy("idx").collect()
    assert [(r.idx, bytes(r.tag)) for r in got] == [(0, b"lnd2"), (1, b"lnd2"), (2, b"lnd2"), (3, b"END.")]


@pytest.mark.parametrize("name", ["scan_texture_records", "scan_pack_directory", "scan_blocks", "read_instances_legacy"])
def test_contents_go_to_python_in_small_batches(spark, sf, name):
    """What a worker holds doesn't follow the number of rows in a partition, nor their length."""
    import pandas as pd

    from terralake import plans

    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.unset(keys[0])
        plans.all_queries()[name](spark, sf)
        measure = lambda batches: (pd.DataFrame({"n": [len(b)], "size": [int(b["content"].map(len).sum())]}) for b in batches)
        for length, n in ((100000, 600), (10, 5000)):
            files = spark.range(n).coalesce(1).select(F.expr(f"repeat('x', {length})").cast("binary").alias("content"))
            got = files.mapInPandas(measure, "n long, size long").collect()
            assert sum(r["n"] for r in got) == n and max(r["n"] for r in got) <= 1000 and max(r["size"] for r in got) <= 6 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_records_of_many_unequal_files(spark, monkeypatch):
    """Frames hold slices of several files: places are counted anew in each file, torn and empty files included."""
    monkeypatch.setattr(binary, "ROWS_PER_FRAME", 7)
    monkeypatch.setattr(binary, "RECORDS_PER_SLICE", 5)
    counts = [0, 1, 4, 5, 6, 23, 1, 7, 0, 2]
    files = spark.createDataFrame([(f, b"".join(struct.pack("<H2f", i, f, -i) for i in range(n)) + b"torn") for f, n in enumerate(counts)], "file long, content binary").coalesce(1)
    got = sorted((r["file"], r["idx"], r["pool_idx"], r["x"], r["y"], r["z"]) for r in binary.parse_instances(files, 10).collect())
    assert got == [(f, i, i, float(f), None, float(-i)) for f, n in enumerate(counts) for i in range(n)]


def test_latest_entry_reads_rows_as_they_come():
    """A key's entries are plain rows, read once; of equal numbers the first counts, in a batch and after it, and one look at the state is enough."""
    from pyspark.sql import Row

    class Latest:
        value, looks = None, 0

        def get(self):
            self.looks += 1
            return self.value

        def update(self, value):
            self.value = value

    entry = jobs.LatestEntry()
    entry.latest = Latest()
    give = lambda *rows: [tuple(r) for r in entry.handleInputRows(("a",), iter([Row(name="a", seq=s, value=v) for s, v in rows]), None)]
    assert give((3, "c"), (7, "x"), (7, "y"), (1, "a")) == [("a", 7, "x", True)]
    assert give((7, "z"), (2, "b")) == [] and give((9, "n")) == [("a", 9, "n", False)]
    assert entry.latest.value == (9,) and entry.latest.looks == 3
