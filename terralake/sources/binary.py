"""Binary level files as tables: object records, height pictures, block chains, texture directories.

``parse_*`` functions take a table ``file, content``; ``read_*`` and ``scan_*`` functions take paths and open the files on the executors, in
byte ranges. Only headers and directories are read, payloads are never decoded.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import sanitize_texture_name

# ---- fixed values: layouts of the files -------------------------------------------------------
RECORD_LAYOUTS = {
    14: [("pool_idx", "<u2"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4")],
    10: [("pool_idx", "<u2"), ("x", "<f4"), ("z", "<f4")],
}
RECORDS_PER_SLICE = 1 << 16
ROWS_PER_FRAME = 1 << 15
DICTS_PER_FRAME = 1 << 12
RANGE_BYTES = 1 << 27
FILES_PER_TASK = 256
BLOCKS_START = 12
TEXTURE_MAGIC = b"DDSx"
TEXTURE_HEADER = "<4s4sIHHB3xH2xII"  # magic, format, flags, w, h, levels, bpp, memory, packed
PACK_MAGIC = b"DxP2"
PACK_BASE = 16
GRID_MAGIC = b"lndm"
GRID_HEADER = "<iffiiiii"  # version, grid cell, land cell, cols, rows, origin x, origin z, tile flag
CELL_PREFIX = "<7sII"  # landclass ids, length, offset of the second texture


def _unpack(layout: str, data, at: int) -> tuple:
    """Fields at a place of ``data``: bytes, or a file that reads the slices it is asked for."""
    return struct.unpack(layout, data[at:at + struct.calcsize(layout)])


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")


def _gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join the small frames of many files into larger ones; handing each over costs milliseconds."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= ROWS_PER_FRAME:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _per_file(files: DataFrame, rows: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """One output row per dict that ``rows`` finds in a file. A task holds one batch of contents (see ``content_batches``) and ``DICTS_PER_FRAME`` dicts."""
    names = ["file"] + [part.strip().split(" ")[0] for part in schema.split(",")]
    kind = dict(files.dtypes)["file"]

    def run(batches):
        held: list[dict] = []
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                for row in rows(bytes(content)):
                    held.append({"file": file, **row})
                    if len(held) >= DICTS_PER_FRAME:
                        yield pd.DataFrame(held, columns=names)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return files.select("file", "content").mapInPandas(run, f"file {kind}, {schema}")


# ---- object records --------------------------------------------------------------------------


def parse_instances(files: DataFrame, stride: int = 14, counts: DataFrame | None = None) -> DataFrame:
    """Fixed-size object records; an incomplete last record is ignored.

    Contents are cut into slices of whole records before they go to Python, and the slices are spread
    over the cluster, so one large file is shared by many tasks.  ``counts`` (``file, n``) limits the
    records used per file.
    """
    layout = np.dtype(RECORD_LAYOUTS[stride])
    kind = dict(files.dtypes)["file"]
    size = RECORDS_PER_SLICE * stride
    slices = (
        files.withColumn("_n", F.floor(F.length("content") / stride)).filter("_n > 0")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RECORDS_PER_SLICE))))
        .select("file", (F.col("_slice") * RECORDS_PER_SLICE).alias("first"),
                F.expr(f"substring(content, cast(_slice * {size} + 1 as int), {size})").alias("blob"))
        .repartition("file", "first")
    )

    def records(batches):
        """A frame for as many slices as fill one, however few records each of them has."""
        for pdf in batches:
            n = pdf["blob"].map(len).to_numpy("int64") // stride
            upto = np.concatenate([[0], np.cumsum(n)])
            low = 0
            while low < len(n):
                high = max(low + 1, int(np.searchsorted(upto, upto[low] + ROWS_PER_FRAME, "right")) - 1)
                part = slice(low, high)
                blobs = b"".join(bytes(b)[:k * stride] for b, k in zip(pdf["blob"].iloc[part], n[part]))
                rows = np.frombuffer(blobs, dtype=layout)
                yield pd.DataFrame({
                    "file": pdf["file"].iloc[part].repeat(n[part]).reset_index(drop=True),
                    "idx": np.repeat(pdf["first"].to_numpy("int64")[part] - upto[:-1][part] + upto[low], n[part]) + np.arange(len(rows)),
                    "pool_idx": rows["pool_idx"].astype("int32"), "x": rows["x"].astype("float32"),
                    "y": rows["y"].astype("float32") if "y" in layout.names else None, "z": rows["z"].astype("float32"),
                })
                low = high

    parsed = slices.mapInPandas(records, f"file {kind}, idx long, pool_idx int, x float, y float, z float")
    if counts is not None:
        parsed = parsed.join(counts.select("file", "n"), "file", "left").filter(
            F.col("n").isNull() | (F.col("idx") < F.col("n"))
        ).drop("n")
    return parsed


def read_instances(spark: SparkSession, paths, stride: int = 14, counts: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Object records of level files, read in byte ranges of whole records; a file that can't be read is one row with its ``error``."""
    parsed = level_files(spark, f"instances{stride}", paths, range_bytes)
    if counts is not None:
        parsed = parsed.join(counts.select("file", "n"), "file", "left").filter(
            F.col("error").isNotNull() | F.col("n").isNull() | (F.col("idx") < F.col("n"))).drop("n")
    return parsed.withColumn("map_id", F.element_at(F.split("file", "/"), -2))


# ---- 16-bit pictures -------------------------------------------------------------------------


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Undo one PNG row filter (published format); ``step`` is the number of bytes per pixel."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line) + step, dtype=np.int32)
    up = np.concatenate([np.zeros(step, dtype=np.int32), above.astype(np.int32)])
    for i, raw in enumerate(line.tolist(), start=step):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (raw + guess) & 0xFF
    return out[step:].astype(np.uint8)


def decode_png16(content: bytes) -> tuple[int, int, Iterator[tuple[int, np.ndarray]]]:
    """Width, height and the rows of a 16-bit grey PNG."""
    at, packed, width, height = 8, [], 0, 0
    while at + 8 <= len(content):
        (size,), tag = struct.unpack_from(">I", content, at), content[at + 4:at + 8]
        body = content[at + 8:at + 8 + size]
        if tag == b"IHDR":
            width, height, depth, colour, *_ , interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (16, 0, 0):
                raise ValueError("not a plain 16-bit grey picture")
        elif tag == b"IDAT":
            packed.append(body)
        at += 12 + size

    def rows():
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, 1 + 2 * width)
        above = np.zeros(2 * width, dtype=np.uint8)
        for z in range(height):
            above = _unfilter(int(raw[z, 0]), raw[z, 1:], above, 2)
            yield z, above.view(">u2").astype("int32")

    return width, height, rows()


def parse_png16(files: DataFrame) -> DataFrame:
    """Cells (``file, px, pz, v``) of 16-bit grey pictures with all 16 bits."""
    kind = dict(files.dtypes)["file"]

    def pictures(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                width, height, rows = decode_png16(bytes(content))
                step = max(1, ROWS_PER_FRAME // max(width, 1))
                lines = [v for _, v in rows]
                for z in range(0, height, step):
                    part = lines[z:z + step]
                    yield pd.DataFrame({
                        "file": [file] * (width * len(part)), "px": np.tile(np.arange(width, dtype="int32"), len(part)),
                        "pz": np.repeat(np.arange(z, z + len(part), dtype="int32"), width), "v": np.concatenate(part),
                    })

    return files.select("file", "content").mapInPandas(
        lambda batches: _gather(pictures(batches)), f"file {kind}, px int, pz int, v int"
    )


def read_raster_png16(spark: SparkSession, paths) -> DataFrame:
    cells = parse_png16(read_files(spark, paths))
    parts = F.split("file", "/")
    return cells.withColumn("map_id", F.element_at(parts, -2)).withColumn(
        "layer", F.regexp_replace(F.element_at(parts, -1), r"\.png$", "")
    )


# ---- block chains ----------------------------------------------------------------------------


def _blocks(data: bytes):
    at, idx = BLOCKS_START, 0
    while at + 8 <= len(data):
        word, tag = _unpack("<I4s", data, at)
        size = word & 0x3FFFFFFF
        if not 4 <= size <= len(data) - at:
            return
        yield {"idx": idx, "pos": at, "len": size, "flags": word >> 30, "tag": tag}
        if set(b"END") <= set(tag):
            return
        at, idx = at + 4 + size, idx + 1


def parse_blocks(files: DataFrame) -> DataFrame:
    """Headers of the tagged blocks of each file, up to an end tag or an impossible length."""
    return _per_file(files, _blocks, "idx int, pos long, len long, flags int, tag binary")


def scan_blocks(spark: SparkSession, paths) -> DataFrame:
    """As ``parse_blocks``, from files of any size: only block headers are read. A file that can't be read is one row with its ``error``."""
    return level_files(spark, "blocks", paths)


# ---- textures --------------------------------------------------------------------------------


def format_name(code: bytes) -> str:
    """Four letters, or the number of a format without letters."""
    if all(32 <= b < 127 for b in code):
        return code.decode("ascii")
    return str(int.from_bytes(code, "little"))


def _header(data: bytes, at: int) -> dict:
    _, fmt, flags, w, h, levels, bpp, mem, packed = _unpack(TEXTURE_HEADER, data, at)
    return {"fmt": format_name(fmt), "flags": flags, "w": w, "h": h, "levels": levels, "bpp": bpp,
            "mem_sz": mem, "packed_sz": packed}


_HEADER_COLUMNS = "fmt string, flags long, w int, h int, levels int, bpp int, mem_sz long, packed_sz long"


def _records(data: bytes):
    at = data.find(TEXTURE_MAGIC)
    while at >= 0 and at + struct.calcsize(TEXTURE_HEADER) <= len(data):
        head = _header(data, at)
        end = at + struct.calcsize(TEXTURE_HEADER) + (head["packed_sz"] or head["mem_sz"])
        fits = end <= len(data)
        if fits:
            yield {"pos": at, "end": end, **head}
        at = data.find(TEXTURE_MAGIC, end if fits else at + 1)


def parse_texture_records(files: DataFrame) -> DataFrame:
    """Texture records inside level files, left to right without overlap."""
    return _per_file(files, _records, "pos long, end long, " + _HEADER_COLUMNS)


def scan_texture_records(spark: SparkSession, paths, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As ``parse_texture_records``, from files of any size, whose ranges are searched by different tasks.

    Every place with the magic is a candidate; its header tells whether the record fits. Which candidates lie inside an earlier record
    is then found in the order of their places, one row at a time. A file that can't be read is one row with its ``error``.
    """
    found = level_files(spark, "textures", paths, range_bytes)

    def apart(batches):
        file, end = None, -1
        for pdf in batches:
            keep = []
            for name, pos, stop, error in zip(pdf["file"], pdf["pos"], pdf["end"], pdf["error"]):
                if name != file:
                    file, end = name, -1
                keep.append(isinstance(error, str) or pos >= end)
                if keep[-1] and not isinstance(error, str):
                    end = stop
            yield pdf[keep]

    return found.repartition("file").sortWithinPartitions("file", "pos").mapInPandas(apart, found.schema)


def _directory(data: bytes):
    if len(data) < 32 or data[:4] != PACK_MAGIC:
        return
    (count,) = _unpack("<I", data, 8)
    names, heads, bodies = (PACK_BASE + _unpack("<I", data, PACK_BASE + 16 * i)[0] if len(data) >= PACK_BASE + 16 * i + 4 else len(data)
                            for i in range(3))
    for i in range(count):
        if names + 8 * i + 4 > len(data) or heads + 32 * i + 32 > len(data) or bodies + 24 * i + 20 > len(data):
            continue
        start = PACK_BASE + _unpack("<I", data, names + 8 * i)[0]
        stop = data.find(b"\0", start)
        offset, size = _unpack("<II", data, bodies + 24 * i + 12)
        if start >= len(data) or stop <= start or offset + size > len(data):
            continue
        try:
            raw = data[start:stop].decode("utf-8")
        except UnicodeDecodeError:
            raw = "tex"
        yield {"entry_idx": i, "raw_name": raw, "body_offset": offset, "body_size": size, **_header(data, heads + 32 * i)}


def parse_pack_directory(files: DataFrame) -> DataFrame:
    """Entries of texture packs with cleaned names; impossible entries are skipped."""
    return _named_entries(_per_file(files, _directory, _DIRECTORY_COLUMNS))


_DIRECTORY_COLUMNS = "entry_idx int, raw_name string, body_offset long, body_size long, " + _HEADER_COLUMNS


def _named_entries(found: DataFrame) -> DataFrame:
    clean = sanitize_texture_name("raw_name")
    named = F.when(clean == "", F.format_string("tex_%04d", "entry_idx")).otherwise(clean)
    return found.withColumn("name", named)


def scan_pack_directory(spark: SparkSession, paths) -> DataFrame:
    """As ``parse_pack_directory``, from packs of any size: only directories are read. A pack that can't be read is one row with its ``error``."""
    return _named_entries(level_files(spark, "packs", paths))


# ---- terrain cells ---------------------------------------------------------------------------


def _grid(data: bytes):
    at = data.find(GRID_MAGIC)
    base = at + 4 + struct.calcsize(GRID_HEADER)
    if at < 0 or base + 8 > len(data):
        return None
    version, _, cell, cols, rows, ox, oz, _ = _unpack(GRID_HEADER, data, at + 4)
    (offset,) = _unpack("<i", data, base + 4)
    if version != 4 or cols <= 0 or rows <= 0 or offset <= 0 or base + offset + 4 > len(data):
        return None
    (names,) = _unpack("<i", data, base + offset)
    start = base + offset + 20 + 4 * cols * rows + max(names, 0)
    return cols, rows, cell, ox, oz, start


def _tile_cells(data: bytes, min_fill: float):
    grid = _grid(data)
    if grid is None:
        return
    cols, rows, cell, ox, oz, at = grid
    found = []
    for i in range(cols * rows):
        if at + struct.calcsize(CELL_PREFIX) > len(data):
            return
        det, size, second = _unpack(CELL_PREFIX, data, at)
        body = at + struct.calcsize(CELL_PREFIX)
        if size and data[body:body + 4] != TEXTURE_MAGIC:
            return
        nested = 0 < second <= size - 4 and data[body + second:body + second + 4] == TEXTURE_MAGIC
        found.append({"cell": i, "tx": i % cols, "tz": i // cols, "det": list(det), "populated": size > 0,
                      "has_tex2": nested, "cols": cols, "rows": rows, "cell_size": float(cell),
                      "origin_x": ox, "origin_z": oz})
        at = body + size
    if sum(c["populated"] for c in found) >= min_fill * len(found):
        yield from found


def parse_tile_cells(files: DataFrame, min_fill: float = 0.02) -> DataFrame:
    """Terrain grid cells of level files; files with a broken or almost empty grid give no rows."""
    return _per_file(files, lambda data: _tile_cells(data, min_fill), _CELL_COLUMNS)


_CELL_COLUMNS = (
    "cell int, tx int, tz int, det array<int>, populated boolean, has_tex2 boolean, cols int, rows int,"
    " cell_size double, origin_x int, origin_z int"
)


def scan_tile_cells(spark: SparkSession, paths, min_fill: float = 0.02) -> DataFrame:
    """As ``parse_tile_cells``, from files of any size: cell payloads are skipped. A file that can't be read is one row with its ``error``."""
    return level_files(spark, "cells", paths, min_fill=min_fill)


# ---- files of any size -----------------------------------------------------------------------


class LevelFile:
    """A file as a sequence of bytes that reads only the slices it is asked for, in windows."""

    WINDOW = 1 << 20

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop - start > self.WINDOW:
            self.file.seek(start)
            return self.file.read(stop - start)
        if not self.at <= start <= stop <= self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(min(self.size - start, max(stop - start, 1 << 12)))
        return self.held[start - self.at:stop - self.at]

    def find(self, wanted: bytes, start: int, stop: int | None = None) -> int:
        """First place at or after ``start`` (and before ``stop``) where ``wanted`` begins, -1 if there is none."""
        stop = self.size if stop is None else min(stop, self.size)
        while start < stop:
            window = self[start:min(start + self.WINDOW, self.size)]
            at = window.find(wanted)
            if at >= 0:
                return start + at if start + at < stop else -1
            start += max(1, len(window) - len(wanted) + 1)
        return -1


def _instance_rows(data, stride: int, start: int, stop: int) -> Iterator[dict]:
    """Records that begin in a range, as frames of columns."""
    layout = np.dtype(RECORD_LAYOUTS[stride])
    first, last = -(-start // stride), min(-(-stop // stride), len(data) // stride)
    for at in range(first, last, RECORDS_PER_SLICE):
        n = min(RECORDS_PER_SLICE, last - at)
        rows = np.frombuffer(data[at * stride:(at + n) * stride], dtype=layout, count=n)
        yield {"idx": at + np.arange(n), "pool_idx": rows["pool_idx"].astype("int32"), "x": rows["x"].astype("float32"),
               "y": rows["y"].astype("float32") if "y" in layout.names else [None] * n, "z": rows["z"].astype("float32")}


def _texture_candidates(data, start: int, stop: int) -> Iterator[dict]:
    """Every record that begins in a range, inside of others or not."""
    at = data.find(TEXTURE_MAGIC, start, stop)
    while at >= 0 and at + struct.calcsize(TEXTURE_HEADER) <= len(data):
        head = _header(data, at)
        end = at + struct.calcsize(TEXTURE_HEADER) + (head["packed_sz"] or head["mem_sz"])
        if end <= len(data):
            yield {"pos": at, "end": end, **head}
        at = data.find(TEXTURE_MAGIC, at + 1, stop)


#: Columns of each kind of file, and whether ranges of it can be read apart.
FILE_KINDS = {
    "instances14": ("idx long, pool_idx int, x float, y float, z float", True),
    "instances10": ("idx long, pool_idx int, x float, y float, z float", True),
    "textures": ("pos long, end long, " + _HEADER_COLUMNS, True),
    "blocks": ("idx int, pos long, len long, flags int, tag binary", False),
    "packs": (_DIRECTORY_COLUMNS, False),
    "cells": (_CELL_COLUMNS, False),
}


@dataclass
class FileRange(InputPartition):
    """Parts of files read by one task: ``(path, start, stop)``."""

    parts: list


class LevelFilesReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.kind, self.paths = options["kind"], json.loads(options["paths"])
        self.range_bytes, self.min_fill = int(options["rangebytes"]), float(options["minfill"])
        self.schema = schema

    def partitions(self) -> list[FileRange]:
        """Large files are cut into ranges where their kind allows it, small ones share a task."""
        out, parts, held = [], [], 0
        for path, size in _list_files(self.paths):
            step = self.range_bytes if FILE_KINDS[self.kind][1] else max(1, size)
            for start in range(0, max(1, size), step):
                n = min(step, size - start)
                if parts and (held + n > self.range_bytes or len(parts) >= FILES_PER_TASK):
                    out.append(FileRange(parts))
                    parts, held = [], 0
                parts.append((path, start, start + n))
                held += n
        return [*out, FileRange(parts)] if parts else out or [FileRange([])]

    def read(self, partition: FileRange):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for path, start, stop in partition.parts:
            held: list[dict] = []
            try:
                for frame in self._rows(path, start, stop):
                    if isinstance(frame.get("idx"), np.ndarray):
                        n = len(frame["idx"])
                        columns = {"file": [path] * n, "error": [None] * n, **frame}
                        yield pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
                        continue
                    held.append({"file": path, "error": None, **frame})
                    if len(held) >= ROWS_PER_FRAME:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
            except Exception as broken:  # a broken file is a row of its own, not the end of all others
                held.append({"file": path, "error": f"{type(broken).__name__}: {broken}"})
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    def _rows(self, path: str, start: int, stop: int) -> Iterator[dict]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_file(inner) as file:
            data = LevelFile(file, file.size())
            if self.kind.startswith("instances"):
                yield from _instance_rows(data, int(self.kind[9:]), start, stop)
            elif self.kind == "textures":
                yield from _texture_candidates(data, start, stop)
            elif self.kind == "cells":
                yield from _tile_cells(data, self.min_fill)
            else:
                yield from {"blocks": _blocks, "packs": _directory}[self.kind](data)


class LevelFilesSource(DataSource):
    """Level files by byte ranges, for ``spark.read.format("level_files")``: one row per record or header and one per file that can't be read."""

    @classmethod
    def name(cls) -> str:
        return "level_files"

    def schema(self) -> str:
        return f"file string, {FILE_KINDS[self.options['kind']][0]}, error string"

    def reader(self, schema) -> LevelFilesReader:
        return LevelFilesReader(dict(self.options), schema)


def _list_files(paths: list[str]) -> list[tuple[str, int]]:
    """Address and size of all files under some paths or patterns, in order."""
    import glob
    import os

    from pyarrow import fs

    out = {}
    for path in paths:
        found = [path]
        if "://" not in path and not path.startswith("file:"):
            found = [f"file://{os.path.abspath(p)}" for p in (glob.glob(path) if any(c in path for c in "*?[") else [path])]
        for address in found:
            system, inner = fs.FileSystem.from_uri(address)
            head = address[:len(address) - len(inner)]
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(address)
            below = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
            out.update({head + i.path: i.size for i in below if i.type == fs.FileType.File})
    return sorted(out.items())


def level_files(spark: SparkSession, kind: str, paths: str | list[str], range_bytes: int = RANGE_BYTES, min_fill: float = 0.02) -> DataFrame:
    """Rows of level files of a ``FILE_KINDS`` kind. Tasks open the files themselves, at their ranges; no file is ever held as a whole."""
    spark.dataSource.register(LevelFilesSource)
    named = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("level_files").options(
        kind=kind, paths=json.dumps(named), rangebytes=str(range_bytes), minfill=str(min_fill)).load()


def failed_files(scanned: DataFrame) -> DataFrame:
    """Files that couldn't be read as build results (``map_id, ok, error``), for ``audit.build_summary``."""
    return scanned.filter(F.col("error").isNotNull()).select(
        F.element_at(F.split("file", "/"), -1).alias("map_id"), F.lit(False).alias("ok"), "error").distinct()
