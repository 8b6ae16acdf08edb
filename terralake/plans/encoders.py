"""Turns table rows into the binary contents that the file readers expect.

Used by queries and tests only: the readers then parse what Spark derived from the given tables.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _container(build):
    """A column function from (id, text) to the bytes of one file; ``build`` gets id and text lines."""
    @F.pandas_udf(T.BinaryType())
    def make(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([build(int(i), [line.encode("utf-8") for line in t.split("\n")]) for i, t in zip(ids, texts)])

    return make


def _chain(doc: int, lines: list[bytes]) -> bytes:
    """A block per line; every third file ends with an end tag, the others with an impossible length."""
    out = b"DBLD.header."
    for i, line in enumerate(lines):
        tag = b"EnND" if i == len(lines) - 1 and doc % 3 == 0 else b"tex." if i % 2 == 0 else b"lnd2"
        out += struct.pack("<I4s", len(line) + 4 | (i % 4) << 30, tag) + line
    return out + (b"padding after the end tag" if doc % 3 == 0 else struct.pack("<I", 2) + b"tex.bad")


def _texture_header(size: int, i: int) -> bytes:
    fmt = [b"DXT1", struct.pack("<I", 21), b"BC7 "][i % 3]
    packed = 0 if i % 5 == 0 else size
    return struct.pack("<4s4sIHHB3xH2xII", b"DDSx", fmt, i * 7, i % 4096, (i + 5) % 4096, i % 12, 32, size, packed)


def _textures(doc: int, lines: list[bytes]) -> bytes:
    """A texture record per line with junk in between; a last one claims more bytes than there are."""
    body = b"".join(b"..." + _texture_header(len(line), i) + line for i, line in enumerate(lines))
    return body + b"DDSx" + b"\xff\xff\xff\x00" * 8


def _pack(doc: int, lines: list[bytes]) -> bytes:
    """A texture pack with an entry per line; every seventh points outside the file."""
    n, base = len(lines), 16
    first = [line.split(b" ")[0] for line in lines]
    raw = [[f + b"*", b"a?%d$x" % i, b"$%d" % i][i % 3] + b"\0" for i, f in enumerate(first)]
    strings_at = 64 + n * 64
    data_at = strings_at + sum(map(len, raw))
    names = heads = bodies = b""
    for i, line in enumerate(lines):
        names += struct.pack("<II", strings_at + sum(map(len, raw[:i])) - base, 0)
        heads += _texture_header(len(line), i)
        offset = 1 << 30 if i % 7 == 6 else data_at + sum(map(len, lines[:i]))
        bodies += struct.pack("<12xIII", offset, len(line), 0)
    sections = b"".join(struct.pack("<I12x", at - base) for at in (64, 64 + n * 8, 64 + n * 40))
    return b"DxP2" + struct.pack("<III", 0, n, 0) + sections + names + heads + bodies + b"".join(raw) + b"".join(lines)


def _cells(doc: int, lines: list[bytes]) -> bytes:
    """A terrain grid with one cell per line; every eighth file has another version."""
    n = len(lines)
    out = b"...lndm" + struct.pack("<iffiiiii", 3 if doc % 8 == 7 else 4, 1.0, 32.0, n, 1, 5, 6, 0)
    out += struct.pack("<iii16x", 0, 8, 11) + bytes(4 * n) + b"name.table."
    for i, line in enumerate(lines):
        used = len(line) % 3 != 0
        second = used and len(line) % 2 == 0
        body = b"DDSx" + line + (b"DDSx" if second else b"") if used else b""
        offset = len(line) + 4 if second else 1 if used and i % 2 == 0 else 0
        det = bytes([i % 250, 255, 1, 2, 3, 4, (i * 3 + 1) % 256])
        out += det + struct.pack("<II", len(body), offset) + body
    return out


chain_of, textures_of, pack_of, cells_of = map(_container, (_chain, _textures, _pack, _cells))


@F.pandas_udf(T.BinaryType())
def records14(values: pd.Series) -> pd.Series:
    """Triples of numbers as 14-byte object records; what is left over becomes a torn record."""
    def one(v):
        v = np.asarray(v, dtype="<f4")
        out = b"".join(struct.pack("<H", i) + v[3 * i:3 * i + 3].tobytes() for i in range(len(v) // 3))
        return out + v[len(v) // 3 * 3:].tobytes()

    return values.map(one)


@F.pandas_udf(T.BinaryType())
def records10(values: pd.Series) -> pd.Series:
    def one(v):
        v = np.asarray(v, dtype="<f4")
        return b"".join(struct.pack("<H", i) + v[2 * i:2 * i + 2].tobytes() for i in range(len(v) // 2))

    return values.map(one)


def png16(grid: np.ndarray) -> bytes:
    """16-bit grey PNG that uses a different row filter on every row."""
    height, width = grid.shape
    rows = grid.astype(">u2").view(np.uint8).reshape(height, 2 * width).astype(np.int32)
    above, body = np.zeros(2 * width, dtype=np.int32), b""
    for z in range(height):
        row, kind = rows[z], z % 5
        left = np.concatenate([[0, 0], row[:-2]])
        corner = np.concatenate([[0, 0], above[:-2]])
        if kind == 4:
            p = left + above - corner
            near = np.argmin(np.stack([abs(p - left), abs(p - above), abs(p - corner)]), axis=0)
            guess = np.choose(near, [left, above, corner])
        else:
            guess = [np.zeros_like(row), left, above, (left + above) // 2][kind]
        body += bytes([kind]) + ((row - guess) & 0xFF).astype(np.uint8).tobytes()
        above = row

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)
    packed = zlib.compress(body)
    half = len(packed) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def png16_of(values: pd.Series) -> pd.Series:
    """Square picture of an array of 16-bit samples."""
    def one(v):
        side = int(len(v) ** 0.5)
        return png16(np.asarray(v[: side * side], dtype=np.int64).reshape(side, side))

    return values.map(one)


def write_files(files) -> None:
    """Write each row of ``path, content`` as a file of its own, on the executors; a repeated task writes the same file again."""
    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                system, inner = fs.FileSystem.from_uri(path if "://" in path else path if path.startswith("file:") else f"file://{path}")
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(bytes(content))
            yield pdf[["path"]].iloc[:0]

    files.select("path", "content").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()
