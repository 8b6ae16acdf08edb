"""Packed numbers, quantised values, JSON fields and byte helpers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._col import ColumnOrName, clamp, col, num, trunc_long

# ---- fixed values ----------------------------------------------------------------------------

TEXTURE_FORMATS = ["DXT1", "DXT5", "BC7 "]
TEXTURE_FORMAT_CODES = [26, 21, 50]  # 4-bit ARGB, 8-bit ARGB, 8-bit grey
COMPRESSIONS = {0: "none", 1: "zstd", 2: "lzma", 3: "oodle", 4: "zlib"}  # key: top three bits
FNV_START = 1469598103934665603
FNV_PRIME = 1099511628211
MIX_SEED = 0x9E3779B97F4A7C15
MIX_FIRST = 0xFF51AFD7ED558CCD
MIX_SECOND = 0xC4CEB9FE1A85EC53

# ---- packed integers -------------------------------------------------------------------------


def unpack_len_flags(word: ColumnOrName) -> Column:
    """30 bits of length, 2 bits of flags. The word is an unsigned 32-bit value in a BIGINT."""
    w = col(word).cast("long")
    return F.struct(
        w.bitwiseAND(F.lit(0x3FFFFFFF)).alias("len"),
        F.shiftrightunsigned(w, 30).cast("int").alias("flags"),
    )


def unpack_entry(word: ColumnOrName, count: ColumnOrName | None = None) -> Column:
    """Pool index and instance count: packed into one word, or given as two plain words."""
    w = col(word).cast("long")
    if count is not None:
        return F.struct(w.alias("idx"), col(count).cast("long").alias("count"))
    high = F.shiftleft(F.shiftrightunsigned(w, 30), 10)
    return F.struct(
        high.bitwiseOR(w.bitwiseAND(F.lit(0x3FF))).alias("idx"),
        F.shiftrightunsigned(w, 10).bitwiseAND(F.lit(0xFFFFF)).alias("count"),
    )


def compression_of(byte: ColumnOrName) -> Column:
    top = F.shiftright(col(byte).cast("int").bitwiseAND(F.lit(0xE0)), 5)
    out = F.when(top == 0, COMPRESSIONS[0])
    for code, label in COMPRESSIONS.items():
        if code:
            out = out.when(top == code, label)
    return out.otherwise("unknown")


def supported_texture(fmt: ColumnOrName) -> Column:
    """Known by its four-letter code, or by a format number written as text."""
    return col(fmt).isin(TEXTURE_FORMATS + [str(c) for c in TEXTURE_FORMAT_CODES])


# ---- quantised values ------------------------------------------------------------------------


def dequantize(v: ColumnOrName, size, origin, wide: bool = False) -> Column:
    """Position inside a cell from a signed 16-bit value (or a wide one with 16 more bits)."""
    raw = col(v) * num(size)
    scaled = raw / 65536.0 / 32767.0 if wide else col(v) * (num(size) / 32767.0)
    return F.round((scaled + num(origin)) * 10) / 10


def vertical_size(delta: ColumnOrName) -> Column:
    d = col(delta).cast("double")
    return F.when(d != 0, d).otherwise(8192.0)


def height_from_u16(v: ColumnOrName, scale, v_min, levels: int = 65535) -> Column:
    return col(v) * (num(scale) / float(levels)) + num(v_min)


def denormalise(v: ColumnOrName, v_min, v_max, levels: int) -> Column:
    return num(v_min) + col(v) / float(levels) * (num(v_max) - num(v_min))


def quantize_u16(h: ColumnOrName, v_min, v_max) -> Column:
    span = F.greatest(num(v_max) - num(v_min), F.lit(0.0001))
    return trunc_long(clamp((col(h) - num(v_min)) / span * 65535.0, 0.0, 65535.0)).cast("int")


def block_value(v_min: ColumnOrName, delta: ColumnOrName, run: ColumnOrName) -> Column:
    scaled = col(run).cast("long") * col(delta) + 127
    return (col(v_min) + F.floor(scaled / 255)).cast("long")


def to_byte(x: Column) -> Column:
    """Scale 0..1 to 0..255, truncating."""
    return trunc_long(clamp(x * 255.0, 0.0, 255.0)).cast("int")


def normal_from_dxt5nm(g: ColumnOrName, a: ColumnOrName, inverted: bool = False) -> Column:
    """Normal with x in the alpha and y in the green channel, as three bytes."""
    x, y = col(a) / 127.5 - 1, col(g) / 127.5 - 1
    z = F.sqrt(F.greatest(F.lit(0.0), 1 - x * x - y * y))
    r, gg, b = (to_byte(c * 0.5 + 0.5) for c in (x, y, z))
    if inverted:
        r, gg = (255 - r).cast("int"), (255 - gg).cast("int")
    return F.struct(r.alias("r"), gg.alias("g"), b.alias("b"))


# ---- hashes ----------------------------------------------------------------------------------


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a over the UTF-8 bytes. Unsigned 64-bit, hence a decimal column."""
    from decimal import Decimal

    def one(s):
        if s is None:
            return None
        h = FNV_START
        for byte in s.encode("utf-8"):
            h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        return Decimal(h)

    seen = {s: one(s) for s in text.unique()}
    return text.map(seen)


def seed_bits(seed: ColumnOrName) -> Column:
    """Unsigned 64-bit number (a decimal) as the BIGINT with the same bits."""
    s, half, whole = col(seed), F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.when(s >= half, s - whole).otherwise(s).cast("long")


def _mixed(seed: pd.Series, gx: pd.Series, gy: pd.Series, chan) -> np.ndarray:
    u = np.uint64
    with np.errstate(over="ignore"):
        h = seed.to_numpy(np.int64).view(u) ^ (gx.to_numpy(np.int64).view(u) << u(32))
        h ^= gy.to_numpy(np.int64).view(u) ^ (chan << u(56)) ^ u(MIX_SEED)
        h ^= h >> u(33)
        h *= u(MIX_FIRST)
        h ^= h >> u(33)
        h *= u(MIX_SECOND)
        h ^= h >> u(33)
    centred = (h & u(0xFF)).astype(np.int32) - 128
    return 128 + np.trunc(centred * 24 / 128).astype(np.int32)


@F.pandas_udf(T.IntegerType())
def _noise(seed: pd.Series, gx: pd.Series, gy: pd.Series, chan: pd.Series) -> pd.Series:
    return pd.Series(_mixed(seed, gx, gy, chan.to_numpy(np.int64).view(np.uint64)))


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in "rgb"]))
def _noise_rgb(seed: pd.Series, gx: pd.Series, gy: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({c: _mixed(seed, gx, gy, np.uint64(i)) for i, c in enumerate("rgb")})


def noise_byte(seed: ColumnOrName, gx: ColumnOrName, gy: ColumnOrName, chan) -> Column:
    """Repeatable grey noise around 128 for landclasses without a texture; the seed is an unsigned number (a decimal)."""
    return _noise(seed_bits(seed), col(gx).cast("long"), col(gy).cast("long"), num(chan).cast("long"))


def noise_rgb(bits: ColumnOrName, gx: ColumnOrName, gy: ColumnOrName) -> Column:
    """Noise of all three channels in one call, from the bits of the seed."""
    return _noise_rgb(col(bits), col(gx).cast("long"), col(gy).cast("long"))


# ---- JSON fields -----------------------------------------------------------------------------


def json_number(json: ColumnOrName, path: str) -> Column:
    """A number at a JSON path; null for anything else, numbers written as strings included."""
    text = F.to_json(F.try_variant_get(F.try_parse_json(col(json)), path, "variant"))
    return text.try_cast("double")


def num_or_first(json: ColumnOrName, path: str) -> Column:
    """A number, or the first entry of an array of numbers."""
    return F.coalesce(json_number(json, path), json_number(json, path + "[0]"))


def vec2(json: ColumnOrName, path: str) -> Column:
    """First two entries of an array of numbers; null unless both are numbers."""
    x, z = json_number(json, path + "[0]"), json_number(json, path + "[1]")
    return F.when(x.isNotNull() & z.isNotNull(), F.array(x, z))


# ---- bytes -----------------------------------------------------------------------------------


def format_bytes(n: ColumnOrName) -> Column:
    c = col(n).cast("long")
    raw = F.concat(F.lit(" ("), c.cast("string"), F.lit(" B)"))
    return (
        F.when(c >= 1024 * 1024, F.concat(F.format_string("%.2f MiB", F.bround(c / (1024.0 * 1024.0), 2)), raw))
        .when(c >= 1024, F.concat(F.format_string("%.2f KiB", F.bround(c / 1024.0, 2)), raw))
        .otherwise(F.concat(c.cast("string"), F.lit(" B")))
    )


_FOUND = T.ArrayType(T.StructType([
    T.StructField("offset", T.LongType()), T.StructField("text", T.StringType()),
]))


def printable_strings(data: ColumnOrName, min_len: int = 6, limit: int = 12) -> Column:
    """First runs of printable ASCII of at least ``min_len`` bytes, with their offsets."""
    pattern = re.compile(rb"[\x20-\x7e]{%d,}" % min_len)

    @F.pandas_udf(_FOUND)
    def find(blobs: pd.Series) -> pd.Series:
        def one(blob):
            out = []
            for m in pattern.finditer(blob or b""):
                out.append({"offset": m.start(), "text": m.group().decode("ascii")})
                if len(out) == limit:
                    break
            return out

        return blobs.map(one)

    return find(col(data))
