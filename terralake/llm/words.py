"""Words of whole Arrow batches of texts, as byte positions and 64-bit hashes in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 18  # bytes hashed at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Everything but the space and the control characters 9 to 13.
INK = np.ones(256, bool)
INK[[32, *range(9, 14)]] = False


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; a null row is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes; rows, and positions marked in ``cuts``, begin anew."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = inside[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~ink[:-1]
    fresh[offsets[(offsets > 0) & (offsets < len(data))]] = True
    if cuts is not None:
        fresh[:-1] |= cuts
    starts = np.flatnonzero(ink & fresh[:-1])
    last = ink.copy()
    last[:-1] &= ~ink[1:] | fresh[1:-1]
    return starts, np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; changes no equality."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, for one block."""
    if not _POWERS:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(BLOCK + 1, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte range, by prefix sums over blocks of the text. Ranges are sorted and don't overlap."""
    up, down = powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + BLOCK, "right"))
        if j <= i:  # a word longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(data[at:int(ends[i])].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        stop = int(ends[j - 1])
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum((data[at:stop].astype(np.uint64) + np.uint64(1)) * up[:stop - at], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on, ``len(words) - n + 1`` of them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + words[k:len(words) - n + 1 + k])
    return out
