"""Coordinates, rectangles, grids and map projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import ColumnOrName, clamp, col, floor_long, half_up, num
from .names import grid_row_label

# ---- fixed values ----------------------------------------------------------------------------

# Robinson projection, one entry per 5 degrees of latitude from 0 to 90 (published table).
ROBINSON_X = [
    1.0000, 0.9986, 0.9954, 0.9900, 0.9822, 0.9730, 0.9600, 0.9427, 0.9216, 0.8962,
    0.8679, 0.8350, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322,
]
ROBINSON_Y = [
    0.0000, 0.0620, 0.1240, 0.1860, 0.2480, 0.3100, 0.3720, 0.4340, 0.4958, 0.5571,
    0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0000,
]
PRIME_MERIDIAN_X = 0.4725
DEFAULT_GRID = 10
MIN_SPAN = 0.001

# ---- rectangles ------------------------------------------------------------------------------


def rect(x0, z0, x1, z1) -> Column:
    """Struct with the corners put in order."""
    a, b, c, d = (num(v).cast("double") for v in (x0, z0, x1, z1))
    return F.struct(
        F.least(a, c).alias("x0"), F.least(b, d).alias("z0"),
        F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("z1"),
    )


def norm_rect(r: ColumnOrName) -> Column:
    r = col(r)
    return F.when(r.isNotNull(), rect(r["x0"], r["z0"], r["x1"], r["z1"]))


def in_rect(x: ColumnOrName, z: ColumnOrName, r: ColumnOrName) -> Column:
    r = col(r)
    return col(x).between(r["x0"], r["x1"]) & col(z).between(r["z0"], r["z1"])


def intersects(a: ColumnOrName, b: ColumnOrName) -> Column:
    a, b = col(a), col(b)
    return (b["x1"] >= a["x0"]) & (b["x0"] <= a["x1"]) & (b["z1"] >= a["z0"]) & (b["z0"] <= a["z1"])


def clip(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Common part of two rectangles; corners are put in order even where they do not overlap."""
    a, b = col(a), col(b)
    return rect(
        F.greatest(a["x0"], b["x0"]), F.greatest(a["z0"], b["z0"]),
        F.least(a["x1"], b["x1"]), F.least(a["z1"], b["z1"]),
    )


# ---- cells -----------------------------------------------------------------------------------


def cell_index(x: ColumnOrName, lo, hi, count, convention: str = "node", outside: str = "clamp") -> Column:
    """Index of a coordinate along one axis.

    ``node``: samples sit on the grid nodes, nearest node wins.  ``cell`` and ``tile``: samples
    fill cells, counted from the low edge.  ``outside``: ``clamp`` to the border or ``null``.
    """
    n = num(count)
    span = F.greatest(num(hi) - num(lo), F.lit(MIN_SPAN))
    u = (col(x) - num(lo)) / span
    if convention == "node":
        i = half_up(u * (n - 1))
    elif convention == "cell":
        i = floor_long(u * n)
    elif convention == "tile":
        i = floor_long((col(x) - num(lo)) / (span / n))
    else:
        raise ValueError(f"unknown convention {convention!r}")
    if outside == "clamp":
        return clamp(i, F.lit(0), n - 1).cast("int")
    if outside == "null":
        return F.when(i.between(F.lit(0), n - 1), i).cast("int")
    raise ValueError(f"unknown outside rule {outside!r}")


def cell_of(x: ColumnOrName, z: ColumnOrName, extent: ColumnOrName, width, height,
            convention: str = "node", outside: str = "clamp") -> Column:
    """Struct (px, pz) of the cell at a world position."""
    e = col(extent)
    return F.struct(
        cell_index(x, e["x0"], e["x1"], width, convention, outside).alias("px"),
        cell_index(z, e["z0"], e["z1"], height, convention, outside).alias("pz"),
    )


def cell_center(i: ColumnOrName, lo, hi, count) -> Column:
    return num(lo) + (col(i) + 0.5) / num(count) * (num(hi) - num(lo))


def world_to_scene(x: ColumnOrName, z: ColumnOrName, extent: ColumnOrName) -> Column:
    """Centred square scene coordinates; the scene's z axis points south."""
    e = col(extent)
    w, h = e["x1"] - e["x0"], e["z1"] - e["z0"]
    plane = F.greatest(w, h)
    return F.struct(
        ((col(x) - (e["x0"] + e["x1"]) / 2) * (plane / w)).alias("x"),
        (-(col(z) - (e["z0"] + e["z1"]) / 2) * (plane / h)).alias("z"),
    )


def scene_to_world(x: ColumnOrName, z: ColumnOrName, extent: ColumnOrName) -> Column:
    e = col(extent)
    w, h = e["x1"] - e["x0"], e["z1"] - e["z0"]
    plane = F.greatest(w, h)
    return F.struct(
        ((e["x0"] + e["x1"]) / 2 + col(x) / (plane / w)).alias("x"),
        ((e["z0"] + e["z1"]) / 2 - col(z) / (plane / h)).alias("z"),
    )


def infer_grid(n: ColumnOrName) -> Column:
    """Side of the smallest square grid that holds n tiles; 16 for none."""
    c = col(n)
    return F.when(c == 0, 16).otherwise(F.ceil(F.sqrt(c))).cast("int")


def cell_px(cols: ColumnOrName, rows: ColumnOrName) -> Column:
    """Pixels per grid cell so that the painted raster stays within 8192 pixels."""
    side = F.greatest(col(cols), col(rows), F.lit(1)).cast("long")
    return clamp(F.floor(F.lit(8192) / side), 64, 512).cast("int")


def grid_extent(origin_x, origin_z, cols, rows, size) -> Column:
    s = num(size).cast("double")
    x0, z0 = num(origin_x) * s, num(origin_z) * s
    return F.when(
        s > 0,
        F.struct(
            x0.alias("x0"), z0.alias("z0"),
            (x0 + num(cols) * s).alias("x1"), (z0 + num(rows) * s).alias("z1"),
        ),
    )


def mesh_resolution(cells_x, cells_z, cell, grid_cell) -> Column:
    """Raster side for a terrain mesh: twice its own density, within 512 to 4096."""
    ratio = num(cell) / num(grid_cell)
    doubled = F.round(F.greatest(num(cells_x), num(cells_z)) * ratio).cast("long") * 2
    return F.when(num(grid_cell) > 0, clamp(doubled, 512, 4096)).otherwise(1024).cast("int")


def tile_rect(tx: ColumnOrName, tz: ColumnOrName, extent: ColumnOrName, cols, rows) -> Column:
    """World rectangle and centre of a grid tile."""
    e = col(extent)
    w, h = (e["x1"] - e["x0"]) / num(cols), (e["z1"] - e["z0"]) / num(rows)
    x0, z0 = e["x0"] + col(tx) * w, e["z0"] + col(tz) * h
    return F.struct(
        x0.alias("x0"), z0.alias("z0"), (x0 + w).alias("x1"), (z0 + h).alias("z1"),
        (e["x0"] + (col(tx) + 0.5) * w).alias("cx"), (e["z0"] + (col(tz) + 0.5) * h).alias("cz"),
    )


# ---- tactical grid ---------------------------------------------------------------------------


def grid_count(size: ColumnOrName) -> Column:
    """Squares per side: the given size where it is between 2 and 64, else 10."""
    s = col(size)
    return F.when(s.between(2, 64), half_up(s)).otherwise(DEFAULT_GRID).cast("int")


def grid_column(x: ColumnOrName, view: ColumnOrName, n) -> Column:
    """Column of the tactical grid, counted from 0 in the west."""
    v, count = col(view), num(n)
    u = (col(x) - v["x0"]) / F.greatest(v["x1"] - v["x0"], F.lit(MIN_SPAN))
    return F.least(floor_long(u * count), count - 1).cast("int")


def grid_row(z: ColumnOrName, view: ColumnOrName, n) -> Column:
    """Row of the tactical grid, counted from 0 in the north."""
    v, count = col(view), num(n)
    w = (v["z1"] - col(z)) / F.greatest(v["z1"] - v["z0"], F.lit(MIN_SPAN))
    return F.least(floor_long(w * count), count - 1).cast("int")


def grid_label(column: ColumnOrName, row: ColumnOrName) -> Column:
    """Letter of the row and number of the column, such as B7."""
    return F.concat(grid_row_label(row), (col(column) + 1).cast("string"))


def grid_square(x: ColumnOrName, z: ColumnOrName, view: ColumnOrName, n) -> Column:
    """Column number (from 1), row and label of a position; null outside the view."""
    column, row = grid_column(x, view, n), grid_row(z, view, n)
    square = F.struct((column + 1).alias("column"), row.alias("row"), grid_label(column, row).alias("label"))
    return F.when(in_rect(x, z, view), square)


def format_metres(v: ColumnOrName, style: str = "viewer") -> Column:
    m = col(v).cast("double")
    known = m.isNotNull() & ~F.isnan(m) & (m > 0) & (m < float("inf"))
    if style == "viewer":
        return (
            F.when(~known | m.isNull(), "-- m")
            .when(m >= 1000, F.format_string("%.2f km", m / 1000))
            .otherwise(F.concat(half_up(m).cast("string"), F.lit(" m")))
        )
    if style == "tactical":
        return (
            F.when(~known | m.isNull(), "-- M")
            .when(m >= 1000, F.format_string("%.2f KM", m / 1000))
            .when(m >= 100, F.concat(F.round(m).cast("long").cast("string"), F.lit(" M")))
            .otherwise(F.format_string("%.1f M", m))
        )
    if style == "ruler":
        return F.when(m >= 1000, F.format_string("%.2f km", m / 1000)).otherwise(
            F.format_string("%.0f m", m)
        )
    raise ValueError(f"unknown style {style!r}")


def dist3d(x0, z0, h0, x1, z1, h1) -> Column:
    dx, dz, dh = num(x1) - num(x0), num(z1) - num(z0), num(h1) - num(h0)
    return F.sqrt(dx * dx + dz * dz + dh * dh)


# ---- transforms ------------------------------------------------------------------------------


def tm_position(tm: ColumnOrName) -> Column:
    """Horizontal position of a 4x3 transform; null where the matrix is malformed."""
    row = F.get(col(tm), F.lit(3))
    x, z = F.get(row, F.lit(0)), F.get(row, F.lit(2))
    fine = (F.size(col(tm)) >= 4) & (F.size(row) >= 3) & x.isNotNull() & z.isNotNull()
    return F.when(fine, F.struct(x.alias("x"), z.alias("z")))


def _row_length(tm: Column, i: int) -> Column:
    row = F.get(tm, F.lit(i))
    return F.when(F.size(row) >= 3, F.sqrt(row[0] * row[0] + row[2] * row[2]))


def tm_half_size(tm: ColumnOrName) -> Column:
    hx, hz = _row_length(col(tm), 0), _row_length(col(tm), 2)
    return F.when(hx.isNotNull() & hz.isNotNull(), F.struct(hx.alias("hx"), hz.alias("hz")))


def tm_radius(tm: ColumnOrName) -> Column:
    return _row_length(col(tm), 0)


# ---- water and light -------------------------------------------------------------------------


def is_water_height(h, level, v_min, v_max, levels: int = 255) -> Column:
    """Height at or below the water level less one quantisation step."""
    lo, hi, wl = num(v_min), num(v_max), num(level)
    usable = (hi > lo) & (lo <= wl)
    return F.coalesce(usable & (num(h) <= wl - (hi - lo) / float(levels)), F.lit(False))


def is_water_color(r: ColumnOrName, g: ColumnOrName, b: ColumnOrName) -> Column:
    r, g, b = col(r), col(g), col(b)
    return (b > r + 12) & (b >= g - 6) & (r + g + b < 360)


def water_fraction(level, v_min, v_max) -> Column:
    lo, hi, wl = num(v_min), num(v_max), num(level)
    share = F.when(hi > lo, (wl - lo) / (hi - lo))
    return F.greatest(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def sun_vector(azimuth, elevation) -> Column:
    az = F.radians(num(azimuth).cast("double"))
    el = F.radians(clamp(num(elevation).cast("double"), 0.0, 90.0))
    return F.struct(
        (F.sin(az) * F.cos(el)).alias("x"), F.sin(el).alias("y"), (F.cos(az) * F.cos(el)).alias("z")
    )


def robinson(lat: ColumnOrName, lon: ColumnOrName) -> Column:
    """Position on a world map, both axes 0..1, y from the top."""
    la = clamp(col(lat).cast("double"), -90.0, 90.0)
    lo = clamp(col(lon).cast("double"), -180.0, 180.0)
    step = F.abs(la) / 5
    i = F.least(F.floor(step), F.lit(17)).cast("int")
    part = (F.abs(la) - i * 5) / 5

    def along(table: list[float]) -> Column:
        arr = F.array(*[F.lit(v) for v in table])
        a, b = F.get(arr, i), F.get(arr, i + 1)
        return a + part * (b - a)

    y = F.when(la >= 0, along(ROBINSON_Y)).otherwise(-along(ROBINSON_Y))
    return F.struct(
        (F.lit(PRIME_MERIDIAN_X) + along(ROBINSON_X) * (lo / 180) * 0.5).alias("nx"),
        (F.lit(0.5) - y * 0.5).alias("ny"),
    )


def lc_scale(size: ColumnOrName, metres_per_pixel=None) -> Column:
    """Texture period of a landclass in metres (or in pixels); 256 where unknown, at least 8."""
    s = col(size)
    known = F.size(s) >= 2

    def axis(i: int) -> Column:
        m = F.greatest(F.when(known, F.coalesce(F.get(s, F.lit(i)), F.lit(256.0))).otherwise(256.0), F.lit(8.0))
        if metres_per_pixel is None:
            return m
        return F.greatest(m / F.greatest(num(metres_per_pixel), F.lit(1e-6)), F.lit(8.0))

    return F.struct(axis(0).alias("sx"), axis(1).alias("sy"))
