"""Scalar functions of the model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public city-model format, version 2.0.
LODS = ("0", "0.0", "0.1", "0.2", "0.3", "1", "1.0", "1.1", "1.2", "1.3", "2", "2.0", "2.1", "2.2", "2.3", "3", "3.0", "3.1", "3.2", "3.3")
GEOMETRY_TYPES = ("MultiPoint", "MultiLineString", "MultiSurface", "CompositeSurface", "Solid", "MultiSolid", "CompositeSolid", "GeometryInstance")

BBox = tuple[float, float, float, float]


def dequantise(v: Column, scale: float, translate: float) -> Column:
    """Stored integer to world coordinate, translation first (the operand order fixes the last bit)."""
    return F.lit(float(translate)) + F.lit(float(scale)) * v


def quantise(x: Column, scale: float, translate: float) -> Column:
    """World coordinate to integer, halves away from zero; beyond 64 bits is an error."""
    q = F.round((x - F.lit(float(translate))) / F.lit(float(scale)))
    return F.when(F.abs(q) < F.lit(2.0**63), q.cast("long")).otherwise(F.raise_error(F.concat(F.lit("coordinate out of range: "), x.cast("string"))))


def bbox_intersects(window: BBox, prefix: str = "") -> Column:
    """Inclusive overlap in x and y; z is never compared."""
    x0, y0, x1, y1 = map(float, window)
    c = lambda n: F.col(prefix + n)
    return (c("max_x") >= x0) & (c("min_x") <= x1) & (c("max_y") >= y0) & (c("min_y") <= y1)


def bbox_measures() -> dict[str, Column]:
    c = F.col
    return {"centre_x": (c("min_x") + c("max_x")) / 2, "centre_y": (c("min_y") + c("max_y")) / 2, "width": c("max_x") - c("min_x"), "length": c("max_y") - c("min_y"), "height": c("max_z") - c("min_z")}


def shrink(window: BBox, fraction: float) -> BBox:
    """A centred share of a window; an axis without extent stays."""
    x0, y0, x1, y1 = window
    axis = lambda a, b: ((a + b) / 2 - (b - a) * fraction / 2, (a + b) / 2 + (b - a) * fraction / 2) if b > a else (a, b)
    (a, b), (c, d) = axis(x0, x1), axis(y0, y1)
    return a, c, b, d


def grid_cell(x: Column, low: Column, high: Column, bits: int = 16) -> Column:
    """Cell of 0 .. 2**bits - 1; 0 on an axis without extent."""
    top = (1 << bits) - 1
    return F.when(high > low, F.least(F.lit(top), F.floor((x - low) / (high - low) * F.lit(float(top)))).cast("long")).otherwise(F.lit(0).cast("long"))


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Place on the Hilbert curve of a cell: a fold over the bits, highest first, on a (x, y, place) state."""

    def level(state: Column, bit: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        right, upper = state.x.bitwiseAND(half) != 0, state.y.bitwiseAND(half) != 0
        quadrant = F.when(right & upper, 2).when(right, 3).when(upper, 1).otherwise(0)
        mask = half - 1
        low_x, low_y = state.x.bitwiseAND(mask), state.y.bitwiseAND(mask)
        turned_x = F.when(upper, low_x).when(right, mask - low_y).otherwise(low_y)
        turned_y = F.when(upper, low_y).when(right, mask - low_x).otherwise(low_x)
        return F.struct(turned_x.cast("long").alias("x"), turned_y.cast("long").alias("y"), (state.d + half * half * quadrant).cast("long").alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, level, lambda s: s.d)


def lod_parsed(lod: Column) -> Column:
    """The level of detail, null for null, an error for text outside the fixed list."""
    return F.when(lod.isNull() | lod.isin(*LODS), lod).otherwise(F.raise_error(F.concat(F.lit("unknown lod: "), lod)))


def canonical_crs(text: Column) -> Column:
    """``EPSG:n``, an OGC URL or a URN that ends in a number become ``EPSG:n``; else the trimmed text."""
    t = F.trim(text)
    tail = F.regexp_extract(t, "(?:^EPSG:|[/:])([0-9]{1,10})[/:]*$", 1)
    return F.when(tail != "", F.concat(F.lit("EPSG:"), tail.cast("long").cast("string"))).otherwise(t)


def safe_file_stem(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def affine(matrix: list[float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The first three rows of a row-major 4 x 4 matrix."""
    row = lambda r: F.lit(float(matrix[4 * r])) * x + F.lit(float(matrix[4 * r + 1])) * y + F.lit(float(matrix[4 * r + 2])) * z + F.lit(float(matrix[4 * r + 3]))
    return row(0), row(1), row(2)


def ring_triangles(ring: Column) -> Column:
    """Fan triangles of a ring of vertex indices; none under three vertices."""
    n = F.size(ring)
    steps = F.when(n >= 3, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array(F.element_at(ring, 1), F.element_at(ring, i), F.element_at(ring, i + 1)))


def segments(offsets: Column, total: Column) -> Column:
    """(start, length) of each segment from start offsets and the child's length."""
    ends = F.concat(F.slice(offsets, 2, F.size(offsets)), F.array(total))
    return F.zip_with(offsets, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))


def offsets_consistent(offsets: Column, total: Column) -> Column:
    """They start at 0, never fall, and stay within the child."""
    rising = F.forall(F.zip_with(offsets, F.slice(offsets, 2, F.size(offsets)), lambda a, b: b.isNull() | (a <= b)), lambda ok: ok)
    return (F.size(offsets) > 0) & (F.element_at(offsets, 1) == 0) & rising & (F.element_at(offsets, -1) <= total)


def _nested(indices: Column, depth: int, each) -> Column:
    """``each`` of every number of arrays nested ``depth`` deep."""
    return each(indices) if depth == 0 else F.transform(indices, lambda x: _nested(x, depth - 1, each))


def shifted(indices: Column, by: Column, depth: int = 1) -> Column:
    """Indices of arrays nested ``depth`` deep, each moved by ``by``; null stays null."""
    return _nested(indices, depth, lambda v: v + by)


def remapped(indices: Column, new: Column, depth: int = 1) -> Column:
    """Indices of arrays nested ``depth`` deep, each looked up in the map ``new``; null stays null, one that is not there is an error."""
    return _nested(indices, depth, lambda v: F.when(v.isNull(), v).otherwise(F.coalesce(F.try_element_at(new, v), F.raise_error(F.concat(F.lit("no new index for "), v.cast("string"))).cast("bigint"))))
