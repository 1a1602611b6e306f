"""Boxes, polygons and the scale between detector and image coordinates.

A box is a struct (x1, y1, x2, y2); a polygon arrives as an array of [x, y] arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CORNERS = ("x1", "y1", "x2", "y2")

# Fixed value: boxes may reach 10 % past the image and still count as image coordinates.
MARGIN = 1.10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _axis(poly: Column, i: int) -> Column:
    return F.transform(poly, lambda p: F.get(p, F.lit(i)))


def _box(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, CORNERS)])


def half_even(value: Column) -> Column:
    """Nearest integer, halves to the even neighbour."""
    return F.rint(value).cast("int")


def _sides(poly: Column) -> list[Column]:
    """Smallest and largest x and y, truncated toward zero."""
    xs, ys = _axis(poly, 0), _axis(poly, 1)
    sides = (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return [s.cast("int") for s in sides]


def poly_to_bbox(poly: Column | str) -> Column:
    """Bounding box of a polygon, each side truncated toward zero; null without points."""
    poly = _col(poly)
    return F.when(F.size(poly) > 0, _box(*_sides(poly)))


def choose_box(box: Column | str, poly: Column | str) -> Column:
    """The recognizer's box if it has four numbers, else the polygon's; null drops the item."""
    box, poly = _col(box), _col(poly)
    given = _box(*[F.get(box, F.lit(i)).cast("double") for i in range(4)])
    derived = _box(*[s.cast("double") for s in _sides(poly)])
    return F.when(F.size(box) == 4, given).when(F.size(poly) > 0, derived)


def det_scale(
    width: Column | str, height: Column | str, limit_type: Column | str, limit: Column | str
) -> Column:
    """Factor by which the detector resized the image.

    `max` shrinks images whose long side exceeds the limit, `min` enlarges those whose
    short side is below it. A missing type means `max`; any other type, or a limit that
    is null or not positive, means no resizing.
    """
    limit = F.coalesce(_col(limit).cast("double"), F.lit(0.0))
    kind = F.coalesce(_col(limit_type), F.lit("max"))
    long_side = F.greatest(_col(width), _col(height)).cast("double")
    short_side = F.least(_col(width), _col(height)).cast("double")
    return (
        F.when(limit <= 0, 1.0)
        .when((kind == "max") & (long_side > limit), F.try_divide(limit, long_side))
        .when((kind == "min") & (short_side < limit), F.try_divide(limit, short_side))
        .otherwise(1.0)
    )


def coord_space(
    max_x: Column | str, max_y: Column | str, width: Column | str, height: Column | str
) -> Column:
    """`orig` when the largest box sides fit the image with the margin, else `scaled`.

    Null sides (an image without items) give `orig`.
    """
    margin = F.lit(MARGIN).cast("double")
    outside = (_col(max_x) > _col(width) * margin) | (_col(max_y) > _col(height) * margin)
    return F.when(outside, "scaled").otherwise("orig")


def _divisor(space: Column | str, scale: Column | str) -> Column:
    scale = _col(scale)
    return F.when((_col(space) == "orig") | (scale == 0), 1.0).otherwise(scale)


def map_box(box: Column | str, space: Column | str, scale: Column | str) -> Column:
    """Box in original pixels, rounded to integers."""
    box, by = _col(box), _divisor(space, scale)
    return _box(*[half_even(box[c] / by) for c in CORNERS])


def map_poly(poly: Column | str, space: Column | str, scale: Column | str) -> Column:
    """Polygon in original pixels as an array of (x, y) structs."""
    by = _divisor(space, scale)

    def point(p: Column) -> Column:
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.struct(half_even(x / by).alias("x"), half_even(y / by).alias("y"))

    return F.transform(_col(poly), point)
