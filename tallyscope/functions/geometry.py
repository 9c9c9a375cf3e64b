"""Boxes, points and frames as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four columns of a box."""
    return tuple(F.col(prefix + c) for c in BOX)


def clamp(value: Column, size: Column | int) -> Column:
    """Truncate towards zero and keep within an image (C4)."""
    return F.greatest(F.lit(0), F.least(value.cast("int"), (size if isinstance(size, Column) else F.lit(size)) - 1))


def centre(b) -> tuple[Column, Column]:
    """Centre of a box; a null box has (0, 0)."""
    return tuple(F.coalesce((b[k] + b[k + 2]) / 2, F.lit(0.0)) for k in (0, 1))


def trail_point(b) -> tuple[Column, Column]:
    """Integer centre, truncated towards zero."""
    return tuple(((b[k] + b[k + 2]) / 2).cast("int") for k in (0, 1))


def displacement(a, b) -> Column:
    """Distance of the centres of two boxes; 0 if either is null."""
    missing = a[0].isNull() | b[0].isNull()
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.when(missing, 0.0).otherwise(F.hypot(bx - ax, by - ay))


def inside(point, region: tuple[float, float, float, float] | None) -> Column:
    """Whether a point lies in a rectangle, edges included; no region holds nothing."""
    if region is None:
        return F.lit(False)
    return F.coalesce(point[0].between(region[0], region[2]) & point[1].between(region[1], region[3]), F.lit(False))


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union isn't positive."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def enclosing_diagonal() -> Column:
    """Aggregate: diagonal of the rectangle around all boxes of a group."""
    x1, y1, x2, y2 = box()
    return F.hypot(F.max(F.greatest(x1, x2)) - F.min(F.least(x1, x2)), F.max(F.greatest(y1, y2)) - F.min(F.least(y1, y2)))


def normalised(distance: Column, diagonal: Column) -> Column:
    """Distance over a diagonal; infinite where that is 0 (C11)."""
    return F.when(diagonal > 0, distance / diagonal).otherwise(F.lit(float("inf")))


def fitted_size(width: Column, height: Column, most_width: int | None, most_height: int | None) -> tuple[Column, Column]:
    """Size within bounds at the same aspect, never enlarged."""
    scale = F.least(F.lit(1.0), *[F.lit(float(m)) / s for m, s in ((most_width, width), (most_height, height)) if m is not None], F.lit(1.0))
    return tuple(F.greatest(F.lit(1), (s * scale).cast("int")) for s in (width, height))


def network_size(width: Column, height: Column, step: int = 32) -> tuple[Column, Column, Column, Column]:
    """Size rounded up to multiples of `step`, and the factors back to the source."""
    w, h = F.ceil(width / step) * step, F.ceil(height / step) * step
    return w, h, width / w, height / h


def crop_in_source(width: Column, height: Column, resized: tuple[int, int] = (128, 171), crop: tuple[int, int] = (112, 112)) -> Column:
    """The part of a source frame that a centred crop of the resized frame shows: scale, origin, visible box, and the share
    of the frame that is lost (C28). Crop origins round half to even."""
    (rh, rw), (ch, cw) = resized, crop
    top, left = round((rh - ch) / 2), round((rw - cw) / 2)
    sx, sy = width / rw, height / rh
    x1, y1 = F.bround(left * sx, 0), F.bround(top * sy, 0)
    x2, y2 = F.bround((left + cw) * sx, 0), F.bround((top + ch) * sy, 0)
    return F.struct(sx.alias("scale_x"), sy.alias("scale_y"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), (1 - F.lit(cw * ch / (rw * rh))).alias("lost"))
