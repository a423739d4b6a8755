"""Points and boxes on the 0-1000 grid (grounding) and the 0-100 scale (actions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000.0


def clamp(value: Column, low: float, high: float) -> Column:
    # greatest() and least() skip nulls, and a missing value must stay missing.
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def normalize_bbox(box: Column, width: Column, height: Column) -> Column:
    """Pixel xyxy box to grid units, clamped; null unless it has four values and positive sizes."""
    sides = [width, height, width, height]
    scaled = F.array(
        *[clamp(F.get(box, F.lit(i)) / side * GRID, 0.0, GRID) for i, side in enumerate(sides)]
    )
    return F.when((F.size(box) == 4) & (width > 0) & (height > 0), scaled)


def bbox_center(box: Column) -> Column:
    return F.array((box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0)


def to_xyxy_pixels(
    box: Column, width: Column, height: Column, box_format: str = "xyxy", units: str = "pixels"
) -> Column:
    if box_format not in ("xyxy", "xywh"):
        raise ValueError(f"unsupported box format: {box_format}")
    if units not in ("pixels", "normalized_0_1"):
        raise ValueError(f"unsupported box units: {units}")
    x1, y1 = box[0], box[1]
    x2, y2 = (box[2], box[3]) if box_format == "xyxy" else (x1 + box[2], y1 + box[3])
    if units == "normalized_0_1":
        x1, y1, x2, y2 = x1 * width, y1 * height, x2 * width, y2 * height
    return F.when(F.size(box) == 4, F.array(x1, y1, x2, y2))


def point_to_pixels(point: Column, width: Column, height: Column) -> Column:
    return F.array(point[0] / GRID * width, point[1] / GRID * height)


def bbox_to_pixels(box: Column, width: Column, height: Column) -> Column:
    return F.array(
        box[0] / GRID * width, box[1] / GRID * height, box[2] / GRID * width, box[3] / GRID * height
    )


def point_in_bbox(point: Column, box: Column) -> Column:
    """Inclusive and tolerant of swapped corners."""
    return point[0].between(F.least(box[0], box[2]), F.greatest(box[0], box[2])) & point[
        1
    ].between(F.least(box[1], box[3]), F.greatest(box[1], box[3]))


def pixel_distance(
    point: Column, target: Column, width: Column, height: Column, scale: float = GRID
) -> Column:
    dx = (point[0] - target[0]) / F.lit(scale) * width
    dy = (point[1] - target[1]) / F.lit(scale) * height
    return F.hypot(dx, dy)


def target_dimensions(width: Column, height: Column, max_width: int, max_height: int) -> Column:
    """Downscale-to-fit size; never enlarges and never falls below one pixel."""
    scale = F.least(F.lit(max_width) / width, F.lit(max_height) / height, F.lit(1.0))

    def side(value):
        return (
            F.when(scale >= 1.0, value)
            .otherwise(F.greatest(F.lit(1.0), F.bround(value * scale, 0)))
            .cast("int")
        )

    return F.struct(side(width).alias("width"), side(height).alias("height"))


def point_answer(point: Column, label: Column) -> Column:
    """The grounding answer text: one labelled integer point as compact JSON."""
    coordinate = [F.bround(clamp(point[i], 0.0, GRID), 0).cast("int") for i in (0, 1)]
    return F.to_json(
        F.array(F.struct(F.array(*coordinate).alias("point_2d"), label.alias("label")))
    )
