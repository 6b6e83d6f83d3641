"""Picture signatures as arrays: differences, edges, masks, ink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest luma, edge and changed differences of hard duplicates, near duplicates, one family.
HARD = (1.5, 2.0, 0.006)
NEAR = (3.0, 4.0, 0.025)
FAMILY = (3.0, 4.0, 0.06)
CHANGED_BY = 12


def _mean(x: Column) -> Column:
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x).cast("double"))


def mean_difference(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))


def changed_ratio(a: Column, b: Column, by: float = CHANGED_BY) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) > by, 1.0).otherwise(0.0)))


def compare(pixels: Column, edges: Column, other_pixels: Column, other_edges: Column) -> Column:
    """luma_mad, edge_mad, changed_ratio; infinite, infinite and 1 where sizes differ."""
    fits = (F.size(pixels) == F.size(other_pixels)) & (F.size(edges) == F.size(other_edges)) & (F.size(pixels) > 0)
    inf = F.lit(float("inf"))
    return F.struct(
        F.when(fits, mean_difference(pixels, other_pixels)).otherwise(inf).alias("luma_mad"),
        F.when(fits, mean_difference(edges, other_edges)).otherwise(inf).alias("edge_mad"),
        F.when(fits, changed_ratio(pixels, other_pixels)).otherwise(1.0).alias("changed_ratio"),
    )


def is_duplicate(difference: Column, limits: tuple[float, float, float] = NEAR) -> Column:
    return (difference["luma_mad"] <= limits[0]) & (difference["edge_mad"] <= limits[1]) & (difference["changed_ratio"] <= limits[2])


def edge_map(pixels: Column, width: int) -> Column:
    """Mean of the differences to the right and lower neighbours; at the border the pixel itself is the neighbour."""
    n = F.size(pixels)
    right = lambda i: F.when((i + 1) % width == 0, F.get(pixels, i)).otherwise(F.get(pixels, i + 1))
    below = lambda i: F.when(i + width >= n, F.get(pixels, i)).otherwise(F.get(pixels, i + width))
    return F.transform(pixels, lambda v, i: F.floor((F.abs(v - right(i)) + F.abs(v - below(i))) / 2).cast("int"))


def apply_mask(pixels: Column, mask: Column, fill: int = 128) -> Column:
    return F.zip_with(pixels, mask, lambda v, m: F.when(m > 0, F.lit(fill)).otherwise(v))


def mask_from_boxes(boxes: Column, width: int, height: int) -> Column:
    """A byte map, 1 inside any box; boxes are (x, y, w, h) as shares of the picture."""
    cell = lambda i: F.struct(((i % width) / width).alias("x"), (F.floor(i / width) / height).alias("y"))
    inside = lambda b, c: (c["x"] >= b["x"]) & (c["x"] < b["x"] + b["w"]) & (c["y"] >= b["y"]) & (c["y"] < b["y"] + b["h"])
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.when(F.exists(boxes, lambda b: inside(b, cell(i))), 1).otherwise(0))


def mask_fraction(mask: Column) -> Column:
    return _mean(mask)


def statistics(pixels: Column, edges: Column) -> Column:
    """mean, contrast (population deviation), sharpness (mean edge), blank."""
    mean = _mean(pixels)
    square = _mean(F.transform(pixels, lambda v: (v * v).cast("double")))
    contrast = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    extreme = _mean(F.transform(pixels, lambda v: F.when((v <= 3) | (v >= 252), 1.0).otherwise(0.0)))
    sharp = _mean(edges)
    return F.struct(mean.alias("mean"), contrast.alias("contrast"), sharp.alias("sharpness"), ((contrast < 2.2) | ((extreme > 0.995) & (sharp < 1.4))).alias("blank"))


def ink_ratio(pixels: Column) -> Column:
    """Share of ink: dark pixels (below 140) on a bright picture, bright ones (140 and up) on a dark one."""
    mean = _mean(pixels)
    return F.when(mean >= 128, _mean(F.transform(pixels, lambda v: F.when(v < 140, 1.0).otherwise(0.0)))).otherwise(_mean(F.transform(pixels, lambda v: F.when(v >= 140, 1.0).otherwise(0.0))))


def quick_distance(a: Column, b: Column) -> Column:
    """Mean difference of every fourth pixel, over 12, at most 1."""
    every = lambda x: F.filter(x, lambda v, i: i % 4 == 0)
    return F.least(F.lit(1.0), mean_difference(every(a), every(b)) / 12)


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x, y, w, h) as a share of their union."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def overlay_kind(box: Column, fill: Column) -> Column:
    """bar (at most 10 % high, 80 % wide), webcam (1 to 20 % of the area, aspect 0.8 to 2.4, sides at most 60 %, 30 % filled), else null; shares of the picture."""
    area, aspect = box["w"] * box["h"], F.try_divide(box["w"] * 16, box["h"] * 9)
    webcam = area.between(0.01, 0.20) & aspect.between(0.8, 2.4) & (F.greatest(box["w"], box["h"]) <= 0.6) & (fill >= 0.3)
    return F.when((box["h"] <= 0.10) & (box["w"] >= 0.80), "bar").when(webcam, "webcam")


def importance(has_target: Column, has_cue: Column, heat: Column, needed: Column, mode: Column) -> Column:
    """Weight of a state, to 3 places; modes A to D have the priors 0, .7, .8, .9."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    prior = F.when(mode == "A", 0.0).when(mode == "B", 0.7).when(mode == "C", 0.8).when(mode == "D", 0.9)
    return F.round(0.35 * one(has_target) + 0.15 * one(has_cue) + 0.15 * heat + 0.10 * one(needed) + 0.25 * prior, 3)
