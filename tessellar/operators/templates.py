"""Templates: the raster layers of a picture to paint, coloured rims, and the places and sizes of its markers.

Glyphs are not drawn: what a drawing needs, places, radii, boxes and scales, are columns. Text sizes are those of a font's box
at scale 1, which grow with the scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from .palette import by
from .regions import beside, boundary_mask, edge_distance

# Colours of the outline and the ground; parameters of rims, markers and texts. Factors and limits in the functions
# below are fixed values, too.
OUTLINE, GROUND = (32, 32, 32), (255, 255, 255)
MODES = ("numbers", "color-circles", "circles-only", "bright-color-circles", "colored-edges")
LEAST_SCALE, LEAST_LABEL_SCALE, TEXT_WEIGHT = 0.22, 0.28, 1.8


def template(pixels: DataFrame, palette: DataFrame, mode: str = "numbers") -> DataFrame:
    """image_id, x, y, r, g, b of the layers below the markers: ground or bright colours, outlines over them, and coloured rims if asked for."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "colored-edges":
        return coloured_rims(pixels, palette)
    edge = boundary_mask(pixels)
    p = pixels.select("image_id", "x", "y", "label").join(edge, ["image_id", "x", "y"]).join(palette, by(palette, "label"), "left")
    below = [C.tint(F.col(c)) if mode == "bright-color-circles" else F.lit(g) for c, g in zip("rgb", GROUND)]
    return p.select("image_id", "x", "y", *[F.when(F.col("boundary"), o).otherwise(F.coalesce(b, F.lit(g))).alias(c) for c, o, b, g in zip("rgb", OUTLINE, below, GROUND)])


def rim_width(longest: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(6), F.bround(longest / 360.0).cast("int")))


def coloured_rims(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b: the ground, with each region's colour fading in from its edge, and outlines in the colour of the region they belong to.

    Distances to the edge are exact. A pixel counts as the edge, too, if an outline pixel touches it.
    """
    size = pixels.groupBy("image_id").agg(rim_width(F.greatest(F.max("x"), F.max("y")) + 1).alias("rim"))
    p = edge_distance(pixels).join(boundary_mask(pixels), ["image_id", "x", "y"])
    p = p.select("image_id", "x", "y", "region_id", "d2", "boundary", F.greatest("boundary", F.coalesce(beside("boundary", "x", -1), F.lit(False)), F.coalesce(beside("boundary", "x", 1), F.lit(False))).alias("b3"))
    p = p.select("*", F.greatest("b3", F.coalesce(beside("b3", "y", -1), F.lit(False)), F.coalesce(beside("b3", "y", 1), F.lit(False))).alias("near"))
    colours = pixels.select("image_id", "region_id", "label").distinct().join(palette, by(palette, "label"))
    p = p.join(colours, ["image_id", "region_id"]).join(size, "image_id")
    far = F.sqrt(F.col("d2").cast("double"))
    inner = (far <= F.col("rim") + 0.25) | F.col("near")
    alpha = 0.18 + 0.64 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("rim") + 1.0 - far) / F.greatest(F.lit(1.0), F.col("rim").cast("double"))))
    mixed = {c: F.when(F.col("boundary"), F.col(c)).when(inner, F.bround(g * (1 - alpha) + F.col(c) * alpha).cast("int")).otherwise(g) for c, g in zip("rgb", GROUND)}
    return p.select("image_id", "x", "y", *[mixed[c].alias(c) for c in "rgb"])


def marker_radius(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(5), F.bround(F.greatest(width, height) / 300.0).cast("int")))


def within_canvas(x: Column, y: Column, radius: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Centre and radius of a circle that stays inside the canvas; the middle where it can't."""
    r = F.least(radius, F.greatest(F.lit(1), F.floor((F.least(width, height) - 2) / 2).cast("int")))

    def safe(v, n):
        low, high = r + 1, n - r - 2
        return F.when(high < low, F.floor(n / 2)).otherwise(F.least(F.greatest(F.bround(v.cast("double")), low), high)).cast("int")

    return safe(x, width), safe(y, height), r


def markers(placements: DataFrame, width: Column, height: Column) -> DataFrame:
    """placements (image_id, region_id, x, y, radius, ...) with the circle that marks each: marker_x, marker_y, marker_radius."""
    r = F.least(marker_radius(width, height), F.greatest(F.lit(1), F.floor(F.col("radius") * 0.75).cast("int")))
    x, y, r = within_canvas(F.col("x"), F.col("y"), r, width, height)
    return placements.select("*", x.alias("marker_x"), y.alias("marker_y"), r.alias("marker_radius"))


def drawn(layers: DataFrame, marked: DataFrame) -> DataFrame:
    """layers (image_id, x, y, r, g, b) with a disc for each of marked (as markers() gives, with area and cr, cg, cb), the larger regions' first."""
    reach = F.sequence(-F.col("marker_radius"), F.col("marker_radius"))
    disc = marked.select("image_id", "region_id", "area", "marker_x", "marker_y", "marker_radius", "cr", "cg", "cb", F.explode(reach).alias("i")).select("*", F.explode(reach).alias("j")).where("i * i + j * j <= marker_radius * marker_radius")
    last = F.max_by(F.struct("cr", "cg", "cb"), F.struct((-F.col("area")).alias("a"), "region_id")).alias("c")
    over = disc.groupBy("image_id", (F.col("marker_x") + F.col("i")).alias("x"), (F.col("marker_y") + F.col("j")).alias("y")).agg(last)
    return layers.join(over, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(F.col("c")[f"c{c}"], c).alias(c) for c in "rgb"])


def _text(scale: Column, w: Column, h: Column, b: Column) -> dict[str, Column]:
    weight = F.greatest(F.lit(1), F.bround(scale * TEXT_WEIGHT).cast("int"))
    whole = lambda c: F.bround(c * scale).cast("int")
    return {"weight": weight, "w": whole(w), "h": whole(h), "b": whole(b), "margin": F.greatest(F.lit(3), weight + 2)}


def _shrunk(scale: Column, fits, steps: int, factor: float, least: float) -> Column:
    """The scale, times the factor until it fits or is no more than the least, so many times at most."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), scale.cast("double"), lambda s, _: F.when(fits(s) | (s <= least), s).otherwise(s * factor))


def text_scale(radius: Column, area: Column, w: Column, h: Column, low: Column, high: Column) -> Column:
    """Scale of a text with the box w x h at scale 1, by its region's area and radius, shrunk until it fits in."""
    by_area, by_radius = F.sqrt(F.greatest(area, F.lit(1)).cast("double")) / 95.0, F.greatest(radius * 0.075, low)
    first = F.least(high, F.greatest(low, F.least(by_area, by_radius)))
    wide, tall = F.greatest(F.lit(8.0), radius * 1.65), F.greatest(F.lit(8.0), radius * 1.35)
    return F.greatest(F.lit(LEAST_LABEL_SCALE), _shrunk(first, lambda s: (F.bround(w * s) <= wide) & (F.bround(h * s) <= tall), 20, 0.88, LEAST_LABEL_SCALE))


def text_in_canvas(scale: Column, w: Column, h: Column, b: Column, width: Column, height: Column) -> Column:
    """Scale at which a text with its margins fits on the canvas."""

    def fits(s):
        t = _text(s, w, h, b)
        return (t["w"] <= F.greatest(F.lit(1), width - 2 * t["margin"])) & (t["h"] + t["b"] <= F.greatest(F.lit(1), height - 2 * t["margin"]))

    return _shrunk(scale, fits, 24, 0.9, LEAST_SCALE)


def label_circle(scale: Column, radius: Column, w: Column, h: Column, b: Column) -> tuple[Column, Column]:
    """(scale, circle radius) of a text in a circle that fits into its region."""
    most = F.greatest(F.lit(1.0), radius * 0.82)

    def circle(s):
        t = _text(s, w, h, b)
        return F.greatest(F.lit(6), F.ceil(F.greatest(t["w"], t["h"] + t["b"]) / 2.0 + F.greatest(F.lit(4), t["weight"] + 3)).cast("int"))

    s = _shrunk(scale, lambda s: circle(s) <= most, 24, 0.9, LEAST_SCALE)
    return s, F.least(circle(s), F.greatest(F.lit(1), F.floor(most).cast("int")))


def text_origin(x: Column, y: Column, w: Column, h: Column, b: Column, margin: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Lower left corner of a text on the canvas, as near to (x, y) as its margins allow."""
    high_x, low_y, high_y = width - margin - w, margin + h, height - margin - b
    sx = F.when(high_x < margin, F.greatest(F.lit(0), F.floor((width - w) / 2).cast("int"))).otherwise(F.least(F.greatest(x, margin), high_x))
    sy = F.when(high_y < low_y, F.least(F.greatest(h, F.floor((height + h - b) / 2).cast("int")), F.greatest(F.lit(0), height - b))).otherwise(F.least(F.greatest(y, low_y), high_y))
    return sx.cast("int"), sy.cast("int")


# Width of a digit, height and depth of a number at scale 1, in pixels; limits of the scale by the longer side.
DIGIT, TALL, DEEP = 20.0, 21.0, 9.0


def number_labels(placed: DataFrame) -> DataFrame:
    """placed (image_id, region_id, number, area, x, y, radius, width, height) with scale, text_x, text_y of the number at a region's place, and circle_scale, circle_x, circle_y, circle of one in a disc."""
    longest = F.greatest("width", "height").cast("double")
    low, high = F.least(F.lit(0.62), F.greatest(F.lit(0.42), longest / 2600.0)), F.least(F.lit(0.85), F.greatest(F.lit(0.62), longest / 1500.0))
    w, h, b = F.char_length(F.col("number").cast("string")) * DIGIT, F.lit(TALL), F.lit(DEEP)
    p = placed.withColumn("scale", text_scale(F.col("radius"), F.col("area"), w, h, low, high))
    p = p.withColumn("scale", text_in_canvas(F.col("scale"), w, h, b, F.col("width"), F.col("height")))
    t = _text(F.col("scale"), w, h, b)
    x, y = text_origin(F.bround(F.col("x") - t["w"] / 2).cast("int"), F.bround(F.col("y") + t["h"] / 2).cast("int"), t["w"], t["h"], t["b"], t["margin"], F.col("width"), F.col("height"))
    s, r = label_circle(F.col("scale"), F.col("radius"), w, h, b)
    p = p.withColumns({"text_x": x, "text_y": y, "circle_scale": s, "_r": r})
    cx, cy, r = within_canvas(F.col("x"), F.col("y"), F.col("_r"), F.col("width"), F.col("height"))
    return p.withColumns({"circle_x": cx, "circle_y": cy, "circle": r}).drop("_r")
