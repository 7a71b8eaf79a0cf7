"""Border geometry: path data, shoelace areas, halving, SVG in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_number(c: Column) -> Column:
    """A number as text, a whole one without a point."""
    c = c.cast("double")
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def path_data(points: Column, scale: float = 1.0) -> Column:
    """Quadratic path through an ordered array of (x, y), times scale: to each point by way of the middle between it and the one before."""
    at = lambda x, y: F.concat(plain_number(x * F.lit(scale)), F.lit(" "), plain_number(y * F.lit(scale)), F.lit(" "))

    def step(i):
        p, q = F.get(points, i - 1), F.get(points, i)
        return F.concat(F.lit("Q "), at((q.x + p.x) / 2, (q.y + p.y) / 2), at(q.x, q.y))

    n = F.size(points)
    steps = F.when(n > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), step), "")).otherwise("")
    return F.when(n > 0, F.concat(F.lit("M "), at(points[0].x, points[0].y), steps, F.lit("Z"))).otherwise("")


def shoelace(points: Column) -> Column:
    """Area of a closed path, without sign."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(points, i).x * F.get(points, (i + 1) % n).y - F.get(points, (i + 1) % n).x * F.get(points, i).y)
    return F.abs(F.aggregate(terms.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)) / 2


def halve(points: Column, width: int, height: int) -> Column:
    """Means of consecutive pairs of an array of (x, y, side); both of a pair stay if its first is on the image's edge.

    The ends stay, and paths of five points or fewer. Means count as points on a left side.
    """
    n = F.size(points)
    edge = lambda p: (p.x == 0) | (p.y == 0) | (p.x == width - 1) | (p.y == height - 1)

    def pair(i):
        p, q = F.get(points, i), F.get(points, i + 1)
        mean = F.struct(((p.x + q.x) / 2).alias("x"), ((p.y + q.y) / 2).alias("y"), F.lit(0).alias("side"))
        return F.when(edge(p), F.array(p, q)).otherwise(F.array(mean))

    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1)), F.lit(2)), pair))
    return F.when(n > 5, F.concat(F.array(F.element_at(points, 1)), inner, F.array(F.element_at(points, -1)))).otherwise(points)


def svg_parts(facets: DataFrame, sizes: DataFrame, scale: float = 1.0, fill: bool = True, stroke: bool = True, labels: DataFrame | None = None, font_size: float = 60, font_colour: str = "#333") -> DataFrame:
    """image_id, place, piece, text: the pieces of one SVG document per image of sizes (image_id, width, height), from facets (image_id, facet_id, color_index, r, g, b, points).

    Piece 0 of place -1 is the head, that of the largest place the foot; between them stand the facets in the order of their numbers, each a closed path and, if
    labels (image_id, facet_id, min_x, min_y, max_x, max_y) are given, the number of its colour in its label's box. No row holds a document.
    """
    times = lambda c: plain_number(c * F.lit(scale))
    w, h = times(F.col("width")), times(F.col("height"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">'))
    ends = sizes.select("image_id", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("place"), head.alias("text")), F.struct(F.lit((1 << 63) - 1).alias("place"), F.lit("</svg>").alias("text")))).alias("e"))
    rgb = F.concat(F.lit("rgb("), F.concat_ws(",", "r", "g", "b"), F.lit(")"))
    colours = [F.lit("#000") if stroke else rgb if fill else F.lit("none"), rgb if fill else F.lit("none")]
    path = F.concat(F.lit('<path data-facet-id="'), F.col("facet_id").cast("string"), F.lit('" d="'), path_data(F.col("points"), scale), F.lit('" stroke="'), colours[0], F.lit('" stroke-width="1" fill="'), colours[1], F.lit('" />'))
    out = ends.select("image_id", "e.place", F.lit(0).alias("piece"), "e.text").unionByName(facets.where(F.size("points") > 0).select("image_id", F.col("facet_id").cast("long").alias("place"), F.lit(0).alias("piece"), path.alias("text")))
    if labels is None:
        return out
    number = F.col("color_index").cast("string")
    box = facets.select("image_id", "facet_id", "color_index").join(labels, ["image_id", "facet_id"])
    label = F.concat(
        F.lit('<g class="label" transform="translate('), times(F.col("min_x")), F.lit(","), times(F.col("min_y")), F.lit(')"><svg width="'), times(F.col("max_x") - F.col("min_x")), F.lit('" height="'), times(F.col("max_y") - F.col("min_y")),
        F.lit('" overflow="visible" viewBox="-50 -50 100 100" preserveAspectRatio="xMidYMid meet"><text font-family="Tahoma" font-size="'), plain_number(F.lit(float(font_size)) / F.char_length(number)),
        F.lit(f'" dominant-baseline="middle" text-anchor="middle" fill="{font_colour}">'), number, F.lit("</text></svg></g>"),
    )
    return out.unionByName(box.select("image_id", F.col("facet_id").cast("long").alias("place"), F.lit(1).alias("piece"), label.alias("text")))


def write_svg(parts: DataFrame, path: str) -> None:
    """A folder for each image: its files, one after the other in the order of their names, are the document. Pieces are dealt out by ranges, so a large document is many tasks' work."""
    parts.repartitionByRange("image_id", "place", "piece").sortWithinPartitions("image_id", "place", "piece").select("image_id", "text").write.mode("overwrite").partitionBy("image_id").text(path)
