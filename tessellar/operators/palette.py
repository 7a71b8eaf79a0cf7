"""Counts, palettes and selections over label rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.store import numbered


def _image():
    return Window.partitionBy("image_id")


def by(palette: DataFrame, *more: str) -> list[str]:
    """The columns that a palette is joined on: each image has its own if the palette names images."""
    return [*["image_id"] * ("image_id" in palette.columns), *more]


def label_counts(raster: DataFrame) -> DataFrame:
    return raster.where("label >= 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("pixel_count"))


def palette_table(raster: DataFrame, palette: DataFrame) -> DataFrame:
    """One row per used label: number, exact and paint colour, count and percentage. The palette is one row per label."""
    counts = label_counts(raster).join(palette, by(palette, "label"))
    p = C.paint(F.col("r"), F.col("g"), F.col("b"))
    share = F.bround(100.0 * F.col("pixel_count") / F.greatest(F.lit(1), F.sum("pixel_count").over(_image())), 3)
    return counts.select("image_id", (F.col("label") + 1).alias("number"), C.hex_code("r", "g", "b").alias("hex"), C.hex_code(*p).alias("paint_hex"), "pixel_count", share.alias("area_percent"))


def palette_json(table: DataFrame, sizes: DataFrame, source: str, settings: dict, outputs: dict) -> DataFrame:
    """image_id, document: one JSON document per image of table (as palette_table gives) and sizes (image_id, width, height).

    Settings and outputs keep their kinds: numbers, booleans, texts; None is left out.
    """
    rgb = lambda c: F.transform(F.array(*[F.lit(i) for i in (2, 4, 6)]), lambda i: F.conv(F.substr(c, i, F.lit(2)), 16, 10).cast("int"))
    row = F.struct("number", "hex", rgb(F.col("hex")).alias("rgb"), "paint_hex", rgb(F.col("paint_hex")).alias("paint_rgb"), "pixel_count", "area_percent")
    made = table.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("colors")).join(sizes, "image_id")
    pairs = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()]) if d else F.create_map().cast("map<string,string>")
    whole = F.struct(F.lit(source).alias("source"), "width", "height", pairs(settings).alias("settings"), "colors", pairs(outputs).alias("outputs"))
    return made.select("image_id", F.to_json(whole).alias("document"))


def swatches(table: DataFrame) -> DataFrame:
    """Place of each colour on the swatch sheet: one column up to 18 colours, else two."""
    n = F.count(F.lit(1)).over(_image())
    rows = F.when(n <= 18, n).otherwise(F.ceil(n / 2))
    at = F.col("number") - 1
    return table.select("image_id", "number", F.floor(at / rows).cast("int").alias("sheet_column"), (at % rows).cast("int").alias("sheet_row"))


# Fixed values of the swatch sheet: height of a row, margin, width of a column; side of a swatch and its place in the row; width of its outline; colours.
ROW, MARGIN, COLUMN, SWATCH, DROP, LINE = 58, 24, 360, 42, 5, 2
SHEET, INK = (252, 250, 244), (20, 20, 20)


def swatch_sheet(table: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b of a sheet for each image of table (image_id, number, r, g, b): a square of each colour with an outline. Texts are not drawn."""
    placed = swatches(table).join(table.select("image_id", "number", "r", "g", "b"), ["image_id", "number"])
    size = table.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).select("image_id", F.when(F.col("n") <= 18, 1).otherwise(2).alias("columns"), F.when(F.col("n") <= 18, F.col("n")).otherwise(F.ceil(F.col("n") / 2)).cast("int").alias("rows"))
    ground = size.select("image_id", F.explode(F.sequence(F.lit(0), 2 * MARGIN + COLUMN * F.col("columns") - 1)).alias("x"), (2 * MARGIN + ROW * F.col("rows") - 1).alias("last")).select("image_id", "x", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("y"))
    side = F.sequence(F.lit(0), F.lit(SWATCH))
    cells = placed.select("image_id", "r", "g", "b", (MARGIN + F.col("sheet_column") * COLUMN).alias("x0"), (MARGIN + F.col("sheet_row") * ROW + DROP).alias("y0"), F.explode(side).alias("i")).select("*", F.explode(side).alias("j"))
    line = (F.least("i", "j") < LINE) | (F.greatest("i", "j") > SWATCH - LINE)
    drawn = cells.select("image_id", (F.col("x0") + F.col("i")).cast("int").alias("x"), (F.col("y0") + F.col("j")).cast("int").alias("y"), *[F.when(line, ink).otherwise(F.col(c)).alias(f"c{c}") for c, ink in zip("rgb", INK)])
    return ground.join(drawn, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(f"c{c}", F.lit(v)).cast("int").alias(c) for c, v in zip("rgb", SHEET)])


def compact_labels(raster: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, label, new_label: used labels renumbered by falling count, then hue, saturation, value, old label."""
    h, s, v = C.hsv8(F.col("r"), F.col("g"), F.col("b"))
    order = Window.partitionBy("image_id").orderBy(F.desc("pixel_count"), h, s, v, "label")
    return label_counts(raster).join(palette, by(palette, "label")).select("image_id", "label", (F.row_number().over(order) - 1).alias("new_label"))


def compacted(raster: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels with their new label; those without a label, or with one that the palette lacks, get -1. An image of which no pixel has a label gets label 0 throughout."""
    new = compact_labels(raster, palette)
    none = raster.groupBy("image_id").agg((~F.max(F.coalesce(F.col("label") >= 0, F.lit(False)))).alias("bare")).where("bare")
    return raster.join(new, ["image_id", "label"], "left").join(none, "image_id", "left").select("image_id", "x", "y", "pid", F.when(F.col("bare"), 0).otherwise(F.coalesce("new_label", F.lit(-1))).alias("label"))


def compacted_palette(raster: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, label, r, g, b: what compacted() makes of the palette; white alone for an image without labels."""
    new = compact_labels(raster, palette).join(palette, by(palette, "label")).select("image_id", F.col("new_label").alias("label"), "r", "g", "b")
    bare = raster.select("image_id").distinct().join(new, "image_id", "left_anti").select("image_id", F.lit(0).alias("label"), *[F.lit(255).alias(c) for c in "rgb"])
    return new.unionByName(bare)


def strict_zip(paint: DataFrame, exact: DataFrame, key: str = "number") -> DataFrame:
    """paint and exact side by side; an error where one has a key that the other lacks."""
    both = paint.withColumn("_p", F.lit(True)).join(exact.withColumn("_e", F.lit(True)), key, "full")
    checked = F.when(F.col("_p").isNull() | F.col("_e").isNull(), F.raise_error(F.concat(F.lit("palettes differ in length at "), F.col(key).cast("string")))).otherwise(F.col(key))
    return both.withColumn(key, checked).where(F.col(key).isNotNull()).drop("_p", "_e")


def label_colours(raster: DataFrame) -> DataFrame:
    """image_id, label, r, g, b: one row for each label from 0 to the largest; labels that no pixel has are white, and label 0 is where none has any."""
    seen = raster.where("label >= 0").groupBy("image_id", "label").agg(*[F.first(c).alias(c) for c in "rgb"])
    last = raster.groupBy("image_id").agg(F.greatest(F.max("label"), F.lit(0)).alias("last")).select("image_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("label"))
    return last.join(seen, ["image_id", "label"], "left").select("image_id", "label", *[F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"])


def recolour(raster: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels with their label's colour; labels beyond the palette take the nearest end, unknown ones the first colour."""
    ends = palette.agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    at = raster.select("image_id", "x", "y", F.coalesce("label", F.lit(0)).alias("l")).join(F.broadcast(ends))
    return at.withColumn("label", F.least(F.greatest("l", "lo"), "hi")).join(palette, "label").select("image_id", "x", "y", "r", "g", "b")


def distinct_colours(raster: DataFrame) -> DataFrame:
    return raster.groupBy("image_id").agg(F.countDistinct("r", "g", "b").alias("colours"))


def colour_index(raster: DataFrame) -> DataFrame:
    """Colours numbered in the order of their first pixel."""
    first = raster.groupBy("image_id", "r", "g", "b").agg(F.min("pid").alias("first_pid"))
    return numbered(first, "image_id", ["first_pid"], "colour_index").withColumn("colour_index", (F.col("colour_index") - 1).cast("int"))


def coarse_histogram(raster: DataFrame) -> DataFrame:
    """Weighted six-bit colours, the input of clustering."""
    k = raster.groupBy("image_id", *[C.coarse(F.col(c)).alias(c) for c in "rgb"]).agg(F.count(F.lit(1)).alias("n"))
    return k.withColumn("weight", F.round(F.col("n") / F.sum("n").over(_image()), 9))


def facet_palette_stats(regions: DataFrame) -> DataFrame:
    """frequency and share of each colour over regions, and its rank by falling frequency, then colour."""
    g = regions.groupBy("image_id", F.col("color_index").alias("colour")).agg(F.sum("area").alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("frequency"), "colour"))
    return g.select("image_id", "colour", "frequency", F.round(F.col("frequency") / F.sum("frequency").over(_image()), 9).alias("share"), rank.alias("rank"))


def coverage_selection(clusters: DataFrame, hint: int, coverage: float = 0.97, min_share: float = 0.005, min_count: int = 8) -> DataFrame:
    """Clusters (image_id, first_seen, n) kept until they cover enough: the first always, then large ones while short of the target."""
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "first_seen")
    total = F.sum("n").over(_image())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = F.greatest(F.lit(min_count).cast("long"), F.bround(total * min_share).cast("long"))
    ranked = clusters.select("image_id", "first_seen", "n", F.row_number().over(order).alias("rn"), before.alias("before"), F.bround(total * coverage).cast("long").alias("target"), least.alias("least"))
    return ranked.where("rn = 1 OR (n >= least AND before < target AND rn <= %d)" % hint).select("image_id", "first_seen", "n", "rn")


def closest_pair(clusters: DataFrame) -> DataFrame:
    """The two clusters (image_id, first_seen, l, a, b) of an image that are nearest; the palette bounds the pairs."""
    c1, c2 = (clusters.select(F.col("image_id"), *[F.col(c).alias(f"{c}{k}") for c in ("first_seen", "l", "a", "b")]) for k in (1, 2))
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in ("l", "a", "b")), F.lit(0.0)))
    pairs = c1.join(c2, "image_id").where("first_seen1 < first_seen2").select("image_id", "first_seen1", "first_seen2", F.round(d, 6).alias("distance"))
    best = F.min(F.struct("distance", "first_seen1", "first_seen2")).alias("m")
    return pairs.groupBy("image_id").agg(best).select("image_id", "m.first_seen1", "m.first_seen2", "m.distance")


def merge_close(clusters: DataFrame, distance: float) -> DataFrame:
    """Clusters (image_id, first_seen, n, l, a, b) after the nearest two of an image have been merged until all are further apart.

    The larger of two keeps its place, the earlier of equals; the mean is weighted and the earlier first_seen stays. An image has as
    many clusters as its palette colours, so one task takes an image's.
    """

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(["n", "first_seen"], ascending=[False, True])
        centre, n, seen = pdf[["l", "a", "b"]].to_numpy(float), pdf.n.to_numpy(), pdf.first_seen.to_numpy()
        while len(n) > 1:
            far = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
            far[np.tril_indices(len(n))] = np.inf
            i, j = np.unravel_index(far.argmin(), far.shape)
            if far[i, j] > distance:
                break
            keep, drop = (i, j) if n[i] >= n[j] else (j, i)
            centre[keep] = (centre[keep] * n[keep] + centre[drop] * n[drop]) / (n[keep] + n[drop])
            n[keep] += n[drop]
            seen[keep] = min(seen[keep], seen[drop])
            centre, n, seen = (np.delete(x, drop, 0) for x in (centre, n, seen))
        import pandas as pd

        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "first_seen": seen, "n": n, "l": centre[:, 0], "a": centre[:, 1], "b": centre[:, 2]})

    rows = clusters.select("image_id", F.col("first_seen").cast("long").alias("first_seen"), F.col("n").cast("long").alias("n"), *[F.col(c).cast("double").alias(c) for c in ("l", "a", "b")])
    return rows.groupBy("image_id").applyInPandas(run, "image_id string, first_seen long, n long, l double, a double, b double")


def colour_distances(palette: DataFrame) -> DataFrame:
    """Euclidean distances of all palette colours; the palette bounds the pairs."""
    a, b = (palette.select(F.col("label").alias(f"label{k}"), F.array(*[F.col(c).cast("double") for c in "rgb"]).alias(f"c{k}")) for k in (1, 2))
    return a.join(b, F.col("label1") <= F.col("label2")).select("label1", "label2", F.round(C.euclidean(F.col("c1"), F.col("c2")), 6).alias("distance"))


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One step of k-means: points (v array, weight) to the nearest of centres (k, c array), ties to the smaller k; means by coordinate. Centres without points stay away."""
    near = points.join(F.broadcast(centres.agg(F.collect_list(F.struct("k", "c")).alias("cs"))))
    best = F.array_min(F.transform("cs", lambda s: F.struct(C.euclidean(F.col("v"), s.c).alias("d"), s.k.alias("k")))).k
    own = near.select(best.alias("k"), "weight", F.posexplode("v").alias("dim", "x"))
    return own.groupBy("k", "dim").agg(F.round(F.sum(F.col("x") * F.col("weight")) / F.sum("weight"), 6).alias("mean"))


def snap(colours: DataFrame, allowed: DataFrame) -> DataFrame:
    """The nearest allowed colour (label, r, g, b) in Lab of each colour (r, g, b), ties to the smaller label."""
    lab = lambda: F.array(*C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    table = allowed.select("label", lab().alias("lab")).agg(F.collect_list(F.struct("label", "lab")).alias("all"))
    own = lab()
    best = F.array_min(F.transform("all", lambda s: F.struct(F.round(C.euclidean(own, s.lab), 6).alias("d"), s.label.alias("label"))))
    return colours.select("r", "g", "b").distinct().join(F.broadcast(table)).select("r", "g", "b", best.label.alias("label"))


def cluster_report(clusters: DataFrame, sample: int | str) -> DataFrame:
    """image_id, sample_pixels, sample_percent, hex of clusters (n, and l, a, b in 8-bit Lab); sample is the number of pixels or the column that has it."""
    whole = [F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(c))) for c in ("l", "a", "b")]
    rgb = C.lab_to_rgb(whole[0] / 2.55, whole[1] - 128, whole[2] - 128)
    of = F.greatest(F.lit(1), F.col(sample) if isinstance(sample, str) else F.lit(sample))
    return clusters.select("image_id", F.col("n").alias("sample_pixels"), F.bround(100.0 * F.col("n") / of, 3).alias("sample_percent"), C.hex_code(*rgb).alias("hex"))
