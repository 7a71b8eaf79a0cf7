"""From pixels to a picture to paint: smoothing, colours, cleaning, merging, regions, places for markers, templates and reports, for all images at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import cleanup, clusters, palette, regions, templates
from ..sources.images import read_images
from ..sources.raster import image_sizes
from ..sources.store import materialize, release
from .settings import Settings

# Runs of the strip cleanup before regions are built, steps of filling after thin protrusions are cut.
STRIP_RUNS, FILL_STEPS = 8, 12


@dataclass(frozen=True)
class Segmentation:
    """Tables of the steps. Rasters are (image_id, x, y, pid, ...); palette is (image_id, label, r, g, b); areas is (image_id, min_area)."""

    settings: Settings
    sizes: DataFrame
    areas: DataFrame
    rgb: DataFrame
    smooth: DataFrame
    quantised: DataFrame
    stripped: DataFrame
    pruned: DataFrame
    pixels: DataFrame
    regions: DataFrame
    palette: DataFrame
    detected: DataFrame | None


def build_segmentation(raster: DataFrame, settings: Settings = Settings()) -> Segmentation:
    """All steps over a raster (image_id, x, y, pid, r, g, b)."""
    rgb = materialize(raster.select("image_id", "x", "y", "pid", "r", "g", "b"))
    sizes = materialize(image_sizes(rgb))
    least = F.greatest(F.lit(settings.min_label_area), F.bround(0.00025 * F.col("width") * F.col("height")).cast("int"))
    areas = materialize(sizes.select("image_id", least.alias("min_area")))
    smooth = materialize(cleanup.bilateral(rgb, settings.smooth_d, settings.smooth_sigma_color, settings.smooth_sigma_space).join(rgb.select("image_id", "x", "y", "pid"), ["image_id", "x", "y"]))
    detected = materialize(clusters.detect_colours(smooth, settings.max_colors)) if settings.auto_color_count else None
    wanted = settings.color_count if detected is None else detected.select("image_id", F.col("detected").alias("k"))
    quantised = materialize(clusters.kmeans_labels(smooth, wanted))
    first = materialize(quantised.select("image_id", "label", F.col("cr").alias("r"), F.col("cg").alias("g"), F.col("cb").alias("b")).distinct())

    def compact(labels, colours):
        return materialize(palette.compacted(labels, colours)), materialize(palette.compacted_palette(labels, colours))

    stripped, second = compact(cleanup.strip_cleanup(quantised.select("image_id", "x", "y", "pid", "label"), first, STRIP_RUNS), first)
    pruned = cleanup.prune_protrusions(stripped, FILL_STEPS)
    labels, third = compact(regions.merged_regions(pruned, second, areas), second)
    pixels = materialize(regions.region_map(labels))
    release(first)
    return Segmentation(settings, sizes, areas, rgb, smooth, quantised, stripped, pruned, pixels, materialize(regions.region_table(pixels)), third, detected)


def segmented_files(spark: SparkSession, settings: Settings) -> Segmentation:
    """All steps over the image files at settings.image."""
    return build_segmentation(read_images(spark, settings.image, settings.resize_max), settings)


def placements(s: Segmentation) -> DataFrame:
    """image_id, region_id, number, area, x, y, radius of each region that is large enough for a number."""
    worthy = s.regions.join(s.areas, "image_id").where("area >= min_area").select("image_id", "region_id", (F.col("color_index") + 1).alias("number"), "area")
    return worthy.join(regions.label_points(s.pixels.join(worthy.select("image_id", "region_id"), ["image_id", "region_id"], "left_semi")), ["image_id", "region_id"])


def painted_palette(s: Segmentation) -> DataFrame:
    """The palette with the colours that it is painted with."""
    return s.palette.select("image_id", "label", *[c.alias(n) for n, c in zip("rgb", C.paint(F.col("r"), F.col("g"), F.col("b")))])


def markers(s: Segmentation, placed: DataFrame) -> DataFrame:
    """placed with the disc that marks each region (marker_x, marker_y, marker_radius) and its colour (cr, cg, cb)."""
    colour = painted_palette(s).select("image_id", (F.col("label") + 1).alias("number"), *[F.col(c).alias(f"c{c}") for c in "rgb"])
    return templates.markers(placed.join(s.sizes, "image_id"), F.col("width"), F.col("height")).join(colour, ["image_id", "number"])


def number_labels(s: Segmentation, placed: DataFrame) -> DataFrame:
    """placed with the scale and origin of each region's number, alone and in a disc."""
    return templates.number_labels(placed.join(s.sizes, "image_id"))


def template(s: Segmentation, mode: str, marked: DataFrame | None = None) -> DataFrame:
    """image_id, x, y, r, g, b of a template; with discs where the mode is one of discs alone."""
    layers = templates.template(s.pixels, painted_palette(s), mode)
    return templates.drawn(layers, marked) if mode in ("circles-only", "bright-color-circles") and marked is not None else layers


def report(s: Segmentation) -> DataFrame:
    """One row for each image: size, colours, regions, extreme areas, settings, and whether as many colours are left as were found."""
    held = s.pixels.select("image_id", "label").distinct().join(s.palette, ["image_id", "label"])
    exact = held.groupBy("image_id").agg(F.countDistinct("r", "g", "b").alias("exact_cleanup_unique_colors"))
    found = s.palette.groupBy("image_id").agg(F.count(F.lit(1)).alias("exact_main_colors_detected"))
    own = s.areas.select("min_area").distinct().collect()  # a few: the settings' own, or the share of an image's size
    parts = None
    for (area,) in own:
        mine = s.areas.where(F.col("min_area") == area).select("image_id")
        part = regions.paintability(s.regions.join(mine, "image_id", "left_semi"), s.sizes.join(mine, "image_id", "left_semi"), area, area, s.settings.write_colored_edges, s.settings.auto_color_count)
        parts = part if parts is None else parts.unionByName(part)
    out = parts.join(found, "image_id", "left").join(exact, "image_id", "left")
    same = F.coalesce(F.col("exact_cleanup_unique_colors") == F.col("exact_main_colors_detected"), F.lit(False))
    return out.withColumn("exact_cleanup_matches_detected_main_colors", same)


def palette_documents(s: Segmentation, outputs: dict) -> DataFrame:
    """image_id, document: the palette of each image with the settings that it was made with."""
    k = s.settings
    settings = {
        "color_count_mode": "auto_detected_k" if k.auto_color_count else "manual_fixed_k", "requested_color_count": k.color_count, "max_colors": k.max_colors, "min_label_area": k.min_label_area,
        "cleanup_bilateral_d": k.smooth_d, "cleanup_bilateral_sigma_color": k.smooth_sigma_color, "cleanup_bilateral_sigma_space": k.smooth_sigma_space, "kmeans_batch_size": clusters.BATCH, "kmeans_random_state": 0,
        "small_area_merging": True, "number_mode": k.number_mode,
    }
    return palette.palette_json(palette.palette_table(s.pixels, s.palette), s.sizes, k.image, settings, outputs)
