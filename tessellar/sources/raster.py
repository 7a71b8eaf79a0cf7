"""Rasters: one row per pixel, (image_id, x, y, pid, ...). Scans, sinks and payload encodings."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the labels of the derived test raster, in order, and a palette for them.
EVENT_LABELS = ["click", "error", "purchase", "signup", "view"]
EVENT_PALETTE = [(0, 150, 167, 43), (1, 251, 249, 233), (2, 10, 10, 10), (3, 32, 96, 200), (4, 160, 160, 52)]
WIDTH = 100


def raster_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, pid, label, r, g, b of the raster that the events table spells."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.array_position(F.array(*map(F.lit, EVENT_LABELS)), F.col("event_type")) - 1
    return e.select(
        F.lit("events").alias("image_id"), (F.col("event_id") % WIDTH).cast("int").alias("x"), F.floor(F.col("event_id") / WIDTH).cast("int").alias("y"), F.col("event_id").alias("pid"),
        label.cast("int").alias("label"), (F.col("user_id") % 256).cast("int").alias("r"), ((F.col("event_id") * 7) % 256).cast("int").alias("g"), (F.floor("value") % 256).cast("int").alias("b"),
    )


def palette(spark: SparkSession, colours=EVENT_PALETTE) -> DataFrame:
    """One row per label. Every task gets it: joined by label instead, all pixels of a label would be one task's."""
    return F.broadcast(spark.createDataFrame(colours, "label int, r int, g int, b int"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height, data of image files by Spark's reader (blue, green, red order in data)."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("image_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def flatten_alpha(c: Column, alpha: Column) -> Column:
    """A channel over white; alpha from 0 to 255."""
    a = alpha / F.lit(255.0)
    return F.floor(255.0 * (1 - a) + c * a + 0.5).cast("int")


def narrow_channel(c: Column, depth: int) -> Column:
    """A channel of depth bits as 8 bits."""
    return F.floor(c * 255.0 / ((1 << depth) - 1) + 0.5).cast("int")


def fit_inside(w: Column, h: Column, max_w: int, max_h: int) -> tuple[Column, Column]:
    """Size that fits inside, in proportion, never larger than before and 1 at least."""
    s = F.least(F.lit(1.0), F.lit(float(max_w)) / w, F.lit(float(max_h)) / h)
    return F.greatest(F.lit(1), F.floor(w * s + 0.5).cast("int")), F.greatest(F.lit(1), F.floor(h * s + 0.5).cast("int"))


def area_resample(raster: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor pixels."""
    g = raster.groupBy("image_id", F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y"))
    return g.agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgb"])


def area_means(raster: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b of images brought to nw x nh pixels (sizes: image_id, w, h, nw, nh), no more than they have: means by area.

    A pixel spreads to the new ones that it overlaps, two at most on each axis, by whole numbers: an axis has w * nw parts, of which
    an old pixel is nw and a new one w.
    """
    p = raster.join(sizes.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("w", "h", "nw", "nh")]), "image_id")

    def cells(c, old, new):
        low, high = F.col(c) * F.col(new), (F.col(c) + 1) * F.col(new)
        part = lambda i: F.struct(i.alias("at"), (F.least(high, (i + 1) * F.col(old)) - F.greatest(low, i * F.col(old))).alias("n"))
        return F.transform(F.sequence(F.floor(low / F.col(old)), F.floor((high - 1) / F.col(old))), part)

    p = p.select("image_id", "r", "g", "b", F.explode(cells("x", "w", "nw")).alias("cx"), cells("y", "h", "nh").alias("cys")).select("image_id", "r", "g", "b", "cx", F.explode("cys").alias("cy"))
    weight = F.col("cx.n") * F.col("cy.n")
    g = p.groupBy("image_id", F.col("cx.at").cast("int").alias("x"), F.col("cy.at").cast("int").alias("y"))
    return g.agg(*[F.bround(F.sum(weight * F.col(c)) / F.sum(weight)).cast("int").alias(c) for c in "rgb"])


def image_sizes(raster: DataFrame) -> DataFrame:
    """image_id, width, height of images by their last pixels."""
    return raster.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def reduced(raster: DataFrame, max_side: int = 480) -> DataFrame:
    """The raster with its longer side cut down to max_side by area means; as it is if it is no longer than that. pid counts the new pixels."""
    size = image_sizes(raster).select("image_id", F.col("width").alias("w"), F.col("height").alias("h"))
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("w", "h"))
    new = size.select("image_id", "w", "h", *[F.greatest(F.lit(1), F.bround(F.col(c) * scale).cast("int")).alias(f"n{c}") for c in "wh"])
    g = area_means(raster, new).join(new.select("image_id", "nw"), "image_id")
    return g.select("image_id", "x", "y", (F.col("y").cast("long") * F.col("nw") + F.col("x")).alias("pid"), *"rgb")


def prepared_output(spark: SparkSession, out_dir: str, source: str | None = None) -> str:
    """A safe output folder without what was in it, through Spark's file systems."""
    if "://" not in out_dir:
        out_dir = str(safe_output(out_dir, source))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(path):
        system.delete(path, True)
    system.mkdirs(path)
    return out_dir


def safe_output(out_dir: str, source: str | None = None) -> Path:
    """A folder that may be overwritten: not the working directory, not a root, not one that holds the input."""
    out, cwd = Path(out_dir).resolve(), Path.cwd().resolve()
    if out == cwd:
        raise ValueError("the output folder is the working directory, and it is cleared before each run")
    if out == out.parent:
        raise ValueError("the output folder is a filesystem root")
    if source is not None and Path(source).resolve().is_relative_to(out):
        raise ValueError("the output folder holds the input, and it is cleared before each run")
    return out


def png_bytes(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB or grey PNG of an array."""
    h, w = rgb.shape[:2]
    kind = 2 if rgb.ndim == 3 else 0
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1).astype(np.uint8)], 1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


#: Rows of an image that one task packs.
PNG_BAND = 256
_ADLER = 65521


def _packed_band(channels: int, band: int):
    """The deflated scan lines of one band of rows, ended so that those of the next can follow, with their checksum and length."""

    def run(pdf):
        import pandas as pd

        w, h, k = int(pdf.width.iloc[0]), int(pdf.height.iloc[0]), int(pdf.band.iloc[0])
        rows = min(band, h - k * band)
        a = np.zeros((rows, w, channels), np.uint8)
        a[pdf.y - k * band, pdf.x] = np.stack([pdf[f"c{i}"] for i in range(channels)], 1)
        raw = np.concatenate([np.zeros((rows, 1), np.uint8), a.reshape(rows, -1)], 1).tobytes()
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "band": [k], "packed": [z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH)], "adler": [zlib.adler32(raw)], "size": [len(raw)]})

    return run


def _png_file(width: int, height: int, channels: int, bands: list) -> bytes:
    low, high, parts = 1, 0, []
    for b in bands:
        parts.append(bytes(b["packed"]))
        low, high = (low + (b["adler"] & 0xFFFF) - 1) % _ADLER, (high + (b["adler"] >> 16) + b["size"] * (low - 1)) % _ADLER
    parts[0] = b"\x78\x9c" + parts[0]
    parts.append(b"\x03\x00" + struct.pack(">I", high << 16 | low))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in [(b"IHDR", head), *((b"IDAT", p) for p in parts), (b"IEND", b"")])


def write_png(raster: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), band: int = PNG_BAND) -> DataFrame:
    """image_id, width, height, png: one file per image, of three channels or one. Bands of rows are packed in tasks of their own; what meets in a row are packed bytes. Missing pixels are black."""
    cells = raster.select("image_id", "x", "y", *[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(channels)], F.floor(F.col("y") / band).cast("int").alias("band")).join(image_sizes(raster), "image_id")
    packed = cells.groupBy("image_id", "band").applyInPandas(_packed_band(len(channels), band), "image_id string, band int, packed binary, adler long, size long")
    bands = packed.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("band", "packed", "adler", "size"))).alias("bands")).join(image_sizes(raster), "image_id")
    file = F.udf(lambda w, h, parts: _png_file(w, h, len(channels), parts), "binary")  # once an image
    return bands.select("image_id", "width", "height", file("width", "height", "bands").alias("png"))


def chunks(text: Column, size: int = 240_000) -> Column:
    """Pieces of size characters; an empty text has one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length(text) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))
