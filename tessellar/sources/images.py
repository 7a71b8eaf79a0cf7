"""From image files to pixel rows: PNG decoded here, other formats by Spark's reader; orientation, alpha, depth, and reduction by Lanczos weights.

A file is decoded by the task that reads it, since a compressed stream has no parts; what leaves the task are its pixels, some rows of the
image at a time. Everything after that is joins and groups over pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import image_sizes

_PIXELS = "image_id string, x int, y int, r int, g int, b int"
#: Pixels that leave a task at once.
_BATCH = 1 << 18
# Fixed values of the format: channels of each colour type, and the passes of interlacing (first column, row, steps).
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; a wrong checksum or a chunk cut short is an error."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged PNG chunk {kind.decode('latin1')}")
        yield kind, body
        at += 12 + size


def unfiltered(kinds: np.ndarray, coded: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """Bytes of rows (rows x units x bytes of a unit) from their coded form, by each row's kind of filter, and from the row above them, if there is one.

    A unit needs the one to its left and the two above these: all units of one diagonal are worked out together.
    """
    h, w, _ = coded.shape
    out = np.zeros((h + 1, w + 1, coded.shape[2]), np.int16)
    if above is not None:
        out[0, 1:] = above
    for step in range(w + h - 1):
        r = np.arange(max(0, step - w + 1), min(h - 1, step) + 1)
        x = step - r
        left, up, corner = out[r + 1, x], out[r, x + 1], out[r, x]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        kind = kinds[r][:, None]
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        out[r + 1, x + 1] = (coded[r, x] + add) & 255
    return out[1:, 1:]


def _samples(raw: bytes, w: int, h: int, depth: int, channels: int, above: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Samples (h x w x channels) of filtered scan lines, and the last line's bytes, for those below it."""
    stride, unit = (w * depth * channels + 7) // 8, max(1, depth * channels // 8)
    lines = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    if (lines[:, 0] > 4).any():
        raise ValueError("unknown filter of a PNG row")
    out = unfiltered(lines[:, 0], lines[:, 1:].reshape(h, stride // unit, unit).astype(np.int16), above)
    flat = out.reshape(h, stride).astype(np.uint8)
    if depth == 16:
        return flat.reshape(h, w, channels, 2).astype(np.int32) @ np.array([256, 1]), out[-1]
    if depth == 8:
        return flat.reshape(h, w, channels).astype(np.int32), out[-1]
    bits = np.unpackbits(flat, axis=1)[:, : w * depth].reshape(h, w, 1, depth)
    return bits.astype(np.int32) @ (1 << np.arange(depth - 1, -1, -1)), out[-1]


def flattened(samples: np.ndarray, depth: int) -> np.ndarray:
    """8-bit red, green and blue over white of samples with one (grey), two (grey, alpha), three or four (alpha last) channels."""
    s = samples.astype(float)
    if depth > 8:
        s = np.floor(s / ((1 << depth) - 1) * 255 + 0.5)
    n = s.shape[2]
    rgb, alpha = (s[..., :1].repeat(3, 2) if n < 3 else s[..., :3]), (s[..., n - 1 : n] / 255 if n in (2, 4) else np.ones(s.shape[:2] + (1,)))
    return np.floor(255 * (1 - alpha) + rgb * alpha + 0.5).astype(np.uint8)


def _coloured(samples: np.ndarray, depth: int, colour: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    """8-bit red, green and blue over white of samples of a colour type, with the file's palette and what it says of transparency."""
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)
        return flattened(np.concatenate([palette, alpha[:, None]], 1)[samples[..., 0]].astype(np.int32), 8)
    if clear is not None:  # one colour that is seen through
        key = np.frombuffer(clear, ">u2")
        solid = np.where((samples == key).all(2), 0, (1 << depth) - 1 if depth > 8 else 255)[..., None]
        samples = samples * (255 // ((1 << depth) - 1)) if depth < 8 else samples
        return flattened(np.concatenate([samples, solid], 2), depth)
    return flattened(samples * (255 // ((1 << depth) - 1)) if depth < 8 else samples, depth)


def png_bands(data: bytes, pixels: int = _BATCH) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x width x 3) of a PNG of any colour type, depth and interlacing, over white, some rows of so many pixels at a time.

    Rows are unpacked as they are needed, so what is held beside the file are the rows of one band; of an interlaced file, whose rows lie apart, all of them.
    """
    head, palette, clear, at, above = None, None, None, 0, None
    unpack, raw, packed = zlib.decompressobj(), bytearray(), []
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            w, h, depth, colour, _, _, interlaced = head
            channels = _CHANNELS[colour]
            line, rows = (w * depth * channels + 7) // 8 + 1, max(1, pixels // w)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT" and interlaced:
            packed.append(body)
        elif kind == b"IDAT":
            while at < h and (body or len(raw) >= line * min(rows, h - at)):
                take = min(rows, h - at)
                raw += unpack.decompress(body, line * take - len(raw)) if len(raw) < line * take else b""
                body = unpack.unconsumed_tail
                if len(raw) < line * take:
                    if not body:
                        break
                    continue
                samples, above = _samples(bytes(raw), w, take, depth, channels, above)
                raw = bytearray()
                yield at, _coloured(samples, depth, colour, palette, clear)
                at += take
    if not interlaced:
        if at < h:
            raw += unpack.flush()
            take = h - at
            if len(raw) < line * take:
                raise ValueError("a PNG cut short")
            yield at, _coloured(_samples(bytes(raw), w, take, depth, channels, above)[0], depth, colour, palette, clear)
        return
    whole = zlib.decompress(b"".join(packed))
    samples, at = np.zeros((h, w, channels), np.int32), 0
    for x, y, dx, dy in _PASSES:
        pw, ph = -(-(w - x) // dx), -(-(h - y) // dy)
        if pw > 0 and ph > 0:
            samples[y::dy, x::dx] = _samples(whole[at:], pw, ph, depth, channels)[0]
            at += ph * ((pw * depth * channels + 7) // 8 + 1)
    for y in range(0, h, rows):
        yield y, _coloured(samples[y : y + rows], depth, colour, palette, clear)


def decode_png(data: bytes) -> np.ndarray:
    """height x width x 3 of a PNG, over white."""
    return np.concatenate([band for _, band in png_bands(data)])


def _exif(body: bytes) -> int:
    """The orientation, 1 to 8, that an EXIF block states; 1 where it states none."""
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if order is None or len(body) < 8:
        return 1
    at = struct.unpack_from(order + "I", body, 4)[0]
    if at + 2 > len(body):
        return 1
    for k in range(struct.unpack_from(order + "H", body, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(body):
            break
        tag, kind, _, value = struct.unpack_from(order + "HHIH", body, entry)
        if tag == 0x0112 and kind == 3:
            return value if 1 <= value <= 8 else 1
    return 1


def orientation(data: bytes) -> int:
    """The orientation of a JPEG (its APP1 segment) or a PNG (its eXIf chunk); 1 for others."""
    if data[:8] == _SIGNATURE:
        return next((_exif(body) for kind, body in png_chunks(data) if kind == b"eXIf"), 1)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _exif(data[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


def upright(raster: DataFrame, turns: DataFrame) -> DataFrame:
    """Pixels where they belong by the orientation of turns (image_id, orientation); pid counts them in rows."""
    p = raster.join(image_sizes(raster), "image_id").join(turns, "image_id", "left").withColumn("o", F.coalesce("orientation", F.lit(1)))
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    # what the first row and the first column of the file are: 1 top left, 2 top right, 3 bottom right, 4 bottom left, 5 to 8 with the axes changed
    right, down = F.col("o").isin(2, 3, 6, 7), F.col("o").isin(3, 4, 7, 8)
    across = F.col("o") >= 5
    nx = F.when(across, F.when(right, h - 1 - y).otherwise(y)).otherwise(F.when(right, w - 1 - x).otherwise(x))
    ny = F.when(across, F.when(down, w - 1 - x).otherwise(x)).otherwise(F.when(down, h - 1 - y).otherwise(y))
    return p.select("image_id", nx.alias("x"), ny.alias("y"), (ny.cast("long") * F.when(across, h).otherwise(w) + nx).alias("pid"), "r", "g", "b")


def lanczos_weights(sizes: DataFrame, old: str, new: str) -> DataFrame:
    """image_id, at, place, weight: what each old place adds to each new one of an axis of sizes (image_id, old, new); the weights of a new place sum to 1."""
    scale = F.greatest(F.lit(1.0), F.col(old) / F.col(new))
    centre = (F.col("at") + 0.5) * (F.col(old) / F.col(new))
    t = sizes.select("image_id", F.col(old), scale.alias("s"), F.explode(F.sequence(F.lit(0), F.col(new) - 1)).alias("at"), F.col(new)).select("image_id", old, "s", "at", centre.alias("c"))
    low, high = F.greatest(F.lit(0), F.floor(F.col("c") - 3 * F.col("s") + 0.5)), F.least(F.col(old).cast("long"), F.floor(F.col("c") + 3 * F.col("s") + 0.5)) - 1
    t = t.select("image_id", "at", "c", "s", F.explode(F.sequence(low, high)).alias("place"))
    x = (F.col("place") - F.col("c") + 0.5) / F.col("s")
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(v * np.pi) / (v * np.pi))
    t = t.select("image_id", "at", "place", F.when(F.abs(x) < 3, sinc(x) * sinc(x / 3)).otherwise(0.0).alias("raw"))
    whole = t.groupBy("image_id", "at").agg(F.sum("raw").alias("whole"))
    return t.join(whole, ["image_id", "at"]).select("image_id", "at", F.col("place").cast("int").alias("place"), (F.col("raw") / F.col("whole")).alias("weight"))


def lanczos(raster: DataFrame, max_side: int) -> DataFrame:
    """The raster with its longer side cut down to max_side, first along rows, then along columns, each rounded to 8 bits; 0 or a longer max_side leave it as it is."""
    if max_side <= 0:
        return raster.select("image_id", "x", "y", "pid", "r", "g", "b")
    longest = F.greatest("width", "height")
    sizes = image_sizes(raster).withColumn("small", longest <= max_side)
    new = [F.greatest(F.lit(1), F.bround(F.col(c) * (F.lit(float(max_side)) / longest)).cast("int")).alias(f"n{c}") for c in ("width", "height")]
    sizes = sizes.select("image_id", "small", "width", "height", *new)
    kept = raster.join(sizes.where("small").select("image_id"), "image_id", "left_semi").select("image_id", "x", "y", "pid", "r", "g", "b")
    large = raster.join(sizes.where("NOT small").select("image_id"), "image_id", "left_semi")
    whole = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.sum(F.col("weight") * F.col(c)) + 0.5))).cast("int").alias(c)
    for old, axis, other in (("width", "x", "y"), ("height", "y", "x")):
        weights = lanczos_weights(sizes.where("NOT small"), old, f"n{old}").withColumnRenamed("place", axis)
        large = large.join(weights, ["image_id", axis]).groupBy("image_id", F.col("at").alias(axis), other).agg(*[whole(c) for c in "rgb"])
    out = large.join(sizes.select("image_id", "nwidth"), "image_id")
    return kept.unionByName(out.select("image_id", "x", "y", (F.col("y").cast("long") * F.col("nwidth") + F.col("x")).alias("pid"), "r", "g", "b"))


def png_pixels(files: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b of PNG files (image_id, content)."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for image, content in zip(pdf.image_id, pdf.content):
                for y, part in png_bands(bytes(content)):
                    yy, xx = np.mgrid[y : y + len(part), 0 : part.shape[1]]
                    yield pd.DataFrame({"image_id": image, "x": xx.ravel().astype(np.int32), "y": yy.ravel().astype(np.int32), **{c: part[..., k].ravel().astype(np.int32) for k, c in enumerate("rgb")}})

    return files.select("image_id", "content").mapInPandas(run, _PIXELS)


def spark_pixels(images: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b of what Spark's image reader gives (image_id, width, height, channels, data in the order blue, green, red, alpha)."""
    byte = lambda k: F.conv(F.hex(F.substring("line", F.col("x") * F.col("channels") + k + 1, 1)), 16, 10).cast("int")
    lines = images.select("image_id", "width", "channels", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substr("data", y * F.col("width") * F.col("channels") + 1, F.col("width") * F.col("channels")))).alias("y", "line"))
    p = lines.select("image_id", "channels", "y", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    alpha = F.when(F.col("channels") == 4, byte(3)).otherwise(255) / F.lit(255.0)
    over = lambda c: F.floor(255 * (1 - alpha) + c * alpha + 0.5).cast("int")
    grey = F.col("channels") == 1
    return p.select("image_id", "x", "y", *[over(F.when(grey, byte(0)).otherwise(byte(k))).alias(c) for c, k in (("r", 2), ("g", 1), ("b", 0))])


def read_images(spark: SparkSession, path: str, resize_max: int = 0) -> DataFrame:
    """image_id (the file), x, y, pid, r, g, b of the image files at path: upright, over white, the longer side no longer than resize_max (0: as it is)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), "content")
    is_png = F.substring("content", 1, 8) == F.lit(bytearray(_SIGNATURE))
    turn = F.udf(lambda c: orientation(bytes(c)), "int")  # once a file
    turns = files.select("image_id", turn("content").alias("orientation"))
    others = files.where(~is_png).select("image_id")
    read = spark.read.format("image").option("dropInvalid", False).load(path).select(F.col("image.origin").alias("image_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    others = read.withColumn("key", plain("image_id")).join(others.select(plain("image_id").alias("key"), F.col("image_id").alias("file")), "key").withColumn("image_id", F.col("file"))
    pixels = png_pixels(files.where(is_png)).unionByName(spark_pixels(others.where("width > 0")))
    return lanczos(upright(pixels, turns), resize_max)
