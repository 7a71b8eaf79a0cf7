"""Messages between a host and a worker: image payloads in base64, answers in nested JSON, names and prompts, JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANSWER = "imageBase64 string, mimeType string, image struct<base64:string,mimeType:string>"
_CANDIDATES = "candidates array<struct<content:struct<parts:array<struct<inlineData:struct<data:string,mimeType:string>,inline_data:struct<data:string,mimeType:string>>>>>>"


def serialise(images: DataFrame) -> DataFrame:
    """image_id, header (JSON with width, height and the number of bytes), payload (base64) of images (image_id, width, height, data)."""
    header = F.to_json(F.struct("width", "height", F.octet_length("data").alias("dataByteLength")))
    return images.select("image_id", header.alias("header"), F.regexp_replace(F.base64("data"), "[\r\n]", "").alias("payload"))


def deserialise(messages: DataFrame) -> DataFrame:
    """image_id, width, height, data of serialised images; an error if a payload is not as long as its header says."""
    h = F.from_json("header", "width int, height int, dataByteLength long")
    m = messages.select("image_id", h.alias("h"), F.unbase64("payload").alias("data"))
    wrong = F.raise_error(F.concat(F.lit("payload length mismatch: expected "), F.coalesce(F.col("h.dataByteLength").cast("string"), F.lit("?")), F.lit(", received "), F.octet_length("data").cast("string")))
    data = F.when(F.octet_length("data") == F.col("h.dataByteLength"), F.col("data")).otherwise(wrong.cast("binary"))
    return m.select("image_id", "h.width", "h.height", data.alias("data"))


def answer_image(payload: Column) -> Column:
    """(mime_type, data) of an answer with imageBase64 or image.base64; null if it has neither."""
    p = F.from_json(payload, _ANSWER)
    mime = lambda c: F.coalesce(c, F.lit("image/png")).alias("mime_type")
    return F.when(p.imageBase64.isNotNull(), F.struct(mime(p.mimeType), p.imageBase64.alias("data"))).when(p.image.base64.isNotNull(), F.struct(mime(p.image.mimeType), p.image.base64.alias("data")))


def candidate_image(payload: Column) -> Column:
    """(mime_type, data) of the first part with inline data among an answer's candidates; null if there is none."""
    p = F.from_json(payload, _CANDIDATES)
    parts = F.flatten(F.transform(F.filter(p.candidates, lambda c: c.content.parts.isNotNull()), lambda c: c.content.parts))
    inline = F.filter(F.transform(parts, lambda x: F.coalesce(x.inlineData, x.inline_data)), lambda d: d.data.isNotNull())
    first = F.get(inline, F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.coalesce(first.mimeType, F.lit("image/png")).alias("mime_type"), first.data.alias("data")))


def clean_stem(name: Column, fallback: str) -> Column:
    """A file name's stem with runs of other characters than letters, digits, dot, dash and underscore as one underscore, and none at the ends; the fallback if nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(clean == "", fallback).otherwise(clean)


def title(text: Column, fallback: str, size: int = 80) -> Column:
    """The text without white space around it, cut to size characters; the fallback if nothing is left."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", fallback).otherwise(F.substring(t, 1, size))


def prompt(*parts: Column) -> Column:
    """The parts that are neither null nor blank, with a blank line between."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), "\n\n")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object per row and line; what was at path goes."""
    rows.write.mode("overwrite").json(path)
