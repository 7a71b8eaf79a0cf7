"""What the operators of this subpackage share: row keys, Arrow batches and hashing."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import materialize, release, shared_dir  # noqa: F401

U64 = np.uint64
_MASK = (1 << 64) - 1
_RADIX = 0x9E3779B97F4A7C15
_BYTE = None


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that lack it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessellar_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "tessellar.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessellar", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._tessellar_shipped = True


def keyed(docs: DataFrame, key: str = "_k", rest: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and a unique key in the order of (doc_id, text); with rest, also a struct _rest of those columns.

    The key is doc_id itself where that is unique and never null; else rows are sorted by (doc_id, text), nulls
    first, and numbered. Rows that repeat stay separate documents.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.struct(*[docs[c] for c in rest]).alias("_rest")] * bool(rest))
    odd = base.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        return base.withColumn(key, F.col("doc_id"))
    return materialize(base.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def spans(off: np.ndarray, limit: int = 1 << 18):
    """Consecutive rows (i, j) of about limit bytes; a longer row stands alone, whole."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    up = np.ones(1, U64)
    down = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            a = np.full(size, base, U64)
            a[0] = 1
            setattr(_Powers, name, np.cumprod(a, dtype=U64))
    return _Powers.up[:n], _Powers.down[:n]


def byte_values() -> np.ndarray:
    global _BYTE
    if _BYTE is None:
        _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_RADIX))
    return _BYTE


class Hasher:
    """Hashes of any spans of a sequence of 64-bit values: a running polynomial, scrambled."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:], dtype=U64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Of every window of this many values."""
        n = len(self.sums) - 1 - size + 1
        return mix((self.sums[size:] - self.sums[: n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: hash, document, byte start, byte end. Words don't cross documents."""
    inside = ~_SEPARATOR[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    first[edges] = True
    last = np.ones(len(data), bool)
    last[:-1] = first[1:] | ~inside[1:]
    start, end = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return Hasher(byte_values()[data]).spans(start, end), doc, start, end


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_of(column, i: int) -> bytes:
    v = column[i].as_py()
    return b"" if v is None else v.encode() if isinstance(v, str) else v
