"""Token ids of whole documents in a Parquet file format that is read selectively.

The files hold one row per document in ascending doc_id order: ids as a list column, dictionary-encoded where pages repeat
values and delta-encoded (format version 2) where not, in row groups and pages of set sizes, with page indexes. Reading
n_tokens or a range of doc_id touches only the metadata column and the row groups and pages of that range.

Null counts as an empty text and holds the end id alone. Repeated rows are separate documents, in the order of
(doc_id, text), nulls first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import default_path, encoder
from .common import keyed, record_batch, shared_dir, ship

END = 2
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2000
_STORED = pa.schema([("_k", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """Encode and write; file names ascend with doc_id, and rows ascend in each file."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]):
        enc = encoder(tokenizer)
        for b in it:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = [ids + tail for ids in enc.encode([t or "" for t in part.column(2).to_pylist()])]
                n = np.array([len(x) // 4 for x in out], np.int64)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(out), np.int32)))
                yield record_batch(_STORED, part.column(0), part.column(1), n, ids)

    dealt = keyed(docs).select("_k", "doc_id", "text").repartitionByRange(F.col("_k")).sortWithinPartitions("_k")
    rows = dealt.mapInArrow(run, "_k long, doc_id long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
    rows.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and, if asked for, ids, of doc_id from low up to high, without high. The filter reaches the page indexes."""
    df = spark.read.schema("_k long, doc_id long, n_tokens long, ids array<int>").parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") < high)
    return df.select("_k", "doc_id", "n_tokens", *["ids"] * ids)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: counts come from the metadata column, checksums from the ids."""
    out = pa.schema([("_k", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.string()), ("ids_crc32", pa.int64())])

    def check(it: Iterator[pa.RecordBatch]):
        for b in it:
            lists = b.column(2)
            off = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:z]) for a, z in zip(off[:-1], off[1:])]
            yield record_batch(out, b.column(0), b.column(1), np.diff(off).astype(np.int64), b.column(3), crc)

    stored = read_tokens(spark, path)
    rows = stored.select("_k", "doc_id", "ids", F.input_file_name().alias("file")).mapInArrow(check, "_k long, doc_id long, n_tokens long, file string, ids_crc32 long")
    # one row per file: a list that the file sizes bound
    files = read_tokens(spark, path, ids=False).groupBy(F.input_file_name().alias("file")).agg(F.sum("n_tokens").alias("n"), F.min("_k").alias("k"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("k")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("_k")) - F.col("n_tokens")
    return rows.join(before, "file").select("doc_id", (F.col("before") + within).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to the shared folder and return the digest of what was written."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer)
    return token_digest(docs.sparkSession, path)
