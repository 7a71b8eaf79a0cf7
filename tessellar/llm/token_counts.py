"""Tokens of each section of a document, by offset-mapped attribution.

A document is encoded once, whole. Its tokens come with the spans of characters that the library gives them; sections tile
the document's characters too, and the two lists of intervals are joined by position. A token that crosses a boundary goes
by an explicit rule:
  most   to the section that holds most of its characters, the earlier of equals (the default)
  first  to the section of its first character
  last   to the section of its last character
A token without characters of its own, such as a space that the library leaves out, goes to the section of its place; the
tokens that make up one character all have that character. Counts of a document's sections add up to the document's tokens.
A section is a line with its line feed, so a text has one more than it has line feeds, but none after a last one. Null and
empty texts have one empty section with no token. Repeated rows give repeated rows, and other columns are ignored. A text is
held whole in one task, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import default_path, encoder
from .common import record_batch, ship

_OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])


def line_ends(text: str) -> np.ndarray:
    """End offsets of lines, each with its line feed."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return ends[:-1] if len(ends) > 1 and text[-1] == "\n" else ends


def attribute(spans: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> np.ndarray:
    """Number of tokens, given as (start, end) rows, of each section."""
    start, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    last = len(section_ends) - 1
    low = np.minimum(np.searchsorted(section_ends, start, "right"), last)
    high = np.minimum(np.searchsorted(section_ends, end - 1, "right"), last)
    if rule == "first":
        to = low
    elif rule == "last":
        to = high
    elif rule == "most":
        to = low.copy()
        for t in np.flatnonzero(low != high):
            edges = np.concatenate([[start[t]], section_ends[low[t] : high[t]], [end[t]]])
            to[t] = low[t] + int(np.argmax(np.diff(edges)))
    else:
        raise ValueError(f"unknown rule: {rule}")
    return np.bincount(to, minlength=len(section_ends))


def section_tokens(docs: DataFrame, tokenizer: str | None = None, rule: str = "most") -> DataFrame:
    """doc_id, section (from 0), start and n_chars in characters, n_tokens."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    if rule not in ("most", "first", "last"):
        raise ValueError(f"unknown rule: {rule}")

    def run(it: Iterator[pa.RecordBatch]):
        enc = encoder(tokenizer)
        for b in it:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, sections, starts, sizes, counts = [], [], [], [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for k, t, tokens in zip(part.column(0).to_pylist(), texts, enc.spans(texts)):
                    ends = line_ends(t)
                    n = attribute(tokens, ends, rule)
                    first = np.concatenate([[0], ends[:-1]])
                    ids += [k] * len(ends)
                    sections.append(np.arange(len(ends)))
                    starts.append(first)
                    sizes.append(ends - first)
                    counts.append(n)
                yield record_batch(_OUT, ids, np.concatenate(sections).astype(np.int32), *(np.concatenate(x).astype(np.int64) for x in (starts, sizes, counts)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, section int, start long, n_chars long, n_tokens long")
