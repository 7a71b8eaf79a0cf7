"""Removal of byte strings that occur earlier in the corpus, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Texts are brought together by content-chosen anchors (repeats.py): all equal strings of `size` bytes meet in one task,
inside contents of at most 2 * size bytes, one for each distinct content, with the number of its copies. There the contents are sorted by suffix as far
as the threshold, which gives their Burrows-Wheeler transform. From the interval of the empty string, breadth first, every
interval is extended backwards by the bytes that stand before each of its rows, by a few at first and by more at each level; each level has the intervals of
strings longer by as much, so common prefixes come in increasing order. Intervals of one suffix whose content has no copies are left out and the expansion
stops at the threshold: what is left are the repeated strings, and the bytes themselves are compared.

Null counts as an empty text. Texts under `size` bytes lose nothing. Repeated rows are separate documents, in the order
of (doc_id, text).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, Hasher, byte_values
from .repeats import blocks_from_anchors, cover, finished, removed_windows, runs_of

SIZE, GRAM = 100, 32
_POSITION = 40


def _units(data, off):
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return data, doc, off[:-1]


def anchors(values: np.ndarray, doc: np.ndarray, size: int = SIZE):
    """The anchor is the gram of GRAM bytes in the window with the least hash, the first of equals."""
    n, gram = len(values), min(GRAM, size)
    valid = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    if not len(valid):
        return valid, valid, np.zeros(0, U64), valid, valid
    h = Hasher(byte_values()[values]).windows(gram)
    key = (h >> U64(_POSITION) << U64(_POSITION)) | np.arange(len(h), dtype=U64)
    width, have = size - gram + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    at = (key[valid] & U64((1 << _POSITION) - 1)).astype(np.int64)
    start, nwin = blocks_from_anchors(valid, at)
    chosen = at[np.searchsorted(valid, start)]
    return start, nwin, h[chosen], chosen, chosen + gram


def bounded_suffixes(text: np.ndarray, bound: int) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """(suffixes, unit, names): the suffixes of text ordered by their first bound symbols or more, by doubling; the order of
    equal ones doesn't matter. names[j] has, of each place, a number for its first unit * 2**j symbols. Only what equals a neighbour is sorted further."""
    n, base, unit = len(text), int(text.max()) + 1, 1
    key = text.astype(np.int64)
    while base ** (unit + 1) < 1 << 62 and unit < bound:  # as many symbols as fit in one integer
        key = key * base
        key[: n - unit] += text[unit:]
        unit += 1
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)  # the row where the suffixes begin that are equal so far
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    names, have = [rank.astype(np.int32)], unit
    row = np.flatnonzero(~new | np.append(~new[1:], False))  # rows that equal a neighbour
    while have < bound:
        if len(row):
            at = order[row]
            after = np.minimum(at + have, n)
            key = rank[at] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            turn = np.argsort(key)
            key, at = key[turn], at[turn]
            order[row] = at
            new = np.ones(len(row), bool)
            new[1:] = key[1:] != key[:-1]
            rank[at] = np.maximum.accumulate(np.where(new, row, 0))
            row = row[~new | np.append(~new[1:], False)]
        have *= 2
        names.append(rank.astype(np.int32))
    return order, unit, names


def repeated_intervals(text: np.ndarray, size: int, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, rows in the intervals of strings of size symbols that occur more than once, the interval of each).

    text: symbols from 0, where 0 ends each content and is never part of a string; several: of each place in text, whether
    its content stands for more than one.
    """
    n = len(text)
    suffix, unit, names = bounded_suffixes(text, size)
    heavy = several[suffix]
    ends = np.flatnonzero(text == 0)
    room = (ends[np.searchsorted(ends, np.arange(n))] - np.arange(n))[suffix]  # symbols before the next end
    before = text[suffix - 1]  # the transform; the text is read as a circle and ends with 0
    # where the suffix longer by the symbol before stands: rows of one symbol keep their order, for strings as far as the bound
    by_symbol = np.argsort(before, kind="stable")
    longer = np.empty(n, np.int32)
    longer[by_symbol] = np.arange(n, dtype=np.int32)

    def levels():
        """(symbols to extend by, row longer by them, number of a place's first symbols), the shortest extension first."""
        to = longer
        for q in range(1, unit + 1):
            if q == size % unit:
                key, base = np.zeros(n, np.int64), int(text.max()) + 1
                for k in range(q):
                    key = key * base
                    key[: n - k] += text[k:]
                yield q, to, key
            if q < unit:
                to = longer[to]
        for j in range((size // unit).bit_length()):
            if size // unit >> j & 1:
                yield unit << j, to, names[j]
            to = to[to]

    rows, group = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    marked, parent = np.zeros(n, bool), np.zeros(n, np.int32)
    for q, ahead, name in levels():
        to = ahead[rows]
        use = room[to] >= q
        to = to[use]
        if not len(to):
            return suffix, to, to
        marked[to] = True
        parent[to] = group[use]
        at = np.flatnonzero(marked).astype(np.int32)
        marked[to] = False
        # an interval: consecutive rows of one parent and equal first symbols
        p, f = parent[at], name[suffix[at]]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (p[1:] != p[:-1]) | (f[1:] != f[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        stay = ~alone | heavy[at]
        rows = at[stay]
        group = np.cumsum(new[stay], dtype=np.int32) - 1
        if not len(rows):
            break
    return suffix, rows, group


def _cut(data: np.ndarray, off: np.ndarray):
    def content(_, first: int, n: int) -> bytes:
        return data[first : first + n].tobytes()

    return content


def _matches(contents: list[bytes], numbers: np.ndarray, place: np.ndarray, size: int):
    """Windows that also occur in a content that comes earlier, and those that occur first in a content that stands for several."""
    lens = np.array(list(map(len, contents)), np.int64)
    values = np.frombuffer(b"".join(contents), np.uint8)
    row = np.repeat(np.arange(len(lens)), lens)
    text = np.zeros(len(values) + len(lens), np.int16)  # with an end after each content
    text[np.arange(len(values)) + row] = values.astype(np.int16) + 1
    several = np.repeat(numbers > 1, lens + 1)
    suffix, rows, group = repeated_intervals(text, size, several)
    every, rest = np.zeros(len(values), bool), np.zeros(len(values), bool)
    if len(rows):
        at = suffix[rows]
        content = np.repeat(np.arange(len(lens)), lens + 1)[at]
        first = np.full(int(group[-1]) + 1, len(lens), np.int64)
        np.minimum.at(first, group, place[content])
        own = place[content] == first[group]
        every[(at - content)[~own]] = True
        rest[(at - content)[own & (numbers[content] > 1)]] = True
    return lens, every, rest


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def suffix_dedup(docs: DataFrame, size: int = SIZE, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes: every byte in a string of `size` bytes that also starts earlier goes."""
    texts, removed = removed_windows(docs, size, _units, anchors, _cut, _matches)

    def finish(text, start, nwin):
        kept, spans = text, 0
        if len(start):
            gone = cover(len(text), start, nwin, size)
            spans = len(runs_of(gone)[0])
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        row = len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()
        return (*row, kept) if with_kept else row

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return finished(texts, removed, finish, schema + ", kept binary" * with_kept, _OUT.append(pa.field("kept", pa.binary())) if with_kept else _OUT)
