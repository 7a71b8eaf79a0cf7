"""Removal of word passages that occur more than once, by recompression.

Round 0 names runs of one word; each later round names pairs: a bit of each name, the same everywhere, says whether it
opens or closes a pair, and an opener before a closer become one symbol. A name is a hash of what it stands for, so all
tasks name alike without meeting. For each symbol the stretch of words is kept that decides how it was formed; a window
that holds the whole stretch has the symbol wherever it stands. The window's anchor is the longest of these symbols
(then the least hash, then the first). A window that decides no symbol, as inside a long run, is its own anchor.

Anchors are counted over the corpus: a shared one reveals a possible repeat. The stretches around it meet in one task, where
windows are compared word by word: no hash decides there.

Null and empty texts have no words. Texts under `size` words lose nothing. Repeated rows are separate documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, Hasher, mix, words
from .repeats import blocks_from_anchors, cover, finished, removed_windows

SIZE, ROUNDS = 35, 5
_FAR = 1 << 60
_POSITION = 34


def _units(data, off):
    h, doc, start, _ = words(data, off)
    return h, doc, np.searchsorted(doc, np.arange(len(off) - 1))


def symbols(values: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """name, first word, end, and the stretch [low, high) of words that decides each symbol."""
    n = len(values)
    new = np.ones(n, bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], n)
    d = doc[s]
    name = mix(values[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))
    # a run is decided by both its neighbours; at a document's end it isn't
    low, high = s - 1, e + 1
    low[np.append(True, d[1:] != d[:-1])] = -_FAR
    high[np.append(d[1:] != d[:-1], True)] = _FAR
    for r in range(rounds):
        m = len(name)
        if m < 2:
            break
        opens = (mix(name ^ U64(0xA5A5 + r)) & U64(1)).astype(bool)
        same = d[1:] == d[:-1]
        joins = np.zeros(m, bool)  # with the next
        joins[:-1] = opens[:-1] & ~opens[1:] & same
        second = np.zeros(m, bool)
        second[1:] = joins[:-1]
        # an opener that stays alone is decided by the next, a closer by the one before
        alone_open, alone_close = opens & ~joins, ~opens & ~second
        right = np.append(np.where(same, high[1:], _FAR), _FAR)
        left = np.insert(np.where(same, low[:-1], -_FAR), 0, -_FAR)
        high = np.where(alone_open, np.maximum(high, right), high)
        low = np.where(alone_close, np.minimum(low, left), low)
        keep = np.flatnonzero(~second)
        pair = joins[keep]
        nxt = np.minimum(keep + 1, m - 1)
        name = np.where(pair, mix(name[keep] * U64(0xD6E8FEB86659FD93) + mix(name[nxt])), name[keep])
        e = np.where(pair, e[nxt], e[keep])
        high = np.where(pair, np.maximum(high[keep], high[nxt]), high[keep])
        low = np.where(pair, np.minimum(low[keep], low[nxt]), low[keep])
        s, d = s[keep], d[keep]
    return name, s, e, low, high


def anchors(values: np.ndarray, doc: np.ndarray, size: int = SIZE):
    n = len(values)
    valid = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    if not len(valid):
        return valid, valid, np.zeros(0, U64), valid, valid
    name, s, e, from_, to = symbols(values, doc)
    fit = np.flatnonzero(to - from_ <= size)
    low, high = from_[fit], to[fit]
    length = np.minimum(e[fit] - s[fit], 63).astype(U64)
    key = ((U64(63) - length) << U64(58)) | ((name[fit] >> U64(40)) << U64(_POSITION)) | np.arange(len(fit), dtype=U64)
    table = [key]
    while 2 << (len(table) - 1) <= min(len(key), size):
        t, w = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(t[:-w], t[w:]))
    a = np.searchsorted(np.minimum.accumulate(low[::-1])[::-1], valid, "left")
    z = np.searchsorted(np.maximum.accumulate(high), valid + size, "right")
    width = z - a
    best = np.full(len(valid), -1, np.int64)
    some = np.flatnonzero(width > 0)
    level = np.zeros(len(some), np.int64)
    for k in range(1, len(table)):
        level[width[some] >= 1 << k] = k
    for k in range(len(table)):
        at = some[level == k]
        if len(at):
            best[at] = (np.minimum(table[k][a[at]], table[k][z[at] - (1 << k)]) & U64((1 << _POSITION) - 1)).astype(np.int64)
    alone = best < 0
    anchor = np.where(alone, -1 - valid, fit[np.maximum(best, 0)] if len(fit) else 0)
    start, nwin = blocks_from_anchors(valid, anchor)
    which = anchor[np.searchsorted(valid, start)]
    own = which < 0
    names = name[np.maximum(which, 0)].copy()
    names[own] = Hasher(values).spans(start[own], start[own] + size)
    at = np.maximum(which, 0)
    return start, nwin, names, np.where(own, start, from_[at]), np.where(own, start + size, to[at])


def _cut(data: np.ndarray, off: np.ndarray):
    """Words of a document, joined by spaces."""
    _, _, start, end = words(data, off)

    def content(_, first: int, n: int) -> bytes:
        return data[start[first] : end[first + n - 1]].tobytes()

    return content


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each different pair."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64) if len(a) else a


def _matches(contents: list[bytes], numbers: np.ndarray, place: np.ndarray, size: int):
    """Windows of words that occur more than once, told apart exactly: words get numbers, then pairs of equal-sized stretches do, until they are as long as a window."""
    lists = [c.split() for c in contents]
    lens = np.array(list(map(len, lists)), np.int64)
    known: dict[bytes, int] = {}
    name = np.array([known.setdefault(w, len(known)) for x in lists for w in x], np.int64)
    have = 1
    while have < size:
        step = min(have, size - have)
        name = _named(name[:-step], name[step:])
        have += step
    n = int(lens.sum())
    flag, none = np.zeros(n, bool), np.zeros(n, bool)
    off = np.concatenate([[0], np.cumsum(lens)])
    row = np.repeat(np.arange(len(lens)), lens)
    at = np.flatnonzero(np.arange(len(name)) + size <= off[row[: len(name)] + 1])
    total = np.bincount(name[at], weights=numbers[row[at]])
    flag[at[total[name[at]] > 1]] = True
    return lens, flag, none


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def substring_dedup(docs: DataFrame, size: int = SIZE, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text: every word in a window of `size` words that also starts elsewhere goes."""
    texts, removed = removed_windows(docs, size, _units, anchors, _cut, _matches)

    def finish(text, start, nwin):
        w = text.split()
        kept = w
        if len(start):
            gone = cover(len(w), start, nwin, size)
            kept = [x for x, g in zip(w, gone.tolist()) if not g]
        joined = b" ".join(kept)
        row = len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest()
        return (*row, joined.decode()) if with_text else row

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return finished(texts, removed, finish, schema + ", kept string" * with_text, _OUT.append(pa.field("kept", pa.string())) if with_text else _OUT)
