"""Benchmark decontamination: rare n-gram seeds bring passages and test items together, Smith-Waterman alignment scores them.

Words are lower-cased runs of letters, digits and non-ASCII characters other than typographic punctuation. Every n-gram of an item whose words make it rare in
the corpus is a seed, and so is at least the rarest quarter of each item's n-grams. Rarity is what the words' counts over
the whole corpus lead to expect, not how often the n-gram occurs, so a passage that leaked into many documents keeps its
seeds. Hits of one item near one place make a passage, which is aligned word by word with the whole item (match 2,
mismatch -1, gap -1). The score is the share of the most that the item can reach; documents from MIN_SCORE on are returned.

Seeds go to the tasks in blocks of items with at most SEEDS n-grams each; a larger benchmark takes more passes.
Null and empty texts match nothing. A part of an item of fewer than MIN_WORDS words is no evidence, and the whole of it none inside other prose: such an item
is found where a line has just its words, with score 1. Of places that score
equally the first counts. Repeated rows give repeated rows. Further columns are ignored. A text of any length is searched
whole, in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, byte_values, record_batch, ship, signed

N, MIN_SCORE, MIN_WORDS, SEEDS = 3, 0.5, 5, 2_000_000
#: An n-gram is rare if it is expected less than once in so many words.
RARE = 1e7
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
_COUNTS = pa.schema([("h", pa.int64()), ("n", pa.int64())])

_PUNCTUATION = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")
_INSIDE = np.ones(256, bool)
_INSIDE[:128] = [bool(re.match("[a-z0-9]", chr(c))) for c in range(128)]


def normal_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and, of each text, its first word; words don't cross texts."""
    raw = [(t if t.isascii() else _PUNCTUATION.sub(" ", t)).lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _INSIDE[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(r) + 1 for r in raw])
    h = Hasher(byte_values()[data]).spans(start, end) if len(start) else np.zeros(0, U64)
    return h, np.searchsorted(start, np.concatenate([[0], ends]))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: (score, item end, passage end)."""
    m = len(passage)
    at = np.arange(m + 1)
    row = np.zeros(m + 1)
    best, bi, bj = 0.0, 0, 0
    for i, w in enumerate(item):
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == w, 2, -1))
        row = np.maximum.accumulate(new + at) - at  # gaps in the item
        j = int(row.argmax())
        if row[j] > best:
            best, bi, bj = float(row[j]), i + 1, j
    return best, bi, bj


class Seeds:
    """Sorted seed hashes with the items and places they come from."""

    def __init__(self, items: list[tuple[int, np.ndarray]], expected: dict[int, float], n: int):
        self.items = items
        keys, owner, place, sizes = [], [], [], []
        for k, (_, words) in enumerate(items):
            size = min(n, len(words))
            if not size:
                continue
            grams = Hasher(words).windows(size)
            rate = np.array([expected.get(int(w), 0.0) for w in signed(words)])
            chance = np.exp(np.convolve(np.log(np.maximum(rate, 1e-12)), np.ones(size), "valid"))
            seed = (chance * RARE < 1) | (chance <= np.sort(chance)[(len(chance) - 1) // 4])
            at = np.flatnonzero(seed)
            keys.append(grams[at])
            owner += [k] * len(at)
            place.append(at)
            sizes += [size] * len(at)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner, self.sizes = np.array(owner, np.int64)[order], np.array(sizes, np.int64)[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> U64(42)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in grams, row of the seed table), every pair."""
        at = np.flatnonzero(self.filter[(grams >> U64(42)).astype(np.int64)])
        low, high = np.searchsorted(self.keys, grams[at], "left"), np.searchsorted(self.keys, grams[at], "right")
        count = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        where = np.repeat(at, count)
        ok = self.sizes[rows] == size
        return where[ok], rows[ok]


def _passages(seeds: Seeds, words: np.ndarray, where: np.ndarray, rows: np.ndarray, least: float):
    """Aligned passages of one document: the best of each item."""
    out = []
    owner = seeds.owner[rows]
    for k in np.unique(owner):
        mine = owner == k
        item_id, item = seeds.items[k]
        size = len(item)
        guess = np.sort(where[mine] - seeds.place[rows[mine]])
        best = None
        for group in np.split(guess, np.flatnonzero(np.diff(guess) > size) + 1):
            low, high = max(0, int(group[0]) - size // 2 - 1), min(len(words), int(group[-1]) + size + size // 2 + 1)
            score, i, j = align(item, words[low:high])
            if best is None or score > best[0]:
                best = score, low, i, j
        score, low, i, j = best
        if score >= least * 2 * size:
            back = align(item[:i][::-1], words[low : low + j][::-1])[2]
            out.append((item_id, round(score / (2 * size), 4), low + j - back, low + j))
    return out


def _whole(words: np.ndarray) -> int:
    return int(Hasher(words).spans(np.array([0]), np.array([len(words)]))[0])


def _lines_of(short: dict[int, list[int]], text: str, min_words: int) -> list[tuple]:
    """Short items that are all of a line, each at the first such line."""
    h, first = normal_words(text.split("\n"))
    n = np.diff(first)
    at = np.flatnonzero((n > 0) & (n < min_words))
    out: dict[int, tuple] = {}
    for line, key in zip(at.tolist(), Hasher(h).spans(first[at], first[at + 1]).tolist()):
        for item_id in short.get(key, ()):
            out.setdefault(item_id, (item_id, 1.0, int(first[line]), int(first[line + 1])))
    return list(out.values())


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, min_score: float = MIN_SCORE, max_seeds: int = SEEDS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of each document and item that align well enough, or, of items under min_words words, that have a line alike."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks: list[list[tuple[int, np.ndarray]]] = [[]]
    held = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = normal_words([r.text or ""])[0]
        if not len(words):
            continue
        if held + len(words) > max_seeds and held:
            blocks.append([])
            held = 0
        held += len(words)
        blocks[-1].append((r.item_id, words))

    out = None
    for block in blocks:
        items, short = [x for x in block if len(x[1]) >= min_words], {}
        for item_id, words in block:
            if len(words) < min_words:
                short.setdefault(_whole(words), []).append(item_id)
        known = np.unique(np.concatenate([np.zeros(0, U64), *(w for _, w in items)]))
        shared = spark.sparkContext.broadcast(known)

        def count(it: Iterator[pa.RecordBatch], shared=shared):
            known = shared.value
            total, counts = 0, np.zeros(len(known), np.int64)
            for b in it:
                for lo in range(0, b.num_rows, 64):
                    h, _ = normal_words([t or "" for t in b.column(0).slice(lo, 64).to_pylist()])
                    total += len(h)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        counts += np.bincount(at[known[at] == h], minlength=len(known))
            seen = np.flatnonzero(counts)
            yield record_batch(_COUNTS, np.append(signed(known[seen]), 0), np.append(counts[seen], total))

        counts = rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
        total = max(1, next((r.n for r in counts if r.h == 0), 1))
        seeds = spark.sparkContext.broadcast((Seeds(items, {r.h: r.n / total for r in counts if r.h}, n), short))

        def match(it: Iterator[pa.RecordBatch], shared=seeds):
            seeds, short = shared.value
            sizes = np.unique(seeds.sizes).tolist()
            for b in it:
                found = []
                for lo in range(0, b.num_rows, 64):
                    ids = b.column(0).slice(lo, 64).to_pylist()
                    texts = [t or "" for t in b.column(1).slice(lo, 64).to_pylist()]
                    if short:
                        found += [(ids[d], *p) for d, t in enumerate(texts) for p in _lines_of(short, t, min_words)]
                    h, first = normal_words(texts)
                    hasher = Hasher(h)
                    where, rows = [], []
                    for size in sizes:
                        grams = hasher.windows(size)
                        w, r = seeds.hits(grams, size)
                        inside = np.searchsorted(first, w, "right") == np.searchsorted(first, w + size - 1, "right")
                        where.append(w[inside])
                        rows.append(r[inside])
                    if not sizes or not sum(map(len, where)):
                        continue
                    where, rows = np.concatenate(where), np.concatenate(rows)
                    doc = np.searchsorted(first, where, "right") - 1
                    for d in np.unique(doc):
                        mine = doc == d
                        a, z = first[d], first[d + 1]
                        found += [(ids[d], *p) for p in _passages(seeds, h[a:z], where[mine] - a, rows[mine], min_score)]
                if found:
                    yield record_batch(_OUT, *map(list, zip(*found)))

        part = rows.mapInArrow(match, "doc_id long, item_id long, score double, start_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out
