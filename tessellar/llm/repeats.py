"""Strings of a fixed number of units that occur more than once in a corpus, without a row for each position.

Every window of `size` units is given an anchor that depends on the window's own content alone, so equal windows have
equal anchors at equal distances. Consecutive windows with one anchor form a block. Then
  1. anchor names are counted (pre-aggregated per batch and per task); a name that occurs once can't hold a repeat;
  2. the remaining blocks are pre-aggregated: of equal contents one goes on, with its number and its first occurrence;
  3. the contents of a name meet in one task, where `matcher` decides every window, by its own method, on the units themselves;
  4. the decisions go back to all blocks of a content, and the removed windows of a document meet its text once, in `finish`.
A name with more than SPLIT contents is split by what stands around its anchor, before any of them meet: a window that reaches far enough
beyond its anchor on the right goes by the anchor and half of what is lacking to a window on that side, any other by the anchor and half of it on the
left. Equal windows go the same way, so nothing is lost; and as every round halves what is lacking, the names of the last one are whole
windows, of one content each. So the matcher decides hot names, too, however many contents they have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, keyed, materialize, mix, record_batch, release, ship, signed, spans, utf8

#: Contents of one name that one task compares; a name with more is split, with the same result.
SPLIT = 4096
#: Bytes of contents that matcher takes at once, rounded up to whole names.
CHUNK = 1 << 16

_NAMES = pa.schema([("name", pa.int64()), ("n", pa.int64())])
_BLOCKS = pa.schema([("name", pa.int64()), ("ctx", pa.int64()), ("_k", pa.int64()), ("start", pa.int32()), ("nwin", pa.int32())])
_CONTENT = pa.schema([("name", pa.int64()), ("ctx", pa.int64()), ("nwin", pa.int32()), ("c", pa.int64()), ("_k", pa.int64()), ("start", pa.int32()), ("content", pa.binary())])
_CUTS = pa.schema([("name", pa.int64()), ("ctx", pa.int64()), ("nwin", pa.int32()), ("k1", pa.int64()), ("s1", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("rest", pa.list_(pa.bool_()))])
_SUB = pa.schema([*_BLOCKS, ("lo", pa.int32()), ("hi", pa.int32())])
_CLASS = "name long, ctx long, nwin int"


def runs_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def blocks_from_anchors(valid: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of consecutive valid windows with one anchor."""
    if not len(valid):
        return valid, valid
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    return valid[at], np.diff(np.append(at, len(valid)))


def removed_windows(docs: DataFrame, size: int, units: Callable, anchors: Callable, cut: Callable, matcher: Callable) -> tuple[DataFrame, DataFrame]:
    """(documents with _k, list of removed windows of each _k as runs).

    units(data, off) -> (values, document, first unit of each document); anchors(values, document, size) -> (first window, windows, name,
    first unit and end of the anchor) of each block;
    cut(data, off) -> content(document, first unit, number of units) in bytes; matcher(contents, numbers, place, size) -> (units of
    each content, windows to remove from every block, windows to remove from all blocks but a content's first), where place orders
    the contents by first occurrence.
    """
    ship(docs.sparkSession)
    base = keyed(docs)

    def names(it: Iterator[pa.RecordBatch]):
        for b in it:
            off, data = utf8(b.column(0))
            for i, j in spans(off):
                values, doc, _ = units(data[off[i] : off[j]], off[i : j + 1] - off[i])
                name = anchors(values, doc, size)[2]
                if len(name):
                    u, n = np.unique(name, return_counts=True)
                    yield record_batch(_NAMES, signed(u), n)

    def blocks(it: Iterator[pa.RecordBatch]):
        for b in it:
            off, data = utf8(b.column(1))
            key = np.asarray(b.column(0))
            for i, j in spans(off):
                values, doc, first = units(data[off[i] : off[j]], off[i : j + 1] - off[i])
                start, nwin, name, _, _ = anchors(values, doc, size)
                if len(name):
                    ctx = Hasher(values).spans(start, start + nwin + size - 1)
                    yield record_batch(_BLOCKS, signed(name), signed(ctx), key[i:j][doc[start]], (start - first[doc[start]]).astype(np.int32), nwin.astype(np.int32))

    long_enough = base.where(F.octet_length("text") >= size)
    # written first, so that Spark may split a name of very many blocks in the join
    many = materialize(long_enough.select("text").mapInArrow(names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"))
    found = long_enough.select("_k", "text").mapInArrow(blocks, "name long, ctx long, _k long, start int, nwin int")
    members = materialize(found.join(many, "name", "left_semi"))
    release(many)
    classes = materialize(members.groupBy("name", "ctx", "nwin").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_k", "start")).alias("m")))
    texts = base.select("_k", "doc_id", "text")

    def halves(it: Iterator[pa.RecordBatch]):
        """Blocks of documents by more of what stands around their anchors."""
        for b in it:
            off, data = utf8(b.column(1))
            key, lists = np.asarray(b.column(0)), b.column(2)
            for i, j in spans(off):
                values, doc, first = units(data[off[i] : off[j]], off[i : j + 1] - off[i])
                every = anchors(values, doc, size)
                hasher, out = Hasher(values), []
                for r in range(i, j):
                    name, start, nwin, lo, hi = (np.asarray(x).astype(np.int64) for x in lists[r].values.flatten())
                    f = int(first[r - i])
                    start = start + f
                    at = np.minimum(np.searchsorted(every[0], start), len(every[0]) - 1)
                    lo, hi = np.where(lo < 0, every[3][at], lo + f), np.where(lo < 0, every[4][at], hi + f)
                    half = (size - (hi - lo) + 1) // 2
                    edge = np.clip(hi + half - size, start, start + nwin)  # from here on windows reach far enough to the right
                    for side, s, e, a, z in ((0, start, edge, hi - size + half - 1, hi), (1, edge, start + nwin, lo, hi + half)):
                        some = np.flatnonzero(e > s)
                        if len(some):
                            s, e, a, z = s[some], e[some], a[some], z[some]
                            longer = mix(hasher.spans(a, z) ^ mix(name[some].view(U64) + U64(side)))
                            out.append((signed(longer), signed(hasher.spans(s, e + size - 1)), np.full(len(s), key[r]), s - f, e - s, a - f, z - f))
                if out:
                    yield record_batch(_SUB, *(np.concatenate(c).astype(t.to_pandas_dtype()) for c, t in zip(zip(*out), _SUB.types)))

    def named(of: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(contents of blocks, names with more of them than a task takes)"""
        counted = materialize(of.groupBy("name", "ctx", "nwin").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_k", "start")).alias("m")))
        return counted, materialize(counted.groupBy("name").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > SPLIT).select("name"))

    classes, hot = named(members)
    parts = []
    open_ = members.withColumns({c: F.lit(-1) for c in ("lo", "hi")})
    while not hot.isEmpty():
        parts.append((open_.join(hot, "name", "left_anti"), classes.join(hot, "name", "left_anti")))
        lists = open_.join(hot, "name", "left_semi").groupBy("_k").agg(F.collect_list(F.struct("name", "start", "nwin", "lo", "hi")).alias("blocks"))
        split = materialize(texts.join(lists.hint("shuffle_hash"), "_k").select("_k", "text", "blocks").mapInArrow(halves, "name long, ctx long, _k long, start int, nwin int, lo int, hi int"))
        again = materialize(split.groupBy("name").count().where("count > 1").select("name"))
        open_ = materialize(split.join(again, "name", "left_semi"))
        release(split, again)
        classes, hot = named(open_)
    members = open_.select("name", "ctx", "_k", "start", "nwin")
    for blocks_of, classes_of in parts:  # what wasn't hot in its round; read once, so not written again
        members, classes = members.unionByName(blocks_of.select(members.columns)), classes.unionByName(classes_of)

    def wanted(of: DataFrame) -> DataFrame:
        """The texts that hold the first occurrence of contents, with the list of these."""
        lists = of.groupBy(F.col("m._k").alias("_k")).agg(F.collect_list(F.struct("name", "ctx", "nwin", "c", F.col("m.start").alias("start"))).alias("reps"))
        return texts.join(lists.hint("shuffle_hash"), "_k")

    def each(it: Iterator[pa.RecordBatch]):
        """(batch of documents: units, their content, key, first unit, name, ctx, windows, number, start of each content)."""
        for b in it:
            off, data = utf8(b.column(2))
            key, lists = b.column(0).to_pylist(), b.column(3)
            for i, j in spans(off):
                own, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                values, _, first = units(own, o)
                content = cut(own, o)
                for r in range(i, j):
                    flat = lists[r].values.flatten()
                    for row in zip(*(x.to_pylist() for x in flat)):
                        yield values, content, key[r], r - i, int(first[r - i]), row
                yield None

    def contents(it: Iterator[pa.RecordBatch]):
        out = []
        for x in each(it):
            if x is not None:
                _, content, k, d, f, (name, ctx, nwin, c, s) = x
                out.append((name, ctx, nwin, c, k, s, content(d, f + s, nwin + size - 1)))
            elif out:
                yield record_batch(_CONTENT, *map(list, zip(*out)))
                out = []

    def compare(it: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        total = 0

        def flush(rows):
            keys, starts = np.array([x[4] for x in rows], np.int64), np.array([x[5] for x in rows], np.int64)
            place = np.empty(len(rows), np.int64)
            place[np.lexsort((starts, keys))] = np.arange(len(rows))
            lens, every, rest = matcher([x[6] for x in rows], np.array([x[3] for x in rows], np.int64), place, size)
            off = np.concatenate([[0], np.cumsum(lens)])
            out = []
            for row, a, z in zip(rows, off[:-1], off[1:]):
                runs = [(s, e - s, False) for s, e in zip(*(x.tolist() for x in runs_of(every[a:z])))] + [(s, e - s, True) for s, e in zip(*(x.tolist() for x in runs_of(rest[a:z])))]
                if runs:
                    out.append((row[0], row[1], row[2], row[4], row[5], *map(list, zip(*runs))))
            return record_batch(_CUTS, *map(list, zip(*out))) if out else None

        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if total >= CHUNK and held[-1][0] != row[0]:
                    if (out := flush(held)) is not None:
                        yield out
                    held, total = [], 0
                held.append(row)
                total += len(row[6])
        if held and (out := flush(held)) is not None:
            yield out

    content = wanted(classes).mapInArrow(contents, _CLASS + ", c long, _k long, start int, content binary")
    cuts = content.repartition("name").sortWithinPartitions("name").mapInArrow(compare, _CLASS + ", k1 long, s1 int, at array<int>, n array<int>, rest array<boolean>")
    cuts = cuts.select("name", "ctx", "nwin", "k1", "s1", F.arrays_zip("at", "n", "rest").alias("runs"))
    first = (F.col("_k") == F.col("k1")) & (F.col("start") == F.col("s1"))
    runs = F.transform(F.filter("runs", lambda r: ~(r.rest & first)), lambda r: F.struct((F.col("start") + r.at).alias("start"), r.n.alias("nwin")))
    removed = members.join(materialize(cuts), ["name", "ctx", "nwin"]).select("_k", runs.alias("runs"))
    return texts, removed.groupBy("_k").agg(F.flatten(F.collect_list("runs")).alias("removed"))


def finished(texts: DataFrame, removed: DataFrame, finish: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """finish(text bytes, starts, numbers of windows) -> tuple after doc_id, for every document."""

    def run(it: Iterator[pa.RecordBatch]):
        none = np.zeros(0, np.int64)
        for b in it:
            ids, text, lists = b.column(1), b.column(2).cast(pa.large_binary()), b.column(3)
            for lo in range(0, len(ids), 256):
                rows = []
                for r in range(lo, min(lo + 256, len(ids))):
                    t = text[r].as_py() or b""
                    s, n = (np.asarray(x).astype(np.int64) for x in lists[r].values.flatten()) if lists[r].is_valid else (none, none)
                    rows.append((ids[r].as_py(), *finish(t, s, n)))
                yield record_batch(arrow, *map(list, zip(*rows)))

    return texts.join(removed.hint("shuffle_hash"), "_k", "left").mapInArrow(run, schema)


def cover(n: int, start: np.ndarray, nwin: np.ndarray, size: int) -> np.ndarray:
    """Which of n units any removed window covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + nwin + size - 1, -1)
    return np.cumsum(d[:-1]) > 0
