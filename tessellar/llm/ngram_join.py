"""Join of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, by MinHash banding.

  1. A document's set gets a 128-bit digest and band hashes; documents of one set form a class, and one stands for it.
  2. Classes are shuffled on band hashes. A bucket links its members to its first member only; the components of these
     links hold every pair that shares a bucket.
  3. The full sets of each component are compared. A component of more than BLOCK classes is dealt into blocks that meet
     two by two, so no task holds an unbounded group; a task gives one row per class and block, never one per pair.
Links are counted for all documents, copies included; components of verified links are the classes of the result.

Null and empty texts have no n-grams and no links. A text of fewer than n words has one n-gram, all its words. Repeated
rows are separate documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, keyed, materialize, mix, record_batch, ship, signed, spans, utf8, words

N, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Hash functions at most; the bands get as many rows as fit.
HASHES = 128
BLOCK = 1024

_SIGNED = pa.schema([("_k", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("comp", pa.int64()), ("parts", pa.int32()), ("part", pa.int32()), ("rep", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])
_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): most rows so that a pair at the threshold shares a band with probability recall, within so many hashes."""
    best = None
    for rows in range(1, 17):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= hashes:
            best = max(bands, 1), rows
    if best is None:
        raise ValueError("this recall needs more hashes")
    return best


def gram_sets(data: np.ndarray, off: np.ndarray, n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document."""
    h, doc, _, _ = words(data, off)
    first = np.searchsorted(doc, np.arange(len(off)))
    hasher = Hasher(h)
    grams = hasher.windows(n)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        elif z > a:
            out.append(hasher.spans(np.array([a]), np.array([z])) ^ U64(z - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each component of edges (a, b), by alternating large and small stars. Written to the shared folder each round."""
    links = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v != m").distinct()
    links = materialize(links)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("to")).select("v", F.least("v", "to").alias("to"))
        large = both.where("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("to").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("to"))
        small = large.where("v != m").join(low, "v").select(F.col("m").alias("v"), F.col("to").alias("m")).where("v != m").unionByName(low.select("v", F.col("to").alias("m")).where("v != m")).distinct()
        links = materialize(small)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    label = links.groupBy("v").agg(F.min("m").alias("label"))
    return label.unionByName(label.select(F.col("label").alias("v"), "label").distinct())


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, base: DataFrame | None = None) -> DataFrame:
    """doc_id, class_id (the key of the first document of its class: its doc_id where that is unique), n_links, n_copies, _k."""
    ship(docs.sparkSession)
    n_bands, n_rows = bands_for(threshold, recall)
    base = keyed(docs) if base is None else base

    def sign(it: Iterator[pa.RecordBatch]):
        seeds = mix(np.arange(1, n_bands * n_rows + 1, dtype=U64) * U64(0x632BE59BD9B4E019))
        for b in it:
            off, data = utf8(b.column(2))
            for i, j in spans(off):
                sets = gram_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                rows = [r for r, s in enumerate(sets) if len(s)]
                if not rows:
                    continue
                sizes = np.array([len(sets[r]) for r in rows])
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                grams = np.concatenate([sets[r] for r in rows])
                bands = np.zeros((n_bands, len(rows)), U64)
                for k, seed in enumerate(seeds):
                    x = (grams ^ seed) * U64(0x9FB21C651E98DF25)
                    x ^= x >> U64(32)
                    band = k // n_rows
                    bands[band] = mix(bands[band] * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(x, first) + U64(band + 1))
                a = np.add.reduceat(mix(grams), first)
                c = np.add.reduceat(mix(grams ^ U64(0x5555555555555555)), first) ^ sizes.astype(U64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * n_bands + 1, n_bands, dtype=np.int32)), pa.array(signed(np.ascontiguousarray(bands.T).reshape(-1))))
                at = np.array(rows) + i
                yield record_batch(_SIGNED, b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), signed(a), signed(c), lists)

    signs = materialize(base.select("_k", "doc_id", "text").mapInArrow(sign, "_k long, doc_id long, a long, b long, bands array<long>"))
    classes = materialize(signs.groupBy("a", "b").agg(F.min("_k").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")))
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    roots = buckets.groupBy("band").agg(F.min("rep").alias("root"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "root")
    near = materialize(connected(buckets.join(roots, "band").where("rep != root").select(F.col("root").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("v", "rep").withColumnRenamed("label", "comp"))
    sizes = near.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    members = near.join(sizes, "comp").join(classes.select("rep", "n"), "rep").select(F.col("rep").alias("_k"), "comp", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "n")

    def full(it: Iterator[pa.RecordBatch]):
        for b in it:
            off, data = utf8(b.column(1))
            for i, j in spans(off, 1 << 20):
                sets = gram_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                m = j - i
                yield record_batch(_SETS, b.column(2).slice(i, m), b.column(3).slice(i, m), b.column(4).slice(i, m), b.column(0).slice(i, m), b.column(5).slice(i, m), [s.tobytes() for s in sets])

    def compare(it: Iterator[pa.RecordBatch]):
        held, key = [], None

        def flush(rows, key):
            _, x, y = key
            k = len(rows)
            part = np.array([r[0] for r in rows])
            rep = np.array([r[1] for r in rows], np.int64)
            copies = np.array([r[2] for r in rows], np.int64)
            sets = [np.frombuffer(r[3], U64) for r in rows]
            size = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            _, gram = np.unique(every, return_inverse=True)
            owner = np.repeat(np.arange(k), size)
            order = np.argsort(gram, kind="stable")
            start = np.searchsorted(gram[order], np.arange(int(gram.max()) + 2))
            holder = owner[order]
            first = np.concatenate([[0], np.cumsum(size)])
            links = np.zeros(k, np.int64)
            above = list(range(k))

            def top(v):
                while above[v] != v:
                    above[v] = above[above[v]]
                    v = above[v]
                return v

            for i in range(k):
                own = gram[first[i] : first[i + 1]]
                a, z = start[own], start[own + 1]
                count = z - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                shared = np.bincount(holder[at], minlength=k)
                hit = shared >= threshold * (size + size[i] - shared) - 1e-9
                hit[i] = False
                if x != y:
                    hit &= part != part[i]
                near = np.flatnonzero(hit)
                links[i] = copies[near].sum()
                t = top(i)
                for v in near[near > i].tolist():
                    u = top(v)
                    if u != t:
                        above[max(u, t)] = min(u, t)
                        t = min(u, t)
            least: dict[int, int] = {}
            for v in range(k):
                least[top(v)] = min(int(rep[v]), least.get(top(v), 1 << 62))
            return record_batch(_LINKS, rep, links, np.array([least[top(v)] for v in range(k)], np.int64))

        for b in it:
            for comp, x, y, *row in zip(*(c.to_pylist() for c in b.columns)):
                if key != (comp, x, y):
                    if held:
                        yield flush(held, key)
                    held, key = [], (comp, x, y)
                held.append(row)
        if held:
            yield flush(held, key)

    sets = base.select("_k", "text").join(members.hint("shuffle_hash"), "_k").mapInArrow(full, "comp long, parts int, part int, rep long, n long, grams binary")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("x"), F.greatest("part", o).alias("y"))))
    pairs = sets.withColumn("at", meet).select("comp", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "part", "rep", "n", "grams")
    found = materialize(pairs.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "rep").mapInArrow(compare, "rep long, links long, root long"))
    label = connected(found.where("rep != root").select(F.col("root").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("v", "rep")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.select("a", "b", "rep", "n").join(linked, "rep", "left").join(label, "rep", "left")
    with_class = signs.select("_k", "a", "b").join(by_class, ["a", "b"]).select("_k", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    keys = base.select("_k", "doc_id")
    return keys.join(with_class, "_k", "left").select("doc_id", F.coalesce("class_id", "_k").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(0).cast("long")).alias("n_copies"), "_k")


def ngram_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that come first in their class; rows without n-grams all stay."""
    columns = tuple(docs.columns)
    base = keyed(docs, rest=columns)
    first = ngram_join(docs, base=base.select("_k", "doc_id", "text"), **options).where("_k = class_id").select("_k")
    return base.select("_k", "_rest").join(first, "_k", "left_semi").select("_rest.*")
