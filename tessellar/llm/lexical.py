"""Ranked lexical search with a hierarchical max tree over document ranges per term, searched best first.

Items are asked in blocks of a bounded number of terms; a block's terms and weights are all that a task is given whole. Documents are read
twice: once for the counts of all of them, once, from the postings of the block's terms that the first reading has written, for the
search. A task cuts its documents into ranges in ascending order. In a range each term has a tree: its leaves are the documents that hold
it, with what each occurrence's weight is multiplied by, and each node above has the largest value below it, FANOUT nodes to one. An item's bound at a node is the
sum over its terms of weight times the node's value; on a leaf that is the score. The search opens the nodes of the highest bounds first, several in one
step, and stops when no bound reaches the item's k-th best score so far. Nodes whose bound equals it are opened: a document
of equal score and smaller doc_id may lie there. The k-th best score stays with the task from one range to the next. Each task gives its best k of each
item; the best of those are the answer, so the rows that meet grow with the tasks and not with the documents.

Terms are maximal runs of digits, letters and all characters beyond ASCII; only A-Z are lower-cased. A null text has none, and an item
without terms, or of which no document holds any, has no rows. Documents or items that repeat an id, or have none, count each by itself; documents without doc_id come first
in ties. Scores are 64-bit integers; one that doesn't fit is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialize, release, ship

#: Results per item; documents and postings after which a range ends; children of a node; nodes opened in one step; terms of a block of items.
K, RANGE, POSTINGS, FANOUT, STEP, BLOCK_TERMS = 20, 16384, 2_000_000, 8, 64, 500_000
#: Terms in UTF-8: what is no other ASCII byte. Bytes lower-case A-Z alone.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    return _TERM.findall(text.encode().lower()) if text else []


class MaxTree:
    """Trees of all terms over one range of documents: for each level sorted (term, node) pairs and their largest values."""

    def __init__(self, term: np.ndarray, at: np.ndarray, value: np.ndarray, size: int):
        """term, place of the document in the range, value: one of each posting."""
        order = np.lexsort((at, term))
        term, at, value = term[order], at[order], value[order]
        self.levels = []
        while True:
            self.levels.append((term * size + at, value, size))
            if size == 1:
                break
            at, size = at // FANOUT, -(-size // FANOUT)
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (at[1:] != at[:-1])])) if len(at) else np.zeros(0, np.int64)
            value = np.maximum.reduceat(value, first) if len(first) else value
            term, at = term[first], at[first]

    def below(self, level: int, nodes: np.ndarray, asked: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children with any of the asked terms, sums of weight times their values) of nodes of a level; above the top, with level the height, its root."""
        keys, values, size = self.levels[level - 1]
        low = asked[:, None] * size + np.minimum(nodes * FANOUT, size)
        high = asked[:, None] * size + np.minimum((nodes + 1) * FANOUT, size)
        start, end = np.searchsorted(keys, low.ravel()), np.searchsorted(keys, high.ravel())
        n = end - start
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(n)
        found = np.arange(total) + np.repeat(start - ends + n, n)
        which = np.repeat(np.arange(len(n)) // len(nodes), n)
        child, by = np.unique(keys[found] - asked[which] * size, return_inverse=True)
        sums = np.zeros(len(child), np.int64)
        np.add.at(sums, by, weight[which] * values[found])
        return child, sums

    def search(self, asked: np.ndarray, weight: np.ndarray, k: int, scores: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, documents) of those given and of this range's, whose documents are ids."""
        height = len(self.levels)
        # the node above the top is no real one: its only child is the root
        level, node, bound = np.array([height]), np.array([0]), np.array([np.iinfo(np.int64).max])
        while len(node):
            least = int(scores[-1]) if len(scores) == k else 1
            open_ = bound >= least
            level, node, bound = level[open_], node[open_], bound[open_]
            if not len(node):
                break
            top = np.argpartition(-bound, STEP - 1)[:STEP] if len(bound) > STEP else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[top] = False
            more = [(level[rest], node[rest], bound[rest])]
            for at in np.unique(level[top]):
                child, sums = self.below(int(at), node[top][level[top] == at], asked, weight)
                if at > 1:
                    more.append((np.full(len(child), at - 1), child, sums))
                    continue
                hold = sums >= least
                scores, docs = np.concatenate([scores, sums[hold]]), np.concatenate([docs, ids[child[hold]]])
                best = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[best], docs[best]
            level, node, bound = (np.concatenate(c) for c in zip(*more))
        return scores, docs


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """_k, doc_id, n (terms with repeats), term and tf (of the vocabulary's terms) of each document (_k, doc_id, text) with any term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        number = known.value
        for batch in batches:
            ns, lists, tfs = [], [], []
            for text in batch.column(2):
                found = terms(text.as_py())
                held = [(number[t], c) for t, c in Counter(found).items() if t in number]
                ns.append(len(found))
                lists.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["_k", "doc_id", "n", "term", "tf"])
            yield out.filter(pa.array([n > 0 for n in ns], pa.bool_()))

    return docs.select("_k", "doc_id", "text").mapInArrow(run, "_k long, doc_id long, n long, term array<int>, tf array<int>")


def _best(found: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], k: int, size: int) -> DataFrame:
    """item (its place), score, _k: for each partition of found (_k, term, value) the best k of each item."""
    asked = found.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]):
        items = asked.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        held, rows, many = [], 0, 0

        def searched():
            ids, n, term, value = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            tree = MaxTree(term.astype(np.int64), np.repeat(place, n), value, len(ids))
            for i, (t, w) in enumerate(items):
                best[i] = tree.search(t, w, k, *best[i], ids[order])

        for batch in batches:
            for part in (batch.slice(a, size) for a in range(0, batch.num_rows, size)):
                term, value = part.column(1), part.column(2)
                lengths = np.diff(np.asarray(term.offsets))
                held.append((np.asarray(part.column(0)), lengths, np.asarray(term.flatten()), np.asarray(value.flatten())))
                rows += part.num_rows
                many += len(held[-1][2])
                if rows >= size or many >= POSTINGS:
                    searched()
                    held, rows, many = [], 0, 0
        if held:
            searched()
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in zip(*best))], names=["item", "score", "_k"])

    return found.select("_k", "term", "value").mapInArrow(run, "item int, score long, _k long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, size: int = RANGE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) of the highest scores above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs)
    asked = keyed(items.select(F.col("item_id").alias("doc_id"), "text")).select(F.col("_k").alias("key"), F.col("doc_id").alias("item_id"), "text")
    # no item has more terms than half its bytes and one
    most = asked.agg(F.sum(F.expr("octet_length(coalesce(text, '')) div 2 + 1"))).first()[0] or 0
    blocks = max(1, -(-most // block_terms))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        texts = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key").collect()
        counts = [Counter(terms(r.text)) for r in texts]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))} if counts else {}
        if vocabulary:
            held = materialize(postings(rows, vocabulary))
            out = out.unionByName(_ranked(held, texts, counts, vocabulary, k, size))
            release(held)
    return out


def _ranked(held: DataFrame, texts: list, counts: list[Counter], vocabulary: dict[bytes, int], k: int, size: int) -> DataFrame:
    spark = held.sparkSession
    documents, all_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = dict(held.select(F.explode("term").alias("t")).groupBy("t").count().collect())  # as many rows as the block has terms at most
    weight = {i: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for i, n in df.items()}
    queries = []
    for c in counts:
        known = sorted((vocabulary[t], n) for t, n in c.items() if vocabulary[t] in df)
        queries.append((np.array([t for t, _ in known], np.int64), np.array([n * weight[t] for t, n in known], np.int64)))
    m = F.expr(f"75 + (25L * n * {documents}L) div {all_terms}L")
    value = F.expr("transform(tf, c -> (1000000000L * c) div (1000L * c + 12L * m))")
    best = _best(held.where(F.size("term") > 0).withColumn("m", m).select("_k", "term", value.alias("value")), queries, k, size)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "_k")
    top = materialize(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(texts)], "item int, item_id long")
    named = materialize(top.join(held.select("_k", "doc_id"), "_k").join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    release(top)
    return named
