"""Exact top-k search by integer inner product over a bit-sliced index.

Vectors are dealt into blocks by a hash of their id. A block's index holds, for each attribute, slices: bitmaps of its
quantised components (the bits from SHIFT up, two's complement). For a query, the slices of each attribute, shifted by the
set bits of the query's component, are added with bitmap arithmetic: three bitmaps of one weight become a sum and a carry
until one bitmap of each weight is left. That is the score but for the low bits, which are bounded. The top rows are selected
from the most significant slice downwards; rows that the low bits could still lift to the k-th place are resolved by the
exact product. The blocks' best meet in one small list per query.

Components are floor(1024 * x). Vectors that are null, empty or hold null or non-finite components take no part, and only
vectors of one length are compared. Scores that could leave 64 bits are worked out in wider integers; a component or a result
that does not fit into 64 bits is an error. A query never finds its own row, but finds others that repeat its id or its vector; query
rows that repeat both count once. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record_batch, ship

K, SHIFT, BLOCK = 10, 4, 16384
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pack(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    raw = np.packbits(bits, bitorder="little")
    out[: len(raw)] = raw
    return out.view(np.uint64)


def _unpack(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), count=n, bitorder="little").view(bool)


class BitSliced:
    """Slices of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray, shift: int = SHIFT):
        self.n, self.dims = vectors.shape
        self.words = (self.n + 63) // 64
        self.shift = shift
        high = vectors >> shift
        # shifted to be non-negative; the offset adds the same to all rows of one query
        self.least = high.min(0)
        high = high - self.least
        self.slices = [[_pack((high[:, d] >> b) & 1, self.words) for b in range(int(high[:, d].max()).bit_length())] for d in range(self.dims)]
        self.exist = _pack(np.ones(self.n, np.uint8), self.words)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """(slices of a non-negative sum, offset, most that the low bits add above it) so that offset + 2**shift * sum is at most the score."""
        by_weight: list[list[np.ndarray]] = []
        offset = 0
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            width = len(self.slices[d])
            # a negative factor counts the complement: -x = ~x - (2**width - 1)
            if q < 0:
                offset += q * ((1 << width) - 1)
            offset += q * int(self.least[d])
            for b, s in enumerate(self.slices[d]):
                s = ~s if q < 0 else s
                for c in range(abs(q).bit_length()):
                    if abs(q) >> c & 1:
                        while len(by_weight) <= b + c:
                            by_weight.append([])
                        by_weight[b + c].append(s)
        low = (1 << self.shift) - 1
        lift, drop = low * sum(max(q, 0) for q in query.tolist()), low * sum(min(q, 0) for q in query.tolist())
        out, w = [], 0
        while w < len(by_weight):
            column = by_weight[w]
            k = 0
            while len(column) - k > 1:
                if w + 1 == len(by_weight):
                    by_weight.append([])
                if len(column) - k > 2:
                    a, b, c = column[k : k + 3]
                    k += 3
                    x = a ^ b
                    column.append(x ^ c)
                    by_weight[w + 1].append((a & b) | (x & c))
                else:
                    a, b = column[k : k + 2]
                    k += 2
                    column.append(a ^ b)
                    by_weight[w + 1].append(a & b)
            out.append(column[k] if len(column) > k else np.zeros(self.words, np.uint64))
            w += 1
        return out, (offset << self.shift) + drop, lift - drop

    def at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of rows whose sum is bound or more, from the most significant slice down."""
        if bound <= 0:
            return self.exist
        if bound >> len(slices):
            return np.zeros(self.words, np.uint64)
        above, equal = np.zeros(self.words, np.uint64), self.exist
        for w in range(len(slices) - 1, -1, -1):
            if bound >> w & 1:
                equal = equal & slices[w]
            else:
                above = above | (equal & slices[w])
                equal = equal & ~slices[w]
        return above | equal

    def kth(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, one bit at a time from the most significant slice down."""
        value, found, equal = 0, 0, self.exist
        for w in range(len(slices) - 1, -1, -1):
            have = equal & slices[w]
            n = int(np.bitwise_count(have).sum())
            if found + n >= k:
                equal = have
                value |= 1 << w
            else:
                found += n
                equal = equal & ~slices[w]
        return value

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows among which are the k best of the block."""
        if self.n <= k:
            return np.arange(self.n)
        slices, _, span = self.scores(query)
        bound = self.kth(slices, k) - -(-span >> self.shift) - 1
        return np.flatnonzero(_unpack(self.at_least(slices, bound), self.n))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors (vec_id, embedding) for each row of queries, a part of vectors."""
    spark = vectors.sparkSession
    ship(spark)

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col("embedding"), lambda x: F.when(F.abs(x.cast("double")) < F.lit(2.0**53), F.floor(x.cast("double") * 1024).cast("long")).otherwise(F.raise_error(F.lit("a component times 1024 does not fit into 64 bits"))))
        sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))
        return df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), v.alias("v"), F.xxhash64("embedding").alias("h"))

    rows, asked = whole(vectors), whole(queries).dropDuplicates(["vec_id", "h"])
    count = max(1, -(-rows.count() // block))
    index = rows.withColumn("b", F.pmod(F.xxhash64("vec_id", "h"), F.lit(count)).cast("int"))
    # each query visits each block once; a task streams the queries past its block
    visits = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select("dims", "b", "vec_id", "v", "h", F.lit(1).alias("q"))
    both = index.select("dims", "b", "vec_id", "v", "h", F.lit(0).alias("q")).unionByName(visits)
    sorted_rows = both.repartition("dims", "b").sortWithinPartitions("dims", "b", "q", "vec_id").select("dims", "b", "q", "vec_id", "v")

    def search(it: Iterator[pa.RecordBatch]):
        key, ids, parts, built, no = None, [], [], None, 0

        def matrix(lists, dims):
            return np.asarray(lists.flatten()).reshape(-1, dims)

        for batch in it:
            dims, b, q = (np.asarray(batch.column(c)) for c in range(3))
            cut = np.flatnonzero((np.diff(dims) != 0) | (np.diff(b) != 0) | (np.diff(q) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(b)]):
                if hi == lo:
                    continue
                part, at = batch.slice(lo, hi - lo), (int(dims[lo]), int(b[lo]))
                if q[lo] == 0:
                    if key != at or built is not None:
                        key, ids, parts, built = at, [], [], None
                    ids.append(np.asarray(part.column(3)))
                    parts.append(matrix(part.column(4), at[0]))
                    continue
                if key != at or not parts:
                    continue
                if built is None:
                    every, vec = np.concatenate(ids), np.concatenate(parts)
                    built = BitSliced(vec)
                    most = max(-int(vec.min()), int(vec.max()))
                out = ([], [], [])
                for query_id, query in zip(np.asarray(part.column(3)).tolist(), matrix(part.column(4), at[0])):
                    found = built.candidates(query, k + 1)
                    own = (every[found] == query_id) & (vec[found] == query).all(1)
                    if own.any():  # its own row, one of equals
                        found = np.delete(found, np.flatnonzero(own)[0])
                    if at[0] * most * max(-int(query.min()), int(query.max())) < 1 << 63:
                        score = vec[found] @ query
                        best = np.lexsort((every[found], -score))[:k]
                    else:
                        score = vec[found].astype(object) @ query.astype(object)
                        best = np.array(sorted(range(len(found)), key=lambda j: (-score[j], every[found[j]]))[:k], np.int64)
                        if any(not -(1 << 63) <= s < 1 << 63 for s in score[best]):
                            raise OverflowError("a score does not fit into 64 bits")
                        score = np.array([max(-(1 << 63), min(s, (1 << 63) - 1)) for s in score], np.int64)
                    for column, x in zip(out, (np.full(len(best), query_id), every[found][best], score[best])):
                        column.append(x)
                yield record_batch(_OUT, *map(np.concatenate, out))

    found = sorted_rows.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
