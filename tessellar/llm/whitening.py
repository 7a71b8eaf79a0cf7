"""Whitening of embeddings: MLlib's Gramian of exactly centred rows, its eigenvectors, and every row projected on them.

Components c become whole numbers x = floor(256 * c). The fit list holds each distinct x vector once: n of them, with sums S per
dimension. Rows are centred in whole numbers, n * x - S, and divided by n, each result the nearest double. RowMatrix sums their outer products
over the partitions; what comes to the driver is one dims x dims matrix, whatever the number of rows. Divided by n it is the
covariance. Its unit eigenvectors, by falling eigenvalue, each with its largest entry positive, and the sums go to all tasks.

Vectors that are null or hold null or non-finite entries are left out; a vector without entries has no component. Vectors of different
lengths are fitted apart, each length for itself. A direction without variance can't be whitened and gives no row, so that one distinct vector alone
gives none. Repeated rows each have their rows. An entry, or a deviation, that does not fit into 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship

SCALE, COMPONENTS = 256, 4
_OUT = "vec_id long, component int, n long, deviation long, whitened double"


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x of the vectors that take part."""
    fits = lambda c: F.abs(c.cast("double")) < F.lit(2.0**63 / scale)
    entry = lambda c: F.when(fits(c), F.floor(c.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit(f"an entry times {scale} does not fit into 64 bits")))
    sound = F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))
    return vectors.where(F.col("embedding").isNotNull() & sound & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", entry).alias("x"))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of an array column, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


class Fit:
    """n, sums per dimension, and the projection on the components, each over the root of its eigenvalue."""

    def __init__(self, fit_list: DataFrame, components: int):
        sums = fit_list.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
        self.n, self.sums = sums[0].n, [r.s for r in sums]
        centred = F.zip_with("x", F.array(*map(F.lit, self.sums)), lambda v, s: (v * F.lit(self.n) - s).cast("double") / F.lit(float(self.n)))
        covariance = gramian(fit_list.select(centred.alias("d")), "d") / self.n
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")
        total = float(np.trace(covariance))
        order = [k for k in order[:components] if values[k] > total * len(values) * np.finfo(float).eps]
        self.explained = [float(values[k]) / total for k in order]
        unit = vectors[:, order]
        signs = np.sign(unit[np.abs(unit).argmax(0), np.arange(len(order))])
        self.project = unit * signs / np.sqrt(values[order])


def _projected(rows: DataFrame, fit: Fit, digits: str = _OUT) -> DataFrame:
    """vec_id, component, n, deviation, whitened of rows (vec_id, x)."""
    known = rows.sparkSession.sparkContext.broadcast((fit.n, fit.sums, fit.project))

    def run(parts: Iterator):
        import pandas as pd

        n, sums, project = known.value
        count = project.shape[1]
        for pdf in parts:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
            most = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums))
            if most * most * x.shape[1] >= 1 << 63:
                d = x.astype(object) * n - np.array(sums, object)
                deviation = (d * d).sum(1)
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation does not fit into 64 bits")
                deviation = deviation.astype(np.int64)
            else:
                d = x * n - np.array(sums, np.int64)
                deviation = (d * d).sum(1)
            white = (d.astype(float) / n) @ project
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64").repeat(count), "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(pdf)), "n": np.int64(n), "deviation": deviation.repeat(count), "whitened": white.ravel()})

    return rows.select("vec_id", "x").mapInPandas(run, digits)


def _identity_error(fit_list: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, centred and divided by n."""
    count = fit.project.shape[1]
    known = fit_list.sparkSession.sparkContext.broadcast((fit.n, fit.sums, fit.project))

    def run(parts: Iterator):
        import pandas as pd

        n, sums, project = known.value
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"w": list((x * n - np.array(sums, np.int64)).astype(float) / n @ project)})

    w = [F.get("w", F.lit(k)) for k in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    row = fit_list.select("x").mapInPandas(run, "w array<double>").agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs))


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and each of its first components."""
    spark = vectors.sparkSession
    ship(spark)
    rows = whole(vectors, scale)
    distinct = materialize(rows.select("x").distinct())
    out = spark.createDataFrame([], _OUT + ", explained double, identity_error double")
    for dims in [r.d for r in distinct.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]:
        fit_list = distinct.where(F.size("x") == dims)
        fit = Fit(fit_list, components)
        if fit.explained:
            error = _identity_error(fit_list, fit)
            share = F.element_at(F.array(*map(F.lit, fit.explained)), F.col("component"))
            out = out.unionByName(_projected(rows.where(F.size("x") == dims), fit).withColumns({"explained": share, "identity_error": F.lit(error)}))
    release(distinct)
    return out
