"""Clusters of several images at once against one image at a time and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.functions import colour as C
from tessellar.operators import clusters as U

RASTER = "image_id string, x int, y int, pid long, r int, g int, b int"


def painted(image, w, h, colours, seed, spread=6):
    rnd = random.Random(seed)
    jitter = lambda c: min(255, max(0, c + rnd.randint(-spread, spread)))
    return [(image, x, y, y * w + x, *[jitter(c) for c in colours[(x * len(colours)) // w]]) for y in range(h) for x in range(w)]


A = painted("a", 40, 30, [(250, 20, 20), (20, 240, 30), (30, 30, 230)], 1)
B_ = painted("b", 50, 20, [(10, 10, 10), (240, 240, 240)], 2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sample_without_repeats(spark):
    px = spark.range(30_000).select(F.when(F.col("id") < 29_000, "big").otherwise("small").alias("image_id"), F.col("id").alias("pid"))
    got = {r.image_id: r for r in U.sampled(px, 12_000, 3).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("pids"), F.countDistinct("draw").alias("draws"), F.max("draw").alias("last")).collect()}
    assert tuple(got["big"])[1:] == (12_000, 12_000, 12_000, 12_000) and tuple(got["small"])[1:] == (1000, 1000, 1000, 1000)
    alone = rows(U.sampled(px.where("image_id = 'small'"), 100, 3))
    assert rows(U.sampled(px.repartition(7), 100, 3).where("image_id = 'small'")) == alone


@pytest.mark.parametrize("work", [lambda d: U.kmeans_labels(d, 4), lambda d: U.detect_colours(d, 8), lambda d: U.clustered_raster(d, 3, 5)])
def test_two_images_as_each_alone(spark, work):
    both = work(spark.createDataFrame(A + B_, RASTER).repartition(5))
    for image, part in (("a", A), ("b", B_)):
        assert rows(both.where(F.col("image_id") == image)) == rows(work(spark.createDataFrame(part, RASTER)))


def test_colours_are_found(spark):
    found = {r.image_id: r for r in U.detect_colours(spark.createDataFrame(A + B_, RASTER), 8).collect()}
    assert found["a"].detected == 3 and found["b"].detected == 2
    assert sum(c.sample_pixels for c in found["a"].clusters) == 1200 and found["a"].exploratory_k == 16
    assert sorted(c.sample_pixels for c in found["b"].clusters) == [500, 500]
    label = {r.pid: r.label for r in U.kmeans_labels(spark.createDataFrame(A, RASTER), 3).collect()}
    assert len({label[r[3]] for r in A}) == 3 and all(label[y * 40 + x] == label[x] for y in range(30) for x in range(40))


def test_early_exits(spark):
    """Two pixels, or a hint of one: nothing is clustered."""
    two = spark.createDataFrame([("i", 0, 0, 0, 1, 1, 1), ("i", 1, 0, 1, 250, 250, 250)], RASTER)
    assert [(r.detected, r.exploratory_k, r.clusters) for r in U.detect_colours(two, 8).collect()] == [(2, 2, [])]
    assert [(r.detected, r.clusters) for r in U.detect_colours(spark.createDataFrame(A, RASTER), 1).collect()] == [(1, [])]
    one = U.kmeans_labels(two.where("x = 0"), 5).collect()
    assert [r.label for r in one] == [0]


def test_first_seen_is_a_pixel(spark):
    px = spark.createDataFrame(B_, RASTER).withColumn("v", U._lab8())
    got = U.minibatch_clusters(U.sampled(px, 5000).withColumn("k", F.lit(2)), "k").collect()
    assert sorted(r.first_seen for r in got) == [0, 25] and sum(r.n for r in got) == 1000


def test_lloyd_equals_plain(spark):
    """Weighted Lloyd of two images, drawn and stopped as one at a time; the mean of a cluster to six places."""
    rng = np.random.default_rng(9)
    images = {"a": (rng.random((60, 3)) * 100, rng.random(60)), "b": (rng.random((7, 3)) * 100, np.ones(7))}
    table = spark.createDataFrame([(k, i + 1, v.tolist(), float(w)) for k, (vs, ws) in images.items() for i, (v, w) in enumerate(zip(vs, ws))], "image_id string, i long, v array<double>, weight double")
    got = {(r.image_id, r.k): r.c for r in U.grouped_lloyd(table, 5, 3, 2.0).collect()}
    draws = [math.sin(3 + j) * 10_000 - math.floor(math.sin(3 + j) * 10_000) for j in range(5)]
    for image, (v, w) in images.items():
        centres = np.array([v[int(len(v) * u)] for u in draws])
        while True:
            of = np.sqrt(((v[:, None] - centres) ** 2).sum(2)).argmin(1)
            new = np.array([np.round((v[of == k] * w[of == k, None]).sum(0) / w[of == k].sum(), 6) if (of == k).any() else centres[k] for k in range(5)])
            moved = np.sqrt(((new - centres) ** 2).sum(1)).sum()
            centres = new
            if moved <= 2.0:
                break
        assert np.allclose([got[image, k] for k in range(5)], centres, atol=2e-6)


def test_a_lloyd_step_writes_one_table(spark, monkeypatch):
    """Two groups far apart, both drawn points in the lower one: steps until nothing moves, each with one write, and the two means at the end."""
    values = [0.0, 1.0, 2.0, 90.0, 91.0, 92.0, 93.0]
    table = spark.createDataFrame([("a", i + 1, [v], 1.0) for i, v in enumerate(values)], "image_id string, i long, v array<double>, weight double")
    draws = [math.sin(s) * 10_000 - math.floor(math.sin(s) * 10_000) for s in range(200)]
    seed = next(s for s in range(199) if sorted(int(7 * u) for u in draws[s : s + 2]) == [0, 1])
    centres, steps, moved = [values[int(7 * u)] for u in draws[seed : seed + 2]], 0, 1.0
    while moved > 0:
        of = [min((0, 1), key=lambda k: (abs(v - centres[k]), k)) for v in values]
        new = [round(sum(v for v, j in zip(values, of) if j == k) / of.count(k), 6) for k in (0, 1)]
        moved, centres, steps = sum(abs(a - b) for a, b in zip(new, centres)), new, steps + 1
    written = []
    monkeypatch.setattr(U, "materialize", lambda df, real=U.materialize: written.append(1) or real(df))
    assert [r.c for r in U.grouped_lloyd(table, 2, seed, 0.0).orderBy("k").collect()] == [[c] for c in centres]
    assert sorted(centres) == [1.0, 91.5] and len(written) == 1 + steps


def test_allowed_colours_and_names(spark):
    px = spark.createDataFrame(A, RASTER)
    out = U.clustered_raster(px, 3, 5, 1.0, "hsl", ["red", (0, 255, 0), (0, 0, 255)], {"red": (255, 0, 0)})
    assert {tuple(r) for r in out.select("r", "g", "b").distinct().collect()} <= {(255, 0, 0), (0, 255, 0), (0, 0, 255)} and out.count() == len(A)
    with pytest.raises(ValueError):
        U.colour_points(px, "cmyk")


def test_points_of_a_raster(spark):
    p = U.colour_points(spark.createDataFrame([("i", 0, 0, 0, 9, 9, 9), ("i", 1, 0, 1, 200, 0, 0), ("i", 2, 0, 2, 10, 11, 8)], RASTER)).orderBy("i").collect()
    assert [(r.i, r.v, round(r.weight, 6)) for r in p] == [(1, [8.0, 8.0, 8.0], 0.666667), (2, [200.0, 0.0, 0.0], 0.333333)]
    assert C.coarse(F.lit(7)) is not None
