"""Exact distances to a region's edge."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessellar.operators import regions as R


def test_distance_equals_all_pairs(spark):
    """Random regions of several images, with gaps in them, against every pixel and place outside."""
    rnd = random.Random(4)
    cells, want = [], {}
    for k in range(40):
        w, h, run = rnd.randint(1, 14), rnd.randint(1, 14), rnd.choice([1, 2, 3, 6, 20])
        at = {(x, y): (x // run * 7 + y // run * 3 + rnd.randrange(2) * (rnd.random() < 0.1)) % 3 for x in range(w) for y in range(h) if rnd.random() > 0.02}
        cells += [(f"i{k}", x, y, v) for (x, y), v in at.items()]
        out = {(x, y): at.get((x, y)) for x in range(-1, w + 1) for y in range(-1, h + 1)}
        want |= {(f"i{k}", *p): min((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for q, u in out.items() if u != v) for p, v in at.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # columns go on from one batch to the next
    try:
        got = {(r.image_id, r.x, r.y): r.d2 for r in R.edge_distance(spark.createDataFrame(cells, "image_id string, x int, y int, region_id long").repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_distance_of_one_large_region(spark):
    """1200 x 1200 pixels of one region: as many rows as pixels, and the pyramid of distances."""
    n = 1200
    px = spark.range(n * n).select(F.lit("i").alias("image_id"), (F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y"), F.lit(0).cast("long").alias("region_id"))
    far = F.least(F.col("x") + 1, F.col("y") + 1, n - F.col("x"), n - F.col("y"))
    r = R.edge_distance(px).agg(F.count(F.lit(1)), F.count_if(F.col("d2") != far * far)).first()
    assert tuple(r) == (n * n, 0)


def test_lowest_parabolas():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 8, 100):
        y, g2 = np.arange(5, 5 + n), rng.integers(1, 50, n) ** 2
        at, value = np.concatenate([[4], y, [5 + n]]), np.concatenate([[0], g2, [0]])
        assert R._lowest_parabolas(y, g2, np.array([0])).tolist() == ((y[:, None] - at) ** 2 + value).min(1).tolist()
