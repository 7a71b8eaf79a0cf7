"""Border tracing and the cleanup in place against plain versions that take one step after another."""

import random

from pyspark.sql import functions as F

from tessellar.operators import borders as B
from tessellar.operators import cleanup as K
from tessellar.operators import regions as R


def walk(facet: int, pixels: dict[tuple[int, int], list[int]]) -> list[tuple[int, int, int]]:
    """(x, y, side) of the outer walls in order, from the left of the first pixel in raster order.

    From a wall on side n of pixel p the next one is, for either direction t along it, in this order: side t of p itself;
    side n of p + t; side -t of p + t + n, round the corner. A wall is used once.
    """
    start = min(pixels, key=lambda p: (p[1], p[0]))
    step = {s: k for k, s in enumerate([*B.SIDES, (-1, -1), (1, -1), (-1, 1), (1, 1)])}

    def own(p, d):
        return pixels[p][step[d]] == facet

    def wall(p, n):
        return p[0] + (n[0] > 0), p[1] + (n[1] > 0), n[0] != 0

    at, n = start, B.SIDES[0]
    path, used = [], set()
    while True:
        path.append((*at, B.SIDES.index(n)))
        used.add(wall(at, n))
        found = None
        along = ((0, -1), (0, 1)) if n[0] else ((-1, 0), (1, 0))
        for t in along:
            if found is None and not own(at, t) and wall(at, t) not in used:
                found = at, t
        for t in along:
            q = at[0] + t[0], at[1] + t[1]
            if found is None and q in pixels and own(at, t) and not own(at, (t[0] + n[0], t[1] + n[1])) and wall(q, n) not in used:
                found = q, n
        for t in along:
            c = t[0] + n[0], t[1] + n[1]
            q, back = (at[0] + c[0], at[1] + c[1]), (-t[0], -t[1])
            if found is None and q in pixels and own(at, c) and wall(q, back) not in used and wall(at, t) not in used:
                found = q, back
        if found is None:
            return path
        at, n = found


def random_raster(rnd, most):
    w, h, labels, run = rnd.randint(1, most), rnd.randint(1, most), rnd.randint(1, 3), rnd.choice([1, 1, 2, 3])
    rows = [[rnd.randrange(labels) for _ in range(w)] for _ in range(h)]
    return [[rows[y // run][x // run] for x in range(w)] for y in range(h)]


def table(spark, images):
    cells = [(k, x, y, y * len(r) + x, v) for k, rows in images.items() for y, r in enumerate(rows) for x, v in enumerate(r)]
    return spark.createDataFrame(cells, "image_id string, x int, y int, pid long, label int").repartition(4, "pid")


def test_paths_equal_a_walk(spark):
    """Facets with holes and touching corners, walls in tiles of 4 pixels: the same order as step by step."""
    rnd = random.Random(11)
    borders = B.border_pixels(R.region_map(table(spark, {f"i{k}": random_raster(rnd, 13) for k in range(60)}), 4)).cache()
    facets = {}
    for r in borders.collect():
        facets.setdefault((r.image_id, r.region_id), {})[r.x, r.y] = list(r.around)
    want = {(*f, k, x, y, side, around[x, y][side]) for f, around in facets.items() for k, (x, y, side) in enumerate(walk(f[1], around))}
    for tile in (4, B.TILE):
        got = B.border_paths(borders, tile)
        assert {(r.image_id, r.region_id, r.place, r.x, r.y, r.side, r.neighbour) for r in got.collect()} == want
    borders.unpersist()


def test_path_of_many_walls(spark):
    """A comb of 300 teeth, 300 pixels each: one facet of 180,000 walls, every place once, from the first wall on."""
    n = 300
    px = spark.range(2 * n * n).select(F.lit("i").alias("image_id"), (F.col("id") % (2 * n)).cast("int").alias("x"), F.floor(F.col("id") / (2 * n)).cast("int").alias("y"), F.lit(0).alias("region_id"))
    px = px.withColumn("region_id", F.when((F.col("y") == 0) | (F.col("x") % 2 == 0), 0).otherwise(F.col("x")).cast("long"))
    p = B.border_paths(B.border_pixels(px)).where("region_id = 0")
    r = p.agg(F.count(F.lit(1)), F.countDistinct("place"), F.min("place"), F.max("place"), F.min_by(F.struct("x", "y", "side"), "place")).first()
    flat, upright = 2 * n + n + n, n + 1 + n * (n - 1) + (n - 1) * (n - 1)
    assert r[0] == r[1] == r[3] + 1 == flat + upright and r[2] == 0 and tuple(r[4]) == (0, 0, 0)


def in_place(rows, rgb):
    a = [list(r) for r in rows]
    far = lambda p, q: sum((i - j) ** 2 for i, j in zip(rgb[p], rgb[q])) ** 0.5 if p in rgb and q in rgb else float("inf")
    for y in range(1, len(a) - 1):
        for x in range(1, len(a[0]) - 1):
            c, up, down, left, right = a[y][x], a[y - 1][x], a[y + 1][x], a[y][x - 1], a[y][x + 1]
            if c < 0 or c not in (up, down, left, right):
                continue
            new = c
            if c not in (up, down):
                new = up if far(up, c) < far(down, c) else down
            elif c not in (left, right):
                new = left if far(left, c) < far(right, c) else right
            a[y][x] = new if new >= 0 else c
    return a


def test_in_place_equals_a_loop(spark):
    """Tiles of 3 pixels, so that many diagonals of them pass their edges on, and one tile for all; pixels without label, a label without colour."""
    rnd = random.Random(8)
    images = {f"i{k}": random_raster(rnd, 14) for k in range(60)}
    for rows in list(images.values())[::4]:
        rows[rnd.randrange(len(rows))][rnd.randrange(len(rows[0]))] = -1
    rgb = {0: (10, 20, 30), 1: (200, 10, 10)}
    palette = spark.createDataFrame([(k, *c) for k, c in rgb.items()], "label int, r int, g int, b int")
    want = {(k, x, y): v for k, rows in images.items() for y, r in enumerate(in_place(rows, rgb)) for x, v in enumerate(r)}
    for tile in (3, K.TILE):
        assert {(r.image_id, r.x, r.y): r.label for r in K.strip_in_place(table(spark, images), palette, tile).collect()} == want


def test_in_place_rounds_of_a_tall_image(spark, monkeypatch):
    """Tiles don't wait for those above them: a tall image takes a few rounds, not one for each diagonal of tiles."""
    rnd = random.Random(5)
    px = spark.createDataFrame([("i", x, y, 4 * y + x, rnd.randrange(3)) for y in range(160) for x in range(4)], "image_id string, x int, y int, pid long, label int")
    palette = spark.createDataFrame([(0, 0, 0, 0), (1, 9, 9, 9), (2, 200, 0, 0)], "label int, r int, g int, b int")
    calls, write = [], K.materialize
    monkeypatch.setattr(K, "materialize", lambda df: calls.append(df) or write(df))
    K.strip_in_place(px, palette, tile=4).count()
    assert len(calls) < 40


def test_palettes_go_to_every_task(spark, monkeypatch):
    """A join by label would give all pixels of a label to one task."""
    from tessellar.sources import raster as S

    px = spark.createDataFrame([("i", 0, 0, 0, 1)], "image_id string, x int, y int, pid long, label int")
    plan = px.join(S.palette(spark).select("label", "r"), "label", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_poles_of_a_shape_are_found_once_and_as_anywhere():
    import numpy as np

    rnd = np.random.default_rng(5)
    shapes = [np.array(s, float) / 4 for s in ([(0, 2), (2, 0), (4, 2), (2, 4)], [(0, 2), (2, 0), (6, 1), (8, 6), (3, 7)], [(0, 0), (4, 0), (4, 4), (0, 4), (1, 2)])]
    shapes += [rnd.integers(0, 30, (int(n), 2)) / 4 for n in rnd.integers(3, 14, 40)]
    B._pole_of_shape.cache_clear()
    for s in shapes:
        for at in ((0, 0), (17.5, 3.25), (93, 951.75)):
            ring = s + np.array(at)
            assert B._placed_pole([ring]) == B.pole([ring])
    kept = B._pole_of_shape.cache_info()
    assert kept.misses <= len(shapes) and kept.hits >= 2 * len(shapes)


def test_neighbours_across_tiles(spark, monkeypatch):
    rnd = random.Random(3)
    t = table(spark, {k: random_raster(rnd, 23) for k in ("a", "b")}).where("pid % 11 != 5")
    ids = R.region_map(t, 4)
    ways = [lambda: B.border_pixels(ids), lambda: R.adjacency(ids), lambda: R.boundary_mask(ids), lambda: K.around(t), lambda: K.opening(t), lambda: K.prune_protrusions(t, 20), lambda: K.strip_cleanup(t, PALETTE(spark), 3)]
    want = [sorted(map(repr, w().collect())) for w in ways]
    monkeypatch.setattr(R, "TILE_ROWS", 7)
    monkeypatch.setattr(R, "TILE_COLUMNS", 5)
    monkeypatch.setattr(K, "FILL", 1)
    assert [sorted(map(repr, w().collect())) for w in ways] == want


def PALETTE(spark):
    return spark.createDataFrame([(0, 90, 90, 90), (1, 94, 94, 94), (2, 99, 99, 99)], "label int, r int, g int, b int")
