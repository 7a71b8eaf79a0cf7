"""Facet reduction and nearest borders against plain versions that go one facet, one pixel at a time."""

import random

import pytest

from tessellar.operators import reduction as D
from tessellar.operators import regions as R

PALETTE = [(0, 10, 10, 10), (1, 200, 30, 30), (2, 30, 200, 30), (3, 190, 40, 50)]
RGB = {k: c for k, *c in PALETTE}


def rasters(n, seed, most=9):
    rnd = random.Random(seed)
    out = {}
    for k in range(n):
        w, h, colours, run = rnd.randint(1, most), rnd.randint(1, most), rnd.randint(1, 4), rnd.choice([1, 1, 2, 4])
        rows = [[rnd.randrange(colours) for _ in range(w)] for _ in range(h)]
        out[f"i{k}"] = [[rows[y // run * run % h][x // run * run % w] for x in range(w)] for y in range(h)]
    return out


def table(spark, images):
    cells = [(k, x, y, y * len(r) + x, v) for k, rows in images.items() for y, r in enumerate(rows) for x, v in enumerate(r)]
    return spark.createDataFrame(cells, "image_id string, x int, y int, pid long, label int").repartition(8, "pid")


def around(p):
    return [(p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)]


def patches(label):
    """Sets of pixels of one label joined by four neighbours, in raster order of their first pixel."""
    out, seen = [], set()
    for start in sorted(label, key=lambda p: (p[1], p[0])):
        if start not in seen:
            group, stack = {start}, [start]
            while stack:
                for q in around(stack.pop()):
                    if q in label and q not in group and label[q] == label[start]:
                        group.add(q)
                        stack.append(q)
            seen |= group
            out.append(group)
    return out


def far(a, b):
    return sum((p - q) ** 2 for p, q in zip(RGB[a], RGB[b])) ** 0.5


def given_away(label, facet):
    rim = [q for q in label if q not in facet and any(n in facet for n in around(q))]
    of = label[next(iter(facet))]
    return {p: min((abs(p[0] - q[0]) + abs(p[1] - q[1]), far(of, label[q]), label[q]) for q in rim) for p in facet} if rim else {}


def one_by_one(rows, least, most, large_first):
    label = {(x, y): v for y, r in enumerate(rows) for x, v in enumerate(r)}
    number = {p: k for k, g in enumerate(patches(label)) for p in g}
    kept = dict(number)

    def now():
        return {min(kept[p] for p in g if p in kept): g for g in patches(label)}

    def go(f):
        new = given_away(label, now()[f])
        for p, (_, _, to) in new.items():
            label[p] = to
            kept.pop(p, None)

    first = now()
    for f in sorted(first, key=lambda f: (-len(first[f]), f) if large_first else (len(first[f]), -f)):
        facets = now()
        if f in facets and len(facets[f]) < least and len(facets) > 1:
            go(f)
    while most is not None and len(facets := now()) > max(1, most):
        go(min(facets, key=lambda f: (len(facets[f]), -f)))
    return label


@pytest.mark.parametrize(("patch", "large_first", "most"), [(D.PATCH, True, None), (D.PATCH, False, 4), (0, True, 3), (0, False, None)])
def test_reduction_equals_one_by_one(spark, patch, large_first, most):
    images = rasters(200, 7, 9 if patch else 5)  # rounds take longer on larger ones
    got = {}
    for r in D.reduce_facets(table(spark, images), spark.createDataFrame(PALETTE, "label int, r int, g int, b int"), 4, most, large_first, patch).collect():
        got.setdefault(r.image_id, {})[r.x, r.y] = r.label
    assert {k: one_by_one(rows, 4, most, large_first) for k, rows in images.items()} == got


@pytest.mark.parametrize("large_first", [True, False])
def test_windows_equal_one_window(spark, monkeypatch, large_first):
    """Facets beside the edges of windows wait, and go as in a window that holds the whole image."""
    rnd = random.Random(5)
    images = {f"i{k}": [[rnd.randrange(4) for _ in range(130 // k)] for _ in range(110)] for k in (1, 2, 10)}
    got = []
    for window in (D.WINDOW, (48, 48)):
        monkeypatch.setattr(D, "WINDOW", window)
        out = D.reduce_facets(table(spark, images), spark.createDataFrame(PALETTE, "label int, r int, g int, b int"), 4, large_first=large_first)
        got.append({(r.image_id, r.pid): r.label for r in out.collect()})
    assert got[0] == got[1] and len(got[0]) == 110 * (130 + 65 + 13)


def test_windows_know_what_stays_beyond_their_edge(spark, monkeypatch):
    """Of a facet of four pixels one lies in the next window, which sees two of them."""
    monkeypatch.setattr(D, "WINDOW", (36, 36))
    rows = [[1 if 33 <= x <= 36 else 0 for x in range(60)]]
    out = D.reduce_facets(table(spark, {"i": rows}), spark.createDataFrame(PALETTE, "label int, r int, g int, b int"), 3)
    assert [r.label for r in out.orderBy("x").collect()] == rows[0]


def test_large_patches_take_few_rounds(spark, monkeypatch):
    """Small facets that touch each other all over an image, more than a task takes, don't take a round for each link of their chains."""
    written = []

    def counted(df, real=D.materialize):
        written.append(df)
        assert len(written) < 20
        return real(df)

    monkeypatch.setattr(D, "materialize", counted)
    monkeypatch.setattr(D, "WINDOW", (36, 36), raising=False)
    px = spark.range(6000).selectExpr("'i' AS image_id", "cast(id % 100 AS int) AS x", "cast(id div 100 AS int) AS y", "id AS pid", "cast(pmod(xxhash64(id), 5) AS int) AS label")
    out = D.reduce_facets(px, spark.createDataFrame([*PALETTE, (4, 90, 90, 90)], "label int, r int, g int, b int"), 3, patch=36 * 36)
    assert out.count() == 6000 and R.region_table(R.region_map(out, 4)).where("area < 3").isEmpty()


def test_most_leaves_as_many(spark):
    """One deletion that joins no more than it must is enough."""
    px = table(spark, {"i": [[0, 0, 1, 0, 0, 1, 0, 0]]})
    out = D.reduce_facets(px, spark.createDataFrame(PALETTE, "label int, r int, g int, b int"), 1, 3)
    assert [r.label for r in out.orderBy("x").collect()] == [0, 0, 1, 0, 0, 0, 0, 0]


def test_pixels_without_label_stay(spark):
    px = table(spark, {"i": [[0, 0, None, 1], [0, 0, -1, 0]]})
    out = D.reduce_facets(px, spark.createDataFrame(PALETTE, "label int, r int, g int, b int"), 2)
    assert sorted((r.x, r.y, r.label) for r in out.collect() if r.label not in (0, 1)) == [(2, 0, None), (2, 1, -1)] or out.count() == 8


def test_nearest_border(spark):
    """The scans find what a comparison with every pixel of the rim finds, in facets of any shape."""
    images = rasters(60, 3)
    pixels = R.region_map(table(spark, images), 4)
    facets = {(r.image_id, r.region_id) for r in pixels.select("image_id", "region_id").distinct().collect()}
    near = {((r.image_id, r.src), (r.image_id, r.dst)) for r in R.adjacency(pixels).collect()}
    chosen = []
    for f in sorted(facets):
        if all((f, g) not in near for g in chosen):
            chosen.append(f)
    got = {(r.image_id, r.pid): (r.distance, r.label) for r in D.nearest_border(pixels, spark.createDataFrame(chosen, "image_id string, region_id long"), spark.createDataFrame(PALETTE, "label int, r int, g int, b int")).collect()}
    want = {}
    for k, rows in images.items():
        label = {(x, y): v for y, r in enumerate(rows) for x, v in enumerate(r)}
        for n, facet in enumerate(patches(label)):
            if (k, n) in chosen:
                want |= {(k, y * len(rows[0]) + x): (d, to) for (x, y), (d, _, to) in given_away(label, facet).items()}
    assert got == want


def test_tables_of_facets_are_not_sent_to_every_task(spark, sf, monkeypatch):
    """Tables of facets or pixels meet by sorting in nearest_borders, even where their files are small; what every task gets is the palette."""
    from tessellar.plans import queries as Q

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans = []
    monkeypatch.setattr(D, "materialize", lambda df, real=D.materialize: plans.append(plan(df)) or real(df))
    plans.append(plan(Q.nearest_borders(spark, sf)))
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in j for j in joins) and not [j for j in joins if "Broadcast" in j and "image_id" in j]
