"""Borders of facets (regions joined by four neighbours): traced paths, segments shared by two facets, rings, label bounds.

A border is a list of walls. A wall is one side of a pixel of the facet, with something else beyond it. Each pixel on a
border carries the facets around it, so that each wall knows the next one, and all else is list ranking, windows, joins and array functions.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize, release
from .groups import per_group
from .outline import halve
from .regions import STEPS, adjacency, region_table, with_beside

#: Sides of a pixel as outward steps: left, top, right, bottom.
SIDES = [(-1, 0), (0, -1), (1, 0), (0, 1)]
_POINTS = "array<struct<x:double,y:double,side:int>>"


def border_pixels(pixels: DataFrame) -> DataFrame:
    """image_id, region_id, x, y, around of the pixels that touch another facet or the image's edge; -1 stands for outside."""
    p = with_beside(pixels.select("image_id", "x", "y", "region_id"), "region_id", tuple(STEPS))
    around = F.array(*[F.coalesce(c, F.lit(-1)).cast("long") for c in ("l", "u", "r", "d", "ul", "ur", "dl", "dr")])
    touches = F.exists(F.slice(around, 1, 4), lambda f: f != F.col("region_id"))
    return p.select("image_id", "region_id", "x", "y", around.alias("around")).where(touches)


#: Side of the tiles in which walls are joined to chains.
TILE = 256


def walls(borders: DataFrame) -> DataFrame:
    """image_id, region_id, x, y, side of each wall, the next one (nx, ny, ns) clockwise around the facet, and whether the next one begins its outer border.

    From side n of pixel p, with t the way along it: side t of p where p + t is not the facet's; else side n of p + t where
    p + t + n is not; else, round the corner, side -t of p + t + n. Each wall has one next and is next of one.
    """
    own = lambda k: F.col("around")[k] == F.col("region_id")
    options = []
    for side, ((i, j), corner) in enumerate(zip(SIDES, (4, 5, 7, 6))):
        a, b = SIDES[(side + 1) % 4]
        at = lambda x, y, s: F.struct((F.col("x") + x).alias("nx"), (F.col("y") + y).alias("ny"), F.lit(s).alias("ns"))
        after = F.when(~own((side + 1) % 4), at(0, 0, (side + 1) % 4)).when(~own(corner), at(a, b, side)).otherwise(at(a + i, b + j, (side + 3) % 4))
        options.append(F.when(~own(side), F.struct(F.lit(side).alias("side"), after.alias("n"))))
    w = borders.select("image_id", "region_id", "x", "y", F.explode(F.filter(F.array(*options), lambda o: o.isNotNull())).alias("w")).select("image_id", "region_id", "x", "y", "w.side", "w.n.*")
    first = borders.groupBy("image_id", "region_id").agg(F.min(F.struct("y", "x")).alias("first"))
    begins = (F.col("nx") == F.col("first.x")) & (F.col("ny") == F.col("first.y")) & (F.col("ns") == 0)
    return w.join(first, ["image_id", "region_id"]).withColumn("ends", begins).drop("first")


def _chained(tile: int):
    """Walls of one tile with the chain that each is on: its first wall (ex, ey, es), the place there, and, at its last, the first wall of the next one."""

    def run(pdf):
        import numpy as np

        x, y = pdf.x.to_numpy() % tile, pdf.y.to_numpy() % tile
        nx, ny = pdf.nx.to_numpy() - pdf.x.to_numpy() + x, pdf.ny.to_numpy() - pdf.y.to_numpy() + y
        at = np.full(4 * tile * tile, -1)
        at[(y * tile + x) * 4 + pdf.side.to_numpy()] = np.arange(len(pdf))
        inside = (nx >= 0) & (nx < tile) & (ny >= 0) & (ny < tile) & ~pdf.ends.to_numpy()
        after = np.full(len(pdf), -1)
        after[inside] = at[(ny[inside] * tile + nx[inside]) * 4 + pdf.ns.to_numpy()[inside]]
        before = np.full(len(pdf), -1)
        before[after[after >= 0]] = np.flatnonzero(after >= 0)
        # from each wall back to the first of its chain, twice as far at each step
        first, place, jump = np.arange(len(pdf)), (before >= 0).astype(np.int64), before.copy()
        first[jump >= 0] = jump[jump >= 0]
        for _ in range(len(pdf).bit_length()):
            go = np.flatnonzero(jump >= 0)
            if not len(go):
                break
            to = jump[go]
            place[go] += place[to]
            first[go] = first[to]
            jump[go] = jump[to]
        closed = jump >= 0  # a hole's border that doesn't leave the tile
        out = pdf.assign(ex=pdf.x.to_numpy()[first], ey=pdf.y.to_numpy()[first], es=pdf.side.to_numpy()[first], spot=place, last=after < 0)
        return out[~closed][["image_id", "region_id", "x", "y", "side", "nx", "ny", "ns", "ends", "ex", "ey", "es", "spot", "last"]]

    return run


def border_paths(borders: DataFrame, tile: int = TILE) -> DataFrame:
    """The outer walls of each facet in order: place, x, y, side (0 to 3), neighbour (-1 outside), around.

    The order is that of a list: walls are joined to chains inside tiles, then each chain learns what follows it up to the border's end by pointer
    doubling over chains alone, in as many rounds as their number has bits. No facet is one task's work. Borders of holes never reach an end and are left out.
    """
    borders = materialize(borders)
    w = walls(borders).withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    schema = "image_id string, region_id long, x int, y int, side int, nx int, ny int, ns int, ends boolean, ex int, ey int, es int, spot long, last boolean"
    on = materialize(w.groupBy("image_id", "tx", "ty").applyInPandas(_chained(tile), schema))
    name = lambda *c: F.struct("image_id", *[F.col(k).cast("int").alias(n) for k, n in zip(c, "xys")])
    chains = materialize(on.where("last").select(name("ex", "ey", "es").alias("chain"), F.when(~F.col("ends"), name("nx", "ny", "ns")).alias("to"), (F.col("spot") + 1).alias("rest")))
    while True:
        ahead = chains.select(F.col("chain").alias("to"), F.col("to").alias("further"), F.col("rest").alias("more"))
        met = chains.where("to IS NOT NULL").join(ahead.hint("merge"), "to").select("chain", F.col("further").alias("to"), (F.col("rest") + F.col("more")).alias("rest"))
        spent, chains = chains, materialize(chains.where("to IS NULL").unionByName(met))
        settled = [t.where("to IS NULL").count() for t in (spent, chains)]
        release(spent)
        if settled[0] == settled[1]:
            break
    rest = chains.where("to IS NULL").select("chain", "rest").hint("merge")  # files tell too little of their size to send them to every task
    facets = borders.groupBy("image_id", "region_id").agg(F.min(F.struct("y", "x")).alias("first")).select("region_id", F.struct("image_id", F.col("first.x").cast("int").alias("x"), F.col("first.y").cast("int").alias("y"), F.lit(0).alias("s")).alias("chain"))
    whole = facets.join(rest, "chain").select(F.col("chain.image_id").alias("image_id"), "region_id", F.col("rest").alias("whole"))
    placed = on.select("image_id", "region_id", "x", "y", "side", "spot", name("ex", "ey", "es").alias("chain")).join(rest, "chain").join(whole.hint("merge"), ["image_id", "region_id"])
    placed = placed.select("image_id", "region_id", "x", "y", "side", (F.col("whole") - F.col("rest") + F.col("spot")).cast("int").alias("place"))
    out = placed.join(borders.select("image_id", "region_id", "x", "y", "around"), ["image_id", "region_id", "x", "y"])
    return out.select("image_id", "region_id", "place", "x", "y", "side", F.get("around", F.col("side")).alias("neighbour"), "around")


def border_segments(paths: DataFrame) -> DataFrame:
    """image_id, region_id, segment, neighbour, points: each path cut where its neighbour changes, both ends included.

    It also changes where the walk turns on one pixel and the pixel at that corner is not the neighbour's. What is left at the
    end goes before the first segment if both have one neighbour.
    """
    facet = Window.partitionBy("image_id", "region_id")
    order = facet.orderBy("place")
    # the corners of a side with the one before it and with the one after it: between 0 and 1, 1 and 2, 2 and 3, 3 and 0
    corners = F.array(*[F.col("around")[k] for k in (4, 5, 7, 6)])
    p = paths.select("image_id", "region_id", "place", "x", "y", "side", "neighbour", F.get(corners, (F.col("side") + 3) % 4).alias("_c0"), F.get(corners, F.col("side")).alias("_c1"))
    p = p.select("*", *[F.lag(c).over(order).alias(f"{c[0]}0") for c in ("x", "y", "side", "neighbour")])
    corner = F.when(F.col("s0") == (F.col("side") + 3) % 4, F.col("_c0")).when(F.col("s0") == (F.col("side") + 1) % 4, F.col("_c1"))
    turn = (F.col("n0") != F.col("neighbour")) | ((F.col("n0") != -1) & (F.col("x") == F.col("x0")) & (F.col("y") == F.col("y0")) & F.coalesce(corner != F.col("n0"), F.lit(False)))
    p = p.withColumn("cut", F.coalesce(turn, F.lit(False))).drop("_c0", "_c1", "s0", "x0", "y0").withColumn("s", F.sum(F.col("cut").cast("int")).over(order).cast("int"))
    whole = facet.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.select("*", F.max("s").over(facet).alias("last"), F.count(F.lit(1)).over(facet).alias("n"), F.first("neighbour").over(whole).alias("first_n"), F.last("neighbour").over(whole).alias("last_n"), F.last("cut").over(whole).alias("ends"))
    # a cut belongs to the segment it ends and to the one it begins
    p = p.select("*", F.explode(F.when(F.col("cut"), F.array("s", F.col("s") - 1)).otherwise(F.array("s"))).alias("segment"))
    tail = (F.col("segment") == F.col("last")) & (F.col("last") > 0)
    p = p.where(~(tail & F.col("ends")))
    joins = tail & (F.col("first_n") == F.col("last_n"))
    owner = F.when(F.col("cut") & (F.col("segment") < F.col("s")), F.col("n0")).otherwise(F.col("neighbour"))
    p = p.withColumn("owner", owner).withColumn("at", F.when(joins, F.col("place") - F.col("n")).otherwise(F.col("place"))).withColumn("segment", F.when(joins, 0).otherwise(F.col("segment")))
    point = F.struct("at", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "side")
    g = p.groupBy("image_id", "region_id", "segment").agg(F.max_by("owner", "at").alias("last_owner"), F.min_by("owner", "at").alias("first_owner"), F.array_sort(F.collect_list(point)).alias("ps"))
    return g.select("image_id", "region_id", "segment", F.col("last_owner").alias("neighbour"), F.transform("ps", lambda q: F.struct(q.x.alias("x"), q.y.alias("y"), q.side.alias("side"))).cast(_POINTS).alias("points"))


def halved(segments: DataFrame, width: int, height: int, times: int = 2) -> DataFrame:
    """Segments with their points halved so many times."""
    for _ in range(times):
        segments = segments.withColumn("points", halve(F.col("points"), width, height))
    return segments


def matched_segments(segments: DataFrame, distance: float = 4.0) -> DataFrame:
    """image_id, region_id, segment, neighbour, points, reverse: segments that two facets share have one set of points, the lower facet's.

    Two match if both ends lie within the distance, straight or reversed, whichever is nearer. In a pair of facets the lower
    one's segments take in turn the first of the other's that is still free. A pair's candidates are one task's work.
    """
    end = lambda k: (F.element_at("points", 1) if k == 0 else F.element_at("points", -1))
    ends = segments.select("image_id", "region_id", "segment", "neighbour", end(0).alias("a"), end(1).alias("z"))
    low = ends.where("neighbour > region_id").select("image_id", F.col("region_id").alias("f"), F.col("neighbour").alias("g"), F.col("segment").alias("s"), F.col("a").alias("a1"), F.col("z").alias("z1"))
    high = ends.where("neighbour >= 0 AND neighbour < region_id").select("image_id", F.col("neighbour").alias("f"), F.col("region_id").alias("g"), F.col("segment").alias("t"), F.col("a").alias("a2"), F.col("z").alias("z2"))
    far = lambda p, q: F.abs(p.x - q.x) + F.abs(p.y - q.y)
    c = {k: F.col(k) for k in ("a1", "z1", "a2", "z2")}
    straight, turned = (far(c["a1"], c["a2"]), far(c["z1"], c["z2"])), (far(c["a1"], c["z2"]), far(c["z1"], c["a2"]))
    is_straight, is_turned = F.greatest(*straight) <= distance, F.greatest(*turned) <= distance
    pairs = low.join(high, ["image_id", "f", "g"]).where(is_straight | is_turned)
    pairs = pairs.select("image_id", "f", "g", "s", "t", (is_turned & (~is_straight | (straight[0] + straight[1] >= turned[0] + turned[1]))).alias("reverse"))

    def greedy(key, rows):
        taken, out = set(), {}
        for s, t, r in sorted(rows):
            if s not in out and t not in taken:
                taken.add(t)
                out[s] = t, r
        return [(*key, s, t, r) for s, (t, r) in out.items()]

    chosen = per_group(pairs, ["image_id", "f", "g"], greedy, "image_id string, f long, g long, s int, t int, reverse boolean")
    source = segments.select("image_id", F.col("region_id").alias("f"), F.col("segment").alias("s"), F.col("points").alias("theirs"))
    given = chosen.join(source, ["image_id", "f", "s"]).select("image_id", F.col("g").alias("region_id"), F.col("t").alias("segment"), "theirs", "reverse")
    out = segments.join(given, ["image_id", "region_id", "segment"], "left")
    return out.select("image_id", "region_id", "segment", "neighbour", F.coalesce("theirs", "points").alias("points"), F.coalesce("reverse", F.lit(False)).alias("reverse"))


def rings(boundary: DataFrame, walls: bool) -> DataFrame:
    """image_id, region_id, points (x, y): a facet's segments one after the other, on its pixels or on its walls. Between two segments the end of the first repeats."""
    if walls:
        dx = lambda p: F.when(p.side == 0, -0.5).when(p.side == 2, 0.5).otherwise(0.0)
        dy = lambda p: F.when(p.side == 1, -0.5).when(p.side == 3, 0.5).otherwise(0.0)
        at = lambda p: F.struct((p.x + dx(p)).alias("x"), (p.y + dy(p)).alias("y"))
    else:
        at = lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))
    way = F.when(F.col("reverse"), F.reverse("points")).otherwise(F.col("points"))
    ordered = F.array_sort(F.collect_list(F.struct("segment", F.transform(way, at).alias("ps"))))
    g = boundary.groupBy("image_id", "region_id").agg(ordered.alias("ss"))
    joined = F.flatten(F.transform("ss", lambda s, i: F.when(i > 0, F.concat(F.array(F.element_at(F.get(F.col("ss"), i - 1).ps, -1)), s.ps)).otherwise(s.ps)))
    return g.select("image_id", "region_id", joined.alias("points"))


def _signed(px, py, polygon):
    """Distances of points to the nearest edge of polygon (rings), positive inside by the even-odd rule."""
    import numpy as np

    a = np.concatenate(polygon)
    b = np.concatenate([np.roll(r, -1, 0) for r in polygon])
    px, py = np.atleast_1d(px)[:, None], np.atleast_1d(py)[:, None]
    d = b - a
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((a[:, 1] > py) != (b[:, 1] > py)) & (px < d[:, 0] * (py - a[:, 1]) / d[:, 1] + a[:, 0])
        t = np.clip(np.nan_to_num(((px - a[:, 0]) * d[:, 0] + (py - a[:, 1]) * d[:, 1]) / (d**2).sum(1)), 0, 1)
    far = np.hypot(px - a[:, 0] - t * d[:, 0], py - a[:, 1] - t * d[:, 1]).min(1)
    return np.where(crosses.sum(1) % 2 == 1, far, -far)


def _centroid(ring):
    import numpy as np

    nxt = np.roll(ring, -1, 0)
    cross = ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]
    return ((ring + nxt) * cross[:, None]).sum(0) / (3 * cross.sum()) if cross.sum() else ring[0]


#: Distances that differ by less may be told apart by rounding alone.
TIE = 1e-6


def pole(polygon, precision: float = 1.0, near: list | None = None) -> tuple[float, float, float]:
    """The inner point farthest from the edges of a polygon (arrays of points: outer ring, then holes), within the precision.

    Squares over the box are halved, the most promising first; the centroid and the box's middle are the first guesses. All but the centroid are
    exact; near, if given, learns of each choice whether it hangs on the centroid's last digits.
    """
    import numpy as np

    polygon = [np.asarray(r, float) for r in polygon]
    outer = polygon[0]
    low, size = outer.min(0), outer.max(0) - outer.min(0)
    cell = size.min()
    if cell == 0:
        return float(low[0]), float(low[1]), 0.0
    centre = _centroid(outer)
    guesses = np.array([centre, low + size / 2])
    d = _signed(guesses[:, 0], guesses[:, 1], polygon)
    k = 1 if d[1] > d[0] else 0
    best = float(guesses[k][0]), float(guesses[k][1]), float(d[k])
    rounded = bool((centre * 2**20 % 1).any())
    near = [] if near is None else near
    near.append(rounded and abs(d[1] - d[0]) < TIE)
    rounded = rounded and k == 0  # of the best so far
    grid = [(x, y) for x in np.arange(low[0], low[0] + size[0], cell) + cell / 2 for y in np.arange(low[1], low[1] + size[1], cell) + cell / 2]
    heap, n = [], 0

    def put(points, half):
        nonlocal n
        for (x, y), d in zip(points, _signed(*np.array(points).T, polygon)):
            heapq.heappush(heap, (-(d + half * 2**0.5), n, x, y, half, float(d)))
            n += 1

    put(grid, cell / 2)
    while heap:
        most, _, x, y, half, d = heapq.heappop(heap)
        near.append(rounded and min(abs(d - best[2]), abs(-most - best[2] - precision)) < TIE)
        if d > best[2]:
            best, rounded = (float(x), float(y), d), False
        if -most - best[2] > precision:
            half /= 2
            put([(x + i * half, y + j * half) for i in (-1, 1) for j in (-1, 1)], half)
    near.append(rounded)
    return best


#: Shapes of facets whose poles a worker keeps, and the points up to which a shape is kept.
SHAPES, SHAPE_POINTS = 1 << 16, 128


@lru_cache(SHAPES)
def _pole_of_shape(shape: bytes) -> tuple[float, float, float, bool] | None:
    """The pole of a ring whose box begins at (0, 0), and whether it is the centroid, in more digits than there are; None where it hangs on the rounding of the centroid, and so on where in the picture it lies."""
    import numpy as np

    ring, near = np.frombuffer(shape).reshape(-1, 2), []
    x, y, d = pole([ring], near=near)
    return None if any(near[:-1]) or d <= TIE else (x, y, d, bool(near and near[-1]))


def _placed_pole(rings) -> tuple[float, float, float]:
    """The pole of a facet (arrays of points: its ring, then those of facets in its box), as pole() gives it. Facets of one shape are worked out once, if where they lie does not matter."""
    outer, *others = rings
    if not others and len(outer) <= SHAPE_POINTS:
        low = outer.min(0)
        found = _pole_of_shape((outer - low).tobytes())
        if found and found[3]:
            x, y = map(float, _centroid(outer))
            return x, y, float(_signed(x, y, [outer])[0])
        if found:
            return found[0] + float(low[0]), found[1] + float(low[1]), found[2]
    return pole([outer, *[r for r in others if (_signed(r[:, 0], r[:, 1], [outer]) >= 0).all()]])


def label_bounds(pixels: DataFrame, boundary: DataFrame) -> DataFrame:
    """image_id, region_id, x, y, distance and the box of each facet's label, around its pole of inaccessibility.

    Facets that lie inside another one are holes in it: neighbours whose box lies in the facet's and whose ring lies inside
    its own. A facet with the neighbours in its box is one task's work.
    """
    ring = rings(boundary, walls=True)
    box = region_table(pixels).select("image_id", "region_id", *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    ends = {c: f for c, f in (("lx", F.array_min(F.transform("points", lambda p: p.x))), ("ly", F.array_min(F.transform("points", lambda p: p.y))), ("hx", F.array_max(F.transform("points", lambda p: p.x))), ("hy", F.array_max(F.transform("points", lambda p: p.y))))}
    other = ring.select("image_id", F.col("region_id").alias("dst"), *[f.alias(c) for c, f in ends.items()])
    # points go only to the few facets that a neighbour may lie in
    wide = box.where("x2 - x1 > 2 AND y2 - y1 > 2")
    near = adjacency(pixels).select("image_id", F.col("src").alias("region_id"), "dst").join(wide, ["image_id", "region_id"]).join(other, ["image_id", "dst"])
    inside = near.where("lx >= x1 AND hx <= x2 - 1 AND ly >= y1 AND hy <= y2 - 1").select("image_id", "region_id", "dst")
    inside = inside.join(ring.select("image_id", F.col("region_id").alias("dst"), "points"), ["image_id", "dst"])
    rows = ring.join(inside.groupBy("image_id", "region_id").agg(F.collect_list("points").alias("others")), ["image_id", "region_id"], "left")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pairs = lambda points: np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
        for batch in batches:
            image, region, points, others = (batch.column(c) for c in ("image_id", "region_id", "points", "others"))
            off, xy = points.offsets.to_pylist(), pairs(points.values)
            rings = [[xy[i:j]] for i, j in zip(off, off[1:])]
            for i in np.flatnonzero(others.is_valid().to_numpy(zero_copy_only=False)):
                rings[i] += [pairs(r.values) for r in others[i].values]
            x, y, d = np.array([_placed_pole(r) for r in rings]).reshape(-1, 3).T
            pad = np.array([2 * max(0.0, 2 * v) ** 0.5 for v in d.tolist()])
            found = {"image_id": image, "region_id": region} | {n: pa.array(c) for n, c in (("x", x), ("y", y), ("distance", d), ("min_x", x - pad), ("min_y", y - pad), ("max_x", x + pad), ("max_y", y + pad))}
            yield pa.RecordBatch.from_pydict(found)

    return rows.select("image_id", "region_id", "points", "others").mapInArrow(run, "image_id string, region_id long, x double, y double, distance double, min_x double, min_y double, max_x double, max_y double")


def facet_outlines(pixels: DataFrame, width: int, height: int, times: int = 2) -> DataFrame:
    """The matched boundary of every facet of pixels (region_id by four neighbours), written to the shared folder once."""
    segments = materialize(halved(border_segments(border_paths(border_pixels(pixels))), width, height, times))
    return materialize(matched_segments(segments))


def closed(points: Column) -> Column:
    """points with the first one at the end, too."""
    ends_open = (F.element_at(points, 1).x != F.element_at(points, -1).x) | (F.element_at(points, 1).y != F.element_at(points, -1).y)
    return F.when(ends_open, F.concat(points, F.array(F.element_at(points, 1)))).otherwise(points)
