"""Reduction of facets: the small ones give their pixels to the nearest border of a neighbour, as if one went after another.

What a facet's going does to labels depends on its own pixels and the labels beside them. So it may go together with others as soon as no
facet beside it can go before it does. A task knows this of nearly all facets of a window; those near its edges wait for another one.
Facets keep their number as long as they last; where several meet, the lowest stays.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.store import materialize, release
from .regions import adjacency, border_pairs, in_tiles, least_joined, region_map, region_table

_NEXT = [(-1, 0), (1, 0), (0, -1), (0, 1)]
#: Rows and columns of a window that one task works through, whatever the size of a patch of small facets.
WINDOW = 256, 512
#: Where small facets are too large for windows: pixels of a patch that one task works through; larger patches go in rounds, with the same result.
PATCH = 1 << 17


def small_facets(facets: DataFrame, least: int) -> DataFrame:
    return facets.where(F.col("area") < least)


def facet_neighbours(pixels: DataFrame) -> DataFrame:
    """image_id, region_id, neighbours: the facets beside each facet, in ascending order; none for a facet alone."""
    near = adjacency(pixels).groupBy("image_id", F.col("src").alias("region_id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return pixels.select("image_id", "region_id").distinct().join(near, ["image_id", "region_id"], "left").select("image_id", "region_id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def _rim(own: DataFrame, pixels: DataFrame, key: str, *held: Column) -> DataFrame:
    """own's key, and what is held of all its pixels alike, with each pixel beside own that has another one: image_id, key, x, y and the other columns of pixels but key."""
    steps = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in _NEXT]))
    touching = own.select("image_id", F.col(key).alias("_own"), *held, steps.alias("s")).select("*", "s.x", "s.y").drop("s").distinct()
    return touching.join(pixels, ["image_id", "x", "y"]).where(~F.col(key).eqNullSafe(F.col("_own"))).drop(key).withColumnRenamed("_own", key)


def lowest_small(pixels: DataFrame, least: int) -> DataFrame:
    """Pixels of the facets of fewer than least pixels beside which no such one has a lower number.

    Tables of facets grow with the image, so they meet by sorting: written out, they look small enough to be sent to every task, and no task may hold one.
    """
    own = ["image_id", "region_id"]
    small = small_facets(region_table(pixels.select(*own, "label", "x", "y")), least).select(*own)
    few = materialize(pixels.join(small.hint("merge"), own, "left_semi"))
    later = border_pairs(few).select("image_id", F.col("dst").alias("region_id")).distinct()
    return materialize(few.join(later.hint("merge"), own, "left_anti"))


def nearest_border(pixels: DataFrame, chosen: DataFrame, palette: DataFrame) -> DataFrame:
    """given_away() of the pixels of chosen facets (image_id, region_id), no two of them side by side."""
    return given_away(pixels.join(chosen.select("image_id", "region_id"), ["image_id", "region_id"], "left_semi"), pixels, palette)


def given_away(own: DataFrame, pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, pid, label, distance: the new labels of own, the pixels of some facets, no two of them side by side.

    Each pixel takes the label of the nearest pixel around its facet, by steps along rows and columns; of equals that of the nearest
    colour, then the lower label. The shortest way never leaves the facet, so one scan along its rows and one along its columns, each in both
    directions and carrying (distance, colour, label), finds it. Rows are the facet's pixels and its rim, whatever its size.
    """
    own = own.select("image_id", "region_id", "x", "y", "pid", "label")
    rim = _rim(own, pixels.select("image_id", "x", "y", "region_id", F.col("label").alias("to")).hint("merge"), "region_id", F.col("label").alias("of"))
    rgb = palette.select("label", F.array(*[F.col(c).cast("double") for c in "rgb"]).alias("c"))
    rim = rim.join(rgb.select(F.col("label").alias("of"), F.col("c").alias("c1")), "of", "left").join(rgb.select(F.col("label").alias("to"), F.col("c").alias("c2")), "to", "left")
    rim = rim.select("image_id", "region_id", "x", "y", F.lit(None).cast("long").alias("pid"), F.struct(F.coalesce(C.euclidean(F.col("c1"), F.col("c2")), F.lit(float("inf"))).alias("far"), F.col("to").cast("int").alias("to")).alias("s"))
    both = own.select("image_id", "region_id", "x", "y", "pid", F.lit(None).cast(rim.schema["s"].dataType).alias("s")).unionByName(rim)

    def scanned(rows: DataFrame, along: str, across: str, known: Column) -> DataFrame:
        """Rows with m, the least of (distance, far, to) over their line; known is that of each row so far."""
        line = Window.partitionBy("image_id", "region_id", across).orderBy(along)
        ways = []
        for sign, frame in ((-1, line.rowsBetween(Window.unboundedPreceding, 0)), (1, line.rowsBetween(0, Window.unboundedFollowing))):
            shifted = F.when(known.isNotNull(), F.struct((known.d + sign * F.col(along)).alias("d"), known.far.alias("far"), known.to.alias("to")))
            m = F.min(shifted).over(frame)
            ways.append(F.when(m.isNotNull(), F.struct((m.d - sign * F.col(along)).alias("d"), m.far.alias("far"), m.to.alias("to"))))
        return rows.withColumn("m", F.least(*ways))

    start = F.when(F.col("s").isNotNull(), F.struct(F.lit(0).alias("d"), F.col("s.far").alias("far"), F.col("s.to").alias("to")))
    found = scanned(scanned(both, "x", "y", start), "y", "x", F.col("m"))
    return found.where(F.col("pid").isNotNull() & F.col("m").isNotNull()).select("image_id", "pid", F.col("m.to").alias("label"), F.col("m.d").cast("long").alias("distance"))


def _known(raster: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, pid, label, first) with region_id: the least number, first, of a pixel that kept its label so far."""
    numbered = region_map(raster, 4).select("image_id", "x", "y", "pid", "label", F.col("region_id").alias("now")).join(raster.select("image_id", "pid", "first"), ["image_id", "pid"])
    return numbered.join(numbered.groupBy("image_id", "now").agg(F.min("first").alias("region_id")), ["image_id", "now"]).drop("now")


def _changed(pixels: DataFrame, new: DataFrame) -> DataFrame:
    """Pixels with the labels of new; those that it holds belong to no facet of before."""
    met = pixels.select("image_id", "x", "y", "pid", "label", "first").join(new.select("image_id", "pid", F.col("label").alias("new")), ["image_id", "pid"], "left")
    return materialize(met.select("image_id", "x", "y", "pid", F.coalesce("new", "label").alias("label"), F.when(F.col("new").isNull(), F.col("first")).alias("first")))


def _in_turn(label: list, facet: list, near: list, place: dict, least: int, far, unknown: bytearray, early=None) -> set[int]:
    """The pixels of the facets that go, one after the other in the order of place, by a search outward from the pixels around each; label is theirs afterwards.

    facet is None where it stays. Of the pixels marked in unknown neither label nor facet is known, now or later. A facet beside one may be more than it
    looks, and go before its place, but not before early(facet, pixels, now); from then on its own pixels are unknown. Thus what goes here goes just as
    it does where all is known, and what is unknown in the end has yet to go.
    """
    own: dict[int, list[int]] = {}
    for i, f in enumerate(facet):
        if f is not None:
            own.setdefault(f, []).append(i)
    queue = [(place[f], 0, f) for f in own]
    heapq.heapify(queue)
    due: dict = {}  # of facets beside unknown pixels

    def warn(f, now):
        due[f] = early(f, own[f], now)
        heapq.heappush(queue, (due[f], 1, f))

    def spread(cells, now):
        for i in cells:
            for j in near[i]:
                if facet[j] is not None and facet[j] not in due:
                    warn(facet[j], now)

    spread([i for i, u in enumerate(unknown) if u], float("-inf"))
    moved: set[int] = set()
    while queue:
        now, is_due, f = heapq.heappop(queue)
        if f not in own or (is_due and due.get(f) != now):
            continue
        cells = own.pop(f)
        if f in due:
            del due[f]
            for i in cells:
                unknown[i], facet[i] = 1, None
            spread(cells, now)
            continue
        inside, of = set(cells), label[cells[0]]
        reached, layer = {}, {}
        for i in cells:
            best = min(((far(of, label[j]), label[j]) for j in near[i] if j not in inside), default=None)
            if best:
                layer[i] = best
        while layer:
            reached |= layer
            beyond: dict[int, tuple] = {}
            for i, best in layer.items():
                for j in near[i]:
                    if j in inside and j not in reached:
                        beyond[j] = min(best, beyond.get(j, best))
            layer = beyond
        if not reached:
            continue
        for i, (_, to) in reached.items():
            label[i] = to
        moved |= inside
        # what is now joined through these pixels is one facet, under its lowest number; one that stays takes all in
        seen = set()
        for start in cells:
            if start in seen:
                continue
            group, stack, stays = [], [start], False
            facets = set()
            seen.add(start)
            while stack:
                i = stack.pop()
                group.append(i)
                for j in near[i]:
                    if label[j] == label[i] and j not in seen:
                        if j in inside:
                            seen.add(j)
                            stack.append(j)
                        elif facet[j] is None:
                            stays = True
                        else:
                            facets.add(facet[j])
            members = group + [i for g in facets for i in own.pop(g)]
            warned = [g for g in facets if due.pop(g, None) is not None]
            name = None if stays or len(members) >= least else min(facets)
            for i in members:
                facet[i] = name
            if name is not None:
                own[name] = members
                if warned:
                    warn(name, now)
    return moved


def _distance(rgb: dict):
    """Distance of the colours of two labels; without bounds where one has none."""
    known: dict = {}

    def far(a, b):
        if (a, b) not in known:
            known[a, b] = sum((p - q) ** 2 for p, q in zip(rgb[a], rgb[b])) ** 0.5 if rgb[a][0] == rgb[a][0] and rgb[b][0] == rgb[b][0] else float("inf")
        return known[a, b]

    return far


def _in_order(least: int):
    """New labels of patches, as many as come at once: the facets of each go one after the other.

    Patches of an image don't touch each other, and the pixels around them stay, so that it is all one whether they are worked through together or alone."""

    def work(pdf):
        import pandas as pd

        at = {(x, y): i for i, (x, y) in enumerate(zip(pdf.x.tolist(), pdf.y.tolist()))}
        near = [[at[q] for i, j in _NEXT if (q := (x + i, y + j)) in at] for x, y in at]
        label, small = pdf.label.tolist(), pdf.small.tolist()
        facet = [f if s else None for f, s in zip(pdf.region_id.tolist(), small)]
        place = {f: (k1, k2) for k1, k2, f in zip(pdf.k1.tolist(), pdf.k2.tolist(), facet)}
        far = _distance(dict(zip(label, zip(pdf.r.tolist(), pdf.g.tolist(), pdf.b.tolist()))))
        out = sorted(_in_turn(label, facet, near, place, least, far, bytearray(len(label))))
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]] * len(out), "pid": pdf.pid.iloc[out].to_numpy(), "label": [label[i] for i in out]})

    def run(parts):
        import pandas as pd

        held = []  # the patch that the rows so far end in
        for pdf in parts:
            if not len(pdf):
                continue
            ends = ((pdf.patch == pdf.patch.iloc[-1]) & (pdf.image_id == pdf.image_id.iloc[-1])).to_numpy()
            goes_on = held and ends.all() and held[-1].patch.iloc[-1] == pdf.patch.iloc[0] and held[-1].image_id.iloc[-1] == pdf.image_id.iloc[0]
            if not goes_on:
                whole = pd.concat([*held, pdf[~ends]])
                for _, one in whole.groupby("image_id", sort=False):
                    yield work(one.drop_duplicates(["x", "y"]).reset_index(drop=True))
                held = []
            held.append(pdf[ends])
        if held:
            yield work(pd.concat(held).drop_duplicates(["x", "y"]).reset_index(drop=True))

    return run


def _places(facets: DataFrame, large_first: bool) -> DataFrame:
    """Facets with k1, k2, by which they go: the area, ascending or not; of equals the later number first, or the earlier one."""
    sign = -1 if large_first else 1
    return facets.select("image_id", F.col("region_id").alias("first"), (sign * F.col("area")).alias("k1"), (-sign * F.col("region_id")).alias("k2"))


def _tables(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    near = materialize(adjacency(pixels).select("image_id", "src", "dst"))
    box = [f(c).alias(n) for f, c, n in ((F.min, "x", "x1"), (F.max, "x", "x2"), (F.min, "y", "y1"), (F.max, "y", "y2"))]
    facets = pixels.groupBy("image_id", "region_id").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("area"), *box)
    return near, materialize(facets.join(near.select("image_id", F.col("src").alias("region_id")).distinct(), ["image_id", "region_id"], "left_semi"))


def _earliest(small: DataFrame, least: int) -> DataFrame:
    """image_id, region_id, early: the first place (k1, k2) that each small facet can ever come to have while it is small.

    A facet takes the place of one of the same label that it meets. Both, and the pixels between them, are then in one small facet, so their
    boxes are no further apart than the pixels that are left to it. Facets are met in cells as wide as that.
    """
    cell = lambda low, high: F.sequence(F.floor(low / least), F.floor(high / least))
    cols = ("region_id", "area", "k1", "k2", "x1", "x2", "y1", "y2")
    a = small.select("image_id", "label", *cols, F.explode(cell(F.col("x1") - least, F.col("x2") + least)).alias("cx")).select("*", F.explode(cell(F.col("y1") - least, F.col("y2") + least)).alias("cy"))
    b = small.select("image_id", "label", *[F.col(c).alias(f"{c}_") for c in cols], F.explode(cell(F.col("x1"), F.col("x2"))).alias("cx")).select("*", F.explode(cell(F.col("y1_"), F.col("y2_"))).alias("cy"))
    gap = lambda c: F.greatest(F.lit(0), F.col(f"{c}1_") - F.col(f"{c}2"), F.col(f"{c}1") - F.col(f"{c}2_"))
    reach = (F.col("region_id") == F.col("region_id_")) | (gap("x") + gap("y") <= least - F.col("area") - F.col("area_"))
    met = a.join(b, ["image_id", "label", "cx", "cy"]).where(reach)
    return met.groupBy("image_id", "region_id").agg(F.min(F.struct(F.col("k1_").alias("k1"), F.col("k2_").alias("k2"))).alias("early"))


def _without_small(raster: DataFrame, palette: DataFrame, least: int, large_first: bool, patch: int) -> DataFrame:
    """Raster (image_id, x, y, pid, label, first) after all small facets have gone in the order of their places."""
    places = None
    rgb = palette.select("label", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    open_, done, written = raster, [], False
    while True:
        pixels = materialize(_known(open_))
        near, facets = _tables(pixels)
        if places is None:
            places = materialize(_places(facets, large_first))
        small = materialize(small_facets(facets, least).join(places.withColumnRenamed("first", "region_id"), ["image_id", "region_id"]))
        if small.isEmpty():
            done.append(open_)
            release(pixels, near, facets, small, places)
            break
        ends = small.select("image_id", "region_id")
        beside = near.join(ends.withColumnRenamed("region_id", "src"), ["image_id", "src"], "left_semi").join(ends.withColumnRenamed("region_id", "dst"), ["image_id", "dst"], "left_semi")
        # patches of small facets that touch each other: regions of the mask of their pixels
        mask = pixels.join(ends, ["image_id", "region_id"], "left_semi").withColumn("label", F.lit(0))
        of = region_map(mask, 4).select("image_id", "pid", F.col("region_id").alias("patch")).join(mask.select("image_id", "pid", "region_id"), ["image_id", "pid"])
        named = of.groupBy("image_id", "region_id").agg(F.min("patch").alias("patch"))
        small_in = small.join(named, ["image_id", "region_id"])
        sizes = small_in.groupBy("image_id", "patch").agg(F.sum("area").alias("pixels"))
        patched = materialize(small_in.join(sizes, ["image_id", "patch"]))

        # patches of a bounded number of pixels, each in order in one task, with the pixels around it
        whole = patched.where(F.col("pixels") <= patch)
        inner = pixels.join(whole.select("image_id", "region_id", "patch", "k1", "k2"), ["image_id", "region_id"]).withColumn("small", F.lit(True))
        staying = pixels.join(ends, ["image_id", "region_id"], "left_anti").withColumn("patch", F.lit(None).cast("long"))
        around = _rim(inner, staying, "patch").withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long"), "small": F.lit(False)})
        cells = inner.unionByName(around.select(inner.columns)).join(rgb, "label", "left").drop("first")
        cells = cells.repartition("image_id", "patch").sortWithinPartitions("image_id", "patch")
        new = cells.mapInPandas(_in_order(least), "image_id string, pid long, label int")

        # of larger ones the facets beside which none can come to go earlier
        wide = patched.where(F.col("pixels") > patch)
        if not wide.isEmpty():
            early = _earliest(wide, least)
            own = F.struct("k1", "k2")
            other = beside.join(early.select("image_id", F.col("region_id").alias("dst"), "early"), ["image_id", "dst"])
            held = wide.select("image_id", F.col("region_id").alias("src"), own.alias("own")).join(other, ["image_id", "src"]).where("early < own").select("image_id", F.col("src").alias("region_id")).distinct()
            free = wide.select("image_id", "region_id").join(held, ["image_id", "region_id"], "left_anti")
            new = new.unionByName(nearest_border(pixels, free, palette).select("image_id", "pid", "label"))
        after = _changed(pixels, new)
        # images without a larger patch are through
        images = materialize(wide.select("image_id").distinct())
        done.append(materialize(after.join(images, "image_id", "left_anti")))
        spent, open_ = open_, materialize(after.join(images, "image_id", "left_semi"))
        release(pixels, near, facets, small, patched, after, images, *[spent] * written)
        written = True
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _window(least: int, large_first: bool, rows: int, columns: int):
    """Work of in_tiles: the facets of a window go in order as far as that doesn't hang on what lies beyond it, of which it sees one pixel.

    Facets are told apart by their first pixel. Those of before are the pixels of one label that never changed (kept), so that each window knows
    their areas, but for those that its edge cuts. stays marks pixels of facets that earlier rounds found to stay, left what has yet to go, needed what the next round reads.
    """

    def run(table, own, at):
        import numpy as np
        import pyarrow as pa

        pid = table.column("pid").to_numpy()
        order = np.argsort(pid, kind="stable")  # places in the order of pixels, whose numbers they stand for
        rank = np.empty(len(pid), np.int64)
        rank[order] = np.arange(len(pid))
        table, own, at, n = table.take(order), np.sort(rank[own]), np.where(at >= 0, rank[at], -1), len(pid)
        x, y, label, kept, stays = (table.column(c).to_numpy() for c in ("x", "y", "label", "kept", "stays"))
        mine = np.zeros(n, bool)
        mine[own] = True
        i, j = (v - v.min() + 1 for v in (y, x))
        near = np.stack([at[i + dy, j + dx] for dx, dy in _NEXT])
        p, q = np.tile(np.arange(n), 2), np.concatenate([near[1], near[3]])
        same = (q >= 0) & (label[p] == label[q])
        p, q = p[same], q[same]
        whole = least_joined(n, p, q)
        before = least_joined(n, p[kept[p] & kept[q]], q[kept[p] & kept[q]])
        small = ~((np.bincount(whole, minlength=n) >= least) | (np.bincount(whole, stays, n) > 0))[whole]
        hidden = small & ~mine
        first = np.full(n, n)
        np.minimum.at(first, whole[kept], np.flatnonzero(kept))
        name = np.where(first < n, first, np.arange(n))[whole]
        area = np.bincount(before[kept], minlength=n)
        at_place = -area * (n + 1) + np.arange(n) if large_first else area * (n + 1) - np.arange(n)

        facet = [f if s else None for f, s in zip(name.tolist(), (small & mine).tolist())]
        place = dict(enumerate(at_place.tolist()))
        cut = set(name[hidden].tolist())
        beside = list(zip(*near.tolist()))
        for k in np.flatnonzero((near < 0).any(axis=0)).tolist():
            beside[k] = tuple(j for j in beside[k] if j >= 0)

        # x and y up to which all is seen: the window's edges, but where nothing that may change lies beyond
        bounds = []
        for v, size in ((x, columns), (y, rows)):
            low = v[own[:1]].sum().item() // size * size
            bounds += [low if (v[hidden] < low).any() else -np.inf, low + size - 1 if (v[hidden] >= low + size).any() else np.inf]
        xs, ys, labels = x.tolist(), y.tolist(), label.tolist()
        cells: dict[tuple, list] = {}

        def lay():
            """Facets of before by label and by the cells, as wide as least, that their box meets."""
            k = np.flatnonzero(kept & small)
            box = [v.copy() for v in (x, x, y, y)]
            for b, v, f in zip(box, (x, x, y, y), (np.minimum, np.maximum) * 2):
                f.at(b, before[k], v[k])
            cut_before = np.zeros(n, bool)
            cut_before[before[k[hidden[k]]]] = True
            roots = k[before[k] == k]
            for g, x1, x2, y1, y2, of, a, at_k, lost in zip(roots.tolist(), *(v[roots].tolist() for v in (*box, label, area, at_place, cut_before))):
                for cx in range(x1 // least, x2 // least + 1):
                    for cy in range(y1 // least, y2 // least + 1):
                        cells.setdefault((of, cx, cy), []).append((g, x1, x2, y1, y2, a, None if lost else at_k))

        def early(f, members, now):
            """A facet takes the place of an earlier one of its label that it meets. Both, and the pixels between them, are then fewer than least,
            so their boxes are no further apart than the pixels that are left to it. One that isn't seen whole may be the first of its area."""
            if f in cut:
                return now
            room = least - len(members)
            if room < 3:
                return place[f]
            soonest = min(place[f], max(now, -(room - 2) * (n + 1) - 1)) if large_first else now
            fx, fy = [xs[i] for i in members], [ys[i] for i in members]
            x1, x2, y1, y2 = min(fx), max(fx), min(fy), max(fy)
            reach = room - 1
            if x1 - reach < bounds[0] or x2 + reach > bounds[1] or y1 - reach < bounds[2] or y2 + reach > bounds[3]:
                return soonest
            if not cells:
                lay()
            best = place[f]
            for cx in range((x1 - reach) // least, (x2 + reach) // least + 1):
                for cy in range((y1 - reach) // least, (y2 + reach) // least + 1):
                    for g, gx1, gx2, gy1, gy2, a, k in cells.get((labels[members[0]], cx, cy), ()):
                        if (k is None or (g < f and now < k < best)) and max(0, gx1 - x2, x1 - gx2) + max(0, gy1 - y2, y1 - gy2) <= room - a:
                            best = min(best, soonest) if k is None else k
            return best

        k = np.unique(label, return_index=True)[1]
        rgb = dict(zip(label[k].tolist(), zip(*(table.column(c).to_numpy()[k].tolist() for c in "rgb"))))
        unknown = bytearray(hidden.astype(np.uint8).tobytes())
        moved = np.fromiter(_in_turn(labels, facet, beside, place, least, _distance(rgb), unknown, early), np.int64)
        kept = kept.copy()
        kept[moved] = False
        left = np.frombuffer(unknown, np.uint8).astype(bool)
        # pixels beside another window's go on though they may stay: from there less of their facet may be seen
        needed = left | ((near >= 0) & (left | ~(mine | stays))[near]).any(axis=0)
        new = {"label": pa.array(labels, pa.int32()), "kept": pa.array(kept), "stays": table.column("stays"), "left": pa.array(left), "needed": pa.array(needed)}
        return pa.table({c: table.column(c) for c in ("image_id", "x", "y", "pid")} | new).take(own)

    return run


def _through_windows(raster: DataFrame, palette: DataFrame, least: int, large_first: bool) -> DataFrame:
    """Raster (image_id, x, y, pid, label) after all small facets have gone in the order of their places, with first, the number of pixels that kept their label.

    Facets near the edges of windows wait for the next round, whose windows lie a third further and which reads only what waits and the pixels beside it. Windows are
    12 times as wide as least, so in one of three rounds the first of all waiting facets goes; many rounds come only of long chains of facets, each waiting for one before.
    """
    rows, columns = WINDOW
    rgb = palette.select("label", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    cast = [F.col(c).cast(t).alias(c) for c, t in (("x", "int"), ("y", "int"), ("pid", "long"), ("label", "int"))]
    open_ = raster.select("image_id", *cast, F.lit(True).alias("kept"), F.lit(False).alias("stays"))
    out, step = None, 0
    while True:
        by = {"x": step % 3 * columns // 3, "y": step % 3 * rows // 3}
        laid = open_.withColumns({c: F.col(c) + n for c, n in by.items()}).join(rgb, "label", "left")
        worked = in_tiles(laid, _window(least, large_first, rows, columns), "image_id string, x int, y int, pid long, label int, kept boolean, stays boolean, left boolean, needed boolean", rows=rows, columns=columns)
        worked = materialize(worked.withColumns({c: F.col(c) - n for c, n in by.items()}))
        done = worked.where("NOT stays AND NOT left").select("image_id", "x", "y", "pid", "label", F.expr("CASE WHEN kept THEN pid END").alias("first"))
        out = done if out is None else out.unionByName(done)
        if worked.where("left").isEmpty():
            return out
        open_ = worked.where("needed").select("image_id", "x", "y", "pid", "label", "kept", (~F.col("left")).alias("stays"))
        step += 1


def _down_to(raster: DataFrame, palette: DataFrame, most: int) -> DataFrame:
    """Raster after the smallest facets have gone, one after the other, until an image has no more than most.

    Areas only grow, so a facet with none of an earlier place beside it goes before any that could change it. Of these, those go in a round
    that go for certain: what goes before one joins no more facets than it and its neighbours are.
    """
    written = False
    while True:
        pixels = materialize(_known(raster))
        near, facets = _tables(pixels)
        key = F.struct("area", (-F.col("region_id")).alias("k"))
        known = facets.select("image_id", "region_id", key.alias("key"))
        others = near.join(known.select("image_id", F.col("region_id").alias("dst"), F.col("key").alias("other")), ["image_id", "dst"]).groupBy("image_id", F.col("src").alias("region_id")).agg(F.min("other").alias("other"))
        known = known.join(others, ["image_id", "region_id"])
        # each facet counts from the first place beside it, or its own
        line = known.select("image_id", F.least("key", "other").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("region_id")).unionByName(known.where("key < other").select("image_id", F.col("key").alias("at"), F.lit(0).alias("n"), "region_id"))
        before = F.sum("n").over(Window.partitionBy("image_id").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("n").over(Window.partitionBy("image_id"))
        chosen = materialize(line.select("image_id", "region_id", before.alias("before"), total.alias("total")).where(F.col("region_id").isNotNull() & (F.col("total") - F.col("before") > most)).select("image_id", "region_id"))
        if chosen.isEmpty():
            release(pixels, near, facets, chosen)
            return raster
        after = _changed(pixels, nearest_border(pixels, chosen, palette))
        release(pixels, near, facets, chosen, *[raster] * written)
        raster, written = after, True


def reduce_facets(raster: DataFrame, palette: DataFrame, least: int, most: int | None = None, large_first: bool = True, patch: int = PATCH) -> DataFrame:
    """image_id, x, y, pid, label without facets smaller than least, then with no more than most facets, the smallest of which go first.

    Small facets go in the order of their first size, from the large ones down (large_first) or up, of equals the earlier number or the later one first; one
    that has grown to least by then stays. A facet without neighbours stays. The result is that of one deletion after the other.
    """
    start = raster.select("image_id", "x", "y", "pid", "label")
    rest = start.where("NOT coalesce(label >= 0, false)")
    if WINDOW[0] * WINDOW[1] <= patch and 12 * least <= min(WINDOW):
        out = _through_windows(start.where("label >= 0"), palette, least, large_first)
    else:
        first = region_map(start, 4).select("image_id", "pid", F.col("region_id").alias("first"))
        out = materialize(start.where("label >= 0").join(first, ["image_id", "pid"], "left"))
        out = _without_small(out, palette, least, large_first, patch)
    if most is not None:
        out = _down_to(out, palette, max(1, most))
    return out.drop("first").unionByName(rest).select("image_id", "x", "y", "pid", "label")
