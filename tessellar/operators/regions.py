"""Regions of a label raster: components, adjacency, merging, boundaries, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import colour as C
from ..sources.store import materialize, numbered, release
from .graph import components, roots


def along_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def beside(c: str, along: str, step: int):
    """c of the pixel one step along x or y; null where there is none, as at the edge or a gap."""
    w, f = (along_row() if along == "x" else along_column()), (F.lead if step > 0 else F.lag)
    return F.when(f(along).over(w) == F.col(along) + step, f(c).over(w))


#: Rows and columns of the tiles that neighbours are looked up in.
TILE_ROWS, TILE_COLUMNS = 256, 1024
STEPS = {"l": (-1, 0), "r": (1, 0), "u": (0, -1), "d": (0, 1), "ul": (-1, -1), "ur": (1, -1), "dl": (-1, 1), "dr": (1, 1)}


def in_tiles(pixels: DataFrame, work: Callable, schema: str | StructType, margin: int = 1, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """work(table, own, at) -> table of schema, for the pixels of each tile of an image and those up to margin beyond it.

    own are the places in table of the tile's own pixels; at is a grid of the places of all, -1 where there is none, with a rim of margin -1. A grid
    is as large as a tile, so neither a tall nor a wide image is one task's work.
    """

    def to(c, n):
        k = F.floor(F.col(c) / n).cast("int")
        return F.when(F.pmod(c, F.lit(n)) < margin, F.array(k - 1, k)).when(F.pmod(c, F.lit(n)) >= n - margin, F.array(k, k + 1)).otherwise(F.array(k))

    def run(table):
        import numpy as np

        x, y = (table.column(c).to_numpy() for c in "xy")
        tx, ty = (table.column(c)[0].as_py() for c in ("_tx", "_ty"))
        low_x, low_y = x.min(), y.min()
        at = np.full((y.max() - low_y + 1 + 2 * margin, x.max() - low_x + 1 + 2 * margin), -1)
        at[y - low_y + margin, x - low_x + margin] = np.arange(len(x))
        return work(table.drop_columns(["_tx", "_ty"]), np.flatnonzero((x // columns == tx) & (y // rows == ty)), at)

    laid = pixels.select("*", F.explode(to("y", rows)).alias("_ty")).select("*", F.explode(to("x", columns)).alias("_tx"))
    return laid.groupBy("image_id", "_tx", "_ty").applyInArrow(run, schema)


def places_beside(table, own, at, names) -> list:
    """Of each own pixel the places of those beside it (names of STEPS), -1 for none. A diagonal is seen through the pixel above or below."""
    import numpy as np

    x, y = (table.column(c).to_numpy() for c in "xy")
    i, j = (v[own] - v.min() + 1 for v in (y, x))
    found = {n: at[i + STEPS[n][1], j + STEPS[n][0]] for n in {*names, *(n[0] for n in names)}}
    return [found[n] if len(n) == 1 else np.where(found[n[0]] >= 0, found[n], -1) for n in names]


def with_beside(pixels: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """pixels with key of the pixels beside each, in columns of these names (of STEPS); null where there is none."""

    def run(table, own, at):
        import pyarrow as pa

        mine, keys = table.take(own), table.column(key)
        for n, place in zip(names, places_beside(table, own, at, names)):
            mine = mine.append_column(n, keys.take(pa.array(place, mask=place < 0)))
        return mine

    return in_tiles(pixels, run, StructType([*pixels.schema.fields, *[StructField(n, pixels.schema[key].dataType) for n in names]]))


#: Rows of an image that one task joins into regions.
BAND = 256


def least_joined(n: int, p, q):
    """Of each of n places the least that it is joined to by the pairs (p, q), whole arrays at a time."""
    import numpy as np

    least = np.arange(n)
    while len(p):
        low = np.minimum(least[p], least[q])
        for end in (p, q):  # only the first place of a tree is hung on another: every other one stays with it
            np.minimum.at(least, least[end], low)
        while True:
            further = least[least]
            if (further == least).all():
                break
            least = further
        open_ = least[p] != least[q]
        p, q = p[open_], q[open_]
    return least


def _band_roots(connectivity: int):
    """Pixels of one band of rows with root, the least pid that is connected to each inside the band."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        x, y, label, pid = (table.column(c).to_numpy() for c in ("x", "y", "label", "pid"))
        x, y = x - x.min(), y - y.min()
        at = np.full((y.max() + 1, x.max() + 1), -1)
        at[y, x] = np.arange(len(x))
        pairs = []
        for dy, dx in [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8):
            h, w = at.shape
            p, q = at[: h - dy, max(0, -dx) : w - max(0, dx)].ravel(), at[dy:, max(0, dx) : w + min(0, dx)].ravel()
            both = (p >= 0) & (q >= 0)
            p, q = p[both], q[both]
            same = label[p] == label[q]
            pairs.append((p[same], q[same]))
        p, q = (np.concatenate(c) for c in zip(*pairs))
        order = np.argsort(pid, kind="stable")
        rank = np.empty(len(pid), np.int64)
        rank[order] = np.arange(len(pid))
        least = least_joined(len(pid), rank[p], rank[q])
        return table.drop_columns(["band"]).append_column("root", pa.array(pid[order[least[rank]]]))

    return run


def region_map(raster: DataFrame, connectivity: int = 8, band: int = BAND) -> DataFrame:
    """Pixels with region_id; regions are numbered by colour, then by first pixel (connectivity 8), or by first pixel alone (4).

    Regions are joined inside bands of rows, one task each; what meets across the edge of two bands is joined by rounds over
    those edges alone. Numbers are given to regions, not to pixels, by ranges of their order. Pixels without a label have no region.
    """
    px = raster.where("label >= 0").select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("pid").cast("long").alias("pid"), F.col("label").cast("int").alias("label"), F.floor(F.col("y") / band).cast("int").alias("band"))
    inner = materialize(px.groupBy("image_id", "band").applyInArrow(_band_roots(connectivity), "image_id string, x int, y int, pid long, label int, root long"))
    top = inner.where(F.pmod(F.col("y"), F.lit(band)) == 0)
    offsets = [0] if connectivity == 4 else [-1, 0, 1]
    above = inner.where(F.pmod(F.col("y"), F.lit(band)) == band - 1).select("image_id", "label", (F.col("y") + 1).alias("y"), F.explode(F.array(*[F.col("x") + d for d in offsets])).alias("x"), F.struct("image_id", "root").alias("a"))
    edges = top.join(above, ["image_id", "label", "x", "y"]).select("a", F.struct("image_id", "root").alias("b"))
    found = components(edges).select(F.col("v.image_id").alias("image_id"), F.col("v.root").alias("root"), F.col("label.root").alias("whole"))
    found = materialize(found)
    order = ["label", "root"] if connectivity == 8 else ["root"]
    # a region has one pixel that is its root: those of bands without the ones that met a lower one
    first = inner.where("pid = root").select("image_id", "label", "root").join(found.where("root != whole"), ["image_id", "root"], "left_anti")
    ids = numbered(first.select("image_id", "label", "root"), "image_id", order, "region_id").select("image_id", "root", (F.col("region_id") - 1).alias("region_id"))
    # numbers of the roots of bands, then of their pixels
    joined = found.where("root != whole").join(ids.withColumnRenamed("root", "whole"), ["image_id", "whole"]).select("image_id", "root", "region_id")
    return inner.join(ids.unionByName(joined), ["image_id", "root"]).select("image_id", "x", "y", "pid", "label", "region_id")


def region_table(pixels: DataFrame) -> DataFrame:
    """Colour, area and half-open box of each region."""
    return pixels.groupBy("image_id", "region_id").agg(F.min("label").alias("color_index"), F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))


def border_pairs(pixels: DataFrame, key: str = "region_id") -> DataFrame:
    """src, dst, border_count, src the smaller one: pairs of pixels side by side with different keys."""

    def counted(table, own, at):
        import numpy as np
        import pyarrow as pa

        keys, known = table.column("a").fill_null(0).to_numpy(), table.column("a").is_valid().to_numpy()
        beside = places_beside(table, own, at, ("r", "d"))
        p, q = np.concatenate([own, own]), np.concatenate(beside)
        met = (q >= 0) & known[p] & known[q] & (keys[p] != keys[q])
        a, b = keys[p[met]], keys[q[met]]
        src, dst = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.append(True, (np.diff(src) != 0) | (np.diff(dst) != 0))[: len(src)])
        n = np.diff(np.append(first, len(src))).astype(np.int64)
        image = pa.array([table.column("image_id")[0].as_py()] * len(n), pa.string())
        return pa.table({"image_id": image, "src": src[first], "dst": dst[first], "n": n})

    p = pixels.select("image_id", "x", "y", F.col(key).alias("a"))
    kind = p.schema["a"].dataType.simpleString()
    return in_tiles(p, counted, f"image_id string, src {kind}, dst {kind}, n bigint").groupBy("image_id", "src", "dst").agg(F.sum("n").alias("border_count"))


def adjacency(pixels: DataFrame, key: str = "region_id") -> DataFrame:
    """src, dst, border_count in both directions: pairs of pixels side by side with different keys, looked up once."""
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("e")
    return border_pairs(pixels, key).select("image_id", both, "border_count").select("image_id", "e.src", "e.dst", "border_count")


def boundary_mask(pixels: DataFrame, key: str = "region_id") -> DataFrame:
    """Pixels whose right or lower neighbour has another key; null keys are no region."""
    other = [F.coalesce(F.col(n) != F.col(key), F.lit(False)) for n in "rd"]
    return with_beside(pixels.select("image_id", "x", "y", key), key, ("r", "d")).select("image_id", "x", "y", (other[0] | other[1]).alias("boundary"))


def border_points(pixels: DataFrame, key: str = "label") -> DataFrame:
    """Pixels that lack one of four neighbours of their key; the image's edge counts."""
    same = [F.coalesce(F.col(n) == F.col(key), F.lit(False)) for n in "lrud"]
    return with_beside(pixels.select("image_id", "x", "y", key), key, ("l", "r", "u", "d")).where(~(same[0] & same[1] & same[2] & same[3])).select("image_id", "x", "y", key)


def thickness():
    return F.col("area") / F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def merge_candidates(regions: DataFrame, min_area: int | Column) -> DataFrame:
    return regions.where((F.col("area") < min_area) | ((F.col("area") <= 2 * min_area) & (thickness() <= 5.5)))


def merge_plan(regions: DataFrame, neighbours: DataFrame, palette: DataFrame, min_area: int | Column) -> DataFrame:
    """src, dst of each candidate region: its best neighbour, by (no candidate, larger, longest border, largest area, nearest colour, id)."""
    from .palette import by

    lab = palette.select(*by(palette), F.col("label").alias("color_index"), F.array(*C.lab8(F.col("r"), F.col("g"), F.col("b"))).alias("lab"))
    marked = regions.join(merge_candidates(regions, min_area).select("image_id", "region_id", F.lit(1).alias("c")), ["image_id", "region_id"], "left").join(lab, by(palette, "color_index")).select("image_id", "region_id", "area", F.coalesce("c", F.lit(0)).alias("c"), "lab")
    s = marked.where("c = 1").select("image_id", F.col("region_id").alias("src"), F.col("area").alias("s_area"), F.col("lab").alias("s_lab"))
    d = marked.select("image_id", F.col("region_id").alias("dst"), "area", "c", "lab")
    options = neighbours.join(s, ["image_id", "src"]).join(d, ["image_id", "dst"]).withColumn("far", F.round(C.euclidean(F.col("lab"), F.col("s_lab")), 6))
    options = options.where("(c = 0 OR area > s_area OR area = s_area AND dst > src) AND (far <= 26.0 OR s_area <= 8)")
    rank = F.struct(F.col("c"), F.when(F.col("area") > F.col("s_area"), 0).otherwise(1).alias("small"), (-F.col("border_count")).alias("b"), (-F.col("area")).alias("a"), "far", F.col("dst").alias("id"))
    return options.groupBy("image_id", "src").agg(F.min(rank).alias("m")).select("image_id", "src", F.col("m.id").alias("dst"))


def apply_merges(pixels: DataFrame, regions: DataFrame, plan: DataFrame) -> DataFrame:
    """Pixels with the colour of the region at the end of their region's chain of merges."""
    pairs = plan.select(F.struct("image_id", F.col("src").alias("id")).alias("src"), F.struct("image_id", F.col("dst").alias("id")).alias("dst"))
    to = roots(pairs).select(F.col("src.image_id").alias("image_id"), F.col("src.id").alias("region_id"), F.col("root.id").alias("root"))
    colour = regions.select("image_id", F.col("region_id").alias("root"), F.col("color_index").alias("new"))
    moved = to.join(colour, ["image_id", "root"]).select("image_id", "region_id", "new")
    return pixels.join(moved, ["image_id", "region_id"], "left").select("image_id", "x", "y", "pid", F.coalesce("new", "label").cast("int").alias("label"))


def merged_regions(raster: DataFrame, palette: DataFrame, min_area: int | DataFrame, passes: int = 3) -> DataFrame:
    """Up to so many passes of regions, plan, merge and strip cleanup, until neither changes anything; up to min_area 1 nothing is done.

    min_area is one for all images or a table (image_id, min_area). Pixels without a label keep their place and get label -1.
    """
    from .cleanup import strip_cleanup

    raster = raster.select("image_id", "x", "y", "pid", F.coalesce("label", F.lit(-1)).alias("label"))
    if isinstance(min_area, int):
        min_area = raster.select("image_id").distinct().withColumn("min_area", F.lit(min_area))
    min_area = materialize(min_area.select("image_id", "min_area"))
    still = raster.join(min_area.where("min_area <= 1"), "image_id", "left_semi")
    raster = raster.join(min_area.where("min_area > 1"), "image_id", "left_semi")
    for k in range(passes):
        pixels = materialize(region_map(raster))
        regions = materialize(region_table(pixels).join(min_area, "image_id"))
        plan = materialize(merge_plan(regions, adjacency(pixels), palette, F.col("min_area")))
        merged = raster if plan.isEmpty() else materialize(apply_merges(pixels, regions, plan).unionByName(raster.where("label < 0")))
        cleaned = strip_cleanup(merged, palette, 4)
        done = plan.isEmpty()
        before = raster.select("image_id", "pid", F.col("label").alias("old"))
        # a plan goes on to the next pass whatever changed
        changed = not done or not cleaned.join(before, ["image_id", "pid"]).where("label != old").isEmpty()
        release(pixels, regions, plan, *[] if done else [merged], *[raster] * (k > 0 and not done))
        raster = cleaned
        if not changed and done:
            break
    return raster.unionByName(still)


def merge_small_regions(raster: DataFrame, palette: DataFrame, min_area: int | DataFrame, passes: int = 3) -> DataFrame:
    """merged_regions() with compact labels."""
    from .palette import compacted

    return compacted(merged_regions(raster, palette, min_area, passes), palette)


def merge_order(regions: DataFrame, min_area: int) -> DataFrame:
    """Candidates in the order in which they are looked at: by area, then number."""
    candidates = merge_candidates(regions, min_area).select("image_id", "region_id", "area")
    return numbered(candidates, "image_id", ["area", "region_id"], "place").withColumn("place", F.col("place").cast("int"))


def size_order(regions: DataFrame) -> DataFrame:
    """All regions from the largest down, of equals the first number first."""
    return numbered(regions.select("image_id", "region_id", "area"), "image_id", [F.desc("area"), F.asc("region_id")], "place").withColumn("place", F.col("place").cast("int"))


def label_worthy(regions: DataFrame, min_area: int) -> DataFrame:
    return regions.where(F.col("area") >= min_area)


def effective_min_area(pixels: int, requested: int) -> int:
    return max(requested, round(0.00025 * pixels))


def paintability(regions: DataFrame, sizes: DataFrame, min_area: int, merge_area: int | None = None, coloured_edges: bool = False, auto_colours: bool = False) -> DataFrame:
    """Colours, counts and extreme areas of the regions of each image of sizes (image_id, width, height), zeros where it has none, and the settings they were made with."""
    n = F.col("area") >= min_area
    whole = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    all_ = sizes.select("image_id", "width", "height").join(regions.select("image_id", "region_id", "color_index", "area"), "image_id", "left")
    return all_.groupBy("image_id").agg(
        F.max("width").cast("long").alias("width"), F.max("height").cast("long").alias("height"),
        F.countDistinct("color_index").alias("colors"), F.count("region_id").alias("regions_total"), F.count_if(n).alias("regions_numbered"), F.count_if(~n).alias("regions_too_small_for_label"), F.lit(min_area).cast("long").alias("min_label_area"),
        whole(F.min("area"), "smallest_region"), whole(F.max("area"), "largest_region"), F.bround(F.coalesce(F.median("area"), F.lit(0.0)), 3).alias("median_region_area"),
        whole(F.min(F.when(n, F.col("area"))), "smallest_numbered_region"), whole(F.max(F.when(~n, F.col("area"))), "largest_unnumbered_region"),
        F.lit(True).alias("small_area_merging"), F.lit(min_area if merge_area is None else merge_area).cast("long").alias("small_region_merge_area"), F.lit(coloured_edges).alias("colored_edges_written"), F.lit(auto_colours).alias("auto_color_count"),
    )


def _lowest_parabolas(y, g2, start):
    """For each of consecutive values y of a run (start: where runs begin) the least of (y - k)**2 + g2[k] over the run's k, its ends included, where 0 stands one beyond.

    The place of the least never falls as y grows. So the places of every second y, then of those between, are looked for between the
    places already known on either side: whole arrays at a time, as many rounds as a run's length has bits.
    """
    import numpy as np

    n = np.diff(np.append(start, len(y)))
    run = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(y)) - start[run] + 1
    # candidates of a run: one before it, its own, one after it
    at = np.zeros(len(y) + 2 * len(n), np.int64)
    value = np.zeros(len(at), np.int64)
    own = np.arange(len(y)) + 2 * run + 1
    at[own], value[own] = y, g2
    first, last = own[start] - 1, own[start + n - 1] + 1
    at[first], at[last] = y[start] - 1, y[start + n - 1] + 1
    place, best = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    step = 1 << int(n.max()).bit_length()
    while step:
        k = np.flatnonzero(i % (2 * step) == step)
        if len(k):
            low = np.where(i[k] > step, place[k - np.minimum(step, i[k] - 1)], first[run[k]])
            after = i[k] + step <= n[run[k]]
            high = np.where(after, place[np.where(after, k + step, k)], last[run[k]])
            count = high - low + 1
            begin = np.cumsum(count) - count
            j = np.arange(int(count.sum())) + np.repeat(low - begin, count)
            far = (np.repeat(y[k], count) - at[j]) ** 2 + value[j]
            best[k] = np.minimum.reduceat(far, begin)
            place[k] = np.minimum.reduceat(np.where(far == np.repeat(best[k], count), j, len(at)), begin)
        step //= 2
    return best


def edge_distance(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, region_id, d2: the square of each pixel's exact distance to the nearest pixel or place outside its region.

    Distances along rows come from windows. Then each column's runs of one region are worked out on their own: the square is the least over
    the run's pixels of the square of the way along the column and that along the row, the lower envelope of a parabola for each pixel. Rows are as many as pixels; a task
    holds the columns of a batch and the one that it ends in.
    """
    ahead, back = along_row().rowsBetween(0, Window.unboundedFollowing), along_row().rowsBetween(Window.unboundedPreceding, 0)
    near = lambda f, step: F.coalesce((f("region_id").over(along_row()) == F.col("region_id")) & (f("x").over(along_row()) == F.col("x") + step), F.lit(False))
    p = pixels.select("image_id", "x", "y", "region_id", F.when(~near(F.lead, 1), F.col("x")).alias("e"), F.when(~near(F.lag, -1), F.col("x")).alias("s"))
    p = p.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("region_id").cast("long").alias("region_id"), (F.least(F.first("e", True).over(ahead) - F.col("x"), F.col("x") - F.last("s", True).over(back)) + 1).cast("long").alias("g"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def worked(table):
            x, y, region, g = (table.column(c).to_numpy() for c in ("x", "y", "region_id", "g"))
            image = table.column("image_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = (np.diff(image) != 0) | (np.diff(x) != 0) | (np.diff(region) != 0) | (np.diff(y) != 1)
            d2 = _lowest_parabolas(y, g * g, np.concatenate([[0], np.flatnonzero(new) + 1]))
            return table.drop_columns(["g"]).append_column("d2", pa.array(d2)).combine_chunks().to_batches()

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            image, x = batch.column(0), batch.column(1).to_numpy()
            end, last = batch.num_rows, (image[-1], x[-1])
            # the column that the batch ends in may go on
            cut = int(np.searchsorted(-((x != x[-1]) | ~np.asarray(pa.compute.equal(image, image[-1]))).astype(int), 0))
            if cut or (held and (held[-1].column(0)[-1], held[-1].column(1)[-1].as_py()) != last):
                done = [*held, batch.slice(0, cut)] if cut else held
                yield from worked(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(cut, end - cut))
        if held:
            yield from worked(pa.Table.from_batches(held))

    columns = p.repartition("image_id", "x").sortWithinPartitions("image_id", "x", "y")
    return columns.mapInArrow(run, "image_id string, x long, y long, region_id long, d2 long").select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "region_id", "d2")


def label_points(pixels: DataFrame) -> DataFrame:
    """The pixel of each region farthest from anything else (exact distance), first in raster order, and that distance."""
    dist = edge_distance(pixels)
    best = F.max(F.struct("d2", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("m")
    return dist.groupBy("image_id", "region_id").agg(best).select("image_id", "region_id", (-F.col("m.nx")).alias("x"), (-F.col("m.ny")).alias("y"), F.round(F.sqrt("m.d2"), 6).alias("radius"))
