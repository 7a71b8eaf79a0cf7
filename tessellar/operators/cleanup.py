"""Neighbourhood cleaning of label rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import colour as C
from ..sources.store import materialize, release
from .palette import by
from .regions import STEPS, in_tiles, places_beside, with_beside

HARD_EDGE = 26.0


def around(raster: DataFrame, diagonals: bool = True) -> DataFrame:
    """Labels of the neighbours: l, r, u, d and, of the rows above and below, ul, ur, dl, dr.

    A raster has a row for every pixel, label -1 or null where there is none: a diagonal is seen through the pixel beside it."""
    return with_beside(raster.select("image_id", "x", "y", "pid", "label"), "label", tuple(STEPS) if diagonals else ("l", "r", "u", "d"))


def _between(raster: DataFrame) -> DataFrame:
    """Pixels with t0 to t3: the label, if it is another one, on both sides along the row, the column, and the two diagonals; null for none, and at the edge.

    Three equal neighbours are two opposite ones and one more: they would say the same.
    """

    def run(table, own, at):
        import numpy as np
        import pyarrow as pa

        column = table.column("label")
        # one more place, for none: unknown labels and absent pixels are no label to take
        label = column.fill_null(-1).to_numpy()
        label = np.append(label, label.dtype.type(-1))
        known = np.append(column.is_valid().to_numpy(), False)
        l, r, u, d, ul, ur, dl, dr = places_beside(table, own, at, ("l", "r", "u", "d", "ul", "ur", "dl", "dr"))
        inside = known[l] & known[r] & known[u] & known[d] & known[own]
        mine = table.take(own)
        for k, (p, q) in enumerate(((l, r), (u, d), (ul, dr), (ur, dl))):
            t = label[p]
            mine = mine.append_column(f"t{k}", pa.array(t, mask=~(inside & (t >= 0) & (t == label[q]) & (t != label[own]))))
        return mine

    p = raster.select("image_id", "x", "y", "pid", "label")
    return in_tiles(p, run, StructType([*p.schema.fields, *[StructField(f"t{k}", p.schema["label"].dataType) for k in range(4)]]))


def _stripped(raster: DataFrame, palette: DataFrame) -> DataFrame:
    """What strip_once() gives, with old, the label before."""
    lab = palette.select(*by(palette, "label"), F.array(*C.lab8(F.col("r"), F.col("g"), F.col("b"))).alias("lab"))
    counts = raster.where("label >= 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    n = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("ns"))
    # of each label, the labels near enough to replace it; the palette bounds the pairs
    other = lab.select(*by(palette), F.col("label").alias("to"), F.col("lab").alias("lab2"))
    met = lab.join(other, by(palette)) if by(palette) else lab.join(other)
    near = met.where(C.euclidean(F.col("lab"), F.col("lab2")) <= HARD_EDGE).groupBy(*by(palette, "label")).agg(F.collect_set("to").alias("near"))
    near = near if by(palette) else F.broadcast(near)  # by label alone, all pixels of a label would be one task's
    p = _between(raster).join(near, by(palette, "label"), "left").join(n, "image_id", "left")
    options = []
    for k in range(4):
        t = F.col(f"t{k}")
        options.append(F.when(t.isNotNull() & F.coalesce(F.array_contains("near", t), F.lit(False)), F.struct(F.try_element_at("ns", t).alias("n"), F.lit(-k).alias("k"), t.alias("t"))))
    some = F.coalesce(*[F.col(f"t{k}") for k in range(4)]).isNotNull()
    best = F.when(some, F.array_max(F.array(*options)))
    return p.select("image_id", "x", "y", "pid", F.coalesce(best.t, "label").alias("label"), F.col("label").alias("old"))


def strip_once(raster: DataFrame, palette: DataFrame) -> DataFrame:
    """One synchronous run: interior pixels between two or three equal neighbours of a near enough colour take the commonest of them.

    The patterns are tried in a fixed order; of equal counts the earlier pattern wins.
    """
    return _stripped(raster, palette).drop("old")


def strip_cleanup(raster: DataFrame, palette: DataFrame, runs: int) -> DataFrame:
    """Runs of strip_once until nothing changes."""
    raster = raster.select("image_id", "x", "y", "pid", "label")
    held = None
    for _ in range(runs):
        new = materialize(_stripped(raster, palette))
        release(*[held] * (held is not None))
        raster, held = new.drop("old"), new
        if new.where("NOT (old <=> label)").isEmpty():
            break
    if held is not None:
        raster._written_at = held._written_at
    return raster


def opening(raster: DataFrame) -> DataFrame:
    """Pixels with opened: whether the opening of their own label's mask by a plus of radius 1 keeps them. The edge does not erode."""
    p = around(raster, diagonals=False)
    same = F.lit(True)
    for c in "lrud":
        same &= F.coalesce(F.col(c) == F.col("label"), F.col(c).isNull())
    e = with_beside(p.select("image_id", "x", "y", "pid", "label", F.when(same, F.col("label")).alias("core")), "core", ("l", "r", "u", "d"))
    near = F.coalesce(F.col("core") == F.col("label"), F.lit(False))
    for c in "lrud":
        near |= F.coalesce(F.col(c) == F.col("label"), F.lit(False))
    return e.select("image_id", "x", "y", "pid", "label", near.alias("opened"))


def prune_protrusions(raster: DataFrame, steps: int = 12) -> DataFrame:
    """Labels whose opening is not empty lose what it removes; these and all unlabelled pixels fill from above, below, left, right in turn, so many times at most. Unfilled pixels have label -1."""
    opened = materialize(opening(raster.withColumn("label", F.coalesce("label", F.lit(-1)))))
    o = opened.join(opened.groupBy("image_id", "label").agg(F.max("opened").alias("has")), ["image_id", "label"])
    p = o.select("image_id", "x", "y", "pid", F.when(F.col("has") & ~F.col("opened"), -1).otherwise(F.col("label")).alias("label"))
    for done in range(0, max(1, steps), FILL):
        p, n = materialize(_filled(p, min(FILL, steps - done))), p
        release(*[n] * (done > 0))
    release(opened)
    return p


#: Steps of filling that are worked through at once.
FILL = 16


def _filled(raster: DataFrame, steps: int) -> DataFrame:
    """raster, where pixels with label -1 have taken one from above, below, left and right in turn, so many times."""

    def run(table, own, at):
        import numpy as np
        import pyarrow as pa

        label = table.column("label").to_numpy()
        label = np.append(label, label.dtype.type(-1))[at]
        for _ in range(steps):
            before = label.copy()
            for dx, dy in ((0, -1), (0, 1), (-1, 0), (1, 0)):
                beside = np.roll(label, (-dy, -dx), (0, 1))  # what comes in over the edge is rim, -1
                label = np.where((at >= 0) & (label < 0) & (beside >= 0), beside, label)
            if (label == before).all():
                break
        out = np.empty(table.num_rows, label.dtype)
        out[at[at >= 0]] = label[at >= 0]
        mine = table.take(own)
        return mine.set_column(mine.column_names.index("label"), "label", pa.array(out[own]))

    # a step looks up and down, left and right: two pixels each way
    return in_tiles(raster, run, raster.schema, 2 * steps) if steps > 0 else raster


def expand_owner(pixels: DataFrame, steps: int) -> DataFrame:
    """Unknown region_id (null) taken from the eight neighbours, all at once per step, in a fixed order of directions."""
    for _ in range(steps):
        p = around(pixels.withColumnRenamed("region_id", "label"))
        pixels = materialize(p.select("image_id", "x", "y", "pid", F.coalesce("label", "u", "d", "l", "r", "ul", "ur", "dl", "dr").alias("region_id")))
    return pixels


#: Side of the tiles of the cleanup in place.
TILE = 256


def _tile_in_place(pdf):
    """One tile with what lies around it: of the pixels of a diagonal none sees another, so they are worked out together, diagonal after diagonal."""
    import numpy as np

    x0, y0 = (int(pdf[c].iloc[0]) for c in ("tx", "ty"))
    side, w, h = (int(pdf[c].iloc[0]) for c in ("tile", "w", "h"))
    a = np.full((side + 2, side + 2), -1, np.int64)
    x, y = pdf.x.to_numpy() - x0 * side + 1, pdf.y.to_numpy() - y0 * side + 1
    names, index = np.unique(pdf.label.to_numpy(), return_inverse=True)
    a[y, x] = index
    unknown = np.flatnonzero(names < 0)
    for u in unknown:
        a[a == u] = -1
    rgb = np.full((len(names) + 1, 3), np.inf)
    rgb[index] = pdf[["r", "g", "b"]].to_numpy(float, na_value=np.inf)
    rgb[unknown] = np.inf

    def far(p, q):
        d = ((rgb[p] - rgb[q]) ** 2).sum(1)
        return np.where(np.isfinite(d), d, np.inf)

    for s in range(2 * side - 1):
        j = np.arange(max(0, s - side + 1), min(side - 1, s) + 1)
        i = s - j
        inner = (i + x0 * side > 0) & (i + x0 * side < w - 1) & (j + y0 * side > 0) & (j + y0 * side < h - 1)
        i, j = i[inner] + 1, j[inner] + 1
        c, up, down, left, right = a[j, i], a[j - 1, i], a[j + 1, i], a[j, i - 1], a[j, i + 1]
        some = (c >= 0) & ((c == up) | (c == down) | (c == left) | (c == right))
        tall = some & (c != up) & (c != down)
        flat = some & ~tall & (c != left) & (c != right)
        with np.errstate(invalid="ignore"):
            new = np.where(tall, np.where(far(up, c) < far(down, c), up, down), np.where(flat, np.where(far(left, c) < far(right, c), left, right), c))
        a[j, i] = np.where(new >= 0, new, c)
    own = (pdf.own & (pdf.label >= 0)).to_numpy()
    keep = pdf[pdf.own][["image_id", "x", "y", "pid", "label", "tx", "ty"]].copy()
    keep.loc[keep.label >= 0, "label"] = names[a[y[own], x[own]]]
    return keep


def strip_in_place(raster: DataFrame, palette: DataFrame, tile: int = TILE) -> DataFrame:
    """The other cleanup: pixels in raster order, each seeing what was changed before it, above and to the left, and what is still to come, below and to the right.

    All tiles are worked through at once, as if nothing changed above and to their left; then again those for which something did, from the last rows and
    columns as they have become, until no tile is left. What a tile gives depends on those only, so the end is that of one pixel after the other, at the
    latest after as many rounds as an image has diagonals of tiles. A pixel without a label stays as it is, and
    none becomes one; a label that the palette lacks is farther than any other.
    """
    rgb = palette.select("label", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    size = raster.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    base = raster.select("image_id", "x", "y", "pid", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))
    place = {c: F.floor(F.col(d) / tile).cast("int") for c, d in (("tx", "x"), ("ty", "y"))}

    def beyond(rows, step, *, own):
        """rows as seen by the tiles that they border on, after them (step 1) or before them (-1); own ones too."""
        edge = tile - 1 if step == 1 else 0
        to = [F.when(F.col(c) % tile == edge, F.struct(*[(F.col(t) + (step if t == m else 0)).alias(t) for t in ("tx", "ty")], F.lit(False).alias("own"))) for c, m in (("x", "tx"), ("y", "ty"))]
        to += [F.struct("tx", "ty", F.lit(True).alias("own"))] * own
        return rows.select("image_id", "x", "y", "pid", "label", F.explode(F.filter(F.array(*to), lambda t: t.isNotNull())).alias("t")).select("image_id", "x", "y", "pid", "label", "t.*").where("tx >= 0 AND ty >= 0")

    keys, schema = ["image_id", "tx", "ty"], "image_id string, x int, y int, pid long, label long, tx int, ty int"
    laid = base.withColumns(place)
    seen = materialize(beyond(laid, -1, own=True))
    # what each tile sees above and to its left
    tiles = seen.where("own").select(*keys).distinct()
    edges = materialize(beyond(laid, 1, own=False).join(tiles, keys, "left_semi"))
    open_ = materialize(tiles)
    done = []  # (tiles, their pixels) of each round
    while not open_.isEmpty():
        rows = seen.select("image_id", "x", "y", "pid", "label", "tx", "ty", "own").unionByName(edges.select("image_id", "x", "y", "pid", "label", "tx", "ty", "own")).join(open_, keys, "left_semi")
        cells = rows.join(size, "image_id").join(rgb, "label", "left").withColumn("tile", F.lit(tile))
        cells = cells.select("image_id", "x", "y", "pid", "label", "tx", "ty", "own", "w", "h", "r", "g", "b", "tile")
        out = materialize(cells.groupBy(*keys).applyInPandas(_tile_in_place, schema))
        done.append((open_, out))
        now = beyond(out, 1, own=False).select("image_id", "x", "y", "tx", "ty", F.col("label").alias("now"))
        spent, edges = edges, materialize(edges.join(now, ["image_id", "x", "y", "tx", "ty"], "left").select("image_id", "x", "y", "pid", F.coalesce("now", "label").alias("label"), "tx", "ty", "own", (F.col("now") != F.col("label")).alias("new")))
        release(spent)
        open_ = materialize(edges.where("new").select(*keys).distinct())
    release(seen, edges, open_)
    # of each tile the last time
    out = later = None
    for worked, part in reversed(done):
        kept = part if later is None else part.join(later, keys, "left_anti")
        out, later = (kept, worked) if out is None else (out.unionByName(kept), later.unionByName(worked))
    if out is None:
        out = laid
    return out.select("image_id", "x", "y", "pid", F.col("label").cast("int").alias("label"))


def bilateral(raster: DataFrame, d: int = 9, sigma_colour: float = 50.0, sigma_space: float = 50.0) -> DataFrame:
    """Edge-preserving means; d up to 1 changes nothing. The image is mirrored at its edge, without repeating the edge. Bands of rows with their margins, one task each."""
    if d <= 1:
        return raster.select("image_id", "x", "y", "r", "g", "b")
    radius, band = d // 2, 64
    row = F.floor(F.col("y") / band).cast("int")
    size = raster.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    spread = raster.join(size, "image_id").select("image_id", "x", "y", "r", "g", "b", "w", "h", F.explode(F.array_distinct(F.array(row, F.floor((F.col("y") - radius) / band).cast("int"), F.floor((F.col("y") + radius) / band).cast("int")))).alias("band")).where(F.col("band").between(0, F.floor((F.col("h") - 1) / band)))

    def run(pdf):
        import numpy as np
        import pandas as pd

        w, h, k, y0 = int(pdf.w.iloc[0]), int(pdf.h.iloc[0]), int(pdf.band.iloc[0]), int(pdf.y.min())
        a = np.full((int(pdf.y.max()) - y0 + 1, w, 3), np.nan)
        a[pdf.y - y0, pdf.x] = pdf[["r", "g", "b"]]

        def mirrored(n, low, high):
            at = np.arange(low, high) % max(2 * n - 2, 1)
            return np.where(at < n, at, 2 * n - 2 - at)

        first, last = k * band, min((k + 1) * band, h)
        wide = a[np.clip(mirrored(h, first - radius, last + radius) - y0, 0, len(a) - 1)][:, mirrored(w, -radius, w + radius)]
        rows = last - first
        mid = wide[radius : radius + rows, radius : radius + w]
        total, weight = np.zeros((rows, w, 3)), np.zeros((rows, w))
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                if dy * dy + dx * dx > radius * radius:
                    continue
                other = wide[radius + dy : radius + dy + rows, radius + dx : radius + dx + w]
                far = np.abs(other - mid).sum(2)
                g = np.nan_to_num(np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - far * far / (2 * sigma_colour**2)))
                total += np.nan_to_num(other) * g[..., None]
                weight += g
        keep = pdf[(pdf.y // band) == k]
        out = np.rint(total / np.maximum(weight, 1e-12)[..., None])[keep.y - first, keep.x].astype(int)
        return pd.DataFrame({"image_id": keep.image_id, "x": keep.x, "y": keep.y, "r": out[:, 0], "g": out[:, 1], "b": out[:, 2]})

    return spread.groupBy("image_id", "band").applyInPandas(run, "image_id string, x int, y int, r int, g int, b int")
