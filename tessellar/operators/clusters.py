"""Clusters of the colours of many images at once: Lloyd steps with a table of centres, mini-batches over a drawn sample, colour detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.raster import reduced
from ..sources.store import materialize, release
from .palette import cluster_report, coverage_selection, merge_close

#: Pixels of a mini-batch, and how many batches at most; both bound what one image's task takes.
BATCH, STEPS = 4096, 64
#: Pixels that colour detection draws of an image, without repeats, and most clusters that it begins with.
SAMPLE, EXPLORED = 12_000, 64
SPACES = ("rgb", "hsl", "lab")


def sampled(pixels: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """size pixels of each image, or all if it has no more, with draw, their place in a random order: by rank of a hash of seed, image and pid.

    Counts of the hashes' first bits tell above which none is drawn, so only little more than what is drawn is ranked; ranks are taken among parts of an
    image first, so that no task sorts all of it.
    """
    p = pixels.withColumn("_h", F.xxhash64(F.lit(seed), "image_id", "pid")).withColumn("_top", F.shiftright("_h", 48))
    counts = p.groupBy("image_id", "_top").agg(F.count(F.lit(1)).alias("n"))
    so_far = counts.withColumn("n", F.sum("n").over(Window.partitionBy("image_id").orderBy("_top")))  # of 65,536 values at most
    enough = so_far.where(F.col("n") >= size).groupBy("image_id").agg(F.min("_top").alias("_most"))
    p = p.join(enough, "image_id", "left").where("_most IS NULL OR _top <= _most").drop("_top", "_most")
    p = p.withColumn("_part", F.pmod("_h", F.lit(64)))
    for part in (["image_id", "_part"], ["image_id"]):
        p = p.withColumn("draw", F.row_number().over(Window.partitionBy(*part).orderBy("_h", "pid"))).where(F.col("draw") <= size)
    return p.drop("_h", "_part")


def _nearest(x, centres):
    import numpy as np

    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 1 << 16):
        out[at : at + (1 << 16)] = ((x[at : at + (1 << 16), None] - centres) ** 2).sum(2).argmin(1)
    return out


def _centres(x, k: int, seed: int, batch: int, steps: int):
    """k centres of the rows of x by mini-batches, taken in turn: a centre moves towards its rows' mean by their share in all it has had so far.

    The first centres are drawn one after the other, each row by the square of its distance to the nearest one drawn before. Steps end early when no
    centre has moved by a thousandth for ten steps.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    first = x[: 3 * max(batch, k)]
    centres = [first[int(rng.integers(len(first)))]]
    far = ((first - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        if far.sum() == 0:
            break  # no more distinct rows
        centres.append(first[int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), "right").clip(0, len(first) - 1))])
        far = np.minimum(far, ((first - centres[-1]) ** 2).sum(1))
    centres, had, quiet = np.array(centres, float), np.zeros(len(centres)), 0
    for step in range(steps):
        rows = x[(np.arange(min(batch, len(x))) + step * batch) % len(x)]
        k_of = _nearest(rows, centres)
        n = np.bincount(k_of, minlength=len(centres))
        sums = np.stack([np.bincount(k_of, rows[:, d], len(centres)) for d in range(x.shape[1])], 1)
        had += n
        move = np.where(n[:, None] > 0, (sums - n[:, None] * centres) / np.maximum(had, 1)[:, None], 0.0)
        centres += move
        quiet = quiet + 1 if np.abs(move).max() < 1e-3 else 0
        if quiet == 10:
            break
    return centres


def minibatch_clusters(sample: DataFrame, k: str, seed: int = 0, batch: int = BATCH, steps: int = STEPS) -> DataFrame:
    """image_id, k, c (three coordinates), n, first_seen of each image's clusters: sample has image_id, pid, draw, v and, in the column named k, how many are wanted.

    One task holds one image's sample, which sampled() bounds. first_seen is the least pid of a cluster; one without pixels is left out.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("draw")
        x = np.stack(pdf.v.to_numpy()).astype(float)
        centres = _centres(x, int(min(pdf.k.iloc[0], len(x))), seed, batch, steps)
        of = _nearest(x, centres)
        pid = pdf.pid.to_numpy()
        used = np.unique(of)
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]] * len(used), "k": np.arange(len(used), dtype=np.int32), "c": list(centres[used]), "n": np.bincount(of)[used], "first_seen": [pid[of == j].min() for j in used]})

    return sample.select("image_id", "pid", "draw", "v", F.col(k).alias("k")).groupBy("image_id").applyInPandas(run, "image_id string, k int, c array<double>, n long, first_seen long")


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points (image_id, v, ...) with k, the nearest centre (image_id, k, c) of their image, of equals the smaller k."""
    listed = centres.groupBy("image_id").agg(F.collect_list(F.struct("k", "c")).alias("_cs"))
    best = F.array_min(F.transform("_cs", lambda s: F.struct(C.euclidean(F.col("v"), s.c).alias("d"), s.k.alias("k")))).k
    return points.join(listed, "image_id").withColumn("k", best).drop("_cs")


def _lab8() -> Column:
    return F.array(*[c.cast("double") for c in C.lab8(F.col("r"), F.col("g"), F.col("b"))])


def kmeans_labels(raster: DataFrame, k: int | DataFrame, seed: int = 0, size: int = BATCH * STEPS) -> DataFrame:
    """The raster with label, and cr, cg, cb, its cluster's colour: each image's own k clusters in 8-bit Lab, no more than it has pixels.

    k is one for all or a table (image_id, k). Clusters are found on a sample of size pixels of an image; every pixel then goes to the nearest. Labels are numbered as their clusters were drawn; not
    number for number what another library gives.
    """
    points = raster.drop("label").withColumn("v", _lab8())
    drawn = sampled(points.select("image_id", "pid", "v"), size, seed)
    drawn = drawn.withColumn("k", F.lit(max(1, k))) if isinstance(k, int) else drawn.join(k.select("image_id", F.greatest(F.lit(1), F.col("k")).alias("k")), "image_id")
    centres = materialize(minibatch_clusters(drawn, "k", seed))
    whole = [F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(F.col("c")[i]))) for i in range(3)]
    colours = centres.select("image_id", "k", *[c.alias(n) for n, c in zip(("cr", "cg", "cb"), C.lab_to_rgb(whole[0] / 2.55, whole[1] - 128, whole[2] - 128))])
    return assigned(points, centres).join(colours, ["image_id", "k"]).withColumnRenamed("k", "label").drop("v")


def detect_colours(raster: DataFrame, hint: int = 48, max_side: int = 480, distance: float = 11.0, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """image_id, detected, and how it came about: how many main colours each image has, and the clusters that say so, with their shares.

    Of each image, reduced to max_side, up to sample pixels are clustered in 8-bit Lab; near clusters merge; the largest that cover enough are kept. Where
    two clusters at most are wanted or possible, there is nothing to find: as many colours as pixels drawn, hint at most.
    """
    small = reduced(raster, max_side).withColumn("v", _lab8())
    drawn = materialize(sampled(small.select("image_id", "pid", "v"), sample, seed))
    sizes = drawn.groupBy("image_id").agg(F.count(F.lit(1)).alias("sample_size")).withColumn("exploratory_k", F.greatest(F.lit(2), F.least(F.lit(min(2 * hint, EXPLORED)), F.col("sample_size"))).cast("int"))
    wide = drawn.join(sizes.where("exploratory_k > 2"), "image_id")
    found = materialize(minibatch_clusters(wide, "exploratory_k", seed, BATCH).select("image_id", "first_seen", "n", *[F.col("c")[i].alias(c) for i, c in enumerate("lab")]))
    merged = materialize(merge_close(found, distance))
    chosen = coverage_selection(merged, hint).join(merged.select("image_id", "first_seen", "l", "a", "b"), ["image_id", "first_seen"]).join(sizes, "image_id")
    listed = cluster_report(chosen, "sample_size").groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("selected"), F.sort_array(F.collect_list(F.struct("sample_pixels", "sample_percent", "hex")), False).alias("clusters"))
    counts = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("before_merge")).join(merged.groupBy("image_id").agg(F.count(F.lit(1)).alias("after_merge")), "image_id")
    out = sizes.join(counts, "image_id", "left").join(listed, "image_id", "left")
    plain = F.greatest(F.lit(1), F.least(F.lit(hint), F.col("sample_size"))).cast("int")
    detected = F.when(F.col("exploratory_k") > 2, F.greatest(F.lit(1), F.least(F.lit(hint), F.col("selected")))).otherwise(plain)
    return out.select("image_id", detected.alias("detected"), "sample_size", "exploratory_k", "before_merge", "after_merge", F.coalesce("clusters", F.array().cast(out.schema["clusters"].dataType)).alias("clusters"))


def _sums(batches):
    """Of each batch of points and each image in it, k, dim, xw, w: sums of the points that are nearest to centre k, of equals the smaller one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        parts = []
        for image in pc.unique(b.column("image_id")):
            rows = b.filter(pc.equal(b.column("image_id"), image))
            x, weight = (pc.list_flatten(rows.column("v")).to_numpy().reshape(len(rows), -1), rows.column("weight").to_numpy())
            ks, centres = (np.array(rows.column(c)[0].as_py()) for c in ("_ks", "_cs"))
            of = np.empty(len(x), np.int64)
            for at in range(0, len(x), 1 << 16):
                of[at : at + (1 << 16)] = np.sqrt(((x[at : at + (1 << 16), None] - centres.reshape(len(ks), -1)) ** 2).sum(2)).argmin(1)
            used, dims = np.unique(of), x.shape[1]
            xw = np.stack([np.bincount(of, x[:, d] * weight, len(ks)) for d in range(dims)], 1)[used]
            w = np.bincount(of, weight, len(ks))[used]
            columns = [np.repeat(ks[used], dims), np.tile(np.arange(dims), len(used)), xw.ravel(), np.repeat(w, dims)]
            parts.append(pa.table([pa.array([image.as_py()] * xw.size, pa.string()), *map(pa.array, columns)], ["image_id", "k", "dim", "xw", "w"]))
        for part in parts:
            yield from part.cast(pa.schema([("image_id", pa.string()), ("k", pa.int32()), ("dim", pa.int32()), ("xw", pa.float64()), ("w", pa.float64())])).to_batches()


def grouped_lloyd(points: DataFrame, k: int, seed: int, delta: float = 1.0) -> DataFrame:
    """image_id, k, c: centres of each image's points (image_id, i from 1 on without gaps, v, weight).

    Each image begins with k of its points, drawn with repeats by the seeded generator. A step sends points to the nearest centre of their image, of equals
    the smaller k, and centres to the weighted mean of theirs, to six places; a centre without points stays. An image is through when its centres together
    have moved by delta or less; the others go on. A step is one pass over the points, of which sums go on, and one table written.
    """
    spark = points.sparkSession
    n = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    draws = spark.range(1).select(F.posexplode(C.seeded_random(F.lit(seed), k)).alias("k", "u"))
    first = n.join(draws).select("image_id", "k", (F.floor(F.col("n") * F.col("u")) + 1).alias("i"))
    state = materialize(first.join(points.select("image_id", "i", "v"), ["image_id", "i"]).select("image_id", "k", F.col("v").alias("c"), F.lit(None).cast("double").alias("moved")))
    while True:
        open_ = state.where(F.col("moved").isNull() | (F.col("moved") > delta))
        if open_.isEmpty():
            return state.select("image_id", "k", "c")
        in_order = F.array_sort(F.collect_list(F.struct("k", "c")))
        listed = open_.groupBy("image_id").agg(in_order.alias("_l")).select("image_id", F.col("_l.k").alias("_ks"), F.flatten("_l.c").alias("_cs"))
        sums = points.select("image_id", "v", "weight").join(listed, "image_id").mapInArrow(_sums, "image_id string, k int, dim int, xw double, w double")
        means = sums.groupBy("image_id", "k", "dim").agg(F.round(F.sum("xw") / F.sum("w"), 6).alias("mean"))
        moved = means.groupBy("image_id", "k").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"))
        new = open_.join(moved, ["image_id", "k"], "left").select("image_id", "k", F.coalesce(F.transform("m", lambda s: s.mean), "c").alias("c"), F.coalesce(C.euclidean(F.col("c"), F.transform("m", lambda s: s.mean)), F.lit(0.0)).alias("by"))
        after = new.select("image_id", "k", "c", F.sum("by").over(Window.partitionBy("image_id")).alias("moved"))
        spent, state = state, materialize(after.unionByName(state.where(F.col("moved") <= delta)))
        release(spent)


def colour_points(raster: DataFrame, space: str = "rgb") -> DataFrame:
    """image_id, r, g, b (six bits of each), i (place of its first pixel among colours), v (in the colour space), weight (share of pixels)."""
    if space not in SPACES:
        raise ValueError(f"unknown colour space: {space}")
    g = raster.groupBy("image_id", *[C.coarse(F.col(c)).alias(c) for c in "rgb"]).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first_pid"))
    image = Window.partitionBy("image_id")  # of 64 ** 3 colours at most
    own = [F.col(c) for c in "rgb"]
    v = F.array(*[c.cast("double") for c in {"rgb": lambda *c: c, "hsl": C.rgb_to_hsl, "lab": C.rgb_to_lab}[space](*own)])
    g = g.withColumn("v", v)
    return g.select("image_id", *"rgb", F.row_number().over(image.orderBy("first_pid")).cast("long").alias("i"), "v", (F.col("n") / F.sum("n").over(image)).alias("weight"))


def clustered_raster(raster: DataFrame, k: int, seed: int, delta: float = 1.0, space: str = "rgb", allowed: list | None = None, aliases: dict[str, tuple] | None = None) -> DataFrame:
    """image_id, x, y, pid, r, g, b: each pixel in the colour of its cluster, or in the nearest of the allowed colours (triples, or names in aliases; the first of equals)."""
    points = materialize(colour_points(raster, space))
    centres = grouped_lloyd(points, k, seed, delta)
    back = {"rgb": lambda *c: c, "hsl": C.hsl_to_rgb, "lab": C.lab_to_rgb}[space]
    colour = centres.select("image_id", "k", *[F.floor(c).cast("int").alias(n) for n, c in zip(("cr", "cg", "cb"), back(*[F.col("c")[i] for i in range(3)]))])
    if allowed:
        named = [tuple(aliases[c]) if isinstance(c, str) else tuple(c) for c in allowed]
        lab = lambda cols: F.array(*C.rgb_to_lab(*cols))
        options = [F.struct(C.euclidean(lab([F.col(c) for c in ("cr", "cg", "cb")]), lab([F.lit(int(x)) for x in c])).alias("d"), F.lit(j).alias("j"), F.array(*[F.lit(int(x)) for x in c]).alias("to")) for j, c in enumerate(named)]
        to = materialize(colour).select("image_id", "k", F.array_min(F.array(*options)).to.alias("to"))
        colour = to.select("image_id", "k", *[F.col("to")[i].alias(n) for i, n in enumerate(("cr", "cg", "cb"))])
    painted = assigned(points, centres).join(colour, ["image_id", "k"]).select("image_id", *[F.col(c).alias(f"{c}6") for c in "rgb"], "cr", "cg", "cb")
    p = raster.select("image_id", "x", "y", "pid", *[C.coarse(F.col(c)).alias(f"{c}6") for c in "rgb"])
    return p.join(painted, ["image_id", "r6", "g6", "b6"]).select("image_id", "x", "y", "pid", *[F.col(f"c{c}").alias(c) for c in "rgb"])
