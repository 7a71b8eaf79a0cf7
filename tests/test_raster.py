"""Raster queries against SQL on another engine, and cases worked out by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellar.functions import colour as C
from tessellar.operators import borders as B
from tessellar.operators import cleanup as K
from tessellar.operators import outline as O
from tessellar.operators import palette as P
from tessellar.operators import reduction as D
from tessellar.operators import regions as R
from tessellar.plans.queries import ORACLE_SQL, QUERIES
from tessellar.plans.settings import Settings
from tessellar.sources import payloads as Y
from tessellar.sources import raster as S
from tessellar.streaming import progress as T

FAST = ["palette_table", "palette_json", "strip_cleanup_runs", "prune_protrusions", "colour_index", "compact_labels", "boundary", "border_points", "strip_cleanup", "opening", "expand_owner", "coverage_selection", "closest_pair", "regions", "merge_plan", "merge_apply", "base64_chunks", "chunk_assembly", "shoelace", "progress_throttle", "progress_overall", "paintability", "small_facets", "neighbours_of_facets", "merge_order", "template_layers", "marker_geometry", "payload_round_trip", "answer_images", "idea_texts", "analysis_raster", "strict_palette", "label_points", "coloured_rims", "nearest_borders", "swatch_layout", "swatch_sheet", "region_markers", "label_texts", "png_round_trip", "lanczos_raster", "colour_distances", "draw_order", "size_order", "bilateral", "border_paths"]


def raster(spark, rows):
    cells = [("i", x, y, y * len(r) + x, v) for y, r in enumerate(rows) for x, v in enumerate(r)]
    return spark.createDataFrame(cells, "image_id string, x int, y int, pid long, label int")


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "embeddings", "orders", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    r = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in cols) for row in got.collect()) == [tuple(w) for w in want]


def test_small_regions(spark):
    p = R.region_map(raster(spark, [[0, 1], [0, 0]]))
    assert sorted((r.color_index, r.area) for r in R.region_table(p).collect()) == [(0, 3), (1, 1)]
    assert {r.border_count for r in R.adjacency(p).collect()} == {2}
    assert sorted((r.x, r.y) for r in R.boundary_mask(p).where("boundary").collect()) == [(0, 0), (1, 0)]


def test_connectivity(spark):
    px = raster(spark, [[0, 1], [1, 0]])
    assert R.region_table(R.region_map(px)).count() == 2
    assert R.region_table(R.region_map(px, 4)).count() == 4


def test_strip_guard(spark):
    px = raster(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    near, far = [(0, 100, 100, 100), (1, 110, 110, 110)], [(0, 0, 0, 0), (1, 255, 255, 255)]
    assert K.strip_once(px, S.palette(spark, near)).where("label = 1").count() == 0
    assert K.strip_once(px, S.palette(spark, far)).where("label = 1").count() == 1
    flat = raster(spark, [[0, 1, 0], [1, 0, 1]])
    assert K.strip_once(flat, S.palette(spark, near)).orderBy("pid").select("label").collect() == flat.orderBy("pid").select("label").collect()


def test_paint_and_tint(spark):
    df = spark.createDataFrame([(251, 249, 233), (0, 0, 0), (10, 10, 10)], "r int, g int, b int")
    got = [tuple(r) for r in df.select(*C.paint(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got == [(238, 232, 218), (24, 24, 24), (42, 42, 42)]
    assert df.select(C.tint(F.col("r")).alias("t")).collect()[1].t == 214


def test_coverage_and_thresholds(spark):
    c = spark.createDataFrame([("i", k, n) for k, n in enumerate((600, 300, 80, 20))], "image_id string, first_seen int, n long")
    assert P.coverage_selection(c, 48).count() == 3
    assert R.effective_min_area(958_800, 260) == 260


def test_merge_chain(spark):
    px = raster(spark, [[0, 1, 2]])
    pixels = R.region_map(px)
    plan = spark.createDataFrame([("i", 0, 1), ("i", 1, 2)], "image_id string, src long, dst long")
    assert {r.label for r in R.apply_merges(pixels, R.region_table(pixels), plan).collect()} == {2}


def test_chunks_throttle_and_pole(spark):
    assert spark.range(1).select(S.chunks(F.lit("")).alias("c")).first().c == [""]
    e = spark.createDataFrame([("a", k, t, v) for k, (t, v) in enumerate([(0, 0.0), (10, 0.01), (20, 0.05), (200, 0.051), (210, 1.0)])], "request_id string, seq long, ts_ms long, local double")
    assert sorted(r.seq for r in T.throttle(e).collect()) == [0, 2, 3, 4]
    x, y, d = B.pole([[(0, 0), (10, 0), (10, 10), (0, 10)]])
    assert (x, y, d) == (5, 5, 5)
    path = [(0, 4), (1, 4), (2, 4), (3, 5), (4, 5), (5, 6), (6, 6), (7, 7)]
    df = spark.createDataFrame([([(float(a), float(b), 1) for a, b in p],) for p in (path[:3], path, [(9, 4)] * 6)], "points array<struct<x:double,y:double,side:int>>")
    got = [[(q.x, q.y) for q in r.h] for r in df.select(O.halve(F.col("points"), 10, 10).alias("h")).collect()]
    assert got == [path[:3], [(0, 4), (1.5, 4), (3.5, 5), (5.5, 6), (7, 7)], [(9, 4)] * 6]


def test_label_point_of_a_large_region(spark):
    px = spark.range(300 * 150).selectExpr("'i' AS image_id", "cast(id % 300 AS int) AS x", "cast(id div 300 AS int) AS y", "0 AS region_id")
    hole = F.when((F.col("x") == 100) & (F.col("y") == 74), 1).otherwise(0).alias("region_id")
    assert [tuple(r)[2:] for r in R.label_points(px).collect()] == [(74, 74, 75.0)]
    got = {r.region_id: (r.x, r.y, r.radius) for r in R.label_points(px.select("image_id", "x", "y", hole)).collect()}
    at = {(x, y): min(x + 1, 300 - x, y + 1, 150 - y, ((x - 100) ** 2 + (y - 74) ** 2) ** 0.5) for y in range(150) for x in range(300)}
    x, y = max(at, key=lambda p: (at[p], -p[1], -p[0]))
    assert got == {0: (x, y, round(at[x, y], 6)), 1: (100, 74, 1.0)}


def test_borders_and_labels(spark):
    px = R.region_map(raster(spark, [[0, 0, 0, 0], [0, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 0]]), 4)
    paths = B.border_paths(B.border_pixels(px))
    inner = [(r.x, r.y, "ltrb"[r.side]) for r in paths.where("region_id = 1").orderBy("place").collect()]
    assert inner == [(1, 1, "l"), (1, 1, "t"), (2, 1, "t"), (2, 1, "r"), (2, 2, "r"), (2, 2, "b"), (1, 2, "b"), (1, 2, "l")]
    assert paths.where("region_id = 0 AND neighbour = -1").count() == 16
    shared = B.matched_segments(B.border_segments(paths))
    bounds = {r.region_id: r for r in B.label_bounds(px, shared).collect()}
    assert (bounds[1].x, bounds[1].y, bounds[1].distance) == (1.5, 1.5, 1.0) and bounds[0].distance == 0.5
    ring = {r.region_id: [(p.x, p.y) for p in r.points] for r in B.rings(shared, walls=True).collect()}
    assert ring[1] == [(0.5, 1), (1, 0.5), (2, 0.5), (2.5, 1), (2.5, 2), (2, 2.5), (1, 2.5), (0.5, 2)]


def test_segments_match(spark):
    px = R.region_map(raster(spark, [[0, 0, 1], [2, 0, 1], [2, 2, 1]]), 4)
    segments = B.border_segments(B.border_paths(B.border_pixels(px)))
    got = {(r.region_id, r.neighbour): [(p.x, p.y, "ltrb"[p.side]) for p in r.points] for r in segments.collect()}
    assert got[0, 1] == [(1, 0, "r"), (1, 1, "r"), (1, 1, "b")] and got[2, 0] == [(0, 1, "t"), (0, 1, "r"), (1, 2, "t"), (1, 2, "r")]
    both = {(r.region_id, r.neighbour): (r.reverse, [(p.x, p.y) for p in r.points]) for r in B.matched_segments(segments).collect()}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert both[a, b][1] == both[b, a][1] and not both[a, b][0] and both[b, a][0]


def test_facet_reduction(spark):
    colours = S.palette(spark, [(0, 0, 0, 0), (1, 255, 255, 255), (2, 10, 10, 10), (3, 90, 90, 90)])
    px = raster(spark, [[0, 0, 0, 0, 1], [0, 0, 2, 3, 1], [0, 0, 0, 0, 1]])
    got = [r.label for r in D.reduce_facets(px, colours, 2, large_first=False).orderBy("pid").collect()]
    # 3 has the later number of the two and goes first: 0, 1 and 2 all touch it, and 2 has the nearest colour; 2 is large enough then
    assert got == [0, 0, 0, 0, 1, 0, 0, 2, 2, 1, 0, 0, 0, 0, 1]
    assert {r.label for r in D.reduce_facets(px, colours, 1, most=1).collect()} == {0}
    assert D.facet_neighbours(R.region_map(raster(spark, [[5]]), 4)).first().neighbours == []


def test_regions_across_bands_and_images(spark):
    rows = [[(x * x + y * 3) % 3 % 2 - (x % 7 == 3) for x in range(19)] for y in range(17)]
    one = raster(spark, rows)
    two = one.unionByName(one.withColumn("image_id", F.lit("j")))
    for c in (4, 8):
        want = sorted(tuple(r) for r in R.region_map(one, c).collect())
        got = sorted(tuple(r) for r in R.region_map(two, c, 3).collect())
        assert got == sorted(want + [("j", *w[1:]) for w in want])


def test_merge_driver_compacts_and_keeps_holes(spark):
    near = S.palette(spark, [(0, 100, 100, 100), (1, 104, 104, 104), (2, 108, 108, 108)])
    got = R.merge_small_regions(raster(spark, [[2, 2], [2, -1]]), near, 1).orderBy("pid").collect()
    assert [r.label for r in got] == [0, 0, 0, -1]
    px = raster(spark, [[1] * 6] * 3 + [[1, 1, 2, 1, 1, -1]] + [[1] * 6] * 2)
    got = R.merge_small_regions(px, near, 4).orderBy("pid").collect()
    assert len(got) == 36 and sorted({r.label for r in got}) == [-1, 0] and sum(r.label < 0 for r in got) == 1


def test_prune_fills_unlabelled_pixels(spark):
    got = [r.label for r in K.prune_protrusions(raster(spark, [[0, 0, 0, 1], [0, 0, 0, -1], [0, 0, 0, 1]])).orderBy("pid").collect()]
    assert got == [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]
    gap = raster(spark, [[0, 0, 0, 0, 0]]).where("x != 2")
    assert {(r.x, r.l, r.r) for r in K.around(gap).select("x", "l", "r").collect()} == {(0, None, 0), (1, 0, None), (3, None, 0), (4, 0, None)}


def test_bilateral_mirrors_the_edge(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (7, 6, 3))
    px = spark.createDataFrame([("i", x, y, *map(int, a[y, x])) for y in range(7) for x in range(6)], "image_id string, x int, y int, r int, g int, b int")
    wide = np.pad(a.astype(float), ((2, 2), (2, 2), (0, 0)), mode="reflect")
    want = {}
    for y in range(7):
        for x in range(6):
            total, weight = np.zeros(3), 0.0
            for j in range(-2, 3):
                for i in range(-2, 3):
                    if i * i + j * j <= 4:
                        q = wide[y + 2 + j, x + 2 + i]
                        w = np.exp(-(i * i + j * j) / 5000 - np.abs(q - a[y, x]).sum() ** 2 / 5000)
                        total, weight = total + w * q, weight + w
            want[x, y] = tuple(int(v) for v in np.rint(total / weight))
    assert {(r.x, r.y): (r.r, r.g, r.b) for r in K.bilateral(px, 5).collect()} == want


def test_in_place_cleanup(spark):
    colours = S.palette(spark, [(0, 0, 0, 0), (1, 255, 255, 255)])
    got = [r.label for r in K.strip_in_place(raster(spark, [[0, 0, 0], [1, 1, 1], [0, 0, 0]]), colours).orderBy("pid").collect()]
    assert got == [0, 0, 0, 1, 0, 1, 0, 0, 0]


def test_chunks_of_a_request(spark):
    rows = [("a", 0, 0, 2, "z old"), ("a", 1, 1, 2, "!"), ("a", 2, 0, 2, "a new "), ("b", 3, 0, 2, "x"), ("c", 4, 0, 1, "y")]
    parts = spark.createDataFrame(rows, "request_id string, seq long, chunk_index int, total_chunks int, chunk string")
    starts = spark.createDataFrame([("a",), ("b",), ("d",)], "request_id string")
    got = {r.request_id: (r.complete, r.text, r.error) for r in T.assemble(parts, starts=starts).collect()}
    assert got == {"a": (True, "a new !", None), "b": (False, None, "missing chunk"), "c": (False, None, "unknown request"), "d": (False, None, "missing chunk")}


def test_throttled_stream(spark, tmp_path):
    e = spark.createDataFrame([("a", k, t, v) for k, (t, v) in enumerate([(0, -1.0), (10, 0.01), (20, 0.05), (200, 0.051), (210, 2.0)])], "request_id string, seq long, ts_ms long, local double")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.stream_throttle(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.seq for r in T.throttle(e).collect()) == [0, 2, 3, 4]


def test_settings_and_payloads(spark):
    assert Settings().derived(958_800).effective_min_label_area == 260
    for wrong in ({"max_colors": 0}, {"color_count": 0}, {"min_label_area": 0}, {"resize_max": -1}, {"smooth_d": -1}, {"smooth_d": 4}):
        with pytest.raises(ValueError):
            Settings(**wrong)
    sent = Y.serialise(spark.createDataFrame([("i", 2, 1, b"abcdefgh")], "image_id string, width int, height int, data binary"))
    assert bytes(Y.deserialise(sent).first().data) == b"abcdefgh"
    with pytest.raises(Exception, match="length mismatch"):
        Y.deserialise(sent.withColumn("payload", F.lit("YWJj"))).collect()
    answers = ['{"image":{"base64":"x","mimeType":"image/webp"}}', '{"candidates":[{},{"content":{"parts":[{"text":"t"},{"inlineData":{"data":"y"}}]}}]}', "[]", None]
    df = spark.createDataFrame([(a,) for a in answers], "p string")
    assert [tuple(r.i) if r.i else None for r in df.select(F.coalesce(Y.answer_image(F.col("p")), Y.candidate_image(F.col("p"))).alias("i")).collect()] == [("image/webp", "x"), ("image/png", "y"), None, None]
    names = spark.createDataFrame([("a b/My photo (1).final.jpg",), ("___.png",)], "n string")
    assert [r[0] for r in names.select(Y.clean_stem(F.col("n"), "image")).collect()] == ["My_photo_1_.final", "image"]
    with pytest.raises(Exception, match="differ in length"):
        P.strict_zip(spark.createDataFrame([(1, "a"), (2, "b")], "number int, h string"), spark.createDataFrame([(1, "c")], "number int, e string")).collect()


def test_cluster_merge(spark):
    rows = [("i", 0, 5, 0.0, 0.0, 0.0), ("i", 1, 9, 4.0, 0.0, 0.0), ("i", 2, 1, 60.0, 0.0, 0.0), ("i", 3, 1, 64.0, 3.0, 0.0), ("j", 0, 1, 0.0, 0.0, 0.0)]
    got = P.merge_close(spark.createDataFrame(rows, "image_id string, first_seen long, n long, l double, a double, b double"), 11.0).collect()
    assert sorted((r.image_id, r.first_seen, r.n, round(r.l, 4), r.a) for r in got) == [("i", 0, 14, 2.5714, 0.0), ("i", 2, 2, 62.0, 1.5), ("j", 0, 1, 0.0, 0.0)]


def test_areas_add_up_and_png(spark, sf):
    px = S.raster_from_events(spark, sf)
    assert R.region_table(R.region_map(px)).agg(F.sum("area")).first()[0] == px.count()
    assert S.write_png(px).first().png[:4] == b"\x89PNG"
    with pytest.raises(ValueError):
        S.safe_output("/")


def two_images(spark):
    """One image of two labels, one without any."""
    rows = [("a", x, y, y * 3 + x, 1 if (x, y) == (1, 1) else 0) for y in range(3) for x in range(3)] + [("b", x, y, y * 3 + x, -1) for y in range(3) for x in range(3)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, pid long, label int")


def test_timings_as_a_map(spark):
    e = spark.createDataFrame([("r", "a", 1.5), ("r", "b", 2.0), ("r", "a", 1.0), ("s", "a", 4.0)], "run string, stage string, ms double")
    assert {r.run: r.ms for r in T.timings_map(e, "run").collect()} == {"r": {"a": 2.5, "b": 2.0}, "s": {"a": 4.0}}


def test_an_image_without_labels(spark):
    px, colours = two_images(spark), S.palette(spark, [(0, 100, 100, 100), (1, 110, 110, 110)])
    once = K.strip_once(px, colours).collect()
    assert {(r.image_id, r.label) for r in once} == {("a", 0), ("b", -1)} and len(once) == 18
    assert {(r.image_id, r.label) for r in P.compacted(px, colours).collect()} == {("a", 0), ("a", 1), ("b", 0)}
    report = {r.image_id: r for r in R.paintability(R.region_table(R.region_map(px)), S.image_sizes(px), 2).collect()}
    assert (report["a"].regions_total, report["a"].largest_region, report["a"].width) == (2, 8, 3)
    assert (report["b"].regions_total, report["b"].colors, report["b"].largest_region, report["b"].median_region_area, report["b"].height) == (0, 0, 0, 0.0, 3)


def test_area_means_of_any_ratio(spark):
    row = lambda image, values: [(image, x, 0, x, v, v, v) for x, v in enumerate(values)]
    px = spark.createDataFrame(row("i", [0, 90, 180]) + row("j", [10, 20]), "image_id string, x int, y int, pid long, r int, g int, b int")
    assert [(r.image_id, r.pid, r.r) for r in S.reduced(px, 2).orderBy("image_id", "x").collect()] == [("i", 0, 30), ("i", 1, 150), ("j", 0, 10), ("j", 1, 20)]
