"""Files in, templates and reports out."""

import json
import struct

import numpy as np

from tessellar.plans import segmentation as G
from tessellar.plans.settings import Settings
from tessellar.sources import raster as S


def bands(w, h, colours):
    a = np.zeros((h, w, 3), np.uint8)
    for k, c in enumerate(colours):
        a[:, k * w // len(colours) : (k + 1) * w // len(colours)] = c
    return a


def bmp(a):
    h, w = a.shape[:2]
    lines = b"".join(r[:, ::-1].tobytes() + bytes(-3 * w % 4) for r in a[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(lines), 2835, 2835, 0, 0) + lines


def test_two_files_to_templates(spark, tmp_path):
    one = bands(30, 16, [(200, 30, 30), (30, 160, 60), (40, 40, 200)])
    one[4:7, 4:6] = (30, 160, 60)  # too small to stay
    two = bands(24, 12, [(90, 90, 90), (240, 200, 40)])
    (tmp_path / "one.png").write_bytes(S.png_bytes(one))
    (tmp_path / "two.bmp").write_bytes(bmp(two))
    s = G.segmented_files(spark, Settings(image=f"file://{tmp_path}/*", color_count=3, min_label_area=20, smooth_d=0))
    short = {r.image_id: r.image_id.rpartition("/")[2] for r in s.sizes.collect()}
    assert set(short.values()) == {"one.png", "two.bmp"}
    exact = {}
    for r in s.palette.collect():
        exact.setdefault(short[r.image_id], set()).add((r.r, r.g, r.b))
    near = lambda p, q: all(abs(a - b) <= 5 for a, b in zip(p, q))
    assert len(exact["one.png"]) == 3 and all(any(near(c, w) for c in exact["one.png"]) for w in [(200, 30, 30), (30, 160, 60), (40, 40, 200)])
    assert len(exact["two.bmp"]) == 2 and all(any(near(c, w) for c in exact["two.bmp"]) for w in [(90, 90, 90), (240, 200, 40)])
    report = {short[r.image_id]: r for r in G.report(s).collect()}
    a, b = report["one.png"], report["two.bmp"]
    assert (a.width, a.height, a.regions_total, a.regions_numbered, a.smallest_region, a.exact_cleanup_matches_detected_main_colors) == (30, 16, 3, 3, 160, True)
    assert (b.width, b.height, b.colors, b.regions_total, b.median_region_area) == (24, 12, 2, 2, 144.0)
    placed = G.placements(s)
    at = {(short[r.image_id], r.x, r.y): r.radius for r in placed.collect()}
    assert len(at) == 5 and at["two.bmp", 5, 5] == 6.0
    marked = G.markers(s, placed)
    colour = {(r.marker_x, r.marker_y): (r.cr, r.cg, r.cb) for r in marked.collect() if short[r.image_id] == "one.png"}
    for mode in ("numbers", "circles-only", "bright-color-circles", "colored-edges"):
        t = {(short[r.image_id], r.x, r.y): (r.r, r.g, r.b) for r in G.template(s, mode, marked).collect()}
        assert len(t) == 30 * 16 + 24 * 12
        if "circles" in mode:
            assert all(t["one.png", x, y] == c for (x, y), c in colour.items())
        if mode == "numbers":
            assert t["one.png", 9, 3] == (32, 32, 32) and t["one.png", 5, 5] == (255, 255, 255)
    documents = {short[r.image_id]: json.loads(r.document) for r in G.palette_documents(s, {"template": "t.png"}).collect()}
    assert documents["two.bmp"]["settings"]["min_label_area"] == 20 and documents["two.bmp"]["settings"]["small_area_merging"] is True and len(documents["two.bmp"]["colors"]) == 2


def test_colours_are_counted_where_asked(spark):
    cells = [(i, x, y, y * 20 + x, *(c[x // 10])) for i, c in (("a", [(250, 0, 0), (0, 0, 250)]), ("b", [(9, 9, 9), (9, 9, 9)])) for y in range(10) for x in range(20)]
    px = spark.createDataFrame(cells, "image_id string, x int, y int, pid long, r int, g int, b int")
    s = G.build_segmentation(px, Settings(auto_color_count=True, max_colors=6, min_label_area=5, smooth_d=0))
    assert {r.image_id: r.detected for r in s.detected.collect()} == {"a": 2, "b": 1}
    assert {r.image_id: r.regions_total for r in G.report(s).collect()} == {"a": 2, "b": 1}
