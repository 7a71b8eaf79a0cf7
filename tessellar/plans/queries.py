"""Queries over the raster operators, and the SQL that says the same on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import borders as B
from ..operators import cleanup as K
from ..operators import clusters as U
from ..operators import outline as O
from ..operators import palette as P
from ..operators import reduction as D
from ..operators import regions as R
from ..operators import templates as M
from ..sources import images as I
from ..sources import payloads as Y
from ..sources import raster as S
from ..streaming import progress as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}
MIN_AREA = 6

# Shared parts of the SQL
_PX = """px AS (SELECT 'events' AS image_id, (event_id % 100)::INTEGER AS x, (event_id // 100)::INTEGER AS y, event_id AS pid,
  (CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END)::INTEGER AS label,
  (user_id % 256)::INTEGER AS r, ((event_id * 7) % 256)::INTEGER AS g, (floor(value)::BIGINT % 256)::INTEGER AS b FROM events)"""
_PAL = "pal(label, r, g, b) AS (VALUES " + ", ".join(map(str, S.EVENT_PALETTE)) + ")"
_LUM = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"
_PAINT = [f"(CASE WHEN {_LUM} > 244 AND greatest(r, g, b) - least(r, g, b) < 24 THEN {light} WHEN {_LUM} >= 42 THEN {c} ELSE greatest(24, least(255, round_even({c} * (42::DOUBLE / greatest({_LUM}, 1)), 0)))::INTEGER END)::INTEGER" for c, light in zip("rgb", (238, 232, 218))]
_HSV = """CASE WHEN mx = mn THEN 0::DOUBLE WHEN mx = r THEN 60::DOUBLE * (g - b) / (mx - mn) WHEN mx = g THEN 120 + 60::DOUBLE * (b - r) / (mx - mn) ELSE 240 + 60::DOUBLE * (r - g) / (mx - mn) END"""
_LAB = """lin AS (SELECT *, [CASE WHEN c / 255::DOUBLE > 0.04045 THEN pow((c / 255::DOUBLE + 0.055) / 1.055, 2.4) ELSE c / 255::DOUBLE / 12.92 END * 100 FOR c IN [r, g, b]] AS q FROM src),
xyz AS (SELECT *, [CASE WHEN t > 0.008856 THEN pow(t, 1::DOUBLE / 3) ELSE 7.787 * t + 16::DOUBLE / 116 END FOR t IN [(q[1] * 0.4124::DOUBLE + q[2] * 0.3576::DOUBLE + q[3] * 0.1805::DOUBLE) / 95.047::DOUBLE, (q[1] * 0.2126::DOUBLE + q[2] * 0.7152::DOUBLE + q[3] * 0.0722::DOUBLE) / 100, (q[1] * 0.0193::DOUBLE + q[2] * 0.1192::DOUBLE + q[3] * 0.9505::DOUBLE) / 108.883::DOUBLE]] AS f FROM lin),
lab AS (SELECT *, 116 * f[2] - 16 AS ll, 500 * (f[1] - f[2]) AS la, 200 * (f[2] - f[3]) AS lb FROM xyz)"""
_EDGES = """nx AS (SELECT a.pid AS p, a.label, a.x + o.dx AS x, a.y + o.dy AS y FROM px a, (VALUES (-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)) o(dx, dy)),
e AS MATERIALIZED (SELECT n.p, b.pid AS q FROM nx n JOIN px b ON n.x = b.x AND n.y = b.y AND n.label = b.label)"""
_REG = f"""{_PX}, {_EDGES}, reach(p, root) AS (SELECT pid, pid FROM px UNION SELECT e.q, reach.root FROM reach JOIN e ON reach.p = e.p),
top AS (SELECT p, min(root) AS root FROM reach GROUP BY p),
reg AS (SELECT px.*, dense_rank() OVER (ORDER BY label, root)::BIGINT - 1 AS region_id FROM px JOIN top ON pid = p),
regions AS (SELECT image_id, region_id, min(label) AS color_index, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM reg GROUP BY ALL),
pairs AS (SELECT a.region_id AS s, b.region_id AS d FROM reg a JOIN reg b ON a.y = b.y AND a.x + 1 = b.x WHERE a.region_id != b.region_id UNION ALL SELECT a.region_id, b.region_id FROM reg a JOIN reg b ON a.x = b.x AND a.y + 1 = b.y WHERE a.region_id != b.region_id),
adj AS (SELECT s AS src, d AS dst, count(*) AS border_count FROM (SELECT s, d FROM pairs UNION ALL SELECT d, s FROM pairs) GROUP BY ALL)"""
_PLAN = f"""{_REG}, {_PAL}, src AS (SELECT * FROM pal), {_LAB},
l8 AS (SELECT label AS color_index, [round_even(ll * 2.55, 0), round_even(la + 128, 0), round_even(lb + 128, 0)] AS lab FROM lab),
m AS (SELECT region_id, area, (area < {MIN_AREA} OR area <= {2 * MIN_AREA} AND area / greatest(x2 - x1, y2 - y1)::DOUBLE <= 5.5)::INTEGER AS c, lab FROM regions JOIN l8 USING (color_index)),
opt AS (SELECT src, dst, n.c, border_count, n.area, round(list_distance(n.lab, s.lab), 6) AS far, s.area AS s_area FROM adj JOIN m s ON s.region_id = src AND s.c = 1 JOIN m n ON n.region_id = dst
  WHERE (n.c = 0 OR n.area > s.area OR n.area = s.area AND dst > src)),
plan AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c, (area <= s_area)::INTEGER, -border_count, -area, far, dst) AS rn FROM opt WHERE far <= 26 OR s_area <= 8) WHERE rn = 1)"""
_AROUND = f"""{_PX}, n AS (SELECT c.*, l.label AS l, r_.label AS rr, u.label AS u, d.label AS d, ul.label AS ul, ur.label AS ur, dl.label AS dl, dr.label AS dr FROM px c
 LEFT JOIN px l ON l.y = c.y AND l.x = c.x - 1 LEFT JOIN px r_ ON r_.y = c.y AND r_.x = c.x + 1 LEFT JOIN px u ON u.y = c.y - 1 AND u.x = c.x LEFT JOIN px d ON d.y = c.y + 1 AND d.x = c.x
 LEFT JOIN px ul ON ul.y = c.y - 1 AND ul.x = c.x - 1 LEFT JOIN px ur ON ur.y = c.y - 1 AND ur.x = c.x + 1 LEFT JOIN px dl ON dl.y = c.y + 1 AND dl.x = c.x - 1 LEFT JOIN px dr ON dr.y = c.y + 1 AND dr.x = c.x + 1)"""

# each pixel against all others outside its region that can be nearer than the image's edge
_DIST = f"""{_REG}, lim AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px), own AS (SELECT reg.*, least(x + 1, y + 1, w - x, h - y) AS far FROM reg, lim),
dist AS (SELECT o.pid, o.region_id, o.label, o.x, o.y, least(any_value(far * far), coalesce(min((o.x - q.x) * (o.x - q.x) + (o.y - q.y) * (o.y - q.y)), 1000000000)) AS d2
  FROM own o LEFT JOIN reg q ON q.x BETWEEN o.x - far AND o.x + far AND q.y BETWEEN o.y - far AND o.y + far AND q.region_id != o.region_id GROUP BY o.pid, o.region_id, o.label, o.x, o.y)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def px(spark, sf_dir) -> DataFrame:
    return S.raster_from_events(spark, sf_dir)


def pal(spark) -> DataFrame:
    return S.palette(spark)


def _regions(spark, sf_dir):
    from ..sources.store import materialize

    return materialize(R.region_map(px(spark, sf_dir)))


def _cast(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


@query("palette_table", f"""WITH {_PX}, {_PAL}, c AS (SELECT image_id, label, count(*) AS n FROM px WHERE label >= 0 GROUP BY ALL), p AS (SELECT *, {_PAINT[0]} AS pr, {_PAINT[1]} AS pg, {_PAINT[2]} AS pb FROM c JOIN pal USING (label))
SELECT image_id, (label + 1)::INTEGER AS number, printf('#%02X%02X%02X', r, g, b) AS hex, printf('#%02X%02X%02X', pr, pg, pb) AS paint_hex, n AS pixel_count, round_even(100::DOUBLE * n / sum(n) OVER (), 3) AS area_percent FROM p""")
def palette_table(spark, sf_dir):
    return P.palette_table(px(spark, sf_dir), pal(spark))


@query("palette_json", f"""WITH t AS ({ORACLE_SQL["palette_table"]}), {_PX}, size AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM px GROUP BY ALL),
c AS (SELECT image_id, list({{'number': number, 'hex': hex, 'rgb': [('0x' || substr(hex, i, 2))::INTEGER FOR i IN [2, 4, 6]], 'paint_hex': paint_hex, 'paint_rgb': [('0x' || substr(paint_hex, i, 2))::INTEGER FOR i IN [2, 4, 6]], 'pixel_count': pixel_count, 'area_percent': area_percent}} ORDER BY number) AS colors FROM t GROUP BY ALL)
SELECT image_id, to_json({{'source': 'events', 'width': width, 'height': height, 'settings': {{'min_label_area': {MIN_AREA}, 'auto_color_count': FALSE, 'smooth_sigma_color': 50.0, 'number_mode': 'numbers'}}, 'colors': colors, 'outputs': {{'template': 'template.png'}}}})::VARCHAR AS document FROM c JOIN size USING (image_id)""")
def palette_json(spark, sf_dir):
    p = px(spark, sf_dir)
    return P.palette_json(P.palette_table(p, pal(spark)), S.image_sizes(p), "events", {"min_label_area": MIN_AREA, "auto_color_count": False, "smooth_sigma_color": 50.0, "number_mode": "numbers"}, {"template": "template.png"})


_SWATCHES = f"""WITH {_PX}, t AS (SELECT image_id, g // 8 + 1 AS number, arg_min(r, pid) AS r, arg_min(g, pid) AS g, arg_min(b, pid) AS b FROM px GROUP BY ALL), n AS (SELECT *, count(*) OVER () AS n FROM t),
s AS (SELECT image_id, number, r, g, b, CASE WHEN n <= 18 THEN 0 ELSE ((number - 1) // ((n + 1) // 2))::INTEGER END AS sheet_column, CASE WHEN n <= 18 THEN number - 1 ELSE ((number - 1) % ((n + 1) // 2))::INTEGER END AS sheet_row, CASE WHEN n <= 18 THEN 1 ELSE 2 END AS cols, CASE WHEN n <= 18 THEN n ELSE (n + 1) // 2 END AS rows FROM n)"""


def _swatch_table(spark, sf_dir):
    """32 colours, enough for two columns: the first of each eighth of green."""
    p = px(spark, sf_dir).groupBy("image_id", (F.floor(F.col("g") / 8) + 1).cast("int").alias("number"))
    return p.agg(F.min_by(F.struct("r", "g", "b"), "pid").alias("c")).select("image_id", "number", "c.*")


@query("swatch_layout", f"{_SWATCHES} SELECT image_id, number, sheet_column, sheet_row FROM s")
def swatch_layout(spark, sf_dir):
    return P.swatches(_swatch_table(spark, sf_dir))


@query("swatch_sheet", f"""{_SWATCHES}, z AS (SELECT any_value(48 + 360 * cols) AS w, any_value(48 + 58 * rows) AS h FROM s), c AS (SELECT x::INTEGER AS x, y::INTEGER AS y FROM z, range(w) a(x), range(h) b(y)),
d AS (SELECT s.*, 24 + 360 * sheet_column AS x0, 29 + 58 * sheet_row AS y0 FROM s)
SELECT c.x, c.y, {", ".join(f"(CASE WHEN d.{k} IS NULL THEN {v} WHEN least(c.x - x0, c.y - y0) < 2 OR greatest(c.x - x0, c.y - y0) > 40 THEN 20 ELSE d.{k} END)::INTEGER AS {k}" for k, v in zip("rgb", (252, 250, 244)))}
FROM c LEFT JOIN d ON c.x BETWEEN x0 AND x0 + 42 AND c.y BETWEEN y0 AND y0 + 42""")
def swatch_sheet(spark, sf_dir):
    return P.swatch_sheet(_swatch_table(spark, sf_dir)).select("x", "y", "r", "g", "b")


@query("label_counts", f"WITH {_PX} SELECT image_id, label, count(*) AS pixel_count FROM px WHERE label >= 0 GROUP BY ALL")
def label_counts(spark, sf_dir):
    return P.label_counts(px(spark, sf_dir))


@query("colour_functions", f"""WITH {_PX}, src AS (SELECT DISTINCT r, g, b FROM px), {_LAB}, h AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM lab), h2 AS (SELECT *, {_HSV} AS hue FROM h)
SELECT r, g, b, printf('#%02X%02X%02X', r, g, b) AS hex, round({_LUM}, 6) AS luminance, {_PAINT[0]} AS paint_r, {_PAINT[1]} AS paint_g, {_PAINT[2]} AS paint_b, {_LUM} < 105 AS light_text, round_even(255 * (1 - 0.16::DOUBLE) + r * 0.16::DOUBLE, 0)::INTEGER AS tint_r,
 (floor((CASE WHEN hue < 0 THEN hue + 360 ELSE hue END) / 2 + 0.5)::INTEGER % 180)::INTEGER AS hue, (CASE WHEN mx = 0 THEN 0 ELSE floor(255::DOUBLE * (mx - mn) / mx + 0.5) END)::INTEGER AS saturation, mx AS value, round(ll, 5) AS lab_l, round(la, 5) AS lab_a, round(lb, 5) AS lab_b, r // 4 * 4 AS coarse_r FROM h2""")
def colour_functions(spark, sf_dir):
    r, g, b = map(F.col, "rgb")
    h, s, v = C.hsv8(r, g, b)
    paint, lab = C.paint(r, g, b), C.rgb_to_lab(r, g, b)
    return px(spark, sf_dir).select("r", "g", "b").distinct().select("r", "g", "b", C.hex_code(r, g, b).alias("hex"), F.round(C.luminance(r, g, b), 6).alias("luminance"), *[p.alias(f"paint_{c}") for p, c in zip(paint, "rgb")], C.needs_light_text(r, g, b).alias("light_text"), C.tint(r).alias("tint_r"), h.alias("hue"), s.alias("saturation"), v.alias("value"), *[F.round(x, 5).alias(f"lab_{c}") for x, c in zip(lab, "lab")], C.coarse(r).alias("coarse_r"))


@query("colour_round_trips", f"WITH {_PX} SELECT DISTINCT r, g, b, r AS lab_r, g AS lab_g, b AS lab_b, r AS hsl_r, g AS hsl_g, b AS hsl_b FROM px")
def colour_round_trips(spark, sf_dir):
    r, g, b = map(F.col, "rgb")


    def turn(there, back):
        bound = F.struct(*[x.alias(n) for x, n in zip(there(r, g, b), "abc")])
        return C.let(bound, lambda s: F.struct(*[x.alias(n) for x, n in zip(back(s.a, s.b, s.c), "rgb")]))

    both = px(spark, sf_dir).select("r", "g", "b").distinct().select("r", "g", "b", turn(C.rgb_to_lab, C.lab_to_rgb).alias("lab"), turn(C.rgb_to_hsl, C.hsl_to_rgb).alias("hsl"))
    return both.select("r", "g", "b", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("lab", "hsl") for c in "rgb"])


@query("distinct_colours", f"WITH {_PX} SELECT image_id, count(DISTINCT (r, g, b)) AS colours FROM px GROUP BY ALL")
def distinct_colours(spark, sf_dir):
    return P.distinct_colours(px(spark, sf_dir))


@query("colour_index", f"WITH {_PX}, f AS (SELECT image_id, r, g, b, min(pid) AS first_pid FROM px GROUP BY ALL) SELECT *, (row_number() OVER (ORDER BY first_pid) - 1)::INTEGER AS colour_index FROM f")
def colour_index(spark, sf_dir):
    return P.colour_index(px(spark, sf_dir))


@query("coarse_histogram", f"WITH {_PX}, k AS (SELECT image_id, r // 4 * 4 AS r, g // 4 * 4 AS g, b // 4 * 4 AS b, count(*) AS n FROM px GROUP BY ALL) SELECT *, round(n / (sum(n) OVER ())::DOUBLE, 9) AS weight FROM k")
def coarse_histogram(spark, sf_dir):
    return P.coarse_histogram(px(spark, sf_dir))


@query("compact_labels", f"""WITH {_PX}, {_PAL}, c AS (SELECT image_id, label, count(*) AS n FROM px GROUP BY ALL), h AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c JOIN pal USING (label)), h2 AS (SELECT *, {_HSV} AS hue FROM h)
SELECT image_id, label, (row_number() OVER (ORDER BY n DESC, floor((CASE WHEN hue < 0 THEN hue + 360 ELSE hue END) / 2 + 0.5)::INTEGER % 180, CASE WHEN mx = 0 THEN 0 ELSE floor(255::DOUBLE * (mx - mn) / mx + 0.5) END, mx, label) - 1)::INTEGER AS new_label FROM h2""")
def compact_labels(spark, sf_dir):
    return P.compact_labels(px(spark, sf_dir), pal(spark))


@query("recolour", f"WITH {_PX}, {_PAL} SELECT image_id, x, y, pal.r, pal.g, pal.b FROM px JOIN pal USING (label)")
def recolour(spark, sf_dir):
    return P.recolour(px(spark, sf_dir), pal(spark))


@query("debug_colours", f"WITH {_PX} SELECT pid, ((pid * 37 + 73) % 255)::INTEGER AS r, ((pid * 67 + 31) % 255)::INTEGER AS g, ((pid * 97 + 151) % 255)::INTEGER AS b FROM px")
def debug_colours(spark, sf_dir):
    return px(spark, sf_dir).select("pid", *[x.alias(c) for x, c in zip(C.debug_colour(F.col("pid")), "rgb")])


@query("colour_distances", f"WITH {_PX}, all_{_PAL}, pal AS (SELECT * FROM all_pal SEMI JOIN px USING (label)) SELECT a.label AS label1, b.label AS label2, round(sqrt(((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2)::DOUBLE), 6) AS distance FROM pal a JOIN pal b ON a.label <= b.label")
def colour_distances(spark, sf_dir):
    """Of the colours that the raster has."""
    return P.colour_distances(pal(spark).join(px(spark, sf_dir).select("label").distinct(), "label", "left_semi"))


@query("snap_colours", f"""WITH {_PX}, {_PAL}, src AS (SELECT DISTINCT r, g, b, NULL AS label FROM px UNION ALL SELECT r, g, b, label FROM pal), {_LAB},
d AS (SELECT c.r, c.g, c.b, p.label, round(sqrt((c.ll - p.ll) ** 2 + (c.la - p.la) ** 2 + (c.lb - p.lb) ** 2), 6) AS d FROM lab c JOIN lab p ON c.label IS NULL AND p.label IS NOT NULL)
SELECT r, g, b, label FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d, label) AS rn FROM d) WHERE rn = 1""")
def snap_colours(spark, sf_dir):
    return P.snap(px(spark, sf_dir), pal(spark))


@query("lloyd_step", f"""WITH {_PX}, {_PAL}, h AS (SELECT r // 4 * 4 AS r, g // 4 * 4 AS g, b // 4 * 4 AS b, count(*) AS n FROM px GROUP BY ALL), d AS (SELECT h.*, label AS k, row_number() OVER (PARTITION BY h.r, h.g, h.b ORDER BY sqrt(((h.r - pal.r) ** 2 + (h.g - pal.g) ** 2 + (h.b - pal.b) ** 2)::DOUBLE), label) AS rn FROM h, pal),
m AS (SELECT k, sum(r::DOUBLE * n) / sum(n) AS m0, sum(g::DOUBLE * n) / sum(n) AS m1, sum(b::DOUBLE * n) / sum(n) AS m2 FROM d WHERE rn = 1 GROUP BY k) SELECT k, dim, round(mean, 6) AS mean FROM (SELECT k, unnest([0, 1, 2]) AS dim, unnest([m0, m1, m2]) AS mean FROM m)""")
def lloyd_step(spark, sf_dir):
    points = P.coarse_histogram(px(spark, sf_dir)).select(F.array(*[F.col(c).cast("double") for c in "rgb"]).alias("v"), F.col("n").cast("double").alias("weight"))
    return P.lloyd_step(points, pal(spark).select(F.col("label").alias("k"), F.array(*[F.col(c).cast("double") for c in "rgb"]).alias("c")))


@query("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    return P.label_counts(U.kmeans_labels(px(spark, sf_dir), 8))


_CL = f"WITH {_PX}, cl AS (SELECT image_id, min(pid) AS first_seen, count(*) AS n FROM px GROUP BY image_id, g // 4)"


def _clusters(spark, sf_dir):
    return px(spark, sf_dir).groupBy("image_id", F.floor(F.col("g") / 4)).agg(F.min("pid").alias("first_seen"), F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(k) for c, k in zip("rgb", "lab")]).select("image_id", "first_seen", "n", "l", "a", "b")


@query("coverage_selection", _CL + """, o AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_seen)::INTEGER AS rn, coalesce(sum(n) OVER (ORDER BY n DESC, first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(n) OVER () AS total FROM cl)
SELECT image_id, first_seen, n, rn FROM o WHERE rn = 1 OR (n >= greatest(8, round_even(total * 0.005::DOUBLE, 0)) AND bef < round_even(total * 0.97::DOUBLE, 0) AND rn <= 48)""")
def coverage_selection(spark, sf_dir):
    return P.coverage_selection(_clusters(spark, sf_dir), 48)


@query("closest_pair", f"""WITH {_PX}, cl AS (SELECT image_id, min(pid) AS first_seen, round(avg(r), 6) AS l, round(avg(g), 6) AS a, round(avg(b), 6) AS b FROM px GROUP BY image_id, g // 4), d AS (SELECT p.image_id, p.first_seen AS first_seen1, q.first_seen AS first_seen2, round(sqrt((p.l - q.l) ** 2 + (p.a - q.a) ** 2 + (p.b - q.b) ** 2), 6) AS distance FROM cl p JOIN cl q ON p.first_seen < q.first_seen)
SELECT * FROM d ORDER BY distance, first_seen1, first_seen2 LIMIT 1""")
def closest_pair(spark, sf_dir):
    return P.closest_pair(_clusters(spark, sf_dir))


@query("regions", f"WITH RECURSIVE {_REG} SELECT * FROM regions")
def regions(spark, sf_dir):
    return R.region_table(_regions(spark, sf_dir))


@query("region_map", f"WITH RECURSIVE {_REG} SELECT pid, region_id FROM reg")
def region_map(spark, sf_dir):
    return _regions(spark, sf_dir).select("pid", "region_id")


@query("facets", f"""WITH RECURSIVE {_PX}, nx AS (SELECT a.pid AS p, a.label, a.x + o.dx AS x, a.y + o.dy AS y FROM px a, (VALUES (0, -1), (-1, 0), (1, 0), (0, 1)) o(dx, dy)), e AS MATERIALIZED (SELECT n.p, b.pid AS q FROM nx n JOIN px b ON n.x = b.x AND n.y = b.y AND n.label = b.label),
reach(p, root) AS (SELECT pid, pid FROM px UNION SELECT e.q, reach.root FROM reach JOIN e ON reach.p = e.p), top AS (SELECT p, min(root) AS root FROM reach GROUP BY p) SELECT pid, dense_rank() OVER (ORDER BY root)::BIGINT - 1 AS region_id FROM px JOIN top ON pid = p""")
def facets(spark, sf_dir):
    return R.region_map(px(spark, sf_dir), 4).select("pid", "region_id")


@query("adjacency", f"WITH RECURSIVE {_REG} SELECT 'events' AS image_id, * FROM adj")
def adjacency(spark, sf_dir):
    return R.adjacency(_regions(spark, sf_dir))


@query("facet_neighbours", f"WITH {_PX}, p AS (SELECT a.label AS s, b.label AS d FROM px a JOIN px b ON a.y = b.y AND abs(a.x - b.x) = 1 UNION ALL SELECT a.label, b.label FROM px a JOIN px b ON a.x = b.x AND abs(a.y - b.y) = 1) SELECT s AS src, list_sort(list(DISTINCT d)) AS neighbours FROM p WHERE s != d GROUP BY s")
def facet_neighbours(spark, sf_dir):
    return R.adjacency(px(spark, sf_dir), "label").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


@query("boundary", _AROUND.join(["WITH ", " SELECT image_id, x, y, coalesce(rr != label, FALSE) OR coalesce(d != label, FALSE) AS boundary FROM n"]))
def boundary(spark, sf_dir):
    return R.boundary_mask(px(spark, sf_dir), "label")


@query("border_points", _AROUND.join(["WITH ", " SELECT image_id, x, y, label FROM n WHERE NOT (coalesce(l = label, FALSE) AND coalesce(rr = label, FALSE) AND coalesce(u = label, FALSE) AND coalesce(d = label, FALSE))"]))
def border_points(spark, sf_dir):
    return R.border_points(px(spark, sf_dir))


@query("merge_candidates", f"WITH RECURSIVE {_REG} SELECT region_id, area, round(area / greatest(x2 - x1, y2 - y1)::DOUBLE, 6) AS thickness FROM regions WHERE area < {MIN_AREA} OR area <= {2 * MIN_AREA} AND area / greatest(x2 - x1, y2 - y1)::DOUBLE <= 5.5")
def merge_candidates(spark, sf_dir):
    return R.merge_candidates(regions(spark, sf_dir), MIN_AREA).select("region_id", "area", F.round(R.thickness(), 6).alias("thickness"))


def _plan(spark, sf_dir):
    p = _regions(spark, sf_dir)
    t = R.region_table(p)
    return p, t, R.merge_plan(t, R.adjacency(p), pal(spark), MIN_AREA)


@query("merge_plan", f"WITH RECURSIVE {_PLAN} SELECT src, dst FROM plan")
def merge_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[2].select("src", "dst")


@query("merge_apply", f"""WITH RECURSIVE {_PLAN}, chase(src, cur) AS (SELECT src, dst FROM plan UNION ALL SELECT chase.src, plan.dst FROM chase JOIN plan ON chase.cur = plan.src), fin AS (SELECT src, cur FROM chase WHERE cur NOT IN (SELECT src FROM plan))
SELECT pid, coalesce(t.color_index, reg.label)::INTEGER AS label FROM reg LEFT JOIN fin ON fin.src = reg.region_id LEFT JOIN regions t ON t.region_id = fin.cur""")
def merge_apply(spark, sf_dir):
    return R.apply_merges(*_plan(spark, sf_dir)).select("pid", "label")


@query("merge_driver")
def merge_driver(spark, sf_dir):
    return R.merge_small_regions(px(spark, sf_dir), pal(spark), MIN_AREA).select("pid", "label")


@query("paintability", f"""WITH RECURSIVE {_REG} SELECT image_id, max(x2)::BIGINT AS width, max(y2)::BIGINT AS height, count(DISTINCT color_index) AS colors, count(*) AS regions_total, count(*) FILTER (area >= {MIN_AREA}) AS regions_numbered, count(*) FILTER (area < {MIN_AREA}) AS regions_too_small_for_label, {MIN_AREA}::BIGINT AS min_label_area, min(area) AS smallest_region, max(area) AS largest_region, round_even(median(area), 3) AS median_region_area,
coalesce(min(area) FILTER (area >= {MIN_AREA}), 0) AS smallest_numbered_region, coalesce(max(area) FILTER (area < {MIN_AREA}), 0) AS largest_unnumbered_region, TRUE AS small_area_merging, {MIN_AREA}::BIGINT AS small_region_merge_area, FALSE AS colored_edges_written, FALSE AS auto_color_count FROM regions GROUP BY image_id""")
def paintability(spark, sf_dir):
    return R.paintability(regions(spark, sf_dir), S.image_sizes(px(spark, sf_dir)), MIN_AREA)


@query("facet_palette_stats", f"WITH RECURSIVE {_REG}, g AS (SELECT image_id, color_index AS colour, sum(area)::BIGINT AS frequency FROM regions GROUP BY ALL) SELECT *, round(frequency / (sum(frequency) OVER ())::DOUBLE, 9) AS share, row_number() OVER (ORDER BY frequency DESC, colour)::INTEGER AS rank FROM g")
def facet_palette_stats(spark, sf_dir):
    return P.facet_palette_stats(regions(spark, sf_dir))


@query("unnumbered_regions", f"WITH RECURSIVE {_REG} SELECT region_id, area FROM regions WHERE area < {MIN_AREA}")
def unnumbered_regions(spark, sf_dir):
    t = regions(spark, sf_dir)
    return t.join(R.label_worthy(t, MIN_AREA).select("region_id"), "region_id", "left_anti").select("region_id", "area")


@query("draw_order", f"WITH RECURSIVE {_REG} SELECT region_id, area, row_number() OVER (ORDER BY area DESC, region_id)::INTEGER AS place FROM regions WHERE area >= {MIN_AREA}")
def draw_order(spark, sf_dir):
    return R.size_order(R.label_worthy(regions(spark, sf_dir), MIN_AREA)).select("region_id", "area", "place")


def _strip_runs(runs: int) -> str:
    """SQL of so many runs of the strip cleanup; a run that changes nothing repeats itself."""
    sql = [f"WITH {_PX}, px0 AS (SELECT pid, x, y, label FROM px), {_PAL}, src AS (SELECT * FROM pal), {_LAB}, l8 AS (SELECT label, [round_even(ll * 2.55, 0), round_even(la + 128, 0), round_even(lb + 128, 0)] AS lab FROM lab), near AS (SELECT a.label, b.label AS t FROM l8 a, l8 b WHERE list_distance(a.lab, b.lab) <= 26)"]
    for k in range(runs):
        around = _AROUND.removeprefix(_PX + ", ").replace("n AS (", f"n{k} AS MATERIALIZED (", 1).replace(" px ", f" px{k} ")
        sql.append(f"""{around}, cnt{k} AS (SELECT label AS t, count(*) AS c FROM px{k} GROUP BY ALL),
inn{k} AS (SELECT * FROM n{k} WHERE l IS NOT NULL AND rr IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL),
o{k} AS (SELECT pid, label, 0 AS k, l AS t FROM inn{k} WHERE l = rr UNION ALL SELECT pid, label, 1, u FROM inn{k} WHERE u = d UNION ALL SELECT pid, label, 2, ul FROM inn{k} WHERE ul = dr UNION ALL SELECT pid, label, 3, ur FROM inn{k} WHERE ur = dl UNION ALL SELECT pid, label, 4, l FROM inn{k} WHERE l = u AND l = d UNION ALL SELECT pid, label, 5, rr FROM inn{k} WHERE rr = u AND rr = d UNION ALL SELECT pid, label, 6, u FROM inn{k} WHERE u = l AND u = rr UNION ALL SELECT pid, label, 7, d FROM inn{k} WHERE d = l AND d = rr),
best{k} AS (SELECT pid, arg_max(o.t, c * 10 - k) AS t FROM o{k} o JOIN near ON near.label = o.label AND near.t = o.t JOIN cnt{k} cnt ON cnt.t = o.t WHERE o.t != o.label GROUP BY pid),
px{k + 1} AS MATERIALIZED (SELECT pid, x, y, coalesce(t, label)::INTEGER AS label FROM px{k} LEFT JOIN best{k} USING (pid))""")
    return ", ".join(sql) + f" SELECT pid, label FROM px{runs}"


def _prune(steps: int) -> str:
    """SQL of pruning: what an opening removes is filled from above, below, left and right, so many times."""
    sql = [f"""WITH {_AROUND}, e AS MATERIALIZED (SELECT *, CASE WHEN coalesce(l = label, TRUE) AND coalesce(rr = label, TRUE) AND coalesce(u = label, TRUE) AND coalesce(d = label, TRUE) THEN label END AS core FROM n),
o AS (SELECT c.pid, c.x, c.y, c.label, coalesce(bool_or(m.core = c.label), FALSE) AS opened FROM e c LEFT JOIN e m ON abs(m.x - c.x) + abs(m.y - c.y) <= 1 AND m.x BETWEEN c.x - 1 AND c.x + 1 AND m.y BETWEEN c.y - 1 AND c.y + 1 GROUP BY ALL),
p0 AS MATERIALIZED (SELECT pid, x, y, CASE WHEN NOT opened AND bool_or(opened) OVER (PARTITION BY label) THEN -1 ELSE label END AS label FROM o)"""]
    for k, (dx, dy) in enumerate([(0, -1), (0, 1), (-1, 0), (1, 0)] * steps):
        sql.append(f"p{k + 1} AS MATERIALIZED (SELECT c.pid, c.x, c.y, CASE WHEN c.label < 0 AND m.label >= 0 THEN m.label ELSE c.label END AS label FROM p{k} c LEFT JOIN p{k} m ON m.x = c.x + {dx} AND m.y = c.y + {dy})")
    return ", ".join(sql) + f" SELECT pid, label FROM p{4 * steps}"


@query("strip_cleanup", f"""WITH {_AROUND}, {_PAL}, src AS (SELECT * FROM pal), {_LAB}, l8 AS (SELECT label, [round_even(ll * 2.55, 0), round_even(la + 128, 0), round_even(lb + 128, 0)] AS lab FROM lab), near AS (SELECT a.label, b.label AS t FROM l8 a, l8 b WHERE list_distance(a.lab, b.lab) <= 26), cnt AS (SELECT label AS t, count(*) AS c FROM px GROUP BY ALL),
inn AS (SELECT * FROM n WHERE l IS NOT NULL AND rr IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL),
o AS (SELECT pid, label, 0 AS k, l AS t FROM inn WHERE l = rr UNION ALL SELECT pid, label, 1, u FROM inn WHERE u = d UNION ALL SELECT pid, label, 2, ul FROM inn WHERE ul = dr UNION ALL SELECT pid, label, 3, ur FROM inn WHERE ur = dl UNION ALL SELECT pid, label, 4, l FROM inn WHERE l = u AND l = d UNION ALL SELECT pid, label, 5, rr FROM inn WHERE rr = u AND rr = d UNION ALL SELECT pid, label, 6, u FROM inn WHERE u = l AND u = rr UNION ALL SELECT pid, label, 7, d FROM inn WHERE d = l AND d = rr),
best AS (SELECT pid, arg_max(o.t, c * 10 - k) AS t FROM o JOIN near ON near.label = o.label AND near.t = o.t JOIN cnt ON cnt.t = o.t WHERE o.t != o.label GROUP BY pid) SELECT px.pid, coalesce(t, label)::INTEGER AS label FROM px LEFT JOIN best USING (pid)""")
def strip_cleanup(spark, sf_dir):
    return K.strip_once(px(spark, sf_dir), pal(spark)).select("pid", "label")


@query("strip_cleanup_runs", _strip_runs(8))
def strip_cleanup_runs(spark, sf_dir):
    return K.strip_cleanup(px(spark, sf_dir), pal(spark), 8).select("pid", "label")


@query("strip_in_place")
def strip_in_place(spark, sf_dir):
    return K.strip_in_place(px(spark, sf_dir), pal(spark)).select("pid", "label")


@query("opening", f"""WITH {_AROUND}, e AS (SELECT *, CASE WHEN coalesce(l = label, TRUE) AND coalesce(rr = label, TRUE) AND coalesce(u = label, TRUE) AND coalesce(d = label, TRUE) THEN label END AS core FROM n)
SELECT c.pid, coalesce(c.core = c.label, FALSE) OR coalesce(l.core = c.label, FALSE) OR coalesce(r_.core = c.label, FALSE) OR coalesce(u.core = c.label, FALSE) OR coalesce(d.core = c.label, FALSE) AS opened FROM e c
LEFT JOIN e l ON l.y = c.y AND l.x = c.x - 1 LEFT JOIN e r_ ON r_.y = c.y AND r_.x = c.x + 1 LEFT JOIN e u ON u.y = c.y - 1 AND u.x = c.x LEFT JOIN e d ON d.y = c.y + 1 AND d.x = c.x""")
def opening(spark, sf_dir):
    return K.opening(px(spark, sf_dir)).select("pid", "opened")


@query("prune_protrusions", _prune(12))
def prune_protrusions(spark, sf_dir):
    return K.prune_protrusions(px(spark, sf_dir)).select("pid", "label")


@query("expand_owner", _AROUND.join(["WITH ", " SELECT pid, coalesce(nullif(label, 4), nullif(u, 4), nullif(d, 4), nullif(l, 4), nullif(rr, 4), nullif(ul, 4), nullif(ur, 4), nullif(dl, 4), nullif(dr, 4)) AS region_id FROM n"]))
def expand_owner(spark, sf_dir):
    p = px(spark, sf_dir).select("image_id", "x", "y", "pid", F.when(F.col("label") != 4, F.col("label")).alias("region_id"))
    return K.expand_owner(p, 1).select("pid", "region_id")


@query("bilateral", f"""WITH {_PX}, lim AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px), o AS (SELECT dx, dy FROM range(-4, 5) a(dx), range(-4, 5) b(dy) WHERE dx * dx + dy * dy <= 16),
n AS (SELECT a.image_id, a.x, a.y, a.r AS r0, a.g AS g0, a.b AS b0, dx * dx + dy * dy AS d, CASE WHEN a.x + dx < 0 THEN -(a.x + dx) WHEN a.x + dx >= w THEN 2 * w - 2 - a.x - dx ELSE a.x + dx END AS x2, CASE WHEN a.y + dy < 0 THEN -(a.y + dy) WHEN a.y + dy >= h THEN 2 * h - 2 - a.y - dy ELSE a.y + dy END AS y2 FROM px a, lim, o),
v AS (SELECT n.*, q.r, q.g, q.b, abs(q.r - r0) + abs(q.g - g0) + abs(q.b - b0) AS far FROM n JOIN px q ON q.x = x2 AND q.y = y2), k AS (SELECT *, exp(-d / 5000::DOUBLE - far * far / 5000::DOUBLE) AS k FROM v)
SELECT image_id, x, y, round_even(sum(k * r) / sum(k), 0)::INTEGER AS r, round_even(sum(k * g) / sum(k), 0)::INTEGER AS g, round_even(sum(k * b) / sum(k), 0)::INTEGER AS b FROM k GROUP BY image_id, x, y""")
def bilateral(spark, sf_dir):
    return K.bilateral(px(spark, sf_dir))


@query("label_points", f"WITH RECURSIVE {_DIST} SELECT region_id, x, y, round(sqrt(d2::DOUBLE), 6) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY d2 DESC, y, x) AS rn FROM dist) WHERE rn = 1")
def label_points(spark, sf_dir):
    return R.label_points(_regions(spark, sf_dir)).select("region_id", "x", "y", "radius")


@query("area_resample", f"WITH {_PX} SELECT image_id, x // 4 AS x, y // 4 AS y, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM px GROUP BY 1, 2, 3")
def area_resample(spark, sf_dir):
    return S.area_resample(px(spark, sf_dir), 4)


@query("fit_sizes", "SELECT p_partkey, greatest(1, floor((p_size * 40) * least(1, 1024::DOUBLE / (p_size * 40), 1024::DOUBLE / (p_partkey + 1)) + 0.5))::INTEGER AS w, greatest(1, floor((p_partkey + 1) * least(1, 1024::DOUBLE / (p_size * 40), 1024::DOUBLE / (p_partkey + 1)) + 0.5))::INTEGER AS h FROM part")
def fit_sizes(spark, sf_dir):
    w, h = S.fit_inside(F.col("p_size") * 40, F.col("p_partkey") + 1, 1024, 1024)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", w.alias("w"), h.alias("h"))


@query("flatten_alpha", f"WITH {_PX} SELECT pid, floor(255 * (1 - b / 255::DOUBLE) + r * (b / 255::DOUBLE) + 0.5)::INTEGER AS flat, floor((r * 257) * 255::DOUBLE / 65535 + 0.5)::INTEGER AS narrow FROM px")
def flatten_alpha(spark, sf_dir):
    return px(spark, sf_dir).select("pid", S.flatten_alpha(F.col("r"), F.col("b")).alias("flat"), S.narrow_channel(F.col("r") * 257, 16).alias("narrow"))


@query("png_sink")
def png_sink(spark, sf_dir):
    return S.write_png(px(spark, sf_dir))


@query("base64_chunks", "WITH t AS (SELECT conv_id, turn, base64(encode(text)) AS b FROM conversations), n AS (SELECT *, unnest(range(0, greatest(1, ceil(length(b) / 100::DOUBLE))::BIGINT)) AS i FROM t) SELECT conv_id, turn, i::INTEGER AS chunk_index, substr(b, i * 100 + 1, 100) AS chunk FROM n")
def base64_chunks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    b = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    return c.select("conv_id", "turn", F.posexplode(S.chunks(b, 100)).alias("chunk_index", "chunk"))


@query("chunk_assembly", "SELECT conv_id AS request_id, count(DISTINCT turn) = max(turn) + 1 AS complete, CASE WHEN count(DISTINCT turn) = max(turn) + 1 THEN string_agg(text, '' ORDER BY turn) END AS text FROM conversations GROUP BY conv_id")
def chunk_assembly(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    total = F.max("turn").over(Window.partitionBy("conv_id")) + 1
    return T.assemble(c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("chunk_index"), F.col("turn").alias("seq"), total.alias("total_chunks"), F.col("text").alias("chunk")))


@query("progress_overall", """WITH st(i, before, share) AS (VALUES (0, 0::DOUBLE, 6::DOUBLE), (1, 6, 24), (2, 30, 2), (3, 32, 16), (4, 48, 6), (5, 54, 14), (6, 68, 12), (7, 80, 10), (8, 90, 5), (9, 95, 5))
SELECT event_id, floor(least(1, greatest(0, value / 500)) * share + before + 0.5)::INTEGER AS progress FROM events JOIN st ON event_id % 10 = i""")
def progress_overall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stage = F.get(F.array(*[F.lit(n) for n, _ in T.STAGES]), (F.col("event_id") % 10).cast("int"))
    return e.select("event_id", T.overall(stage, F.col("value") / 500).alias("progress"))


@query("progress_throttle", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, least(1, greatest(0, value / 500)) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, t, p, TRUE AS go FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.n, CASE WHEN g THEN e.t ELSE f.t END, CASE WHEN g THEN e.p ELSE f.p END, g FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1, LATERAL (SELECT e.p >= 1 OR e.p - f.p >= 0.03::DOUBLE OR e.t - f.t >= 150 AS g))
SELECT user_id AS request_id, event_id AS seq FROM f WHERE go""")
def progress_throttle(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return T.throttle(e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("value") / 500).alias("local")))


@query("message_routing", "SELECT event_type AS type, user_id::VARCHAR AS \"requestId\" FROM events WHERE event_type IN ('click', 'view')")
def message_routing(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return T.route(e.select(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("requestId"))).alias("message")), ["click", "view"]).select("type", "requestId")


@query("recent_items", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 6")
def recent_items(spark, sf_dir):
    return T.recent(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")))


@query("stage_timings", "SELECT event_type AS stage, round(sum(value), 4) AS ms FROM events GROUP BY 1")
def stage_timings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return T.timings(e.select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))).select("stage", F.round("ms", 4).alias("ms"))


def _paths(pixels):
    p = pixels.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("pid", "r", "g"))).alias("ps"))
    return p.select("y", F.transform("ps", lambda q: F.struct(q.r.cast("double").alias("x"), q.g.cast("double").alias("y"))).alias("points"))


@query("shoelace", f"WITH {_PX}, p AS (SELECT *, lead(r) OVER w AS r2, lead(g) OVER w AS g2, first(r) OVER w AS r0, first(g) OVER w AS g0 FROM px WINDOW w AS (PARTITION BY y ORDER BY x)) SELECT y, abs(sum(r * coalesce(g2, g0) - coalesce(r2, r0) * g))::DOUBLE / 2 AS area FROM p GROUP BY y")
def shoelace(spark, sf_dir):
    return _paths(px(spark, sf_dir)).select("y", O.shoelace(F.col("points")).alias("area"))


_FAC = f"""{_PX}, nx AS (SELECT a.pid AS p, a.label, a.x + o.dx AS x, a.y + o.dy AS y FROM px a, (VALUES (0, -1), (-1, 0), (1, 0), (0, 1)) o(dx, dy)), e AS MATERIALIZED (SELECT n.p, b.pid AS q FROM nx n JOIN px b ON n.x = b.x AND n.y = b.y AND n.label = b.label),
reach(p, root) AS (SELECT pid, pid FROM px UNION SELECT e.q, reach.root FROM reach JOIN e ON reach.p = e.p), top AS (SELECT p, min(root) AS root FROM reach GROUP BY p), fac AS (SELECT px.*, dense_rank() OVER (ORDER BY root)::BIGINT - 1 AS region_id FROM px JOIN top ON pid = p)"""


def _facets(spark, sf_dir):
    from ..sources.store import materialize

    return materialize(R.region_map(px(spark, sf_dir), 4))


def _height(pixels) -> int:
    return pixels.agg(F.max("y")).first()[0] + 1


_WALLS = f"""{_FAC}, n AS (SELECT c.region_id, c.x, c.y, coalesce(l.region_id, -1) AS l, coalesce(u.region_id, -1) AS u, coalesce(r_.region_id, -1) AS r, coalesce(d.region_id, -1) AS d, coalesce(ul.region_id, -1) AS ul, coalesce(ur.region_id, -1) AS ur, coalesce(dl.region_id, -1) AS dl, coalesce(dr.region_id, -1) AS dr FROM fac c LEFT JOIN fac l ON l.x = c.x - 1 AND l.y = c.y + 0 LEFT JOIN fac u ON u.x = c.x + 0 AND u.y = c.y - 1 LEFT JOIN fac r_ ON r_.x = c.x + 1 AND r_.y = c.y + 0 LEFT JOIN fac d ON d.x = c.x + 0 AND d.y = c.y + 1 LEFT JOIN fac ul ON ul.x = c.x - 1 AND ul.y = c.y - 1 LEFT JOIN fac ur ON ur.x = c.x + 1 AND ur.y = c.y - 1 LEFT JOIN fac dl ON dl.x = c.x - 1 AND dl.y = c.y + 1 LEFT JOIN fac dr ON dr.x = c.x + 1 AND dr.y = c.y + 1),
w AS MATERIALIZED (SELECT region_id, x, y, 0 AS side, l AS neighbour, CASE WHEN u != region_id THEN x WHEN ul != region_id THEN x + 0 ELSE x - 1 END AS nx, CASE WHEN u != region_id THEN y WHEN ul != region_id THEN y - 1 ELSE y - 1 END AS ny, CASE WHEN u != region_id THEN 1 WHEN ul != region_id THEN 0 ELSE 3 END AS ns FROM n WHERE l != region_id
  UNION ALL SELECT region_id, x, y, 1 AS side, u AS neighbour, CASE WHEN r != region_id THEN x WHEN ur != region_id THEN x + 1 ELSE x + 1 END AS nx, CASE WHEN r != region_id THEN y WHEN ur != region_id THEN y + 0 ELSE y - 1 END AS ny, CASE WHEN r != region_id THEN 2 WHEN ur != region_id THEN 1 ELSE 0 END AS ns FROM n WHERE u != region_id
  UNION ALL SELECT region_id, x, y, 2 AS side, r AS neighbour, CASE WHEN d != region_id THEN x WHEN dr != region_id THEN x + 0 ELSE x + 1 END AS nx, CASE WHEN d != region_id THEN y WHEN dr != region_id THEN y + 1 ELSE y + 1 END AS ny, CASE WHEN d != region_id THEN 3 WHEN dr != region_id THEN 2 ELSE 1 END AS ns FROM n WHERE r != region_id
  UNION ALL SELECT region_id, x, y, 3 AS side, d AS neighbour, CASE WHEN l != region_id THEN x WHEN dl != region_id THEN x - 1 ELSE x - 1 END AS nx, CASE WHEN l != region_id THEN y WHEN dl != region_id THEN y + 0 ELSE y + 1 END AS ny, CASE WHEN l != region_id THEN 0 WHEN dl != region_id THEN 3 ELSE 2 END AS ns FROM n WHERE d != region_id)"""


@query("border_paths", f"""WITH RECURSIVE {_WALLS}, first AS (SELECT region_id, arg_min(x, y * 1000000 + x) AS sx, min(y) AS sy FROM w WHERE side = 0 AND neighbour != region_id GROUP BY region_id),
path AS (SELECT w.*, 0 AS place, sx, sy FROM w JOIN first ON w.region_id = first.region_id AND x = sx AND y = sy AND side = 0
  UNION ALL SELECT w.*, place + 1, sx, sy FROM path JOIN w ON w.region_id = path.region_id AND w.x = path.nx AND w.y = path.ny AND w.side = path.ns WHERE NOT (path.nx = sx AND path.ny = sy AND path.ns = 0))
SELECT region_id, place, x, y, side, neighbour FROM path""")
def border_paths(spark, sf_dir):
    return B.border_paths(B.border_pixels(_facets(spark, sf_dir))).select("region_id", "place", "x", "y", "side", "neighbour")


@query("border_segments")
def border_segments(spark, sf_dir):
    p = _facets(spark, sf_dir)
    return B.halved(B.border_segments(B.border_paths(B.border_pixels(p))), S.WIDTH, _height(p)).select("region_id", "segment", "neighbour", F.size("points").alias("n_points"))


@query("matched_segments")
def matched_segments(spark, sf_dir):
    p = _facets(spark, sf_dir)
    return B.facet_outlines(p, S.WIDTH, _height(p)).select("region_id", "segment", "neighbour", "reverse")


@query("facet_label_bounds")
def facet_label_bounds(spark, sf_dir):
    p = _facets(spark, sf_dir)
    return B.label_bounds(p, B.facet_outlines(p, S.WIDTH, _height(p)))


@query("svg_document")
def svg_document(spark, sf_dir):
    """The pieces of the picture's SVG, with fill, stroke and labels."""
    p = _facets(spark, sf_dir)
    boundary = B.facet_outlines(p, S.WIDTH, _height(p))
    colour = R.region_table(p).join(pal(spark), F.col("color_index") == F.col("label")).select("image_id", "region_id", "color_index", "r", "g", "b")
    ring = B.rings(boundary, walls=False).join(colour, ["image_id", "region_id"]).select("image_id", F.col("region_id").alias("facet_id"), "color_index", "r", "g", "b", B.closed(F.col("points")).alias("points"))
    labels = B.label_bounds(p, boundary).select("image_id", F.col("region_id").alias("facet_id"), "min_x", "min_y", "max_x", "max_y")
    return O.svg_parts(ring, S.image_sizes(p), 3.0, labels=labels)


@query("facet_reduction")
def facet_reduction(spark, sf_dir):
    return D.reduce_facets(px(spark, sf_dir), pal(spark), MIN_AREA).select("pid", "label")


@query("nearest_borders", f"""WITH RECURSIVE {_FAC}, {_PAL}, size AS (SELECT region_id, count(*) AS area FROM fac GROUP BY region_id HAVING count(*) < {MIN_AREA}),
step AS (SELECT a.pid, a.region_id AS f, q.region_id AS t, q.x, q.y, q.label FROM fac a JOIN fac q ON q.x BETWEEN a.x - 1 AND a.x + 1 AND q.y BETWEEN a.y - 1 AND a.y + 1 AND abs(a.x - q.x) + abs(a.y - q.y) = 1 AND q.region_id != a.region_id),
chosen AS (SELECT region_id FROM size WHERE region_id NOT IN (SELECT f FROM step JOIN size ON size.region_id = t WHERE f > t)),
rim AS (SELECT DISTINCT f AS region_id, x, y, label FROM step SEMI JOIN chosen ON chosen.region_id = f),
far AS (SELECT fac.pid, rim.label, abs(fac.x - rim.x) + abs(fac.y - rim.y) AS distance, sqrt(((o.r - n.r) * (o.r - n.r) + (o.g - n.g) * (o.g - n.g) + (o.b - n.b) * (o.b - n.b))::DOUBLE) AS colour FROM fac JOIN rim USING (region_id) JOIN pal o ON o.label = fac.label JOIN pal n ON n.label = rim.label)
SELECT pid, label, distance::BIGINT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, colour, label) AS rn FROM far) WHERE rn = 1""")
def nearest_borders(spark, sf_dir):
    """Small facets beside which no small one has a lower number give their pixels away."""
    p = _facets(spark, sf_dir)
    return D.given_away(D.lowest_small(p, MIN_AREA), p, pal(spark)).select("pid", "label", "distance")


@query("small_facets", f"WITH RECURSIVE {_FAC} SELECT region_id, count(*) AS area FROM fac GROUP BY region_id HAVING count(*) < {MIN_AREA}")
def small_facets(spark, sf_dir):
    return D.small_facets(R.region_table(_facets(spark, sf_dir)), MIN_AREA).select("region_id", "area")


@query("neighbours_of_facets", f"WITH RECURSIVE {_FAC}, p AS (SELECT a.region_id AS s, b.region_id AS d FROM fac a JOIN fac b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.x BETWEEN b.x - 1 AND b.x + 1 AND (a.y = b.y OR a.x = b.x)) SELECT s AS region_id, list_sort(list(DISTINCT d) FILTER (d != s)) AS neighbours FROM p GROUP BY s")
def neighbours_of_facets(spark, sf_dir):
    return D.facet_neighbours(_facets(spark, sf_dir)).select("region_id", "neighbours")


@query("merge_order", f"WITH RECURSIVE {_REG} SELECT region_id, area, row_number() OVER (ORDER BY area, region_id)::INTEGER AS place FROM regions WHERE area < {MIN_AREA} OR area <= {2 * MIN_AREA} AND area / greatest(x2 - x1, y2 - y1)::DOUBLE <= 5.5")
def merge_order(spark, sf_dir):
    return R.merge_order(regions(spark, sf_dir), MIN_AREA).select("region_id", "area", "place")


@query("size_order", f"WITH RECURSIVE {_REG} SELECT region_id, area, row_number() OVER (ORDER BY area DESC, region_id)::INTEGER AS place FROM regions")
def size_order(spark, sf_dir):
    return R.size_order(regions(spark, sf_dir)).select("region_id", "area", "place")


_TINT = ", ".join(f"CASE WHEN coalesce(rr != n.label, FALSE) OR coalesce(d != n.label, FALSE) THEN 32 ELSE round_even(255 * (1 - 0.16::DOUBLE) + pal.{c} * 0.16::DOUBLE, 0)::INTEGER END AS {c}" for c in "rgb")


@query("template_layers", _AROUND.join(["WITH ", f", {_PAL} SELECT n.x, n.y, {_TINT} FROM n JOIN pal ON pal.label = n.label"]))
def template_layers(spark, sf_dir):
    return M.template(_regions(spark, sf_dir), pal(spark), "bright-color-circles").select("x", "y", "r", "g", "b")


_RIM = [f"(CASE WHEN b.b THEN p.{c} WHEN sqrt(d2::DOUBLE) <= rim + 0.25 OR near THEN round_even({g} * (1 - alpha) + p.{c} * alpha, 0)::INTEGER ELSE {g} END)::INTEGER AS {c}" for c, g in zip("rgb", M.GROUND)]


@query("coloured_rims", f"""WITH RECURSIVE {_DIST}, {_PAL}, bm AS (SELECT o.pid, o.x, o.y, coalesce(r_.region_id != o.region_id, FALSE) OR coalesce(d.region_id != o.region_id, FALSE) AS b FROM reg o LEFT JOIN reg r_ ON r_.y = o.y AND r_.x = o.x + 1 LEFT JOIN reg d ON d.x = o.x AND d.y = o.y + 1),
t AS (SELECT a.pid, bool_or(c.b) AS near FROM bm a JOIN bm c ON c.x BETWEEN a.x - 1 AND a.x + 1 AND c.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.pid), z AS (SELECT greatest(3, least(6, round_even(greatest(w, h) / 360::DOUBLE, 0)::INTEGER)) AS rim FROM lim),
f AS (SELECT dist.*, rim, 0.18::DOUBLE + 0.64::DOUBLE * least(1, greatest(0, (rim + 1 - sqrt(d2::DOUBLE)) / rim::DOUBLE)) AS alpha FROM dist, z)
SELECT f.x, f.y, {", ".join(_RIM)} FROM f JOIN t USING (pid) JOIN bm b USING (pid) JOIN pal p ON p.label = f.label""")
def coloured_rims(spark, sf_dir):
    return M.template(_regions(spark, sf_dir), pal(spark), "colored-edges").select("x", "y", "r", "g", "b")


_BOX = "least(p_size % 7 + 1, greatest(1, (least(p_size * 9, 300) - 2) // 2))"


@query("marker_geometry", f"""WITH c AS (SELECT p_partkey, p_size * 9 AS w, 300 AS h, (p_partkey % 600)::INTEGER AS x, (p_partkey % 400)::INTEGER AS y, {_BOX}::INTEGER AS r FROM part),
b AS (SELECT *, r + 1 AS low, w - r - 2 AS hx, h - r - 2 AS hy FROM c)
SELECT p_partkey, r, (CASE WHEN hx < low THEN w // 2 ELSE least(greatest(x, low), hx) END)::INTEGER AS cx, (CASE WHEN hy < low THEN h // 2 ELSE least(greatest(y, low), hy) END)::INTEGER AS cy, greatest(3, least(5, round_even(greatest(w, h) / 300::DOUBLE, 0)))::INTEGER AS fixed FROM b""")
def marker_geometry(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    w, h = (F.col("p_size") * 9).cast("int"), F.lit(300)
    x, y, r = M.within_canvas((F.col("p_partkey") % 600).cast("int"), (F.col("p_partkey") % 400).cast("int"), (F.col("p_size") % 7 + 1).cast("int"), w, h)
    return part.select("p_partkey", r.cast("int").alias("r"), x.alias("cx"), y.alias("cy"), M.marker_radius(w, h).alias("fixed"))


# of each region that is large enough its label point, number and the image's size
_PLACED = f"""{_DIST}, pt AS (SELECT region_id, label, x, y, sqrt(d2::DOUBLE) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY d2 DESC, y, x) AS rn FROM dist) WHERE rn = 1),
t AS (SELECT pt.region_id, pt.label + 1 AS number, area, pt.x, pt.y, round(radius, 6) AS radius, w, h, (20 * length((pt.label + 1)::VARCHAR))::DOUBLE AS tw FROM pt JOIN regions USING (region_id), lim WHERE area >= {MIN_AREA})"""


def _placed(spark, sf_dir):
    p = _regions(spark, sf_dir)
    table = R.label_worthy(R.region_table(p), MIN_AREA).select("image_id", "region_id", (F.col("color_index") + 1).alias("number"), "area")
    return table.join(R.label_points(p), ["image_id", "region_id"]).join(S.image_sizes(px(spark, sf_dir)), "image_id")


@query("region_markers", f"""WITH RECURSIVE {_PLACED}, m AS (SELECT *, least(least(greatest(3, least(5, round_even(greatest(w, h) / 300::DOUBLE, 0)::INTEGER)), greatest(1, floor(radius * 0.75)::INTEGER)), greatest(1, floor((least(w, h) - 2) / 2::DOUBLE)::INTEGER)) AS r FROM t)
SELECT region_id, (CASE WHEN w - r - 2 < r + 1 THEN w // 2 ELSE least(greatest(x, r + 1), w - r - 2) END)::INTEGER AS marker_x, (CASE WHEN h - r - 2 < r + 1 THEN h // 2 ELSE least(greatest(y, r + 1), h - r - 2) END)::INTEGER AS marker_y, r::INTEGER AS marker_radius FROM m""")
def region_markers(spark, sf_dir):
    """The disc of each region that is large enough, at its label point."""
    return M.markers(_placed(spark, sf_dir), F.col("width"), F.col("height")).select("region_id", "marker_x", "marker_y", "marker_radius")


_WEIGHT = "greatest(1, round_even(s * 1.8::DOUBLE, 0)::INTEGER)"
_FITS = f"(round_even(tw * s, 0) <= greatest(1, w - 2 * greatest(3, {_WEIGHT} + 2)) AND round_even(21 * s, 0) + round_even(9 * s, 0) <= greatest(1, h - 2 * greatest(3, {_WEIGHT} + 2)))"
_CIRCLE = f"greatest(6, ceil(greatest(round_even(tw * s, 0), round_even(21 * s, 0) + round_even(9 * s, 0)) / 2 + greatest(4, {_WEIGHT} + 3))::INTEGER)"


@query("label_texts", f"""WITH RECURSIVE {_PLACED}, o AS (SELECT *, least(0.62::DOUBLE, greatest(0.42::DOUBLE, greatest(w, h) / 2600::DOUBLE)) AS low, least(0.85::DOUBLE, greatest(0.62::DOUBLE, greatest(w, h) / 1500::DOUBLE)) AS high FROM t),
s1(region_id, s, k) AS (SELECT region_id, least(high, greatest(low, least(sqrt(area::DOUBLE) / 95, greatest(radius * 0.075::DOUBLE, low)))), 0 FROM o UNION ALL SELECT s1.region_id, s * 0.88::DOUBLE, k + 1 FROM s1 JOIN o USING (region_id)
  WHERE k < 20 AND s > 0.28 AND NOT (round_even(tw * s, 0) <= greatest(8, radius * 1.65::DOUBLE) AND round_even(21 * s, 0) <= greatest(8, radius * 1.35::DOUBLE))),
e1 AS (SELECT region_id, greatest(0.28::DOUBLE, arg_max(s, k)) AS s FROM s1 GROUP BY region_id),
s2(region_id, s, k) AS (SELECT region_id, s, 0 FROM e1 UNION ALL SELECT s2.region_id, s * 0.9::DOUBLE, k + 1 FROM s2 JOIN o USING (region_id) WHERE k < 24 AND s > 0.22 AND NOT {_FITS}), e2 AS (SELECT region_id, arg_max(s, k) AS s FROM s2 GROUP BY region_id),
s3(region_id, s, k) AS (SELECT region_id, s, 0 FROM e2 UNION ALL SELECT s3.region_id, s * 0.9::DOUBLE, k + 1 FROM s3 JOIN o USING (region_id) WHERE k < 24 AND s > 0.22 AND NOT {_CIRCLE} <= greatest(1, radius * 0.82::DOUBLE)), e3 AS (SELECT region_id, arg_max(s, k) AS s FROM s3 GROUP BY region_id),
c AS (SELECT region_id, s AS circle_scale, least(least({_CIRCLE}, greatest(1, floor(greatest(1, radius * 0.82::DOUBLE))::INTEGER)), greatest(1, floor((least(w, h) - 2) / 2::DOUBLE)::INTEGER)) AS r, x, y, w, h FROM e3 JOIN o USING (region_id)),
g AS (SELECT region_id, s, x, y, w, h, round_even(tw * s, 0)::INTEGER AS bw, round_even(21 * s, 0)::INTEGER AS bh, round_even(9 * s, 0)::INTEGER AS bb, greatest(3, {_WEIGHT} + 2) AS margin FROM e2 JOIN o USING (region_id))
SELECT region_id, round(s, 6) AS scale,
  (CASE WHEN g.w - margin - bw < margin THEN greatest(0, (g.w - bw) // 2) ELSE least(greatest(round_even(g.x - bw / 2::DOUBLE, 0), margin), g.w - margin - bw) END)::INTEGER AS text_x,
  (CASE WHEN g.h - margin - bb < margin + bh THEN least(greatest(bh, (g.h + bh - bb) // 2), greatest(0, g.h - bb)) ELSE least(greatest(round_even(g.y + bh / 2::DOUBLE, 0), margin + bh), g.h - margin - bb) END)::INTEGER AS text_y,
  round(circle_scale, 6) AS circle_scale, r::INTEGER AS circle, (CASE WHEN c.w - r - 2 < r + 1 THEN c.w // 2 ELSE least(greatest(c.x, r + 1), c.w - r - 2) END)::INTEGER AS circle_x, (CASE WHEN c.h - r - 2 < r + 1 THEN c.h // 2 ELSE least(greatest(c.y, r + 1), c.h - r - 2) END)::INTEGER AS circle_y
FROM g JOIN c USING (region_id)""")
def label_texts(spark, sf_dir):
    """Scale and origin of each region's number, alone and in a disc, at its label point."""
    t = M.number_labels(_placed(spark, sf_dir))
    return t.select("region_id", F.round("scale", 6).alias("scale"), "text_x", "text_y", F.round("circle_scale", 6).alias("circle_scale"), F.col("circle").cast("int").alias("circle"), "circle_x", "circle_y")


@query("label_colours", f"WITH {_PX}, m AS (SELECT label, min(pid) AS p FROM px GROUP BY label) SELECT m.label, pal.r, pal.g, pal.b FROM m JOIN ({_PAL.join(['WITH ', ' SELECT * FROM pal'])}) pal USING (label)")
def label_colours(spark, sf_dir):
    return P.label_colours(px(spark, sf_dir).select("image_id", "label").join(pal(spark), "label")).select("label", "r", "g", "b")


@query("strict_palette", f"WITH {_PX}, {_PAL}, c AS (SELECT label, count(*) AS n FROM px GROUP BY label) SELECT (label + 1)::INTEGER AS number, printf('#%02X%02X%02X', r, g, b) AS exact_hex, n AS pixel_count FROM c JOIN pal USING (label)")
def strict_palette(spark, sf_dir):
    exact = pal(spark).select((F.col("label") + 1).alias("number"), C.hex_code("r", "g", "b").alias("exact_hex"))
    return P.strict_zip(palette_table(spark, sf_dir), exact).select("number", "exact_hex", "pixel_count")


@query("top_colours", f"WITH {_PX} SELECT label AS colour, count(*) AS frequency FROM px GROUP BY label ORDER BY frequency DESC, label LIMIT 8")
def top_colours(spark, sf_dir):
    return P.facet_palette_stats(regions(spark, sf_dir)).where("rank <= 8").select("colour", "frequency")


@query("cluster_merge")
def cluster_merge(spark, sf_dir):
    return P.merge_close(_clusters(spark, sf_dir), 11.0).select("first_seen", "n", *[F.round(c, 6).alias(c) for c in ("l", "a", "b")])


@query("weighted_kmeans")
def weighted_kmeans(spark, sf_dir):
    from ..sources.store import materialize

    centres = U.grouped_lloyd(materialize(U.colour_points(px(spark, sf_dir))), 4, 7, 8.0)
    return centres.select("image_id", "k", F.posexplode("c").alias("dim", "mean"))


@query("clustered_pixels")
def clustered_pixels(spark, sf_dir):
    """Every pixel in the allowed colour nearest to its cluster's."""
    return U.clustered_raster(px(spark, sf_dir), 6, 7, 8.0, "lab", ["ink", (200, 200, 200), (150, 40, 60), (40, 160, 60)], {"ink": (10, 10, 10)}).select("pid", "r", "g", "b")


@query("auto_colours")
def auto_colours(spark, sf_dir):
    return U.detect_colours(px(spark, sf_dir), 8)


@query("template_from_pixels")
def template_from_pixels(spark, sf_dir):
    """The whole way from pixels to a template with a disc in each region that is large enough."""
    from . import segmentation as G

    s = G.build_segmentation(px(spark, sf_dir), G.Settings(color_count=8, min_label_area=MIN_AREA))
    return G.template(s, "bright-color-circles", G.markers(s, G.placements(s))).select("x", "y", "r", "g", "b")


@query("png_round_trip", f"WITH {_PX} SELECT x, y, r, g, b FROM px")
def png_round_trip(spark, sf_dir):
    """The raster as a PNG file, and decoded again."""
    return I.png_pixels(S.write_png(px(spark, sf_dir)).select("image_id", F.col("png").alias("content"))).select("x", "y", "r", "g", "b")


_SINC = "CASE WHEN {0} = 0 THEN 1 ELSE sin({0} * pi()) / ({0} * pi()) END"


@query("lanczos_raster", f"""WITH {_PX}, s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px), z AS (SELECT 40::DOUBLE / greatest(w, h) AS f, * FROM s), d AS (SELECT unnest(['x', 'y']) AS axis, unnest([w, h]) AS o, unnest([greatest(1, round_even(w * f, 0))::INTEGER, greatest(1, round_even(h * f, 0))::INTEGER]) AS n FROM z),
t AS (SELECT axis, o, greatest(1, o / n::DOUBLE) AS s, unnest(range(n)) AS i, (i + 0.5::DOUBLE) * (o / n::DOUBLE) AS c FROM d), v AS (SELECT axis, i, unnest(range(greatest(0, floor(c - 3 * s + 0.5)::INTEGER), least(o, floor(c + 3 * s + 0.5)::INTEGER))) AS p, (p - c + 0.5::DOUBLE) / s AS q FROM t),
k AS (SELECT axis, i, p, CASE WHEN abs(q) < 3 THEN ({_SINC.format("q")}) * ({_SINC.format("(q / 3)")}) ELSE 0 END AS raw FROM v), wt AS (SELECT axis, i, p, raw / sum(raw) OVER (PARTITION BY axis, i) AS w FROM k),
a AS (SELECT i AS x, y, least(255, greatest(0, floor(sum(w * r) + 0.5::DOUBLE)))::INTEGER AS r, least(255, greatest(0, floor(sum(w * g) + 0.5::DOUBLE)))::INTEGER AS g, least(255, greatest(0, floor(sum(w * b) + 0.5::DOUBLE)))::INTEGER AS b FROM px JOIN wt ON axis = 'x' AND p = x GROUP BY i, y)
SELECT x::INTEGER AS x, i::INTEGER AS y, least(255, greatest(0, floor(sum(w * r) + 0.5::DOUBLE)))::INTEGER AS r, least(255, greatest(0, floor(sum(w * g) + 0.5::DOUBLE)))::INTEGER AS g, least(255, greatest(0, floor(sum(w * b) + 0.5::DOUBLE)))::INTEGER AS b FROM a JOIN wt ON axis = 'y' AND p = y GROUP BY x, i""")
def lanczos_raster(spark, sf_dir):
    return I.lanczos(px(spark, sf_dir), 40).select("x", "y", "r", "g", "b")


@query("seeded_random", "SELECT n_nationkey, round(sin((n_nationkey + i)::DOUBLE) * 10000 - floor(sin((n_nationkey + i)::DOUBLE) * 10000), 6) AS u FROM nation, (VALUES (0), (1), (2)) r(i)")
def seeded_random(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_nationkey", F.explode(C.seeded_random(F.col("n_nationkey"), 3)).alias("u")).select("n_nationkey", F.round("u", 6).alias("u"))


@query("payload_round_trip", "SELECT conv_id, turn, octet_length(encode(text)) AS n_bytes, md5(text) AS digest FROM conversations WHERE text IS NOT NULL")
def payload_round_trip(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    sent = Y.serialise(c.select(F.struct("conv_id", "turn").alias("image_id"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.encode("text", "UTF-8").alias("data")))
    return Y.deserialise(sent).select("image_id.conv_id", "image_id.turn", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


@query("answer_images", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'image/webp' ELSE 'image/png' END AS mime_type, text AS data FROM conversations WHERE text IS NOT NULL")
def answer_images(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    text = F.col("text")
    direct = F.to_json(F.struct(text.alias("imageBase64"), F.lit("image/webp").alias("mimeType")))
    nested = F.to_json(F.struct(F.struct(text.alias("base64")).alias("image")))
    part = F.struct(F.struct(text.alias("data")).alias("inline_data"))
    candidate = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"))).alias("candidates")))
    payload = F.when(F.col("turn") % 3 == 0, direct).when(F.col("turn") % 3 == 1, nested).otherwise(candidate)
    found = F.coalesce(Y.answer_image(F.col("payload")), Y.candidate_image(F.col("payload")))
    return c.select("conv_id", "turn", payload.alias("payload")).select("conv_id", "turn", found.alias("i")).select("conv_id", "turn", "i.mime_type", "i.data")


@query("idea_texts", r"""SELECT conv_id, turn, CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' OR text IS NULL THEN 'idea' ELSE substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 80) END AS title,
  coalesce(nullif(regexp_replace(regexp_replace(coalesce(role, '') || ' ' || turn, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'image') AS stem, concat_ws(chr(10) || chr(10), role, 'turn ' || turn) AS prompt
FROM conversations WHERE length(trim(text)) >= 8""")
def idea_texts(spark, sf_dir):
    c = T.ready_ideas(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    stem = Y.clean_stem(F.concat(F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.lit(".png")), "image")
    return c.select("conv_id", "turn", Y.title(F.col("text"), "idea").alias("title"), stem.alias("stem"), Y.prompt(F.col("role"), F.lit(" "), F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("prompt"))


@query("base64_decode", "SELECT conv_id, turn, text FROM conversations")
def base64_decode(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.decode(F.unbase64(F.base64(F.encode("text", "UTF-8"))), "UTF-8").alias("text"))


@query("analysis_raster", f"""WITH {_PX}, s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px), z AS (SELECT *, least(1, 37::DOUBLE / greatest(w, h)) AS f FROM s), d AS (SELECT w, h, greatest(1, round_even(w * f, 0))::INTEGER AS nw, greatest(1, round_even(h * f, 0))::INTEGER AS nh FROM z),
ax AS (SELECT i AS cx, j AS x, least((i + 1) * w, (j + 1) * nw) - greatest(i * w, j * nw) AS n FROM d, range(nw) a(i), range(w) b(j) WHERE least((i + 1) * w, (j + 1) * nw) > greatest(i * w, j * nw)),
ay AS (SELECT i AS cy, j AS y, least((i + 1) * h, (j + 1) * nh) - greatest(i * h, j * nh) AS m FROM d, range(nh) a(i), range(h) b(j) WHERE least((i + 1) * h, (j + 1) * nh) > greatest(i * h, j * nh))
SELECT cx::INTEGER AS x, cy::INTEGER AS y, round_even(sum(n * m * r)::DOUBLE / sum(n * m)::DOUBLE, 0)::INTEGER AS r, round_even(sum(n * m * g)::DOUBLE / sum(n * m)::DOUBLE, 0)::INTEGER AS g, round_even(sum(n * m * b)::DOUBLE / sum(n * m)::DOUBLE, 0)::INTEGER AS b FROM px JOIN ax USING (x) JOIN ay USING (y) GROUP BY ALL""")
def analysis_raster(spark, sf_dir):
    return S.reduced(px(spark, sf_dir), 37).select("x", "y", "r", "g", "b")


@query("vector_distances", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 5) AS manhattan FROM embeddings")
def vector_distances(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    zero = F.transform("v", lambda x: F.lit(0.0))
    return e.select("vec_id", F.round(C.euclidean(F.col("v"), zero), 5).alias("norm"), F.round(C.manhattan(F.col("v"), zero), 5).alias("manhattan"))
