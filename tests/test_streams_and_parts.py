"""Chunk assembly as a stream, numbering by ranges, SVG in pieces."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellar.operators import outline as O
from tessellar.plans.queries import ORACLE_SQL
from tessellar.sources import payloads as Y
from tessellar.sources import raster as S
from tessellar.sources.store import numbered
from tessellar.streaming import progress as T

MESSAGE = "runner string, request_id string, seq long, ts timestamp, kind string, chunk_index int, total_chunks int, chunk string"


def test_stream_of_chunks(spark, tmp_path):
    """Several batches, each after a restart from the checkpoint: the state lasts from start to finish."""
    begin = datetime(2024, 1, 1)
    folder = tmp_path / "in"
    folder.mkdir()

    def batch(k, rows):
        made = [(runner, request, seq, begin + timedelta(seconds=at), kind, i, n, c) for runner, request, seq, at, kind, i, n, c in rows]
        spark.createDataFrame(made, MESSAGE).coalesce(1).write.mode("append").parquet(str(folder))
        stream = T.stream_assemble(spark.readStream.schema(MESSAGE).parquet(str(folder)), timeout_ms=10_000)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()

    batch(0, [("r1", "a", 1, 0, "start", 0, 2, "he"), ("r1", "b", 2, 0, "chunk", 0, None, "?"), ("r2", "c", 1, 0, "start", 1, 3, "x"), ("r1", "a", 3, 0, "chunk", 5, None, "!")])
    batch(1, [("r1", "a", 5, 1, "finish", 1, None, "llo"), ("r1", "d", 6, 1, "start", 0, 1, "two"), ("r1", "d", 7, 1, "finish", 0, None, "two"), ("r2", "c", 2, 1, "finish", 0, None, "w")])
    batch(2, [("r1", "a", 8, 2, "done", None, None, None), ("r1", "d", 9, 2, "finish", 0, None, "two"), ("r1", "e", 10, 2, "start", 0, None, "")])
    batch(3, [("r3", "z", 1, 100, "start", 0, 1, "z")])
    batch(4, [("r3", "z", 2, 101, "finish", 0, None, "z")])
    got = sorted((r.runner, r.seq or 99, r.request_id, r.status, r.text, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("r1", 2, "b", "error", None, "chunk chunk of an unknown request"), ("r1", 3, "a", "error", None, "a chunk out of its request's range"), ("r1", 5, "a", "complete", "hello", None), ("r1", 7, "d", "error", None, "request a is still at work"),
        ("r1", 9, "d", "complete", "two", None), ("r1", 10, "e", "error", None, "a start without a number of chunks"), ("r2", 2, "c", "error", None, "one or more chunks are missing"), ("r2", 99, "c", "timeout", None, None), ("r3", 2, "z", "complete", "z", None),
    ]


def test_progress_of_halves(spark):
    """Sums of shares in binary fractions fall beside a half; the query and its SQL round them up."""
    rows = [(5, 125.0, 58), (1, 218.75, 17), (1, 343.75, 23), (0, 0.0, 0), (9, 500.0, 100), (9, 900.0, 100), (3, -5.0, 32), (7, 25.0, 81)]
    e = spark.createDataFrame(rows, "stage int, value double, want int")
    stage = F.get(F.array(*[F.lit(n) for n, _ in T.STAGES]), "stage")
    assert [r.got for r in e.select(T.overall(stage, F.col("value") / 500).alias("got")).collect()] == [r[2] for r in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?)", [(10 * k + stage, value) for k, (stage, value, _) in enumerate(rows)])
    assert [p for _, p in sorted(con.execute(ORACLE_SQL["progress_overall"]).fetchall())] == [r[2] for r in rows]


def test_numbers_by_ranges(spark):
    rnd = random.Random(2)
    rows = [("big" if rnd.random() < 0.9 else f"g{k % 5}", rnd.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "image_id string, v int, k int").repartition(6)
    place, seen = {}, {}
    for g, _, k in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        place[k] = seen[g]
    assert {r.k: r.n for r in numbered(df, "image_id", [F.desc("v"), F.asc("k")], "n").collect()} == place


def facets(spark):
    point = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [("i", 0, 1, 255, 0, 10, point((0, 0), (3, 0), (0, 0))), ("i", 1, 12, 0, 0, 0, point((1.5, 2))), ("j", 4, 0, 1, 2, 3, [])]
    return spark.createDataFrame(rows, "image_id string, facet_id long, color_index int, r int, g int, b int, points array<struct<x:double,y:double>>")


def test_svg_pieces(spark, tmp_path):
    """Two documents worked out by hand, with labels and without; the files of a folder in order are the document."""
    sizes = spark.createDataFrame([("i", 4, 3), ("j", 2, 2)], "image_id string, width int, height int")
    labels = spark.createDataFrame([("i", 1, 0.5, 0.5, 2.0, 1.5)], "image_id string, facet_id long, min_x double, min_y double, max_x double, max_y double")
    parts = O.svg_parts(facets(spark), sizes, 2.0, labels=labels, font_size=60, font_colour="#333")
    O.write_svg(parts, str(tmp_path / "svg"))
    text = {}
    for name in "ij":
        text[name] = "".join(line for p in sorted((tmp_path / "svg" / f"image_id={name}").glob("part-*")) for line in p.read_text().splitlines())
    assert text["j"] == '<svg xmlns="http://www.w3.org/2000/svg" width="4" height="4" viewBox="0 0 4 4"></svg>'
    assert text["i"] == (
        '<svg xmlns="http://www.w3.org/2000/svg" width="8" height="6" viewBox="0 0 8 6">'
        '<path data-facet-id="0" d="M 0 0 Q 3 0 6 0 Q 3 0 0 0 Z" stroke="#000" stroke-width="1" fill="rgb(255,0,10)" />'
        '<path data-facet-id="1" d="M 3 4 Z" stroke="#000" stroke-width="1" fill="rgb(0,0,0)" />'
        '<g class="label" transform="translate(1,1)"><svg width="3" height="2" overflow="visible" viewBox="-50 -50 100 100" preserveAspectRatio="xMidYMid meet">'
        '<text font-family="Tahoma" font-size="30" dominant-baseline="middle" text-anchor="middle" fill="#333">12</text></svg></g></svg>'
    )
    styles = {(f, s): O.svg_parts(facets(spark), sizes, 1.0, f, s).where("place = 0 AND piece = 0").first().text for f in (True, False) for s in (True, False)}
    assert 'stroke="rgb(255,0,10)" stroke-width="1" fill="rgb(255,0,10)"' in styles[True, False] and 'stroke="none" stroke-width="1" fill="none"' in styles[False, False] and 'stroke="#000" stroke-width="1" fill="none"' in styles[False, True]


def test_output_folders(spark, tmp_path, monkeypatch):
    """Neither the working directory, nor a root, nor a folder that holds the input may be cleared; others are."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"x")
    monkeypatch.chdir(tmp_path)
    for out, source in ((".", None), ("/", None), (str(tmp_path / "in"), str(tmp_path / "in" / "a.png"))):
        with pytest.raises(ValueError):
            S.safe_output(out, source)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old").write_text("x")
    assert S.prepared_output(spark, "out", "in/a.png") == str(tmp_path / "out") and not list((tmp_path / "out").iterdir())


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for _ in range(2):  # the second takes the place of the first
        Y.write_json(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema("k int, v string").json(str(tmp_path / "j")).collect())) == [(1, "a"), (2, None)]
