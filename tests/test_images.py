"""Image files to pixels."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.sources import images as I
from tessellar.sources import raster as S


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def coded(rows, unit, rnd):
    """Scan lines, each coded with a filter drawn at random, byte after byte as the format tells it."""
    out, before = b"", bytes(len(rows[0]))
    for row in rows:
        kind = rnd.randrange(5)
        line = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - unit] if i >= unit else 0, before[i], before[i - unit] if i >= unit else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind]) + bytes(line)
        before = row
    return out


def png(w, h, depth, colour, rnd, interlaced=False, extra=b""):
    """A PNG of random samples and these samples."""
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    s = np.array([[[rnd.randrange(1 << depth) for _ in range(n)] for _ in range(w)] for _ in range(h)])
    body = b""
    for x, y, dx, dy in [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlaced else [(0, 0, 1, 1)]:
        part = s[y::dy, x::dx]
        if part.size:
            bits = (part.reshape(len(part), -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
            body += coded([np.packbits(r.ravel()).tobytes() for r in bits], max(1, depth * n // 8), rnd)
    half = len(body) // 2
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))) + extra + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b""), s


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_kinds(colour, depth, interlaced):
    rnd = random.Random(colour * 100 + depth)
    for w, h in ((1, 1), (7, 5), (9, 13)):
        data, s = png(w, h, depth, colour, rnd, interlaced)
        v = s / ((1 << depth) - 1) * 255
        v = np.floor(v + 0.5) if depth == 16 else np.rint(v)
        alpha = v[..., -1:] / 255 if colour in (4, 6) else 1.0
        grey = v[..., :1].repeat(3, 2) if colour in (0, 4) else v[..., :3]
        assert (I.decode_png(data) == np.floor(255 * (1 - alpha) + grey * alpha + 0.5)).all()


def test_png_palette_and_clear_colour():
    rnd = random.Random(3)
    colours = bytes(rnd.randrange(256) for _ in range(12))
    data, s = png(6, 4, 2, 3, rnd, extra=chunk(b"PLTE", colours) + chunk(b"tRNS", bytes([0, 128])))
    table = np.frombuffer(colours, np.uint8).reshape(-1, 3).astype(float)
    alpha = np.array([0, 128, 255, 255])[:, None] / 255
    assert (I.decode_png(data) == np.floor(255 * (1 - alpha) + table * alpha + 0.5)[s[..., 0]]).all()
    data, s = png(6, 4, 2, 0, rnd, extra=chunk(b"tRNS", struct.pack(">H", 2)))
    assert (I.decode_png(data)[..., 0] == np.where(s[..., 0] == 2, 255, s[..., 0] * 85)).all()
    with pytest.raises(ValueError):
        I.decode_png(data[:40] + b"x" + data[41:])


def turned(a, o):
    """By numpy: what a viewer shows for each orientation."""
    return {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.transpose(1, 0), 6: a.transpose(1, 0)[:, ::-1], 7: a.transpose(1, 0)[::-1, ::-1], 8: a.transpose(1, 0)[::-1]}[o]


def test_files_are_read_upright(spark, tmp_path):
    """A PNG written here comes back as it was; all eight orientations; two files at once."""
    a = np.arange(12).reshape(3, 4) * 20
    exif = lambda o, order: (b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, o, 0)) if order == "<" else (b"MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, o, 0))
    for o in range(1, 9):
        whole = S.png_bytes(a.astype(np.uint8))
        (tmp_path / f"o{o}.png").write_bytes(whole[:33] + chunk(b"eXIf", exif(o, "<>"[o % 2])) + whole[33:])
    got = {}
    for r in I.read_images(spark, f"file://{tmp_path}/*.png").collect():
        got.setdefault(int(r.image_id[-5]), {})[r.x, r.y] = r
    for o in range(1, 9):
        want = turned(a, o)
        assert {p: r.r for p, r in got[o].items()} == {(x, y): int(v) for y, row in enumerate(want) for x, v in enumerate(row)}
        assert all(r.pid == r.y * want.shape[1] + r.x and r.r == r.g == r.b for r in got[o].values())
    assert I.orientation(b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", 2 + 6 + len(exif(6, "<"))) + b"Exif\0\0" + exif(6, "<") + b"\xff\xda") == 6
    assert I.orientation(b"\xff\xd8\xff\xda") == I.orientation(b"GIF") == 1


def test_written_png_comes_back(spark, tmp_path):
    rnd = random.Random(5)
    cells = [(i, x, y, y * 5 + x, *[rnd.randrange(256) for _ in range(3)]) for i in ("a", "b") for y in range(4) for x in range(5)]
    px = spark.createDataFrame(cells, "image_id string, x int, y int, pid long, r int, g int, b int")
    for band in (1, 3, S.PNG_BAND):
        made = S.write_png(px, band=band)
        assert sorted(map(tuple, I.png_pixels(made.select("image_id", F.col("png").alias("content"))).collect())) == sorted((c[0], c[1], c[2], *c[4:]) for c in cells)
    made.write.mode("overwrite").parquet(str(tmp_path / "png"))
    (tmp_path / "a.png").write_bytes(bytes(spark.read.parquet(str(tmp_path / "png")).where("image_id = 'a'").first().png))
    read = spark.read.format("image").load(f"file://{tmp_path}/a.png").select("image.*").first()  # another reader
    assert (read.width, read.height, read.nChannels) == (5, 4, 3) and [tuple(read.data[3 * c[3] : 3 * c[3] + 3]) for c in cells[:20]] == [c[:3:-1] for c in cells[:20]]
    grey = I.png_pixels(S.write_png(px, ("g",), 2).select("image_id", F.col("png").alias("content")))
    assert sorted((r.image_id, r.x, r.y, r.r) for r in grey.collect()) == sorted((c[0], c[1], c[2], c[5]) for c in cells)


def test_other_formats_by_spark(spark):
    """Rows as Spark's reader gives them: blue, green, red, and alpha; grey."""
    images = spark.createDataFrame([("c", 2, 1, 3, bytearray([1, 2, 3, 4, 5, 6])), ("a", 1, 1, 4, bytearray([10, 20, 30, 0])), ("g", 1, 2, 1, bytearray([7, 8]))], "image_id string, width int, height int, channels int, data binary")
    assert sorted(map(tuple, I.spark_pixels(images).collect())) == [("a", 0, 0, 255, 255, 255), ("c", 0, 0, 3, 2, 1), ("c", 1, 0, 6, 5, 4), ("g", 0, 0, 7, 7, 7), ("g", 0, 1, 8, 8, 8)]


def test_lanczos(spark):
    """Weights sum to 1; a flat image stays flat; the separable sum is that of numpy; smaller images stay as they are."""
    sizes = spark.createDataFrame([("i", 37, 11), ("j", 5, 5), ("k", 1000, 3)], "image_id string, old int, new int")
    w = I.lanczos_weights(sizes, "old", "new")
    assert w.groupBy("image_id", "at").agg(F.abs(F.sum("weight") - 1).alias("d")).agg(F.max("d")).first()[0] < 1e-12
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20, 30))
    cells = [("i", x, y, y * 30 + x, int(a[y, x]), 77, 0) for y in range(20) for x in range(30)] + [("s", x, 0, x, x, x, x) for x in range(3)]
    px = spark.createDataFrame(cells, "image_id string, x int, y int, pid long, r int, g int, b int")
    got = I.lanczos(px, 9).collect()
    assert sorted((r.pid, r.r) for r in got if r.image_id == "s") == [(0, 0), (1, 1), (2, 2)]

    def matrix(old, new):
        m = np.zeros((new, old))
        for i in range(new):
            c, s = (i + 0.5) * old / new, old / new
            for p in range(max(0, int(c - 3 * s + 0.5)), min(old, int(c + 3 * s + 0.5))):
                x = (p - c + 0.5) / s
                m[i, p] = np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0
        return m / m.sum(1, keepdims=True)

    step = np.clip(np.floor(a @ matrix(30, 9).T + 0.5), 0, 255)
    want = np.clip(np.floor(matrix(20, 6) @ step + 0.5), 0, 255)
    out = {(r.x, r.y): r for r in got if r.image_id == "i"}
    assert len(out) == 54 and all((r.r, r.g, r.b) == (want[y, x], 77, 0) for (x, y), r in out.items())


def test_png_in_bands():
    """A file is unpacked some rows at a time, filters reaching from one band into the next."""
    import struct
    import zlib

    import numpy as np

    from tessellar.sources import images as I
    from tessellar.sources import raster as S

    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (50, 7, 3)).astype(np.uint8)
    coded, wide = np.zeros((50, 22), np.uint8), np.zeros((51, 24), np.int32)
    wide[1:, 3:] = a.reshape(50, 21)
    for y in range(50):  # each row by the one above it
        coded[y, 0], coded[y, 1:] = 2, (wide[y + 1, 3:] - wide[y, 3:]) % 256
    z = zlib.compress(coded.tobytes())
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    for cuts in ([0, len(z)], list(range(0, len(z), 5)) + [len(z)]):
        file = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 50, 8, 2, 0, 0, 0)) + b"".join(chunk(b"IDAT", z[i:j]) for i, j in zip(cuts, cuts[1:])) + chunk(b"IEND", b"")
        bands = list(I.png_bands(file, 28))
        assert [(y, len(b)) for y, b in bands] == [(y, min(4, 50 - y)) for y in range(0, 50, 4)]
        assert (np.concatenate([b for _, b in bands]) == a).all()
    assert (I.decode_png(S.png_bytes(a)) == a).all()
