"""WARC archives, whitening and lexical search against plain versions, and odd input."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard

from tessellar.llm import lexical, topk, warc, whitening

BODY = "<html><body><p>The same page, word for word, " + "and more of it " * 30 + "</p></body></html>"
PAGES = [
    (1, "http://a.example/1", BODY, 1), (2, "http://a.example/2", None, 2), (3, None, "", 3), (4, "http://a.example/4\r\nX-Page-Id: 9", BODY, 4), (None, "http://a.example/5", BODY, 5),
    (6, "http://a.example/é x", "größer 中文 🙂\r\n\r\n", 6), (6, "http://a.example/6", BODY, 7), (6, "http://a.example/6", BODY, 7), (7, "u", "<p>" + "long " * 50_000, 8), (8, "u", "ab", 9), (9, "u", "ab", 9),
]
PAGE = "page_id long, url string, html string, _k int"


def wanted_pages(least=0):
    rows = sorted(PAGES, key=lambda r: (r[0] is not None, r[0] or 0, r[2] or ""))
    of = {r[2] or "": k for k, r in enumerate(rows)}
    out = []
    for k, r in enumerate(rows):
        body = (r[2] or "").encode()
        repeat = of[r[2] or ""] != k and len(body) >= least
        out.append((r[0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if repeat else "response", rows[of[r[2] or ""]][0] if repeat else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 3])
def test_warc_round_trip(spark, least):
    got = warc.archived(spark.createDataFrame(PAGES, PAGE), least=least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == wanted_pages(least)


def test_warc_files(spark, tmp_path):
    """Each file: dictionary frame first, then frames that decompress alone; a long record has a file of its own; payloads come back."""
    pages = spark.createDataFrame([*PAGES, *[(100 + i, "u", f"page {i} " + BODY, 0) for i in range(200)]], PAGE).coalesce(1)
    path = warc.write_archives(pages, f"file://{tmp_path}/w", raw_bytes=20_000)
    files = sorted(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    assert len(files) > 5
    trained = 0
    for p in files:
        raw = p.read_bytes()
        mark, size = struct.unpack_from("<II", raw)
        assert mark == 0x184D2A5D and raw.endswith(b"P*M\x18" + bytes(4))
        trained += raw[8:12] == bytes([0x37, 0xA4, 0x30, 0xEC])
        with zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).stream_reader(raw[8 + size : -8], read_across_frames=True) as r:
            whole = r.read()
        records = list(warc.records_of(raw))
        assert b"".join(records) == whole and all(x.startswith(b"WARC/1.1\r\n") for x in records)
        assert b"WARC-Type: warcinfo" in records[0]
        assert sum(map(len, records[1:])) <= 20_000 or len(records) == 2
    assert trained
    back = warc.read_archives(spark, path).collect()
    body = {r.page_id: bytes(r.payload).decode() for r in back if r.warc_type == "response"}
    assert body[7] == PAGES[8][2] and body[110] == "page 10 " + BODY
    assert not any("\r" in (r.target_uri or "") or " " in (r.target_uri or "") for r in back)
    revisit = next(r for r in back if r.warc_type == "revisit" and r.page_id == 1)
    assert revisit.payload is None and revisit.stated_bytes == len(BODY)
    assert next(r for r in back if r.record_id == revisit.refers_to_id).payload == BODY.encode()


def test_warc_damage():
    """A payload that differs from its digest, and bytes that are no frame, are errors."""
    good = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Date", "d"), ("WARC-Payload-Digest", "sha1:A"), ("Content-Type", "application/http;msgtype=response")], warc._http(2) + b"ab")
    with pytest.raises(ValueError):
        warc._parsed(good, True)
    with pytest.raises(ValueError):
        list(warc.records_of(b"no frame, but more than eight bytes"))


def test_warc_empty(spark):
    assert warc.archived(spark.createDataFrame([], PAGE)).count() == 0


def wanted_whitening(rows):
    """vec_id, deviation and whitened of each row, by numpy and whole numbers alone."""
    xs = [tuple(math.floor(256 * float(c)) for c in v) for _, v in rows]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    order = [k for k in np.argsort(-e)[:4] if e[k] > 1e-9 * e.sum()]
    out = []
    for (vec_id, _), x in zip(rows, xs):
        centred = [n * a - s for a, s in zip(x, sums)]
        for c, k in enumerate(order, 1):
            out.append((vec_id, c, n, sum(a * a for a in centred), np.array(centred, float) / n @ v[:, k] / e[k] ** 0.5, e[k] / e.sum()))
    return out


def held(df, want):
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert len(want) == len({w[:2] for w in want}) == len(got)
    signs = {}
    for vec_id, c, n, deviation, white, share in want:
        r = got[vec_id, c]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - share) <= 1e-9 * share and r.identity_error <= 1e-9
        if abs(white) > 1e-6:
            assert signs.setdefault(c, np.sign(white * r.whitened)) == np.sign(white * r.whitened)
        assert abs(abs(r.whitened) - abs(white)) <= 1e-8


def test_whitening(spark):
    rng = np.random.default_rng(5)
    sound = [(i, (rng.normal(size=6) * [3, 2, 1.5, 1, 0.7, 0.2] + 5).tolist()) for i in range(300)]
    sound += [(300 + i, sound[0][1]) for i in range(200)]  # a hot vector counts once in the fit
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [])]
    df = spark.createDataFrame([(i, v, 7, "n") for i, v in sound + odd], "vec_id long, embedding array<double>, label int, n string").repartition(5)
    held(whitening.whitened(df), wanted_whitening(sound))


def test_whitening_lengths_and_rank(spark):
    """Lengths are fitted apart; a flat direction gives no row; one distinct vector, or an empty table, none at all; repeats keep their rows."""
    flat = [(i, [float(i % 7), 1.0, 2.0 * (i % 7)]) for i in range(40)]
    long_ = [(100 + i, [float(i), float(i * i % 11), float(i % 5), 0.5, float(i % 3)]) for i in range(50)]
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held(whitening.whitened(make(flat + long_)), wanted_whitening(flat) + wanted_whitening(long_))
    assert {r.component for r in whitening.whitened(make(flat)).collect()} == {1}
    assert whitening.whitened(make([(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whitened(make([])).count() == 0
    twice = whitening.whitened(make([(None, [1.0, 2.0]), (1, [3.0, 5.0]), (1, [3.0, 5.0])]))
    assert Counter(r.vec_id for r in twice.collect()) == {None: 1, 1: 2}


def wanted_search(docs, items, k):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(cut(t))) for d, t in sorted(docs, key=order)]
    held = [(p, d, c) for p, (d, c) in enumerate(held) if c]
    n, total = len(held), sum(sum(c.values()) for _, _, c in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for p, d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in cut(text) if c[t])
            if score > 0:
                scores.append((-score, p, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "block", "k"), [(16384, 500_000, 20), (7, 40, 3), (1, 500_000, 5)])
def test_lexical_search(spark, monkeypatch, size, block, k):
    """Ranges of few documents, several blocks of items, steps of two nodes: always what a full scan gives."""
    rnd = random.Random(size)
    words = ["the", "The", "a", "café", "CAFÉ", "中文", "x1", "it's", "rare", "b" * 300] + [f"w{i}" for i in range(12)]
    docs = [(i % 55, " ".join(rnd.choices(words, [30, 5, 20, 2, 2, 1, 1, 3, 0.3, 0.5] + [1] * 12, k=rnd.choice([1, 3, 10, 60])))) for i in range(60)]
    docs += [(200 + i, "same text for a tie") for i in range(9)] + [(None, "same text for a tie"), (300, None), (301, ""), (302, "--- !!!"), (303, "the " * 3000)]
    items = [(i, " ".join(rnd.choices(words, k=8))) for i in range(6)] + [(7, "tie for a same text same"), (8, None), (9, ""), (10, "unknown"), (7, "rare rare the"), (None, "w1")]
    if size == 7:
        monkeypatch.setattr(lexical, "STEP", 2)
    got = lexical.lexical_search(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, term string").repartition(3), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n int"), k, size, block)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted_search(docs, items, k)


def test_lexical_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.lexical_search(docs, items).count() == 0
    assert lexical.lexical_search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_max_tree_opens_little():
    """A few good documents among many poor ones: the search reads a small part of the postings and gives what a full sum gives."""
    rng = np.random.default_rng(1)
    size = 20_000
    term, at = np.repeat([0, 1, 2], size), np.tile(np.arange(size), 3)
    value = rng.integers(1, 20, 3 * size)
    good = rng.choice(size, 30, replace=False)
    value[good] = 1000 + np.arange(30)
    tree, seen = lexical.MaxTree(term, at, value, size), []
    plain = tree.below
    tree.below = lambda level, nodes, *a: (seen.append(len(nodes)), plain(level, nodes, *a))[1]
    none = np.zeros(0, np.int64)
    scores, docs = tree.search(np.array([0, 1, 2]), np.array([5, 3, 1]), 20, none, none, np.arange(size))
    total = (value.reshape(3, -1) * [[5], [3], [1]]).sum(0)
    best = np.lexsort((np.arange(size), -total))[:20]
    assert docs.tolist() == best.tolist() and scores.tolist() == total[best].tolist()
    assert sum(seen) * lexical.FANOUT < size / 4


def test_top_k_odd_rows(spark):
    """Repeated ids and vectors, vectors of another length, null and non-finite ones, further columns of clashing names, fewer rows than k, no rows."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (61, rows[3][1]), (62, [1.0, 2.0]), (63, [2.0, 1.0]), (64, None), (65, [1.0, None, 0.0, 0.0, 0.0]), (66, [float("nan")] * 5), (67, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, b string")
    whole = [(i, tuple(math.floor(1024 * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q, x in sorted({r for r in whole if r[0] % 5 == 0 or r[0] in (7, 62)}):
        others = list(whole)
        others.remove((q, x))
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in others if len(y) == len(x))[:4]
        want += [(q, i, -s) for s, i in best]
    got = topk.top_k(df, df.where("vec_id % 5 = 0 OR vec_id IN (7, 62)"), 4, block=16)
    by_query = Counter((r.query_id, r.vec_id, r.score) for r in got.collect())
    once = [w for w in want if w[0] != 7]
    assert {k: n for k, n in by_query.items() if k[0] != 7} == Counter(once)
    assert len([1 for k in by_query if k[0] == 7]) > 0 and got.where("query_id = 62").count() == 1
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
