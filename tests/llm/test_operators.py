"""Each operator against a plain version, and odd input: nulls, empty and repeated rows, empty tables, further columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessellar.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_join, recompression, sentencepiece_codec, suffix_dedup, token_counts, token_store, topk

PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, "a " + PASSAGE + " b", "en", "s", 0, "x"), (2, "c " + PASSAGE + " d", "en", "s", 0, "x"), (3, None, None, None, None, None), (4, "", "en", "s", 0, "x"),
    (5, "the same line of text, twice over\nthe same line of text, twice over\nshort", "en", "s", 0, "x"), (6, "the same line of texts, twice over\nother words here", "en", "s", 0, "x"),
    (7, "the " * 200, "en", "s", 0, "x"), (None, "no id " + PASSAGE, "en", "s", 0, "x"), (2, "c " + PASSAGE + " d", "en", "s", 0, "x"), (8, "  two  spaces \n\n and 中文 🙂 ▁ ", "de", "s", 0, "x"), (9, "x" * 5000, "en", "s", 0, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ordered():
    return sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(odd, monkeypatch, hot):
    if hot:
        monkeypatch.setattr("tessellar.llm.repeats.SPLIT", 1)
    size, texts = 35, [(d, (t or "").encode().split()) for d, t in ordered()]
    n = Counter(tuple(w[i : i + size]) for _, w in texts for i in range(len(w) - size + 1))
    want = []
    for d, w in texts:
        gone = {j for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert rows(recompression.substring_dedup(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(odd, monkeypatch, hot):
    if hot:
        monkeypatch.setattr("tessellar.llm.repeats.SPLIT", 1)
    seen, want = set(), []
    for d, t in ordered():
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(t[i : i + 100])
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert rows(suffix_dedup.suffix_dedup(odd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("split", [1, 4096])
def test_repeats_around_one_anchor(spark, monkeypatch, split):
    """Many texts around one common core, repeated to different lengths on either side: split names decide as whole ones do."""
    monkeypatch.setattr("tessellar.llm.repeats.SPLIT", split)
    rng = np.random.default_rng(3)
    core = [f"c{i}" for i in range(30)]
    texts = []
    for i in range(120):
        left, right = rng.integers(0, 25, 2)
        side = lambda n, tag: [f"{tag}{j}" if rng.random() > 0.03 else f"x{i}" for j in range(n)]
        texts.append((i, " ".join([*side(left, "l")[::-1], *core, *side(right, "r")])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    n = Counter(tuple(w[i : i + 35]) for w in (t.split() for _, t in texts) for i in range(len(w) - 34))
    want = [(d, len({j for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)})) for d, w in ((d, t.split()) for d, t in texts)]
    assert rows(recompression.substring_dedup(docs), "doc_id", "n_removed") == sorted(want, key=repr)
    seen, gone = set(), []
    for d, t in texts:
        t, mark = t.encode(), set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                mark |= set(range(i, i + 100))
            seen.add(t[i : i + 100])
        gone.append((d, len(mark)))
    assert rows(suffix_dedup.suffix_dedup(docs), "doc_id", "n_removed") == sorted(gone, key=repr)


def test_token_store(odd):
    t = Tokenizer.from_file(byte_bpe.default_path())
    start, want = 0, []
    for d, text in ordered():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_store.tokenized(odd), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def strange_texts(n, seed):
    rng = np.random.default_rng(seed)
    pieces = np.array([" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\r", "\x1c", "a", "The", "n", "'s", "'", "1", "2024", ".", ",", ";", "!", "(", "\u00e9", "\u4e2d", "\U0001f642", "\u2581", "\u0301", "<|endoftext|>", "\0", "\x85", "\u00b2"])
    return ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(n)]


def test_encoder_equals_the_library():
    e = byte_bpe.Encoder(byte_bpe.default_path())
    texts = strange_texts(20_000, 5) + ["20\u00a0km\n\u00a0", "a\tb\n\u00a0 c", "word " * 60_000]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, np.uint32).tolist() for x in e.encode(texts)] == [w.ids for w in want]
    assert all(s.tolist() == [list(o) for o in w.offsets] for s, w in zip(e.spans(texts), want))


def test_token_counts(spark, odd):
    t = Tokenizer.from_file(byte_bpe.default_path())
    texts = [(k, x) for k, x in enumerate(strange_texts(300, 6))] + ordered()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = []
    for d, text in texts:
        text = text or ""
        ends, n = [], 0
        for line in text.split("\n"):
            n += len(line) + 1
            ends.append(min(n, len(text)))
        if len(ends) > 1 and text.endswith("\n"):
            del ends[-1]
        held = [0] * len(ends)
        for s, e in t.encode(text, add_special_tokens=False).offsets:
            share = Counter(min(sum(p >= z for z in ends), len(ends) - 1) for p in range(s, max(e, s + 1)))
            held[min(share, key=lambda k: (-share[k], k))] += 1
        want += [(d, k, c) for k, c in enumerate(held)]
    got = token_counts.section_tokens(docs)
    assert rows(got, "doc_id", "section", "n_tokens") == sorted(want, key=repr)
    tokens, sections = np.array([[0, 2], [2, 6], [6, 9]]), np.array([3, 9])
    assert [token_counts.attribute(tokens, sections, r).tolist() for r in ("most", "first", "last")] == [[1, 2], [2, 1], [1, 2]]


def test_token_files(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    token_store.write_tokens(docs, str(tmp_path / "t"), row_group=1 << 16)
    some = token_store.read_tokens(spark, str(tmp_path / "t"), 20, 40)
    assert sorted(r.doc_id for r in some.collect()) == list(range(20, 40))
    plan = token_store.read_tokens(spark, str(tmp_path / "t"), 20, 40, ids=False)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,20)" in plan and "ids:array" not in plan.split("ReadSchema")[-1]
    metas = [pq.ParquetFile(f).metadata for f in sorted((tmp_path / "t").glob("*.parquet"))]
    groups = [m.row_group(g) for m in metas for g in range(m.num_row_groups)]
    assert len(groups) > len(metas) and all(g.column(k).has_column_index and g.column(k).has_offset_index for g in groups for k in range(3))
    used = {e for g in groups for e in g.column(3).encodings}
    assert used & {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"}


def test_sentencepiece(odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    want = []
    for d, text in ordered():
        ids = sp.encode(text or "")
        want.append((d, len(ids), zlib.crc32(np.array(ids, np.int32).tobytes()), True))
    assert rows(sentencepiece_codec.encoded(odd), "doc_id", "n_tokens", "ids_crc32", "round_trip") == sorted(want, key=repr)


def test_sentencepiece_commits_early():
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    text, parts = "internationalizationing" * 40, []
    c.segment("▁" + text, parts.append)
    assert len(parts) > 1 and [p for x in parts for p in x] == sp.encode(text, out_type=str)


def test_ngram_join(odd):
    sets = [(d, (t or "").encode().split()) for d, t in ordered()]
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()) for d, w in sets]
    want = [(d, sum(1 for j, (_, b) in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b))) for i, (d, a) in enumerate(sets)]
    assert rows(ngram_join.ngram_join(odd), "doc_id", "n_links") == sorted(want, key=repr)
    assert rows(ngram_join.ngram_join(odd, block=1), "doc_id", "n_links") == sorted(want, key=repr)
    kept = ngram_join.ngram_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == 8


def test_ngram_join_against_all_pairs(docs):
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first = {d: d for d in ids}
    for _ in ids:
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    want = [(d, first[d], sum(d in link for link in links)) for d in ids]
    assert links and rows(ngram_join.ngram_join(docs), "doc_id", "class_id", "n_links") == sorted(want, key=repr)
    assert {r.doc_id for r in ngram_join.ngram_dedup(docs).collect()} == {d for d in ids if first[d] == d}


def test_recall_of_bands():
    bands, per = ngram_join.bands_for()
    assert 1 - (1 - 0.8**per) ** bands >= ngram_join.RECALL


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_line_dedup(spark, odd):
    base = "one line that is long enough to count"
    lines = [(k, t) for k, t in enumerate([base, base[:-2], "x" + base, base.replace("long", "lung"), base.replace("one", "two"), base[::-1], base + "!!!", base])]
    many = spark.createDataFrame([(k, t, "en", "s", 0, "x") for k, t in lines], SCHEMA)
    gone = {k for k, t in lines if any(edits(t, u) <= 2 for _, u in lines[:k])}
    assert {r.doc_id for r in line_dedup.line_dedup(many).where("n_removed > 0").collect()} == gone
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(odd).collect()}
    assert got[5] == ("the same line of text, twice over\nshort", 1) and got[6] == ("other words here", 1) and got[3] == (None, 0) and got[4] == ("", 0)


def test_line_dedup_short_lines(spark):
    texts = ["Les.\n\nIt is a line of more than twenty characters\n \nYes.", "Les.\n\nNo.\nLes.\n \nYet.", "Les.\n\nNo."]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, "x") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {0: (texts[0], 5, 0), 1: ("\nNo.\n \nYet.", 6, 2), 2: ("", 3, 2)}


def test_line_dedup_equals_plain(spark):
    """Lines of 1 to 45 characters, many of them near others: the bound shrinks with the shorter line."""
    rng = np.random.default_rng(12)
    base = ["".join(rng.choice(list("abcde é"), n)) for n in rng.integers(1, 45, 60)] + ["", " ", "x" * 9, "x" * 10, "x" * 19, "x" * 20]
    lines = []
    for _ in range(400):
        t = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 4)):
            i, kind = int(rng.integers(len(t) + 1)), rng.integers(3)
            t[i : i + int(kind < 2)] = ["z"] * int(kind > 0)
        lines.append("".join(t))
    docs = spark.createDataFrame([(d, "\n".join(lines[20 * d : 20 * d + 20])) for d in range(20)], "doc_id long, text string")
    stay = []
    for i, t in enumerate(lines):
        near = any(t == u or edits(t, u) <= min(2, min(len(t), len(u)) // 10) for u in lines[:i])
        stay.append(not near or (not t.strip() and len(t) < 20))
    want = {d: "\n".join(t for t, k in zip(lines[20 * d : 20 * d + 20], stay[20 * d : 20 * d + 20]) if k) for d in range(20)}
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == want


def test_decontaminate_short_items(spark):
    """Items of one to four words are found as whole lines, not inside prose; a longer one as ever."""
    docs = [(1, "We saw it.\nYes!\nYes"), (2, "yes we saw it in New York, yes"), (3, "New York\nnew  york."), (4, None), (5, "a passage of just enough words\n\nto be: or not"), (6, "new york city")]
    items = [(1, "Yes."), (2, "New York"), (3, "to be or not"), (4, "a passage of just enough words"), (5, "..."), (6, None), (7, "yes")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "score", "start_word", "end_word") == sorted([(1, 1, 1.0, 3, 4), (1, 7, 1.0, 3, 4), (3, 2, 1.0, 0, 2), (5, 3, 1.0, 6, 10), (5, 4, 1.0, 0, 6)], key=repr)


def test_decontaminate(spark, odd):
    edited = PASSAGE.replace("word7 ", "other ").replace("word30 ", "").replace("word44", "new words").upper()
    docs = odd.union(spark.createDataFrame([(20, "intro " + edited + " end", "en", "s", 0, "x")], SCHEMA))
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "quite different text of a few words")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 1), (None, 1), (20, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, items, max_seeds=10).collect()} == {(1, 1), (2, 1), (None, 1), (20, 1)}


def test_decontaminate_against_every_pair(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    items = [(k, " ".join(rng.choice(words, 25))) for k in range(12)] + [(90, "yes"), (91, None)]
    texts = []
    for k in range(60):
        w = list(rng.choice(words, 80))
        if k % 3 == 0:
            own = items[k % 12][1].split()
            for _ in range(k % 7):
                own[rng.integers(len(own))] = rng.choice(words)
            w[30:30] = own
        texts.append((k, " ".join(w)))
    texts.append((60, "yes " + "filler " * 5000))
    got = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = []
    for d, text in texts:
        passage = decontaminate.normal_words([text])[0]
        for i, item in items:
            w = decontaminate.normal_words([item or ""])[0]
            if len(w) >= decontaminate.MIN_WORDS and (score := decontaminate.align(w, passage)[0] / (2 * len(w))) >= decontaminate.MIN_SCORE:
                want.append((d, i, round(score, 4)))
    assert len(want) >= 20 and rows(got, "doc_id", "item_id", "score") == sorted(want, key=repr)


def test_language_id_against_plain_arithmetic(spark, docs):
    langs, model = language_id.fit_documents(docs)
    some = docs.where("doc_id < 40").withColumn("host", language_id.F.concat(language_id.F.lit("h"), (language_id.F.col("doc_id") % 5).cast("string")))
    records = some.select("doc_id", "text", "host", language_id.F.lit("d.org").alias("domain"), *[language_id.F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "segment")])
    ll, host = {}, {}
    for r in records.collect():
        f = language_id.features(np.frombuffer((r.text or "").encode(), np.uint8))
        ll[r.doc_id], host[r.doc_id] = model[f].astype(float).sum(0) / language_id.TEMPER, r.host

    def share(x):
        p = np.exp(x - x.max())
        return p / p.sum()

    p = {d: share(x) for d, x in ll.items()}
    overall = sum(p.values()) + 1
    overall /= overall.sum()
    smooth = lambda own, above: (own + language_id.SMOOTH * above) / (own.sum() + language_id.SMOOTH)
    domain = smooth(sum(p.values()), overall)
    prior = {h: smooth(sum(p[d] for d in p if host[d] == h), domain) for h in set(host.values())}
    got = {r.doc_id: (r.identified, r.probability) for r in language_id.identify(records, langs, model, ["doc_id"]).collect()}
    for d, x in ll.items():
        q = share(x + np.log(prior[host[d]]))
        assert got[d][0] == langs[int(q.argmax())] and abs(got[d][1] - q.max()) < 2e-3


CLASHING = ["_k", "no", "line", "rep", "band", "stay", "_text", "ids", "key", "name", "ctx", "c", "h1", "n", "a", "b", "bands", "_rest", "gone", "removed", "host", "prior"]


def test_clashing_names_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = [(1, long), (2, "short text of a few words only"), (3, long + " end")]
    plain = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    wide = plain.select("*", *[language_id.F.lit(f"v{k}").alias(c) for k, c in enumerate(CLASHING)])
    items = spark.createDataFrame([(1, "w3x3 w4x4 w5x5 w6x6 w7x7 w8x8")], "item_id long, text string")
    for f in (recompression.substring_dedup, suffix_dedup.suffix_dedup, token_store.tokenized, token_counts.section_tokens, sentencepiece_codec.encoded, ngram_join.ngram_join, line_dedup.line_dedup, lambda d: decontaminate.decontaminate(d, items)):
        assert rows(f(wide), *f(plain).columns) == rows(f(plain), *f(plain).columns)
    assert ngram_join.ngram_dedup(wide).columns == wide.columns
    assert {r.doc_id: r.n_removed for r in recompression.substring_dedup(plain).collect()} == {1: 60_000, 2: 0, 3: 60_000}


def test_language_id(docs):
    half = docs.where("doc_id % 2 = 0")
    langs, model = language_id.fit_documents(half)
    rest = language_id.document_records(docs.where("doc_id % 2 = 1"), "doc_id").withColumn("declared", language_id.F.lit(None).cast("string"))
    got = language_id.identify(rest, langs, model, ["doc_id"]).join(docs, "doc_id")
    right = got.where("identified = lang").count()
    assert right >= 0.97 * got.count()


def test_language_id_odd(docs, odd):
    langs, model = language_id.fit_documents(docs)
    keep = {(r.doc_id, r.keep) for r in language_id.identify(language_id.document_records(odd, "doc_id"), langs, model, ["doc_id"]).collect()}
    assert (3, False) in keep and (4, False) in keep and (5, True) in keep


def test_language_id_fits_every_label(spark):
    rng = np.random.default_rng(2)
    words = {f"l{i:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6)] for i in range(70)}
    texts = [(i, " ".join(rng.choice(w, 30)), lang, "s", 0, "x") for i, (lang, w) in enumerate((lang, w) for lang, w in words.items() for _ in range(2 if lang == "l69" else 3))]
    docs = spark.createDataFrame(texts, SCHEMA)
    langs, model = language_id.fit_documents(docs)
    assert langs == sorted(words)
    got = language_id.identify(language_id.document_records(docs, "doc_id"), langs, model, ["doc_id"]).collect()
    assert {(r.doc_id, r.identified) for r in got} == {(r[0], r[2]) for r in texts}


def test_language_id_address_suffix(spark):
    urls = ["https://a.example.de/fr/x", "http://b.org.:80/", "http://192.0.2.7/de", "https://u@C.Example.UK?x=y", None]
    pages = spark.createDataFrame([(i, u, "<html></html>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert rows(language_id.page_records(pages), "page_id", "suffix", "segment") == [(0, "de", "fr"), (1, "org", None), (2, None, "de"), (3, "uk", None), (4, None, None)]
    texts = [(i, f"http://h{i}.{'de' if i % 2 else 'fr'}/", "aaaaaa bbbbbb" * 9 if i % 2 else "cccccc dddddd" * 9) for i in range(200)] + [(200, "http://new.de/", "xyz"), (201, "http://new.fr/", "xyz")]
    docs = spark.createDataFrame([(i, t, "de" if i % 2 else "fr", "s", 0, "x") for i, _, t in texts[:200]], SCHEMA)
    langs, model = language_id.fit_documents(docs)
    found = language_id.identify(language_id.page_records(spark.createDataFrame(texts, "page_id long, url string, html string")), langs, model, ["page_id"])
    assert {(r.page_id, r.identified) for r in found.where("page_id >= 200").collect()} == {(200, "de"), (201, "fr")}


def test_language_id_without_labels(spark, odd):
    for docs in (odd.limit(0), odd.withColumn("lang", language_id.F.lit(None).cast("string"))):
        langs, model = language_id.fit_documents(docs)
        got = language_id.identify(language_id.document_records(docs, "doc_id"), langs, model, ["doc_id"])
        assert langs == [] and got.columns == ["doc_id", "identified", "probability", "keep"]
        assert got.count() == docs.count() and got.where("keep OR identified IS NOT NULL").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = [(int(i), [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(300)]
    v[7] = (7, v[5][1])
    bad = [(301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [])]
    df = spark.createDataFrame(v + bad, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), block=64)
    m = np.floor(np.array([x for _, x in v]) * 1024).astype(int)
    want = []
    for q in (0, 100, 200):
        s = m @ m[q]
        best = [j for j in sorted(range(300), key=lambda j: (-s[j], j)) if j != q][:10]
        want += [(q, r + 1, j, int(s[j])) for r, j in enumerate(best)]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_large_components(spark):
    v = [(0, [0.5, 0.25]), (1, [2e12, 0.0]), (2, [-1e13, 3.0]), (3, [1.0, 1.0]), (4, [8e12, 8e12]), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    m = [[int(np.floor(x * 1024)) for x in e] for _, e in v[:5]]
    score = {j: m[0][0] * e[0] + m[0][1] * e[1] for j, e in enumerate(m)}
    want = [(0, r + 1, j, score[j]) for r, j in enumerate(sorted(range(1, 5), key=lambda j: -score[j]))]
    assert rows(topk.top_k(df, df.where("vec_id = 0")), "query_id", "rank", "vec_id", "score") == want
    with pytest.raises(Exception, match="does not fit into 64 bits"):
        topk.top_k(df, df.where("vec_id = 1")).collect()
    huge = spark.createDataFrame([(0, [1.0]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit into 64 bits"):
        topk.top_k(huge, huge.where("vec_id = 0")).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (recompression.substring_dedup, suffix_dedup.suffix_dedup, token_store.tokenized, token_counts.section_tokens, sentencepiece_codec.encoded, ngram_join.ngram_join, line_dedup.line_dedup):
        assert f(none).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
