"""Language identification by Bayesian fusion of evidence.

Each record has a text, and may have a host, a declared markup language, an address suffix (the host's last label) and an
address segment (two letters that begin the path). A naive Bayes model over
byte trigrams gives log-likelihoods of the text. Then, all by grouped aggregation over every record:
  * host priors: expected languages per host, smoothed towards the host's domain, that towards all records;
  * how far a declaration, an address suffix or an address segment can be trusted: expected languages of the records that carry it.
The logarithms are added and normalised. A record is kept if its text has evidence and the best language has at least
MIN_PROBABILITY.

The model is fitted on every label, on at most about SAMPLE texts of each, chosen by a hash of the text; everything else
covers all records. Of equally probable languages the first by name is found. A text of any length is scored whole, in one task. Texts are counted and scored for BLOCK languages at a time. Null and empty texts have no evidence and are not kept. A null host, declaration, suffix or segment says
nothing. Repeated rows are separate records; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, record_batch, ship, utf8, spans

SAMPLE, FEATURES, MIN_PROBABILITY, SMOOTH, BLOCK = 2000, 1 << 15, 0.5, 20.0, 64
#: Trigrams of a text are not independent: so many count as much as one.
TEMPER = 8.0
_SIGNS = ("declared", "suffix", "segment")
_MODEL = pa.schema([("lang", pa.string()), ("f", pa.int32()), ("n", pa.int64())])


def features(data: np.ndarray) -> np.ndarray:
    """Trigram features of bytes, with ASCII capitals lowered."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    x = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(17)).astype(np.int64)


def fit(records: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of features) from (text, label); no language where nothing has a label."""
    ship(records.sparkSession)
    known = records.where("label IS NOT NULL AND text IS NOT NULL AND label != ''")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((FEATURES, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    chosen = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.try_element_at(share, F.col("label")) * 1_000_003)

    def batches(table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, n in table.items():
            at = np.flatnonzero(n)
            yield record_batch(_MODEL, [label] * len(at), at.astype(np.int32), n[at])

    def count(it: Iterator[pa.RecordBatch]):
        table: dict[str, np.ndarray] = {}
        for b in it:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = features(np.frombuffer(text.encode(), np.uint8))
                table[label] = table.get(label, 0) + np.bincount(f, minlength=FEATURES)
                if len(table) >= BLOCK:
                    yield from batches(table)
                    table = {}
        yield from batches(table)

    langs = sorted(counts)
    column = {lang: i for i, lang in enumerate(langs)}
    model = np.full((FEATURES, len(langs)), 0.5)
    for r in chosen.select("label", "text").mapInArrow(count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toLocalIterator():
        model[r.f, column[r.lang]] += r.n
    return langs, np.log(model / model.sum(0)).astype(np.float32)


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, text, host, domain, declared, suffix, segment from url and html, by DataFrame functions."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    segment = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), blank(host).alias("host"), blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), blank(declared).alias("declared"), blank(F.regexp_extract(host, r"\.([^.0-9][^.]*)\.?$", 1)).alias("suffix"), blank(segment).alias("segment"))


def identify(records: DataFrame, langs: list[str], model: np.ndarray, keys: list[str], min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """keys, lang, probability, keep of records (keys, text, host, domain, declared, suffix, segment); without languages none is kept."""
    if not langs:
        return records.select(*keys, F.lit(None).cast("string").alias("identified"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("keep"))
    spark = records.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [*keys, "host", "domain", *_SIGNS]
    source = records.select("text", *rest)
    kinds = dict(source.dtypes)

    def score(it: Iterator[pa.RecordBatch]):
        model = shared.value
        k = model.shape[1]
        for b in it:
            off, data = utf8(b.column(0))
            for i, j in spans(off):
                o = off[i : j + 1] - off[i]
                f = features(data[off[i] : off[j]])
                n = np.maximum(np.diff(o) - 2, 0)
                sums = np.zeros((j - i, k))
                some = np.flatnonzero(n)
                if len(some):
                    # trigrams that cross texts are left out by ending each text two earlier
                    edges = np.stack([o[some], o[some] + n[some]], 1).reshape(-1)
                    at = np.append(f, 0)
                    for c in range(0, k, BLOCK):
                        sums[some, c : c + BLOCK] = np.add.reduceat(model[:, c : c + BLOCK][at], edges, axis=0)[::2]
                total = sums / np.maximum(TEMPER, 1)
                total -= total.max(1, keepdims=True)
                p = np.exp(total)
                p /= p.sum(1, keepdims=True)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, k, dtype=np.int32)), pa.array(a.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(b.column(1 + c).slice(i, j - i) for c in range(len(rest))), pa.array(n), lists(total), lists(p)], names=[*rest, "n", "ll", "p"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "n long, ll array<double>, p array<double>"])
    scored = materialize(source.mapInArrow(score, schema))
    k = len(langs)
    sums = [F.sum(F.when(F.col("n") > 0, F.col("p")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(k)]

    def table(by: str) -> DataFrame:
        return scored.where(F.col(by).isNotNull()).groupBy(*dict.fromkeys([by, "domain"] if by == "host" else [by])).agg(*sums)

    def array(prefix=""):
        return F.array(*[F.col(f"s{i}") for i in range(k)])

    def smoothed(own, above):
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda x, y: (x + SMOOTH * y) / (total + SMOOTH))

    every = scored.agg(*sums).select(F.array(*[(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + 1.0) for i in range(k)]).alias("s"))
    overall = every.first()["s"]
    overall = [x / sum(overall) for x in overall]
    everywhere = F.array(*map(F.lit, overall))
    domains = table("domain").select(F.col("domain").alias("_domain"), smoothed(array(), everywhere).alias("above"))
    hosts = table("host").join(domains, F.col("domain") == F.col("_domain"), "left").select(F.col("host").alias("_host"), F.col("domain").alias("_hd"), smoothed(array(), F.coalesce("above", everywhere)).alias("prior"))
    says = {}
    for by in _SIGNS:
        # likelihood of the sign given a language: what its records were, over what all records are
        says[by] = table(by).select(F.col(by).alias(f"_{by}"), F.zip_with(smoothed(array(), everywhere), everywhere, lambda x, y: F.log(x / y)).alias(f"{by}_log"))
    none = F.array(*[F.lit(0.0)] * k)
    out = scored.join(hosts, (F.col("host") == F.col("_host")) & F.col("domain").eqNullSafe(F.col("_hd")), "left")
    for by in _SIGNS:
        out = out.join(says[by], F.col(by) == F.col(f"_{by}"), "left")
    prior = F.transform(F.coalesce("prior", everywhere), lambda x: F.log(x))
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    out = out.withColumn("post", reduce(add, [F.coalesce(f"{by}_log", none) for by in _SIGNS], add(F.col("ll"), prior)))
    best = F.array_max("post")
    names = F.array(*map(F.lit, langs))
    found = F.get(names, (F.array_position("post", best) - 1).cast("int"))
    probability = 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    evidence = F.col("n") > 0
    return out.select(*keys, F.when(evidence, found).alias("identified"), F.when(evidence, F.round(probability, 4)).alias("probability"), F.coalesce(evidence & (probability >= min_probability), F.lit(False)).alias("keep"))


def document_records(docs: DataFrame, *keys: str) -> DataFrame:
    """Records of documents: source is the host. They have no markup and no address; lang is a label to fit on, never evidence."""
    null = F.lit(None).cast("string")
    return docs.select(*keys, F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"), *[null.alias(c) for c in ("domain", *_SIGNS)])


def fit_documents(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    return fit(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label")), sample)
