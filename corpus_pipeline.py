"""Documents to token ids in five stages, each over all that the one before it kept.

  language_id    rejects documents whose text has no evidence of a language or no language probable enough
  line_dedup     removes repeated lines; documents of which nothing is left go
  ngram_join     keeps one document of each class of near duplicates
  decontaminate  rejects documents that hold a passage of the benchmark
  sentencepiece  encodes each text and decodes it again

Each stage but the last returns the columns of documents, further ones included, whatever their names. Null and empty texts
go in the first stage. Rows are told apart even where doc_id repeats or is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import common as _common
from tessellar.llm import decontaminate as _decontaminate
from tessellar.llm import language_id as _language
from tessellar.llm import line_dedup as _lines
from tessellar.llm import ngram_join as _ngrams
from tessellar.llm import sentencepiece_codec as _pieces


def _keyed(docs: DataFrame) -> DataFrame:
    """A unique _k, doc_id, text and the struct _rest of all columns of docs."""
    return _common.keyed(docs, rest=tuple(docs.columns))


def _whole(rows: DataFrame) -> DataFrame:
    return rows.select("_rest.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    langs, model = _language.fit_documents(docs)
    rows = _keyed(docs)
    records = _language.document_records(rows.select("_k", "text", F.col("_rest.source").alias("source")), "_k")
    kept = _language.identify(records, langs, model, ["_k"]).where("keep").select("_k")
    return _whole(rows.join(kept, "_k", "left_semi"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _lines.line_dedup(docs, rest=tuple(docs.columns)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"(?U)\S"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _ngrams.ngram_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    leaks = _decontaminate.decontaminate(rows.select(F.col("_k").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _whole(rows.join(leaks.select(F.col("doc_id").alias("_k")).distinct(), "_k", "left_anti"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _pieces.encoded(docs, keep=("lang", "source"), outputs=("n_tokens", "ids_crc32", "round_trip", "ids"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]

#: Tokenisation and model fitting can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _common.materialize(stage(spark, docs, sf_dir))
    return docs
