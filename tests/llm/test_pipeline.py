import corpus_pipeline
from pyspark.sql import functions as F

from tessellar.llm import decontaminate, sentencepiece_codec


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < out.count() <= docs.count()
    assert out.where("NOT round_trip").count() == 0
    assert out.select("doc_id").distinct().count() == out.count()


def test_stages_on_odd_rows(spark, sf):
    """Every stage keeps and drops what a plain reading says, on repeats, nulls and further columns of clashing names."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND length(text) BETWEEN 300 AND 2000").orderBy("doc_id").limit(4).collect()]
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[1]), (None, prose[2]), (3, None), (4, ""), (5, prose[3] + "\n" + item)]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), f"r{k}", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _row string, _k int")
    known = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_row", F.lit("x")).withColumn("_k", F.lit(-1))

    kept = corpus_pipeline.language_id(spark, known.unionByName(docs), sf)
    assert kept.columns == docs.columns and {r._k for r in kept.where("_k >= 0").collect()} == {0, 1, 2, 3, 6}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    lines = corpus_pipeline.line_dedup(spark, docs, sf).collect()
    assert {r._k for r in lines} - {4, 5} == {0, 2, 3, 6} or {r._k for r in lines} - {4, 5} == {1, 2, 3, 6}
    assert {r._k for r in corpus_pipeline.ngram_join(spark, docs, sf).collect()} in ({0, 2, 3, 4, 5, 6}, {1, 2, 3, 4, 5, 6})
    clean = corpus_pipeline.decontaminate(spark, docs, sf)
    leaks = {r.doc_id for r in decontaminate.decontaminate(docs.select(F.col("_k").alias("doc_id"), "text"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert 6 in leaks and {r._k for r in clean.collect()} == set(range(7)) - leaks
    made = {r.doc_id: r for r in corpus_pipeline.sentencepiece(spark, docs, sf).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    assert all(made[d].ids == sp.encode(t or "") and made[d].round_trip for d, t in rows)


def test_stages_on_empty_tables(spark, sf):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_line_dedup_drops_whole_copies(spark):
    text = "Les.\n\nA line that has more than twenty characters\n \t\nYes.\n"
    docs = spark.createDataFrame([(1, text, 0), (2, text, 0), (3, " \n", 0), (4, "Les.\n\nNo.", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: (text, len(text)), 3: (" \n", 2), 4: ("\nNo.", 4)}
