"""One query for each operator of this subpackage, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, lexical, line_dedup, ngram_join, recompression, sentencepiece_codec, suffix_dedup, token_counts, token_store, topk, warc, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_token_store(spark, sf_dir):
    return token_store.tokenized(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return recompression.substring_dedup(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    """Every document and every page; pages have no doc_id, documents no page_id."""
    docs, pages = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    langs, model = language_id.fit_documents(docs)
    key = F.lit(None).cast("long")
    records = language_id.document_records(docs.withColumn("page_id", key), "doc_id", "page_id")
    records = records.unionByName(language_id.page_records(pages).withColumn("doc_id", key).select(records.columns))
    return language_id.identify(records, langs, model, ["doc_id", "page_id"])


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encoded(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.section_tokens(_read(spark, sf_dir, "documents"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op10_topk(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")


def op11_warc(spark, sf_dir):
    return warc.archived(_read(spark, sf_dir, "pages"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(_read(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark, sf_dir):
    return lexical.lexical_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_line_dedup, op3_token_store, op4_substring_dedup, op5_suffix_dedup, op6_language_id, op7_sentencepiece, op8_token_counts, op9_ngram_join, op10_topk, op11_warc, op12_whitening, op13_lexical_search)
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        h AS (SELECT doc_id, list_transform(range(1, greatest(1, len(ws) - 33)), lambda i: md5(array_to_string(ws[i:i + 34], chr(10)))) AS hs FROM w),
        s AS (SELECT doc_id, unnest(hs) AS x, generate_subscripts(hs, 1) AS i FROM h),
        d AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM s SEMI JOIN d USING (x)),
        k AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id),
        t AS (SELECT w.doc_id, ws, coalesce(js, []) AS js FROM w LEFT JOIN k USING (doc_id))
        SELECT doc_id, len(ws)::BIGINT AS n_words, len(js)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN len(js) = 0 THEN ws ELSE list_where(ws, list_transform(range(1, len(ws) + 1), lambda j: NOT list_contains(js, j))) END, ' ')) AS kept_sha256
        FROM t""",
    "op5_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT r, x, unnest(range(0, greatest(0, length(x) // 2 - 99))) AS i FROM d)),
        f AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY h ORDER BY r, i) AS n FROM w) WHERE n > 1),
        s AS (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 100)::INTEGER AS new FROM f),
        g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
        u AS (SELECT r, run, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY ALL),
        k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM u),
        t AS (SELECT k.r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(z) AS last FROM k JOIN d USING (r) GROUP BY k.r)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t USING (r)""",
    # The engine's levenshtein counts bytes, so the letters of these texts beyond ASCII become one control byte each
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM l),
        f AS (SELECT *, length(line) AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS rn FROM e WHERE length(line) >= 20 OR regexp_matches(line, '\S')),
        o AS (SELECT doc_id, no, n, translate(line, 'éÉßÇÊíÈöÓçäÄóêüÖÍÜèñÑ', (SELECT string_agg(chr(CASE WHEN i < 8 THEN i + 1 ELSE i + 6 END::INTEGER), '' ORDER BY i) FROM range(21) r(i))) AS line FROM f WHERE rn = 1 AND n >= 10),
        p AS (SELECT *, n + unnest([-2, -1, 0, 1, 2]) AS m FROM o),
        near AS (SELECT DISTINCT b.doc_id, b.no FROM p a JOIN o b ON a.m = b.n WHERE (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.no < b.no) AND levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 10)),
        gone AS (SELECT doc_id, no FROM f WHERE rn > 1 UNION SELECT doc_id, no FROM near),
        t AS (SELECT e.doc_id, count(*) AS n_lines, count(gone.no) AS n_removed, coalesce(string_agg(CASE WHEN gone.no IS NULL THEN line END, chr(10) ORDER BY e.no), '') AS text FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.no = e.no GROUP BY e.doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)""",
    "op9_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        s AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id != b.doc_id GROUP BY ALL),
        e AS (SELECT x, y, c = a.n AND c = b.n AS same FROM s JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
        r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.y AS u FROM r JOIN e ON r.u = e.x),
        k AS (SELECT v AS doc_id, min(u) AS class_id FROM r GROUP BY v),
        l AS (SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS n_copies FROM e GROUP BY x)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies FROM k LEFT JOIN l USING (doc_id)""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score
              FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id != q.vec_id AND len(v.v) = len(q.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((16 * (strpos('0123456789abcdef', substr(h, 5 * i // 4 + 1, 1)) - 1)
                 + greatest(0, strpos('0123456789abcdef', substr(h || '0', 5 * i // 4 + 2, 1)) - 1)) // (2 ** (3 - 5 * i % 4))::BIGINT % 32)::INTEGER, 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != top THEN top END AS refers_to
        FROM d""",
    "op13_lexical_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
        g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM n),
        m AS (SELECT doc_id, 75 + (25 * n * n_docs) // l AS m FROM n, g),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term, n_docs),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        c AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
        s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM c JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}
