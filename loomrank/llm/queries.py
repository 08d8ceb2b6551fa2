"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, contamination, embed_dedup, lang_id, mixing, ngram_join, packing, repair, secret_scan, substring_dedup, token_counts, url_filter, variants
from .common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.find_secrets(docs, secret_scan.train(docs))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.best_fit(docs.select("doc_id", mixing.word_count(F.col("text")).alias("n_words")), "n_words")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts in four batches, deletes, revisions and a compaction, some batches sent twice.

    Documents whose id ends in 0 are deleted, and every other one of those comes
    back; those whose id ends in 1 are revised to their text twice over.  Rows
    without an id are in the first batch and stay as they are.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rollup = token_counts.TokenRollup(spark)
    for b in (0, 1, 2, 3, 3):
        rollup.commit(b, docs.where(f"coalesce(pmod(doc_id, 4), 0) = {b}"))
    rollup.commit(4, docs.where("pmod(doc_id, 10) = 0").withColumn("op", F.lit("delete")), op_col="op")
    twice = docs.where("pmod(doc_id, 10) = 1").withColumn("old", F.col("text")).withColumn("text", F.concat_ws(" ", "text", "text")).withColumn("op", F.lit("revise"))
    rollup.commit(5, twice, op_col="op", old_col="old")
    rollup.compact()
    rollup.commit(5, twice, op_col="op", old_col="old")
    rollup.commit(6, docs.where("pmod(doc_id, 20) = 10"))
    return rollup.totals()


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.word_counts(pages))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, lang_id.learn(docs.where(~lang_id.held_out())))
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_secret_scan, op3_best_fit_packing, op4_embedding_dedup, op5_substring_dedup, op6_nearest, op7_token_counts, op8_url_filter, op9_language_id, op10_source_mixing, op11_conversation_repair, op12_spelling_variants, op13_decontamination, pipeline)
}

_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FOLDED = f"text, {_UPPER_LOWER}"

ORACLE: dict[str, str] = {
    "op7_token_counts": rf"""
        WITH kept AS (SELECT source, lang, CASE WHEN doc_id % 10 = 1 THEN concat_ws(' ', text, text) ELSE text END AS text
                      FROM documents WHERE coalesce(doc_id % 20 <> 0, true))
        SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
               CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))) AS BIGINT) AS n_tokens
        FROM kept GROUP BY source, lang
        UNION ALL
        SELECT source, lang, 'chars-1', count(*), CAST(sum(length(coalesce(text, ''))) AS BIGINT)
        FROM kept GROUP BY source, lang""",
    # windows as text; an item of fewer words than a window is one
    "op13_decontamination": rf"""
        WITH
        i AS (SELECT item_id, regexp_extract_all(translate({_FOLDED}), '{contamination.WORD}') AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS win FROM i WHERE len(w) > 0),
        d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(regexp_extract_all(translate({_FOLDED}), '{contamination.WORD}'), []) AS w FROM documents),
        s AS (SELECT DISTINCT size FROM p),
        g AS (SELECT row, s.size, unnest(range(1, len(w) - s.size + 2)) AS k, unnest(list_transform(range(1, len(w) - s.size + 2), lambda k: array_to_string(w[k:k + s.size - 1], ' '))) AS win FROM d, s WHERE len(w) >= s.size),
        m AS (SELECT row, k, g.size, item_id FROM g JOIN p ON g.win = p.win AND g.size = p.size),
        h AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(k, k + size)) AS spot FROM m) GROUP BY row),
        t AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY row)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (row) LEFT JOIN t USING (row)""",
    # crc32 over bytes with its usual table, built from the polynomial
    "op12_spelling_variants": rf"""
        WITH RECURSIVE
        bits AS (SELECT b::BIGINT AS b, 0 AS step, b::BIGINT AS c FROM range(256) r(b)
                 UNION ALL SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
        crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
        r AS (SELECT doc_id, translate(u, {_UPPER_LOWER}) AS r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{variants.LETTERS}]{{7,}}')) AS u FROM documents) GROUP BY 1, 2),
        k AS (SELECT doc_id, r, n, regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), '..') AS x FROM r),
        v AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(x, lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS h FROM k, crc),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(n)::BIGINT AS n FROM v GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
        e AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS less FROM w, range(1, 100) g(i) WHERE i <= length(word)),
        a AS (SELECT x.word, y.word AS other, y.n AS other_n FROM e x JOIN e y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
              UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.less = w.word
              UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.less = w.word),
        b AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM a GROUP BY 1),
        f AS (SELECT w.word, CASE WHEN best_n >= 10 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
        up AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY 1) USING (word)""",
}
