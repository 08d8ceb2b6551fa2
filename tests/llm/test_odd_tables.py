"""Extra columns with names of results, nulls in every column, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomrank.llm import contamination, lang_id, mixing, packing, repair, secret_scan, token_counts, variants

SF = "/root/testdata/sf0.001"
NAMES = "n_assign n_access n_hex base_sha256 spans n_model piece start n_tokens bin_id bin_capacity bin_tokens slot mix shard length topic rate selected gap weight tokens lang_pred score accepted held_out tokenizer n_docs sign op old word form root n n_near n_hit n_words items_sha256 contaminated audit cost t l id draw raw u i x".split()


@pytest.fixture(scope="module")
def net(spark):
    return secret_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))


def with_clashes(df):
    """``df`` with a column of a wrong type for every name of a result or of a step, but for those it has."""
    return df.select("*", *[F.array(F.lit("clash")).alias(n) for n in NAMES if n not in df.columns])


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("name", "secrets packing mixing language counts variants contamination repair".split())
def test_extra_columns_change_nothing(spark, net, name, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    content = lang_id.learn(docs)

    def counts(d):
        rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/{len(d.columns)}")
        rollup.commit(0, d)
        return rollup.totals()

    run, df = {
        "secrets": (lambda d: secret_scan.find_secrets(d, net), docs),
        "packing": (lambda d: packing.best_fit(d, "n_chars"), docs),
        "mixing": (lambda d: mixing.mix(d), docs),
        "language": (lambda d: lang_id.identify(d, content), docs),
        "counts": (counts, docs),
        "variants": (lambda d: variants.spelling_variants(d), docs),
        "contamination": (lambda d: contamination.contamination(d, with_clashes(items) if len(d.columns) > 20 else items), docs),
        "repair": (lambda d: repair.repair(d), turns),
    }[name]
    plain = rows(run(df))
    assert plain and rows(run(with_clashes(df))) == plain


def test_language_of_repeated_rows_and_missing_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    content = lang_id.learn(docs)
    text = docs.where("length(text) > 500").first()["text"]
    odd = [(1, text), (1, text), (None, text), (None, None), (2, ""), (None, "123 !"), (3, text * 40)]
    got = lang_id.identify(spark.createDataFrame(odd, "doc_id long, text string"), content).collect()
    assert sorted((repr(r["doc_id"]), r["lang_pred"] == "und") for r in got) == sorted((repr(i), t in (None, "", "123 !")) for i, t in odd)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    # rows without an id are learned from, and a language without texts is never predicted
    labelled = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang").union(spark.createDataFrame([(1, None, "xx"), (2, text, None)], "doc_id long, text string, lang string"))
    assert set(lang_id.learn(labelled)) == {r[0] for r in docs.where("lang is not null").select("lang").distinct().collect()}


def odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    some = docs.where("length(text) > 300").orderBy("doc_id").limit(6).collect()
    key = "token=abcdef0123456789"
    odd = [tuple(r) for r in some] + [tuple(some[0]), (None, some[1]["text"], None, None, None), (None, None, None, None, None), (some[2]["doc_id"], "", "en", None, 0)]
    odd += [(10**9, some[3]["text"] + " " + key, "en", "s", 1), (10**9 + 1, "a " * 50000 + key, None, "s", None)]
    return spark.createDataFrame(odd, docs.schema), some, key


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_odd_rows(spark, stage):
    docs, some, key = odd_rows(spark)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, with_clashes(docs), SF)
    got = out.collect()
    ids = {r["doc_id"] for r in got}
    if stage == "packing":
        assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}
        # every word is placed once: all pieces of all rows
        assert sum(r["n_tokens"] for r in got) == sum(len((r["text"] or "").split()) for r in docs.collect())
    else:
        assert out.columns == corpus_pipeline.COLUMNS and 0 < len(got) <= docs.count()
        same = {(r["doc_id"], r["text"]) for r in docs.collect()}
        if stage == "secrets":
            assert len(got) == docs.count() and all(key.split("=")[1] not in (r["text"] or "") for r in got)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        else:
            assert {(r["doc_id"], r["text"]) for r in got} <= same
        if stage == "language_id":
            assert {(r["doc_id"], r["text"]) for r in some} <= {(r["doc_id"], r["text"]) for r in got}
            assert None not in {r["text"] for r in got} and "" not in {r["text"] for r in got}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "bin_id" in out.columns
