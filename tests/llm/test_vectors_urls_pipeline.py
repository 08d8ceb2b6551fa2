"""Vector operators, URL filters and the pipeline."""

import math
import re

import numpy as np
import pytest

import corpus_pipeline
from loomrank.llm import ann, common, embed_dedup, queries, url_filter
from loomrank.llm.graph import components


def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[140:160] = x[1]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(300, None, ""), (301, [0.0] * 16, ""), (302, [float("nan")] * 16, ""), (303, [1.0], ""), (304, [], "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string"), x


def test_embedding_dedup(spark):
    df, x = vectors(spark)
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.embedding_dedup(df).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -1)
    near = s >= 0.95
    assert [got[i][0] for i in range(300)] == near.sum(1).tolist()
    low = np.arange(300)
    for _ in range(300):
        low = np.minimum(low, np.where(near, low, 999).min(1))
    assert [got[i][1] for i in range(300)] == low.tolist()
    assert all(got[i] == (0, i, True) for i in range(300, 305)) and not any(got[i][0] for i in (303, 304))
    assert embed_dedup.embedding_dedup(df.where("false")).count() == 0


def test_vectors_of_other_widths_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=3), rng.normal(size=200)
    near = (b + 0.01 * rng.normal(size=200)).tolist()
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, a.tolist()), (4, a.tolist()), (5, b.tolist()), (6, near), (7, [9.0]), (8, [-9.0]), (None, a.tolist()), (9, [1.0]), (9, [5.0, 1.0])] + [(20 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 3)))]
    df = spark.createDataFrame([(i, v, i, "c") for i, v in rows], "vec_id long, embedding array<double>, id int, code string")
    got = [tuple(r) for r in embed_dedup.embedding_dedup(df).where("vec_id < 20 or vec_id is null").collect()]
    want = [(None, 0, None, None), (1, 1, 1, True), (2, 1, 1, False), (3, None, 3, True), (4, None, 3, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert sorted(map(str, ((i, None if i in (3, 4) else n, c, k) for i, n, c, k in got))) == sorted(map(str, want))
    found = [tuple(r) for r in ann.nearest(df, df.where("vec_id in (1, 3, 5, 7)"), k=2).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in found if r[0] in (1, 5)] == [(1, 1, 2), (1, 2, 9), (5, 1, 6)]
    assert [r[:3] for r in found if r[0] == 3][0] == (3, 1, 4) and [r[2] for r in found if r[0] == 7] == [9, 8]


@pytest.mark.parametrize("wide", [16, 64, 1024])
def test_tables_find_pairs_at_the_threshold(wide):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(2, 400, wide))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    k, tables = embed_dedup.plan_tables(1_000_000, wide)
    found = np.zeros(400, bool)
    for t in range(tables):
        found |= (embed_dedup.buckets(x, k, t) == embed_dedup.buckets(y, k, t)[:, :1]).any(1)
    assert found.all()


def test_nearest_recall(spark):
    df, x = vectors(spark)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 10))
    hit = 0
    for q, rows in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(300), d))[:10]
        assert [r[0] for r in sorted(rows)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & set(best.tolist()))
    assert hit >= 0.9 * 10 * len(got)
    assert len(ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0"), k=10).collect()) == 3
    assert ann.nearest(df.where("vec_id > 299"), df, k=3).count() == 0


def test_nearest_ties_beyond_any_cut(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[:300] = x[0]
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    copies = sorted(ids[:300].tolist())
    asked = copies[:2] + copies[-1:]
    got = {q: [] for q in asked}
    for r in ann.nearest(df, df.where(df.vec_id.isin(asked)), k=10).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: [(i, 0.0) for i in copies if i != q][:10] for q in asked}


def test_nearest_block_with_a_common_offset():
    rng = np.random.default_rng(4)
    x = 1e8 + rng.normal(size=(500, 16))
    ids = rng.permutation(500)
    model = ann.CodeModel(x, 10)
    for q in range(20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        got = [v for _, v, _ in ann.search_block(model, ids[q : q + 1], x[q : q + 1], ids, x, 10, model.bits)]
        assert got == ids[np.lexsort((ids, d))[:10]].tolist()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (1, 0)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


HTML = ["<p>the and then news of the city library</p>"] * 3


def test_urls(spark):
    urls = ["http://A.Net/x", "https://www.example.net/en/1?q", "https://example.net/de/", "http://m.example.com/de/x#y", "http://b.org/fr/z", "http://b.org/en/", None, "no scheme", "http://casino-bets.example.com/en/2", "http://xorg/fr/", "http://net"]
    df = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    counts = url_filter.word_counts(spark.createDataFrame([(h,) for h in HTML], "html string"))
    got = {r["page_id"]: r for r in url_filter.judge(df, counts).collect()}
    assert [got[i]["rule"] for i in range(11)] == ["net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4)] == ["block", "allow", "block", "block", "allow"]
    assert got[8]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert (got[0]["host"], got[0]["path"]) == ("a.net", "/x") and (got[6]["host"], got[7]["path"]) == ("", "")
    assert (got[10]["host"], got[10]["path"]) == ("net", "")
    assert url_filter.judge(df.where("false"), counts).count() == 0


def plain_parts(url):
    rest = (url or "").partition("://")[2]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_urls_of_a_table_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = ["HTTP://X.ORG/fr/", "a://b://c/d?e#f", "://", "x://?q", "x://h#/p?", "x://net?/en", "x://NETnet/", "ftp://u@example.com:80/de/", "x://example.com/de", "x://É.Org/fr/é\n/z", "x://" + "a.b/" * 3000]
    extra = spark.createDataFrame([(None if i % 2 else -i, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(extra)
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"])) for r in url_filter.judge(both, url_filter.word_counts(both)).collect())
    want = []
    for r in both.collect():
        host, path = plain_parts(r["url"])
        fits = [h + p for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((str(r["page_id"]), host, path, str(max(fits, key=len) if fits else None)))
    assert got == sorted(want)


def test_url_classifier_learns_from_ruled_pages(spark):
    rng = np.random.default_rng(2)
    bad, good = ["meadow", "river", "cliff"], ["copper", "silver", "nickel"]
    urls = [f"http://{rng.choice(bad)}{rng.choice(bad)}.site.net/{rng.choice(bad)}" for _ in range(60)]
    urls += [f"http://{rng.choice(good)}{rng.choice(good)}.example.net/en/{rng.choice(good)}" for _ in range(60)]
    urls += ["http://rivercliff.org/meadow", "http://coppersilver.org/nickel", "http://rivercliff.org/en/copper-silver-nickel", "http://other.org/"]
    html = [" ".join(bad + good)] * 124
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string")
    counts = url_filter.word_counts(df)
    bayes = url_filter.train(df, counts)
    assert not {"net", "example", "en", "org", "de", "fr", "com"} & {r["w"] for r in bayes.collect()}
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, counts, bayes).collect()}
    assert [got[i] for i in range(120, 124)] == ["block", "allow", "allow", "allow"]


def test_rare_words_are_known_among_many(spark):
    names = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "quartz" for i in range(5000)]
    counts = spark.createDataFrame([(w, 1) for w in names] + [("field", 10**7)], "w string, n long")
    asked = spark.createDataFrame([(w + "field",) for w in names[::50]] + [("w" * 70,), ("é",)], "name string")
    got = {r["name"]: r["words"] for r in url_filter.segment(asked, counts).collect()}
    assert got == {**{w + "field": [w, "field"] for w in names[::50]}, "w" * 70: ["w" * 70], "é": ["é"]}


def plain_scores(urls, ruled, counts):
    """Verdicts and log odds by one loop over rows: rules first, then words of names."""
    known = dict(counts)
    for w in url_filter.UNWANTED:
        known[w] = max(known.get(w, 0), url_filter.PRIOR_COUNT)
    split, word = url_filter.Segmenter(known), re.compile(r"[^\W\d_]+")
    own = set(word.findall(" ".join(h + p for h, p, _ in url_filter.RULES)))
    tally = {w: [url_filter.PRIOR_COUNT, 0] for w in url_filter.UNWANTED}
    parts = [plain_parts(u) for u in urls]
    for (host, path), rule in zip(parts, ruled, strict=True):
        if rule is not None:
            h, _, p = rule[0].partition("/")
            names = word.findall(host[: len(host) - len(h)] + "/" + path[len(p) + 1 :].lower())
            for w in {w for x in names for w in split(x)} - own:
                tally.setdefault(w, [0, 0])[rule[1] == "allow"] += 1
    bad, good = (sum(n[i] for n in tally.values()) + len(tally) + 1 for i in (0, 1))
    odds = {w: math.log((n[0] + 1) / bad) - math.log((n[1] + 1) / good) for w, n in tally.items()}
    return [None if rule else sum(odds.get(w, 0.0) for x in word.findall(h + "/" + p.lower()) for w in split(x)) for (h, p), rule in zip(parts, ruled, strict=True)]


def test_scores_of_a_table_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    extra = [(None, "http://Casinobonus.org/Win/x", None), (1, "http://a.org/fr/casino", None), (1, None, "word word"), (2, "http://a.org/" + "newscasino" * 300, "<b>news</b>")]
    both = pages.unionByName(spark.createDataFrame(extra * 2, "page_id long, url string, html string"))
    counts = url_filter.word_counts(both)
    rows = url_filter.judge(both, counts).collect()
    assert len(rows) == both.count()
    got = {(r["host"], r["path"]): r for r in rows}
    urls = [r["url"] for r in both.collect()]
    verdict = {h + p: v for h, p, v in url_filter.RULES}
    rules = [got[plain_parts(u)]["rule"] for u in urls]
    want = plain_scores(urls, [r and (r, verdict[r]) for r in rules], {r["w"]: r["n"] for r in counts.collect()})
    for u, z in zip(urls, want, strict=True):
        r = got[plain_parts(u)]
        assert (r["score"] is None) == (z is None)
        if z is not None:
            assert r["score"] == pytest.approx(z, abs=1e-6) and (abs(z) < 1e-6 or r["verdict"] == ("block" if z > 0 else "allow"))


def test_long_names_are_judged_whole(spark):
    plain, bad = "newsofthecityandthelibrary" * 3, "casinobonusfreespinsjackpot" * 4
    df = spark.createDataFrame(list(enumerate([f"http://b.org/{plain}{bad}", f"http://{plain}{bad}.org/", f"http://b.org/{plain}"])), "page_id long, url string")
    counts = url_filter.word_counts(spark.createDataFrame([(h,) for h in HTML], "html string"))
    got = {r["page_id"]: r for r in url_filter.judge(df, counts).collect()}
    assert [got[i]["verdict"] for i in range(3)] == ["block", "block", "allow"]
    [words] = [r["words"] for r in url_filter.segment(spark.createDataFrame([(plain + bad,)], "name string"), counts).collect()]
    assert "".join(words) == plain + bad and words.count("casino") == words.count("jackpot") == 4


def test_segmenter():
    cut = url_filter.Segmenter({"then": 50, "the": 100, "news": 20, "city": 10})
    assert cut("newscity") == ["news", "city"] and cut("") == [] and "".join(cut("qqzzx")) == "qqzzx"


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_rows_by_ids(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    df = spark.createDataFrame([(i if i else None, str(i)) for i in range(-200, 200)] * 2, "k long, v string")
    ids = spark.createDataFrame([(3 * i,) for i in range(-40, 90)], "k long")
    inside = [r["v"] for r in df.collect() if r["k"] is not None and r["k"] % 3 == 0 and -120 <= r["k"] < 270]
    assert sorted(r["v"] for r in common.within(df, "k", ids).collect()) == sorted(inside)
    assert sorted(r["v"] for r in common.without(df, "k", ids).collect()) == sorted(r["v"] for r in df.collect() if r["v"] not in inside)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, sf), name)
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= before
            before = out.count()
        else:
            assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
        docs = out


def test_stages_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[40 * i : 40 * i + 40]) for i in range(8)}
    rows = [(1, texts[1]), (1, texts[1]), (2, texts[1]), (3, texts[3]), (4, None), (4, texts[4]), (None, texts[3]), (None, texts[5]), (None, None), (None, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, texts[1]), (3, texts[3]), (4, texts[4]), (None, texts[3]), (None, texts[5]), (None, None), (None, texts[5])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_mixing_draws_rows_without_id_by_content(spark):
    rows = [(i if i % 2 else None, f"one two three w{i}", "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    chosen = {r["doc_id"] for r in queries.mixing.mix(docs).where("selected and doc_id is not null").collect()}
    assert {r["doc_id"] for r in got} - {None} == chosen
    nulls, others = sum(r["doc_id"] is None for r in got), sum(r["doc_id"] is not None for r in got)
    assert 0 < nulls and 0.6 < nulls / others < 1.7


def test_token_counts_of_rows_without_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (None, "c", "en", "s"), (20, "d e f", "en", "s"), (None, None, "en", "s")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["tokenizer"]: (r["n_docs"], r["n_tokens"]) for r in queries.op7_token_counts(spark, str(tmp_path)).collect()}
    # document 1 is revised to "a b a b"; 20 is deleted and stays away
    assert got == {"words-1": (3, 5), "chars-1": (3, 8)}


def test_registered():
    assert sorted(queries.QUERIES, key=len) and sum(n.startswith("op") for n in queries.QUERIES) == 13


def test_embedding_dedup_below_the_default_threshold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    side = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = 0.7 + 1e-6
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * side]))]
    found = embed_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.7)
    assert found.agg({"n_links": "sum"}).first()[0] >= 598
    assert embed_dedup.code_bits(0.95) == 22
    assert [embed_dedup.code_bits(t) for t in (1.0, 0.0, -1.0)] == [0, 52, 64]


def test_segmenter_finds_the_cheapest_pieces():
    rng = np.random.default_rng(7)
    words = {"".join(rng.choice(list("abc"), rng.integers(1, 5))): int(rng.integers(1, 50)) for _ in range(40)} | {"x" * 70: 3}
    split = url_filter.Segmenter(words)

    def cost(pieces):
        return sum(split.cost.get(p, split.unknown * (1 + 0.5 * len(p))) for p in pieces)

    for _ in range(200):
        name = "".join(rng.choice(list("abcd"), rng.integers(0, 14)))
        best = [0.0]
        for end in range(1, len(name) + 1):
            best.append(min(best[i] + cost([name[i:end]]) for i in range(end)))
        assert "".join(split(name)) == name
        assert cost(split(name)) == pytest.approx(best[-1])
    assert split("x" * 70) == ["x" * 70]
    assert "".join(split("d" * 100_000)) == "d" * 100_000
