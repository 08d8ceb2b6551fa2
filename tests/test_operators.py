"""Invariants and cross-checks of operators that SQL does not cover."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomrank import plans, session

from loomrank.operators import geometry, spread, statistics, tables
from loomrank.functions import text as X
from loomrank.operators.alignment import best_fits, fit_targets, global_identities, global_identity, global_matches
from loomrank.operators.search import containing, greedy_clusters, kmer_hits, nearest_by_pivots, redundancy_levels
from loomrank.operators.statistics import crossed_bootstrap
from loomrank.operators.terms import tfidf
from loomrank.plans.library import best_chains
from loomrank.plans.statistics import subset_statistics
from loomrank.sources import files as R
from loomrank.streaming.intake import intake, latest, tally


SF = "/root/testdata/sf0.001"


def test_fit_recovers_a_rotation_and_never_mirrors(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(12, 3)) + 100
    r, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    r *= np.sign(np.linalg.det(r))
    q, mirror = p @ r.T + 5, p * [1, 1, -1]
    rows = [(k, x.tolist(), y.tolist()) for k, ys in (("turned", q), ("mirror", mirror)) for x, y in zip(p, ys)]
    rows += [("few", [0.0, 0.0, 0.0], [1.0, 1.0, 1.0])]
    out = {x["k"]: x for x in geometry.fit_pairs(spark.createDataFrame(rows, "k string, p array<double>, q array<double>"), ["k"]).collect()}
    assert out["turned"]["rmsd"] < 1e-6
    assert np.allclose(np.reshape(out["turned"]["rotation"], (3, 3)), r, atol=1e-8)
    assert out["mirror"]["rmsd"] > 0.1
    assert np.linalg.det(np.reshape(out["mirror"]["rotation"], (3, 3))) == pytest.approx(1)
    assert out["few"]["rmsd"] is None


def test_p_values():
    assert statistics.t_two_sided(0.5, 10) == pytest.approx(0.141111, abs=1e-5)
    assert statistics.t_two_sided(0.0, 10) == pytest.approx(1)
    assert statistics.t_two_sided(None, 10) is None


def test_alignment():
    assert global_identity("ACGT", "ACGT") == 1
    assert global_identity("ACGT", "AGT") == 0.75
    assert global_identity("", "") is None


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(statistics.pearson("x", "y").alias("r")).first()["r"] is None


def test_merged_intervals_are_disjoint(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 6, 7), ("a", 10, 11), ("b", 1, 1)], "k string, s int, e int")
    got = sorted(tuple(r) for r in tables.merge_intervals(df, ["k"], "s", "e", gap=0, min_length=2).collect())
    assert got == [("a", 1, 7), ("a", 10, 11)]


def test_duplicate_policy(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "y"), (2, 1, "z")], "k int, o int, v string")
    assert tables.collapse_duplicates(df.where("k = 1"), ["k"], "o").count() == 1
    with pytest.raises(ValueError):
        tables.collapse_duplicates(df, ["k"], "o")
    with pytest.raises(ValueError):
        tables.checked_join(df, df, ["k"], "one_to_one")


def _sequential_clusters(seqs, identity, coverage):
    """``{text: representative}`` by going through all sequences in order."""
    first, reps, want = {}, [], {}
    for i, s in sorted(seqs):
        first.setdefault(s, i)
    for s, i in sorted(first.items(), key=lambda x: (-len(x[0]), x[1])):
        for r, t in reps:
            matches, columns = global_matches([t], [s])[0]
            if matches / columns >= identity and (len(s) + len(t) - columns) / max(len(s), len(t)) >= coverage:
                want[s] = r
                break
        else:
            reps.append((i, s))
            want[s] = i
    return want


def test_redundancy_levels_match_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("ACDEFGHIKL"), 30)) for _ in range(5)]
    seqs = [(100, "A"), (101, "A"), (102, "AC"), (103, ""), (104, "AAAAAAAAAAAA"), (105, "AAAAAAAAAAA")]
    for i in range(40):
        s = list(base[i % 5])
        for j in rng.integers(0, 30, i % 4):
            s[j] = "W"
        if i % 3 == 0:
            s = s[:-1]
        seqs.append((i, "".join(s)))
    df = spark.createDataFrame([*seqs, (200, None)], "id long, seq string")
    levels = [(0.9, 0.0), (0.9, 0.98), (0.96, 0.0), (0.7, 0.0), (0.8, 0.8)]
    got = {(r["identity"], r["coverage"], r["member"]): r["rep"] for r in redundancy_levels(df, levels).collect()}
    assert len(got) == len(levels) * len(seqs)
    for identity, coverage in levels:
        want = _sequential_clusters(seqs, identity, coverage)
        assert all(got[identity, coverage, i] == want[s] for i, s in seqs)
    assert len({tuple(got[i, c, m] for m in range(40)) for i, c in levels}) > 3
    assert {r["member"]: r["rep"] for r in greedy_clusters(df).collect()} == {m: r for (i, c, m), r in got.items() if (i, c) == levels[0]}
    assert redundancy_levels(df.where("id < 0"), levels).count() == 0
    with pytest.raises(ValueError):
        redundancy_levels(df, [(0.5, 0.0)])


def test_containing_matches_a_plain_search(spark):
    rng = random.Random(5)
    words = ["ab", "b", "", "cab", "d"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (7, "d d cab b b d ab")]
    pieces = [(j, (texts[j][1] + " x")[rng.randrange(0, 3) : 3 + 4 * j]) for j in range(20)] + [(90, None), (91, "no such words are in any text"), (92, "d")]
    pieces += [(93, ""), (94, "b"), (94, "b"), (95, "b d")]
    want = sorted((j, i) for j, f in pieces for i, u in texts if f is not None and u is not None and f in u)
    for part_chars in (1 << 20, 40):
        got = containing(spark.createDataFrame(texts, "id long, u string"), spark.createDataFrame(pieces, "item long, f string"), part_chars=part_chars)
        assert sorted(map(tuple, got.collect())) == want


def test_intake_skips_keys_of_earlier_shards(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for batch in ([(1, "a"), (2, "b"), (2, "b"), (None, "n")], [(2, "z"), (3, "c"), (None, "m")], [(1, "q"), (3, "r")]):
        spark.createDataFrame(batch, "k long, v string").write.mode("append").parquet(source)
        intake(spark, source, "k long, v string", ["k"], out, state)
        tally(spark, source, "k long, v string", "k", out + "-tally", state + "-tally")
    assert sorted(((r["k"], r["v"]) for r in spark.read.parquet(out).collect()), key=str) == sorted([(1, "a"), (2, "b"), (None, "n"), (3, "c")], key=str)
    assert {r["k"]: r["n"] for r in latest(spark, out + "-tally").collect()} == {1: 2, 2: 3, 3: 2, None: 2}


def test_intake_reads_no_parts_for_new_keys(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    report = []
    for b in range(6):
        spark.range(b * 50, b * 50 + 50).select(F.col("id").alias("k"), F.lit(b).alias("v")).coalesce(1).write.mode("append").parquet(source)
        intake(spark, source, "k long, v int", ["k"], out, state, report)
    assert [r[0] for r in report] == [1, 2, 3, 4, 5]
    assert sum(r[1] for r in report) == sum(r[2] for r in report) == 0
    spark.createDataFrame([(7, 9), (7, 9), (1000, 9)], "k long, v int").write.mode("append").parquet(source)
    intake(spark, source, "k long, v int", ["k"], out, state, report)
    assert report[-1] == (6, 1, 1)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(i, i // 50) for i in range(300)] + [(1000, 9)]


@pytest.mark.parametrize("block_rows,pivots", [(16384, None), (7, 5), (20, 1)])
def test_nearest_by_pivots_matches_numpy(spark, block_rows, pivots):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (90, 4)).astype(float)
    df = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (200, None)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest_by_pivots(df, df.where("id % 5 = 0"), 7, block_rows, pivots).collect()}
    assert len(got) == 18 * 7
    for q in range(0, 90, 5):
        d = ((x - x[q]) ** 2).sum(1)
        want = [i for i in np.lexsort((np.arange(90), d)) if i != q][:7]
        assert [got[q, r] for r in range(1, 8)] == want
    assert nearest_by_pivots(df.where("id < 3"), df.where("id = 0"), 7, block_rows, pivots).count() == 2
    assert nearest_by_pivots(df.where("id < 0"), df, 7, block_rows, pivots).count() == 0


def test_nearest_by_pivots_skips_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(20, 16)) * 10, 50, 0) + rng.normal(size=(1000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    report = {}
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest_by_pivots(df, df.where("id % 50 = 0"), 5, pivots=60, report=report).collect()}
    for q in range(0, 1000, 50):
        d = ((x - x[q]) ** 2).sum(1)
        assert [got[q, r] for r in range(1, 6)] == [i for i in np.argsort(d, kind="stable") if i != q][:5]
    assert report["compared"] < 0.3 * report["pairs"]


def test_kmer_hits_match_a_plain_search(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(9)]
    common = " the same four words again "
    library = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))) + common * (i % 3 > 0)) for i in range(120)] + [(500, None), (501, "")]
    queries = [(j, " ".join(rng.choices(words, k=30)) + common) for j in range(6)] + [(7, library[4][1].upper()), (8, None), (9, "no such gram is there"), (10, "short")]

    def grams(text):
        w = re.split(r"\s+", (text or "").lower())
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    held = {i: grams(t) for i, t in library}
    for top in (1000, 12, 3):
        got = sorted((r["query"], r["rank"], r["id"], r["shared"], round(r["identity"], 9)) for r in kmer_hits(spark.createDataFrame(queries, "query long, seq string"), spark.createDataFrame(library, "id long, seq string"), 4, top).collect())
        want = []
        for j, t in queries:
            own = grams(t)
            found = sorted((-len(own & h), i) for i, h in held.items() if own & h)[:top]
            want += [(j, n + 1, i, -s, round(-s / len(own), 9)) for n, (s, i) in enumerate(found)]
        assert got == sorted(want)


@pytest.mark.parametrize("held", [statistics.HELD, 1])
def test_crossed_bootstrap_matches_numpy(spark, held):
    rng = np.random.default_rng(4)
    rows = [(f"d{i}", f"c{j}", float(rng.integers(0, 9)), float(rng.integers(0, 9))) for i in range(6) for j in range(5) if rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "donor string, carrier string, x double, y double")
    got = {r["b"]: r["r"] for r in crossed_bootstrap(cells, 20, held=held).collect()}

    def drawn(b, kind, names):
        picks = [int(hashlib.md5(f"{b}:{kind}/{i}".encode()).hexdigest()[:8], 16) % len(names) for i in range(len(names))]
        return {n: picks.count(i) for i, n in enumerate(names)}

    def mid_ranks(v, w):
        return np.array([w[v < x].sum() + (w[v == x].sum() + 1) / 2 for x in v])

    x, y = (np.array([r[i] for r in rows]) for i in (2, 3))
    for b in range(20):
        d, c = drawn(b, "donor", sorted({r[0] for r in rows})), drawn(b, "carrier", sorted({r[1] for r in rows}))
        w = np.array([d[r[0]] * c[r[1]] for r in rows], float)
        rx, ry = mid_ranks(x, w), mid_ranks(y, w)
        mx, my = np.average(rx, weights=w), np.average(ry, weights=w)
        want = (w * (rx - mx) * (ry - my)).sum() / np.sqrt((w * (rx - mx) ** 2).sum() * (w * (ry - my) ** 2).sum())
        assert got[b] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_spread_ranks_and_quantiles(spark, keys):
    rng = np.random.default_rng(9)
    # one key holds nearly all rows, one is missing, one has missing values only
    rows = [(None if i % 50 == 0 else "rare" if i % 60 == 1 else "empty" if i % 60 == 2 else "hot", i, None if i % 60 == 2 or i % 37 == 0 else float(rng.integers(0, 60))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(9)
    groups = {}
    for k, i, x in rows:
        groups.setdefault(k if keys else 0, []).append((i, x))

    def of(r):
        return r["k"] if keys else 0

    want = {i: (n, len(g)) for g in groups.values() for n, (i, _) in enumerate(sorted(g, key=lambda t: (t[1] is not None, t[1], t[0])), 1)}
    got = spread.number_rows(df, keys, ["x", "i"], "n", "all").collect()
    assert {r["i"]: (r["n"], r["all"]) for r in got} == want
    got = spread.average_ranks(df, keys, "x", "r").collect()
    assert len(got) == len(rows)
    for r in got:
        have = [x for _, x in groups[of(r)] if x is not None]
        assert r["r"] is None if r["x"] is None else r["r"] == sum(x < r["x"] for x in have) + (have.count(r["x"]) + 1) / 2
    got = {of(r): r for r in spread.quantiles(df, keys, "x", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        have = [x for _, x in g if x is not None]
        for n, q in zip("abcd", (0.0, 0.1, 0.5, 1.0)):
            assert got[k][n] == (pytest.approx(np.quantile(have, q)) if have else None)
    assert spread.number_rows(df.where("false"), keys, ["i"]).count() == 0


@pytest.mark.parametrize("blind", [False, True])
def test_quantiles_of_long_keys_by_brackets(spark, monkeypatch, blind):
    rng = np.random.default_rng(3)
    values = {"smooth": rng.normal(size=20000), "tied": rng.integers(0, 4, 9000).astype(float), "steep": rng.pareto(0.5, 7000), "ends": np.repeat([-np.inf, 1.0, 2.0, np.inf], [900, 800, 800, 900]), "short": rng.normal(size=7), "edge": rng.normal(size=1000), "past": rng.normal(size=1001)}
    rows = [(k, float(x)) for k, xs in values.items() for x in xs] + [("smooth", None), ("smooth", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    if blind:  # a sketch that is always wrong changes nothing but the time it takes
        monkeypatch.setattr(spread.F, "percentile_approx", lambda c, ends, accuracy: F.array(*[F.lit(1e9)] * len(ends)))
    at = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.999, "f": 1.0}
    got = {r["k"]: r for r in spread.quantiles(df, ["k"], "x", at).collect()}
    assert set(got) == {*values, "none"} and got["none"]["c"] is None
    for k, xs in values.items():
        for n, q in at.items():
            i = (len(xs) - 1) * q
            low, high = np.sort(xs)[[math.floor(i), math.ceil(i)]]
            want = low if low == high else low + (high - low) * (i - math.floor(i))
            assert got[k][n] == pytest.approx(want, nan_ok=True) or math.isinf(low), (k, n)


def test_ten_thousand_replicates(spark):
    rows = [(f"u{i % 12}", float(i % 7), float(i * i % 11)) for i in range(200)]
    sums = statistics.cluster_sums(spark.createDataFrame(rows, "u string, x double, y double"), "u", "x", "y")
    r = statistics.bootstrap_replicates(sums, 10_000)
    assert r.count() == 10_000 and r.where("r between -1 and 1").count() == 10_000


def plain_fit(chain, target):
    """All alignments, by recursion: the best (score, matches)."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j, last):
        if j == len(target):
            return (0.0, 0)  # the rest of the chain is free
        found = []
        if i < len(chain):
            s, k = go(i + 1, j + 1, "pair")
            same = chain[i] == target[j]
            found.append((s + (2 if same else -1), k + same))
            s, k = go(i + 1, j, "start" if last == "start" else "down")
            found.append((s + (0 if last == "start" else -0.5 if last == "down" else -2), k))
        s, k = go(i, j + 1, "side")
        found.append((s + (-0.5 if last == "side" else -2), k))
        return max(found)

    return go(0, 0, "start")


def test_targets_in_chains_match_a_plain_search():
    rng = np.random.default_rng(5)
    chains = ["".join(rng.choice(list("ABC"), rng.integers(0, 9))) for _ in range(200)]
    targets = ["".join(rng.choice(list("ABC"), rng.integers(1, 7))) for _ in range(200)]
    got = fit_targets(chains, targets, places=True)
    assert [g[:2] for g in got] == [plain_fit(c, s) for c, s in zip(chains, targets)]
    assert all(len(g[2]) == g[1] and g[2] == sorted(set(g[2])) for g in got)
    assert fit_targets(chains, targets) == [g[:2] for g in got]
    assert fit_targets(["XXACDEYY"], ["ACDE"], places=True) == [(8.0, 4, [0, 1, 2, 3])]
    assert fit_targets(["ACDE"], ["ACWWDE"], places=True) == [(5.5, 4, [0, 1, 4, 5])]


def test_identities_of_a_batch_match_a_plain_table():
    def plain(a, b):
        row = [(-2 * j, 0, -j) for j in range(len(b) + 1)]
        for i in range(1, len(a) + 1):
            last, row = row, [(-2 * i, 0, -i)]
            for j in range(1, len(b) + 1):
                s, k, c = last[j - 1]
                same = a[i - 1] == b[j - 1]
                row.append(max((s + (2 if same else -1), k + same, c - 1), *((s - 2, k, c - 1) for s, k, c in (last[j], row[j - 1]))))
        return row[-1][1] / -row[-1][2]

    rng = np.random.default_rng(6)
    a, b = (["".join(rng.choice(list("ABé"), rng.integers(0, 12))) for _ in range(300)] for _ in range(2))
    want = [plain(x, y) if x or y else None for x, y in zip(a, b)]
    assert global_identities([*a, None, "A"], [*b, "A", None]) == [*want, None, None]


def test_sequence_values_worked_by_hand(spark):
    df = spark.createDataFrame([("AR",), ("",), ("A?",), (None,), ("K",), ("DE",)], "s string")
    rows = df.select("s", X.mean_hydropathy("s").alias("h"), X.hydrophobic_moment("s").alias("m"), X.net_charge("s", F.lit(7.0)).alias("c"), X.isoelectric_point("s").alias("pi")).collect()
    got = {r["s"]: r for r in rows}
    assert got["AR"]["h"] == pytest.approx((0.62 - 2.53) / 2) and got["A?"]["h"] == pytest.approx(0.31)
    assert got[""]["h"] == 0 and got[None]["h"] is None and got[""]["m"] == 0
    turn = np.deg2rad(100)
    assert got["AR"]["m"] == pytest.approx(np.hypot(0.62 - 2.53 * np.cos(turn), -2.53 * np.sin(turn)) / 2)
    # lysine: side chain 10.0 and ends 7.5 and 3.55; DE: ends 7.5 and, of E, 4.75
    assert got["K"]["c"] == pytest.approx(1 / (1 + 10**-0.5) + 1 / (1 + 10**-3.0) - 1 / (1 + 10**-3.45))
    assert got["DE"]["c"] == pytest.approx(1 / (1 + 10**-0.5) - 1 / (1 + 10**-2.25) - 1 / (1 + 10**-2.95) - 1 / (1 + 10**-2.55))
    assert got["K"]["pi"] == pytest.approx(8.75, abs=0.01) and got[""]["pi"] is None
    here = df.select("s", X.net_charge("s", X.isoelectric_point("s")).alias("c")).where("s in ('K', 'DE', 'AR')").collect()
    assert all(abs(r["c"]) < 1e-3 for r in here if r["s"] != "AR")


def test_keywords(spark):
    df = spark.createDataFrame([("DNA-binding domain, Zn2 (c) n, cellular process x",), (None,), ("",)], "t string")
    got = [r["k"] for r in df.select(X.keywords(F.col("t")).alias("k")).collect()]
    assert got == [["dna", "binding", "domain", "dna binding", "zn2", "zn2 c", "c n", "cellular", "process", "process x"], None, []]


def test_student_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (1000.0,), (0.0,), (None,)], "v double")
    got = [r["t"] for r in df.select(statistics.t_quantile(F.col("v")).alias("t")).collect()]
    assert got[:3] == [pytest.approx(12.7062, abs=1e-4), pytest.approx(2.22814, abs=1e-5), pytest.approx(1.96234, abs=1e-5)] and got[3:] == [None, None]


def points_of(vec):
    return np.array(vec, float)[:63].reshape(21, 3)


def superposed(p, q):
    a, b = p - p.mean(0), q - q.mean(0)
    u, _, v = np.linalg.svd(a.T @ b)
    d = np.sign(np.linalg.det(u @ v))
    return (u @ np.diag([1, 1, d]) @ v), p.mean(0), q.mean(0)


def test_fits_match_numpy(spark):
    vec = {r["vec_id"]: points_of(r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    tm = {r["vec_id"]: r["tm"] for r in plans.QUERIES["g3_tm_score"](spark, SF).collect()}
    rmsd = {r["vec_id"]: r["rmsd"] for r in plans.QUERIES["g2_superposed_rmsd"](spark, SF).collect()}
    region = {(r["vec_id"], r["region"]): r["rmsd"] for r in plans.QUERIES["g13_framework_fit"](spark, SF).collect()}
    n = 0
    for i in sorted(vec)[:60]:
        if i + 1 not in vec:
            continue
        p, q = vec[i], vec[i + 1]
        turn, mp, mq = superposed(p, q)
        d = np.linalg.norm((p - mp) @ turn - (q - mq), axis=1)
        d0 = max(0.5, 1.24 * np.cbrt(21 - 15) - 1.8)
        assert rmsd[i] == pytest.approx(np.sqrt((d**2).mean()), rel=1e-6) and tm[i] == pytest.approx((1 / (1 + (d / d0) ** 2)).mean(), rel=1e-6)
        place = np.arange(21)
        one, two = (place >= 5) & (place <= 8), (place >= 13) & (place <= 16)
        rest = ~one & ~two
        turn, mp, mq = superposed(p[rest], q[rest])
        for k, part in ((1, one), (2, two)):
            d = np.linalg.norm((p[part] - mp) @ turn - (q[part] - mq), axis=1)
            assert region[i, k] == pytest.approx(np.sqrt((d**2).mean()), rel=1e-6)
        n += 1
    assert n > 20


def test_hashes_torsions_and_clusters_match_numpy(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rng = random.Random(1)
    planes = np.array([[[rng.gauss(0, 1) for _ in range(64)] for _ in range(8)] for _ in range(4)])
    for r in plans.QUERIES["v10_hyperplane_hash"](spark, SF).collect():
        sign = planes @ rows[r["vec_id"]] >= 0
        assert [r[f"token_{t}"] for t in range(4)] == [int(sum(1 << b for b in range(8) if sign[t, b])) for t in range(4)]
    angles = {(r["vec_id"], r["i"]): r["angle"] for r in plans.QUERIES["w14_torsions"](spark, SF).collect()}
    for v in sorted(rows)[:40]:
        p = points_of(rows[v])
        assert (v, 0) not in angles and (v, 19) not in angles
        for i in range(1, 19):
            a, b, c = p[i] - p[i - 1], p[i + 1] - p[i], p[i + 2] - p[i + 1]
            m, n = np.cross(a, b), np.cross(b, c)
            want = np.degrees(np.arctan2(np.linalg.norm(b) * (a @ n), m @ n))
            assert angles[v, i] == pytest.approx(want, abs=1e-6)
    found = {r["vec_id"]: (r["cluster"], r["distance"]) for r in plans.QUERIES["m4_kmeans"](spark, SF).collect()}
    assert set(found) == set(rows)
    for c in {k for k, _ in found.values()}:
        own = np.stack([rows[i] for i, (k, _) in found.items() if k == c])
        want = np.linalg.norm(own - own.mean(0), axis=1)
        assert sorted(d for k, d in found.values() if k == c) == pytest.approx(sorted(want), rel=0.05, abs=0.05)


def test_wilcoxon_matches_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").collect()
    mean = {}
    for r in rows:
        if r["event_type"] in ("click", "view") and r["value"] is not None:
            mean.setdefault(r["user_id"], {}).setdefault(r["event_type"], []).append(r["value"])
    d = np.array([np.mean(m["click"]) - np.mean(m["view"]) for m in mean.values() if len(m) == 2])
    d = d[d != 0]
    a = np.abs(d)
    rank = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    got = plans.QUERIES["t14_wilcoxon"](spark, SF).first().asDict()
    n = len(d)
    values = [v for v in got.values() if isinstance(v, (int, float))]
    plus, minus = rank[d > 0].sum(), rank[d < 0].sum()
    z = abs(plus - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sum((a == x).sum() ** 2 - 1 for x in a) / 48)
    p = math.erfc(z / math.sqrt(2))
    assert any(v == pytest.approx(p, abs=1e-6) for v in values), (got, p)
    assert any(v == pytest.approx(w) for v in values for w in (plus, minus, min(plus, minus)))


def test_subsets_in_one_job_match_each_subset_alone(spark):
    rng = np.random.default_rng(8)
    rows = [(s, r, int(rng.integers(0, 9)), float(rng.integers(0, 20)), float(rng.normal())) for s, n in (("all", 120), ("near", 40), ("tiny", 2)) for r in "ab" for _ in range(n)]
    df = spark.createDataFrame(rows, "subset string, region string, cluster long, x double, y double")
    got = {(r["subset"], r["region"]): r for r in subset_statistics(df, 30).collect()}
    assert set(got) == {(s, r) for s in ("all", "near", "tiny") for r in "ab"}
    assert got["tiny", "a"]["rho"] is None and got["tiny", "a"]["q"] is None
    for subset in ("all", "near"):
        part = df.where(F.col("subset") == subset)
        cells = part.groupBy(F.col("cluster").alias("donor"), F.col("region").alias("carrier")).agg(F.min("x").alias("x"), F.avg("y").alias("y"))
        r = [x["r"] for x in crossed_bootstrap(cells, 30).where("r is not null").collect()]
        assert got[subset, "a"]["crossed_low"] == pytest.approx(np.quantile(r, 0.025))
        p = sorted(got[s, "a"]["p"] for s in ("all", "near"))
        assert sorted(got[s, "a"]["q"] for s in ("all", "near")) == pytest.approx([min(2 * p[0], p[1]), p[1]])
        for region in "ab":
            one = part.where(F.col("region") == region)
            ranked = statistics.with_ranks(one.select("cluster", "x", "y"), [], ["x", "y"])
            sums = statistics.cluster_sums(ranked, "cluster", "r_x", "r_y")
            r = [x["r"] for x in statistics.bootstrap_replicates(sums, 30).collect()]
            row = got[subset, region]
            assert (row["low"], row["high"]) == pytest.approx(tuple(np.quantile(r, [0.025, 0.975])))
            assert row["flip_p"] == pytest.approx(statistics.sign_flip(sums, 30).first()["p"])


def test_confidence_files(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("t1/seed_7/predictions/t1_summary_confidence_sample_3.json", '{"iptm": 0.5,\n "ptm": "bad", "plddt": 80}')
    put("t1/seed_7/predictions/other_summary_confidence_sample_3.json", '{"iptm": 1}')
    put("t2/seed-4_sample-0/t2_seed-4_sample-0_summary_confidences.json", '{"iptm": "0.25", "overall_plddt": 0.9, "mine": 3}')
    put("t2/t2_summary_confidences.json", '{"iptm": 1}')
    one = R.read_confidence(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in one] == [("t1", "7", "3", 0.5, None, 80.0, "t1/seed_7/predictions/t1_summary_confidence_sample_3.json")]
    two = R.read_confidence(spark, str(tmp_path), "rf3", {"ptm": "mine"}, 100.0).collect()
    assert [tuple(r)[:6] for r in two] == [("t2", "4", "0", 0.25, 3.0, 90.0)]


def test_replicates_in_blocks_equal_joined_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(k, f"u{c}", float(rng.integers(0, 9)), float(rng.normal())) for k in ("a", None) for c in range(7) for _ in range(4)]
    df = spark.createDataFrame(rows, "k string, u string, x double, y double")
    sums = statistics.cluster_sums(df.where("k = 'a'"), "u", "x", "y", ["k"])
    for f, by in ((statistics.bootstrap_replicates, ("k", "b")), (statistics.sign_flip, ("k",))):
        one, other = ({tuple(r[c] for c in by): r[-1] for r in f(sums, 600, ["k"], held=held).collect()} for held in (statistics.HELD, 1))
        assert one == pytest.approx(other) and len(one) == (600 if "b" in by else 1)
    values = df.where("k = 'a'").groupBy("u").agg(F.avg("x").alias("v")).withColumn("g", F.lit("g"))
    one, other = ({r["b"]: r["m"] for r in statistics.bootstrap_means(values, 300, "g", "u", "v", held=held).collect()} for held in (statistics.HELD, 1))
    assert one == pytest.approx(other) and len(one) == 300
    constant = statistics.cluster_sums(df.withColumn("x", F.lit(1.0)), "u", "x", "y")
    assert statistics.bootstrap_replicates(constant, 10).where("r is not null").count() == 0


def test_nested_spearman_matches_each_subset(spark):
    rng = np.random.default_rng(12)
    rows = [(k, *(None if rng.random() < 0.05 else float(v) for v in (rng.integers(0, 12), rng.integers(0, 5), rng.normal() * 5))) for k in ("a", "b", None) for _ in range(90)]
    rows += [("few", 1.0, 2.0, 0.0), ("few", 2.0, 3.0, 50.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    at = [-6, -1, 0, 2.5, 20]
    got = {(r["k"], r["threshold"]): (r["rho"], r["n"], r["retained"]) for r in statistics.nested_spearman(df, ["k"], "x", "y", "z", at).collect()}
    want = {}
    for k in ("a", "b", None, "few"):
        full = np.array([r[1:] for r in rows if r[0] == k and None not in r[1:]])
        for t in at:
            part = full[full[:, 2] <= t]
            if len(part):
                rho = np.corrcoef(ranks(part[:, 0]), ranks(part[:, 1]))[0, 1] if len(part) >= 3 and np.ptp(part[:, 0]) and np.ptp(part[:, 1]) else None
                want[k, t] = (rho, len(part), 100 * len(part) / len(full))
    assert set(got) == set(want)
    for k, (rho, n, kept) in want.items():
        assert got[k][1:] == (n, pytest.approx(kept))
        assert got[k][0] == (None if rho is None else pytest.approx(rho, abs=1e-9))


def test_mcnemar_tail_is_exact(spark):
    counts = [(0, 0), (0, 1), (3, 1), (5, 5), (12, 30), (100_000, 100_900), (None, 2)]
    got = [r["p"] for r in spark.createDataFrame(counts, "a long, b long").select(statistics.mcnemar_exact(F.col("a"), F.col("b")).alias("p")).collect()]
    for (a, b), p in zip(counts[:5], got):
        assert p == pytest.approx(min(1, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)), abs=1e-12)
    # a normal tail with continuity correction, good to four digits at such counts
    assert got[5] == pytest.approx(math.erfc((900 - 1) / math.sqrt(200_900) / math.sqrt(2)), rel=1e-4)
    assert got[6] is None


def test_wilcoxon_row(spark):
    from statistics import NormalDist

    r = plans.QUERIES["t14_wilcoxon"](spark, SF).first()
    users = {}
    for x in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "value").collect():
        users.setdefault(x[0], {}).setdefault(x[1], []).append(x[2])
    d = [np.mean(u["click"]) - np.mean(u["view"]) for u in users.values() if "click" in u and "view" in u]
    tied, d = d.count(0), np.array([x for x in d if x])
    a = np.abs(d)
    rank = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    n, sizes = len(d), np.unique(a, return_counts=True)[1]
    spread_ = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (sizes**3 - sizes).sum() / 48)
    z = (rank[d > 0].sum() - n * (n + 1) / 4) / spread_
    want = (n, rank[d > 0].sum(), rank[d < 0].sum(), (d > 0).sum(), (d < 0).sum(), tied)
    assert (r["n"], r["w_plus"], r["w_minus"], r["higher"], r["lower"], r["tied"]) == want
    assert r["p"] == pytest.approx(2 * NormalDist().cdf(-abs(z)))


def test_beside_gives_the_next_and_the_previous_row(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, 1.0, 2.0])) for k in ("a", "b", None) for i in rng.sample(range(1000), 300 if k == "a" else 3)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    for ahead in (True, False):
        got = {(r["k"], r["i"]): r["n"] and tuple(r["n"]) for r in spread.beside(df, ["k"], ["i"], ["i", "v"], "n", ahead).collect()}
        want = {}
        for k in ("a", "b", None):
            own = sorted((r[1:] for r in rows if r[0] == k), key=lambda r: r[0])
            for here, other in zip(own, [*own[1:], None] if ahead else [None, *own[:-1]]):
                want[k, here[0]] = other
        assert got == want


def test_pair_run_values(spark):
    vectors = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        vectors.setdefault(r["label"], []).append((r["vec_id"], np.array(r["embedding"], float)))
    got = {(r["a"], r["b"]): r for r in plans.QUERIES["g10_pair_run"](spark, SF).collect()}
    assert len(got) == sum(len(v) - 1 for v in vectors.values())
    for own in vectors.values():
        own.sort(key=lambda x: x[0])
        for (a, v), (b, w) in zip(own, own[1:]):
            p, q = (x[:63].reshape(21, 3) - x[:63].reshape(21, 3).mean(0) for x in (v, w))
            u, s, vt = np.linalg.svd(p.T @ q)
            s[2] *= np.sign(np.linalg.det(u @ vt))
            rmsd = math.sqrt(max(0, (p**2).sum() + (q**2).sum() - 2 * s.sum()) / 21)
            assert got[a, b]["distance"] == pytest.approx(np.linalg.norm(v - w)) and got[a, b]["status"] == "ok"
            assert got[a, b]["rmsd"] == pytest.approx(rmsd, abs=1e-6)


def test_weights_joined_equal_weights_held(spark):
    docs = spark.createDataFrame([(1, [["aa", "bb"], [], ["aa"]]), (2, [["bb", "cc", "x"]]), (2, [["cc"], None]), (3, None), (4, []), (5, [["aa", "bb", "the"]])], "id long, words array<array<string>>")
    one, other = (sorted((r["id"], r["term"], round(r["w"], 9)) for r in tfidf(docs, ["the"], vocabulary=v).collect()) for v in (1 << 20, 0))
    assert one == other and {t for _, t, _ in one} == {"aa", "bb", "cc", "aa bb"}
    aa, bb = math.log(6 / 2) + 1, math.log(6 / 3) + 1
    w = (1 + math.log(2)) * aa, aa, bb
    assert one[0] == (1, "aa", round(w[0] / math.hypot(*w), 9))
    assert tfidf(docs.limit(0), []).count() == 0


def test_canonical_json_and_checksums(spark, tmp_path):
    one = spark.sql("select named_struct('b', 1, 'a', named_struct('y', array(1.5D, null), 'x', 'q\"\\u00e9\n'), 'm', map('k2', true, 'k1', cast(null as boolean))) as r")
    other = spark.sql("select named_struct('m', map('k1', cast(null as boolean), 'k2', true), 'a', named_struct('x', 'q\"\\u00e9\n', 'y', array(1.5D, null)), 'b', 1) as r")
    text = [d.select(X.canonical_json(F.col("r"), d.schema["r"].dataType)).first()[0] for d in (one, other)]
    assert text[0] == text[1] == '{"a":{"x":"q\\"\u00e9\\n","y":[1.500000000,null]},"b":1,"m":{"k1":null,"k2":true}}'
    (tmp_path / "f.bin").write_bytes(b"abc")
    row = R.file_checksums(spark, str(tmp_path / "f.bin")).first()
    assert (row["bytes"], row["sha256"]) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 7 + [(None,)], "x double")
    assert {r["bin"]: r["n"] for r in tables.histogram(df, "x").collect()} == {0: 7, None: 1}
    assert tables.histogram(df.where("x is null"), "x").first()["bin"] is None
    assert tables.histogram(df.limit(0), "x").count() == 0


def test_absent_ids_fail(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("a\t1\t2\nb\t3\t4\n")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert R.read_some_vectors(spark, str(tmp_path / "v.tsv"), ids).count() == 2
    with pytest.raises(ValueError, match="no vectors for z"):
        R.read_some_vectors(spark, str(tmp_path / "v.tsv"), ids.unionByName(ids.select(F.lit("z").alias("id"))))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Cluster:
        conf, sparkContext = spark.conf, type("C", (), {"master": "spark://host:7077", "applicationId": "app"})

    if not spark.conf.get("spark.checkpoint.dir", None):
        assert session.scratch(spark, "x").startswith("file:/")
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch(Cluster(), "x")


def test_best_fits_is_the_best_of_all_pairs():
    r = random.Random(5)
    for _ in range(60):
        letters = r.choice(["AB", "ABCD", "ABCDEFGHIJ"])
        chains = list({"".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 50))})
        keys = r.sample(range(1000), len(chains))
        targets = ["".join(r.choice(letters) for _ in range(r.randint(1, 10))) for _ in range(r.randint(1, 8))]
        for target, (score, matches, key) in zip(targets, best_fits(chains, keys, targets), strict=True):
            assert (score, matches, -key) == max((s, m, -k) for (s, m), k in zip(fit_targets(chains, [target] * len(chains)), keys))


def test_best_chains_in_blocks_and_with_repeated_names(spark):
    r = random.Random(6)
    chains = [(i, "".join(r.choice("ABC") for _ in range(r.randint(0, 6))), i % 3) for i in range(120)] + [(500, "AAB", None), (501, None, 1)]
    targets = [(i, "".join(r.choice("ABC") for _ in range(r.randint(1, 5))), i % 3) for i in range(20)] + [(90, "AB", 7), (91, "AB", None)]
    found = best_chains(spark.createDataFrame(targets, "s_suppkey long, target string, n long"), spark.createDataFrame(chains, "c_custkey long, chain string, n long"), 7, 3).collect()
    assert sorted(x["s_suppkey"] for x in found) == list(range(20))
    for x in found:
        _, target, n = targets[x["s_suppkey"]]
        own = [(c, s) for c, s, k in chains if k == n and s is not None]
        best = max((score, m, -c) for (c, _), (score, m) in zip(own, fit_targets([s for _, s in own], [target] * len(own))))
        assert (x["score"], x["matches"], -x["c_custkey"]) == best


def test_draws_are_those_of_md5():
    for b, prefix in ((0, ""), (9999, "donor/"), (12, "click"), (7, "x" * 50)):
        for low, high in ((0, 12), (95, 5205), (99_000, 103_000)):
            assert statistics.raw_draws(b, prefix, low, high).tolist() == [int(hashlib.md5(f"{b}:{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(low, high)]


def test_rows_meet_in_parts_and_odd_vectors_stay(spark):
    from loomrank.plans.joins import _measured

    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0, 3.0]), (5, [3.0, 4.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = tables.meet_in_blocks(e, e.where("vec_id = 0"), _measured, "query_id long, vec_id long, euclidean double, cosine double", 2, 1)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 5.0, 0.0), (0, 2, None, None), (0, 3, None, 0.0), (0, 4, None, None), (0, 5, 0.0, 1.0)]


def test_upper_case_is_that_of_sql(spark):
    import duckdb
    from loomrank.plans.joins import _WIDE, _upper

    text = "Stra\u00dfe \u00e9\u00ff " + "".join(_WIDE)
    want = duckdb.execute("select upper(?)", [text]).fetchall()[0][0]
    assert spark.createDataFrame([(text,)], "text string").select(_upper("text")).first()[0] == want


@pytest.mark.parametrize("extra", ["", "é ", "\U0001f600￿", "ab" * 200])
def test_differences_of_packed_texts(spark, monkeypatch, extra):
    from loomrank.functions import text

    names = ["", "abc", "abd", "ab", None, "\0", "abcdefgh", "xbcdefghi", "~" * 30, "abc", "z" + extra, extra + "z"]
    s, bits, size = text.packed(spark.createDataFrame([(n,) for n in names], "n string"), "n", "codes")
    want = sorted([(a, b, None if a is None or b is None else sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))) for a in names for b in names], key=repr)
    for few in (0, 1000):
        monkeypatch.setattr(text, "FEW_NUMBERS", few)
        pairs = tables.every_pair(s, s, rows=5)
        got = pairs.select("n", F.col("other.n").alias("m"), text.differences(F.col("codes"), F.col("other.codes"), bits, size).alias("d"))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    # pairs are made where rows are, not sent to Python and back
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Broadcast" not in plan


def test_parts_that_meet_are_bounded_and_sent_once(spark):
    rows = spark.createDataFrame([(7,)] * 9, "k long")
    sizes = tables.meet_in_blocks(rows, rows, lambda a, b: pa.table({"n": [a.num_rows], "m": [b.num_rows]}), "n long, m long", 4, 2)
    found = [tuple(r) for r in sizes.collect()]
    # equal rows do not end up in one part
    assert sum(n * m for n, m in found) == 81 and max(n for n, _ in found) <= 4 and max(m for _, m in found) <= 2
    assert "CartesianProduct" in sizes._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_keys_come_in_any_order():
    rng, own = np.random.default_rng(8), {k: np.arange(k * 1000, k * 1000 + 1800 + k).reshape(-1, 1) for k in (1, 2, 3)}
    pieces = pa.concat_tables([statistics._in_pieces(pa.table({"_key": [k]}), lambda _, v=v: (len(v), v)) for k, v in own.items()])
    pieces = pieces.append_column("_block", pa.array([4] * pieces.num_rows))
    for order in (np.arange(pieces.num_rows), rng.permutation(pieces.num_rows)):
        found = {k: (b, n, data.view(np.int64).tolist()) for b, k, n, data in statistics._put_together(pieces.take(order).to_batches(max_chunksize=5))}
        assert found == {k: (4, len(v), v.ravel().tolist()) for k, v in own.items()}


def test_a_million_cells_are_not_joined_to_replicates(spark):
    cells = spark.range((1 << 20) + 10).select((F.col("id") % 400_000).alias("donor"), F.format_string("c%d", F.col("id") % 3).alias("carrier"), (F.col("id") % 1009).cast("double").alias("x"), (F.col("id") % 1013).cast("double").alias("y"))
    r = crossed_bootstrap(cells, 2)
    assert r.where("abs(r) < 1").count() == 2
    # cells are packed once and read beside each block of replicates
    assert "CartesianProduct" in r._jdf.queryExecution().executedPlan().toString()


def test_terms_are_asked_for_once_by_each_part(spark):
    from collections import Counter

    rng = random.Random(3)
    words = ["a", "the", "é", "ﬀ", "zz\U0001f600"] + [f"w{i}" for i in range(30)]
    texts = {i: [[rng.choice(words) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(4))] for i in range(150)} | {150: None, 151: []}
    docs = spark.createDataFrame(list(texts.items()), "id long, words array<array<string>>")

    def terms(elements):
        found = Counter(t for e in elements or [] for t in [*e, *map(" ".join, zip(e, e[1:]))])
        return {t: 1 + math.log(n) for t, n in found.items() if len(t) > 1 and t not in ("the", "w1 w2")}

    held = {i: terms(e) for i, e in texts.items()}
    df = Counter(t for h in held.values() for t in h)
    want = {}
    for i, h in held.items():
        w = {t: v * (math.log(len(texts) / df[t]) + 1) for t, v in h.items() if df[t] >= 2}
        want |= {(i, t): v / math.hypot(*w.values()) for t, v in w.items()}
    for size in (1 << 20, 2000):
        out = tfidf(docs, ["the", "w1 w2"], vocabulary=size)
        assert {(r["id"], r["term"]): r["w"] for r in out.collect()} == pytest.approx(want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the documents are shuffled once, and no term by itself
        assert "Join" not in plan and "Generate" not in plan and "ReusedExchange" in plan


def test_rows_of_subsets_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(s, f"r{i % 2}", i % 7, float(i % 5), float(i * i % 11)) for s in "ab" for i in range(60)], "subset string, region string, cluster long, x double, y double")
    assert subset_statistics(rows.mapInArrow(counted, rows.schema), 5).count() == 4
    assert seen.value == 120
