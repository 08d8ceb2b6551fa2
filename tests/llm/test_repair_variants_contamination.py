"""Operators 11 to 13 against plain versions, with nulls, odd texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from loomrank.llm import contamination, queries, repair, variants

SF = "/root/testdata/sf0.001"
FOLD = {i: i + 32 for i in range(65, 91)}
TURN, NAME = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def plain_way(rows, state="", ends=("", "a")):
    """Row by row: ``rows`` are (role, text, fault); the best (cost, audit, repaired) to each state is kept."""

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, out) in list(best.items()):
                put(best, TURN[s], (cost + 5, audit + "I", (*out, NAME[TURN[s]] + ":")))
        return best

    def put(best, s, way):
        if s not in best or way[:2] < best[s][:2]:
            best[s] = way

    best = insert({state: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, out) in best.items():
            put(new, s, (cost + 2, audit + "D", out))
            if fault in "KT":
                more = 5 * (fault == "T")
                put(new, TURN[s], (cost + more + 1, audit + "R", (*out, f"{NAME[TURN[s]]}:{text}")))
                if (s, role[:1]) in LEGAL:
                    put(new, role[:1], (cost + more, audit + "K", (*out, f"{role}:{text}")))
        best = insert(new)
    return min((best[s] for s in ends if s in best), key=lambda w: w[:2], default=None)


def plain_repair(rows):
    convs, found = {}, {}
    for c, turn, role, text in rows:
        own = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults = {r[0] for r in own} - {None}, set(), []
        for _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("B" if not marks else "D" if (role, text) in seen else "K" if marks[-1] in ".!?" else "T")
            seen.add((role, text))
        first = [r[1][:1] for r in own]
        cost, audit, out = plain_way([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[c] = (gaps, *[faults.count(f) for f in "BDT"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def test_least_edits_on_random_lattices():
    rng = random.Random(4)
    names = {repair.START: "", repair.SYSTEM: "s", repair.USER: "u", repair.ASSISTANT: "a"}
    for _ in range(3000):
        codes = tuple((rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice("KKKTD")) for _ in range(rng.randrange(9)))
        entry = rng.choice(list(names))
        ends = (0, 3) if rng.random() < 0.5 else (rng.randrange(4),)
        want = plain_way([(r, "x", f) for r, f in codes], names[entry], [names[e] for e in ends])
        assert repair.least_edits(codes, entry, ends) == (want and want[:2])


def odd_conversations(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "Yes.", "No", "Why?\n", "a b! ", "Once. ", "é", "x.", "y" * 200_000]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randint(1, 25))]
    rows += [rows[0]] * 3
    return rows, spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")


@pytest.mark.parametrize("long", [repair.LONG, 7, 2])
def test_repair(spark, long):
    rows, df = odd_conversations(spark)
    got = repair.repair(df, long).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_repair(rows)
    assert len(got) == 41


@pytest.mark.parametrize("long", [repair.LONG, 3])
def test_repair_on_a_table(spark, long):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    got = repair.repair(df, long)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert repair.repair(df.limit(0), long).count() == 0


def plain_variants(docs, min_length=7, min_count=2):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near, places = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            places.setdefault((i, less), []).append(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for some in places.values():
        for w in some:
            near[w].update(x for x in some if x != w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def variant_texts():
    chain = ["abcdefgh"] * 2000 + ["abcdefgx"] * 200 + ["abcdefyx"] * 20 + ["abcdzfyx"] * 2
    ends = ["xabcdefgh", "abcdefg", "bcdefgh", "aabbccdd", "aabbccd", "abbccdd", "aabccdd", "aabbccddd", "ÀÉÎõüÿß", "àÉÎõüÿß", "ÀÉÎõüÿßa"] * 2
    rng = random.Random(9)
    mixed = ["".join(rng.choice("ab") for _ in range(rng.randint(7, 11))) for _ in range(900)] * 2
    body = "lo" * 1_000
    deep = [body + "ng", body + "nh", body + "g", body[:900] + "x" + body[900:] + "ng", "p" * 70, "p" * 71, "q" + "p" * 70, "p" * 35 + "r" + "p" * 34] * 2
    return [(1, " ".join(chain)), (2, " ".join(ends)), (3, " ".join(mixed).upper()), (4, " ".join(deep)), (5, None), (None, "abcdefgh abcdefgh 12"), (5, ""), (6, "one"), (2, " ".join(ends))]


def test_variants(spark):
    docs = variant_texts()
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in docs], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in variants.spelling_variants(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_variants(docs)
    assert any(r[1] != r[2] and r[1] for r in got)
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_variants_of_short_words(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60))) for i in range(20)]
    got = variants.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), min_length=3, times=2).where("n_near > 0").count()
    assert got == sum(r[4] > 0 for r in plain_variants(docs, 3))


def plain_contamination(docs, items):
    pattern = re.compile(contamination.WORD)
    windows = {}
    for i, text in items:
        w = pattern.findall((text or "").translate(FOLD))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, text in docs:
        w = pattern.findall((text or "").translate(FOLD))
        hit, met = [False] * len(w), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    met |= own
                    hit[k : k + size] = [True] * size
        ids = sorted(str(m) for m in met if m is not None)
        out.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


def contamination_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    long = [rng.choice(words) for _ in range(1500)]
    items = [(1, " ".join(long)), (2, "Only three-words"), (3, "ONE"), (4, None), (5, " .,; "), (6, " ".join(long[700:712])), (None, " ".join(["lost"] * 11)), (10, " ".join(["echo"] * 10)), (1, "Änd the söme ïtem agaïn, with more than ten words here now"), (2, "Only three-words")]
    docs = [(0, None), (1, ""), (2, " ".join(long)), (3, "x " + "|".join(long[695:720]).upper() + " y"), (4, " ".join(long[0:9])), (5, "say only THREE words"), (5, "say only THREE words"), (None, "one two"), (6, "echo " * 25), (7, "lost " * 12), (8, "änd the söme ïtem agaïn with more than ten words"), (9, "änd the söme ïtem agaïn with more than ten wordss"), (10, "z" * 240_000 + " " + " ".join(long[40:60])), (11, "none of it " * 30_000)]
    docs += [(100 + k, " ".join(rng.choice(words) for _ in range(40))) for k in range(20)]
    return docs, items


@pytest.mark.parametrize("part_bytes", [contamination.PART_BYTES, 1500])
def test_contamination(spark, part_bytes):
    docs, items = contamination_rows()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, piece string")
    got = contamination.contamination(df, bench, part_bytes=part_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_contamination(docs, items)
    assert not contamination.contamination(df, bench.limit(0)).where("contaminated or n_hit + n_items > 0").count()
    assert contamination.contamination(df.limit(0), bench).count() == 0


def test_contamination_on_a_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = contamination.contamination(docs, bench).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_decontamination"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
