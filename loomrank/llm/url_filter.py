"""URL filters: host rules, then segmented words scored by naive Bayes.

Rules of (host, path start) are applied first; the longest that fits wins.  For
the other urls the names in host and path are split into words by a unigram Viterbi
search, whose word counts come from the visible text of all pages, and the words are
scored by multinomial naive Bayes.  Its training rows are the pages that rules decide:
their words, without those of the rule itself, count for the rule's verdict.  A short
list of words of unwanted sites is added to the blocked class, as prior knowledge.

No model is held whole anywhere: word counts and log odds are tables.  Every distinct
name meets only those of its pieces that are words, by a join; its words meet their
odds by another, and addresses add up the scores of their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, possibly_in, session_settings

#: (host, path start, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: words of sites that are not wanted: prior knowledge, each as if seen ``PRIOR_COUNT`` times in blocked pages
UNWANTED = (
    "adult bet bets betting bingo blackjack bonus camgirl casino cash cheap cialis clickbait crack dating escort "
    "free gambling hentai hookup jackpot keygen loan loans lottery lotto nude nudes pharma pills poker porn porno pron roulette "
    "sex sexy slot slots spam spins sportsbook torrent viagra warez webcam win winner winning xxx"
).split()
PRIOR_COUNT = 20
#: letters of a part of a host name, at most
LABEL = 63
#: log odds are added as whole numbers of this part, so that no order of adding changes a score
ODDS_UNIT = 1 << 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path columns; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null; length counts host and path."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(w, n)``: counts of all words of all pages' visible text, the segmenter's unigrams."""
    seen = F.lower(F.regexp_replace(F.col(html_col), r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " "))
    words = pages.select(F.explode(F.split(seen, r"[^\p{L}]+")).alias("w")).where("w <> ''")
    return cut(words.groupBy("w").agg(F.count("*").alias("n")), "words")


class Segmenter:
    """Unigram Viterbi over one name; unknown stretches pay by length.

    ``counts`` holds the words that may occur in the name, ``total`` the sum of all
    counts of the model they are from.  Words of ``LABEL`` letters or fewer are looked
    for at every place; a longer one is known where it is a whole name.
    """

    def __init__(self, counts: Mapping[str, int], total: int | None = None) -> None:
        total = total or max(2, sum(counts.values()))
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 2.0
        self.sizes = sorted({len(w) for w in counts if 0 < len(w) <= LABEL})

    def __call__(self, name: str) -> list[str]:
        if len(name) > LABEL and name in self.cost:
            return [name]
        n, far = len(name), math.inf
        # the cheapest way to each place, and the cheapest that ends in an unknown stretch; where their last pieces begin
        best, back = [0.0] + [far] * n, [0] * (n + 1)
        lost, since = far, 0
        for start in range(n):
            if start and lost < best[start]:
                best[start], back[start] = lost, since
            open_ = best[start] + self.unknown
            if open_ < lost:
                lost, since = open_, start
            lost += 0.5 * self.unknown
            for size in self.sizes:
                end = start + size
                if end > n:
                    break
                cost = self.cost.get(name[start:end])
                if cost is not None and best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        if n and lost < best[n]:
            best[n], back[n] = lost, since
        out, end = [], n
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def names_of(host: Column, path: Column) -> Column:
    """Names of an address: the runs of letters of its host and lower-cased path."""
    return F.regexp_extract_all(F.concat(host, F.lit("/"), F.lower(path)), F.lit(r"(\p{L}+)"), F.lit(1))


def segment(names: DataFrame, counts: DataFrame, prior: Sequence[str] = UNWANTED) -> DataFrame:
    """``(name, words)`` of a table of distinct names; ``counts`` is ``(w, n)``, to which words of ``prior`` are added.

    Pieces of names, under a digest of the name, are joined with the words; each name is
    then split by the words found in it, which are at most ``LABEL`` for each letter.
    """
    spark = names.sparkSession
    more = spark.createDataFrame([(w, PRIOR_COUNT) for w in sorted(set(prior))], "w string, n long")
    known = cut(counts.select("w", F.col("n").cast("long").alias("n")).unionByName(more).groupBy("w").agg(F.max("n").alias("n")), "known")
    total = max(2, known.agg(F.sum("n")).first()[0] or 0)

    keyed = names.select("name", F.unhex(F.md5("name")).alias("id"))
    tails = keyed.select("id", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")).select("id", F.col("name").substr(F.col("at"), F.lit(LABEL)).alias("tail"))
    pieces = tails.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda k: F.substring(F.col("tail"), F.lit(1), k))).alias("w"))
    whole = keyed.where(F.length("name") > LABEL).select("id", F.col("name").alias("w"))
    possible = possibly_in(pieces.unionByName(whole), "w", known.select("w")).where("possibly").select("id", "w").distinct()
    found = possible.join(known, "w").groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(0).to_pylist()
            words = [Segmenter({r["w"]: r["n"] for r in own or ()}, total)(x) for x, own in zip(name, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return keyed.join(found, "id", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def _ruled(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "hit.rule", "hit.verdict")


def _addresses(rows: DataFrame, counts: DataFrame, prior: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct addresses of pages with their number of rows, and their names split into words."""
    found = cut(rows.groupBy("host", "path", "rule", "verdict").agg(F.count("*").alias("m")), "addresses")
    names = found.select(F.explode(F.array_distinct(names_of(F.col("host"), F.col("path")))).alias("name")).distinct()
    return found, cut(segment(names, counts, prior), "segments")


def _learn(addresses: DataFrame, split: DataFrame, rules, prior: Sequence[str]) -> DataFrame:
    own = sorted({w for h, p, _ in rules for w in re.findall(r"[^\W\d_]+", f"{h}/{p.lower()}")})
    rule_host = F.substring_index("rule", "/", 1)
    host = F.expr("substring(host, 1, length(host) - length(substring_index(rule, '/', 1)))")
    path = F.col("path").substr(F.length("rule") - F.length(rule_host) + 1, F.length("path"))
    labelled = addresses.where("verdict is not null").select("host", "path", "verdict", "m", F.explode(F.array_distinct(names_of(host, path))).alias("name"))
    words = labelled.join(split, "name").select("host", "path", "verdict", "m", F.explode("words").alias("w")).distinct()
    blocked = F.col("verdict") == "block"
    bad, good = (F.sum(F.when(c, F.col("m")).otherwise(0)) for c in (blocked, ~blocked))
    seen = words.where(~F.col("w").isin(own)).groupBy("w").agg(bad.alias("bad"), good.alias("good"))
    more = addresses.sparkSession.createDataFrame([(w, PRIOR_COUNT, 0) for w in sorted(set(prior))], "w string, bad long, good long")
    table = cut(seen.unionByName(more).groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "address_words")
    n = table.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("bad") + 1) / float(n[0] + n[2] + 1)) - F.log((F.col("good") + 1) / float(n[1] + n[2] + 1))
    return table.select("w", "bad", "good", odds.alias("odds"))


def train(pages: DataFrame, counts: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, prior: Sequence[str] = UNWANTED) -> DataFrame:
    """The classifier as a table ``(w, bad, good, odds)``, from all pages that a rule decides.

    Multinomial naive Bayes of two classes of equal weight, add-one smoothing; ``odds`` are
    the log odds of blocked.  A page's words count once each.  What a rule looks at is left
    out: the end of the host and the start of the path that are the rule's, and in the words
    of all pages the rules' own names; so the classes differ by what stands beside the rules.
    Words of ``prior`` count as if seen ``PRIOR_COUNT`` times in blocked pages.
    """
    session_settings(pages.sparkSession)
    return _learn(*_addresses(_ruled(pages, id_col, url_col, rules), counts, prior), rules, prior)


def judge(pages: DataFrame, counts: DataFrame, bayes: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES, prior: Sequence[str] = UNWANTED) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, one row per row of ``pages``.

    ``score`` is the naive Bayes log odds, null where a rule decides; over 0 blocks, and 0
    allows.  Null urls and urls without ``://`` have empty host and path and are
    scored on those (0).  Words that neither class knows say nothing.  Whole urls are
    scored, however long.  Null and repeated ids keep a row each; other columns are
    ignored; an empty table gives no rows.  Without ``bayes`` the classifier is trained
    on ``pages``.  ``counts`` is a table ``(w, n)``, ``bayes`` one of ``(w, odds)``.
    """
    session_settings(pages.sparkSession)
    rows = _ruled(pages, id_col, url_col, rules)
    addresses, split = _addresses(rows, counts, prior)
    bayes = _learn(addresses, split, rules, prior) if bayes is None else bayes
    odds = bayes.select("w", F.round(F.col("odds") * ODDS_UNIT).cast("long").alias("z"))
    of_name = split.select("name", F.explode("words").alias("w")).join(odds, "w").groupBy("name").agg(F.sum("z").alias("z"))
    open_ = addresses.where("verdict is null").select("host", "path", F.explode(names_of(F.col("host"), F.col("path"))).alias("name"))
    scores = open_.join(of_name, "name").groupBy("host", "path").agg(F.sum("z").alias("z"))
    score = F.when(F.col("verdict").isNull(), F.coalesce(F.col("z"), F.lit(0)) / ODDS_UNIT)
    verdict = F.coalesce("verdict", F.when(F.col("z") > 0, "block").otherwise("allow"))
    return rows.join(scores, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
