"""Spelling variants: words one edit apart, found by walking all words through a trie held as tables.

A trie over all words, and one over all reversed words, exist only as edge tables,
one for each depth, made when the walk gets there.  The walk's states are rows
``(word, position, node, edits)``; at each depth they are joined with the edges that
leave their nodes.  An edit in the second half of a word is met in the first trie,
one in the first half in the second, so states branch only below a word's own half
and no node near a root is ever joined.  A node below which a single word lies
carries that word; states that get there compare what is left and end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE = ["way", "w", "n", "pos", "node", "edits"]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased; of a run whose crc32 with its document's id is divisible by ``every`` one letter is gone."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("r"))
    rows = rows.select("d", F.translate("r", _UPPER, _LOWER).alias("r")).withColumn("h", F.crc32(F.concat_ws(":", "d", "r")))
    at = F.pmod(F.col("h"), F.length("r")).cast("int")
    less = F.concat(F.col("r").substr(F.lit(1), at), F.col("r").substr(at + 2, F.length("r")))
    word = F.when(F.col("h") % every == 0, less).otherwise(F.col("r"))
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _step(depth: int) -> int:
    """Letters on the edges that leave a depth: one up to 8, then an eighth to a quarter of the depth."""
    return 1 << max(0, depth.bit_length() - 3)


def _depths(least: int, most: int) -> list[int]:
    out = [least]
    while out[-1] < most:
        out.append(out[-1] + _step(out[-1]))
    return out


def _rest(word: str | Column, position: str | Column, size: Column | None = None) -> Column:
    word, position = (F.col(c) if isinstance(c, str) else c for c in (word, position))
    return word.substr(position + 1, F.length(word) if size is None else size)


def _letter_bit(letter: Column) -> Column:
    """One of 64 bits for a letter."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letter), F.lit(64)).cast("int"))


def near_words(words: DataFrame, min_length: int = 7) -> DataFrame:
    """``(word, n, other, other_n)`` for all ordered pairs of words ``(word, n)`` that are one edit apart.

    Words are distinct and of ``min_length`` letters at least.  Substitutions are
    found from the smaller word and deletions from the longer, then turned round.
    Nodes are 64-bit names of prefixes; two prefixes with one name share a node,
    and pairs are compared in full at the end.
    """
    both = words.select(F.lit(0).alias("way"), F.col("word").alias("w"), "n").unionByName(words.select(F.lit(1).alias("way"), F.reverse("word").alias("w"), "n"))
    least = min_length // 2
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    depths = _depths(least, longest + 1)
    states = both.select("way", "w", "n", F.lit(least).alias("pos"), F.xxhash64("way", F.col("w").substr(1, least)).alias("node"), F.lit(-1).alias("edits"))
    pairs: list[DataFrame] = []
    for depth, after in zip(depths, depths[1:], strict=False):
        step = F.lit(after - depth)
        # a word's edits begin at the last depth within its first half
        states = states.withColumn("edits", F.when((F.col("edits") == -1) & (F.floor(F.length("w") / 2) < after), 0).otherwise(F.col("edits")))
        own = F.struct(F.col("w").alias("w"), F.col("n").alias("n"))
        label = F.col("w").substr(depth + 1, after - depth)
        ends = F.length("w") <= after
        edges = states.where("edits <= 0").groupBy("node", label.alias("label")).agg(F.count("*").alias("below"), F.min(own).alias("one"), F.max(F.when(ends, own)).alias("last"), F.bit_or(F.when(~ends, _letter_bit(F.col("w").substr(after + 1, 1)))).alias("follow"))
        edges = edges.withColumn("child", F.xxhash64("node", "label"))

        def to(position: Column, edits: int | Column, ended: bool = False) -> Column:
            return F.struct(position.cast("int").alias("pos"), (F.lit(edits) if isinstance(edits, int) else edits).alias("edits"), F.lit(ended).alias("ended"))

        alone = F.col("below") == 1
        # states without a choice take the edge that goes on as they do
        straight = states.where("edits <> 0").withColumn("label", _rest("w", "pos", step)).join(edges, ["node", "label"])
        meets = (F.col("edits") == 1) & (_rest("w", "pos") == _rest("one.w", F.lit(depth)))
        straight = straight.withColumn("to", F.when(~alone, to(F.col("pos") + step, F.col("edits"))).when(meets, to(F.col("pos"), 1, True)))
        # states with their edit to come meet every edge of their node
        free = states.where("edits = 0").join(edges, "node")
        here, longer = _rest("w", "pos", step), _rest("w", "pos", step + 1)
        mine, theirs = _rest("w", "pos"), _rest("one.w", F.lit(depth))
        meets = ((F.length(mine) == F.length(theirs) + 1) | ((F.length(mine) == F.length(theirs)) & (theirs > mine))) & (F.levenshtein(mine, theirs, 1) == 1)
        changed = (F.length(here) == step) & (F.col("label") > here) & (F.levenshtein("label", here, 1) == 1)
        dropped = (F.length(longer) == step + 1) & (F.levenshtein("label", longer, 1) == 1)

        def goes_on(position: Column) -> Column:
            """Whether the word ends behind the edge, or its next letter may leave the node there; only such states are worth a row."""
            more = F.coalesce(F.col("follow").bitwiseAND(_letter_bit(F.col("w").substr(position + 1, F.lit(1)))) != 0, F.lit(False))
            return F.when(F.length("w") == position, F.col("last").isNotNull()).otherwise(more)

        over, beyond = F.col("pos") + step, F.col("pos") + step + 1
        ways = F.array_compact(F.array(F.when(changed & goes_on(over), to(over, 1)), F.when(dropped & goes_on(beyond), to(beyond, 1))))
        on = F.when(alone, F.when(meets, F.array(to(F.col("pos"), 0, True)))).when(F.col("label") == here, F.array(to(F.col("pos") + step, 0))).otherwise(ways)
        free = free.withColumn("to", F.explode(on))
        moved = [df.where("to is not null").select("way", "w", "n", "to.*", F.col("child").alias("node"), F.when(F.col("to.ended"), F.col("one")).otherwise(F.col("last")).alias("at")) for df in (straight, free)]
        found = cut(moved[0].unionByName(moved[1]).select("*", F.col("at.w").alias("x"), F.col("at.n").alias("xn")).drop("at"), f"depth{depth}")
        left = F.length("w") - F.col("pos")
        hit = F.col("ended") | (F.col("x").isNotNull() & (((F.col("edits") == 1) & (left == 0)) | ((F.col("edits") == 0) & (left == 1))))
        pairs.append(found.where(hit).select("way", "w", "n", "x", "xn"))
        states = found.where(~F.col("ended") & ((F.col("edits") <= 0) | (left > 0))).select(*STATE)
        if states.isEmpty():
            break
    if not pairs:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    turned = reduce(DataFrame.unionByName, pairs)
    straight = turned.select(*[F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c)).alias(a) for c, a in (("w", "word"), ("x", "other"))], "n", F.col("xn").alias("other_n"))
    straight = straight.select("word", "n", "other", "other_n").where(F.levenshtein("word", "other", 1) == 1)
    back = straight.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return straight.unionByName(back).distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, times: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of :func:`vocabulary`.

    ``form`` is the near word of largest count, ties to the smaller one, if its count
    is ``times`` the word's or more, else null; ``root`` is where following forms
    ends.  Null texts and texts without letters give no words; a document without an
    id is one with an empty id; repeated rows count as often as they are there; words
    of any length are walked whole.  Other columns are ignored; an empty table
    gives no rows.
    """
    words = cut(vocabulary(docs, id_col, text_col, min_length, min_count), "words")
    near = near_words(words, min_length)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(found, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.coalesce(F.col("form_n") >= F.lit(times) * F.col("n"), F.lit(False))
    rows = rows.select("word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"))
    rows = cut(rows, "forms")
    up = rows.where("form is not null").select("word", F.col("form").alias("root"))
    # each form occurs ``times`` as often as the word before it: a way of 2^r steps needs times^(2^r) occurrences
    most, reach = words.agg(F.max("n")).first()[0] or 1, 1
    while times**reach <= most:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = cut(up.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        reach *= 2
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
