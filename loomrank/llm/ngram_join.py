"""Exact self-join of documents on the Jaccard similarity of word n-gram sets.

Parity sketches.  Each shingle is hashed to one of k blocks and to a place in
that block; a block keeps, for every place, the parity of the shingles there.
Two sketches differ in at most as many places as their sets have elements apart
(shingles at one place cancel in pairs), so the Hamming distance bounds the
symmetric difference from below.  A block has 2**64 places, and of its parity
vector only the XOR of the hashes of its set places is kept: equal vectors have
equal digests.

Pigeonhole.  Sets of sizes a <= b with Jaccard >= t differ in at most
D = (a + b)(1 - t)/(1 + t) elements, so of k blocks at least k - D are equal.
Sizes fall into bands, each ``WIDE`` ratios 1/t wide: partners lie in one band or
in neighbouring ones, and a document joins in its own band and, if it is within a
ratio 1/t of the next, in that too.  Blocks are put in one order for all
documents, rare contents first; k is larger than D + 1, and the first D + 1 blocks
of two partners hold an equal one (two sets that share k - D of k elements do
so).  A passage that thousands of documents share fills the blocks at the end of
that order, which stay at home.  The order needs only be the same everywhere: a
block is as rare as its rarest shingle, counted over all documents in a table of
fixed size (``LOADS`` buckets).  Empty blocks are last.

Equal sets are one set: their digests link them, and only the smallest document
of each takes part in what follows.  Near copies share many blocks, often with
the same members; of blocks with equal member lists one stays.  Its candidates are not
paired off: each is checked against the block's smallest document, then against
members drawn by a hash while the block holds several classes; links give
classes.  Only pairs of documents that share a block and are in different classes
after that are checked one by one, so a group of copies of any size costs its
members, not its pairs.  Before texts are fetched, sizes and the Hamming distance
of folded sketches drop what cannot be similar; what is left is verified on the
whole shingle sets.

Hot blocks: an Arrow batch sends one row for each of its blocks, with the list of
the other members it saw (at most a batch of rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .common import cut, possibly_in, session_settings, within
from .graph import components
from .textops import U, mix

#: width of a size band in powers of 1/t
WIDE = 3
#: rounds of stars around drawn members before pairs are checked one by one
STAR_ROUNDS = 2
#: buckets in which shingles are counted to order blocks by rarity
LOADS = 1 << 16
_DIGESTS = "doc long, n long, xor long, sum long, bucket int, seen long"
_BLOCKS = "key long, doc long, more array<long>"


class Bands:
    """Size bands for a threshold t = num/den: ``lo[i] <= size < lo[i + 1]``, ``WIDE`` ratios 1/t each."""

    def __init__(self, num: int, den: int) -> None:
        self.t = Fraction(num, den)
        self.lo = [1]

    def of(self, size: int) -> int:
        while self.lo[-1] <= size:
            self.lo.append(max(self.lo[-1] + 1, -int(-(self.lo[-1] / self.t**WIDE) // 1)))
        return int(np.searchsorted(self.lo, size, "right")) - 1

    def _most(self, size: int, high: int) -> int:
        return int((size + high) * (1 - self.t) / (1 + self.t))

    def high(self, band: int) -> int:
        """The largest size in a band."""
        while len(self.lo) <= band + 1:
            self.of(self.lo[-1])
        return self.lo[band + 1] - 1

    def blocks(self, band: int) -> int:
        """Blocks of a band: half as many again as some partners may need."""
        need = self._most(self.high(band), self.high(band)) + 1
        return need + need // 2

    def joined(self, size: int) -> tuple[int, ...]:
        """The bands of a set's partners that are no smaller than itself, and its own."""
        own = self.of(size)
        return (own, own + 1) if size / self.t >= self.high(own) + 1 else (own,)

    def sent(self, size: int, band: int) -> int:
        """How many blocks, rarest first, a set of this size sends in a band."""
        return self._most(size, min(self.high(band), int(size / self.t))) + 1


def sketch_words(size: int, bands: Bands) -> int:
    """64-bit words of a set's folded sketch: 8 bits per possible difference, a power of two."""
    most = int(2 * size * (1 - bands.t) / (1 + bands.t)) + 1
    return max(1, 1 << max(0, (8 * most - 1).bit_length() - 6))


def fold(items: np.ndarray, n_words: int) -> np.ndarray:
    """Parity sketch of 64 * n_words places; its Hamming distances bound set differences."""
    place = mix(items ^ U(0x5EED)) % U(64 * n_words)
    odd = np.flatnonzero(np.bincount(place.astype(np.int64), minlength=64 * n_words) & 1)
    out = np.zeros(n_words, U)
    np.bitwise_or.at(out, odd // 64, U(1) << (odd % 64).astype(U))
    return out.view(np.int64)


def bucket(items: np.ndarray) -> np.ndarray:
    """Buckets of shingles in the table of counts."""
    return (mix(items ^ U(0x10AD)) % U(LOADS)).astype(np.int64)


def block_keys(items: np.ndarray, bands: Bands, loads: np.ndarray) -> np.ndarray:
    """Join keys of one set: the digests of the blocks it sends, in the bands it joins."""
    size, out = len(items), []
    load, value = loads[bucket(items)], mix(items ^ U(0xD16E57))
    for band in bands.joined(size):
        k, sent = bands.blocks(band), bands.sent(size, band)
        block = mix(items ^ U(0xB10C + band)) % U(k)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        where, digest = block[first], np.bitwise_xor.reduceat(value[order], first)
        key = mix(digest ^ mix(where * U(0x10001) + U(band << 40)))
        if len(key) > sent:
            key = key[np.lexsort((key, np.minimum.reduceat(load[order], first)))[:sent]]
        elif len(key) < sent:
            empty = mix(mix(np.setdiff1d(np.arange(k, dtype=U), where) * U(0x10001) + U(band << 40)))
            key = np.concatenate([key, np.sort(empty)[: sent - len(key)]])
        out.append(key)
    return np.concatenate(out)


def _digests(n: int):
    """Size and digests of every set, and how often each bucket of shingles was seen by the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LOADS, np.int64)
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            xor, total = np.zeros(batch.num_rows, U), np.zeros(batch.num_rows, U)
            for row, end, data, offsets in textops.slices(batch.column(1)):
                items, bounds = textops.shingle_sets(textops.words(data, offsets, fold=True), n)
                seen += np.bincount(bucket(items), minlength=LOADS)
                size[row:end] = np.diff(bounds)
                some = np.flatnonzero(size[row:end])
                if len(some):
                    xor[row + some] = np.bitwise_xor.reduceat(mix(items), bounds[some])
                    total[row + some] = np.add.reduceat(items, bounds[some])
            yield _rows(_DIGESTS, batch.column(0), pa.array(size), pa.array(xor.view(np.int64)), pa.array(total.view(np.int64)))
        used = np.flatnonzero(seen)
        yield _rows(_DIGESTS, *[pa.nulls(len(used), pa.int64())] * 4, pa.array(used.astype(np.int32)), pa.array(seen[used]))

    return run


def _rows(schema: str, *columns: pa.Array) -> pa.RecordBatch:
    """A batch by a schema string; columns that are not given are null."""
    fields = [f.split() for f in schema.split(", ")]
    empty = [pa.nulls(len(columns[0]), pa.int32() if kind == "int" else pa.int64()) for _, kind in fields[len(columns) :]]
    return pa.RecordBatch.from_arrays([*columns, *empty], names=[name for name, _ in fields])


def shingle_loads(counts: DataFrame) -> np.ndarray:
    """How often the shingles of each of ``LOADS`` buckets occur, over all texts, on a log scale.

    The driver gets the finished table, whose size does not depend on the input.
    """
    total = counts.groupBy("bucket").agg(F.sum("seen").alias("n")).toPandas()
    loads = np.zeros(LOADS, np.uint8)
    loads[total["bucket"]] = np.minimum(255, 6 * np.log2(1 + total["n"]))
    return loads


def _blocks(n: int, num: int, den: int, loads: np.ndarray):
    """One row per block of a batch: its key, its smallest document and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            keys, docs, known = [], [], {}
            for row, end, data, offsets in textops.slices(batch.column(1)):
                items, bounds = textops.shingle_sets(textops.words(data, offsets, fold=True), n)
                for d in range(row, end):
                    own = items[bounds[d - row] : bounds[d - row + 1]]
                    same = own.tobytes()
                    if not len(own) or known.get(same, ids[d]) < ids[d]:
                        continue  # nothing to join, or a copy: digests link it to the smaller document
                    known[same] = ids[d]
                    key = block_keys(own, bands, loads)
                    keys.append(key)
                    docs.append(np.full(len(key), ids[d]))
            if not keys:
                continue
            key, doc = np.concatenate(keys).view(np.int64), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            count = np.diff(np.append(np.flatnonzero(first), len(key)))
            more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count - 1)]).astype(np.int32)), pa.array(doc[~first]), mask=pa.array(count == 1))
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(doc[first]), more], names=["key", "doc", "more"])

    return run


def _sketches(n: int, num: int, den: int):
    """Texts with the sizes and folded sketches of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            sizes, folded = [], []
            for row, end, data, offsets in textops.slices(batch.column(1)):
                items, bounds = textops.shingle_sets(textops.words(data, offsets, fold=True), n)
                for d in range(end - row):
                    own = items[bounds[d] : bounds[d + 1]]
                    sizes.append(len(own))
                    folded.append(fold(own, sketch_words(len(own), bands)))
            info = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(folded, pa.list_(pa.int64()))], names=["n", "sketch"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), info], names=["doc", "text", "info"])

    return run


def _verify(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(texts):
            for _, _, data, offsets in textops.slices(texts):
                items, bounds = textops.shingle_sets(textops.words(data, offsets, fold=True), n)
                for d in range(len(bounds) - 1):
                    yield items[bounds[d] : bounds[d + 1]]

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(sets(batch.column(2)), sets(batch.column(3)), strict=True)):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = inter > 0 and den * inter >= num * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _possible(num: int, den: int, a: str, b: str) -> Column:
    """Sizes and sketches of two info structs allow similarity num/den (sketches of unequal length are not compared)."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    fits = (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (na > 0)
    return fits & ((F.size(F.col(f"{a}.sketch")) != F.size(F.col(f"{b}.sketch"))) | (apart * (den + num) <= (na + nb) * (den - num)))


def merge_classes(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(id, component_id)`` after further links ``(a, b)``: only classes that the links touch are joined anew."""
    if classes is None:
        return cut(components(links), "classes")
    of_a, of_b = classes.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), classes.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))
    between = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    new = cut(components(between), "joined")
    root = new.select(F.col("id").alias("component_id"), F.col("component_id").alias("root"))
    old = classes.join(root, "component_id", "left").select("id", F.coalesce("root", "component_id").alias("component_id"))
    return cut(old.unionByName(new.join(classes, "id", "left_anti")), "classes")


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row per row of ``docs``.

    Texts are lower-cased in A-Z and split at ``[\\x20\\x09-\\x0D]+``.  Two
    documents link when ``den * |A n B| >= num * |A u B|`` for their sets of
    distinct n-word shingles; ``component_id`` is the smallest id reachable by
    links.  A text of fewer than n words is one shingle; null, empty and blank
    texts have no shingles and link with nothing.  Rows with equal ids are one
    document, whose text is the greatest of theirs; a row with a null id keeps a
    null component.  Other columns are ignored, whatever their names.
    """
    session_settings(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ids = text.select("doc")
    null = F.lit(None).cast("long")
    blank = ids.where("doc is null").select(null.alias("doc_id"), null.alias("n_shingles"), null.alias("component_id"))
    text = text.where("doc is not null")
    repeated = not ids.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty()
    if repeated:
        text = cut(text.groupBy("doc").agg(F.max("text").alias("text")), "greatest")

    found = cut(text.mapInArrow(_digests(n), _DIGESTS), "digests")
    own = found.where("doc is not null").select("doc", "n", "xor", "sum")
    loads = shingle_loads(found.where("bucket is not null"))
    equal = own.where("n > 0").groupBy("n", "xor", "sum").agg(F.min("doc").alias("rep"), F.count("*").alias("m")).where("m > 1")
    copies = cut(own.join(equal, ["n", "xor", "sum"]).where("doc <> rep").select("doc", "rep"), "copies")

    # member lists are named by their size, smallest document and the XOR of all hashes
    group = Window.partitionBy("key")
    rows = text.mapInArrow(_blocks(n, num, den, loads), _BLOCKS)
    hashed = F.when(F.col("more").isNull(), F.xxhash64("doc")).otherwise(F.aggregate("more", F.xxhash64("doc"), lambda h, x: h.bitwiseXOR(F.xxhash64(x))))
    rows = rows.select("key", "doc", "more", F.sum(1 + F.coalesce(F.size("more"), F.lit(0))).over(group).alias("m"), F.bit_xor(hashed).over(group).alias("h"), F.min("doc").over(group).alias("low"))
    lists = rows.where("m > 1").select("m", "h", "low", "doc", "more").distinct()
    members = lists.select(F.xxhash64("m", "h", "low").alias("block"), F.explode(F.concat(F.array("doc"), F.coalesce("more", F.array().cast("array<long>")))).alias("doc"))
    members = cut(members.join(copies, "doc", "left").select("block", F.coalesce("rep", "doc").alias("doc")).distinct(), "members")

    wanted = cut(members.select("doc").distinct(), "wanted")
    texts = cut(within(text, "doc", wanted).mapInArrow(_sketches(n, num, den), "doc long, text string, info struct<n:long,sketch:array<long>>"), "texts")
    one, two = (texts.select(F.col("doc").alias(x), F.col("info").alias(f"i{x}")) for x in "ab")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs that link: sizes and sketches first, then whole sets."""
        near = cut(pairs.join(one, "a").join(two, "b").where(_possible(num, den, "ia", "ib")).select("a", "b"), f"near-{name}")
        ids = near.select(F.explode(F.array("a", "b")).alias("doc"))
        some = possibly_in(texts.select("doc", "text"), "doc", ids).where("possibly")  # the rest need not be shuffled
        left, right = (some.select(F.col("doc").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        return cut(near.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(n, num, den), "a long, b long"), name)

    low = members.groupBy("block").agg(F.min("doc").alias("low"))
    stars = members.join(low, "block").where("doc <> low").select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct()
    tried = cut(stars, "stars")
    classes = merge_classes(None, similar(tried, "links"))

    def still_open() -> DataFrame:
        """Members of blocks whose documents are in several classes so far, two beside the first at least."""
        known = members.join(classes, F.col("doc") == F.col("id"), "left").select("block", "doc", F.coalesce("component_id", "doc").alias("c"))
        keys = known.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("block")
        return cut(known.join(keys, "block"), "open")

    # further stars around members drawn by a hash join most of what the first
    # left apart, so that few pairs are left to check one by one
    for draw in range(STAR_ROUNDS):
        now = still_open()
        hub = now.groupBy("block").agg(F.min_by(F.struct("doc", "c"), F.xxhash64("block", "doc", F.lit(draw))).alias("h"))
        pairs = now.join(hub, "block").where("c <> h.c").select(F.greatest("doc", "h.doc").alias("a"), F.least("doc", "h.doc").alias("b")).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        more = similar(pairs, "more")
        if not more.isEmpty():
            classes = merge_classes(classes, more)

    # what is left: every pair that shares a block and is in different classes.  One
    # of the two is outside the block's largest class, so that class is on one side only
    now = still_open()
    main = now.groupBy("block", "c").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("c", F.struct("n", "c")).alias("m"))
    sides = now.join(main, "block").withColumn("main", F.col("c") == F.col("m")).drop("m").join(texts.select("doc", "info"), "doc")
    x, y = (sides.select(*(F.col(c).alias(f"{p}{c}") for c in ("block", "doc", "c", "main", "info"))) for p in "xy")
    once = F.col("ymain") | (F.col("xdoc") > F.col("ydoc"))
    rest = x.where("not xmain").join(y, (F.col("xblock") == F.col("yblock")) & once & (F.col("xc") != F.col("yc")) & _possible(num, den, "xinfo", "yinfo"))
    rest = cut(rest.select(F.greatest("xdoc", "ydoc").alias("a"), F.least("xdoc", "ydoc").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        classes = merge_classes(classes, similar(rest, "last"))

    placed = own.join(copies, "doc", "left").withColumn("rep", F.coalesce("rep", "doc"))
    out = placed.join(classes, F.col("rep") == F.col("id"), "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
    if repeated:
        out = ids.where("doc is not null").withColumnRenamed("doc", "doc_id").join(out, "doc_id")
    return out.unionByName(blank)
