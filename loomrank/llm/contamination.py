"""Benchmark decontamination by Wu-Manber search on words.

Windows of ten words of every benchmark item are the patterns, words the symbols.
A table of two-word blocks says how far the search may jump: a block that no
window holds lets it skip nine words.  Where a block ends some window, the hashes
of the last and the first block name a bucket, and the windows in it are compared
byte by byte.  Texts are searched many stretches at a time in numpy.

The patterns go to tasks in parts of about ``PART_BYTES``; a benchmark of several
parts is searched part by part, and what a document has got travels with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import cut, session_settings
from .textops import U, Words

WINDOW = 10
#: what a word may not hold, after A-Z were lower-cased
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: windows that begin in one piece of an item
PIECE = 512
#: about so many bytes of items are searched at once
PART_BYTES = 8 << 20
#: positions that one cursor goes through
LANE = 128
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each run, one after the other."""
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begin, sizes)


def _plain_bytes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words, each with a blank behind it, and the offsets of words."""
    sizes = w.ends - w.starts
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(first[-1]), 0x20, np.uint8)
    raw = w.data[_runs(w.starts, sizes)]
    out[_runs(first[:-1], sizes)] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    return out, first


def _blocks(names: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the blocks of one or two words that end at ``ends``."""
    found = names[ends] * _A
    if size > 1:
        found = found + names[ends - 1] * _B
    return textops.mix(found)


class WuManber:
    """Patterns of one length: shift table, buckets, and the words of the patterns."""

    def __init__(self, w: Words, starts: np.ndarray, length: int) -> None:
        self.length, self.block = length, min(2, length)
        names = textops.ngrams(w.names, length)[starts]
        _, rep, self.pattern_of = np.unique(names, return_index=True, return_inverse=True)
        at = starts[rep]
        inside = np.arange(self.block - 1, length)
        blocks = _blocks(w.names, (at[:, None] + inside).ravel(), self.block)
        bits = max(12, int(np.ceil(np.log2(8 * max(1, len(np.unique(blocks)))))))
        self.mask = U((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, np.int64)
        np.minimum.at(self.shift, (blocks & self.mask).astype(np.int64), np.tile(length - 1 - inside, len(at)))
        keys = self._keys(w.names, at + length - 1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order
        self.bytes, first = _plain_bytes(w)
        self.begin, self.end = first[at], first[at + length]

    def _keys(self, names: np.ndarray, ends: np.ndarray) -> np.ndarray:
        last, first = _blocks(names, ends, self.block), _blocks(names, ends - self.length + self.block, self.block)
        return textops.mix(last * _A + first)

    def occurrences(self, w: Words, plain: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index of the last word, pattern)`` of every occurrence in a slice of documents."""
        n, length = len(w.names), self.length
        at = np.arange(length - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        ends = []
        while len(at):
            jump = self.shift[(_blocks(w.names, at, self.block) & self.mask).astype(np.int64)]
            ends.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        end = end[doc[end] == doc[end - length + 1]]
        keys = self._keys(w.names, end)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        end, low, size = end[high > low], low[high > low], (high - low)[high > low]
        found_end, found_pattern = [], []
        for i in range(0, len(end), 1 << 14):  # so many positions are compared at once
            some = slice(i, i + (1 << 14))
            e, p = np.repeat(end[some], size[some]), self.order[_runs(low[some], size[some])]
            start, span = first[e - length + 1], self.end[p] - self.begin[p]
            same = first[e + 1] - start == span
            e, p, start, span = e[same], p[same], start[same], span[same]
            if len(e):
                differ = plain[_runs(start, span)] != self.bytes[_runs(self.begin[p], span)]
                same = np.add.reduceat(differ, np.cumsum(span) - span, dtype=np.int64) == 0
                found_end.append(e[same])
                found_pattern.append(p[same])
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *found_end]), np.concatenate([empty, *found_pattern])


class Patterns:
    """The windows of some pieces of items, by length, and the items that hold them."""

    def __init__(self, items: list, pieces: list[str], window: int) -> None:
        self.items = sorted({str(i) for i in items if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        item = np.array([-1 if i is None else number[str(i)] for i in items], np.int64)
        self.searches: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        for _, _, data, offsets in textops.slices(pa.array(pieces, pa.string()), 1 << 40):
            w = textops.words(data, offsets, fold=True, outside="marks")
            counts = w.counts
            lengths = np.minimum(counts, window)
            for length in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == length)
                n = counts[rows] - length + 1
                search = WuManber(w, _runs(w.first[rows], n), int(length))
                pairs = np.unique(np.stack([search.pattern_of, np.repeat(item[rows], n)], 1), axis=0)
                pairs = pairs[pairs[:, 1] >= 0]
                at = np.searchsorted(pairs[:, 0], np.arange(search.pattern_of.max() + 2))
                self.searches.append((search, at, pairs[:, 1]))

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hit words as flags, documents, items)``: the last two are the distinct pairs, ordered."""
        steps = np.zeros(len(w.names) + 1, np.int64)
        plain, first = _plain_bytes(w)
        doc = w.doc_of_word()
        pairs = [np.zeros((0, 2), np.int64)]
        for search, at, items in self.searches:
            end, pattern = search.occurrences(w, plain, first, doc)
            np.add.at(steps, end - search.length + 1, 1)
            np.add.at(steps, end + 1, -1)
            met = np.unique(np.stack([doc[end], pattern], 1), axis=0)
            size = at[met[:, 1] + 1] - at[met[:, 1]]
            pairs.append(np.stack([np.repeat(met[:, 0], size), items[_runs(at[met[:, 1]], size)]], 1))
        both = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(steps)[:-1] > 0, both[:, 0], both[:, 1]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, piece, bytes)``: stretches of items that overlap by a window less one word, so that each window is in one."""
    plain = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = benchmark.select(F.col(item_col).alias("item"), F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.lit(0), F.floor((F.size("w") - window) / PIECE))
    cut_ = w.select("item", "w", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k"))
    text = F.array_join(F.slice("w", (F.col("k") * PIECE + 1).cast("int"), F.lit(PIECE + window - 1)), " ")
    return cut_.select("item", text.alias("piece")).withColumn("bytes", F.octet_length("piece").cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an
    item, or of all its words if it has fewer.  Null and empty texts have no words;
    rows of the benchmark with equal ids are one item, each text with its own
    windows; a row without an id hits words but is no item that is counted.
    Repeated documents and null ids are judged each for itself.  Other columns of
    either table are ignored; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    session_settings(spark)
    pieces = cut(_pieces(benchmark, item_col, f"{text_col}", window), "pieces")
    total = pieces.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    kept = f"`{id_col}` {kind}, {{}}n_words long, spans binary, items array<string>"
    out = docs.select(F.col(id_col), F.col(text_col), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("spans"), F.array().cast("array<string>").alias("items"))
    out = out.toDF(id_col, "_text", "n_words", "spans", "items")
    for part in range(parts):
        rows = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(parts)) == part).select("item", "piece").collect()
        patterns = spark.sparkContext.broadcast(Patterns([r["item"] for r in rows], [r["piece"] for r in rows], window))
        out = out.mapInArrow(_searched(patterns, id_col, keep_text=part + 1 < parts), kept.format("_text string, " if part + 1 < parts else ""))
        if part + 1 < parts:
            out = cut(out, f"part{part}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            hit = [0 if s is None else int(np.diff(np.frombuffer(s, np.int64).reshape(-1, 2), axis=1).sum()) for s in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            digests = [hashlib.sha256(",".join(i).encode()).hexdigest() if i else nothing for i in items]
            cols = [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return out.mapInArrow(finish, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _searched(shared, id_col: str, keep_text: bool):
    """Adds what one part of the patterns finds: spans of hit words as ``[begin, end)`` pairs, and items in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Patterns = shared.value
        for batch in batches:
            for row, end, data, offsets in textops.slices(batch.column(1)):
                w = textops.words(data, offsets, fold=True, outside="marks")
                hit, doc, item = patterns.search(w)
                own = np.searchsorted(doc, np.arange(end - row + 1))
                spans, items = batch.column(3)[row:end].to_pylist(), batch.column(4)[row:end].to_pylist()
                any_hit = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[w.first]))
                for d in any_hit:
                    mine = hit[w.first[d] : w.first[d + 1]].copy()
                    if spans[d] is not None:
                        for b, e in np.frombuffer(spans[d], np.int64).reshape(-1, 2):
                            mine[b:e] = True
                    spans[d] = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]))).astype(np.int64).tobytes()
                    met = {patterns.items[i] for i in item[own[d] : own[d + 1]]}
                    items[d] = sorted(met.union(items[d]))
                text = [batch.column(1).slice(row, end - row)] if keep_text else []
                cols = [batch.column(0).slice(row, end - row), *text, pa.array(w.counts.astype(np.int64)), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *(["_text"] if keep_text else []), "n_words", "spans", "items"])

    return run
