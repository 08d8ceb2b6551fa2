"""Weights of terms in documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: bytes of text whose terms a task holds
PART = 8 << 20


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unfolded(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _terms(words: pa.ChunkedArray, excluded: list[str], buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms by bucket and then in order, the buckets' borders among them, and of each document the places of its terms with their counts.

    The same documents give the same terms, in whatever order they come.
    """
    lists = words.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    elements = lists.flatten() if sizes.sum() else pa.array([], pa.list_(pa.string()))
    inner = np.asarray(pc.fill_null(pc.list_value_length(elements), 0), np.int64)
    element = np.repeat(np.arange(len(inner)), inner)
    owner = np.repeat(np.arange(len(sizes)), sizes)[element]
    coded = (elements.flatten().cast(pa.string()) if inner.sum() else pa.array([], pa.string())).dictionary_encode()
    by = np.asarray(pc.sort_indices(coded.dictionary), np.int64)
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    names, at = coded.dictionary.take(pa.array(by)), place[np.asarray(coded.indices, np.int64)]
    # a word stands in the upper half of a number, and the word behind it in the lower one
    beside = np.flatnonzero(element[1:] == element[:-1])
    single = at + 1 << 32
    known, where = np.unique(np.concatenate([single, single[beside] + at[beside + 1] + 1]), return_inverse=True)
    first, second = (known >> 32) - 1, (known & 0xFFFFFFFF) - 1
    terms = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second, mask=second < 0)), " ", null_handling="skip")
    keep = np.asarray(pc.and_(pc.greater(pc.utf8_length(terms), 1), pc.invert(pc.is_in(terms, value_set=pa.array(excluded, pa.string())))))
    # terms that begin alike come to one bucket, where they take little room beside each other
    bucket = np.array([zlib.crc32(w.encode()) % buckets for w in names.to_pylist()], np.int64)[first]
    order = np.flatnonzero(keep)[np.argsort(bucket[keep], kind="stable")]
    code = np.full(len(known), -1)
    code[order] = np.arange(len(order))
    n = max(1, len(known))
    both, tf = np.unique(np.concatenate([owner, owner[beside]]) * n + where, return_counts=True)
    kept = code[both % n] >= 0
    return terms.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1)), (both // n)[kept], code[both % n][kept], tf[kept]


def _asked(excluded: list[str], buckets: int):
    """For each bucket the terms of a part, with the number of the part's documents that have them."""

    def run(rows: pa.Table) -> pa.Table:
        terms, cuts, _, code, _ = _terms(rows.column("words"), excluded, buckets)
        n = np.bincount(code, minlength=len(terms)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), terms), "\n")
        full = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "part": pa.array(np.full(len(full), rows.column("part")[0].as_py()), pa.int32()),
                "terms": pa.array([_squeezed(lines[k].as_buffer().to_pybytes()) for k in full], pa.binary()),
                "n": pa.array([_squeezed(n[cuts[k] : cuts[k + 1]].tobytes()) for k in full], pa.binary()),
            }
        )

    return run


def _told(rows: pa.Table) -> pa.Table:
    """For each part the number of documents that have its terms, in the order in which it asked."""
    lines = [pc.split_pattern(pa.array([_unfolded(b).decode()], pa.string()), "\n").values for b in rows.column("terms").to_pylist()]
    n = np.concatenate([np.frombuffer(_unfolded(b), np.int32) for b in rows.column("n").to_pylist()])
    at = np.asarray(pa.concat_arrays(lines).dictionary_encode().indices, np.int64)
    df = np.bincount(at, n).astype(np.int64)[at]
    ends = np.cumsum([len(x) for x in lines])
    return pa.table({"part": rows.column("part"), "bucket": rows.column("bucket"), "df": pa.array([_squeezed(x.tobytes()) for x in np.split(df, ends[:-1])], pa.binary())})


def _weighed(kind: pa.DataType, excluded: list[str], buckets: int, total: float, least: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows or not told.num_rows:
            return pa.table({"id": pa.array([], kind), "term": pa.array([], pa.string()), "w": pa.array([], pa.float64())})
        terms, _, doc, code, tf = _terms(rows.column("words"), excluded, buckets)
        df = np.concatenate([np.frombuffer(_unfolded(b), np.int64) for b in told.sort_by("bucket").column("df").to_pylist()])
        kept = df[code] >= least
        doc, code, tf = doc[kept], code[kept], tf[kept]
        w = (1 + np.log(tf)) * (np.log(total / df[code]) + 1)
        norm = np.sqrt(np.bincount(doc, w * w, rows.num_rows))
        return pa.table({"id": rows.column("id").take(pa.array(doc)), "term": terms.take(pa.array(code)), "w": pa.array(w / norm[doc])})

    return run


def tfidf(docs: DataFrame, excluded: list[str], least: int = 2, vocabulary: int = PART, words: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(id, term, w)`` of documents ``(id, words)``: (1 + ln tf) x idf, of length 1 in each document.

    ``words`` are lists of the words of elements, without blanks or line ends; terms are words, and pairs of
    words beside each other in an element, of two letters or more and not ``excluded``.
    Terms of fewer than ``least`` documents are dropped. Documents are dealt to parts of some ``vocabulary`` bytes. Each
    part asks once for each of its distinct terms, in sorted and compressed lists, and is told in how many documents they are; so what is
    shuffled is the documents, once, and less than that of terms. With ``words`` documents are ``(id, text)``, and their
    words are worked out in the parts.
    """
    last = docs.columns[1]
    made = (words or (lambda c: c))(F.col(last))
    size = F.octet_length(last) if words else F.octet_length(F.to_json(F.struct(last)))
    total, long = docs.agg(F.count("*"), F.sum(size)).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(total, max(-(-(long or 0) // max(1, vocabulary)), min(cores, total // 100))))
    dealt = docs.select("id", last, F.pmod(F.xxhash64("id", last), F.lit(parts)).cast("int").alias("part")).repartition(parts, "part")
    rows = dealt.select("part", "id", made.alias("words"))
    asked = rows.groupBy("part").applyInArrow(_asked(excluded, parts), "bucket int, part int, terms binary, n binary")
    told = asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_told, "part int, bucket int, df binary")
    kind = docs.schema["id"].dataType.simpleString()
    weighed = _weighed(to_arrow_type(docs.schema["id"].dataType), excluded, parts, float(max(1, total)), least)
    return rows.groupBy("part").cogroup(told.repartition(parts, "part").groupBy("part")).applyInArrow(weighed, f"id {kind}, term string, w double")
