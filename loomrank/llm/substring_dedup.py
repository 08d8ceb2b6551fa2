"""Removal of repeated passages of words by recompression.

1. Recompression rounds (:mod:`.recompress`) name word pairs and pairs of pairs
   the same way in every document.  Every window of ``size`` words is stood for
   by the longest phrase whose evidence it holds, so documents that share a
   window share that phrase's name.  A run of windows with one name is reported
   once.
2. A shuffle on names finds those that more than one document has.
3. Only windows under shared names are candidates: their exact contents are
   compared (a 64-bit name of all ``size`` words), and the smallest document of
   each window is found.
4. Words covered by a window that a smaller document has are removed.

Hot passages: each Arrow batch first settles what it can see alone.  If several
documents of a batch share a name or window, only the batch's smallest document
goes on to the global comparison; the rest are settled and spread by document.
A passage of every third document thus sends one row per batch, not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import recompress, textops
from .common import possibly_in, session_settings
from .textops import U

WINDOW = 13
_SPREAD = 1021


def _rows(key, doc, at, *more) -> tuple[np.ndarray, ...]:
    """Rows ``(key, doc, at, salt, *more)``: salt 0 takes part in the global comparison.

    Within the batch, rows of documents above a key's smallest are settled
    (salt > 0); the smallest document's rows go on.
    """
    order = np.lexsort((at, doc, key))
    key, doc, at = key[order], doc[order], at[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    lowest = np.repeat(doc[first], np.diff(np.append(np.flatnonzero(first), len(key))))
    salt = np.where(doc > lowest, 1 + doc % _SPREAD, 0).astype(np.int32)
    return key, doc, at, salt, *[m[order] for m in more]


def _batch(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _name_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            keys, docs = [], []
            for row, _, data, offsets in textops.slices(batch.column(1)):
                w = textops.words(data, offsets)
                doc = w.doc_of_word()
                starts, key = recompress.window_keys(w.names, doc, size)
                if not len(key):
                    continue
                own = doc[starts]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                keys.append(key[new])
                docs.append(ids[row + own[new]])
            if not keys:
                continue
            key, doc = np.concatenate(keys).view(np.int64), np.concatenate(docs)
            key, doc, _, salt = _rows(key, doc, np.zeros(len(key), np.int8))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc, salt = key[fresh], doc[fresh], salt[fresh]
            # the smallest document of a name seen in several is settled as well,
            # by a row of its own beside the one that stands for the batch
            more = np.zeros(len(key), bool)
            more[:-1] = (salt[:-1] == 0) & (key[1:] == key[:-1])
            key, doc = np.concatenate([key, key[more]]), np.concatenate([doc, doc[more]])
            salt = np.concatenate([salt, (1 + doc[len(salt) :] % _SPREAD).astype(np.int32)])
            yield _batch(["key", "doc", "salt"], [key, doc, salt])

    return run


def _window_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(3)))
            ids, copies, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            shared_all = np.asarray(lists.flatten())
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            keys, docs, ats, versions = [], [], [], []
            for row, end, data, offsets in textops.slices(batch.column(2)):
                w = textops.words(data, offsets)
                doc = w.doc_of_word()
                starts, key = recompress.window_keys(w.names, doc, size)
                if not len(key):
                    continue
                own, key = doc[starts], key.view(np.int64)
                # is (document, name) in the list of shared names? compared as one number per pair
                have = textops.mix(shared_all[bounds[row] : bounds[end]].view(U) ^ textops.mix(np.repeat(np.arange(end - row), np.diff(bounds[row : end + 1])).astype(U)))
                pick = np.isin(textops.mix(key.view(U) ^ textops.mix(own.astype(U))), have)
                grams = textops.ngrams(w.names, size)
                keys.append(grams[starts[pick]].view(np.int64))
                docs.append(ids[row + own[pick]])
                versions.append(copies[row + own[pick]])
                ats.append((starts[pick] - w.first[own[pick]]).astype(np.int32))
            if keys:
                key, doc, at, salt, copy = _rows(np.concatenate(keys), np.concatenate(docs), np.concatenate(ats), np.concatenate(versions))
                yield _batch(["key", "doc", "copy", "at", "salt"], [key, doc, copy, at, salt])

    return run


def _finish(size: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            flat = np.asarray(lists.flatten())
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            total, gone, digests, texts = [], [], [], []
            for row, end, data, offsets in textops.slices(batch.column(1)):
                w = textops.words(data, offsets)
                raw = data.tobytes()
                for d in range(end - row):
                    lo, hi = w.first[d], w.first[d + 1]
                    at = flat[bounds[row + d] : bounds[row + d + 1]]
                    if len(at):
                        edge = np.zeros(hi - lo + size + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + size, -1)
                        left = np.flatnonzero(np.cumsum(edge)[: hi - lo] == 0)
                    else:
                        left = np.arange(hi - lo)
                    text = b" ".join([raw[s:e] for s, e in zip(w.starts[lo + left].tolist(), w.ends[lo + left].tolist(), strict=True)])
                    total.append(hi - lo)
                    gone.append(hi - lo - len(left))
                    digests.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        texts.append(text.decode("utf-8", "replace"))
            out = [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                out, names = [*out, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def substring_dedup(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept_text])``, one row per row of ``docs``.

    Null or empty text: no words, nothing removed, digest of the empty string.
    Texts shorter than ``size`` words are never cut.  Repeats inside one document
    stay.  Other columns are ignored, whatever their names.  ``id_col`` is a
    long.  Rows of one id are texts of their own: each loses what a smaller id has, and
    nothing to each other.  Rows with a null id are kept unchanged and compared with none.
    """
    session_settings(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # texts of repeated ids are told apart by their hash; of all others it is 0 and costs nothing where it is shuffled
    again = text.where("doc is not null").groupBy("doc").count().where("count > 1").select("doc")
    text = possibly_in(text, "doc", again, "again").select("doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("copy"), "text")
    names = text.where("doc is not null").select("doc", "text").mapInArrow(_name_rows(size), "key long, doc long, salt int")
    group = Window.partitionBy("key", "salt")
    shared = names.withColumn("lo", F.min("doc").over(group)).withColumn("hi", F.max("doc").over(group)).where("salt > 0 or lo < hi")
    by_doc = shared.groupBy("doc").agg(F.collect_set("key").alias("keys"))
    # documents without shared names are dropped inside: a filter here would give
    # this join another scan, and the shuffle of the texts serves both joins
    windows = text.join(by_doc, "doc", "left").select("doc", "copy", "text", "keys").mapInArrow(_window_rows(size), "key long, doc long, copy long, at int, salt int")
    later = windows.withColumn("lo", F.min("doc").over(group)).where("salt > 0 or lo < doc")
    cover = later.groupBy("doc").agg(F.collect_list(F.struct("copy", "at")).alias("at"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    own = F.transform(F.filter("at", lambda x: x["copy"] == F.col("copy")), lambda x: x["at"])
    return text.join(cover, "doc", "left").select("doc", "text", own.alias("at")).mapInArrow(_finish(size, keep_text), schema)
