"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of labelled texts,
a bounded sample drawn over all labelled documents by a hash of their id.  Of a
text longer than a quarter of a dictionary a slice from inside is taken.  Every
language has a dictionary; many languages have smaller ones.
Letters are lower-cased and runs of anything else become one space, in texts and
dictionaries alike.  A text is compressed with every dictionary, in pieces of ``PIECE`` bytes, so that
the dictionary speaks to every part of it and not the text before, and the language with
the smallest total wins.  The margin is the share by which the runner-up is larger; texts with
a margin below ``min_margin`` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import widen
from .common import session_settings, unit_hash

#: bytes of each dictionary, sampled rows of each language
DICT_BYTES, SAMPLE_ROWS = 128 << 10, 400
#: bytes of all dictionaries together, and of one however many there are
TOTAL_BYTES, LEAST_BYTES = 64 * DICT_BYTES, 512
PIECE, LEVEL = 64, 3
MIN_MARGIN = 0.001
_ASCII = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Letters in lower case, ASCII clutter between them one space: case and clutter tell no language.

    Empty for a text without any letter.
    """
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_ASCII).split())
    return raw if any(c.isalpha() for c in text) else b""


def held_out(id_col: str = "doc_id") -> Column:
    """One document in five: crc32 of the id as text is divisible by 5; never one without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionaries by language, commonest language first, from rows with a text and a language.

    Counts cover all rows; texts are read only of the sampled ones, and of all
    rows of a language whose sample has no letters.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").collect()}
    if not counts:
        return {}
    size = max(min(dict_bytes, LEAST_BYTES), min(dict_bytes, TOTAL_BYTES // len(counts)))
    found = _content(rows, {lang: min(1.0, 3 * sample_rows / n) for lang, n in counts.items()}, size, sample_rows)
    missing = {lang: 1.0 for lang in counts if lang not in found}
    if missing:
        found |= _content(rows, missing, size, sample_rows)
    return {lang: found[lang] for lang in counts if lang in found}


def _content(rows: DataFrame, share: dict[str, float], size: int, sample_rows: int) -> dict[str, bytes]:
    """``size`` bytes at most of each language of ``share``, from rows drawn with that share."""
    most = size // 4  # a text beyond a quarter of a dictionary would fill it with one voice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, draw in zip(batch.column(3), batch.column(2).to_pylist(), strict=True):
                raw = plain(t.as_py())
                # the draws are the lowest of a language: their last digits say where to begin
                at = int(draw * 1e6 % 1 * (len(raw) - most)) if len(raw) > most else 0
                out.append(raw[at : at + most])
            new = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.binary())], names=["l", "id", "draw", "raw"])
            yield new.filter(pa.array([bool(r) for r in out], pa.bool_()))

    shares = rows.sparkSession.createDataFrame(list(share.items()), "l string, share double")
    kind = rows.schema["id"].dataType.simpleString()
    some = rows.where(F.expr("length(t) > 0")).withColumn("draw", unit_hash(F.col("id"), F.lit(9)))
    some = some.join(F.broadcast(shares), "l").where("draw < share or share = 1").select("l", "id", "draw", "t")
    some = some.mapInArrow(run, f"l string, id {kind}, draw double, raw binary")
    first = Window.partitionBy("l").orderBy("draw", "id", "raw")
    some = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_rows)
    some = some.withColumn("before", F.sum(F.length("raw") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1)))
    texts: dict[str, list[bytes]] = {}
    for r in some.where(F.coalesce("before", F.lit(0)) < size).orderBy("l", "r").select("l", "raw").collect():
        texts.setdefault(r["l"], []).append(bytes(r["raw"]))
    content = {lang: b"\n".join(t)[:size] for lang, t in texts.items()}
    return {lang: raw for lang, raw in content.items() if len(raw) >= 8}


class Classifier:
    def __init__(self, content: dict[str, bytes]) -> None:
        self.langs = list(content)
        self.tools = []
        for raw in content.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """``(language, margin)``; ``und`` and 0 for a text that is null or has no letter."""
        raw = plain(text) if text and self.langs else b""
        if not raw:
            return "und", 0.0
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = [sum(len(t.compress(p)) for p in pieces) for t in self.tools]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], (second - sizes[best]) / second


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``(id_col, lang_pred, score, accepted)``, one row per row of ``docs``.

    ``score`` is the margin, from 0 to 1; ties go to the language that is
    commoner in training.  Null texts and texts without a letter are ``und``
    with score 0 and rejected.  Repeated rows are judged alike, each for itself; null
    ids stay null.  Other columns are ignored; an empty table gives no rows.  A table in
    fewer partitions than there are cores is dealt to all of them.
    """
    session_settings(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(content)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(1)]
            lang, score = [f[0] for f in found], [f[1] for f in found]
            ok = [p != "und" and s >= min_margin for p, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=[id_col, "lang_pred", "score", "accepted"])

    return widen(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Rows of ``docs`` whose text has a language by a clear margin, all columns as they were."""
    session_settings(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(content)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([p != "und" and s >= min_margin for p, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
