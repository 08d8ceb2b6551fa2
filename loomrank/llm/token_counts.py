"""Token counts kept up to date by signed deltas.

A batch of changes (insert, delete, revise) is committed as one folder of signed
sums by (source, lang, tokenizer version).  Totals are the sum of all deltas, so
no change ever reads old documents: a revision carries the text it replaces.

What counts is said by a manifest, a small numbered file: the folder of each
batch, the folder of the compacted rest, and the ids folded into it.  A batch is
written to a folder of its own and becomes visible when the next manifest is put
in place, which fails if another writer was first and is then done again.  So a
batch that is sent again replaces itself, a writer that dies leaves the state as it
was, and readers see one state.  Folders that no manifest names stay until
``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .mixing import word_count

KEYS = ("source", "lang", "tokenizer")
VERSIONS: Mapping[str, Callable[[Column], Column]] = {
    "words-1": word_count,
    "chars-1": lambda text: F.coalesce(F.length(text), F.lit(0)).cast("long"),
}


class TokenRollup:
    """Totals of documents and tokens under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, versions: Mapping[str, Callable[[Column], Column]] = VERSIONS) -> None:
        self.spark, self.path, self.versions = spark, path or f"{shared_dir(spark)}/rollup", versions

    def deltas(self, changes: DataFrame, text_col: str = "text", old_col: str | None = None, op_col: str | None = None) -> DataFrame:
        """Signed sums of changes.

        ``op_col`` holds ``insert`` (also null), ``delete`` or ``revise``; a
        revision takes the counts of ``old_col`` away and adds those of
        ``text_col``.  Null texts are documents of no tokens; null sources and
        languages are groups of their own.  An unknown operation is an error.
        Repeated rows count as often as they come; other columns are ignored; no
        changes give no sums.
        """
        op = F.coalesce(F.col(op_col), F.lit("insert")) if op_col else F.lit("insert")
        known = op.isin("insert", "delete", "revise")
        sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), op)).cast("int"))
        counted = []
        for name, count in self.versions.items():
            new = count(F.col(text_col))
            old = count(F.col(old_col)) if old_col else F.lit(0).cast("long")
            tokens = F.when(op == "revise", new - old).when(known, sign * new).otherwise(sign)
            counted.append(F.struct(F.lit(name).alias("tokenizer"), tokens.alias("tokens")))
        rows = changes.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), sign.cast("long").alias("docs"), F.explode(F.array(*counted)).alias("c"))
        return rows.groupBy("source", "lang", F.col("c.tokenizer").alias("tokenizer")).agg(F.sum("docs").alias("d_docs"), F.sum("c.tokens").alias("d_tokens"))

    def commit(self, batch_id: int, changes: DataFrame, **how) -> None:
        """Write a batch; the same batch again replaces itself. Batches that were compacted are left as they are."""
        if batch_id in self._state()[1]["folded"]:
            return
        name = self._write(self.deltas(changes, **how))

        def with_batch(state: dict) -> dict:
            return state if batch_id in state["folded"] else state | {"batches": state["batches"] | {str(batch_id): name}}

        self._publish(with_batch)

    def _write(self, sums: DataFrame) -> str:
        name = f"delta-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{name}")
        return name

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/manifests")
        return hadoop, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict]:
        """Number and content of the latest manifest; 0 and an empty one if there is none."""
        hadoop, folder, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        last = max((int(n[1:]) for n in names if n[:1] == "m" and n[1:].isdigit()), default=0)
        if not last:
            return 0, {"batches": {}, "base": None, "folded": []}
        return last, json.loads(self.spark.read.text(f"{self.path}/manifests/m{last:08}").first()[0])

    def _publish(self, change: Callable[[dict], dict]) -> None:
        """Put the next manifest in place; when another writer has taken its number, apply the change to that one's."""
        hadoop, folder, fs = self._fs()
        context = hadoop.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        while True:
            last, state = self._state()
            draft, final = hadoop.Path(folder, f".draft-{uuid.uuid4().hex}"), hadoop.Path(folder, f"m{last + 1:08}")
            out = fs.create(draft)
            out.write(bytearray(json.dumps(change(state)), "utf-8"))
            out.close()
            try:
                context.rename(draft, final, self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
                return
            except Exception:
                fs.delete(draft, False)
                if not fs.exists(final):
                    raise

    def _read(self) -> DataFrame:
        state = self._state()[1]
        live = [f"{self.path}/{d}" for d in (*state["batches"].values(), state["base"]) if d]
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        return self.spark.read.schema(schema).parquet(*live) if live else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)``; groups with neither are left out."""
        out = self._read().groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """One delta of all committed batches, which are then refused; batches committed meanwhile stay."""
        seen = self._state()[1]
        if not seen["batches"]:
            return
        base = self._write(self._sums(seen))

        def folded(state: dict) -> dict:
            if any(state["batches"].get(k) != v for k, v in seen["batches"].items()) or state["base"] != seen["base"]:
                raise RuntimeError("a compacted batch was replaced meanwhile; compact again")
            rest = {k: v for k, v in state["batches"].items() if k not in seen["batches"]}
            return {"batches": rest, "base": base, "folded": sorted({*state["folded"], *map(int, seen["batches"])})}

        self._publish(folded)

    def _sums(self, state: dict) -> DataFrame:
        live = [f"{self.path}/{d}" for d in (*state["batches"].values(), state["base"]) if d]
        rows = self.spark.read.schema("source string, lang string, tokenizer string, d_docs long, d_tokens long").parquet(*live)
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def vacuum(self) -> int:
        """Delete delta folders and manifests that are not of the latest state; how many folders went. No writer may be at work."""
        hadoop, folder, fs = self._fs()
        last, state = self._state()
        live = {*state["batches"].values(), state["base"]}
        old = [s.getPath() for s in fs.listStatus(hadoop.Path(self.path)) if s.getPath().getName().startswith("delta-") and s.getPath().getName() not in live]
        for path in [*old, *(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() != f"m{last:08}")]:
            fs.delete(path, True)
        return len(old)
