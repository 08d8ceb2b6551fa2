"""Structured Streaming: shard intake and a live tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import cut


#: parts of the table of keys, by a hash of the key
PARTS = 64
#: bits of the filter over keys seen; it is read and written with every batch, whatever the table's size
FILTER_BITS = 1 << 23
#: bits that each key sets
PROBES = 3


def _places(keys: list[str]) -> Column:
    """The filter words a key sets bits in, with the bits of each."""
    at = [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(FILTER_BITS)) for i in range(PROBES)]
    return F.array(*[F.struct(F.floor(a / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(a, F.lit(64)).cast("int")).alias("bit")) for a in at])


def intake(spark: SparkSession, source: str, schema: str, keys: list[str], out: str, checkpoint: str, report: list | None = None) -> None:
    """Append new shard files to ``out`` (in ``batch=N`` folders); a key that is already there is skipped.

    Beside it lie the keys alone, in parts by hash (``out-keys``), and a filter of fixed
    size over them (``out-filter``). A batch reads the filter; only keys it may have
    seen are looked up, and only in their parts. No state grows in the executors. A
    restart with the same ``checkpoint`` goes on where it was; a repeated batch
    replaces itself. Missing parts of a key are equal to each other. ``report`` takes
    ``(batch, keys looked up, parts read)``.
    """
    shards = spark.readStream.schema(schema).parquet(source)
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int").alias("part")

    def add(batch: DataFrame, number: int) -> None:
        new = cut(batch.dropDuplicates(keys).select("*", part))
        words = "word long, bits long"
        # version N holds the keys of batches 0 to N; a repeated batch N starts from version N - 1 again
        old = spark.read.schema(words).parquet(f"{out}-filter/version={number - 1}") if number else spark.createDataFrame([], words)
        bits = new.select(*keys, F.explode(_places(keys)).alias("at")).select(*keys, "at.*")
        if number:
            met = bits.join(old, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
            maybe = cut(met.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") == PROBES).select(*keys, part))
            parts = [r["part"] for r in maybe.select("part").distinct().collect()]
            if parts:
                kinds = new.select(*keys).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
                known = spark.read.schema(f"{kinds}, part int, batch long").option("basePath", f"{out}-keys").parquet(f"{out}-keys")
                known = known.where(F.col("part").isin(parts) & (F.col("batch") < number))
                seen = maybe.alias("m").join(known.alias("k"), [F.col("m.part") == F.col("k.part"), *[F.col(f"m.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]], "left_semi")
                seen = cut(seen.select(*keys))
                new = new.join(seen, [new[k].eqNullSafe(seen[k]) for k in keys], "left_anti")
            if report is not None:
                report.append((number, maybe.count(), len(parts)))
        new.drop("part").write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.select(*keys, "part", F.lit(number).cast("long").alias("batch")).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{out}-keys")
        all_ = old.unionByName(bits.select("word", F.col("bit").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        all_.write.mode("overwrite").parquet(f"{out}-filter/version={number}")

    query = shards.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def tally(spark: SparkSession, source: str, schema: str, status: str, out: str, checkpoint: str) -> None:
    """Counts by status so far, a new ``version=N`` folder with every batch: a reader never sees one that is half written.

    :func:`latest` reads the newest.
    """
    counts = spark.readStream.schema(schema).parquet(source).groupBy(status).agg(F.count("*").alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={number}")

    query = counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest tally in ``out``."""
    all_ = spark.read.option("basePath", out).parquet(out)
    return all_.join(all_.agg(F.max("version").alias("version")), "version", "left_semi").drop("version")
