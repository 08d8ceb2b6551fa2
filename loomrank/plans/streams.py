"""Streaming (X1, X2): the tables are split into shard files and taken in as a stream."""

from __future__ import annotations

from ..sources.files import scratch
from ..streaming.intake import intake, latest, tally
from .base import query

SCHEMA = "event_id long, user_id long, event_type string, value double"


def _shards(t) -> str:
    path = scratch(t.spark, "shards")
    t.events.select("event_id", "user_id", "event_type", "value").repartition(6).write.parquet(path)
    return path


@query("x1_shard_intake", "SELECT event_id, user_id, event_type, value FROM events")
def x1(t):
    source, out = _shards(t), scratch(t.spark, "table")
    intake(t.spark, source, SCHEMA, ["event_id"], out, f"{out}-state")
    return t.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(out)


@query("x2_live_tally", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def x2(t):
    source, out = _shards(t), scratch(t.spark, "tally")
    tally(t.spark, source, SCHEMA, "event_type", out, f"{out}-state")
    return latest(t.spark, out)
