"""A relation feed kept current by a stream: each micro-batch is merged into the latest state, which Spark holds by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import feed


def latest_stream(raw: DataFrame, position: str = "position") -> DataFrame:
    """The last record of each identity over a stream of raw records (raw, position); use output mode update or complete."""
    relations = feed.decoded_relations(raw)
    return relations.groupBy(*feed.IDENTITY).agg(F.max_by("raw", F.struct("generation", position)).alias("raw"), F.max("generation").alias("generation"))


def to_memory(raw: DataFrame, name: str) -> StreamingQuery:
    return latest_stream(raw).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
