"""Incremental scoring of a stream of sentences: each distinct sentence is scored and cached once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.text import text_hash
from ledgerloom.operators.scoring import append_cache, lexicon_tone


def score_stream(sentences: DataFrame, cache: str, checkpoint: str, ts: str = "ts", text: str = "sentence", delay: str = "1 day") -> StreamingQuery:
    """Scores sentences of a stream into a parquet cache. Copies within ``delay`` are dropped by watermark, older ones
    by the cache itself; a batch that runs again writes nothing twice."""
    fresh = sentences.withColumn("hash", text_hash(F.col(text))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["hash"])

    def save(batch: DataFrame, _id: int) -> None:
        pos, neu, neg = lexicon_tone(F.col(text))
        append_cache(batch.dropDuplicates(["hash"]).select("hash", pos.alias("pos"), neu.alias("neu"), neg.alias("neg")), cache)

    return fresh.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and value of events by type in tumbling windows; runs on a stream or a table alike."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
