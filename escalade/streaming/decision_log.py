"""Streaming cascade -> decision log.

Routing is per sample and stateless, so the stream needs no watermark or
state store: each micro-batch is scored with the (static, already fitted)
tiers and written to its own ``batch_id`` partition, overwritten on replay.
With the query checkpoint this gives exactly-once output even when a batch
is re-run after a failure. ``availableNow`` processes what is there and
stops, in batches bounded by files (``maxFilesPerTrigger``) or bytes (``maxBytesPerTrigger``). Every
batch meets the whole model, so many small files are better bounded by bytes.

Sources that deliver a row again (a replayed file, a retried producer) are handled by
``Replays``: a key seen within the watermark is passed on once, whatever batch or file it
comes in. The state holds keys and times only, each until the watermark has passed it, so it is bounded
by the keys of one delay, not by the stream. Rows later than the watermark are dropped: a key
whose state is gone couldn't be told from a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from escalade.sources.results import decision_log


@dataclass(frozen=True)
class Replays:
    """Rows of one ``key`` are one row if their ``event_time`` is at most ``delay`` apart (rows with
    a NULL key count as one key); ``delay`` is also how late a row may be.
    Event times up to 1970 are late from the start."""

    key: str
    event_time: str
    delay: str

    def once(self, rows: DataFrame) -> DataFrame:
        kind = rows.schema[self.event_time].dataType.simpleString()
        if kind != "timestamp":
            raise TypeError(f"{self.event_time} must be a timestamp, not {kind}")
        return rows.withWatermark(self.event_time, self.delay).dropDuplicatesWithinWatermark([self.key])


def stream_decision_log(spark: SparkSession, source_dir: str, schema, glob: str,
                        to_decisions: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str,
                        files_per_trigger: int = 1, available_now: bool = True,
                        to_samples: Callable[[DataFrame], DataFrame] | None = None,
                        replays: Replays | None = None, bytes_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream; ``to_samples`` (optional) prepares a micro-batch of
    source rows (e.g. tokenises it), ``to_decisions`` routes the prepared rows;
    ``replays`` (optional) lets repeated rows through once; ``bytes_per_trigger`` (optional) bounds
    a batch by the bytes of its files (one file at least) in place of their number. The prepared batch is persisted while the staged tiers read it."""
    bound = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    src = spark.readStream.schema(schema).option("pathGlobFilter", glob).option(*bound).parquet(source_dir)
    if replays:
        src = replays.once(src)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # the prepared batch is read several times by the staged tiers: keep it
        # for the duration of this batch only (bounded by the trigger)
        prepared = (to_samples(batch) if to_samples else batch).persist()
        # fill the cache before the tiers' stages read it concurrently
        prepared.count()
        try:
            decision_log(to_decisions(prepared), out_path, batch_id=batch_id)
        finally:
            prepared.unpersist()

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
