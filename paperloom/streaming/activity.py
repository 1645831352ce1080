"""Structured Streaming forms of the activity and works operators; each equals its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from paperloom.operators import relational, usage
from paperloom.sources.bucketed import BucketedTable


def timed(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events with a watermark; a timestamp without zone is read as UTC of the session first."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def ingest(events: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str, known: list[str], creating: list[str]) -> StreamingQuery:
    """Valid events to one table, the others with a reason to another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = usage.validate_events(batch, known, creating)
        accepted.write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """Repeats within the watermark go."""
    return timed(events, late).dropDuplicatesWithinWatermark(key)


def usage_by_window(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, activity_type, n) by tumbling windows, or sliding ones with ``slide``."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(window, "activity_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "activity_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(map_id, start, end, n): runs of events of a map without a pause of ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "map_id").agg(F.count(F.lit(1)).alias("n")).select("map_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def touched_maps(events: DataFrame, store: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """For each batch, recompute an operator for the maps it touches from the stored log, late events included."""

    def write(batch: DataFrame, batch_id: int) -> None:
        maps = batch.select("map_id").distinct()
        compute(store().join(maps, "map_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_works(updates: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merge each batch into a bucketed table of works, of which only the buckets of the batch's works are rewritten.

    Read it with ``BucketedTable(...).read()``. A batch that runs again after a failure starts from
    the table as it was before it. Versions that the last two merges don't need are deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = BucketedTable(batch.sparkSession, path, updates.schema, "work_id", buckets)
        table.merge(batch, batch_id, relational.upsert_works)
        table.vacuum()

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
