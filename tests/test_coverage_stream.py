"""Unlock alerts of a stream, against the coverage of the whole log."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")

from paperloom.operators import usage  # noqa: E402
from paperloom.streaming import activity as streams  # noqa: E402
from paperloom.streaming import coverage  # noqa: E402

SCHEMA = "event_id long, map_id long, activity_type string, work_id long, ts timestamp, seq long, work_ids array<long>"
START = datetime.datetime(2026, 1, 1)
NODES = ["open", "note"]


def event(i, map_id, kind, hours, work=None, seq=None, works=None):
    return (i, map_id, kind, work, START + datetime.timedelta(hours=hours), seq, works)


class Log:
    """A folder that a stream reads: each call of ``run`` adds a file and lets the stream take it, from its checkpoint."""

    def __init__(self, spark, folder, name, **options):
        self.spark, self.folder, self.name, self.options = spark, folder, name, options

    def run(self, rows):
        before = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", "2")
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        stream = streams.timed(self.spark.readStream.schema(SCHEMA).parquet(str(self.folder / "in")))
        alerts = coverage.coverage_alerts(stream, "timeline", NODES, **self.options)
        alerts.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        self.spark.conf.set("spark.sql.shuffle.partitions", before)
        return sorted((r["map_id"], round(r["coverage"], 6)) for r in self.spark.read.schema(coverage.ALERT).parquet(str(self.folder / "out")).collect())


def test_alerts_restart_late_events_and_expiry(spark, tmp_path):
    log = Log(spark, tmp_path, "alerts", idle="5 days")
    explored = [event(i, 1, "open", 0.1 * i, work=i % 9) for i in range(12)]  # 9 nodes: 0.27
    assert log.run(explored + [event(20, 2, "timeline", 1)]) == []
    one = (1, round(0.27 + 0.15, 6))
    assert log.run([event(21, 1, "timeline", 2), event(21, 1, "timeline", 2)]) == [one]
    # told once; a late event within the watermark counts, one behind it does not
    late = [event(30 + i, 2, "note", 1.5, work=i) for i in range(9)]
    assert log.run([event(22, 1, "open", 3, work=50), event(23, 3, "open", 3.2, work=1), *late]) == [one, (2, 0.42)]
    assert log.run([event(40 + i, 3, "open", 3 + 24, work=i) for i in range(2, 4)]) == [one, (2, 0.42)]
    assert log.run([event(50 + i, 3, "note", 2, work=i) for i in range(9)] + [event(60, 3, "timeline", 28)]) == [one, (2, 0.42)]
    # after five idle days map 1 is forgotten: it starts anew and is told of again
    assert log.run([event(70, 9, "open", 300, work=1)]) == [one, (2, 0.42)]
    assert log.run([event(71, 9, "open", 301, work=1), event(72, 1, "timeline", 301)]) == [one, (2, 0.42)]
    assert log.run([event(80 + i, 1, "open", 302, work=i) for i in range(10)]) == [one, (1, 0.45), (2, 0.42)]


def test_maps_of_the_whole_log(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        map_id, hours = rng.randint(0, 25), i / 10
        if rng.random() < 0.25:
            rows.append(event(i, map_id, "compare", hours, seq=i, works=rng.sample(range(12), rng.randint(1, 5))))
        else:
            rows.append(event(i, map_id, rng.choice(["open", "note", "view", "view", "timeline"]), hours, work=rng.randint(0, 8)))
    table = spark.createDataFrame(rows, SCHEMA)
    compared = table.where("activity_type = 'compare'").select("map_id", F.col("event_id").alias("comparison_id"), "seq", "work_ids")
    whole = {r["map_id"]: (r["unlocked"], round(r["coverage"], 6)) for r in usage.coverage(table, compared, "timeline", NODES).collect()}
    got = Log(spark, tmp_path, "whole").run(rows)
    assert 3 < len(got) < 26 and got == sorted((m, c) for m, (unlocked, c) in whole.items() if unlocked)
