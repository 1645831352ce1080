"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from paperloom.plans.views import activity
from paperloom.sources.bucketed import BucketedTable
from paperloom.streaming import activity as streams
from paperloom.tables import table


def landed_events(spark, tables, tmp_path, copies=1):
    path = str(tmp_path / "in")
    e = table(spark, tables, "events").select("event_id", F.col("user_id").alias("map_id"), F.col("event_type").alias("activity_type"), F.col("ts").cast("timestamp").alias("ts"))
    for i in range(copies):
        e.repartition(3).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).parquet(path), e


def run(spark, df, name, mode="append"):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_usage_by_hour(spark, tables, tmp_path):
    stream, batch = landed_events(spark, tables, tmp_path)
    got = run(spark, streams.usage_by_window(streams.timed(stream)), "hours", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.usage_by_window(batch).collect()))


def test_sessions_of_closed_windows(spark, tables, tmp_path):
    stream, batch = landed_events(spark, tables, tmp_path)
    got, want = set(map(tuple, run(spark, streams.sessions(streams.timed(stream)), "sess").collect())), set(map(tuple, streams.sessions(batch).collect()))
    assert got and got <= want


def test_dedupe(spark, tables, tmp_path):
    stream, batch = landed_events(spark, tables, tmp_path, copies=2)
    got = run(spark, streams.dedupe(stream, ["event_id"], "60 days"), "once")
    assert got.count() == batch.count()


def test_ingest_splits_rejects(spark, tables, tmp_path):
    stream, batch = landed_events(spark, tables, tmp_path)
    streams.ingest(stream, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp"), ["view", "click"], []).awaitTermination()
    ok, no = spark.read.parquet(str(tmp_path / "ok")), spark.read.parquet(str(tmp_path / "no"))
    assert ok.count() + no.count() == batch.count() and ok.select("activity_type").distinct().count() == 2


def test_touched_maps(spark, tables, tmp_path):
    stream, batch = landed_events(spark, tables, tmp_path)
    from paperloom.operators.usage import activity_summary

    log = activity(spark, tables)
    streams.touched_maps(stream, lambda: log, activity_summary, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == activity_summary(log).count()


WORKS = "work_id long, title string, year int, cited_by_count int"


def test_works_upsert_touches_few_buckets(spark, tmp_path):
    source, path = str(tmp_path / "w"), str(tmp_path / "table")
    batches = [[(i, None if i % 3 else f"t{i}", 2000 + i % 5, i) for i in range(200)], [(7, "new", 1990, 5), (7, "newer", None, 900), (500, "x", None, None)], [(8, None, 1980, 1)]]
    rows = []
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, WORKS)
        df.coalesce(1).write.mode("append").parquet(source)
        rows += batch
        streams.upsert_works(spark.readStream.schema(df.schema).parquet(source), path, str(tmp_path / "cp"), buckets=16).awaitTermination()
        table = BucketedTable(spark, path, df.schema, "work_id", 16)
        assert table.versions()[-1] == k and sum(v == k for v in table.manifest().values()) <= len({r[0] for r in batch})
        got = {r["work_id"]: r for r in table.read().collect()}
        assert len(got) == len({r[0] for r in rows}) == table.read().count()
    assert (got[7]["title"], got[7]["year"], got[7]["cited_by_count"]) == ("new", 1990, 900) and (got[500]["cited_by_count"], got[8]["year"], got[8]["cited_by_count"]) == (0, 1980, 8)


def test_a_merge_that_failed_runs_again(spark, tmp_path):
    add = lambda stored, new: stored.union(new).groupBy("work_id").agg(F.sum("n").alias("n"))  # noqa: E731  not the same if done twice
    one = spark.createDataFrame([(i, i) for i in range(40)], "work_id long, n long")
    table = BucketedTable(spark, str(tmp_path / "t"), one.schema, "work_id", 8)
    assert table.read().count() == 0 and table.merge(one, 0, add) == set(range(8))
    two = spark.createDataFrame([(3, 100), (3, 1), (77, 5)], one.schema)

    def breaks(stored, new):
        add(stored, new).withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(str(tmp_path / "t" / "versions" / "version=1"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.merge(two, 1, breaks)
    assert table.read().count() == 40
    for _ in range(2):  # replayed whole
        assert 1 <= len(table.merge(two, 1, add)) <= 2
        got = {r["work_id"]: r["n"] for r in table.read().collect()}
        assert got == {**{i: i for i in range(40)}, 3: 104, 77: 5}
    assert {r["work_id"]: r["n"] for r in table.read(version=0).collect()} == {i: i for i in range(40)}
    table.merge(two.limit(0), 2, add)
    table.merge(one, 3, lambda stored, new: stored.join(new, "work_id", "left_anti"))
    assert table.read().collect() == [(77, 5)] and table.vacuum(1) > 0 and table.read().collect() == [(77, 5)]
