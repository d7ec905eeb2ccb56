"""Versioned tables, increments and debounced changes, over failures and replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylode.operators import versioned
from quarrylode.operators.versioned import Conflict, VersionedTable
from quarrylode.streaming.debounce import Debouncer, debounced
from quarrylode.streaming.increments import keep_up


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_rewrites_touched_buckets_and_readers_keep_their_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 8)
    assert t.upsert(spark.createDataFrame([(i, i * 10) for i in range(40)], "k int, v int")) == 1
    before, files = t.read(), t.manifest()["files"]
    assert t.upsert(spark.createDataFrame([(3, -1), (99, 5)], "k int, v int")) == 2
    after = t.manifest()["files"]
    assert 1 <= sum(files.get(b) != f for b, f in after.items()) <= 2
    assert rows(t.read()) == sorted([(i, i * 10) for i in range(40) if i != 3] + [(3, -1), (99, 5)])
    assert rows(before) == rows(t.read(1)) == [(i, i * 10) for i in range(40)]
    assert t.forget_unused(keep=1) == 0 and rows(t.read()) and len(after) == 8


def test_a_failed_publish_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))

    def crash(*_):
        raise OSError("no manifest")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(VersionedTable, "_write", crash)
        t.upsert(spark.createDataFrame([(1, "lost")], "k int, v string"))
    assert t.version() == 1 and rows(t.read()) == [(1, "a"), (2, "b")]
    assert t.forget_unused() == 1 and rows(t.read()) == [(1, "a"), (2, "b")]


def test_of_two_changes_from_one_version_one_is_told(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    t.upsert(spark.createDataFrame([(1, 1)], "k int, v int"))
    base = t.manifest()
    fresh = t._bucketed(spark.createDataFrame([(2, 2)], "k int, v int"))
    touched = [r[0] for r in fresh.select(versioned.BUCKET).collect()]
    assert t._publish(base, fresh, touched, {}) == 2
    with pytest.raises(Conflict):
        t._publish(base, fresh, touched, {})


def test_updated_at_is_set_where_a_row_is_replaced(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    when = F.lit("2025-01-02").cast("timestamp")
    t.upsert(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), when)
    t.upsert(spark.createDataFrame([(2, 3), (3, 4)], "k int, v int"), when)
    assert rows(t.read().select("k", "v", F.col("updated_at").isNotNull())) == [(1, 1, False), (2, 3, True), (3, 4, False)]


def test_chunks_with_a_bad_row_are_counted_whole(spark):
    data = spark.createDataFrame([(f"d{i}", i) for i in range(20)] + [("d0", 1), (None, 2)], "k string, v int")
    fine, report = versioned.chunked(data, "k", {"small": F.col("v") < 19}, 6)
    found = report.collect()
    assert sum(r.n_rows for r in found) == 22 and sum(r.n_rows - r.errors for r in found) == fine.count()
    assert {x for r in found for x in r.failed} == {"key", "small"}
    assert fine.filter("v >= 19 or k is null or k = 'd0'").isEmpty()


def test_increments_are_merged_once_over_replays_and_feeds(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    part = lambda b: b.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    combine = {"n": "sum", "top": "max"}
    for epoch, vs in enumerate([[1, 5], [7], [2]]):
        spark.createDataFrame([("a", v) for v in vs] + [("b", epoch)], "k string, v int").write.parquet(str(tmp_path / "in" / f"p{epoch}"))
    schema = "k string, v int"
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    keep_up(feed(), "one", part, t, combine, str(tmp_path / "log"), once=True).awaitTermination()
    whole = [("a", 4, 7), ("b", 3, 2)]
    assert rows(t.read()) == whole
    version = t.version()
    keep_up(feed(), "one", part, t, combine, str(tmp_path / "log2"), once=True).awaitTermination()  # all epochs again
    assert t.version() == version and rows(t.read()) == whole
    keep_up(feed(), "two", part, t, combine, str(tmp_path / "log3"), once=True).awaitTermination()
    assert rows(t.read()) == [("a", 8, 7), ("b", 6, 2)]


def test_bursts_are_told_once_over_batches_with_late_and_repeated_changes(spark, tmp_path):
    zero = dt.datetime(2025, 1, 1)
    batches = [[("a", 0.0), ("a", 1.5), ("b", 1.0)], [("a", 0.5), ("a", 1.5), ("a", 6.0), ("b", 4.0), (None, 5.0)], [("a", 7.9), ("b", 12.0), ("c", 30.0)], [("c", 60.0)]]
    out = []
    for i, batch in enumerate(batches):
        spark.createDataFrame([(k, zero + dt.timedelta(seconds=s)) for k, s in batch], "k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        stream = spark.readStream.schema("k string, at timestamp").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = debounced(stream, "k", "at", late="10 seconds").writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "log"))
        query.trigger(availableNow=True).start().awaitTermination()
    seconds = lambda t: (t - zero).total_seconds()
    assert sorted((r.key, seconds(r.first_change), seconds(r.last_change), r.n_changes) for r in out) == [("a", 0.0, 1.5, 4), ("a", 6.0, 7.9, 2), ("b", 1.0, 1.0, 1), ("b", 4.0, 4.0, 1), ("b", 12.0, 12.0, 1), ("c", 30.0, 30.0, 1)]


def test_a_key_of_many_bursts_has_one_timer():
    class Handle:
        def __init__(self):
            self.timers, self.asked, self.value = [], 0, None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, t):
            self.asked += 1
            self.timers.append(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, bursts = Handle(), Debouncer(10)
    bursts.init(handle)
    list(bursts.handleInputRows(("k",), iter([{"ms": 100 * i} for i in range(1, 51)]), At(0)))
    assert handle.asked == 1 and handle.timers == [110]
    list(bursts.handleInputRows(("k",), iter([{"ms": 105}]), At(0)))
    assert handle.timers == [115]
    handle.timers.clear()
    assert [tuple(r) for r in bursts.handleExpiredTimer(("k",), At(2010), At(115))] == [("k", 100, 105, 2)] + [("k", 100 * i, 100 * i, 1) for i in range(2, 21)]
    assert handle.timers == [2110] and [len(c) for c in handle.value] == [30] * 3
