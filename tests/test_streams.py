"""Streams over several micro-batches against their batch twins, and the end of their state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandlake.streaming import feeds
from strandlake.tables import stage


class Feed:
    """A stream over a folder of files, run once for each batch of rows."""

    def __init__(self, spark, folder, schema, make, name):
        self.spark, self.folder, self.make, self.name, self.n = spark, folder, make, name, 0
        self.schema = schema

    def push(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        self.n += 1
        if query.lastProgress is not None:
            self.state_rows = query.lastProgress.stateOperators[0].numRowsTotal

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()), key=str)

    def live(self, state):
        """The keys that have a state now."""
        rows = self.spark.read.format("statestore").option("stateVarName", state).load(f"{self.folder}/state")
        return {r["key"][0] for r in rows.select("key").collect()}

    def input(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/in")


def in_batches(rows, k):
    return [rows[i * len(rows) // k : (i + 1) * len(rows) // k] for i in range(k)]


def test_throttle_and_the_end_of_its_state(spark, tmp_path):
    rnd = random.Random(1)
    rows = sorted((float(t), e, 100 * e + t, min(0.9 if e == 4 else 1.0, t * rnd.random() / 5)) for e in range(5) for t in range(12))
    rows = [(e, i, t, p) for t, e, i, p in rows]
    feed = Feed(spark, tmp_path, "execution_id long, id long, ts double, progress double", lambda s: feeds.throttled_stream(s, 0.05, 2.0, keep_seconds=0.0), "throttle")
    for part in in_batches(rows, 3):
        feed.push(part)
    assert feed.rows() == sorted(map(tuple, feeds.throttled(feed.input(), 0.05, 2.0).collect()), key=str)
    assert feed.state_rows >= 5
    feed.push([(e, 10_000 + e, 100.0, 1.0) for e in range(4)])
    feed.push([(9, 1, 2000.0, 0.1)])  # the watermark passes the complete ones
    assert feed.live("last") == {4, 9}


def test_status_moves_and_the_end_of_their_state(spark, tmp_path):
    rows = [(i, s, float(t)) for t, s in enumerate(["queued", "running", "running", "completed"]) for i in range(20)]
    feed = Feed(spark, tmp_path, "id long, status string, ts double", lambda s: feeds.status_moves_stream(s, keep_seconds=0.0), "moves")
    for part in in_batches(rows, 2):
        feed.push(part)
    assert feed.rows() == sorted(map(tuple, feeds.status_moves(feed.input()).collect()), key=str)
    feed.push([(99, "running", 900.0)])
    assert feed.live("last") == {99}
    feed.push([(99, "queued", 890.0)])  # late: passes nothing on
    assert [r for r in feed.rows() if r[0] == 99] == [(99, None, "running", 900.0)]
    feed.push([(5, "queued", 900.0 + 8 * 86_400)])
    feed.push([(5, "queued", 900.0 + 8 * 86_400)])
    assert feed.live("last") == {5}  # nothing was heard of 99 for a week


def test_fingerprints(spark, tmp_path):
    rows = [(k, float(t), round(t * (k + 1) / 4), "x") for t in range(12) for k in range(4)]
    feed = Feed(spark, tmp_path, "k long, ts double, a long, b string", lambda s: feeds.fingerprint_changes_stream(s, "k", "ts", "a", "b"), "prints")
    for part in in_batches(rows, 3):
        feed.push(part)
    twin = feeds.fingerprint_changes(feed.input(), "k", "ts", "a", "b").selectExpr("string(k)", "ts", "fingerprint")
    assert feed.rows() == sorted(map(tuple, twin.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_snapshots(spark, tmp_path, parts):
    rnd, begin = random.Random(2), dt.datetime(2024, 1, 1)
    state, rows = {}, []
    for t in range(14):
        for u in range(8):
            if rnd.random() < 0.25:
                state.pop(u, None)
            elif rnd.random() < 0.6:
                state[u] = (rnd.choice(["queued", "running", "completed", "failed"]), rnd.randrange(3))
        rows += [(f"u{u}", begin + dt.timedelta(seconds=10 * t), s, p) for u, (s, p) in sorted(state.items())]
    feed = Feed(spark, tmp_path, "unit_id string, ts timestamp, status string, progress long", lambda s: feeds.snapshot_changes_stream(s, 10.0, 5.0), "snap")
    for part in in_batches(rows, parts):
        feed.push(part)
    feed.push([("clock", begin + dt.timedelta(seconds=2000), "running", 0)])
    feed.push([("clock", begin + dt.timedelta(seconds=2001), "running", 0)])
    want = sorted(map(tuple, feeds.snapshot_changes(feed.input(), 10.0, 5.0).collect()), key=str)
    assert feed.rows() == want
    assert {r[2] for r in want} == {"new", "updated", "completed", "removed"}
    assert feed.live("last") == {"clock"}


def test_snapshots_equal_two_snapshots(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    old = [("a", at(0), "running", 1), ("b", at(0), "running", 1), ("c", at(0), "queued", 1), ("d", at(0), "completed", 1)]
    new = [("a", at(1), "completed", 1), ("b", at(1), "running", 2), ("d", at(1), "completed", 1), ("e", at(1), "queued", 0)]
    schema = "unit_id string, ts timestamp, status string, progress long"
    o, n = spark.createDataFrame(old, schema), spark.createDataFrame(new + [("clock", at(9), "queued", 0)], schema)
    got = {(r["unit_id"], r["change"]) for r in feeds.snapshot_changes(o.unionByName(n), 60.0).collect() if r["ts"] in (at(1),) or r["change"] == "removed" and r["unit_id"] == "c"}
    assert got == {tuple(r) for r in feeds.changes(o.drop("ts"), n.where("unit_id <> 'clock'").drop("ts")).collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_combination_feed(spark, tmp_path, parts):
    rnd, rows, now = random.Random(3), [], {}
    for t in range(40):
        for w in ("w1", "w2", "w3"):
            if rnd.random() < 0.3:
                now[w] = rnd.choice([None, 1, 2, 10])
            c = now.get(w)
            units = [None] if c is None else [f"u{c}-{k}" for k in range(rnd.randrange(1, 4))]
            rows += [(w, float(t), c, u, None if u is None else rnd.choice(["running", "completed"]), None if u is None else rnd.randrange(5) / 4) for u in units]
    feed = Feed(spark, tmp_path, "work_id string, ts double, combination_id long, unit_id string, status string, progress double", feeds.combination_feed_stream, "feed")
    for part in in_batches(rows, parts):
        feed.push(part)
    want = sorted(map(tuple, feeds.combination_feed(feed.input()).collect()), key=str)
    assert feed.rows() == want and {r[2] for r in want} == {"changed", "flush"}


def test_combination_feed_by_hand(spark):
    rows = [("w", 1.0, 1, "a", "running", 0.1), ("w", 2.0, 1, "a", "completed", 1.0), ("w", 2.0, 1, "b", "running", 0.0), ("w", 3.0, None, None, None, None), ("w", 4.0, None, None, None, None), ("w", 5.0, 1, "b", "completed", 1.0), ("w", 6.0, 2, "c", "running", 0.0)]
    df = spark.createDataFrame(rows, "work_id string, ts double, combination_id long, unit_id string, status string, progress double")
    got = sorted((r["ts"], r["event"], r["previous"], r["combination_id"], r["unit_id"], r["progress"]) for r in feeds.combination_feed(df).collect())
    assert got[0] == (1.0, "changed", None, "1", None, None)
    assert got[1:3] == [(3.0, "flush", None, "1", "a", 1.0), (3.0, "flush", None, "1", "b", 0.0)]
    assert got[3:] == [(6.0, "changed", "1", "2", None, None), (6.0, "flush", None, "1", "a", 1.0), (6.0, "flush", None, "1", "b", 1.0)]


def test_combination_feed_over_many_ranges(spark, monkeypatch):
    """A work's rows lie in several ranges, none of which sees the others' rows."""
    rows = [(w, float(t // 3), None if t % 11 == 0 else str(t // 7 % 3), f"u{t % 4}", "running", float(t)) for w in ("a", "b", None) for t in range(240)]
    df = spark.createDataFrame(rows, "work_id string, ts double, combination_id string, unit_id string, status string, progress double")
    whole = sorted(map(tuple, feeds.combination_feed(df).collect()), key=str)
    used = []

    def narrow(rows, by, *order):
        cut = stage(rows.repartitionByRange(9, by, *order).withColumn("part_no", F.spark_partition_id()), "ranges")
        used.append(cut.where("work_id = 'a'").select("part_no").distinct().count())
        return cut

    monkeypatch.setattr(feeds, "ranges", narrow)
    assert sorted(map(tuple, feeds.combination_feed(df).collect()), key=str) == whole and used[0] > 1
