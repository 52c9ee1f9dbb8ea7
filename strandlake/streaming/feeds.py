"""Change feeds: each as a stream with state, and as a batch twin over stored rows.

A stream sees a key's rows in time order within a micro-batch; a row older than what the key's
state already holds is late and passes nothing on, and one that is ``LATE_SECONDS`` behind the
newest of all is not read. State ends by timers in event time: ``keep_seconds`` after a key's last
row if that row is final, ``ttl_seconds`` after it if not. A key that comes back later is a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import FINAL
from ..tables import ranges, stage

THROTTLED = "execution_id long, ts double, progress double"
MOVES = "id long, old_status string, new_status string, ts double"
LATE_SECONDS, KEEP_SECONDS, TTL_SECONDS = 600, 3_600.0, 7 * 86_400.0


class Ending(StatefulProcessor):
    """A processor whose keys' state is cleared by a timer, sooner after a final row."""

    def __init__(self, keep_seconds: float, ttl_seconds: float):
        self.keep_ms, self.ttl_ms = int(1000 * keep_seconds), int(1000 * ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> list:
        """The states, which the end of a key clears."""
        raise NotImplementedError

    def ends(self, final: bool, ts: float) -> None:
        """After a key's rows, the last at ``ts``: move the timer of its end."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(1000 * (ts + AHEAD)) + (self.keep_ms if final else self.ttl_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in self.states:
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


#: Times up to 1970 are late before a stream has begun, so the clock of timers is a day ahead: feeds may count from 0.
AHEAD = 86_400.0


def _timed(rows: DataFrame) -> DataFrame:
    """With the watermark that the timers go by."""
    return rows.withColumn("event_time", (F.col("ts").cast("double") + AHEAD).cast("timestamp")).withWatermark("event_time", f"{LATE_SECONDS} seconds")


# ------------------------------------------------------------------ T1: progress throttle


def throttled(progress: DataFrame, least_gain: float = 0.01, least_seconds: float = 0.5) -> DataFrame:
    """Of ``progress(execution_id, id, ts double, progress)`` the rows that are passed on.

    A row passes if it is the execution's first, or has gained enough over the last row that
    passed and comes late enough after it. A fold over each execution's rows in time order.
    """
    rows = F.array_sort(F.collect_list(F.struct("ts", "id", "progress")))

    def step(acc: Column, r: Column) -> Column:
        go = acc["last"].isNull() | ((r["progress"] - acc["last"]["progress"] >= least_gain) & (r["ts"] - acc["last"]["ts"] >= least_seconds))
        return F.when(go, F.struct(r.alias("last"), F.concat(acc["out"], F.array(r)).alias("out"))).otherwise(acc)

    kind = "struct<ts:double,id:bigint,progress:double>"
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
    kept = progress.groupBy("execution_id").agg(rows.alias("rows")).select("execution_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("r"))
    return kept.select("execution_id", "r.ts", "r.progress")


class Throttle(Ending):
    """The stream form: the last row that passed is an execution's state, cleared some time after it is complete."""

    def __init__(self, least_gain: float, least_seconds: float, keep_seconds: float, ttl_seconds: float):
        super().__init__(keep_seconds, ttl_seconds)
        self.least_gain, self.least_seconds = least_gain, least_seconds

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.last = handle.getValueState("last", "progress double, ts double")
        return [self.last]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        last, out = self.last.get() if self.last.exists() else None, []
        for ts, progress in zip(batch["ts"], batch["progress"]):
            if last is None or (progress - last[0] >= self.least_gain and ts - last[1] >= self.least_seconds):
                last = (float(progress), float(ts))
                out.append((key[0], float(ts), float(progress)))
        if out:
            self.last.update(last)
        self.ends(last[0] >= 1 or bool((batch["progress"] >= 1).any()), float(batch["ts"].iloc[-1]))
        yield pd.DataFrame(out, columns=["execution_id", "ts", "progress"])


def throttled_stream(progress: DataFrame, least_gain: float = 0.01, least_seconds: float = 0.5, keep_seconds: float = KEEP_SECONDS, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    return _timed(progress).groupBy("execution_id").transformWithStateInPandas(Throttle(least_gain, least_seconds, keep_seconds, ttl_seconds), THROTTLED, "append", "eventTime")


# ------------------------------------------------------------------ T2: changes between snapshots


def changes(old: DataFrame, new: DataFrame, key: str = "unit_id") -> DataFrame:
    """``(key, change)`` of two snapshots: new, removed, completed (newly final), updated."""
    a = old.select(F.col(key).alias("k"), F.col("status").alias("s1"), F.struct(*sorted(c for c in old.columns if c != key)).alias("r1"))
    b = new.select(F.col(key).alias("k2"), F.col("status").alias("s2"), F.struct(*sorted(c for c in new.columns if c != key)).alias("r2"))
    both = a.join(b, a["k"] == b["k2"], "full_outer")
    kind = F.when(F.col("k").isNull(), "new").when(F.col("k2").isNull(), "removed").when(F.col("s2").isin(*FINAL) & ~F.col("s1").isin(*FINAL), "completed").when(~F.col("r1").eqNullSafe(F.col("r2")), "updated")
    return both.select(F.coalesce("k", "k2").alias(key), kind.alias("change")).where("change is not null")


CHANGES = "unit_id string, ts timestamp, change string"


def _observed(rows: DataFrame, key: str) -> DataFrame:
    record = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in (key, "ts"))), {"ignoreNullFields": "false"})
    return rows.select(F.col(key).alias("unit_id"), "ts", "status", record.alias("record"))


def snapshot_changes(rows: DataFrame, every: float, late: float = 0.0, key: str = "unit_id") -> DataFrame:
    """``CHANGES`` in a series of snapshots ``rows(key, ts, status, ...)`` that are ``every`` seconds apart at most.

    A unit is new where it was not seen for longer than ``every``, removed ``every`` seconds after it
    was last seen, completed where it becomes final, updated where anything else of it differs. What
    was last seen less than ``every`` + ``late`` seconds before the newest row may still come back.
    Of rows with the same unit and time the least record counts.
    """
    gap = F.make_dt_interval(secs=F.lit(every))
    one = _observed(rows, key).groupBy("unit_id", "ts").agg(F.min(F.struct("record", "status")).alias("r")).select("unit_id", "ts", "r.record", "r.status")
    order = Window.partitionBy("unit_id").orderBy("ts")
    seen = one.select("*", *[F.lag(c).over(order).alias(f"old_{c}") for c in ("ts", "status", "record")], F.lead("ts").over(order).alias("next"))
    newest = one.agg(F.max("ts").alias("newest"))  # one row
    fresh = F.col("old_ts").isNull() | (F.col("ts") - F.col("old_ts") > gap)
    final = lambda c: F.coalesce(F.col(c).isin(*FINAL), F.lit(False))
    kind = F.when(fresh, "new").when(final("status") & ~final("old_status"), "completed").when(F.col("record") != F.col("old_record"), "updated")
    gone = seen.crossJoin(F.broadcast(newest)).where(F.coalesce(F.col("next") - F.col("ts") > gap, F.col("ts") + gap < F.col("newest") - F.make_dt_interval(secs=F.lit(late))))
    return seen.select("unit_id", "ts", kind.alias("change")).where("change IS NOT NULL").unionByName(gone.select("unit_id", (F.col("ts") + gap).alias("ts"), F.lit("removed").alias("change")))


class Snapshots(StatefulProcessor):
    """The stream form: a unit's last record and a timer in event time, which goes off when the unit stays away."""

    def __init__(self, every: float):
        self.every = pd.Timedelta(seconds=every)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, status string, record string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "record"])
        last, out = self.last.get() if self.last.exists() else None, []
        for ts, status, record in zip(batch["ts"], batch["status"], batch["record"]):
            before = None if last is None else pd.Timestamp(last[0], unit="ms")
            if before is not None and ts <= before:
                continue
            if before is not None and ts - before > self.every:
                out.append((key[0], before + self.every, "removed"))
                before = None
            if before is None:
                out.append((key[0], ts, "new"))
            elif status in FINAL and last[1] not in FINAL:
                out.append((key[0], ts, "completed"))
            elif record != last[2]:
                out.append((key[0], ts, "updated"))
            last = (int(ts.value // 1_000_000), status, record)
        self.last.update(last)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last[0] + int(self.every.total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["unit_id", "ts", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        self.last.clear()
        yield pd.DataFrame([(key[0], at, "removed")], columns=["unit_id", "ts", "change"])

    def close(self) -> None:
        pass


def snapshot_changes_stream(rows: DataFrame, every: float, late: float = 0.0, key: str = "unit_id") -> DataFrame:
    """As ``snapshot_changes``; removed units come out once the watermark, ``late`` seconds behind the newest row, has passed. Times count in whole milliseconds."""
    seen = _observed(rows, key).withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", f"{late} seconds")
    return seen.groupBy("unit_id").transformWithStateInPandas(Snapshots(every), CHANGES, "append", "eventTime")


# ------------------------------------------------------------------ T4-T6: fingerprints and moves


def fingerprints(rows: DataFrame, *fields: str) -> DataFrame:
    """An md5 of each row's fields, doubles rounded to three digits."""
    kinds = dict(rows.dtypes)
    parts = [F.round(c, 3).alias(c) if kinds[c] == "double" else F.col(c) for c in sorted(fields)]
    return rows.withColumn("fingerprint", F.md5(F.to_json(F.struct(*parts))))


def fingerprint_changes(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """The rows whose fingerprint differs from the one before of their key."""
    before = F.lag("fingerprint").over(Window.partitionBy(key).orderBy(order))
    return fingerprints(rows, *fields).withColumn("before", before).where(~F.col("fingerprint").eqNullSafe(F.col("before"))).drop("before")


PRINTS = "key string, ts double, fingerprint string"


class Prints(Ending):
    """The stream form of ``fingerprint_changes``: a key's last fingerprint is its state."""

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.last = handle.getValueState("last", "fingerprint string, ts double")
        return [self.last]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "fingerprint"])
        last, out = self.last.get() if self.last.exists() else (None, float("-inf")), []
        for ts, fingerprint in zip(batch["ts"], batch["fingerprint"]):
            if ts >= last[1]:
                if fingerprint != last[0]:
                    out.append((key[0], float(ts), fingerprint))
                last = (fingerprint, float(ts))
        self.last.update(last)
        self.ends(False, last[1])
        yield pd.DataFrame(out, columns=["key", "ts", "fingerprint"])


def fingerprint_changes_stream(rows: DataFrame, key: str, order: str, *fields: str, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """``PRINTS``: where a key's fingerprint differs from the one before. A key's state lives ``ttl_seconds`` from its last row."""
    seen = fingerprints(rows, *fields).select(F.col(key).cast("string").alias("key"), F.col(order).cast("double").alias("ts"), "fingerprint")
    return _timed(seen).groupBy("key").transformWithStateInPandas(Prints(ttl_seconds, ttl_seconds), PRINTS, "append", "eventTime")


def status_moves(rows: DataFrame, key: str = "id", tie: str | None = None) -> DataFrame:
    """``rows(key, status, ts)`` -> old and new status wherever it changes; the first has no old one."""
    old = F.lag("status").over(Window.partitionBy(key).orderBy(*["ts", *([tie] if tie else [])]))
    return rows.withColumn("old_status", old).where(~F.col("status").eqNullSafe(F.col("old_status"))).select(key, "old_status", F.col("status").alias("new_status"), "ts")


class Moves(Ending):
    """The stream form: an id's last status is its state, cleared some time after a final one."""

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.last = handle.getValueState("last", "status string, ts double")
        return [self.last]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        now, at = self.last.get() if self.last.exists() else (None, float("-inf"))
        out = []
        for status, ts in zip(batch["status"], batch["ts"]):
            if ts >= at:
                if status != now:
                    out.append((key[0], now, status, float(ts)))
                now, at = status, float(ts)
        self.last.update((now, at))
        self.ends(now in FINAL, at)
        yield pd.DataFrame(out, columns=["id", "old_status", "new_status", "ts"])


def status_moves_stream(rows: DataFrame, keep_seconds: float = KEEP_SECONDS, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    return _timed(rows).groupBy("id").transformWithStateInPandas(Moves(keep_seconds, ttl_seconds), MOVES, "append", "eventTime")


def combination_changes(rows: DataFrame) -> DataFrame:
    """``rows(work_id, ts, combination_id)`` -> where the running combination changes, with the one before, whose rows are to be flushed."""
    before = F.lag("combination_id").over(Window.partitionBy("work_id").orderBy("ts", "combination_id"))
    return rows.withColumn("previous", before).where(~F.col("combination_id").eqNullSafe(F.col("previous")))


FEED = "work_id string, ts double, event string, previous string, combination_id string, unit_id string, status string, progress double"


def _watched(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("work_id").cast("string"), F.col("ts").cast("double"), F.col("combination_id").cast("string"), F.col("unit_id").cast("string"), "status", F.col("progress").cast("double"))


def combination_feed(rows: DataFrame) -> DataFrame:
    """``FEED`` of ``rows(work_id, ts, combination_id, unit_id, status, progress)``, what was seen of each work's running combination.

    Where the combination changes there is a ``changed`` row with the one before and the new one,
    and a ``flush`` row with the last status and progress of each unit of the one before. A null
    combination (no more work, or a pause) flushes the open one too, once until another opens.
    Rows count in order of time, combination and unit. They are read in ranges of that order, and
    each range learns from the few figures of those before it, so no task sorts a whole work.
    """
    by = ["ts", "combination_id", "unit_id", "status", "progress"]
    cut = ranges(_watched(rows), "work_id", *by)
    here = Window.partitionBy("work_id", "part_no").orderBy(*by)
    earlier = Window.partitionBy("work_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)

    def with_earlier(rows: DataFrame, parts: DataFrame, **figures) -> DataFrame:
        far = parts.select(F.col("work_id").alias("work_of"), F.col("part_no").alias("part_of"), *[c.over(earlier).alias(k) for k, c in figures.items()])
        return rows.join(far, F.col("work_id").eqNullSafe(F.col("work_of")) & (F.col("part_no") == F.col("part_of"))).drop("work_of", "part_of")

    newest = F.max_by("combination_id", F.when(F.col("combination_id").isNotNull(), F.struct(*by)))
    parts = cut.groupBy("work_id", "part_no").agg(F.count(F.lit(1)).alias("n"), newest.alias("newest"))
    seen = with_earlier(cut, parts, shift=F.sum("n"), carried=F.last("newest", ignorenulls=True))
    before = F.coalesce(F.last("combination_id", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    opens = F.col("combination_id").isNotNull() & ~F.col("combination_id").eqNullSafe(F.col("before"))
    seen = seen.withColumn("before", before).withColumn("opens", opens).withColumn("pos", F.row_number().over(here) + F.coalesce("shift", F.lit(0)))
    seen = seen.withColumn("run", F.sum(F.col("opens").cast("int")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    seen = stage(seen.drop("shift", "carried"), "feed")
    opened = seen.groupBy("work_id", "part_no").agg(F.max("run").alias("opened"))
    runs = with_earlier(seen, opened, shift=F.sum("opened")).withColumn("run", F.col("run") + F.coalesce("shift", F.lit(0)))
    changed = runs.where("opens").select("work_id", "run", "ts", "pos", F.col("before").alias("previous"), "combination_id")
    paused = runs.where("combination_id IS NULL AND run > 0").groupBy("work_id", "run").agg(F.min("pos").alias("until"), F.min_by("ts", "pos").alias("at"))
    ended = changed.where("run > 1").select("work_id", (F.col("run") - 1).alias("run"), F.col("pos").alias("until"), F.col("ts").alias("at"))
    units = runs.where("combination_id IS NOT NULL").select("work_id", "run", "combination_id", "unit_id", "pos", F.struct("pos", "status", "progress").alias("r"))
    last = units.join(paused.unionByName(ended), ["work_id", "run"]).where("pos < until").groupBy("work_id", "run", "until", "at", "combination_id", "unit_id").agg(F.max("r").alias("r"))
    none = F.lit(None).cast("string")
    events = changed.select("work_id", "ts", F.lit("changed").alias("event"), "previous", "combination_id", none.alias("unit_id"), none.alias("status"), F.lit(None).cast("double").alias("progress"))
    flushed = last.select("work_id", F.col("at").alias("ts"), F.lit("flush").alias("event"), none.alias("previous"), "combination_id", "unit_id", "r.status", "r.progress")
    return events.unionByName(flushed)


class Combinations(Ending):
    """The stream form: the open combination of a work and the last row of each of its units."""

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.now = handle.getValueState("now", "combination_id string, flushed boolean, ts double")
        self.units = handle.getMapState("units", "unit_id string", "status string, progress double")
        return [self.now, self.units]

    def _flush(self, work: str, ts: float, combination: str) -> list[tuple]:
        return [(work, ts, "flush", None, combination, unit[0], status, progress) for unit, (status, progress) in self.units.iterator()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "combination_id", "unit_id", "status", "progress"], na_position="first")
        now, flushed, at = self.now.get() if self.now.exists() else (None, False, float("-inf"))
        out: list[tuple] = []
        last: dict[str, tuple] = {}  # the open combination's units of this batch, written to the state at once

        def keep() -> None:
            for unit, row in last.items():
                self.units.updateValue((unit,), row)
            last.clear()

        for ts, combination, unit, status, progress in zip(*[batch[c] for c in ("ts", "combination_id", "unit_id", "status", "progress")]):
            if ts < at:
                continue
            at = float(ts)
            if pd.isna(combination):
                if now is not None and not flushed:
                    keep()
                    out += self._flush(key[0], at, now)
                    flushed = True
                continue
            if combination != now:
                if now is not None:
                    keep()
                    out += self._flush(key[0], at, now)
                    self.units.clear()
                out.append((key[0], at, "changed", now, combination, None, None, None))
                now, flushed = combination, False
            last[unit] = (status, None if pd.isna(progress) else float(progress))
        keep()
        self.now.update((now, flushed, at))
        self.ends(flushed, at)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEED.split(", ")])


def combination_feed_stream(rows: DataFrame, keep_seconds: float = KEEP_SECONDS, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """As ``combination_feed``; a work's state is cleared ``keep_seconds`` after the flush by a null combination."""
    return _timed(_watched(rows)).groupBy("work_id").transformWithStateInPandas(Combinations(keep_seconds, ttl_seconds), FEED, "append", "eventTime")


# ------------------------------------------------------------------ T3, T7


def new_events(events: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The stream of events of some types; the checkpoint's offsets are the cursor."""
    return events.where(F.col("event_type").isin(*kinds)) if kinds else events


def live_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by work and window of their time; as a stream, late ones count until the watermark."""
    return events.withWatermark("ts", late).groupBy("work_id", F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("work_id", F.col("w.start").alias("begins"), "event_type", "n")


def live_progress(executions: DataFrame) -> DataFrame:
    """Finished and all executions by combination, for output mode update."""
    final = F.count_if(F.col("status").isin(*FINAL))
    return executions.groupBy("combination_id").agg(final.alias("finished"), F.count(F.lit(1)).alias("n"), (final / F.count(F.lit(1))).alias("progress"))
