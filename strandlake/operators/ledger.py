"""The run ledger: status tallies, progress, latest rows, listings, writes.

Tables: work, combinations, executions, execution_progress, run_events. Writes give new tables;
a caller stores them as new snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EVENT_CATEGORIES, EVENT_TYPES, FINAL, STATUSES, TRANSITIONS

LEVELS = ("task_id", "dataset_id", "preset_id", "algorithm_id")


def is_final(status: str = "status") -> Column:
    return F.col(status).isin(*FINAL)


def _status_class(n: Column, final: Column, queued: Column) -> Column:
    return F.when(final == n, "finished").when(queued == n, "queued").otherwise("running")


def level_status(combos: DataFrame, depth: int) -> DataFrame:
    """finished, queued or running for each task, or dataset of a task, and so on (depth 1 to 4)."""
    n, final, queued = F.count(F.lit(1)), F.count_if(is_final()), F.count_if(F.col("status") == "queued")
    return combos.groupBy("work_id", *LEVELS[:depth]).agg(n.alias("n"), _status_class(n, final, queued).alias("class"))


def all_level_status(combos: DataFrame) -> DataFrame:
    """All four levels in one pass: the rolled-up ids are null, ``level`` says how many are given."""
    n, final, queued = F.count(F.lit(1)), F.count_if(is_final()), F.count_if(F.col("status") == "queued")
    rolled = combos.withColumn("w", F.col("work_id")).rollup("w", *LEVELS).agg(n.alias("n"), _status_class(n, final, queued).alias("class"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, 4).when(F.col("g") == 1, 3).when(F.col("g") == 3, 2).when(F.col("g") == 7, 1).otherwise(0)
    return rolled.withColumn("level", level).where("level > 0").select(F.col("w").alias("work_id"), *LEVELS, "level", "n", "class")


def execution_class(status: str = "status") -> Column:
    return F.when(is_final(status), "finished").when(F.col(status) == "queued", "queued").otherwise("running")


def execution_lists(executions: DataFrame) -> DataFrame:
    """The ids of each class for each combination."""
    rows = executions.withColumn("class", execution_class())
    return rows.groupBy("combination_id", "class").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def global_stats(combos: DataFrame, executions: DataFrame) -> DataFrame:
    """Per work: sequences wanted, executions finished, their ratio (0 if none wanted)."""
    wanted = combos.groupBy("work_id").agg(F.coalesce(F.sum("total_sequences"), F.lit(0)).alias("total"))
    done = with_combinations(executions, combos).where(is_final()).groupBy("work_id").agg(F.count(F.lit(1)).alias("finished"))
    out = wanted.join(done, "work_id", "left").fillna(0, ["finished"])
    return out.withColumn("progress", F.coalesce(F.try_divide("finished", "total"), F.lit(0.0)))


def with_combinations(executions: DataFrame, combos: DataFrame) -> DataFrame:
    """Executions with the keys of their combination."""
    keys = combos.select(F.col("id").alias("combination_id"), "work_id", *LEVELS)
    return executions.join(keys, "combination_id")


def progress_chain(progress: DataFrame, executions: DataFrame, combos: DataFrame) -> DataFrame:
    """Progress rows with their execution's unit and their combination's keys."""
    runs = executions.select(F.col("id").alias("execution_id"), "unit_id", "combination_id")
    return with_combinations(progress.join(runs, "execution_id"), combos)


def progress_summary(combos: DataFrame, executions: DataFrame) -> DataFrame:
    """Per work: the current combination, how many of each class at its levels, global progress."""
    current = running_combination(combos).select("work_id", F.col("id").alias("current_id"), *[F.col(k).alias(f"current_{k}") for k in LEVELS])
    levels = all_level_status(combos).groupBy("work_id", "level").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("finished", "running", "queued")], F.count(F.lit(1)).alias("total"))
    tally = levels.groupBy("work_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", F.struct("finished", "running", "queued", "total").alias("t"))))).alias("levels"))
    return global_stats(combos, executions).join(tally, "work_id").join(current, "work_id", "left")


def combination_counts(combos: DataFrame) -> DataFrame:
    return combos.groupBy("work_id", "status").agg(F.count(F.lit(1)).alias("n"))


def execution_counts(combos: DataFrame, executions: DataFrame) -> DataFrame:
    return with_combinations(executions, combos).groupBy("work_id", "status").agg(F.count(F.lit(1)).alias("n"))


def execution_stats(combos: DataFrame, executions: DataFrame) -> DataFrame:
    """Counts by class, failed with error, and all."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return with_combinations(executions, combos).groupBy("work_id").agg(of("completed").alias("completed"), of("running").alias("running"), of("queued").alias("queued"), of("failed", "error").alias("failed"), F.count(F.lit(1)).alias("total"))


def combination_progress(combos: DataFrame, executions: DataFrame) -> DataFrame:
    """Finished executions over all of a combination; 0 without any."""
    done = executions.groupBy("combination_id").agg(F.avg(is_final().cast("double")).alias("progress"))
    return combos.join(done, combos.id == done.combination_id, "left").select("id", F.coalesce("progress", F.lit(0.0)).alias("progress"))


def event_summary(events: DataFrame) -> DataFrame:
    """Counts of each type for each category."""
    return events.groupBy("event_category").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])


def combination_tally(combos: DataFrame) -> DataFrame:
    return combos.groupBy("work_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


# ------------------------------------------------------------------ windows and top-k


def running_combination(combos: DataFrame) -> DataFrame:
    """The first running combination of each work, by its keys."""
    rows = combos.where("status = 'running'")
    best = rows.groupBy("work_id").agg(F.min(F.struct(*LEVELS, "id")).alias("b"))
    return best.select("work_id", "b.*")


def next_incomplete(combos: DataFrame) -> DataFrame:
    """Paused (latest) before queued (earliest), failed or error (latest), canceled (latest)."""
    s = F.col("status")
    rank = F.when(s == "paused", 0).when(s == "queued", 1).when(s.isin("failed", "error"), 2).when(s == "canceled", 3)
    rows = combos.withColumn("rank", rank).where("rank is not null")
    best = rows.groupBy("work_id").agg(F.min(F.struct("rank", F.when(s == "queued", F.col("id")).otherwise(-F.col("id")).alias("o"), "id", "status")).alias("b"))
    return best.select("work_id", "b.id", "b.status")


def latest_progress(progress: DataFrame) -> DataFrame:
    """Each execution's newest progress row; the larger id of equal times."""
    best = progress.groupBy("execution_id").agg(F.max(F.struct("ts", "id", "progress")).alias("b"))
    return best.select("execution_id", "b.progress", "b.ts")


def execution_details(executions: DataFrame, combos: DataFrame, progress: DataFrame) -> DataFrame:
    """Executions with keys and newest progress, and a message by status."""
    rows = with_combinations(executions, combos).join(latest_progress(progress).withColumnRenamed("execution_id", "id"), "id", "left")
    result = F.col("result_json") if "result_json" in executions.columns else F.lit(None).cast("string")
    text = F.when(F.col("status") == "completed", F.concat(F.lit("Objective: "), F.round("objective", 2).cast("decimal(18,2)").cast("string"))).when(F.col("status").isin("failed", "error"), error_text(result))
    return rows.withColumn("progress", F.coalesce("progress", F.lit(0.0))).withColumn("message", text)


def error_text(result: Column) -> Column:
    return F.coalesce(F.get_json_object(result, "$.error_message"), F.get_json_object(result, "$.error"), F.lit("Unknown error"))


def newest(rows: DataFrame, time: str, k: int, *ties: str) -> DataFrame:
    """The k newest rows of all: a top-k, no sort of the table."""
    return rows.orderBy(F.desc(time), *[F.desc(t) for t in ties]).limit(k)


def newest_by(rows: DataFrame, key: str, time: str, k: int, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def progress_history(progress: DataFrame, executions: DataFrame, k: int | None = None) -> DataFrame:
    """Each unit's progress rows, newest first (``rank`` 1), at most k of them."""
    rows = progress.join(executions.select(F.col("id").alias("execution_id"), "unit_id"), "execution_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("ts"), F.desc("id"))))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def events_of(events: DataFrame, field: str, value) -> DataFrame:
    """Events whose JSON names this value, such as a unit's id."""
    return events.where(F.get_json_object("entity_data_json", f"$.{field}") == F.lit(str(value)))


def next_queued(combos: DataFrame) -> DataFrame:
    return combos.where("status = 'queued'").groupBy("work_id").agg(F.min("id").alias("id"))


def elapsed(rows: DataFrame, now: Column) -> DataFrame:
    return rows.withColumn("elapsed", F.coalesce("finished_at", now) - F.col("started_at"))


# ------------------------------------------------------------------ listings

_COMPARE = {
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "ne": lambda c, v: c != v,
    "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v), "in": lambda c, v: c.isin(*v),
}


def predicate(df: DataFrame, filters: dict) -> Column:
    """Values are equal, lists are any of, dicts hold comparisons; unknown fields are ignored."""
    out = F.lit(True)
    for name, want in filters.items():
        if name not in df.columns:
            continue
        col = F.col(name)
        if isinstance(want, dict):
            for op, value in want.items():
                out &= _COMPARE[op](col, value)
        elif isinstance(want, (list, tuple, set)):
            out &= col.isin(*want)
        else:
            out &= col.eqNullSafe(F.lit(want))
    return out


def list_rows(df: DataFrame, filters: dict | None = None, order_by: str | None = None, desc: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A filtered, ordered page."""
    rows = df.where(predicate(df, filters or {}))
    if order_by in df.columns:
        rows = rows.orderBy(F.desc(order_by) if desc else F.asc(order_by))
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def total(df: DataFrame, filters: dict | None = None) -> DataFrame:
    return df.where(predicate(df, filters or {})).agg(F.count(F.lit(1)).alias("total"))


def search_works(works: DataFrame, status: str | None = None, author: str | None = None, tags: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Works by status, author part, any of the tags, and free text over the metadata."""
    meta = lambda k: F.get_json_object("config_json", f"$.metadata.{k}")
    own = F.coalesce(F.from_json(meta("tags"), "array<string>"), F.array().cast("array<string>"))
    rows = works.where(F.col("status") == status) if status else works
    if author:
        rows = rows.where(F.lower(meta("author")).contains(author.lower()))
    if tags:
        rows = rows.where(F.arrays_overlap(F.transform(own, F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    if text:
        hay = F.lower(F.concat_ws(" ", "id", meta("name"), meta("description"), meta("author"), F.array_join(own, " ")))
        rows = rows.where(hay.contains(text.lower()))
    return rows


def of_work(child: DataFrame, parent: DataFrame, on: Column) -> DataFrame:
    """Rows of a child table that some row of ``parent`` owns."""
    return child.join(parent, on, "left_semi")


def work_tables(work_id: str, combos: DataFrame, executions: DataFrame, progress: DataFrame, events: DataFrame, sequences: DataFrame) -> dict[str, DataFrame]:
    """All that one work owns, by table."""
    own = combos.where(F.col("work_id") == work_id)
    runs = of_work(executions, own.select(F.col("id").alias("of")), F.col("combination_id") == F.col("of"))
    steps = of_work(progress, runs.select(F.col("id").alias("of")), F.col("execution_id") == F.col("of"))
    seqs = of_work(sequences, own.select(F.col("dataset_id").alias("of")), F.col("dataset_id") == F.col("of"))
    return {"combinations": own, "executions": runs, "execution_progress": steps, "events": events.where(F.col("work_id") == work_id), "sequences": seqs}


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no row of ``others``."""
    return rows.join(others.select(key), key, "left_anti")


def among(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in some row of ``others``."""
    return rows.join(others.select(key), key, "left_semi")


def with_prefix(executions: DataFrame, mode: str) -> DataFrame:
    """Executions of a mode; the prefix reaches the Parquet scan."""
    return executions.where(F.col("unit_id").startswith(f"{mode}:"))


# ------------------------------------------------------------------ writes


def bulk_insert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``new`` that go in: the first of each key that isn't there yet."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def bulk_update(df: DataFrame, filters: dict, values: dict) -> DataFrame:
    """The table with ``values`` set in the rows that match."""
    hit = predicate(df, filters)
    return df.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items() if k in df.columns})


def update_count(df: DataFrame, filters: dict) -> DataFrame:
    """How many rows `bulk_update` sets."""
    return df.where(predicate(df, filters)).agg(F.count(F.lit(1)).alias("updated"))


def normal_status(status: str | Column = "status") -> Column:
    """Trimmed and in lower case; null if it is none of the known ones."""
    s = F.lower(F.trim(F.col(status) if isinstance(status, str) else status))
    return F.when(s.isin(*STATUSES), s)


def may_move(old: Column, new: Column) -> Column:
    return F.coalesce(F.array_contains(F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])[old], new), F.lit(False))


def apply_moves(rows: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``moves(id, new_status, at)`` -> the table after the allowed ones, and the refused ones.

    Several moves of a row are tried in the order of ``at``. A row that doesn't move keeps its
    ``updated_at``, which is null in a table without that column; moves without a status are none.
    """
    tried = moves.where("new_status is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "new_status"))).alias("tried"))
    held = rows if "updated_at" in rows.columns else rows.withColumn("updated_at", F.lit(None).cast(dict(moves.dtypes)["at"]))
    refusal = "array<struct<status:string,new_status:string>>"
    start = F.struct("status", F.col("updated_at").cast(dict(moves.dtypes)["at"]).alias("updated_at"), F.array().cast(refusal).alias("refused"))

    def step(now: Column, move: Column) -> Column:
        ok = may_move(now["status"], move["new_status"])
        moved = F.struct(move["new_status"].alias("status"), move["at"].alias("updated_at"), now["refused"].alias("refused"))
        stays = F.struct(now["status"].alias("status"), now["updated_at"].alias("updated_at"), F.concat(now["refused"], F.array(F.struct(now["status"].alias("status"), move["new_status"].alias("new_status")))).alias("refused"))
        return F.when(ok, moved).otherwise(stays)

    both = held.join(tried, "id", "left").withColumn("end", F.when(F.col("tried").isNull(), start).otherwise(F.aggregate("tried", start, step)))
    refused = both.select("id", F.explode("end.refused").alias("r")).select("id", "r.status", "r.new_status")
    return both.withColumns({"status": F.col("end.status"), "updated_at": F.col("end.updated_at")}).drop("tried", "end"), refused


def status_times(changes: DataFrame) -> DataFrame:
    """``changes(id, status, ts)`` -> first time running, first time final."""
    return changes.groupBy("id").agg(F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.min(F.when(is_final(), F.col("ts"))).alias("finished_at"))


def cascade(gone: DataFrame, combos: DataFrame, executions: DataFrame, progress: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The child tables without what the works ``gone(work_id)`` own."""
    lost = combos.join(gone, "work_id", "left_semi").select(F.col("id").alias("combination_id"))
    runs = executions.join(lost, "combination_id", "left_semi").select(F.col("id").alias("execution_id"))
    return combos.join(gone, "work_id", "left_anti"), executions.join(lost, "combination_id", "left_anti"), progress.join(runs, "execution_id", "left_anti")


def clear_open_progress(progress: DataFrame, executions: DataFrame, combos: DataFrame | None = None, work_id: str | None = None, combination_id: int | None = None, execution_id: int | None = None) -> DataFrame:
    """Progress without the rows of executions that aren't final: all, or those of a work, a combination or an execution."""
    open_ = executions.where(~is_final())
    if execution_id is not None:
        open_ = open_.where(F.col("id") == execution_id)
    if combination_id is not None:
        open_ = open_.where(F.col("combination_id") == combination_id)
    if work_id is not None:
        of = combos.where(F.col("work_id") == work_id).select(F.col("id").alias("combination_id"))
        open_ = open_.join(of, "combination_id", "left_semi")
    open_ = open_.select(F.col("id").alias("execution_id"))
    return progress.join(open_, "execution_id", "left_anti")


def requeue(combos: DataFrame) -> DataFrame:
    return bulk_update(combos, {"status": ["running", "paused", "canceled"]}, {"status": "queued"})


def reset(rows: DataFrame) -> DataFrame:
    """Running and paused rows queued again, without times, objective and result."""
    hit = F.col("status").isin("running", "paused")
    empty = {"started_at": None, "finished_at": None, "objective": None, "result_json": "{}"}
    cols = {k: F.when(hit, F.lit(v).cast(dict(rows.dtypes)[k])).otherwise(F.col(k)) for k, v in empty.items() if k in rows.columns}
    return rows.withColumns(cols | {"status": F.when(hit, F.lit("queued")).otherwise(F.col("status"))})


def event_rows(rows: DataFrame, event_type: str, category: str, context: Column, **payload: Column) -> DataFrame:
    """Event rows whose JSON has the context's entries beside the payload's."""
    if event_type not in EVENT_TYPES or category not in EVENT_CATEGORIES:
        raise ValueError(f"unknown event {event_type}/{category}")
    own = F.create_map(*[x for k, v in payload.items() for x in (F.lit(k), v.cast("string"))]) if payload else F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(context, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    return rows.select("work_id", F.lit(event_type).alias("event_type"), F.lit(category).alias("event_category"), F.to_json(both).alias("entity_data_json"), "ts")
