"""Registered queries on the run ledger, experiments and feeds, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as exp
from ..operators import ledger as led
from ..sources import store, synthetic
from ..streaming import feeds
from .views import Views

_FINAL = "status IN ('completed','failed','error')"
_CLASS = f"CASE WHEN count(*) FILTER ({_FINAL}) = count(*) THEN 'finished' WHEN count(*) FILTER (status = 'queued') = count(*) THEN 'queued' ELSE 'running' END"
LEVELS = ["task_id", "dataset_id", "preset_id", "algorithm_id"]


def _level(depth: int) -> str:
    keys = ", ".join(["work_id", *LEVELS[:depth]])
    return f"SELECT {keys}, count(*) AS n, {_CLASS} AS class FROM combos GROUP BY {keys}"


def _units(v: Views):
    tasks = v.combinations.groupBy("task_id").agg(F.array_sort(F.collect_set("dataset_id")).alias("datasets"), F.array_sort(F.collect_set("preset_id")).alias("presets"), (F.count(F.lit(1)) % 3 + 1).cast("int").alias("total"))
    tasks = tasks.withColumns({"mode": F.lit("experiment"), "seed": F.lit(100).cast("long"), "seed_increment": F.lit(True)})
    presets = v.combinations.select("preset_id", "algorithm_id").distinct().withColumn("params", F.create_map().cast("map<string,string>"))
    return tasks, presets


_UNITS = "tasks AS (SELECT task_id, count(*) % 3 + 1 AS total FROM combos GROUP BY task_id), cmb AS (SELECT DISTINCT c.task_id, c.dataset_id, p.preset_id, q.algorithm_id, total AS total_sequences FROM combos c JOIN combos p USING (task_id) JOIN (SELECT DISTINCT preset_id, algorithm_id FROM combos) q ON p.preset_id = q.preset_id JOIN tasks ON tasks.task_id = c.task_id)"


def _points(v: Views):
    rows = v.table("lineitem").select("l_returnflag", F.col("l_extendedprice").alias("objective"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"))
    return rows.unpivot(["l_returnflag", "objective"], ["l_discount", "l_tax", "l_quantity"], "param", "value")


_POINTS = "pts AS (UNPIVOT (SELECT l_returnflag, l_extendedprice AS objective, l_discount, l_tax, l_quantity FROM lineitem) ON l_discount, l_tax, l_quantity INTO NAME param VALUE value)"


def _snapshots(v: Views):
    """The ledger as of two times: later it has newer runs, and the oldest are gone."""
    old = v.executions.where("started_at < '1999-01-01'").select("unit_id", F.when(F.col("status") == "completed", "running").otherwise(F.col("status")).alias("status"), "objective")
    return old, v.executions.where("started_at >= '1994-01-01'").select("unit_id", "status", "objective")


def _moves(v: Views):
    rows = v.progress.select(F.col("execution_id").alias("id"), F.when(F.col("progress") > 0.5, "completed").when(F.col("progress") > 0.2, "running").otherwise("queued").alias("status"), "ts", F.col("id").alias("line"))
    return rows.groupBy("id", "ts").agg(F.max("status").alias("status"))


_MOVES = "mv AS (SELECT execution_id AS id, ts, max(CASE WHEN progress > 0.5 THEN 'completed' WHEN progress > 0.2 THEN 'running' ELSE 'queued' END) AS status FROM prog GROUP BY ALL)"
_STATS = "SELECT work_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status IN ('failed','error')) AS failed, count(*) AS total FROM ecombos GROUP BY work_id"
_PAGE = {"status": ["queued", "running"], "total_sequences": {"gte": 11, "lt": 13}, "task_id": {"like": "%E"}, "nowhere": 1}


def _two_moves(v: Views):
    """To running, then to completed, for all combinations."""
    ends = F.explode(F.array(F.struct(F.lit("completed").alias("new_status"), F.lit(2.0).alias("at")), F.struct(F.lit("running").alias("new_status"), F.lit(1.0).alias("at"))))
    return v.combinations.select("id", ends.alias("m")).select("id", "m.*")


_EVENT_SPREAD = ["error", "progress", "warning"]

#: The fold of T1: each row is compared with the last that passed.
_THROTTLED = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY ts, id, progress) AS n FROM prog),
    f AS (SELECT execution_id, n, ts, progress, ts AS last_ts, progress AS last_progress, TRUE AS passed FROM o WHERE n = 1
          UNION ALL SELECT o.execution_id, o.n, o.ts, o.progress, CASE WHEN g.go THEN o.ts ELSE f.last_ts END, CASE WHEN g.go THEN o.progress ELSE f.last_progress END, g.go
          FROM f JOIN o ON o.execution_id = f.execution_id AND o.n = f.n + 1, LATERAL (SELECT o.progress - f.last_progress >= 0.15::DOUBLE AND o.ts - f.last_ts >= 86400 AS go) g)
    SELECT execution_id, ts, progress FROM f WHERE passed"""
_SNAPSHOTS = """WITH o AS (SELECT l_orderkey::VARCHAR AS unit_id, l_shipdate::TIMESTAMP AS ts, min(CASE l_returnflag WHEN 'A' THEN 'queued' WHEN 'N' THEN 'running' ELSE 'completed' END) AS status FROM lineitem GROUP BY ALL),
    s AS (SELECT *, lag(ts) OVER w AS old_ts, lag(status) OVER w AS old_status, lead(ts) OVER w AS next FROM o WINDOW w AS (PARTITION BY unit_id ORDER BY ts)),
    c AS (SELECT unit_id, ts, CASE WHEN old_ts IS NULL OR ts - old_ts > INTERVAL 30 DAY THEN 'new' WHEN status = 'completed' AND old_status <> 'completed' THEN 'completed' WHEN status <> old_status THEN 'updated' END AS change FROM s)
    SELECT * FROM c WHERE change IS NOT NULL
    UNION ALL SELECT unit_id, ts + INTERVAL 30 DAY, 'removed' FROM s WHERE coalesce(next - ts > INTERVAL 30 DAY, ts + INTERVAL 30 DAY < (SELECT max(ts) FROM o) - INTERVAL 1 DAY)"""
_FEED = """WITH r AS (SELECT work_id, epoch(started_at)::DOUBLE AS ts, CASE WHEN status <> 'queued' THEN (combination_id % 2)::VARCHAR END AS c, CASE WHEN status <> 'queued' THEN unit_id END AS unit_id, status, objective AS progress FROM ecombos),
    p AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY ts, c NULLS FIRST, unit_id NULLS FIRST, status, progress NULLS FIRST) AS pos FROM r),
    b AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM p),
    n AS (SELECT *, c IS NOT NULL AND c IS DISTINCT FROM previous AS opens FROM b),
    q AS (SELECT *, sum(opens::INT) OVER (PARTITION BY work_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n),
    e AS (SELECT work_id, run, min(pos) AS stop, min_by(ts, pos) AS at FROM q WHERE c IS NULL GROUP BY ALL UNION ALL SELECT work_id, run - 1, pos, ts FROM q WHERE opens)
    SELECT work_id, ts, 'changed' AS event, previous, c AS combination_id, NULL::VARCHAR AS unit_id, NULL::VARCHAR AS status, NULL::DOUBLE AS progress FROM q WHERE opens
    UNION ALL SELECT q.work_id, e.at, 'flush', NULL, q.c, q.unit_id, max_by(q.status, q.pos), arg_max_null(q.progress, q.pos) FROM q JOIN e ON q.work_id = e.work_id AND q.run = e.run AND q.pos < e.stop AND q.c IS NOT NULL GROUP BY q.work_id, e.stop, e.at, q.c, q.unit_id"""

QUERIES = {
    # ---- tallies
    "a1_task_status": (lambda v: led.level_status(v.combinations, 1), _level(1)),
    "a2_dataset_status": (lambda v: led.level_status(v.combinations, 2), _level(2)),
    "a3_preset_status": (lambda v: led.level_status(v.combinations, 3), _level(3)),
    "a4_algorithm_status": (lambda v: led.level_status(v.combinations, 4), _level(4)),
    "a1_a4_rollup": (lambda v: led.all_level_status(v.combinations), " UNION ALL ".join(f"SELECT work_id, task_id, {', '.join(k if i < d else 'NULL AS ' + k for i, k in enumerate(LEVELS) if i > 0)}, {d} AS level, count(*) AS n, {_CLASS} AS class FROM combos GROUP BY work_id, {', '.join(LEVELS[:d])}" for d in (1, 2, 3, 4))),
    "a5_execution_lists": (lambda v: led.execution_lists(v.executions).withColumn("ids", F.array_join("ids", ",")), f"SELECT combination_id, CASE WHEN {_FINAL} THEN 'finished' WHEN status = 'queued' THEN 'queued' ELSE 'running' END AS class, string_agg(id, ',' ORDER BY id) AS ids FROM execs GROUP BY ALL"),
    "a6_global_stats": (lambda v: led.global_stats(v.combinations, v.executions), f"WITH t AS (SELECT work_id, sum(total_sequences)::BIGINT AS total FROM combos GROUP BY ALL), f AS (SELECT work_id, count(*) AS finished FROM ecombos WHERE {_FINAL} GROUP BY ALL) SELECT work_id, total, coalesce(finished, 0) AS finished, coalesce(finished, 0) / total AS progress FROM t LEFT JOIN f USING (work_id)"),
    "a7_summary": (lambda v: led.progress_summary(v.combinations, v.executions).select("work_id", "total", "finished", "progress", "current_id", F.col("levels")[1]["total"].alias("tasks"), F.col("levels")[4]["finished"].alias("finished_algorithms")), f"WITH t AS (SELECT work_id, sum(total_sequences)::BIGINT AS total, count(DISTINCT task_id) AS tasks FROM combos GROUP BY ALL), f AS (SELECT work_id, count(*) AS finished FROM ecombos WHERE {_FINAL} GROUP BY ALL), c AS (SELECT work_id, id AS current_id FROM combos WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY task_id, dataset_id, preset_id, algorithm_id, id) = 1), l AS (SELECT work_id, count(*) FILTER (class = 'finished') AS finished_algorithms FROM ({_level(4)}) GROUP BY ALL) SELECT work_id, total, finished, finished / total AS progress, current_id, tasks, finished_algorithms FROM t JOIN f USING (work_id) JOIN l USING (work_id) LEFT JOIN c USING (work_id)"),
    "a8_combination_counts": (lambda v: led.combination_counts(v.combinations), "SELECT work_id, status, count(*) AS n FROM combos GROUP BY ALL"),
    "a9_execution_counts": (lambda v: led.execution_counts(v.combinations, v.executions), "SELECT work_id, status, count(*) AS n FROM ecombos GROUP BY ALL"),
    "a10_execution_stats": (lambda v: led.execution_stats(v.combinations, v.executions), _STATS),
    "a11_combination_progress": (lambda v: led.combination_progress(v.combinations, v.executions), f"WITH p AS (SELECT combination_id, avg(({_FINAL})::INT) AS p FROM execs GROUP BY ALL) SELECT id, coalesce(p, 0) AS progress FROM combos LEFT JOIN p ON id = combination_id"),
    "a12_event_summary": (lambda v: led.event_summary(v.run_events), "SELECT event_category, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _EVENT_SPREAD) + " FROM evts GROUP BY ALL"),
    "a13_tally": (lambda v: led.combination_tally(v.combinations), "SELECT work_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in led.STATUSES) + " FROM combos GROUP BY ALL"),
    # ---- joins
    "j1_executions_with_keys": (lambda v: led.with_combinations(v.executions, v.combinations).select("id", "work_id", "task_id", "status"), "SELECT id, work_id, task_id, status FROM ecombos"),
    "j2_progress_chain": (lambda v: led.progress_chain(v.progress, v.executions, v.combinations).groupBy("work_id", "task_id").agg(F.count(F.lit(1)).alias("n"), F.max("progress").alias("most")), "SELECT work_id, task_id, count(*) AS n, max(progress) AS most FROM prog JOIN ecombos e ON prog.execution_id = e.id GROUP BY ALL"),
    "j3_of_work": (lambda v: led.of_work(v.executions, v.combinations.where("work_id = 'w1'").select(F.col("id").alias("cid")), F.col("combination_id") == F.col("cid")).select("id", "unit_id"), "SELECT id, unit_id FROM execs WHERE combination_id IN (SELECT id FROM combos WHERE work_id = 'w1')"),
    "j4_pending": (lambda v: exp.pending(v.executions.select("unit_id"), v.executions), f"SELECT unit_id FROM execs WHERE NOT {_FINAL}"),
    "j6_cross": (lambda v: exp.spec_summary(v.combinations), "SELECT count(DISTINCT algorithm_id) AS algorithms, count(DISTINCT dataset_id) AS datasets, count(*) AS combinations FROM combos"),
    # ---- windows and top-k
    "w1_running": (lambda v: led.running_combination(v.combinations), "SELECT work_id, task_id, dataset_id, preset_id, algorithm_id, id FROM combos WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY task_id, dataset_id, preset_id, algorithm_id, id) = 1"),
    "w2_next_incomplete": (lambda v: led.next_incomplete(v.combinations), "SELECT work_id, id, status FROM combos WHERE status IN ('paused','queued','failed','error','canceled') QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY CASE status WHEN 'paused' THEN 0 WHEN 'queued' THEN 1 WHEN 'canceled' THEN 3 ELSE 2 END, CASE WHEN status = 'queued' THEN id ELSE -id END) = 1"),
    "w3_latest_progress": (lambda v: led.latest_progress(v.progress), "SELECT execution_id, progress, ts FROM prog QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY ts DESC, id DESC, progress DESC) = 1"),
    "w4_details": (lambda v: led.execution_details(v.executions, v.combinations, v.progress).select("id", "work_id", "progress", "message"), "WITH lp AS (SELECT execution_id, progress FROM prog QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY ts DESC, id DESC, progress DESC) = 1) SELECT e.id, work_id, coalesce(progress, 0) AS progress, CASE WHEN status = 'completed' THEN 'Objective: ' || round(objective, 2)::DECIMAL(18,2) WHEN status IN ('failed','error') THEN 'Unknown error' END AS message FROM ecombos e LEFT JOIN lp ON e.id = lp.execution_id"),
    "w5_newest_running": (lambda v: led.newest(v.executions.where("status = 'running'"), "started_at", 20, "id").select("id", "unit_id"), "SELECT id, unit_id FROM execs WHERE status = 'running' ORDER BY started_at DESC, id DESC LIMIT 20"),
    "w6_newest_errors": (lambda v: led.newest(v.executions.where("status IN ('failed','error')"), "started_at", 10, "id").select("id", led.error_text(F.lit(None).cast("string")).alias("message")), "SELECT id, 'Unknown error' AS message FROM execs WHERE status IN ('failed','error') ORDER BY started_at DESC, id DESC LIMIT 10"),
    "w7_newest_warnings": (lambda v: led.newest(v.run_events.where("event_type = 'warning'"), "ts", 10, "id").select("id", F.get_json_object("entity_data_json", "$.k").alias("k")), "SELECT id, json_extract_string(entity_data_json, '$.k') AS k FROM evts WHERE event_type = 'warning' ORDER BY ts DESC, id DESC LIMIT 10"),
    "w8_newest_events": (lambda v: led.newest(v.run_events, "ts", 100, "id").select("id", "event_type"), "SELECT id, event_type FROM evts ORDER BY ts DESC, id DESC LIMIT 100"),
    "w9_newest_by_category": (lambda v: led.newest_by(v.run_events, "event_category", "ts", 3, "id").select("event_category", "id", "rank"), "SELECT event_category, id, row_number() OVER (PARTITION BY event_category ORDER BY ts DESC, id DESC) AS rank FROM evts QUALIFY rank <= 3"),
    "w9_unit_events": (lambda v: led.events_of(v.run_events, "k", 7).select("id", "work_id"), "SELECT id, work_id FROM evts WHERE json_extract_string(entity_data_json, '$.k') = '7'"),
    "w9_progress_history": (lambda v: led.progress_history(v.progress, v.executions, 3).groupBy("unit_id").agg(F.max("progress").alias("most"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest")), "SELECT unit_id, max(progress) AS most, count(*) AS n, max(ts) AS newest FROM (SELECT p.*, e.unit_id FROM prog p JOIN execs e ON p.execution_id = e.id QUALIFY row_number() OVER (PARTITION BY e.unit_id ORDER BY p.ts DESC, p.id DESC) <= 3) GROUP BY unit_id"),
    "w10_next_queued": (lambda v: led.next_queued(v.combinations), "SELECT work_id, min(id) AS id FROM combos WHERE status = 'queued' GROUP BY ALL"),
    "w11_elapsed": (lambda v: led.elapsed(v.progress.groupBy("execution_id").agg(F.min("ts").alias("started_at"), F.max(F.when(F.col("progress") > 0.4, F.col("ts"))).alias("finished_at")), F.lit(1.0e9)).select("execution_id", "elapsed"), "SELECT execution_id, coalesce(max(ts) FILTER (progress > 0.4), 1.0e9) - min(ts) AS elapsed FROM prog GROUP BY ALL"),
    # ---- listings
    "o1_page": (lambda v: led.list_rows(v.combinations, _PAGE, "id", True, 5, 20), "SELECT * FROM combos WHERE status IN ('queued','running') AND total_sequences >= 11 AND total_sequences < 13 AND task_id LIKE '%E' ORDER BY id DESC LIMIT 20 OFFSET 5"),
    "o1_total": (lambda v: led.total(v.combinations, _PAGE), "SELECT count(*) AS total FROM combos WHERE status IN ('queued','running') AND total_sequences >= 11 AND total_sequences < 13 AND task_id LIKE '%E'"),
    "o5_active": (lambda v: led.list_rows(v.combinations, {"status": ["queued", "running", "paused"]}), "SELECT * FROM combos WHERE status IN ('queued','running','paused')"),
    "o7_prefix": (lambda v: led.with_prefix(v.executions, "optimization").select("unit_id", "status"), "SELECT unit_id, status FROM execs WHERE unit_id LIKE 'optimization:%'"),
    "o8_json_events": (lambda v: v.run_events.where(F.get_json_object("entity_data_json", "$.k").cast("int") > 50).select("id", "ts"), "SELECT id, ts FROM evts WHERE json_extract_string(entity_data_json, '$.k')::INT > 50"),
    "o9_difference": (lambda v: v.combinations.select("id").exceptAll(v.executions.select(F.col("combination_id").alias("id")).distinct()), "SELECT id FROM combos EXCEPT SELECT combination_id FROM execs"),
    "o2_all_rows": (lambda v: led.list_rows(v.executions), "SELECT * FROM execs"),
    "o3_point": (lambda v: led.list_rows(v.executions, {"id": 7}), "SELECT * FROM execs WHERE id = 7"),
    "o4_filtered": (lambda v: led.list_rows(v.combinations, {"status": {"ne": "queued"}, "task_id": {"ilike": "%machinery%"}, "total_sequences": {"in": [10, 12]}}), "SELECT * FROM combos WHERE status <> 'queued' AND task_id ILIKE '%machinery%' AND total_sequences IN (10, 12)"),
    "o6_work_tables": (lambda v: store.manifest({k: t.select(t.columns[0]) for k, t in led.work_tables("w2", v.combinations, v.executions, v.progress, v.run_events, v.names.withColumn("dataset_id", F.concat(F.lit("d"), F.col("seq_index") % 40))).items()}).drop("n_columns"), "SELECT 'combinations' AS table_name, count(*) AS n_rows FROM combos WHERE work_id = 'w2' UNION ALL SELECT 'executions', count(*) FROM ecombos WHERE work_id = 'w2' UNION ALL SELECT 'execution_progress', count(*) FROM prog WHERE execution_id IN (SELECT id FROM ecombos WHERE work_id = 'w2') UNION ALL SELECT 'events', count(*) FROM evts WHERE work_id = 'w2' UNION ALL SELECT 'sequences', count(*) FROM names WHERE 'd' || seq_index % 40 IN (SELECT dataset_id FROM combos WHERE work_id = 'w2')"),
    "o9_without": (lambda v: led.without(v.combinations.select("id"), v.executions.where("status = 'completed'").select(F.col("combination_id").alias("id")), "id"), "SELECT id FROM combos WHERE id NOT IN (SELECT combination_id FROM execs WHERE status = 'completed')"),
    "o9_among": (lambda v: led.among(v.combinations.select("id"), v.executions.where("status = 'completed'").select(F.col("combination_id").alias("id")), "id"), "SELECT id FROM combos INTERSECT SELECT combination_id FROM execs WHERE status = 'completed'"),
    "p13_search": (lambda v: led.search_works(_works(v), author="segment", tags=["D3", "d5"], text="machinery").select("id", "status"), "WITH w AS (SELECT task_id || '-' || work_id AS id, min(status) AS status, list(DISTINCT dataset_id) AS tags FROM combos GROUP BY task_id, work_id) SELECT id, status FROM w WHERE (list_contains(tags, 'd3') OR list_contains(tags, 'd5')) AND lower(id) LIKE '%machinery%'"),
    # ---- writes
    "m1_bulk_insert": (lambda v: led.bulk_insert(v.combinations.where("status = 'completed'"), v.combinations, ["work_id", "task_id", "dataset_id", "preset_id", "algorithm_id"], "id").select("id"), "WITH n AS (SELECT work_id, task_id, dataset_id, preset_id, algorithm_id, min(id) AS id FROM combos GROUP BY ALL) SELECT n.id FROM n WHERE NOT EXISTS (SELECT 1 FROM combos c WHERE c.status = 'completed' AND (c.work_id, c.task_id, c.dataset_id, c.preset_id, c.algorithm_id) = (n.work_id, n.task_id, n.dataset_id, n.preset_id, n.algorithm_id))"),
    "m2_bulk_update": (lambda v: led.bulk_update(v.combinations, {"status": ["failed", "error"]}, {"status": "queued", "total_sequences": 0}), "SELECT * REPLACE (CASE WHEN status IN ('failed','error') THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('failed','error') THEN 0 ELSE total_sequences END AS total_sequences) FROM combos"),
    "m3_moves": (lambda v: led.apply_moves(v.combinations, v.combinations.select("id", F.lit("running").alias("new_status"), F.lit(1.0).alias("at")))[0].select("id", "status", "updated_at"), "SELECT id, CASE WHEN status IN ('queued','paused') THEN 'running' ELSE status END AS status, CASE WHEN status IN ('queued','paused') THEN 1.0::DOUBLE END AS updated_at FROM combos"),
    "m3_moves_in_order": (lambda v: led.apply_moves(v.combinations.withColumn("updated_at", F.col("id").cast("double")), _two_moves(v))[0].select("id", "status", "updated_at"), "SELECT id, CASE WHEN status IN ('queued','paused','running') THEN 'completed' ELSE status END AS status, CASE WHEN status IN ('queued','paused','running') THEN 2.0::DOUBLE ELSE id::DOUBLE END AS updated_at FROM combos"),
    "m3_refused_in_order": (lambda v: led.apply_moves(v.combinations, _two_moves(v))[1].groupBy("id").count().withColumnRenamed("count", "n"), "SELECT id, CASE WHEN status = 'running' THEN 1 ELSE 2 END::BIGINT AS n FROM combos WHERE status NOT IN ('queued','paused')"),
    "m3_refused": (lambda v: led.apply_moves(v.combinations, v.combinations.select("id", F.lit("running").alias("new_status"), F.lit(1.0).alias("at")))[1], "SELECT id, status, 'running' AS new_status FROM combos WHERE status NOT IN ('queued','paused')"),
    "m4_normal_status": (lambda v: v.table("events").select("event_id", led.normal_status(F.concat(F.lit("  "), F.upper("event_type"))).alias("status")), "SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('queued','running','paused','canceled','completed','failed','error') THEN lower(trim(event_type)) END AS status FROM events"),
    "m5_status_times": (lambda v: led.status_times(_moves(v)), f"WITH {_MOVES} SELECT id, min(ts) FILTER (status = 'running') AS started_at, min(ts) FILTER ({_FINAL}) AS finished_at FROM mv GROUP BY id"),
    "m6_cascade": (lambda v: led.cascade(v.combinations.where("work_id = 'w2'").select("work_id").distinct(), v.combinations, v.executions, v.progress)[2].groupBy("execution_id").count().withColumnRenamed("count", "n"), "SELECT execution_id, count(*) AS n FROM prog WHERE execution_id NOT IN (SELECT id FROM ecombos WHERE work_id = 'w2') GROUP BY ALL"),
    "m7_clear_progress": (lambda v: led.clear_open_progress(v.progress, v.executions).groupBy("execution_id").count().withColumnRenamed("count", "n"), f"SELECT execution_id, count(*) AS n FROM prog WHERE execution_id NOT IN (SELECT id FROM execs WHERE NOT {_FINAL}) GROUP BY ALL"),
    "m7_clear_progress_of_work": (lambda v: led.clear_open_progress(v.progress, v.executions, v.combinations, work_id="w2").groupBy("execution_id").count().withColumnRenamed("count", "n"), f"SELECT execution_id, count(*) AS n FROM prog WHERE execution_id NOT IN (SELECT id FROM ecombos WHERE work_id = 'w2' AND NOT {_FINAL}) GROUP BY ALL"),
    "m2_update_count": (lambda v: led.update_count(v.combinations, {"status": ["failed", "error"]}), "SELECT count(*) AS updated FROM combos WHERE status IN ('failed','error')"),
    "m8_requeue": (lambda v: led.requeue(v.combinations), "SELECT * REPLACE (CASE WHEN status IN ('running','paused','canceled') THEN 'queued' ELSE status END AS status) FROM combos"),
    "m9_reset": (lambda v: led.reset(v.executions), "SELECT * REPLACE (CASE WHEN status IN ('running','paused') THEN 'queued' ELSE status END AS status, CASE WHEN status NOT IN ('running','paused') THEN objective END AS objective, CASE WHEN status NOT IN ('running','paused') THEN started_at END AS started_at) FROM execs"),
    "m10_event_rows": (lambda v: led.event_rows(v.run_events, "progress", "unit", F.from_json("entity_data_json", "map<string,string>"), id=F.col("id")).select("work_id", "event_type", F.get_json_object("entity_data_json", "$.k").alias("k"), F.get_json_object("entity_data_json", "$.id").alias("id")), "SELECT work_id, 'progress' AS event_type, json_extract_string(entity_data_json, '$.k') AS k, id::VARCHAR AS id FROM evts"),
    # ---- experiments
    "x1_combinations": (lambda v: exp.combinations(*_units(v)).select("task_id", "dataset_id", "preset_id", "algorithm_id", "total_sequences"), f"WITH {_UNITS} SELECT * FROM cmb"),
    "x2_x4_units": (lambda v: exp.units(exp.combinations(*_units(v))).select("unit_id", "unit_seed"), f"WITH {_UNITS} SELECT 'experiment:' || task_id || ':' || dataset_id || ':' || preset_id || ':' || algorithm_id || ':' || r AS unit_id, 100 + r AS unit_seed FROM cmb, range(1, 4) t(r) WHERE r <= total_sequences"),
    "x5_x6_methods": (lambda v: exp.run_methods(v.dna, ["consensus"]).select("dataset_id", "method", "max_distance", "objective"), "WITH c AS (SELECT dataset_id, pos, ch, count(*) AS n FROM dchars GROUP BY ALL), b AS (SELECT dataset_id, string_agg(ch, '' ORDER BY pos) AS center FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset_id, pos ORDER BY n DESC, ch) = 1) GROUP BY ALL) SELECT dataset_id, 'consensus' AS method, max(hamming(center, sequence)) AS max_distance, max(hamming(center, sequence))::DOUBLE AS objective FROM dna JOIN b USING (dataset_id) GROUP BY ALL"),
    "x6_worst_status": (lambda v: exp.worst_status(v.executions, "combination_id"), "SELECT combination_id, CASE max(CASE status WHEN 'failed' THEN 3 WHEN 'error' THEN 2 WHEN 'completed' THEN 1 ELSE 0 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'error' WHEN 1 THEN 'completed' ELSE 'running' END AS status FROM execs GROUP BY ALL"),
    "x7_parameters": (lambda v: synthetic.sample_parameters(v.table("nation").select(F.col("n_name").alias("name"), F.lit("int").alias("kind"), F.lit(1.0).alias("low"), (F.col("n_nationkey") + 5).cast("double").alias("high"), F.lit(None).cast("double").alias("step"), F.array().cast("array<string>").alias("choices")), 40), "SELECT i AS sample, n_name AS name, (1 + floor((('0x' || substr(md5('0|' || n_name || '|' || i), 1, 8))::BIGINT / 4294967296.0) * (n_nationkey + 5)))::BIGINT::VARCHAR AS value FROM nation, range(40) t(i)"),
    "x9_sensitivity": (lambda v: exp.sensitivity(_points(v), "l_returnflag").withColumn("score", F.round("score", 6)), f"WITH {_POINTS} SELECT l_returnflag, param, round(coalesce(abs(corr(value, objective)), 0), 6) AS score, count(*) AS num_samples FROM pts GROUP BY ALL"),
    "x10_variance": (lambda v: exp.objective_variance(_points(v), "param").select("param", F.round(F.col("variance") / 1e6, 3).alias("variance")), f"WITH {_POINTS} SELECT param, round(var_samp(objective) / 1e6, 3) AS variance FROM pts GROUP BY ALL"),
    "x11_x14_scores": (lambda v: exp.sensitivity_scores(exp.score_events(exp.sensitivity(_points(v), "l_returnflag"), "corr", "2024-01-01", "l_returnflag").withColumn("unit_id", F.col("l_returnflag")).withColumn("ts", F.lit(0.0))).select("unit_id", "method", "param", F.round("score", 6).alias("score"), "num_samples"), f"WITH {_POINTS} SELECT l_returnflag AS unit_id, 'corr' AS method, param, round(abs(corr(value, objective)), 6) AS score, count(*) AS num_samples FROM pts GROUP BY ALL"),
    "x12_trials": (lambda v: exp.trials(v.executions), "SELECT unit_id, 't1|d1|' || split_part(unit_id, ':', 4) || '|' || split_part(unit_id, ':', 5) AS study, split_part(unit_id, ':', 1) AS mode, split_part(unit_id, ':', 6)::BIGINT AS trial, status, objective FROM execs"),
    "x13_best_so_far": (lambda v: exp.best_so_far(exp.trials(v.executions)), "WITH t AS (SELECT unit_id, 't1|d1|' || split_part(unit_id, ':', 4) || '|' || split_part(unit_id, ':', 5) AS study, id AS trial, objective FROM execs WHERE objective IS NOT NULL) SELECT study, trial, unit_id, objective, min(objective) OVER (PARTITION BY study ORDER BY trial, unit_id ROWS UNBOUNDED PRECEDING) AS best, count(*) OVER (PARTITION BY study) AS trial_count FROM t"),
    "x15_outcome": (lambda v: exp.outcome(v.executions, "combination_id"), "WITH q AS (SELECT combination_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('failed','error')) AS failures FROM execs GROUP BY ALL) SELECT *, CASE WHEN completed = 0 THEN 'failed' WHEN failures > completed THEN 'error' ELSE 'completed' END AS outcome FROM q"),
    # ---- exports
    "s14_flat_text": (lambda v: store.flat_text(v.run_events.select("id", "work_id", "entity_data_json")), "SELECT id::VARCHAR AS id, work_id, entity_data_json FROM evts"),
    "s15_full_results": (lambda v: store.full_results(v.combinations, v.executions).select("work_id", F.size("combinations").cast("long").alias("n"), F.aggregate("combinations", F.lit(0), lambda s, c: s + F.size(c["executions"])).cast("long").alias("runs")), "SELECT work_id, count(DISTINCT c.id) AS n, count(e.id) AS runs FROM combos c LEFT JOIN execs e ON e.combination_id = c.id GROUP BY work_id"),
    "s16_manifest": (lambda v: store.manifest({"combinations": v.combinations, "executions": v.executions, "events": v.run_events}), "SELECT 'combinations' AS table_name, count(*) AS n_rows, 8 AS n_columns FROM combos UNION ALL SELECT 'executions', count(*), 6 FROM execs UNION ALL SELECT 'events', count(*), 6 FROM evts"),
    # ---- feeds (batch twins)
    "t1_throttle": (lambda v: feeds.throttled(v.progress, 0.15, 86_400.0), _THROTTLED),
    "t2_snapshots": (lambda v: feeds.snapshot_changes(_seen(v), 30 * 86_400.0, 86_400.0), _SNAPSHOTS),
    "t6_feed": (lambda v: feeds.combination_feed(_running(v)), _FEED),
    "t2_changes": (lambda v: feeds.changes(*_snapshots(v)), f"WITH o AS (SELECT unit_id, CASE WHEN status = 'completed' THEN 'running' ELSE status END AS status, objective FROM execs WHERE started_at < '1999-01-01'), n AS (SELECT unit_id, status, objective FROM execs WHERE started_at >= '1994-01-01') SELECT * FROM (SELECT coalesce(o.unit_id, n.unit_id) AS unit_id, CASE WHEN o.unit_id IS NULL THEN 'new' WHEN n.unit_id IS NULL THEN 'removed' WHEN n.status IN ('completed','failed','error') AND o.status NOT IN ('completed','failed','error') THEN 'completed' WHEN o.status <> n.status THEN 'updated' END AS change FROM o FULL JOIN n ON o.unit_id = n.unit_id) WHERE change IS NOT NULL"),
    "t3_new_events": (lambda v: feeds.new_events(v.run_events, ["error", "warning"]).groupBy("work_id", "event_type").count().withColumnRenamed("count", "n"), "SELECT work_id, event_type, count(*) AS n FROM evts WHERE event_type IN ('error','warning') GROUP BY ALL"),
    "t4_fingerprint_changes": (lambda v: feeds.fingerprint_changes(v.progress.select("execution_id", "id", F.floor(F.col("progress") * 4).alias("quarter")), "execution_id", "id", "quarter").select("execution_id", "id", "quarter"), "SELECT execution_id, id, floor(progress * 4)::BIGINT AS quarter FROM (SELECT *, lag(floor(progress * 4)) OVER (PARTITION BY execution_id ORDER BY id) AS b FROM (SELECT DISTINCT * FROM (SELECT execution_id, id, progress FROM prog))) WHERE b IS DISTINCT FROM floor(progress * 4)"),
    "t5_status_moves": (lambda v: feeds.status_moves(_moves(v)), f"WITH {_MOVES}, l AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY ts) AS old_status FROM mv) SELECT id, old_status, status AS new_status, ts FROM l WHERE old_status IS DISTINCT FROM status"),
    "t6_combination_changes": (lambda v: feeds.combination_changes(v.executions.where("status = 'running'").join(v.combinations.select(F.col("id").alias("combination_id"), "work_id"), "combination_id").select("work_id", F.col("started_at").alias("ts"), "combination_id").distinct()).select("work_id", "combination_id", "previous"), "WITH r AS (SELECT DISTINCT work_id, started_at AS ts, combination_id FROM ecombos WHERE status = 'running'), l AS (SELECT *, lag(combination_id) OVER (PARTITION BY work_id ORDER BY ts, combination_id) AS previous FROM r) SELECT work_id, combination_id, previous FROM l WHERE previous IS DISTINCT FROM combination_id"),
    "t7_live_counts": (lambda v: feeds.live_counts(v.run_events), "SELECT work_id, date_trunc('hour', ts) AS begins, event_type, count(*) AS n FROM evts GROUP BY ALL"),
    "t7_live_progress": (lambda v: feeds.live_progress(v.executions), f"SELECT combination_id, count(*) FILTER ({_FINAL}) AS finished, count(*) AS n, count(*) FILTER ({_FINAL}) / count(*) AS progress FROM execs GROUP BY ALL"),
}


def _seen(v: Views):
    """Line items as snapshots of their orders."""
    status = F.when(F.col("l_returnflag") == "A", "queued").when(F.col("l_returnflag") == "N", "running").otherwise("completed")
    return v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("unit_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), status.alias("status"))


def _running(v: Views):
    """What was seen of each work's running combination, one of two; queued executions stand for none."""
    some = F.col("status") != "queued"
    rows = v.executions.join(v.combinations.select(F.col("id").alias("combination_id"), "work_id"), "combination_id")
    return rows.select("work_id", F.unix_timestamp("started_at").cast("double").alias("ts"), F.when(some, F.col("combination_id") % 2).alias("combination_id"), F.when(some, F.col("unit_id")).alias("unit_id"), "status", F.col("objective").alias("progress"))


def _works(v: Views):
    """A work for each task and region, with metadata as JSON."""
    rows = v.combinations.groupBy("task_id", "work_id").agg(F.min("status").alias("status"), F.array_sort(F.collect_set("dataset_id")).alias("tags"))
    meta = F.struct(F.lit("Segment Team").alias("author"), F.col("task_id").alias("name"), F.to_json("tags").alias("tags"))
    return rows.select(F.concat_ws("-", "task_id", "work_id").alias("id"), "status", F.to_json(F.struct(F.struct(meta["author"].alias("author"), meta["name"].alias("name"), F.col("tags")).alias("metadata"))).alias("config_json"))
