"""Views over the driver's tables in the shapes the library works on, in Spark and as SQL text.

Spark derives them from whole tables; the SQL is the same definition for another engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def codes(self) -> DataFrame:
        """Signs of embeddings as strings of 0 and 1: equal lengths, a dataset for each label."""
        bits = F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0"))
        return self.table("embeddings").select(F.concat(F.lit("g"), F.col("label")).alias("dataset_id"), F.col("vec_id").cast("int").alias("seq_index"), F.array_join(bits, "").alias("sequence"))

    @cached_property
    def dna(self) -> DataFrame:
        """Pairs of signs as A, C, G, T: 32 letters from 64 dimensions."""
        sign = lambda i: (F.get("embedding", i) > 0).cast("int")
        letters = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit("ACGT"), 1 + 2 * sign(2 * i) + sign(2 * i + 1), F.lit(1)))
        return self.table("embeddings").select(F.concat(F.lit("g"), F.col("label")).alias("dataset_id"), F.col("vec_id").cast("int").alias("seq_index"), F.array_join(letters, "").alias("sequence"))

    @cached_property
    def days(self) -> DataFrame:
        """Order dates as eight digits, a dataset for each priority: many equal rows."""
        return self.table("orders").select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").cast("int").alias("seq_index"), F.date_format("o_orderdate", "yyyyMMdd").alias("sequence"))

    @cached_property
    def names(self) -> DataFrame:
        """Part names by brand: unequal lengths."""
        return self.table("part").select(F.col("p_brand").alias("dataset_id"), F.col("p_partkey").cast("int").alias("seq_index"), F.col("p_name").alias("sequence"))

    @cached_property
    def combinations(self) -> DataFrame:
        k = F.col("c_custkey")
        status = F.get(F.array(*[F.lit(s) for s in ("queued", "running", "paused", "canceled", "failed", "error", "completed")]), (k % 7).cast("int"))
        rows = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
        return rows.select(
            k.alias("id"), name("w", F.col("n_regionkey")).alias("work_id"), F.col("c_mktsegment").alias("task_id"), name("d", F.col("c_nationkey")).alias("dataset_id"),
            name("p", k % 3).alias("preset_id"), name("a", k % 5).alias("algorithm_id"), status.alias("status"), (10 + k % 4).cast("int").alias("total_sequences"),
        )

    @cached_property
    def executions(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        mode = F.get(F.array(F.lit("experiment"), F.lit("optimization"), F.lit("sensitivity")), (k % 3).cast("int"))
        first = F.substring("o_orderpriority", 1, 1)
        status = F.when(first == "1", "completed").when(first == "2", "running").when(first == "3", "queued").when(first == "4", "failed").otherwise("error")
        unit = F.concat_ws(":", mode, F.lit("t1"), F.lit("d1"), F.concat(F.lit("p"), c % 3), F.concat(F.lit("a"), c % 5), k.cast("string"))
        return self.table("orders").select(k.alias("id"), unit.alias("unit_id"), c.alias("combination_id"), status.alias("status"), F.when(first == "1", F.col("o_totalprice")).alias("objective"), F.col("o_orderdate").alias("started_at"))

    @cached_property
    def progress(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("execution_id"), (F.col("l_linenumber").cast("double") / 10).alias("progress"), F.unix_timestamp("l_shipdate").cast("double").alias("ts"))

    @cached_property
    def run_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").otherwise("progress")
        category = F.get(F.array(*[F.lit(c) for c in ("work", "task", "dataset", "preset", "combination", "unit", "algorithm", "other")]), (F.col("event_id") % 8).cast("int"))
        return self.table("events").select(F.col("event_id").alias("id"), F.concat(F.lit("w"), F.col("user_id") % 5).alias("work_id"), kind.alias("event_type"), category.alias("event_category"), F.col("props").alias("entity_data_json"), "ts")

    @cached_property
    def centers(self) -> DataFrame:
        """The first row of each dna dataset, as a centre."""
        return self.dna.groupBy("dataset_id").agg(F.min_by("sequence", "seq_index").alias("center"))


SQL = {
    "codes": "SELECT 'g' || label AS dataset_id, vec_id AS seq_index, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS sequence FROM embeddings",
    "dna": "SELECT 'g' || label AS dataset_id, vec_id AS seq_index, array_to_string([substr('ACGT', 1 + 2 * (embedding[2 * i + 1] > 0)::INT + (embedding[2 * i + 2] > 0)::INT, 1) FOR i IN range(32)], '') AS sequence FROM embeddings",
    "days": "SELECT o_orderpriority AS dataset_id, o_orderkey AS seq_index, strftime(o_orderdate, '%Y%m%d') AS sequence FROM orders",
    "names": "SELECT p_brand AS dataset_id, p_partkey AS seq_index, p_name AS sequence FROM part",
    "combos": "SELECT c_custkey AS id, 'w' || n_regionkey AS work_id, c_mktsegment AS task_id, 'd' || c_nationkey AS dataset_id, 'p' || c_custkey % 3 AS preset_id, 'a' || c_custkey % 5 AS algorithm_id, ['queued','running','paused','canceled','failed','error','completed'][c_custkey % 7 + 1] AS status, 10 + c_custkey % 4 AS total_sequences FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "execs": "SELECT o_orderkey AS id, ['experiment','optimization','sensitivity'][o_orderkey % 3 + 1] || ':t1:d1:p' || o_custkey % 3 || ':a' || o_custkey % 5 || ':' || o_orderkey AS unit_id, o_custkey AS combination_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'completed' WHEN '2' THEN 'running' WHEN '3' THEN 'queued' WHEN '4' THEN 'failed' ELSE 'error' END AS status, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN o_totalprice END AS objective, o_orderdate AS started_at FROM orders",
    "prog": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS execution_id, l_linenumber::DOUBLE / 10 AS progress, epoch(l_shipdate)::DOUBLE AS ts FROM lineitem",
    "evts": "SELECT event_id AS id, 'w' || user_id % 5 AS work_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'progress' END AS event_type, ['work','task','dataset','preset','combination','unit','algorithm','other'][event_id % 8 + 1] AS event_category, props AS entity_data_json, ts FROM events",
    "centers": "SELECT dataset_id, min_by(sequence, seq_index) AS center FROM dna GROUP BY ALL",
    "dchars": "SELECT dataset_id, seq_index, i AS pos, substr(sequence, i + 1, 1) AS ch FROM dna, range(32) t(i)",
    "ychars": "SELECT dataset_id, seq_index, i AS pos, substr(sequence, i + 1, 1) AS ch FROM days, range(8) t(i)",
    "nchars": "SELECT dataset_id, seq_index, i AS pos, substr(sequence, i + 1, 1) AS ch FROM names, range(64) t(i) WHERE i < length(sequence)",
    "dist": "SELECT d.dataset_id, seq_index, center, hamming(center, sequence) AS d FROM dna d JOIN centers USING (dataset_id)",
    "pairs": "SELECT a.dataset_id, a.seq_index AS i, b.seq_index AS j, hamming(a.sequence, b.sequence) AS d FROM dna a JOIN dna b ON a.dataset_id = b.dataset_id AND a.seq_index < b.seq_index",
    "ecombos": "SELECT e.*, c.work_id, c.task_id, c.dataset_id, c.preset_id, c.algorithm_id FROM execs e JOIN combos c ON e.combination_id = c.id",
}


def with_views(body: str) -> str:
    """The query with the views it names, and those that they name, in front."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in used and re.search(rf"\b{name}\b", text):
                need(SQL[name])
                if name not in used:
                    used.append(name)

    need(body)
    recursive = body.lstrip().upper().startswith("WITH RECURSIVE")
    own = re.sub(r"^\s*WITH (RECURSIVE )?", "", body, flags=re.I) if body.lstrip().upper().startswith("WITH") else None
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    if not heads:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}" + (f", {own}" if own else f" {body}")
