"""Table schemas, status sets and the checks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCES = "dataset_id string, seq_index int, sequence string"
RESULTS = "dataset_id string, method string, success boolean, center_string string, max_distance int, avg_distance double, total_distance bigint, parameters map<string,string>, error string"

#: Statuses of the run ledger, and the moves between them that are allowed.
STATUSES = ("queued", "running", "paused", "canceled", "completed", "failed", "error")
FINAL = ("completed", "failed", "error")
INCOMPLETE = ("queued", "running", "paused", "canceled")
TRANSITIONS = {
    "queued": ("running", "canceled", "paused"),
    "running": ("paused", "completed", "failed", "canceled", "error"),
    "paused": ("running", "canceled", "queued"),
    "canceled": ("queued", "paused"),
}
EVENT_TYPES = ("error", "progress", "warning")
EVENT_CATEGORIES = ("work", "task", "dataset", "preset", "combination", "unit", "algorithm", "other")


def assert_uniform_length(seqs: DataFrame) -> DataFrame:
    """``(dataset_id, lengths, uniform)``: whether position-wise operators are defined on each dataset."""
    n = F.count_distinct(F.char_length("sequence"))
    return seqs.groupBy("dataset_id").agg(n.alias("lengths"), (n == 1).alias("uniform"))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(rule, n)``: rows that break each rule (a SQL predicate that must hold)."""
    flags = [F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(name) for name, p in rules.items()]
    return df.agg(*flags).unpivot([], list(rules), "rule", "n")
