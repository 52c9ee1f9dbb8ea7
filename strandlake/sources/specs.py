"""Experiment specs as typed tables, with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deep_merge(base: dict, more: dict) -> dict:
    """``more`` over ``base``, key by key in nested dicts."""
    out = dict(base)
    for k, v in more.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def spec_tables(spark: SparkSession, spec: dict, defaults: dict | None = None) -> dict[str, DataFrame]:
    """A spec (the parsed form of a batch file) as ``datasets``, ``presets`` and ``tasks``."""
    spec = deep_merge(defaults or {}, spec)
    text = lambda d: {k: str(v) for k, v in d.items() if k not in ("id", "name", "type") and not isinstance(v, (dict, list)) and v is not None}
    datasets = [(d.get("id"), d.get("name"), d.get("type"), text(d) | text(d.get("parameters", {}))) for d in spec.get("datasets", [])]
    presets = [(p.get("id"), a, {k: str(v) for k, v in (p.get("params", {}).get(a) or {}).items()}) for p in spec.get("presets", []) for a in p.get("algorithms", [])]
    tasks = [(t.get("id"), t.get("type", "experiment"), t.get("datasets", []), t.get("presets", []), int(t.get("repetitions") or t.get("trials") or t.get("samples") or {"optimization": 50, "sensitivity": 100}.get(t.get("type"), 1)), bool(t.get("seed_increment", True)), t.get("seed")) for t in spec.get("tasks", [])]
    return {
        "datasets": spark.createDataFrame(datasets, "dataset_id string, name string, type string, parameters map<string,string>"),
        "presets": spark.createDataFrame(presets, "preset_id string, algorithm_id string, params map<string,string>"),
        "tasks": spark.createDataFrame(tasks, "task_id string, mode string, datasets array<string>, presets array<string>, total int, seed_increment boolean, seed long"),
    }


def problems(tables: dict[str, DataFrame]) -> DataFrame:
    """``(problem, item)``: missing and repeated ids, and references to nothing."""
    out = []
    for name, key in (("datasets", "dataset_id"), ("tasks", "task_id")):
        df = tables[name]
        out.append(df.where(F.col(key).isNull()).select(F.lit(f"{name}: missing id").alias("problem"), F.lit(None).cast("string").alias("item")))
        out.append(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.lit(f"{name}: repeated id").alias("problem"), F.col(key).alias("item")))
    for name, key in (("datasets", "dataset_id"), ("presets", "preset_id")):
        asked = tables["tasks"].select(F.explode(name).alias(key)).distinct()
        out.append(asked.join(tables[name], key, "left_anti").select(F.lit(f"tasks: unknown {key}").alias("problem"), F.col(key).alias("item")))
    df = out[0]
    for more in out[1:]:
        df = df.unionByName(more)
    return df
