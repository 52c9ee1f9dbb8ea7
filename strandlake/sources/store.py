"""Parquet storage of datasets, and exports of the run ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_sequences(seqs: DataFrame, path: str) -> None:
    """Partitioned by dataset, so that reading one dataset reads its folder only."""
    seqs.write.mode("append").partitionBy("dataset_id").parquet(path)


def load_sequences(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if dataset_id is None else rows.where(F.col("dataset_id") == dataset_id)


def write_as(df: DataFrame, path: str, kind: str) -> None:
    """csv, json or parquet."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def flat_text(df: DataFrame) -> DataFrame:
    """Every column as text on one line; nested ones as JSON."""
    def one(name: str, kind: str):
        col = F.col(f"`{name}`")
        text = F.to_json(col) if kind.startswith(("struct", "array", "map")) else col.cast("string")
        return F.regexp_replace(text, r"[\r\n]+", " ").alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def export_tables(tables: dict[str, DataFrame], path: str, kinds: tuple[str, ...] = ("csv",)) -> DataFrame:
    """Each table that has rows in each format, under its name; returns the manifest."""
    done = manifest(tables)
    full = {r["table_name"] for r in done.where("n_rows > 0").collect()}  # a row for each table
    for name in sorted(full):
        for kind in kinds:
            write_as(flat_text(tables[name]) if kind == "csv" else tables[name], f"{path}/{kind}/{name}", kind)
    return done


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows, n_columns)``."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def full_results(combinations: DataFrame, executions: DataFrame) -> DataFrame:
    """A nested row a work: its combinations, each with its executions in order."""
    inner = executions.groupBy("combination_id").agg(F.array_sort(F.collect_list(F.struct("id", "unit_id", "status", "objective"))).alias("executions"))
    rows = combinations.join(inner, combinations.id == inner.combination_id, "left")
    fields = F.struct("id", "task_id", "dataset_id", "preset_id", "algorithm_id", "status", F.coalesce("executions", F.array().cast(inner.schema["executions"].dataType)).alias("executions"))
    return rows.groupBy("work_id").agg(F.array_sort(F.collect_list(fields)).alias("combinations"))
