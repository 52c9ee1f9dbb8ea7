"""Experiment matrices, units, methods, sensitivity, trial tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FINAL, RESULTS
from .consensus import cluster_recombine, block_heuristic, greedy_consensus, results
from .candidates import smallest_radius


def combinations(tasks: DataFrame, presets: DataFrame) -> DataFrame:
    """task x dataset x preset x algorithm; presets that don't exist give no row (see `unknown_presets`)."""
    rows = tasks.select("task_id", "mode", "total", "seed", "seed_increment", F.explode("datasets").alias("dataset_id"), "presets")
    rows = rows.withColumn("preset_id", F.explode("presets")).drop("presets")
    return rows.join(presets, "preset_id").select("task_id", "dataset_id", "preset_id", "algorithm_id", "mode", F.col("total").alias("total_sequences"), "seed", "seed_increment", "params")


def unknown_presets(tasks: DataFrame, presets: DataFrame) -> DataFrame:
    return tasks.select("task_id", F.explode("presets").alias("preset_id")).join(presets, "preset_id", "left_anti")


def unit_id(mode: str | Column = "experiment", repetition: str = "repetition") -> Column:
    """mode:task:dataset:preset:algorithm:repetition; colons in a preset become underscores."""
    first = F.lit(mode) if isinstance(mode, str) else mode
    return F.concat_ws(":", first, "task_id", "dataset_id", F.replace("preset_id", F.lit(":"), F.lit("_")), "algorithm_id", F.col(repetition).cast("string"))


def units(combos: DataFrame) -> DataFrame:
    """A row for each repetition, with its id and seed."""
    rows = combos.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("total_sequences"))))
    return rows.withColumn("unit_id", unit_id(F.col("mode"))).withColumn("unit_seed", unit_seed(F.col("seed"), F.col("seed_increment"), F.col("repetition")))


def unit_seed(seed: Column, increment: Column, repetition: Column) -> Column:
    return F.when(increment, seed + repetition).otherwise(seed)


def pending(needed: DataFrame, executions: DataFrame) -> DataFrame:
    """Needed units that no final execution has."""
    done = executions.where(F.col("status").isin(*FINAL)).select("unit_id")
    return needed.join(done, "unit_id", "left_anti")


def objective(rows: DataFrame) -> DataFrame:
    """The largest distance; null, not -1, for failed rows."""
    return rows.withColumn("objective", F.when(F.col("success"), F.col("max_distance").cast("double")))


# ------------------------------------------------------------------ methods


@dataclass(frozen=True)
class Method:
    """A method: ``fn(seqs, **params) -> results``, over all datasets of ``seqs``."""

    fn: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)
    deterministic: bool = True

    def run(self, seqs: DataFrame, **params) -> DataFrame:
        return self.fn(seqs, **(self.defaults | params))


METHODS: dict[str, Method] = {}


def register_method(name: str, deterministic: bool = True, **defaults):
    """Decorator: make a function on DataFrames a method by name."""

    def add(fn):
        METHODS[name] = Method(fn, defaults, deterministic)
        return fn

    return add


@register_method("consensus", tie="lex")
def _consensus(seqs: DataFrame, tie: str) -> DataFrame:
    return results(seqs, greedy_consensus(seqs, tie), "consensus")


@register_method("cluster_recombine", radius=2, n_blocks=2, rounds=10)
def _cluster_recombine(seqs: DataFrame, radius: int, n_blocks: int, rounds: int) -> DataFrame:
    return results(seqs, cluster_recombine(seqs, radius, n_blocks, rounds=rounds), "cluster_recombine")


@register_method("block_heuristic", alphabet="ACGT", width=8, k=3, rounds=3)
def _block_heuristic(seqs: DataFrame, alphabet: str, width: int, k: int, rounds: int) -> DataFrame:
    return results(seqs, block_heuristic(seqs, alphabet, width, k, rounds), "block_heuristic")


@register_method("exact_radius", most_states=2e6)
def _exact_radius(seqs: DataFrame, most_states: float) -> DataFrame:
    found = smallest_radius(seqs, most_states)
    return results(seqs, found.where("success").select("dataset_id", "center"), "exact_radius")


def register_group_method(name: str, fn, deterministic: bool = True, **defaults) -> None:
    """A third party's pandas function on one dataset at a time, whose groups fit in memory.

    ``fn(rows, **params)`` gets the defaults and what a run sets over them, its seed included.
    """

    def run(seqs: DataFrame, **params) -> DataFrame:
        return seqs.groupBy("dataset_id").applyInPandas(lambda rows: fn(rows, **params), RESULTS)

    METHODS[name] = Method(run, defaults, deterministic)


def run_methods(seqs: DataFrame, names: list[str], **params) -> DataFrame:
    """Each method once over all datasets, as one table of result rows."""
    out = None
    for name in names:
        rows = objective(METHODS[name].run(seqs, **params.get(name, {})))
        out = rows if out is None else out.unionByName(rows)
    return out


def worst_status(rows: DataFrame, *keys: str) -> DataFrame:
    """failed over error over completed."""
    rank = F.when(F.col("status") == "failed", 3).when(F.col("status") == "error", 2).when(F.col("status") == "completed", 1).otherwise(0)
    top = rows.groupBy(*keys).agg(F.max(rank).alias("r"))
    return top.withColumn("status", F.when(F.col("r") == 3, "failed").when(F.col("r") == 2, "error").when(F.col("r") == 1, "completed").otherwise("running")).drop("r")


# ------------------------------------------------------------------ analysis


def parameter_block(params: DataFrame, algorithm: str) -> DataFrame:
    """Of ``params(algorithm_id, name, ...)`` an algorithm's own rows, else those without one."""
    own = params.where(F.col("algorithm_id") == algorithm)
    flat = params.where("algorithm_id is null").join(own.select("name"), "name", "left_anti")
    return own.unionByName(flat.select(*own.columns))


def sensitivity(points: DataFrame, *keys: str) -> DataFrame:
    """``points(param, value, objective)``: absolute correlation of each parameter; undefined is 0."""
    r = F.abs(F.corr("value", "objective"))
    return points.groupBy(*keys, "param").agg(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("num_samples"))


def objective_variance(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.coalesce(F.var_samp("objective"), F.lit(0.0)).alias("variance"))


def score_events(scores: DataFrame, method: str, analysis_date: str, *keys: str) -> DataFrame:
    """A JSON record of each group's scores."""
    rows = scores.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "score")))).alias("param_scores"), F.max("num_samples").alias("num_samples"))
    record = F.to_json(F.struct(F.lit(method).alias("method"), "num_samples", "param_scores", F.lit(analysis_date).alias("analysis_date")))
    return rows.select(*keys, record.alias("entity_data_json"))


def trials(executions: DataFrame) -> DataFrame:
    """Unit ids taken apart; those of under six parts drop out."""
    part = lambda k: F.element_at("p", k)
    rows = executions.withColumn("p", F.split("unit_id", ":")).where(F.size("p") >= 6)
    return rows.select("unit_id", F.concat_ws("|", part(2), part(3), part(4), part(5)).alias("study"), part(1).alias("mode"), part(6).cast("long").alias("trial"), "status", "objective")


def best_so_far(rows: DataFrame) -> DataFrame:
    """Running minimum of the objective by trial, and each study's trials."""
    order = Window.partitionBy("study").orderBy("trial", "unit_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.where("objective is not null").select("study", "trial", "unit_id", "objective", F.min("objective").over(order).alias("best"), F.count(F.lit(1)).over(Window.partitionBy("study")).alias("trial_count"))


def sensitivity_scores(events: DataFrame) -> DataFrame:
    """Score records exploded: flat or with the payload under ``context``."""
    j = F.col("entity_data_json")
    of = lambda k: F.coalesce(F.get_json_object(j, f"$.{k}"), F.get_json_object(j, f"$.context.{k}"))
    scores = F.from_json(of("param_scores"), "map<string,double>")
    return events.select("unit_id", of("method").alias("method"), of("num_samples").cast("int").alias("num_samples"), "ts", F.explode(scores).alias("param", "score"))


def outcome(executions: DataFrame, *keys: str) -> DataFrame:
    """failed if none completed, error if failures outnumber, else completed."""
    ok, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status").isin("failed", "error"))
    return executions.groupBy(*keys).agg(ok.alias("completed"), bad.alias("failures")).withColumn("outcome", F.when(F.col("completed") == 0, "failed").when(F.col("failures") > F.col("completed"), "error").otherwise("completed"))


def spec_summary(combos: DataFrame) -> DataFrame:
    return combos.agg(F.count_distinct("algorithm_id").alias("algorithms"), F.count_distinct("dataset_id").alias("datasets"), F.count(F.lit(1)).alias("combinations"))
