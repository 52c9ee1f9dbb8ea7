"""Datasets by their specs: made up, read from files, or landed by an external feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fasta, synthetic

_NUMBERS = {"n": "int", "length": "int", "seed": "long", "noise": "double", "noise_rate": "double", "mutation_rate": "double", "num_clusters": "int", "cluster_distance": "double"}


def load_datasets(specs: DataFrame, base: str = ".", landed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``specs(dataset_id, name, type, parameters)`` -> ``(sequences, datasets)``.

    synthetic: by its parameters; file: the FASTA file ``parameters.filename`` under ``base``;
    external: the rows of ``landed(dataset_id, sequence, ...)`` with the spec's id, by the length
    bounds and policy of its parameters. Ids and names are the spec's, whatever the source calls
    itself; a missing id is the name, and a missing name the id. Specs of other types are an error.
    """
    spark = specs.sparkSession
    known = specs.withColumns({"dataset_id": F.coalesce("dataset_id", "name"), "name": F.coalesce("name", "dataset_id")})
    p = lambda k: F.col("parameters")[k]
    rows = known.select("dataset_id", "type", p("filename").alias("filename"), p("min_length").cast("int").alias("lo"), p("max_length").cast("int").alias("hi"), p("retmax").cast("int").alias("retmax"), p("uniform_policy").alias("policy")).collect()  # a row for each spec
    if odd := sorted({str(r["type"]) for r in rows} - {"synthetic", "file", "external"}):
        raise ValueError(f"unknown dataset types {odd}")
    empty = "dataset_id string, seq_index int, sequence string"
    parts = [spark.createDataFrame([], empty)]
    made = known.where("type = 'synthetic'")
    given = {k for r in made.select(F.map_keys("parameters").alias("k")).collect() for k in r["k"] or ()}
    if any(r["type"] == "synthetic" for r in rows):
        fields = [p(k).cast(_NUMBERS.get(k, "string")).alias(k) for k in sorted(given)]
        parts.append(synthetic.synthetic(made.select("dataset_id", *fields).withColumn("mode", F.coalesce("mode", F.lit("random")) if "mode" in given else F.lit("random"))))
    for r in rows:
        if r["type"] == "file":
            parts.append(fasta.load(spark, r["filename"], base).select(F.lit(r["dataset_id"]).alias("dataset_id"), "seq_index", "sequence"))
        if r["type"] == "external":
            own = landed.where(F.col("dataset_id") == r["dataset_id"])
            parts.append(synthetic.external_clean(own, r["lo"] or 0, 2147483647 if r["hi"] is None else r["hi"], r["retmax"], r["policy"]).select("dataset_id", "seq_index", "sequence"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more.select("dataset_id", F.col("seq_index").cast("int"), "sequence"))
    return out, known.select("dataset_id", "name", "type", "parameters")
