"""Synthetic sequence tables: one job for any number of dataset specs.

A spec is a row of ``specs(dataset_id, n, length, alphabet, seed, ...)``. Every random choice is
a hash of the seed and the place, so rows are the same however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import pick, symbols, unit
from ..tables import stage

#: Defaults of a spec, and the bounds of a request.
DEFAULTS = {"n": 20, "length": 50, "alphabet": "ACGT", "seed": 0, "noise_rate": 0.1, "mutation_rate": 0.1, "mutation_types": "substitution", "num_clusters": 2, "cluster_distance": 0.2, "pad_char": "N"}
BOUNDS = {"n": (3, 1000), "length": (5, 10_000)}
#: Rows of a spec that one task makes in a row.
RUN = 1000


def with_defaults(specs: DataFrame) -> DataFrame:
    """Missing columns and nulls filled; a parameter named ``noise`` is taken for ``noise_rate``."""
    if "noise" in specs.columns:
        specs = specs.withColumn("noise_rate", F.coalesce(*[c for c in ("noise_rate", "noise") if c in specs.columns])).drop("noise")
    for name, value in DEFAULTS.items():
        specs = specs.withColumn(name, F.coalesce(name, F.lit(value)) if name in specs.columns else F.lit(value))
    return specs


def rejected(specs: DataFrame) -> DataFrame:
    """Specs out of bounds, with the reason."""
    why = F.concat_ws("; ", *[F.when(~F.coalesce(F.col(k).between(lo, hi), F.lit(False)), F.lit(f"{k} not in {lo}..{hi}")) for k, (lo, hi) in BOUNDS.items()])
    return specs.withColumn("reason", why).where("reason <> ''")


def _rows(specs: DataFrame) -> DataFrame:
    """A row for each index of each spec. Specs are few and make many rows, so runs of ``RUN``
    indices are dealt to tasks by number, not by their size, before they become rows."""
    n = F.col("n").cast("int")
    tasks = int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = specs.where("n > 0").withColumn("from", F.explode(F.sequence(F.lit(0), n - 1, F.lit(RUN)))).repartition(tasks)
    return runs.withColumn("seq_index", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN, n) - 1))).drop("from")


def _letter(*keys) -> Column:
    return F.substring("alphabet", pick(F.char_length("alphabet"), *keys) + 1, F.lit(1))


def _text(make, n: Column = None) -> Column:
    """The letters that ``make`` gives for places 0..n-1."""
    n = F.col("length").cast("int") if n is None else n
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), make), "")).otherwise("")


def _keys(kind: str, *more) -> list:
    return [F.col("seed"), F.lit(kind), F.col("dataset_id"), *more]


def random_sequences(specs: DataFrame) -> DataFrame:
    """Uniform over the alphabet."""
    made = _text(lambda p: _letter(*_keys("r", F.col("seq_index"), p)))
    return _rows(with_defaults(specs)).select("dataset_id", "seq_index", made.alias("sequence"))


def with_base(specs: DataFrame) -> DataFrame:
    """A random base where a spec has none."""
    made = _text(lambda p: _letter(*_keys("base", p)))
    return specs.withColumn("base_sequence", F.coalesce("base_sequence", made) if "base_sequence" in specs.columns else made)


def noisy_sequences(specs: DataFrame) -> DataFrame:
    """Copies of a base whose characters are another symbol with probability ``noise_rate``."""
    rows = _rows(with_base(with_defaults(specs)))

    def at(x: Column, p: Column) -> Column:
        rest = F.replace(F.col("alphabet"), x, F.lit(""))
        other = F.when(F.char_length(rest) == 0, x).otherwise(F.substring(rest, pick(F.char_length(rest), *_keys("ns", F.col("seq_index"), p)) + 1, F.lit(1)))
        return F.when(unit(*_keys("n", F.col("seq_index"), p)) < F.col("noise_rate"), other).otherwise(x)

    made = F.array_join(F.transform(symbols("base_sequence"), at), "")
    return rows.select("dataset_id", "seq_index", made.alias("sequence"))


def mutated_sequences(specs: DataFrame) -> DataFrame:
    """Copies of a base with substitutions, insertions before and deletions of characters.

    Each base character changes with probability ``mutation_rate`` by one of the comma-separated
    ``mutation_types``; unknown types change nothing. The last character can't be deleted if the
    text would be empty. Shorter rows are filled up to the longest of their dataset.
    """
    rows = _rows(with_base(with_defaults(specs)))

    def at(x: Column, p: Column) -> Column:
        own = lambda k: _keys(k, F.col("seq_index"), p)
        kinds = F.split("mutation_types", ",")
        kind = F.trim(F.get(kinds, pick(F.size(kinds), *own("mk"))))
        rest = F.replace(F.col("alphabet"), x, F.lit(""))
        other = F.when(F.char_length(rest) == 0, x).otherwise(F.substring(rest, pick(F.char_length(rest), *own("ms")) + 1, F.lit(1)))
        changed = F.when(kind == "substitution", other).when(kind == "insertion", F.concat(_letter(*own("mi")), x)).when(kind == "deletion", F.lit("")).otherwise(x)
        return F.when(unit(*own("m")) < F.col("mutation_rate"), changed).otherwise(x)

    made = F.array_join(F.transform(symbols("base_sequence"), at), "")
    rows = rows.select("dataset_id", "seq_index", made.alias("made"), F.right("base_sequence", F.lit(1)).alias("last"), "pad_char")
    rows = stage(rows.select("dataset_id", "seq_index", F.coalesce(F.nullif("made", F.lit("")), "last").alias("sequence"), "pad_char"), "mutated")  # read twice
    longest = rows.groupBy("dataset_id").agg(F.max(F.char_length("sequence")).alias("n"))
    return rows.join(longest, "dataset_id").select("dataset_id", "seq_index", F.rpad("sequence", F.col("n"), F.col("pad_char")).alias("sequence"))


def clustered_sequences(specs: DataFrame) -> DataFrame:
    """Row i follows centre i mod ``num_clusters``; each character is drawn anew from the whole
    alphabet with probability ``cluster_distance``. ``cluster_id`` is kept."""
    rows = _rows(with_defaults(specs)).withColumn("cluster_id", (F.col("seq_index") % F.greatest(F.lit(1), F.col("num_clusters"))).cast("int"))
    centre = lambda p: _letter(*_keys("c", F.col("cluster_id"), p))
    made = _text(lambda p: F.when(unit(*_keys("cd", F.col("seq_index"), p)) < F.col("cluster_distance"), _letter(*_keys("cl", F.col("seq_index"), p))).otherwise(centre(p)))
    return rows.select("dataset_id", "seq_index", made.alias("sequence"), "cluster_id")


def synthetic(specs: DataFrame) -> DataFrame:
    """Dispatch by ``mode``: random, noise (random at a rate of 0 or less), mutations, clustered."""
    full = with_defaults(specs.where("mode is not null"))
    noisy = (F.col("mode") == "noise") & (F.col("noise_rate") > 0)
    parts = [
        random_sequences(full.where((F.col("mode") == "random") | ((F.col("mode") == "noise") & (F.col("noise_rate") <= 0)))),
        noisy_sequences(full.where(noisy)), mutated_sequences(full.where("mode = 'mutations'")), clustered_sequences(full.where("mode = 'clustered'")).drop("cluster_id"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def sample_parameters(params: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """``params(name, kind, low, high, step, choices)`` -> ``(sample, name, value)`` as text.

    Kinds: categorical, int, float, uniform, loguniform; a step rounds down to the grid.
    """
    rows = params.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = unit(seed, F.col("name"), F.col("sample"))
    lo, hi = F.col("low"), F.col("high")
    whole = lo + F.floor(u * (F.floor((hi - lo) / F.coalesce("step", F.lit(1.0))) + 1)) * F.coalesce("step", F.lit(1.0))
    real = lo + u * (hi - lo)
    grid = F.when(F.col("step") > 0, lo + F.floor((real - lo) / F.col("step")) * F.col("step")).otherwise(real)
    value = (
        F.when(F.col("kind") == "categorical", F.get("choices", F.floor(u * F.size("choices")).cast("int")))
        .when(F.col("kind") == "int", whole.cast("long").cast("string"))
        .when(F.col("kind") == "loguniform", F.exp(F.log(lo) + u * (F.log(hi) - F.log(lo))).cast("string"))
        .otherwise(grid.cast("string"))
    )
    return rows.select("sample", "name", value.alias("value"))


def external_clean(seqs: DataFrame, least: int = 0, most: int = 2147483647, retmax: int | None = None, policy: str | None = None) -> DataFrame:
    """Landed sequences by length bounds, the first ``retmax`` of each dataset, then a length policy."""
    from ..operators.profile import preview, uniformise

    kept = seqs.where(F.char_length("sequence").between(least, most))
    return uniformise(preview(kept, retmax) if retmax else kept, policy)
