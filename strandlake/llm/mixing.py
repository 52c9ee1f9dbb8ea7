"""Mixing to target weights with soft membership.

A multinomial regression, fitted on a bounded sample of labelled rows, gives every document a
posterior over the domains that the labels table names: clean, poor (quality 0) and toxic. With
n the tokens (words) of a document, p its posterior and r >= 0 its rate, the mixture has
E_d = sum of r * n * p_d tokens of domain d. Rates minimise

    sum over d of (E_d - T_d)^2 / (2 T_d)  +  ridge / 2 * sum of n * (r - 1)^2

for the target tokens T_d, by projected gradient steps with Nesterov's momentum, y being the rates
that momentum carries on:

    r <- max(0, y - (sum over d of p_d (E_d(y) - T_d) / T_d + ridge * (y - 1)) / (sum over d of p_d c_d + ridge)).

Here c_d = E_d(1) / T_d, and n times the divisor is the sum of the document's row in the matrix of
second derivatives. That matrix has no negative entry, so the diagonal of its row sums bounds it
and the step is never too long, while documents of a rare domain take long steps where a common
domain far above its target would dictate short ones.

A step changes r by what the document's own posterior and the D sums E say. So the rates are the
fold of the steps' D error numbers, made anew from the posterior wherever they are needed: nothing
of the corpus's size is kept, sent or rewritten.

Steps are many where posteriors are soft or targets out of reach, so the first of them are taken on
cells: Spark adds up the tokens of documents with about the same posterior, in a number of cells
that the grid bounds whatever the corpus. Then each step is a pass over all documents, which sends
2 D numbers to the driver. Passes go on until the rates' own totals are within the tolerance of
the targets, or stand still (targets that no rates reach, such as those of a domain without
documents); what is left is in the result as ``residual``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxicity
from .common import columns_apart, stage, unused

DOMAINS = ("clean", "poor", "toxic")
#: Shares of the mixture's tokens, and its size: the tokens of the first domain times ANCHOR
#: fill that domain's share, so that its documents are kept and some come twice.
WEIGHTS = {"clean": 0.93, "poor": 0.05, "toxic": 0.02}
ANCHOR = 1.1
#: Keeps rates near 1 where the targets leave a choice; it holds totals off their targets by about its size times (rate - 1).
RIDGE = 1e-4
TOLERANCE = 1e-3
#: Passes in a row that move no total by more than half the tolerance end the fit.
STILL = 3
#: The grid of the cells: how many to a doubling of a posterior, and the least posterior told from 0.
CELLS_A_DOUBLING, LEAST_POSTERIOR = 4, 2.0**-16
#: Steps on cells, at most. They are a start only: passes over all documents follow.
CELL_STEPS = 500
ROWS_A_LABEL = 4_000


def posteriors(docs: DataFrame, labels: DataFrame, rows_a_label: int = ROWS_A_LABEL) -> DataFrame:
    """``docs(id, text)`` -> ``(id, n, p array<double>)`` by row: words, and a posterior in the order of DOMAINS.

    Domains that no labelled row has get 0; without any labelled row all are clean.
    """
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
    rows = toxicity.labelled(docs, labels, ["quality", "toxic"], rows_a_label, parts=(0, 1, 2, 3))
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    rows = rows.withColumn("domain", domain)
    seen = sorted(r["domain"] for r in rows.select("domain").distinct().collect())
    if len(seen) < 2:
        only = seen[0] if seen else 0
        return toxicity.feature_rows(docs, {}).select("id", F.col("n_words").alias("n"), F.array(*[F.lit(float(k == only)) for k in range(len(DOMAINS))]).alias("p"))
    lexicon = toxicity.learn_lexicon(rows)
    train = stage(toxicity.feature_rows(rows.select("id", "text", "domain"), lexicon, "domain"), "domains")
    place = F.create_map(*[F.lit(x) for i, k in enumerate(seen) for x in (k, float(i))])
    # the sample has as many rows of each label; weights bring the corpus's shares back
    train = train.withColumn("label", place[F.col("domain")]).withColumn("vector", array_to_vector("features")).coalesce(4).cache()
    true = labels.where("quality is not null and toxic is not null").groupBy(domain.alias("domain")).count().collect()
    share, have = {r["domain"]: r["count"] for r in true}, {r["domain"]: r["count"] for r in train.groupBy("domain").count().collect()}
    heavy = F.create_map(*[F.lit(x) for k in seen for x in (k, share.get(k, 1) / have[k])])
    model = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="w", maxIter=60, regParam=1e-4, family="multinomial").fit(train.withColumn("w", heavy[F.col("domain")]))
    train.unpersist()
    out = model.transform(toxicity.feature_rows(docs, lexicon).withColumn("vector", array_to_vector("features")))
    chance = vector_to_array("probability")
    p = F.array(*[chance[seen.index(k)] if k in seen else F.lit(0.0) for k in range(len(DOMAINS))])
    return out.select("id", F.col("n_words").alias("n"), p.alias("p"))


def _step(p: np.ndarray, r: np.ndarray, y: np.ndarray, t: float, e: np.ndarray, scale: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The next rates, carried-on rates and momentum."""
    new = np.maximum(0.0, y - (p @ e + ridge * (y - 1)) / (p @ scale + ridge))
    after = (1 + np.sqrt(1 + 4 * t * t)) / 2
    return new, new + (t - 1) / after * (new - r), after


def _fold(p: np.ndarray, errors: np.ndarray, scale: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after one step for each row of ``errors`` ((E - T) / T), from rates of 1, and the next y.

    At a row of NaN momentum starts anew.
    """
    r = y = np.ones(len(p))
    t = 1.0
    for e in errors:
        r, y, t = (r, r, 1.0) if np.isnan(e).any() else _step(p, r, y, t, e, scale, ridge)
    return r, y


def _arrays(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(b.column("n"), np.float64), np.asarray(b.column("p").flatten(), np.float64).reshape(-1, dim)


def fit_rates(members: DataFrame, targets: list[float], ridge: float = RIDGE, passes: int | None = None, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Error vectors and scale that give the rates of ``members(id, n, p)`` by `_fold`; at most so many ``passes`` if given."""
    return _fit(members, targets, ridge, passes, tolerance)[:2]


def _cells(members: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mean posteriors of the cells: at most (16 doublings of 4 cells, and one) to the power ``dim`` - 1, times a few."""
    cell = [F.round(CELLS_A_DOUBLING * F.log2(F.greatest(F.col("p")[k], F.lit(LEAST_POSTERIOR)))).alias(f"c{k}") for k in range(dim)]
    sums = [F.sum(F.col("n") * F.col("p")[k]).alias(f"s{k}") for k in range(dim)]
    rows = members.where("n > 0").groupBy(*cell).agg(F.sum("n").alias("n"), *sums).collect()
    n = np.array([r["n"] for r in rows], np.float64)
    return n, np.array([[r[f"s{k}"] for k in range(dim)] for r in rows]).reshape(-1, dim) / n[:, None]


def _fit(members: DataFrame, targets: list[float], ridge: float, passes: int | None, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `fit_rates`, and by how much of its target each domain's total is off."""
    dim, goal = len(targets), np.array(targets)

    def totals(errors: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, dim))
            for b in batches:
                n, p = _arrays(b, dim)
                sums += (n * np.stack(_fold(p, errors, scale, ridge))) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.ravel()], [f"e{k}" for k in range(2 * dim)])

        one = members.mapInArrow(run, ", ".join(f"e{k} double" for k in range(2 * dim))).agg(*[F.sum(f"e{k}") for k in range(2 * dim)]).first()
        of_r, of_y = np.array([x or 0.0 for x in one]).reshape(2, dim)
        return of_r, of_y

    live = goal > 0
    relative = lambda e: np.where(live, (e - goal) / np.where(live, goal, 1.0), 0.0)
    errors = np.zeros((0, dim))
    of_r, of_y = totals(errors, np.ones(dim))
    scale, left, still, done = relative(of_r) + live, relative(of_r), 0, 0
    if np.abs(left).max(initial=0.0) > tolerance:
        errors = np.vstack([_steps_on_cells(*_cells(members, dim), relative, scale, ridge, tolerance / 4), np.full(dim, np.nan)])
        of_r, of_y = totals(errors, scale)
        left = relative(of_r)
    while np.abs(left).max(initial=0.0) > tolerance and still < STILL and (passes is None or done < passes):
        errors, done = np.vstack([errors, relative(of_y)]), done + 1
        of_r, of_y = totals(errors, scale)
        now = relative(of_r)
        still = still + 1 if np.abs(now - left).max() < tolerance / 2 else 0
        left = now
    return errors, scale, left


def _steps_on_cells(n: np.ndarray, p: np.ndarray, relative, scale: np.ndarray, ridge: float, tolerance: float) -> np.ndarray:
    """Error vectors of the steps that bring the cells' totals to their targets, or as near as ``CELL_STEPS`` do."""
    errors: list[np.ndarray] = []
    r = y = np.ones(len(n))
    t = 1.0
    while len(errors) < CELL_STEPS and np.abs(relative((n * r) @ p)).max(initial=0.0) > tolerance:
        errors.append(relative((n * y) @ p))
        r, y, t = _step(p, r, y, t, errors[-1], scale, ridge)
    return np.array(errors).reshape(-1, len(scale))


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, anchor: float = ANCHOR, ridge: float = RIDGE) -> DataFrame:
    """``(id, n, p, rate, residual, copies)`` for each row of ``docs(id, text)``.

    residual says for each domain by what share of its target the mixture's expected tokens are
    off; it is the same in all rows.
    copies is the rate rounded to a neighbour by the id's hash, up with the chance of its
    fraction. Documents without words have no say in the totals; their rate follows their
    posterior as others' does. An empty table gives an empty result.
    """
    weights = weights or WEIGHTS
    members = stage(posteriors(docs, labels), "members")
    dim = len(DOMAINS)
    have = members.agg(*[F.sum(F.col("n") * F.col("p")[k]) for k in range(dim)]).first()
    first = have[0] or 0.0
    total = anchor * first / weights[DOMAINS[0]]
    errors, scale, left = _fit(members, [weights[d] * total for d in DOMAINS], ridge, None, TOLERANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, p = _arrays(b, dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_fold(p, errors, scale, ridge)[0])], ["id", "n", "p", "rate"])

    out = members.mapInArrow(run, "id long, n long, p array<double>, rate double").withColumn("residual", F.array(*[F.lit(float(x)) for x in left]))
    chance = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 20)) / float(1 << 20)
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each as often as its ``copies`` say, in the input's columns.

    Rows that repeat an id all come as often as the one with most copies; so do all rows with a
    null id.
    """
    rows = columns_apart(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), F.col("text").cast("string"))
    own, copies, n = unused(docs, "id_of"), unused(docs, "copies"), unused(docs, "n")
    of_id = rates(rows, labels).groupBy("id").agg(F.max("copies").alias(copies)).withColumnRenamed("id", own)
    joined = docs.join(of_id, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own)))
    return joined.where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
