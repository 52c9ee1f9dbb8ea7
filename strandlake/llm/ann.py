"""Nearest neighbours by inner product: an inverted file whose lists are scanned adaptively.

Largest inner product becomes smallest distance: vectors are divided by a norm M that no listed
one exceeds and get one more component sqrt(1 - |x|^2), queries are made unit vectors with a 0
there, which adds the same to all of a query's distances. Both are turned by one random rotation
and kept in column blocks. A query's first lists are scored whole, which gives the distance of
its k-th best so far. In its other probed lists distances are built up block by block; after
each, a candidate whose scaled partial distance exceeds (1 + EPSILON / sqrt(dimensions seen))
times that distance is abandoned (the hypothesis that it is nearer is rejected). Survivors get
their inner product from the original vectors in double precision.

Every vector is in a list. M is ``FAR`` times the norm that one vector in a hundred exceeds. The
few vectors above M have a list of their own, which all queries score whole: they are nearest to
many, and would leave the others no digits.

List centres are fitted on a sample of ``SAMPLE`` vectors. How many lists a query probes is
measured: for ``TRIED`` vectors the true neighbours among all are found, and the probes are as
many as reach the share ``RECALL`` of these. Vectors near to random need a large share of the
lists, others a few.

Lists and the queries that probe them are both cut into blocks of bounded size, so a list with
a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_apart, stage

SAMPLE = 20_000
MOST_LISTS = 4096
COLUMN_BLOCK = 16
EPSILON = 2.1
#: Lists that are scored whole.
FIRST_LISTS = 2
FAR = 4.0
TRIED, RECALL = 128, 0.96
#: The list of the vectors above M.
APART = -1
LIST_BLOCK = 4096
QUERY_BLOCK = 1024
SEED = 7

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, v)`` of the rows that take part: an id, and a vector without null or non-finite parts that isn't zero."""
    rows = columns_apart(vectors, id_col, vector_col).toDF("id", "v").select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & fine)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


class Index:
    """What all tasks need, of a size that the parameters bound: rotation, the norm M, list centres."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int):
        rng = np.random.default_rng(SEED)
        self.dim, self.norm = sample.shape[1], norm
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim + 1, self.dim + 1)))[0]
        data = self.turn(sample)
        centres = data[rng.choice(len(data), min(lists, len(data)), replace=False)]
        for _ in range(8):
            own = nearest(data, centres, 1)[:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, own, data)
            n = np.bincount(own, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        self.centres = centres

    def turn(self, x: np.ndarray) -> np.ndarray:
        """Vectors up to the norm M with their added component, rotated."""
        x = x / self.norm
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))]) @ self.rotation

    def turn_queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q / norms(q)[:, None], np.zeros(len(q))]) @ self.rotation

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), APART, np.int64)
        near = norms(x) <= self.norm
        if near.any():
            out[near] = nearest(self.turn(x[near]), self.centres, 1)[:, 0]
        return out


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors, whatever the size of their parts."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centres of each row, nearest first."""
    out = []
    size = (centres * centres).sum(1)
    for at in range(0, len(x), 4096):
        d = size - 2 * x[at : at + 4096] @ centres.T
        k_ = min(k, d.shape[1])
        part = np.argpartition(d, k_ - 1, axis=1)[:, :k_]
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.vstack(out) if out else np.zeros((0, min(k, len(centres))), np.int64)


def scan(x: np.ndarray, turned: np.ndarray, q: np.ndarray, q_turned: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the candidates that no test abandons; squared radii by query.

    While many candidates are left a block's distances are one matrix product, later only those
    of the pairs left.
    """
    dim = turned.shape[1]
    partial = np.zeros((len(q), len(x)))
    qi = xi = None
    for c in range(0, dim, COLUMN_BLOCK):
        xb, qb = turned[:, c : c + COLUMN_BLOCK], q_turned[:, c : c + COLUMN_BLOCK]
        if qi is None:
            partial += (qb * qb).sum(1)[:, None] + (xb * xb).sum(1) - 2 * qb @ xb.T
        else:
            block = xb[xi] - qb[qi]
            partial += np.einsum("ij,ij->i", block, block)
        seen = min(c + COLUMN_BLOCK, dim)
        limit = radius * (seen / dim) * ((1 + EPSILON / np.sqrt(seen)) ** 2 if seen < dim else 1 + 1e-9)
        if qi is None:
            stay = partial <= limit[:, None]
            if seen == dim or stay.mean() < 0.15:
                qi, xi = np.nonzero(stay)
                partial = partial[qi, xi]
        else:
            stay = partial <= limit[qi]
            qi, xi, partial = qi[stay], xi[stay], partial[stay]
    return qi, xi, (x[xi] * q[qi]).sum(1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest scores, ties to smaller ids."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    out = np.empty((len(score), k), np.int64)
    for i, row in enumerate(score):
        at = np.flatnonzero(row >= least[i])
        out[i] = at[np.lexsort((ids[at], -row[at]))[:k]]
    return out


def enough_probes(listed: DataFrame, tried: list[tuple[int, list[float]]], index, k: int, recall: float = RECALL) -> int:
    """Lists to probe for this share of the true neighbours of ``tried``; a pass over ``listed(id, v, list)``."""
    own, q = np.array([i for i, _ in tried]), np.array([v for _, v in tried], np.float64)
    dim = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, lists = np.asarray(b.column(0)), np.asarray(b.column(2), np.int64)
            score = np.nan_to_num(q @ _matrix(b.column(1), dim).T, nan=-np.inf)
            score[own[:, None] == ids] = -np.inf
            parts = [np.broadcast_to(ids, score.shape), np.broadcast_to(lists, score.shape), score]
            if held is not None:
                parts = [np.concatenate(x, axis=1) for x in zip(held, parts)]
            top = np.argsort(-parts[2], axis=1, kind="stable")[:, :k]
            held = [np.take_along_axis(x, top, 1) for x in parts]
        if held is not None:
            number = np.repeat(np.arange(len(q)), held[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(number), *[pa.array(x.ravel()) for x in held]], ["q", "id", "list", "score"])

    found = listed.select("id", "v", "list").mapInArrow(run, "q long, id long, list long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    top = found.where("score > double('-Infinity')").withColumn("rank", rank).where(F.col("rank") <= k).select("q", "list").collect()  # at most TRIED * k rows
    order = nearest(index.turn_queries(q), index.centres, len(index.centres))
    place = np.argsort(order, axis=1)
    needed = sorted(place[r["q"], r["list"]] + 1 for r in top if r["list"] != APART)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if needed else 1


def search(vectors: DataFrame, query_if, k: int = 20, probes: int | None = None, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row for which ``query_if(id)`` holds.

    Rows without an id or a usable vector take no part; vectors of another length than most have
    no inner product with these and take no part either. Rows that repeat an id are one candidate
    with their best score, and one query; a query's own id is no candidate of it. A score beyond the
    range of double precision is infinite. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    largest = F.greatest(F.array_max("v"), -F.array_min("v"))
    # an array of one, so that the largest part is found once a row
    norm = F.transform(F.array(largest), lambda m: m * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / m) * (x / m))))[0]
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.percentile_approx(norm, 0.99, 1000).alias("usual"))
    top = shapes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, most, usual = top[0]
    bound = min(most, FAR * usual) * (1 + 1e-12)
    rows = rows.where(F.size("v") == dim)
    lists = lists or int(min(MOST_LISTS, max(1, round(n**0.5))))
    share = min(1.0, SAMPLE / n)
    near = rows.where(norm <= bound)
    picked = near.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < round(share * 1_000_000)).limit(SAMPLE)
    sample = _matrix(picked.select("v").toArrow().column(0).combine_chunks(), dim)
    if not len(sample):
        sample = _matrix(near.limit(SAMPLE).select("v").toArrow().column(0).combine_chunks(), dim)
    index = spark.sparkContext.broadcast(Index(sample, bound, lists))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = index.value.lists_of(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], ["id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(index.value.turn_queries(_matrix(b.column(1), dim)), index.value.centres, probes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "v", "lists"])

    def scan_block(keys: tuple, xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(qs):
            ids, x = xs["id"].to_numpy(), np.stack(xs["v"].to_numpy()).astype(np.float64)
            whole = int(keys[0]) == APART
            turned, own = None if whole else index.value.turn(x), qs["id"].to_numpy()
            for at in range(0, len(qs), 64):
                part = qs.iloc[at : at + 64]
                q = np.stack(part["v"].to_numpy()).astype(np.float64)
                if whole:
                    with np.errstate(over="ignore", invalid="ignore"):
                        qi, xi = (c.ravel() for c in np.indices((len(q), len(x))))
                        score = (x[xi] * q[qi]).sum(1)
                else:
                    floor = part["floor"].to_numpy(np.float64, na_value=-np.inf)
                    qi, xi, score = scan(x, turned, q, index.value.turn_queries(q), np.maximum(2 - 2 * (floor / norms(q)) / bound, 0) + 1e-9)
                pairs = pd.DataFrame({"query_id": own[at + qi], "vec_id": ids[xi], "score": score})
                pairs = pairs[pairs["query_id"] != pairs["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(pairs.groupby("query_id", sort=False).head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    def scanned(wanted: DataFrame) -> DataFrame:
        """``wanted(id, v, floor, list)`` against the lists, both cut into blocks."""
        m = wanted.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
        cuts = stage(sizes.join(m, "list").select("list", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("parts"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("rounds")), "cuts")
        cuts = F.broadcast(cuts)  # at most MOST_LISTS rows of three integers
        of = lambda name, count: F.pmod(F.xxhash64("id", F.lit(name)), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        xs = listed.join(cuts, "list").select("list", of("part", "parts").alias("part"), every("rounds").alias("round"), "id", "v")
        qs = wanted.join(cuts, "list").select("list", every("parts").alias("part"), of("round", "rounds").alias("round"), "id", "v", "floor")
        keys = ["list", "part", "round"]
        return xs.groupBy(*keys).cogroup(qs.groupBy(*keys)).applyInPandas(scan_block, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("rank") <= k)

    listed = stage(rows.mapInArrow(assign, "id long, v array<double>, list int"), "listed")
    if probes is None:
        by_hash = near.orderBy(F.xxhash64("id", F.lit(SEED + 1)), "id").limit(TRIED).collect()
        probes = max(FIRST_LISTS + 1, enough_probes(listed, by_hash, index.value, k))
    probes = min(lists, len(index.value.centres), probes)
    asked = stage(rows.where(query_if(F.col("id"))).mapInArrow(probe, "id long, v array<double>, lists array<int>"), "asked")
    sizes = stage(listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "sizes")
    first_lists = F.slice("lists", 1, FIRST_LISTS)
    if most > bound:
        first_lists = F.concat(first_lists, F.array(F.lit(APART)))
    begin = asked.select("id", "v", F.lit(None).cast("double").alias("floor"), F.explode(first_lists).alias("list"))
    first = stage(ranked(scanned(begin)), "first")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    other = asked.join(floors, "id", "left").select("id", "v", "floor", F.explode(F.slice("lists", FIRST_LISTS + 1, max(1, probes - FIRST_LISTS))).alias("list"))
    return ranked(first.drop("rank").unionByName(scanned(other))).select("query_id", "rank", "vec_id", "score")
