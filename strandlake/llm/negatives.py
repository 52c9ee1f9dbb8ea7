"""Hard negatives: integer scores of anchors against all rows, by Strassen's multiplication of tiles.

Rows are cut into blocks of bounded size by label, and a task multiplies one tile, a block of
anchors by a block of candidates. First each anchor meets the blocks of its own label and keeps a
heap of its best positives; heaps are merged across tiles. Then, with the positives' scores
known, it meets all blocks of other labels and keeps a heap for each positive's window of scores.
So every anchor meets every row once, and no task or shuffle holds more than a few scores of each
anchor and tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_apart, stage

#: Anchors and candidates of a task; anchors that are multiplied at once.
ANCHOR_BLOCK, CANDIDATE_BLOCK, AT_ONCE = 4096, 8192, 512
#: Rows, columns or depth at which Strassen's recursion stops.
LEAF = 16
N_POSITIVES, N_NEGATIVES = 5, 5
#: A negative's score in hundredths of the positive's.
LEAST_PERCENT, MOST_PERCENT = 80, 100
SCALE = 256


# ------------------------------------------------------------------ exact products


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven products of quarters; odd sides are padded with zeros.

    Sums and products are of int64 and exact as long as they fit, wherever that is not certain
    they are of Python's integers.
    """
    if not _fits(a, b, leaf):
        a, b = a.astype(object), b.astype(object)
    return _strassen(a, b, leaf)


def _fits(a: np.ndarray, b: np.ndarray, leaf: int) -> bool:
    """Whether no sum or product inside the recursion can leave 64 bits.

    A level adds at most two quarters on each side, and its results add at most four products.
    """
    if not a.size or not b.size:
        return True
    levels, side = 0, min(*a.shape, b.shape[1])
    while side > leaf:
        side, levels = -(-side // 2), levels + 1
    top = lambda x: max(int(x.max()), -int(x.min()))
    return top(a) * top(b) * a.shape[1] * 16**levels < 1 << 62


def _even(x: np.ndarray) -> np.ndarray:
    """With a row and a column of zeros where their number is odd."""
    out = np.zeros([n + n % 2 for n in x.shape], x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def _strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = _even(a), _even(b)
    h, d, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :d], a[:h, d:], a[h:, :d], a[h:, d:]
    b11, b12, b21, b22 = b[:d, :w], b[:d, w:], b[d:, :w], b[d:, w:]
    p1 = _strassen(a11 + a22, b11 + b22, leaf)
    p2 = _strassen(a21 + a22, b11, leaf)
    p3 = _strassen(a11, b12 - b22, leaf)
    p4 = _strassen(a22, b21 - b11, leaf)
    p5 = _strassen(a11 + a12, b22, leaf)
    p6 = _strassen(a21 - a11, b11 + b12, leaf)
    p7 = _strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * w), a.dtype)
    out[:h, :w] = p1 + p4 - p5 + p7
    out[:h, w:] = p3 + p5
    out[h:, :w] = p2 + p4
    out[h:, w:] = p1 - p2 + p3 + p6
    return out[:m, :n]


# ------------------------------------------------------------------ rows and blocks


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, v)`` of the rows that take part, ``v`` in whole steps of 1 / ``SCALE``.

    A row without an id can be named by no result and takes no part either. An empty vector has
    score 0 with any other.
    """
    rows = columns_apart(vectors, id_col, vector_col, label_col).toDF("id", "v", "label").select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def _ints(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dim)


def scored(qs: pd.DataFrame, xs: pd.DataFrame, dim: int) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Each anchor row with its scores of the candidates; scores beyond 64 bits count as the nearest that fits."""
    x, most = _ints(xs["v"], dim).T, (1 << 63) - 1
    for at in range(0, len(qs), AT_ONCE):
        part = qs.iloc[at : at + AT_ONCE]
        scores = strassen(_ints(part["v"], dim), x)
        if scores.dtype == object:
            scores = np.clip(scores, -most, most).astype(np.int64)
        for i in range(len(part)):
            yield part.iloc[i], scores[i]


def best_places(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _tiles(anchors: DataFrame, rows: DataFrame, same_label: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides, dealt to tiles: (dim, label of the candidates, part, round).

    A tile holds a block of candidates of one label, and anchors of that label or of others. A
    label with a third of all rows is many blocks. The table of blocks has one row a label and
    dimension and is joined, whatever its size.
    """
    own = ["dim", "label"] if same_label else ["dim"]
    blocks = rows.groupBy("dim", "label").agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).cast("int").alias("parts"))
    rounds = anchors.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK).cast("int").alias("rounds"))
    cuts = stage(blocks.join(rounds, own), "cuts")
    of = lambda name, count: F.pmod(F.xxhash64("id", F.lit(name)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    xs = rows.join(cuts, ["dim", "label"]).select("dim", "label", of("part", "parts").alias("part"), every("rounds").alias("round"), "id", "v")
    to = cuts.withColumnRenamed("label", "to")
    keys = (anchors["dim"] == to["dim"]) & ((anchors["label"] == to["to"]) if same_label else (anchors["label"] != to["to"]))
    qs = anchors.join(to, keys).select(anchors["dim"], F.col("to").alias("label"), every("parts").alias("part"), of("round", "rounds").alias("round"), *[anchors[c] for c in anchors.columns if c not in ("dim", "label")])
    return xs, qs


KEYS = ["dim", "label", "part", "round"]


def _first(found: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """Merge heaps: each key's k first rows of all tiles. Tasks merge what they hold before it is shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor_if, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Positives of an anchor (a row for which ``anchor_if(id)`` holds) are its best rows of the same
    label, its own id left out; negatives of a positive the best rows of other labels with
    ``LEAST_PERCENT`` to ``MOST_PERCENT`` of its score. Vectors have scores only with those of the
    same length. Rows that repeat an id are candidates each; of anchors that repeat an id the
    first by label and vector counts. An empty table gives an empty result.
    """
    rows = stage(usable(vectors, id_col, vector_col, label_col).withColumn("dim", F.size("v")), "rows")
    firsts = rows.where(anchor_if(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("a"))
    anchors = stage(firsts.select("id", "a.label", "a.v", "a.dim"), "anchors")

    def positives(keys: tuple, xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(qs):
            ids = xs["id"].to_numpy(np.int64)
            for anchor, row in scored(qs, xs, int(keys[0])):
                other = np.flatnonzero(ids != anchor["id"])
                at = other[best_places(row[other], ids[other], n_positives)]
                out += [(int(anchor["id"]), int(ids[j]), int(row[j])) for j in at]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    def windows(keys: tuple, xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(qs):
            ids = xs["id"].to_numpy(np.int64)
            for anchor, row in scored(qs, xs, int(keys[0])):
                for p in anchor["positives"]:
                    top = int(p["positive_score"])
                    if top < 0:
                        continue  # no score is both at least 0.8 times and at most a negative one
                    lo, hi = -(-LEAST_PERCENT * top // 100), MOST_PERCENT * top // 100
                    inside = np.flatnonzero((row >= lo) & (row <= hi))
                    at = inside[best_places(row[inside], ids[inside], n_negatives)]
                    out += [(int(anchor["id"]), int(p["rank"]), int(p["positive_id"]), top, int(ids[j]), int(row[j])) for j in at]
        return pd.DataFrame(out, columns=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    xs, qs = _tiles(anchors, rows, same_label=True)
    heaps = xs.groupBy(*KEYS).cogroup(qs.groupBy(*KEYS)).applyInPandas(positives, "anchor_id long, positive_id long, positive_score long")
    best = stage(_first(heaps, ["anchor_id"], "positive_score", "positive_id", n_positives), "positives")
    known = best.groupBy("anchor_id").agg(F.collect_list(F.struct("rank", "positive_id", "positive_score")).alias("positives"))  # n_positives at most
    xs, qs = _tiles(anchors.join(known, anchors["id"] == known["anchor_id"]).drop("anchor_id"), rows, same_label=False)
    # a positive is told by its place among the anchor's, as rows may repeat an id
    heaps = xs.groupBy(*KEYS).cogroup(qs.groupBy(*KEYS)).applyInPandas(windows, "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(heaps, ["anchor_id", "place"], "negative_score", "negative_id", n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
