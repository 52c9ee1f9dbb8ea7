"""Distances from centres and between rows, and quality figures of centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import hamming, hamming_of, metric, packed
from ..tables import stage
from . import tiles
from .profile import diversity, mean_pair_distance

#: Symbols of a block from which bands tell pairs apart.
BLOCK = 6


def center_distances(seqs: DataFrame, centers: DataFrame, name: str = "hamming") -> DataFrame:
    """``centers(dataset_id, center)`` joined to all rows of their dataset, with the distance d."""
    a, b = F.col("center"), F.col("sequence")
    if metric(name) is not hamming:
        return seqs.join(centers, "dataset_id").withColumn("d", metric(name)(a, b))
    # packed before they meet: once a row and once a centre
    both = seqs.withColumn("packed_row", packed(b)).join(centers.withColumn("packed_center", packed(a)), "dataset_id")
    return both.withColumn("d", hamming_of(a, b, F.col("packed_center"), F.col("packed_row"))).drop("packed_row", "packed_center")


def summary(distances: DataFrame, *keys: str) -> DataFrame:
    """Largest, least, mean, total and median (mean of the middle two) distance."""
    return distances.groupBy("dataset_id", *keys).agg(
        F.max("d").alias("max_distance"), F.min("d").alias("min_distance"), F.avg("d").alias("avg_distance"),
        F.sum("d").alias("total_distance"), F.expr("percentile(d, 0.5)").alias("median_distance"), F.count(F.lit(1)).alias("num_strings"),
    )


def strength(max_distance: Column, center: Column) -> Column:
    """1 - largest distance over the centre's length; 1 for an empty pool or centre."""
    return F.when(F.coalesce(F.char_length(center), F.lit(0)) == 0, 1.0).otherwise(1 - F.coalesce(max_distance, F.lit(0)) / F.char_length(center))


def quality(seqs: DataFrame, centers: DataFrame, name: str = "hamming") -> DataFrame:
    """Nine figures of each centre; the diversity counts the centre as one more member."""
    known = centers.select("dataset_id", "center")
    figures = summary(center_distances(seqs, known, name), "center")
    base = known.join(figures, ["dataset_id", "center"], "left").fillna(0, ["max_distance", "min_distance", "avg_distance", "total_distance", "median_distance", "num_strings"])
    last = seqs.select("dataset_id", "seq_index", "sequence").unionByName(known.select("dataset_id", F.lit(2147483647).alias("seq_index"), F.col("center").alias("sequence")))
    out = base.join(diversity(last), "dataset_id", "left")
    return out.withColumn("string_length", F.char_length("center")).withColumn("consensus_strength", strength(F.col("max_distance"), F.col("center")))


def compare(seqs: DataFrame, first: DataFrame, second: DataFrame, name: str = "hamming") -> DataFrame:
    """Both centres' figures, the better by largest distance (a tie goes to the second), differences."""
    parts = ["center", "max_distance", "avg_distance", "total_distance"]
    a = quality(seqs, first, name).select("dataset_id", *[F.col(c).alias(f"{c}_1") for c in parts])
    b = quality(seqs, second, name).select("dataset_id", *[F.col(c).alias(f"{c}_2") for c in parts])
    both = a.join(b, "dataset_id").withColumn("better", F.when(F.col("max_distance_1") < F.col("max_distance_2"), F.col("center_1")).otherwise(F.col("center_2")))
    for c in parts[1:]:
        both = both.withColumn(c.replace("distance", "difference"), F.col(f"{c}_1") - F.col(f"{c}_2"))
    return both


def pair_table(seqs: DataFrame, name: str = "hamming") -> DataFrame:
    """All pairs of a dataset once, with their distance: as many rows as that, in tiles that all tasks share."""
    if metric(name) is hamming:
        return tiles.all_pairs(_texts(seqs)).select("dataset_id", "i", "j", "d")
    a = seqs.select("dataset_id", F.col("seq_index").alias("i"), F.col("sequence").alias("a"))
    b = seqs.select("dataset_id", F.col("seq_index").alias("j"), F.col("sequence").alias("b"))
    return a.join(b, "dataset_id").where("i < j").select("dataset_id", "i", "j", metric(name)(F.col("a"), F.col("b")).alias("d"))


def _texts(seqs: DataFrame) -> DataFrame:
    return seqs.select("dataset_id", F.col("seq_index").alias("id"), F.col("sequence").alias("text"))


def pair_extremes(seqs: DataFrame) -> DataFrame:
    """Least, mean and largest distance of a pair; the mean comes from position counts.

    Equal rows are one in the pair join, as multiplicity only matters for a least distance of 0.
    """
    classes = seqs.groupBy("dataset_id", "sequence").agg(F.count(F.lit(1)).alias("n"), F.min("seq_index").alias("seq_index"))
    ends = tiles.extremes(_texts(classes))
    again = classes.groupBy("dataset_id").agg(F.max("n").alias("most"))
    out = mean_pair_distance(seqs).join(again, "dataset_id").join(ends, "dataset_id", "left")
    least = F.when(F.col("most") > 1, 0).otherwise(F.coalesce("lo", F.lit(0)))
    return out.select("dataset_id", least.alias("min_distance"), F.col("mean_distance"), F.coalesce("hi", F.lit(0)).alias("max_distance"))


def neighbours(seqs: DataFrame, radius: int) -> DataFrame:
    """Pairs of different rows within a Hamming radius: ``dataset_id, i, j, d``.

    Cut into radius + 1 blocks, near strings agree on a whole block, so an equi-join on
    (dataset, length, block, text) finds all. Where blocks would have fewer than ``BLOCK`` symbols
    most pairs agree on one, and all are compared in tiles instead. Equal strings are one class
    and linked to their first row, which keeps a group of copies linear: rows are the classes'
    first ones, and copies are given as links of distance 0 to theirs. A pair is given at its
    first common block alone, so nothing is left to make distinct.
    """
    keys = ["dataset_id", "sequence"]
    first = stage(seqs.groupBy(*keys).agg(F.min("seq_index").alias("seq_index")), "first")
    copies = seqs.join(first.withColumnRenamed("seq_index", "i"), keys).where("seq_index <> i").select("dataset_id", "i", F.col("seq_index").alias("j"), F.lit(0).alias("d"))
    return in_bands(first.where(~short(radius)), radius).unionByName(tiles.pairs(_texts(first.where(short(radius))), radius)).unionByName(copies)


def near_pairs(seqs: DataFrame, radius: int) -> DataFrame:
    """All pairs i < j of rows within a Hamming radius, copies too: ``dataset_id, i, j, d``.

    There are as many as that: a group of n equal or near rows has n (n - 1) / 2. Short rows are
    compared in tiles, copies like others, so that all tasks share them. Of longer ones pairs of
    different texts come from bands, and each is then given for all rows of both, in chunks of
    about ``tiles.JOINED`` rows that meet each other.
    """
    keys, by = ["dataset_id", "sequence"], ["dataset_id", "i"]
    tiled = tiles.pairs(_texts(seqs.where(short(radius))), radius)
    rows = seqs.where(~short(radius))
    first = stage(rows.groupBy(*keys).agg(F.min("seq_index").alias("i"), F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / tiles.JOINED).cast("int")), "first")
    members = rows.join(first, keys).select(*by, F.pmod(F.xxhash64("seq_index"), F.col("chunks")).cast("int").alias("part"), F.col("seq_index").alias("row"))
    classes = in_bands(first.select(*keys, F.col("i").alias("seq_index")), radius)
    classes = classes.unionByName(first.where("n > 1").select(*by, F.col("i").alias("j"), F.lit(0).alias("d")))
    chunks = first.select(*by, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
    side = lambda df, to, more: df.select("dataset_id", F.col("i").alias(to), F.col("part").alias(f"part_{to}"), *more)
    met = classes.join(side(chunks, "i", []), by).join(side(chunks, "j", []), ["dataset_id", "j"])
    for to in ("i", "j"):
        met = met.join(side(members, to, [F.col("row").alias(f"row_{to}")]), ["dataset_id", to, f"part_{to}"])
    a, b = F.col("row_i"), F.col("row_j")
    return tiled.unionByName(met.where((F.col("i") != F.col("j")) | (a < b)).select("dataset_id", F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), "d"))


def short(radius: int) -> Column:
    """Whether bands of a row's blocks would tell few pairs apart."""
    return F.char_length("sequence") < BLOCK * (radius + 1)


def in_bands(first: DataFrame, radius: int) -> DataFrame:
    """`neighbours` of different rows that are longer than the radius."""
    n, k = F.char_length("sequence"), F.col("k")
    begin = lambda k: F.floor(k * n / (radius + 1)).cast("int")
    piece = lambda text, k: F.substring(text, begin(k) + 1, begin(k + 1) - begin(k))
    cut = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda k: F.struct(k.alias("k"), piece("sequence", k).alias("seg")))
    banded = first.select("dataset_id", F.col("seq_index").alias("i"), "sequence", packed(F.col("sequence")).alias("p"), n.alias("n"), F.explode(cut).alias("b")).select("dataset_id", "i", "sequence", "p", "n", "b.k", "b.seg")
    other = banded.select("dataset_id", "n", "k", "seg", F.col("i").alias("j"), F.col("sequence").alias("other"), F.col("p").alias("q"))
    met = banded.join(other, ["dataset_id", "n", "k", "seg"]).where("i < j")
    near = met.withColumn("d", hamming_of(F.col("sequence"), F.col("other"), F.col("p"), F.col("q"))).where(F.col("d") <= radius)
    # only pairs that are near are looked at again: does an earlier block agree?
    before = (k > 0) & F.exists(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda k: piece("sequence", k) == piece("other", k))
    return near.where(~before).select("dataset_id", "i", "j", "d")
