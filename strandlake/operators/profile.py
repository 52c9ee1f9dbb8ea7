"""Profiles of datasets: sizes, alphabets, position counts, diversity, blocks, clean-up.

Every operator takes ``sequences(dataset_id, seq_index, sequence)`` and answers for all datasets
at once. What needs positions goes through `symbol_counts`, whose size is positions x symbols a
dataset however many sequences there are, and whose counts are combined before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import size_text, symbols
from ..tables import number


def chars(seqs: DataFrame) -> DataFrame:
    """A row for each character: dataset_id, seq_index, pos (from 0), ch."""
    return seqs.select("dataset_id", "seq_index", F.posexplode(symbols("sequence")).alias("pos", "ch"))


def symbol_counts(seqs: DataFrame) -> DataFrame:
    """How often each symbol stands at each position, and the first row that has it there."""
    return chars(seqs).groupBy("dataset_id", "pos", "ch").agg(F.count(F.lit(1)).alias("cnt"), F.min("seq_index").alias("first_seen"))


def sizes(seqs: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Rows, least, most, mean and total characters; datasets without rows have zeros."""
    n = F.char_length("sequence")
    out = seqs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("size"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"), F.sum(n).alias("total_chars"))
    if datasets is None:
        return out
    zero = ["size", "min_length", "max_length", "avg_length", "total_chars"]
    return datasets.select("dataset_id").join(out, "dataset_id", "left").fillna(0, zero)


def uniformity(seqs: DataFrame, with_lengths: bool = False) -> DataFrame:
    """Whether all lengths are equal; the list of lengths by row is opt-in as it has no bound."""
    aggs = [(F.count_distinct(F.char_length("sequence")) == 1).alias("uniform")]
    if with_lengths:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("seq_index", F.char_length("sequence").alias("n")))), lambda x: x["n"]).alias("lengths"))
    return seqs.groupBy("dataset_id").agg(*aggs)


def alphabets(seqs: DataFrame) -> DataFrame:
    """The distinct characters in order, and how many there are."""
    seen = seqs.select("dataset_id", F.explode(F.array_distinct(symbols("sequence"))).alias("ch")).distinct()
    return seen.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("alphabet"), F.count(F.lit(1)).alias("alphabet_size"))


def foreign(seqs: DataFrame, alphabet: str) -> DataFrame:
    """Rows with characters outside the alphabet, for quarantine."""
    return seqs.where(F.translate("sequence", alphabet, "") != "")


def pair_counts(seqs: DataFrame) -> DataFrame:
    """Sums over all pairs of rows without making pairs: n, pairs, mismatches.

    At a position with n_p rows and symbol counts c the pairs that differ are C(n_p, 2) - sum of
    C(c, 2). Of unequal lengths the shorter one counts, as positions beyond have no pair.
    """
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    at = symbol_counts(seqs).groupBy("dataset_id", "pos").agg(F.sum("cnt").alias("n_p"), F.sum(two("cnt")).alias("same"))
    differ = at.groupBy("dataset_id").agg(F.sum(two("n_p") - F.col("same")).cast("long").alias("mismatches"))
    n = seqs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.char_length("sequence"), "seq_index").alias("first_length"))
    return n.join(differ, "dataset_id", "left").fillna(0, ["mismatches"]).withColumn("pairs", two("size").cast("long"))


def diversity(seqs: DataFrame) -> DataFrame:
    """Mean mismatches of a pair over the first row's length; 0 with under two rows."""
    value = F.when((F.col("size") < 2) | (F.col("first_length") == 0), 0.0).otherwise(F.col("mismatches") / F.col("pairs") / F.col("first_length"))
    return pair_counts(seqs).select("dataset_id", value.alias("diversity"))


def mean_pair_distance(seqs: DataFrame) -> DataFrame:
    """Mean Hamming distance of all pairs; 0 with under two rows."""
    return pair_counts(seqs).select("dataset_id", F.when(F.col("pairs") == 0, 0.0).otherwise(F.col("mismatches") / F.col("pairs")).alias("mean_distance"))


def with_pattern(seqs: DataFrame, pattern: str, position: int) -> DataFrame:
    """Rows with ``pattern`` at a 0-based position, from the end if negative; rows too short drop out."""
    start = F.lit(position + 1) if position >= 0 else F.char_length("sequence") + (position + 1)
    return seqs.where((start >= 1) & (F.substring("sequence", start, F.lit(len(pattern))) == pattern))


def append(seqs: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` after the rows of its dataset, numbered on."""
    return renumber(seqs.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1))), "part", "seq_index")


def remove(seqs: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows ``gone(dataset_id, seq_index)``; later rows move down."""
    return renumber(seqs.join(gone, ["dataset_id", "seq_index"], "left_anti"), "seq_index")


def renumber(seqs: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 0 in each dataset by the order, in ranges, so that no task sorts a whole dataset."""
    return number(seqs, "dataset_id", *order).select("dataset_id", "seq_index", "sequence")


def to_records(seqs: DataFrame) -> DataFrame:
    """One nested row a dataset."""
    return seqs.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("seq_index", "sequence"))).alias("sequences"))


def from_records(records: DataFrame) -> DataFrame:
    return records.select("dataset_id", F.explode("sequences").alias("s")).select("dataset_id", "s.seq_index", "s.sequence")


def preview(seqs: DataFrame, k: int = 5) -> DataFrame:
    """The first k rows of each dataset, kept while reading (a top-k a partition first)."""
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("seq_index"))
    return seqs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def info(seqs: DataFrame) -> DataFrame:
    """A row a dataset for a listing: sizes, alphabet, diversity, size in words, a guessed kind."""
    total = F.col("total_chars")
    kind = F.when(F.col("alphabet").rlike("^[ACGTN]+$"), "dna").when(F.col("alphabet").rlike("^[01]+$"), "binary").otherwise("text")
    out = sizes(seqs).join(uniformity(seqs), "dataset_id").join(alphabets(seqs), "dataset_id", "left").join(diversity(seqs), "dataset_id")
    return out.withColumn("size_kb", total / 1024).withColumn("size_text", size_text(total)).withColumn("kind", kind)


def uniformise(seqs: DataFrame, policy: str | None, pad: str = "N") -> DataFrame:
    """Equal lengths by policy: strict keeps uniform datasets only, majority the rows of the most
    frequent length (ties: the shortest), pad fills up to the longest, trim cuts to the shortest."""
    n = F.char_length("sequence")
    by = Window.partitionBy("dataset_id")
    if policy is None:
        return seqs
    if policy == "majority":
        top = seqs.groupBy("dataset_id", n.alias("n")).count().groupBy("dataset_id").agg(F.max_by("n", F.struct("count", -F.col("n"))).alias("n"))
        return seqs.join(top, (seqs.dataset_id == top.dataset_id) & (n == top.n), "left_semi")
    if policy not in ("strict", "pad", "trim"):
        raise ValueError(f"unknown policy {policy!r}")
    span = seqs.groupBy("dataset_id").agg(F.min(n).alias("lo"), F.max(n).alias("hi"))
    both = seqs.join(span, "dataset_id")
    if policy == "strict":
        return both.where("lo = hi").drop("lo", "hi")
    new = F.rpad("sequence", F.col("hi"), F.lit(pad)) if policy == "pad" else F.substring("sequence", F.lit(1), F.col("lo"))
    return both.withColumn("sequence", new).drop("lo", "hi")


def block_spans(lengths: DataFrame, rule: str = "even", blocks: int = 4, size: int = 4, least: int = 1, most_blocks: int | None = None) -> DataFrame:
    """``lengths(dataset_id, length)`` -> half-open spans ``(dataset_id, block_no, l, r)``.

    even: so many blocks, the first ones longer by the remainder; sqrt: ceil(sqrt(length))
    blocks; fixed: blocks of a size; proportional: block i ends at the floor of (i + 1) * length /
    blocks. Of more than ``most_blocks`` the first ones stay and the last of these reaches to the
    end. A block under ``least`` joins the one before; a first one has none before.
    """
    n = F.col("length")
    if rule == "fixed":
        count = F.ceil(n / size).cast("int")
        l = lambda i: i * size
        r = lambda i: F.least(n, (i + 1) * size)
    elif rule in ("even", "sqrt"):
        count = F.greatest(F.lit(1), F.least(n, F.lit(blocks) if rule == "even" else F.ceil(F.sqrt(n)).cast("int")))
        base, rest = F.floor(n / count).cast("int"), (n % count).cast("int")
        l = lambda i: i * base + F.least(i, rest)
        r = lambda i: (i + 1) * base + F.least(i + 1, rest)
    elif rule == "proportional":
        count = F.greatest(F.lit(1), F.least(n, F.lit(blocks)))
        l = lambda i: F.floor(i * n / count)
        r = lambda i: F.floor((i + 1) * n / count)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    if most_blocks is not None:
        count, whole = F.least(count, F.lit(most_blocks)), r
        r = lambda i: F.when(i == count - 1, n).otherwise(whole(i))
    spans = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(l(i).cast("int").alias("l"), r(i).cast("int").alias("r")))

    def join(done: Column, s: Column) -> Column:
        before = F.element_at(done, -1)
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(before["l"].alias("l"), s["r"].alias("r"))))
        return F.when((F.size(done) > 0) & (s["r"] - s["l"] < least), wider).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(spans, F.array().cast("array<struct<l:int,r:int>>"), join) if least > 1 else spans
    return lengths.where("length > 0").select("dataset_id", F.posexplode(merged).alias("block_no", "s")).select("dataset_id", "block_no", "s.l", "s.r")


def segments(seqs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every sequence cut at its dataset's spans."""
    return seqs.join(spans, "dataset_id").select("dataset_id", "seq_index", "block_no", "l", "r", F.substring("sequence", F.col("l") + 1, F.col("r") - F.col("l")).alias("seg"))


def repair_length(candidate: Column, length: Column, alphabet: Column | None = None) -> Column:
    """Cut, or filled with its last character, else the alphabet's first symbol, else A."""
    fill = F.coalesce(F.nullif(F.right(candidate, F.lit(1)), F.lit("")), F.nullif(F.substring(alphabet, 1, 1), F.lit("")) if alphabet is not None else F.lit(None), F.lit("A"))
    return F.rpad(F.substring(candidate, F.lit(1), length), length, fill)


def entropies(seqs: DataFrame) -> DataFrame:
    """Shannon entropy in bits of each position."""
    total = F.sum("cnt").over(Window.partitionBy("dataset_id", "pos"))
    p = symbol_counts(seqs).withColumn("p", F.col("cnt") / total)
    return p.groupBy("dataset_id", "pos").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def entropy_spans(seqs: DataFrame, least: int = 2, share: float = 0.7) -> DataFrame:
    """Blocks walked from the left: ``least`` long where the entropy is above the share of the
    largest, twice that elsewhere. A fold, as each block begins where the one before ends."""
    rows = entropies(seqs).groupBy("dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entropy"))), lambda x: x["entropy"]).alias("e"))
    high = F.array_max("e") * share

    def step(acc: Column, at: Column) -> Column:
        size = F.when(F.element_at("e", at + 1) > high, F.lit(least)).otherwise(F.lit(2 * least))
        end = F.least(at + size, F.size("e"))
        grown = F.struct(end.alias("next"), F.concat(acc["spans"], F.array(F.struct(at.alias("l"), end.alias("r")))).alias("spans"))
        return F.when(at == acc["next"], grown).otherwise(acc)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<l:int,r:int>>").alias("spans"))
    spans = F.aggregate(F.sequence(F.lit(0), F.size("e") - 1), start, step)["spans"]
    return rows.select("dataset_id", F.posexplode(spans).alias("block_no", "s")).select("dataset_id", "block_no", "s.l", "s.r")


def observed_symbols(seqs: DataFrame) -> DataFrame:
    """The symbols seen at each position, in order."""
    return symbol_counts(seqs).groupBy("dataset_id", "pos").agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("symbols"))
