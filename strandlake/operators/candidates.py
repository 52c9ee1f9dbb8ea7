"""Candidate tables: neighbourhoods, augmentation, pools, and exact radius search.

Transforms of ``candidates(dataset_id, cand_id, candidate)``; random choices are hashes of the
seed and the row's keys, so a result depends on no partitioning and on no order of execution.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import pick, replace_at, symbols, unit
from ..tables import is_empty, number, stage, unstage
from .consensus import best_candidate, hill_climb, plurality, score_candidates
from .distance import center_distances, neighbours
from .profile import alphabets, chars

#: Rows that a move is held against before it is compared with all.
FAR_ROWS = 64


def _length() -> Column:
    return F.char_length("candidate")


def refine_greedy(seqs: DataFrame, centers: DataFrame, rounds: int | None = None) -> DataFrame:
    """Best symbol of the whole alphabet at any position until nothing improves, or for so many ``rounds``."""
    letters = alphabets(seqs).select("dataset_id", F.explode(symbols("alphabet")).alias("b"))
    places = chars(seqs).select("dataset_id", "pos").distinct()
    return hill_climb(seqs, centers, rounds, places.join(letters, "dataset_id"))


def _improve(seqs: DataFrame, centers: DataFrame, moves, rounds: int | None) -> DataFrame:
    """Rounds of: all texts that ``moves`` makes of each centre, the best kept if it is better; without a number until none is.

    A text at least as far from one of the ``FAR_ROWS`` rows that are farthest from its centre as
    the centre is from them can't be better; only the others are compared with all rows.
    """
    rows = stage(seqs.select("dataset_id", "sequence").distinct(), "rows")
    # a largest distance ignores copies, so only the rows just written are read
    state = stage(center_distances(rows, centers.select("dataset_id", "center")).groupBy("dataset_id", "center").agg(F.max("d").alias("max_distance")), "moves")
    state = state.withColumn("better", F.lit(True))
    for _ in count() if rounds is None else range(rounds):
        open_ = state.where("better")
        rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc_nulls_last("d"), "sequence"))
        far = center_distances(rows, open_.select("dataset_id", "center")).withColumn("rank", rank).where(F.col("rank") <= FAR_ROWS).select("dataset_id", "sequence")
        made = moves(open_.select("dataset_id", F.col("center").alias("candidate")))
        bound = made.join(score_candidates(far, made).select("dataset_id", "candidate", F.col("max_d").alias("least")).distinct(), ["dataset_id", "candidate"])
        able = bound.join(open_.select("dataset_id", "max_distance"), "dataset_id").where(F.coalesce("least", F.lit(-1)) < F.col("max_distance"))
        best = best_candidate(score_candidates(rows, stage(able.select("dataset_id", "cand_no", "candidate"), "able"), distinct=True)).select("dataset_id", F.col("center").alias("new"), F.col("max_distance").alias("new_d"))
        both = state.drop("better").join(best, "dataset_id", "left").withColumn("better", F.coalesce(F.col("new_d") < F.col("max_distance"), F.lit(False)))
        before, state = state, stage(both.select("dataset_id", F.when(F.col("better"), F.col("new")).otherwise(F.col("center")).alias("center"), F.when(F.col("better"), F.col("new_d")).otherwise(F.col("max_distance")).alias("max_distance"), "better"), "moves")
        unstage(before)
        if is_empty(state.where("better")):
            break
    return state.drop("better")


def _pairs_of_places(df: DataFrame) -> DataFrame:
    """Each candidate with all places i < j."""
    i = df.withColumn("i", F.explode(F.when(_length() > 1, F.sequence(F.lit(0), _length() - 2)).otherwise(F.array().cast("array<int>"))))
    return i.withColumn("j", F.explode(F.sequence(F.col("i") + 1, _length() - 1))).withColumn("cand_no", F.col("i") * _length() + F.col("j"))


def swaps(df: DataFrame) -> DataFrame:
    """All exchanges of two symbols."""
    at = lambda c: F.substring("candidate", F.col(c) + 1, F.lit(1))
    new = replace_at(replace_at(F.col("candidate"), F.col("i"), at("j")), F.col("j"), at("i"))
    return _pairs_of_places(df).select("dataset_id", "cand_no", new.alias("candidate"))


def reversals(df: DataFrame) -> DataFrame:
    """All reversals of a stretch from i to j."""
    c = F.col("candidate")
    new = F.concat(F.substring(c, F.lit(1), F.col("i")), F.reverse(F.substring(c, F.col("i") + 1, F.col("j") - F.col("i") + 1)), F.substring(c, F.col("j") + 2, _length()))
    return _pairs_of_places(df).select("dataset_id", "cand_no", new.alias("candidate"))


def insertions(df: DataFrame, longest: int = 3) -> DataFrame:
    """All moves of a stretch of 1..longest symbols to another place."""
    none = F.array().cast("array<int>")
    rows = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest)))).where(F.col("n") < _length())
    rows = rows.withColumn("i", F.explode(F.when(_length() >= F.col("n"), F.sequence(F.lit(0), _length() - F.col("n"))).otherwise(none)))
    rest = F.concat(F.substring("candidate", F.lit(1), F.col("i")), F.substring("candidate", F.col("i") + F.col("n") + 1, _length()))
    rows = rows.withColumn("rest", rest).withColumn("t", F.explode(F.sequence(F.lit(0), _length() - F.col("n")))).where("t <> i")
    new = F.concat(F.substring("rest", F.lit(1), F.col("t")), F.substring("candidate", F.col("i") + 1, F.col("n")), F.substring("rest", F.col("t") + 1, _length()))
    return rows.select("dataset_id", ((F.col("n") * _length() + F.col("i")) * (_length() + 1) + F.col("t")).alias("cand_no"), new.alias("candidate"))


def refine_swap(seqs: DataFrame, centers: DataFrame, rounds: int = 1) -> DataFrame:
    return _improve(seqs, centers, swaps, rounds)


def refine_insertion(seqs: DataFrame, centers: DataFrame, rounds: int = 1) -> DataFrame:
    return _improve(seqs, centers, insertions, rounds)


def refine_2opt(seqs: DataFrame, centers: DataFrame, rounds: int | None = None) -> DataFrame:
    return _improve(seqs, centers, reversals, rounds)


# ------------------------------------------------------------------ augmentation


def other_symbol(x: Column, alphabet: str, *keys) -> Column:
    """A hashed symbol of the alphabet that isn't x; x itself if there is none."""
    rest = F.translate(F.lit(alphabet), x, F.lit("")) if isinstance(x, str) else F.replace(F.lit(alphabet), x, F.lit(""))
    return F.when(F.char_length(rest) == 0, x).otherwise(F.substring(rest, pick(F.char_length(rest), *keys) + 1, F.lit(1)))


def mutate_multi(cands: DataFrame, alphabet: str, n: int = 2, seed: int = 0) -> DataFrame:
    """n hashed places, one after the other, each given another symbol."""

    def step(s: Column, k: Column) -> Column:
        pos = pick(F.char_length(s), seed, F.lit("p"), F.col("dataset_id"), F.col("cand_id"), k)
        old = F.substring(s, pos + 1, F.lit(1))
        return replace_at(s, pos, other_symbol(old, alphabet, seed, F.lit("s"), F.col("dataset_id"), F.col("cand_id"), k))

    made = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.col("candidate"), step) if n > 0 else F.col("candidate")
    return cands.withColumn("candidate", F.when(_length() > 0, made).otherwise(F.col("candidate")))


def _stretch(seed: int) -> tuple[Column, Column]:
    """Two hashed places i <= j."""
    a, b = (pick(_length(), seed, F.lit(k), F.col("dataset_id"), F.col("cand_id")) for k in "ab")
    return F.least(a, b), F.greatest(a, b)


def mutate_inversion(cands: DataFrame, seed: int = 0) -> DataFrame:
    """A hashed stretch reversed."""
    c, (i, j) = F.col("candidate"), _stretch(seed)
    new = F.concat(F.substring(c, F.lit(1), i), F.reverse(F.substring(c, i + 1, j - i + 1)), F.substring(c, j + 2, _length()))
    return cands.withColumn("candidate", F.when(_length() > 1, new).otherwise(c))


def mutate_transposition(cands: DataFrame, seed: int = 0) -> DataFrame:
    """A hashed stretch taken out and put in again at a hashed place of the rest."""
    c, (i, j) = F.col("candidate"), _stretch(seed)
    rest = F.concat(F.substring(c, F.lit(1), i), F.substring(c, j + 2, _length()))
    at = pick(F.char_length(rest) + 1, seed, F.lit("t"), F.col("dataset_id"), F.col("cand_id"))
    new = F.concat(F.substring(rest, F.lit(1), at), F.substring(c, i + 1, j - i + 1), F.substring(rest, at + 1, _length()))
    return cands.withColumn("candidate", F.when(_length() > 1, new).otherwise(c))


def couples(cands: DataFrame) -> DataFrame:
    """Candidates in pairs, by order of cand_id; an odd last one has no partner and drops out."""
    no = F.col("no")
    rows = number(cands, "dataset_id", "cand_id", name="no").withColumn("pair", F.floor(no / 2).cast("int")).withColumn("side", no % 2)
    a = rows.where("side = 0").select("dataset_id", "pair", F.col("candidate").alias("a"))
    return a.join(rows.where("side = 1").select("dataset_id", "pair", F.col("candidate").alias("b")), ["dataset_id", "pair"])


def _children(df: DataFrame, one: Column, two: Column) -> DataFrame:
    return df.select("dataset_id", F.posexplode(F.array(one, two)).alias("k", "candidate"), "pair").select("dataset_id", (F.col("pair") * 2 + F.col("k")).alias("cand_id"), "candidate")


def crossover_one_point(cands: DataFrame, seed: int = 0) -> DataFrame:
    """Both tails exchanged from a hashed point in 1..length-1."""
    n = F.char_length("a")
    p = F.when(n > 1, 1 + pick(n - 1, seed, F.col("dataset_id"), F.col("pair"))).otherwise(n)
    head, tail = (lambda c: F.substring(c, F.lit(1), F.col("p"))), (lambda c: F.substring(c, F.col("p") + 1, F.char_length(c)))
    return _children(couples(cands).withColumn("p", p), F.concat(head("a"), tail("b")), F.concat(head("b"), tail("a")))


def crossover_uniform(cands: DataFrame, seed: int = 0) -> DataFrame:
    """A hashed coin for each position says which parent's symbol goes to which child."""
    both = F.arrays_zip(symbols("a").alias("a"), symbols("b").alias("b"))
    coin = lambda i: unit(seed, F.col("dataset_id"), F.col("pair"), i) < 0.5
    child = lambda x, y: F.array_join(F.transform("both", lambda s, i: F.when(coin(i), s[x]).otherwise(s[y])), "")
    return _children(couples(cands).withColumn("both", both), child("a", "b"), child("b", "a"))


def crossover_blocks(cands: DataFrame, spans: DataFrame, seed: int = 0) -> DataFrame:
    """A hashed coin for each block."""
    blocks = spans.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("spans"))
    coin = lambda i: unit(seed, F.col("dataset_id"), F.col("pair"), i) < 0.5
    part = lambda c, s: F.substring(F.col(c), s["l"] + 1, s["r"] - s["l"])
    child = lambda x, y: F.array_join(F.transform("spans", lambda s, i: F.when(coin(i), part(x, s)).otherwise(part(y, s))), "")
    return _children(couples(cands).join(blocks, "dataset_id"), child("a", "b"), child("b", "a"))


def pool(seqs: DataFrame, spans: DataFrame, alphabet: str, size: int | None = None, factor: float = 1.5, least: int = 4, seed: int = 0) -> DataFrame:
    """A start pool: the consensus, a third with blocks borrowed from random rows, the rest random.

    The size is given, or ``factor`` times the rows and at least ``least``. Borrowed blocks come
    by joining hashed row numbers, so no task holds a dataset.
    """
    n = seqs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    base = plurality(seqs).join(n, "dataset_id").withColumn("size", F.lit(size) if size else F.greatest(F.lit(least), F.floor(F.col("n") * factor)).cast("int"))
    rows = base.withColumn("cand_id", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    third = F.floor(F.col("size") / 3)
    first = rows.where("cand_id = 0").select("dataset_id", "cand_id", F.col("center").alias("candidate"))
    mixed = rows.where((F.col("cand_id") >= 1) & (F.col("cand_id") <= third)).join(spans, "dataset_id")
    lend = pick(F.col("n"), seed, F.lit("row"), F.col("dataset_id"), F.col("cand_id"), F.col("block_no"))
    taken = unit(seed, F.lit("coin"), F.col("dataset_id"), F.col("cand_id"), F.col("block_no")) < 0.5
    numbered = number(seqs, "dataset_id", "seq_index", name="no").select("dataset_id", "no", "sequence")
    cut = lambda c: F.substring(c, F.col("l") + 1, F.col("r") - F.col("l"))
    lent = mixed.withColumn("no", lend).withColumn("taken", taken).join(numbered, ["dataset_id", "no"]).withColumn("part", F.when(F.col("taken"), cut("sequence")).otherwise(cut("center")))
    from .consensus import joined

    mixed = joined(lent, ["dataset_id", "cand_id"], "block_no", "part", "candidate")
    symbol = lambda i: F.substring(F.lit(alphabet), pick(len(alphabet), seed, F.lit("fill"), F.col("dataset_id"), F.col("cand_id"), i) + 1, F.lit(1))
    fill = rows.where(F.col("cand_id") > third).select("dataset_id", "cand_id", F.array_join(F.transform(F.sequence(F.lit(1), F.char_length("center")), symbol), "").alias("candidate"))
    return first.unionByName(mixed).unionByName(fill)


def elite(scored: DataFrame, rate: float = 0.1) -> DataFrame:
    """The best ``max(1, floor(rate * size))`` candidates of each pool, by (max_d, cand_no)."""
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("max_d", "cand_no"))
    size = scored.groupBy("dataset_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * rate)).alias("k"))
    return scored.withColumn("rank", rank).join(size, "dataset_id").where(F.col("rank") <= F.col("k")).drop("k")


def niche(scored: DataFrame, radius: int) -> DataFrame:
    """Greedy thinning: best first, a candidate stays if it is ``radius`` away from all that stay.

    Rounds instead of a loop over rows: a candidate stays if none of its open neighbours is
    better; those near to one that stays go; the others wait for the next round. Of equal
    candidates only the best can stay at a radius above 0: whatever is near to it is near to all.
    """
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("max_d", "cand_no")).cast("int")
    ranked = scored.withColumn("rank", rank)
    if radius > 0:
        own = F.when(F.col("candidate").isNull(), F.col("rank")).alias("own")  # a null is no one's equal
        best = ranked.groupBy("dataset_id", "candidate", own).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in ranked.columns]), "rank").alias("best"))
        ranked = best.select("best.*")
    open_ = stage(ranked, "niche")
    asked = open_.select("dataset_id", F.col("rank").alias("seq_index"), F.col("candidate").alias("sequence"))
    links = neighbours(asked, radius - 1) if radius > 0 else neighbours(asked, 0).where("false")
    near = stage(links.select("dataset_id", F.col("i").alias("rank"), F.col("j").alias("other")), "near")  # i < j: i is the better
    kept = None
    while not is_empty(open_):
        ranks = open_.select("dataset_id", "rank")
        beaten = near.join(ranks, ["dataset_id", "rank"], "left_semi").select("dataset_id", F.col("other").alias("rank")).distinct()
        stay = stage(open_.join(beaten, ["dataset_id", "rank"], "left_anti"), "stay")
        kept = stay if kept is None else kept.unionByName(stay)
        gone = near.join(stay.select("dataset_id", "rank"), ["dataset_id", "rank"], "left_semi").select("dataset_id", F.col("other").alias("rank")).distinct()
        open_ = stage(open_.join(stay.select("dataset_id", "rank"), ["dataset_id", "rank"], "left_anti").join(gone, ["dataset_id", "rank"], "left_anti"), "niche")
    return kept if kept is not None else open_


# ------------------------------------------------------------------ exact radius


def upper_bound(seqs: DataFrame) -> DataFrame:
    """The first row as a centre: ``(dataset_id, center, max_distance)``."""
    first = seqs.groupBy("dataset_id").agg(F.min_by("sequence", "seq_index").alias("center"))
    return center_distances(seqs, first).groupBy("dataset_id", "center").agg(F.max("d").alias("max_distance"))


def feasible(seqs: DataFrame, radii: DataFrame) -> DataFrame:
    """``radii(dataset_id, radius)`` -> those with a centre within, and the smallest such centre.

    A frontier of states, the errors each distinct row has left, goes from position to position:
    every symbol is tried, states below zero go, equal ones are one and keep the smallest path.
    """
    rows = seqs.select("dataset_id", "sequence").distinct()
    held = stage(rows.groupBy("dataset_id").agg(F.array_sort(F.collect_list("sequence")).alias("rows")).join(alphabets(seqs).select("dataset_id", "alphabet"), "dataset_id").join(radii, "dataset_id"), "radius")
    longest = held.agg(F.max(F.char_length(F.col("rows")[0]))).first()[0] or 0
    frontier = held.select("dataset_id", F.transform("rows", lambda _: F.col("radius")).alias("left"), F.lit("").alias("path"))
    size = F.char_length(F.col("rows")[0])
    for pos in range(longest):
        both = frontier.join(held, "dataset_id")
        tried = both.where(size > pos).withColumn("c", F.explode(symbols("alphabet")))
        left = F.zip_with("left", "rows", lambda n, s: n - (F.substring(s, pos + 1, 1) != F.col("c")).cast("int"))
        grown = tried.select("dataset_id", left.alias("left"), F.concat("path", "c").alias("path")).where(F.array_min("left") >= 0)
        grown = grown.groupBy("dataset_id", "left").agg(F.min("path").alias("path"))
        frontier = stage(grown.unionByName(both.where(size <= pos).select("dataset_id", "left", "path")), "frontier")
    return frontier.groupBy("dataset_id").agg(F.min("path").alias("center")).join(radii, "dataset_id").select("dataset_id", "radius", "center")


def smallest_radius(seqs: DataFrame, most_states: float = 2e6) -> DataFrame:
    """Binary search over `feasible`, all open datasets in each round.

    ``(dataset_id, success, radius, center, error)``. A dataset whose (radius + 1)^rows exceeds
    ``most_states`` at the first row's bound is an error row, as is one of unequal lengths.
    """
    shape = seqs.groupBy("dataset_id").agg(F.count_distinct("sequence").alias("n"), (F.count_distinct(F.char_length("sequence")) == 1).alias("uniform"))
    bound = upper_bound(seqs).join(shape, "dataset_id", "right")
    large = F.pow(F.col("max_distance") + 1.0, F.col("n")) > most_states
    error = F.when(~F.col("uniform"), "unequal lengths").when(large, "too many states")
    known = stage(bound.withColumn("error", error), "bounds")
    state = stage(known.where("error is null").select("dataset_id", F.lit(0).alias("lo"), F.col("max_distance").alias("hi"), "center"), "search")
    usable = seqs.join(state.select("dataset_id"), "dataset_id", "left_semi")
    while not is_empty(state.where("lo < hi")):
        asked = state.where("lo < hi").select("dataset_id", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("radius"))
        found = feasible(usable.join(asked.select("dataset_id"), "dataset_id", "left_semi"), asked).select("dataset_id", F.col("center").alias("new"))
        both = state.join(asked, "dataset_id", "left").join(found, "dataset_id", "left")
        open_, ok = F.col("radius").isNotNull(), F.col("new").isNotNull()
        state = stage(both.select("dataset_id", F.when(open_ & ~ok, F.col("radius") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & ok, F.col("radius")).otherwise(F.col("hi")).alias("hi"), F.when(open_ & ok, F.col("new")).otherwise(F.col("center")).alias("center")), "search")
    fine = state.select("dataset_id", F.lit(True).alias("success"), F.col("hi").alias("radius"), "center", F.lit(None).cast("string").alias("error"))
    return fine.unionByName(known.where("error is not null").select("dataset_id", F.lit(False).alias("success"), F.lit(None).cast("int").alias("radius"), F.lit(None).cast("string").alias("center"), "error"))
