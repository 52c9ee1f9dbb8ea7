"""Consensus strings, clusters and block heuristics, for all datasets in one job."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import hamming, hamming_of, packed, symbols, unit
from ..tables import is_empty, number, stage, unstage
from .components import connected_components
from .distance import center_distances, in_bands, short, summary
from .profile import block_spans, mean_pair_distance, repair_length, segments, sizes, symbol_counts
from .tiles import best_joined, farthest, links, weights_near

#: Bounds of the automatic cluster radius and block count.
AUTO = {"min_d": 2, "d_factor": 0.8, "min_blocks": 2, "max_blocks": 4, "n_div": 6, "l_div": 25}
MAX_CANDIDATES = 5000
#: Difficulty tiers and search bounds of the block heuristic.
TIERS = (2, 4, 8)
EXHAUSTIVE_LIMIT = 10_000
BEAM_WIDTH = 32
K_CANDIDATES = 5


def joined(rows: DataFrame, keys: list[str], order: str, text: str, name: str) -> DataFrame:
    """The texts of each key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(name))


def greedy_consensus(seqs: DataFrame, tie: str = "lex", alphabet: str | None = None, seed: int = 0, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """The most frequent symbol of each position: ``(dataset_id, center)``.

    Ties: lex the smallest, first the earliest in the alphabet, seen the one that the earliest row
    has, random by a hash of the seed; others are lex. Only symbols of a given alphabet can win;
    a position without any gets the alphabet's smallest.
    """
    counts = symbol_counts(seqs) if keys == ("dataset_id",) else _counts_by(seqs, keys)
    cnt = F.col("cnt") if alphabet is None else F.when(F.instr(F.lit(alphabet), F.col("ch")) > 0, F.col("cnt")).otherwise(-1)
    rank = {"first": F.instr(F.lit(alphabet or ""), F.col("ch")), "seen": F.col("first_seen"), "random": unit(seed, F.col("pos"), F.col("ch"))}.get(tie, F.lit(0))
    best = counts.groupBy(*keys, "pos").agg(F.min_by(F.struct("ch", cnt.alias("cnt")), F.struct(-cnt, rank, "ch")).alias("b"))
    win = F.col("b.ch") if alphabet is None else F.when(F.col("b.cnt") >= 0, F.col("b.ch")).otherwise(min(alphabet))
    return joined(best.withColumn("win", win), list(keys), "pos", "win", "center")


def _counts_by(seqs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    ch = seqs.select(*keys, "seq_index", F.posexplode(symbols("sequence")).alias("pos", "ch"))
    return ch.groupBy(*keys, "pos", "ch").agg(F.count(F.lit(1)).alias("cnt"), F.min("seq_index").alias("first_seen"))


def plurality(seqs: DataFrame) -> DataFrame:
    """Consensus whose ties go to the symbol of the earliest row."""
    return greedy_consensus(seqs, "seen")


def results(seqs: DataFrame, centers: DataFrame, method: str, datasets: DataFrame | None = None) -> DataFrame:
    """Result rows of a method: distances of its centres; datasets without strings are error rows."""
    found = summary(center_distances(seqs, centers), "center")
    known = sizes(seqs, datasets)
    row = known.join(found, "dataset_id", "left")
    ok = F.col("center").isNotNull() & (F.char_length("center") > 0)
    return row.select(
        "dataset_id", F.lit(method).alias("method"), ok.alias("success"), F.col("center").alias("center_string"),
        F.when(ok, F.col("max_distance")).otherwise(-1).alias("max_distance"), "avg_distance", F.col("total_distance").cast("long").alias("total_distance"),
        F.create_map(F.lit("size"), F.col("size").cast("string")).alias("parameters"), F.when(~ok, F.lit("no strings or no alphabet")).alias("error"),
    )


def block_difficulty(seqs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per block its plurality consensus, the worst distance to it, and its tier's limits met."""
    segs = segments(seqs, spans)
    by = ["dataset_id", "block_no"]
    centers = greedy_consensus(segs.withColumnRenamed("seg", "sequence"), "seen", keys=("dataset_id", "block_no"))
    d = segs.join(centers, by).withColumn("d", hamming(F.col("seg"), F.col("center")))
    return d.groupBy(*by, "l", "r", "center").agg(F.max("d").alias("difficulty"))


def difficulty_summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("dataset_id").agg(F.min("difficulty").alias("easiest"), F.max("difficulty").alias("hardest"), F.avg("difficulty").alias("mean_difficulty"))


def technique(difficulty: Column, small: int = TIERS[0], medium: int = TIERS[1], large: int = TIERS[2]) -> Column:
    """exhaustive up to small, reduced_beam up to medium, else beam; limits are put in order."""
    a, b, _ = sorted((small, medium, large))
    return F.when(difficulty <= a, "exhaustive").when(difficulty <= b, "reduced_beam").otherwise("beam")


# ------------------------------------------------------------------ clusters and recombination


def auto_parameters(seqs: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, d, n_blocks)``: by size, length and mean distance; given values win.

    ``params`` may hold dataset_id and any of d, n_blocks and the keys of AUTO.
    """
    base = sizes(seqs).join(mean_pair_distance(seqs), "dataset_id").join(seqs.groupBy("dataset_id").agg(F.min_by(F.char_length("sequence"), "seq_index").alias("length")), "dataset_id")
    if params is not None:
        base = base.join(params, "dataset_id", "left")
    of = lambda k: F.coalesce(F.col(k), F.lit(AUTO[k])) if params is not None and k in params.columns else F.lit(AUTO[k])
    few = F.col("size") < 2
    d = F.when(few, of("min_d")).otherwise(F.greatest(of("min_d"), F.floor(F.col("mean_distance") * of("d_factor")))).cast("int")
    blocks = F.when(few, of("min_blocks")).otherwise(F.greatest(of("min_blocks"), F.least(of("max_blocks"), F.floor(F.col("size") / of("n_div")), F.floor(F.col("length") / of("l_div"))))).cast("int")
    given = lambda k, auto: F.coalesce(F.col(k), auto) if params is not None and k in params.columns else auto
    return base.select("dataset_id", given("d", d).alias("d"), given("n_blocks", blocks).alias("n_blocks"), F.col("length"))


def clusters(seqs: DataFrame, radius: int, min_samples: int = 2) -> DataFrame:
    """Density clusters ``(dataset_id, seq_index, cluster_id)``; noise has no row.

    A row is core if it and its neighbours are at least ``min_samples``; components of core rows
    are clusters, other neighbours join the smallest one they touch. Clusters are numbered from 0
    by their first member. Equal rows count for the density of their class. Pairs of short rows are
    counted and joined in tiles, which give rows and links but not the pairs of a large group. For
    two samples or less every row with another one near is core, so links alone tell all, and rows
    are compared once.
    """
    keys = ["dataset_id", "sequence"]
    copies = stage(seqs.groupBy(*keys).agg(F.min("seq_index").alias("i"), F.count(F.lit(1)).alias("n")), "copies")
    near = in_bands(copies.where(~short(radius)).select(*keys, F.col("i").alias("seq_index")), radius)
    tiled = copies.where(short(radius))
    texts = lambda df, more: df.select("dataset_id", F.col("i").alias("id"), F.col("sequence").alias("text"), F.col(more).cast("bigint").alias("more"))
    if min_samples <= 2:
        inner = stage(near.select("dataset_id", "i", "j").unionByName(links(texts(tiled.withColumn("core", F.lit(True)), "core"), radius)), "links")
        core = copies.where(F.col("n") >= min_samples).select("dataset_id", "i")  # the others are in links
        found = None
    else:
        near = stage(near, "links")
        banded = near.select("dataset_id", "i", "j").unionByName(near.select("dataset_id", F.col("j").alias("i"), F.col("i").alias("j")))
        weights = copies.select("dataset_id", F.col("i").alias("j"), "n")
        around = banded.join(weights, ["dataset_id", "j"]).groupBy("dataset_id", "i").agg(F.sum("n").alias("others"))
        around = around.unionByName(weights_near(texts(tiled, "n"), radius).withColumnRenamed("id", "i"))
        degree = copies.join(around, ["dataset_id", "i"], "left").withColumn("core", F.col("n") + F.coalesce("others", F.lit(0)) >= min_samples)
        # a row without others near has no links
        degree = stage(degree.where(F.col("core") | F.col("others").isNotNull()), "degree")
        core = degree.where("core").select("dataset_id", "i")
        found = stage(banded.unionByName(links(texts(degree.where(short(radius)), "core"), radius)), "links")
        found = found.join(core.withColumnRenamed("i", "j"), ["dataset_id", "j"], "left_semi")
        inner = found.join(core, ["dataset_id", "i"], "left_semi")
    node = lambda c: F.struct("dataset_id", F.col(c).alias("i"))
    loops = core.select(node("i").alias("src"), node("i").alias("dst"))
    roots = connected_components(inner.select(node("i").alias("src"), node("j").alias("dst")).unionByName(loops))
    roots = stage(roots.select(F.col("node.dataset_id").alias("dataset_id"), F.col("node.i").alias("i"), F.col("root.i").alias("of")), "roots")
    # known by its first core row, whatever links were given
    roots = roots.join(roots.groupBy("dataset_id", "of").agg(F.min("i").alias("root")), ["dataset_id", "of"]).drop("of")
    if found is not None:
        border = found.join(core, ["dataset_id", "i"], "left_anti").join(roots.withColumnRenamed("i", "j"), ["dataset_id", "j"]).groupBy("dataset_id", "i").agg(F.min("root").alias("root"))
        roots = roots.unionByName(border)
    classes = stage(roots, "classes")
    members = seqs.join(copies.drop("n"), keys).join(classes, ["dataset_id", "i"]).select("dataset_id", "seq_index", "root")
    first = members.groupBy("dataset_id", "root").agg(F.min("seq_index").alias("first"))
    numbered = number(first, "dataset_id", "first", name="cluster_id")
    return members.join(numbered.drop("first"), ["dataset_id", "root"]).select("dataset_id", "seq_index", "cluster_id")


def cluster_consensus(seqs: DataFrame, members: DataFrame) -> DataFrame:
    """``(dataset_id, cluster_id, center)``."""
    return greedy_consensus(seqs.join(members, ["dataset_id", "seq_index"]), "seen", keys=("dataset_id", "cluster_id"))


def _choices(centers: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of all centres, ``(dataset_id, nth, block, part)``, and for each dataset its first
    centre, the number b of that one's blocks, and the number k of centres."""
    length = F.char_length("center")
    ranked = stage(number(centers.where(length > 0).select("dataset_id", "cluster_id", "center"), "dataset_id", "cluster_id", name="nth"), "ranked")
    blocks = F.least(F.lit(n_blocks), length)
    base, rest = F.floor(length / blocks), length % blocks
    begin = lambda i: (i * base + F.least(i, rest)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring("center", begin(i) + 1, begin(i + 1) - begin(i)))
    parts = ranked.select("dataset_id", "nth", F.posexplode(cut).alias("block", "part"))
    k = ranked.groupBy("dataset_id").agg(F.count(F.lit(1)).cast("int").alias("k"))
    return parts, ranked.where("nth = 0").select("dataset_id", F.col("center").alias("first"), blocks.alias("b")).join(k, "dataset_id")


def recombine(centers: DataFrame, n_blocks: int = 2, mode: str = "per_block", limit: int = MAX_CANDIDATES) -> DataFrame:
    """``centers(dataset_id, cluster_id, center)`` -> ``(dataset_id, cand_no, candidate)``.

    per_block: one cluster's block for each block position, k^blocks strings. reference: one
    block out of each cluster's centre, blocks^k strings, cut or filled up from the first centre
    to its length. Candidates are numbered in order of their choices, and those from ``limit`` on
    are left out, as the choices of a number are its digits. Each digit is a row that is joined to
    its part, so no row holds a dataset's centres.
    """
    parts, held = _choices(centers, n_blocks)
    radix, digits = ("k", "b") if mode == "per_block" else ("b", "k")
    held = held.withColumn("radix", F.col(radix)).withColumn("digits", F.col(digits))
    total = F.least(F.lit(limit).cast("double"), F.pow(F.col("radix").cast("double"), F.col("digits"))).cast("int")
    numbers = held.withColumn("cand_no", F.explode(F.sequence(F.lit(0), total - 1))).select("dataset_id", "radix", "digits", "cand_no")
    # a number's digits, one row each, meet the part that digit and place name
    rows = numbers.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)))
    digit = F.floor(F.col("cand_no") / F.pow(F.col("radix").cast("double"), F.col("digits") - 1 - F.col("place"))).cast("int") % F.col("radix")
    nth, block = (digit, F.col("place")) if mode == "per_block" else (F.col("place"), digit)
    met = rows.select("dataset_id", "cand_no", "place", nth.alias("nth"), block.alias("block")).join(parts, ["dataset_id", "nth", "block"], "left")
    made = joined(met, ["dataset_id", "cand_no"], "place", "part", "made").join(held.select("dataset_id", "first"), "dataset_id")
    size = F.char_length("first")
    full = F.concat("made", F.substring("first", F.char_length("made") + 1, size))
    return stage(made.select("dataset_id", "cand_no", F.substring(full, F.lit(1), size).alias("candidate")), "recombined")


def score_candidates(seqs: DataFrame, candidates: DataFrame, distinct: bool = False) -> DataFrame:
    """Candidates with their largest distance, each distinct text scored once; ``distinct`` if ``seqs`` are written and without copies."""
    texts = stage(candidates.select("dataset_id", F.col("candidate").alias("text")).distinct(), "texts")
    rows = seqs.select("dataset_id", F.col("sequence").alias("text"))
    if not distinct:
        rows = stage(rows.distinct(), "rows")  # a largest distance ignores copies
    scored = stage(farthest(texts, rows).select("dataset_id", F.col("text").alias("candidate"), F.col("d").alias("max_d")), "scored")
    return candidates.join(scored, ["dataset_id", "candidate"])


def best_candidate(scored: DataFrame) -> DataFrame:
    """The first candidate with the smallest largest distance."""
    best = scored.groupBy("dataset_id").agg(F.min_by(F.struct("candidate", "max_d"), F.struct("max_d", "cand_no")).alias("b"))
    return best.select("dataset_id", F.col("b.candidate").alias("center"), F.col("b.max_d").alias("max_distance"))


def best_by_bounds(seqs: DataFrame, candidates: DataFrame, first: int = 1024) -> DataFrame:
    """As `best_candidate` of `score_candidates`, plus ``scored``, the texts compared with all rows.

    A candidate's largest distance from a few rows bounds that from all. Each round compares the
    ``first`` candidates of least bound, then eight times as many, with all rows; the rows they are
    farthest from raise the others' bounds, and candidates that can't beat the best one go. It
    ends when none is left, so the result is exact; where bounds tell nothing, the growing rounds
    compare all candidates with all rows and as many rows with all candidates. Distances between
    texts of unequal length are null and count as below 0, as in `best_candidate`.
    """
    rows = stage(seqs.select("dataset_id", "sequence").distinct(), "rows")
    low = lambda c: F.coalesce(F.col(c), F.lit(-1))
    texts = candidates.where("candidate IS NOT NULL").join(rows.select("dataset_id").distinct(), "dataset_id", "left_semi").groupBy("dataset_id", "candidate").agg(F.min("cand_no").alias("cand_no"))
    open_ = stage(texts.withColumn("bound", F.lit(-1)), "open")
    best = open_.where("false").select("dataset_id", "candidate", "cand_no", F.lit(0).alias("max_d"), F.lit(0).cast("long").alias("scored"))
    batch = first
    while not is_empty(open_):
        rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("bound", "cand_no"))
        asked = stage(open_.withColumn("rank", rank).where(F.col("rank") <= batch).drop("rank"), "asked")
        far = farthest(asked.select("dataset_id", F.col("candidate").alias("text")), rows.withColumnRenamed("sequence", "text"))
        exact = stage(asked.select("dataset_id", "candidate", "cand_no").join(far.select("dataset_id", F.col("text").alias("candidate"), F.col("d").alias("max_d"), "far"), ["dataset_id", "candidate"]), "exact")
        both = best.unionByName(exact.select("dataset_id", "candidate", "cand_no", "max_d", F.lit(1).cast("long").alias("scored")))
        top = F.min_by(F.struct("candidate", "cand_no", "max_d"), F.struct(low("max_d"), "cand_no"))
        best = stage(both.groupBy("dataset_id").agg(top.alias("b"), F.sum("scored").alias("scored")).select("dataset_id", "b.*", "scored"), "best")
        limit = best.select("dataset_id", low("max_d").alias("best_d"), F.col("cand_no").alias("best_no"))
        can_win = F.struct("bound", "cand_no") < F.struct(F.col("best_d").alias("bound"), F.col("best_no").alias("cand_no"))
        rest = open_.join(asked.select("dataset_id", "candidate"), ["dataset_id", "candidate"], "left_anti").join(limit, "dataset_id").where(can_win)
        pivots = exact.where("far is not null").select("dataset_id", F.col("far").alias("sequence")).distinct()
        raised = score_candidates(pivots, rest.select("dataset_id", "candidate")).select("dataset_id", "candidate", "max_d")
        new = rest.join(raised, ["dataset_id", "candidate"], "left").withColumn("bound", F.greatest("bound", low("max_d"))).where(can_win)
        before, open_ = open_, stage(new.select("dataset_id", "candidate", "cand_no", "bound"), "open")
        unstage(before, asked, exact)
        batch *= 8
    return best.select("dataset_id", F.col("candidate").alias("center"), F.col("max_d").alias("max_distance"), "scored")


def _joined_halves(parts: DataFrame, held: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """All beginnings and all ends of per_block candidates, as `best_joined` takes them.

    Beginnings have half of the blocks; ``no`` are the choices as digits, of equal texts the first.
    An end is cut or filled up from the first centre, as what it follows leaves room for.
    """
    places = held.select("dataset_id", "k", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"))
    every = places.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).join(parts, ["dataset_id", "nth", "block"], "left")
    # a centre that is shorter than the first one may have fewer blocks
    choices = stage(every.groupBy("dataset_id", "block", F.coalesce("part", F.lit("")).alias("part")).agg(F.min("nth").alias("nth")), "choices")
    half = F.floor(F.col("b") / 2)

    def grown(first: Column, last: Column) -> DataFrame:
        out = held.select("dataset_id", "k", "b", F.lit(0).cast("long").alias("no"), F.lit("").alias("text"))
        for block in range(n_blocks):
            mine = (first <= block) & (last > block)
            more = out.where(mine).join(choices.where(F.col("block") == block), "dataset_id").groupBy("dataset_id", "k", "b", F.concat("text", "part").alias("text")).agg(F.min(F.col("no") * F.col("k") + F.col("nth")).alias("no"))
            out = more.unionByName(out.where(~mine))
        return out.select("dataset_id", "no", "text").join(held.select("dataset_id", "first"), "dataset_id")

    size, least = F.char_length("first"), F.min("no").alias("no")
    lefts = grown(F.lit(0), half).withColumn("cut", F.least(F.char_length("text"), size))
    lefts = stage(lefts.groupBy("dataset_id", "cut", F.substring("text", F.lit(1), size).alias("text")).agg(least), "lefts")
    rights = grown(half, F.col("b")).join(lefts.select("dataset_id", "cut").distinct(), "dataset_id")
    full = F.concat("text", F.substring("first", F.col("cut") + F.char_length("text") + 1, size))
    rights = stage(rights.groupBy("dataset_id", "cut", F.substring(full, F.lit(1), size - F.col("cut")).alias("text")).agg(least), "rights")
    return lefts, rights


def best_recombined(seqs: DataFrame, centers: DataFrame, n_blocks: int = 2, mode: str = "per_block", limit: int | None = None) -> DataFrame:
    """The first of all recombined candidates with the smallest largest distance: ``(dataset_id, center, max_distance)``.

    The first `MAX_CANDIDATES` are made and scored. Where per_block has more, all are searched for a
    better one as pairs of a beginning and an end, which need not be made. Only a given ``limit``
    leaves candidates out, and mode reference beyond `MAX_CANDIDATES`, as the reference does: its
    blocks^k strings double with each cluster.
    """
    centers = stage(centers, "centers")
    best = best_by_bounds(seqs, recombine(centers, n_blocks, mode, MAX_CANDIDATES if limit is None else limit)).select("dataset_id", "center", "max_distance")
    if limit is not None or mode != "per_block":
        return best
    parts, held = _choices(centers, n_blocks)
    more = held.where(F.pow(F.col("k").cast("double"), F.col("b")) > MAX_CANDIDATES)
    if is_empty(more):
        return best
    best, more = stage(best, "best"), stage(more, "more")
    lefts, rights = _joined_halves(parts.join(more.select("dataset_id"), "dataset_id", "left_semi"), more, n_blocks)
    most = more.join(best.where("max_distance IS NOT NULL"), "dataset_id").select("dataset_id", F.char_length("first").alias("size"), (F.col("max_distance") - 1).alias("most"))
    rows = seqs.select("dataset_id", F.col("sequence").alias("text")).distinct().join(most, "dataset_id").where(F.char_length("text") == F.col("size"))
    better = stage(best_joined(lefts, rights, rows.select("dataset_id", "text", "most")), "better")
    out = best.join(better, "dataset_id", "left")
    return out.select("dataset_id", F.coalesce("text", "center").alias("center"), F.coalesce("d", "max_distance").alias("max_distance"))


def with_fallback(seqs: DataFrame, centers: DataFrame) -> DataFrame:
    """Datasets without a centre get their plurality consensus; ``fallback_used`` says which."""
    rest = seqs.join(centers.select("dataset_id").distinct(), "dataset_id", "left_anti")
    fill = plurality(rest).select("dataset_id", "center", F.lit(True).alias("fallback_used"))
    return centers.select("dataset_id", "center", F.lit(False).alias("fallback_used")).unionByName(fill)


def hill_climb(seqs: DataFrame, centers: DataFrame, rounds: int | None = None, alternatives: DataFrame | None = None) -> DataFrame:
    """One-symbol steps while the largest distance falls: ``(dataset_id, center, max_distance)``.

    A step takes the best (distance, position, symbol). With m the largest distance of the rows
    that have symbol x at a position, putting b there for a gives the maximum over x of
    m - [x != a] + [x != b]; so a round reads the rows once and joins position tables only.
    ``alternatives(dataset_id, pos, b)`` may offer more symbols than those seen at a position.
    Without a number of ``rounds`` it goes on until no dataset gains, which ends, as every round
    lowers a distance. A dataset that gained nothing is not looked at again.
    """
    state = stage(center_distances(seqs, centers.select("dataset_id", "center")).groupBy("dataset_id", "center").agg(F.max("d").alias("max_distance")).withColumn("better", F.lit(True)), "climb")
    for _ in count() if rounds is None else range(rounds):
        d = center_distances(seqs, state.where("better AND max_distance > 0").select("dataset_id", "center"))
        # letters carry their row's distance, so that only maxima leave a task
        at = d.select("dataset_id", "center", "d", F.posexplode(symbols("sequence")).alias("pos", "ch"))
        worst = at.groupBy("dataset_id", "pos", "ch").agg(F.max("d").alias("m"), F.first(F.substring("center", F.col("pos") + 1, F.lit(1))).alias("a"))
        offers = worst.select("dataset_id", "pos", F.col("ch").alias("b")) if alternatives is None else alternatives
        new = worst.join(offers, ["dataset_id", "pos"]).where("a <> b").groupBy("dataset_id", "pos", "b").agg(F.max(F.col("m") - (F.col("ch") != F.col("a")).cast("int") + (F.col("ch") != F.col("b")).cast("int")).alias("d"))
        best = new.groupBy("dataset_id").agg(F.min(F.struct("d", "pos", "b")).alias("s"))
        gain = state.drop("better").join(best, "dataset_id", "left").withColumn("better", F.coalesce(F.col("s.d") < F.col("max_distance"), F.lit(False)))
        moved = F.overlay("center", F.col("s.b"), F.col("s.pos") + 1, F.lit(1))
        before, state = state, stage(gain.select("dataset_id", F.when(F.col("better"), moved).otherwise(F.col("center")).alias("center"), F.when(F.col("better"), F.col("s.d")).otherwise(F.col("max_distance")).alias("max_distance"), "better"), "climb")
        unstage(before)
        if is_empty(state.where("better")):
            break
    return state.drop("better")


def cluster_recombine(seqs: DataFrame, radius: int, n_blocks: int = 2, mode: str = "per_block", rounds: int | None = None, limit: int | None = None) -> DataFrame:
    """Clusters, their centres, recombined, the best of all refined; without clusters the consensus."""
    centers = cluster_consensus(seqs, clusters(seqs, radius))
    best = best_recombined(seqs, centers, n_blocks, mode, limit)
    chosen = stage(with_fallback(seqs, best), "chosen")
    refined = hill_climb(seqs, chosen, rounds)
    return refined.join(chosen.select("dataset_id", "fallback_used"), "dataset_id")


# ------------------------------------------------------------------ block heuristic


def exhaustive_blocks(seqs: DataFrame, spans: DataFrame, alphabet: str, k: int = K_CANDIDATES, limit: int = EXHAUSTIVE_LIMIT) -> DataFrame:
    """The k best texts of each block: all over the alphabet if there are at most ``limit``, else
    the block's own segments and consensus. ``(dataset_id, block_no, cand_no, candidate, d)``."""
    size = len(alphabet)
    segs = segments(seqs, spans).select("dataset_id", "block_no", "l", "r", "seg").distinct()
    blocks = spans.withColumn("space", F.pow(F.lit(float(size)), F.col("r") - F.col("l")))
    digit = lambda i: (F.floor(F.col("no") / F.pow(F.lit(float(size)), F.col("r") - F.col("l") - 1 - i)) % size).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("r") - F.col("l") - 1), lambda i: F.substring(F.lit(alphabet), digit(i) + 1, F.lit(1))), "")
    every = blocks.where(F.col("space") <= limit).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("space").cast("int") - 1))).select("dataset_id", "block_no", "no", text.alias("candidate"))
    wide = blocks.where(F.col("space") > limit).select("dataset_id", "block_no")
    own = segs.join(wide, ["dataset_id", "block_no"], "left_semi").select("dataset_id", "block_no", F.lit(0).alias("no"), F.col("seg").alias("candidate"))
    cons = block_difficulty(seqs, spans).join(wide, ["dataset_id", "block_no"], "left_semi").select("dataset_id", "block_no", F.lit(1).alias("no"), F.col("center").alias("candidate"))
    return _top_blocks(every.unionByName(own).unionByName(cons).dropDuplicates(["dataset_id", "block_no", "candidate"]), segs, k)


def _top_blocks(candidates: DataFrame, segs: DataFrame, k: int) -> DataFrame:
    scored = candidates.join(segs.select("dataset_id", "block_no", "seg"), ["dataset_id", "block_no"]).groupBy("dataset_id", "block_no", "candidate").agg(F.max(hamming(F.col("candidate"), F.col("seg"))).alias("d"))
    rank = F.row_number().over(Window.partitionBy("dataset_id", "block_no").orderBy("d", "candidate"))
    return scored.withColumn("cand_no", rank - 1).where(F.col("cand_no") < k)


def beam_blocks(seqs: DataFrame, spans: DataFrame, alphabet: str, width: int | Column = BEAM_WIDTH, k: int = K_CANDIDATES) -> DataFrame:
    """Candidates by beam search over positions, all blocks of all datasets in each round.

    The ``width`` prefixes with the smallest worst mismatch with the block's segments go on; ties
    by text. A round reads the distinct segments as rows and keeps, for a prefix and the symbol x
    that follows in a segment, the largest mismatch m so far; a prefix grown by c then has the
    maximum over x of m + [x != c], so only width x symbols rows a block leave a task.
    """
    segs = stage(segments(seqs, spans).select("dataset_id", "block_no", "l", "r", "seg").distinct(), "beam_segments")
    keys = ["dataset_id", "block_no"]
    shape = segs.groupBy(*keys).agg(F.first(F.col("r") - F.col("l")).alias("m"))
    longest = shape.agg(F.max("m")).first()[0] or 0
    beam = stage(shape.select(*keys, "m", F.lit("").alias("prefix")), "beam")
    letters = F.explode(F.array(*[F.lit(x) for x in alphabet]))
    for depth in range(longest):
        so_far, grows = F.substring("seg", F.lit(1), F.lit(depth)), F.col("m") > depth
        met = segs.select(*keys, "seg").join(beam.where(grows), keys)
        n = hamming_of(F.col("prefix"), so_far, packed(F.col("prefix")), packed(so_far))
        worst = met.groupBy(*keys, "m", "prefix", F.substring("seg", depth + 1, 1).alias("x")).agg(F.max(n).alias("n"))
        step = F.max(F.col("n") + (F.col("x") != F.col("c")).cast("int")).alias("misses")
        grown = worst.withColumn("c", letters).groupBy(*keys, "m", F.concat("prefix", "c").alias("prefix")).agg(step)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("misses", "prefix"))
        kept = grown.withColumn("rank", rank).where(F.col("rank") <= width).select(*beam.columns)
        before, beam = beam, stage(kept.unionByName(beam.where(~grows)), "beam")
        unstage(before)
    return _top_blocks(beam.select(*keys, F.col("prefix").alias("candidate")), segs, k)


def fuse_blocks(choices: DataFrame, spans: DataFrame, alphabet: str = "A") -> DataFrame:
    """One candidate for each block joined to a centre, each put to its block's length."""
    fixed = choices.join(spans, ["dataset_id", "block_no"]).withColumn("part", repair_length(F.col("candidate"), F.col("r") - F.col("l"), F.lit(alphabet)))
    return joined(fixed, ["dataset_id"], "block_no", "part", "center")


def block_heuristic(seqs: DataFrame, alphabet: str, width: int = BEAM_WIDTH, k: int = K_CANDIDATES, rounds: int | None = None) -> DataFrame:
    """Blocks of about sqrt(length), searched by their difficulty, fused and refined."""
    lengths = seqs.groupBy("dataset_id").agg(F.min(F.char_length("sequence")).alias("length"))
    spans = stage(block_spans(lengths, "sqrt"), "spans")
    tiers = stage(block_difficulty(seqs, spans).withColumn("technique", technique(F.col("difficulty"))).select("dataset_id", "block_no", "technique"), "tiers")
    of = lambda name: spans.join(tiers.where(F.col("technique") == name), ["dataset_id", "block_no"], "left_semi")
    found = exhaustive_blocks(seqs, of("exhaustive"), alphabet, k).unionByName(beam_blocks(seqs, of("reduced_beam"), alphabet, max(1, width // 2), k)).unionByName(beam_blocks(seqs, of("beam"), alphabet, width, k))
    return hill_climb(seqs, fuse_blocks(found.where("cand_no = 0"), spans, alphabet), rounds)
