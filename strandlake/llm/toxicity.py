"""Toxicity scores: boosted trees over dense features of a whole text, calibrated by isotonic steps.

The lexicon is a list of common insults and what the labelled rows add to it: words and word
beginnings that are much more frequent in toxic texts. Features are densities of lexicon words
as written and after undoing digit-for-letter spelling, their distance to second-person words,
and rates of capitals, punctuation and obfuscated words. The trees are Spark's; scoring a text
needs the text only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import columns_apart, stage

#: Labelled rows that are learned from at most, of each label.
ROWS_A_LABEL = 6_000
LEXICON_SIZE = 3_000
PREFIXES = (4, 5, 6)
HEAD = min(PREFIXES)
THRESHOLD = 0.3

#: Common insults, and words that address somebody: chosen here, and added to by what labelled rows show.
INSULTS = frozenset(
    "asshole bastard bitch clown coward creep cretin crap cunt damn dirtbag disgusting dumb dumbass fag faggot filth fool freak fuck fucking garbage"
    " hate hideous idiot idiotic imbecile jerk kill loser lunatic maggot moron moronic nasty nazi parasite pathetic pig prick psycho retard retarded"
    " rotten scum shit shut slut stupid subhuman sucker trash twat ugly useless vermin vile whore worm worthless".split()
)
YOU = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch euer tú tu ti te usted ustedes vosotros toi vous votre vos tes".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")
_EDGE = "\"'`.,;:!?()[]{}<>«»„“”‚‘’…-–—/\\|&%#*~_+=^"
_INSIDE = re.compile(r"(?<=[^\W\d_])[0-9@$!|*#_.+-]+(?=[^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")

_ASCII = re.compile(r"[\x00-\x7f]+")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

#: What `look` says of most words, and how many words a task remembers.
PLAIN = (0.0, False, False)
MOST_SEEN = 200_000

FEATURES = [
    "log_words", "hits_per_100", "weight_per_100", "top_weight", "distinct_hits", "insults_per_100", "hidden_hits_per_100", "any_hit",
    "hits_near_you_per_100", "you_per_100", "upper_share", "shouted_share", "exclamations_per_100", "questions_per_100", "punctuation_share",
    "obfuscated_per_100", "spelled_out_per_100", "distinct_share", "symbols_per_100", "word_length",
]


def bare(word: str) -> str:
    return word.strip(_EDGE)


def terms(word: str) -> list[str]:
    """What of a word may be in the lexicon: itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def weight(word: str, lexicon: dict[str, float]) -> float:
    found = lexicon.get(word, 0.0)
    for n in PREFIXES:
        if len(word) > n and (w := lexicon.get(word[:n] + "*", 0.0)) > found:
            found = w
    return found


def look(word: str, lexicon: dict[str, float]) -> tuple[float, bool, bool]:
    """A word's weight, whether something stands between its letters, and whether that hides a lexicon word."""
    found, odd = weight(word, lexicon), bool(_INSIDE.search(word))
    hidden = odd and not found and bool(weight(word.translate(_LEET), lexicon) or weight(_INSIDE.sub("", word), lexicon))
    return (found, odd, hidden) if found or odd else PLAIN


def heads(lexicon: dict[str, float]) -> frozenset[str]:
    """How the lexicon's words and word beginnings begin: a word of letters that begins otherwise has no weight."""
    return frozenset(term[:HEAD] for term in lexicon)


def capitals(text: str) -> int:
    """Upper-case letters of a text."""
    plain = text.encode("ascii", "ignore")
    others = 0 if len(plain) == len(text) else sum(map(str.isupper, _ASCII.sub("", text)))
    return len(plain) - len(plain.translate(None, _CAPITALS)) + others


def features(text: str, lexicon: dict[str, float], seen: dict[str, tuple[float, bool, bool]] | None = None, begins: frozenset[str] | None = None) -> list[float]:
    """The numbers of ``FEATURES``; all 0 for a text without words.

    ``seen`` remembers what `look` says of words, for later texts; ``begins`` are the lexicon's `heads`.
    """
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    seen = {} if seen is None else seen
    begins = heads(lexicon) if begins is None else begins
    words = list(map(str.strip, text.lower().split(), repeat(_EDGE)))
    counts = Counter(words)
    weights: dict[str, float] = {}
    hits, hidden, odd = 0, 0, 0
    for w in [w for w in counts if w[:HEAD] in begins or not w.isalpha()]:
        if (known := seen.get(w)) is None:
            known = seen[w] = look(w, lexicon)
        if known is PLAIN:
            continue
        k = counts[w]
        if known[0]:
            weights[w] = known[0]
            hits += k
        odd += k * known[1]
        hidden += k * known[2]
    if len(seen) > MOST_SEEN:
        seen.clear()
    near = 0
    if weights and not YOU.isdisjoint(counts):
        you = [i for i, w in enumerate(words) if w in YOU]
        close = {j for i in you for j in range(i - 3, i + 4)}
        near = sum(1 for j in close if 0 <= j < n and words[j] in weights)
    spelled, run = 0, 0
    if 1 in set(map(len, counts)):
        for w in (*words, ""):
            run = run + 1 if len(w) == 1 and w.isalpha() else 0
            spelled += run >= 4
    chars = sum(map(len, raw))
    letters = sum(map(len, words)) or 1
    shouted = sum(1 for w in compress(raw, map(str.isupper, raw)) if len(w) > 2)
    per = 100.0 / n
    return [
        math.log1p(n), hits * per, sum(counts[w] * x for w, x in weights.items()) * per, max(weights.values(), default=0.0), float(min(len(weights), 20)),
        sum(counts[w] for w in INSULTS.intersection(weights)) * per, hidden * per, float(bool(weights) or hidden > 0), near * per, sum(counts[w] for w in YOU & counts.keys()) * per,
        capitals(text) / chars, shouted / n, text.count("!") * per, text.count("?") * per, (chars - letters) / chars,
        odd * per, spelled * per, len(counts) / n, sum(map(text.count, "#*$%&|<>@")) * per, letters / n,
    ]


def feature_rows(docs: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """``docs(id, text, *keep)`` -> ``(id, *keep, n_words long, features array<double>)``, row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_SIZE terms and the fixed list
    schema = docs.select("id", *keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = shared.value, {}
        begins = heads(lexicon)
        for b in batches:
            texts = b.column(1)
            rows = [features(t.as_py() or "", lexicon, seen, begins) for t in texts]
            n = pa.array([round(math.expm1(r[0])) for r in rows], pa.int64())
            others = [b.column(i) for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*others, n, pa.array(rows, pa.list_(pa.float64()))], ["id", *keep, "n_words", "features"])

    out = schema.add("n_words", "long").add("features", ArrayType(DoubleType()))
    return docs.select("id", "text", *keep).mapInArrow(run, out)


def part_of(id_col: str = "id"):
    """crc32 of the id as text, modulo 4; a null id counts as part 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], rows_a_label: int = ROWS_A_LABEL, parts: tuple[int, ...] = (0, 1, 3)) -> DataFrame:
    """``docs(id, text)`` with their labels, without the held-out part and repeated texts: a bounded sample.

    Of labels given more than once the largest counts. Whole texts are taken, chosen by a hash
    of the id, ``rows_a_label`` for each combination of labels.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("id"), *[F.col(c).cast("int").alias(c) for c in columns]).where("id is not null")
    for c in columns:
        wanted = wanted.where(F.col(c).isNotNull())
    wanted = wanted.where(part_of().isin(*parts)).groupBy("id").agg(*[F.max(c).alias(c) for c in columns])
    sizes = {tuple(r[c] for c in columns): r["count"] for r in wanted.groupBy(*columns).count().collect()}  # a row for each combination of labels
    chance = F.lit(0.0)
    for key, n in sizes.items():
        chance = F.when(F.expr(" and ".join(f"{c} = {v}" for c, v in zip(columns, key))), min(1.0, rows_a_label / n)).otherwise(chance)
    picked = wanted.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < chance * 1_000_000)
    most = 2 * rows_a_label * max(1, len(sizes))  # far above what the chances pick; it makes the bound of the broadcast a fact
    found = docs.select("id", "text").join(F.broadcast(picked.limit(most)), "id")
    # of equal texts the one with the smallest id is learned from
    return stage(found.where("text is not null").groupBy("text").agg(F.min_by(F.struct(*[c for c in found.columns if c != "text"]), "id").alias("x")).select("x.id", "text", *[f"x.{c}" for c in columns]), "labelled")


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """``rows(text, toxic)`` -> terms and weights: log of how much more frequent a term is in toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[toxic].update({t for w in set(map(bare, text.lower().split())) if w for t in terms(w)})
            for toxic in (0, 1):
                kept = list(seen[toxic].items())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.int64()), pa.array([toxic] * len(kept), pa.int32())], ["term", "n", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    base = {w: 3.0 for w in INSULTS}
    if not sizes.get(0) or not sizes.get(1):
        return base
    counts = rows.select("text", "toxic").mapInArrow(run, "term string, n long, toxic int")
    both = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / sizes[1]) - F.log((F.col("c") + 0.5) / sizes[0])
    least = max(3, sizes[1] // 400)
    top = both.where(F.col("t") >= least).withColumn("w", ratio).where("w > 2.3").orderBy(F.desc(F.col("w") * F.log("t")), "term").limit(size)
    return base | {r["term"]: min(6.0, r["w"]) for r in top.collect()}


class Model:
    """A lexicon, Spark's boosted trees, and isotonic steps from their margin to a chance."""

    def __init__(self, lexicon: dict[str, float], trees=None, steps=None, prior: float = 0.0):
        self.lexicon, self.trees, self.steps, self.prior = lexicon, trees, steps, prior

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows(..., features)`` with a score in 0..1 in place of the features."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.prior)).drop("features")
        raw = self.trees.transform(rows.withColumn("vector", array_to_vector("features")))
        raw = raw.withColumn("raw", vector_to_array("probability")[1])
        out = self.steps.transform(raw.withColumn("at", F.col("raw")))
        # steps have equal values over stretches; inside these the trees' order decides
        return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw")))).drop("features", "vector", "rawPrediction", "probability", "prediction", "raw", "at", "calibrated")


def fit(docs: DataFrame, labels: DataFrame, rows_a_label: int = ROWS_A_LABEL) -> Model:
    """Learn from ``docs(id, text)`` whose crc32 part is not 2.

    Parts 0 and 1 give lexicon and trees, part 3 the calibration. Without both labels in each,
    every text has the share of toxic rows as its score (0 without any rows).
    """
    labels = labels.where(F.col("toxic").isin(0, 1))
    rows = labelled(docs, labels, ["toxic"], rows_a_label).withColumn("part", part_of())
    have = {(r["calibrate"], r["toxic"]): r["count"] for r in rows.groupBy((F.col("part") == 3).alias("calibrate"), "toxic").count().collect()}
    if any(not have.get((c, t)) for c in (True, False) for t in (0, 1)):
        total = sum(have.values())
        return Model(learn_lexicon(rows), prior=sum(n for (_, t), n in have.items() if t) / total if total else 0.0)
    lexicon = learn_lexicon(rows.where("part <> 3"))
    table = stage(feature_rows(rows.select("id", "text", "toxic", "part"), lexicon, "toxic", "part").withColumn("label", F.col("toxic").cast("double")), "features")
    table = table.withColumn("vector", array_to_vector("features")).coalesce(4).cache()
    boost = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=4, maxBins=64, stepSize=0.2, subsamplingRate=0.8, seed=11)
    trees = boost.fit(table.where("part <> 3"))
    seen = trees.transform(table.where("part = 3")).withColumn("at", vector_to_array("probability")[1])
    # the sample holds labels at other shares than the corpus; weights put that right
    true = labels.where(F.col("toxic").isNotNull() & part_of("doc_id").isin(0, 1, 3)).groupBy("toxic").count().collect()
    share = {r["toxic"]: r["count"] for r in true}
    weights = F.when(F.col("label") == 1, share.get(1, 1) / have[(True, 1)]).otherwise(share.get(0, 1) / have[(True, 0)])
    steps = IsotonicRegression(featuresCol="at", labelCol="label", weightCol="w", predictionCol="calibrated").fit(seen.withColumn("w", weights))
    table.unpersist()
    return Model(lexicon, trees, steps)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_label: int = ROWS_A_LABEL) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null and wordless texts are scored as empty ones."""
    rows = columns_apart(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), F.col("text").cast("string"))
    model = fit(rows, labels, rows_a_label)
    scored = model.score(feature_rows(rows, model.lexicon))
    return scored.select(F.col("id").alias("doc_id"), (part_of() == 2).alias("held_out"), F.col("score"), (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
