"""Best-fit packing of tokenised documents after Martello-Toth reduction.

How a set of pieces packs depends on their lengths alone, and there are at most ``capacity``
lengths. So Spark counts the pieces by length, the driver packs that histogram (its size is
bounded by the capacity, whatever the corpus), and Spark deals the pieces out: a piece's rank
within its length says which sequence it goes to.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CAPACITY = 2048
#: Words whose ids a worker remembers; beyond it starts anew, which changes speed only.
WORD_CACHE = 200_000
END = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The pre-token pattern of ``word_bpe_49k.json``, for texts of these characters only.
_LATIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class WordIds:
    """The ids of a text as little-endian unsigned 32-bit bytes, by ``word_bpe_49k.json``.

    No pre-token of that tokenizer has white space in it, and none of its normalisation steps
    looks across ASCII white space, so a text's ids are those of its words in a row. The ids of
    words, and of the pre-tokens in them, are looked up once. Words outside ASCII and Latin-1,
    or that may hold a special token, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.to_bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            shown = part if part.isascii() else self.to_bytes.pre_tokenize_str(part)[0][0]
            ids = self.parts[part] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not _LATIN.fullmatch(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self._part, _PRE_TOKEN.findall(text.lower())))

    def encode(self, text: bytes) -> bytes:
        words, known = text.split(), self.words
        for w in set(words).difference(known):
            known[w] = self._word(w)
        out = b"".join(map(known.__getitem__, words)) + END
        for cache in (self.words, self.parts):
            if len(cache) > WORD_CACHE:
                cache.clear()
        return out


_loaded: dict[str, WordIds] = {}


def tokenizer_at(path: str) -> WordIds:
    """One tokenizer a Python worker, which Spark uses again for later tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and a final 0, cut into pieces of ``capacity`` if there are more.

    A null text counts as empty and has the one id 0. Columns as in ``PIECES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, step = tokenizer_at(tokenizer), 4 * capacity
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                ids = coder.encode(text.as_py() or b"")
                out += [(doc, at // step, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for at in range(0, len(ids), step)]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


# ------------------------------------------------------------------ the plan, on counts by length


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix the small sets that dominate all others with their largest piece; ``counts`` keeps the rest.

    A set with w dominates the others with w if whatever else may stand beside w can be swapped
    for its parts without overfilling anything, so some optimal packing holds it. For each
    length w, largest first, with v the largest piece that fits beside it:

    * nothing fits: {w};
    * {w, v} is full, or no two pieces fit beside w, or no two that fit outweigh v: {w, v};
    * no three pieces fit beside w, u is the largest that fits beside w and v, and no two pieces
      above u fit: every pair has one piece up to v and one up to u: {w, v, u}.

    Each case stays true while the pieces it names last, so it is applied as often as they do.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(x for x, n in counts.items() if n)

    def largest(room: int, *but: int) -> int | None:
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and counts[lengths[at]] <= but.count(lengths[at]):
            at -= 1
        return lengths[at] if at >= 0 else None

    def smallest(k: int, above: int, but: int) -> list[int]:
        out: list[int] = []
        for x in lengths[bisect_left(lengths, above + 1) :]:
            out += [x] * min(k - len(out), counts[x] - (x == but))
            if len(out) >= k:
                break
        return out

    def outweighs(v: int, room: int, but: int) -> bool:
        """Whether some two pieces that fit together sum to more than v."""
        for x in lengths[bisect_left(lengths, v // 2) :]:
            if x > v:
                break
            if counts[x] > (x == but) and (y := largest(room - x, x, but)) is not None and x + y > v:
                return True
        return False

    for w in sorted(lengths, reverse=True):
        while counts[w]:
            room = capacity - w
            group = None
            v, few = largest(room, w), smallest(3, 0, w)
            if v is None:
                group = (w,)
            elif v == room or len(few) < 2 or few[0] + few[1] > room:
                group = (w, v)
            elif len(few) < 3 or sum(few) > room:
                u = largest(room - v, w, v)
                if u is None or not outweighs(v, room, w):
                    group = (w, v)
                elif len(pair := smallest(2, u, w)) < 2 or sum(pair) > room:
                    group = (w, v, u)
            if group is None:
                break
            each = Counter(group)
            times = min(counts[x] // k for x, k in each.items())
            fixed.append((group, times))
            for x, k in each.items():
                counts[x] -= k * times
                if not counts[x]:
                    lengths.remove(x)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal pieces that go to equal sequences go there at once."""
    rooms: list[int] = []  # the distinct rooms left, ascending
    open_: dict[int, Counter] = {}  # room -> {group: how many}
    for w in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[w]
        while left:
            at = bisect_left(rooms, w)
            if at == len(rooms):  # a new sequence each, as full of w as it gets
                k = min(left, capacity // w)
                times = left // k
                _put(rooms, open_, capacity - k * w, (w,) * k, times)
                left -= k * times
                continue
            room = rooms[at]
            group, there = next(iter(open_[room].items()))
            k = min(left, room // w)
            times = min(there, left // k)
            open_[room][group] -= times
            if not open_[room][group]:
                del open_[room][group]
                if not open_[room]:
                    rooms.pop(at)
                    del open_[room]
            _put(rooms, open_, room - k * w, group + (w,) * k, times)
            left -= k * times
    return [(g, n) for groups in open_.values() for g, n in groups.items()]


def _put(rooms: list[int], open_: dict[int, Counter], room: int, group: tuple[int, ...], times: int) -> None:
    if room not in open_:
        open_[room] = Counter()
        insort(rooms, room)
    open_[room][group] += times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), using up ``counts`` exactly."""
    rest = dict(counts)
    fixed = reduce_by_dominance(rest, capacity)
    return fixed + best_fit(rest, capacity)


# ------------------------------------------------------------------ pieces to sequences


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: ``PIECES`` and sequence_id, offset.

    Every piece of every row is placed once; repeated rows and null ids are packed like others
    (equal rows are interchangeable). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows, first, used = [], 0, Counter()
    for group, times in plan(counts, capacity):
        offset = 0
        for length, k in sorted(Counter(group).items(), reverse=True):
            rows.append((length, used[length], used[length] + k * times, k, offset, first))
            used[length] += k * times
            offset += k * length
        first += times
    slots = spark.createDataFrame(rows, "length long, lo long, hi long, k long, at long, first long")
    return _deal(cut, slots)


def _deal(cut: DataFrame, slots: DataFrame) -> DataFrame:
    """Give each piece its rank within its length, then the slot that holds this rank.

    Ranks are taken within (length, bucket) and shifted by the counts of the buckets before, so
    that a length which a third of all pieces share is no single task's work. Slots of a length
    are cut at bucket borders and ranks are matched inside (length, bucket), by their order.
    """
    n = cut.count()
    buckets = max(1, n // 20_000)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = stage(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "sizes")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1)
    # tables of (length, bucket) grow with the input: they are merged with the pieces, which are dealt so already
    placed = ranked.join(starts.select("length", "bucket", "base").hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("r") + F.col("base"))
    # the slots that meet a bucket's stretch of ranks, in order, as one array a (length, bucket)
    met = starts.join(slots, "length").where("lo < base + n and hi > base")
    held = met.groupBy("length", "bucket").agg(F.sort_array(F.collect_list(F.struct("lo", "k", "at", "first"))).alias("slots"))
    slot = F.element_at(F.filter("slots", lambda s: s["lo"] <= F.col("rank")), -1)
    out = placed.join(held.hint("merge"), ["length", "bucket"]).withColumn("s", slot).withColumn("i", F.col("rank") - F.col("s.lo"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("s.first") + F.floor(F.col("i") / F.col("s.k"))).cast("long").alias("sequence_id"), (F.col("s.at") + F.col("i") % F.col("s.k") * F.col("length")).cast("long").alias("offset"))
