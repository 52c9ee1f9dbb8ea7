"""Hamming distances of many texts from many others, in tiles of bounded size.

Rows are dealt to blocks of about `TILE` rows by a hash of their id; a tile is two blocks of a
dataset that meet in one task, so neither a dataset nor a long list is ever held whole. In a tile
texts of equal length are bit planes, and a distance is the bits set in their exclusive ors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import PACKED, packed_difference

#: Rows of a block, and distances that are held at a time.
TILE = 4096
HELD = 1 << 16
#: Rows of a block, and longs of a packed text, where all pairs are returned.
JOINED = 1024
WORDS = 16
#: Characters that are put in planes at a time.
CHARS = 1 << 22
#: Beginnings and ends of a tile of joined texts, rows they are held against at a time, and pairs that are kept one by one.
LEFTS, RIGHTS = 2048, 8192
ROWS = 1024
FEW = 1 << 16

Tile = Callable[[tuple, tuple, bool], Iterator[tuple]]


# ------------------------------------------------------------------ in a task


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def _planes(texts: list[str], letters: np.ndarray, length: int) -> np.ndarray:
    """Texts of one length as (plane, word, text): a plane has one bit of each letter's number."""
    bits = max(1, (len(letters) - 1).bit_length())
    size = next((n for n in (8, 16, 32) if length <= n), 64)
    words = max(1, -(-length // size))
    out = np.zeros((bits, len(texts), words * size // 8), dtype=np.uint8)
    step = max(1, CHARS // max(1, length))
    for at in range(0, len(texts) if length else 0, step):
        codes = np.searchsorted(letters, _points(texts[at : at + step])).reshape(-1, length)
        for b in range(bits):
            packed = np.packbits((codes >> b & 1).astype(np.uint8), axis=1)
            out[b, at : at + step, : packed.shape[1]] = packed
    return np.ascontiguousarray(out.view(f"u{size // 8}").transpose(0, 2, 1))


def _letters(texts: list[str], length: int) -> np.ndarray:
    step = max(1, CHARS // max(1, length))
    seen = [np.unique(_points(texts[at : at + step])) for at in range(0, len(texts), step)]
    return np.unique(np.concatenate(seen))


def _by_length(texts: list) -> dict[int, np.ndarray]:
    n = np.array([-1 if t is None else len(t) for t in texts], dtype=np.int64)
    return {int(k): np.flatnonzero(n == k) for k in np.unique(n)}


def distances(left: list, right: list, unequal: bool = False, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Places in ``left``, places in ``right`` and their distances, piece by piece.

    Texts of unequal lengths and nulls have no distance; their pieces, with None, are opt-in. A
    piece's distances are overwritten by the next. ``own`` if both sides are one list: then rows of
    a piece meet themselves and those after them, so all pairs a < b are given, but only some a > b.
    """
    here, there = _by_length(left), _by_length(right)
    for n, a in here.items():
        for m, b in there.items():
            step = max(1, HELD // len(b))
            if n != m or n < 0:
                yield from ((a[at : at + step], b, None) for at in range(0, len(a) if unequal else 0, step))
                continue
            texts = [left[k] for k in a], [right[k] for k in b]
            letters = _letters(texts[0] + texts[1], n)
            p = _planes(texts[0], letters, n)
            q = p if own else _planes(texts[1], letters, n)
            # held in the same memory for all pieces, of which each is used before the next
            size = min(step, len(a)) * len(b)
            memory = np.empty(size, p.dtype), np.empty(size, p.dtype), np.empty(size, np.uint8)
            for at in range(0, len(a), step):
                mine, first = p[:, :, at : at + step, None], at if own else 0
                shape = mine.shape[2], len(b) - first
                differ, more, ones = (m[: shape[0] * shape[1]].reshape(shape) for m in memory)
                total = 0
                for w in range(p.shape[1]):
                    np.bitwise_xor(mine[0, w], q[0, w, first:], out=differ)
                    for plane in range(1, len(p)):
                        differ |= np.bitwise_xor(mine[plane, w], q[plane, w, first:], out=more)
                    np.bitwise_count(differ, out=ones)
                    total = ones if p.shape[1] == 1 else total + ones.astype(np.int32)
                yield a[at : at + step], b[first:], total


def _near(d: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.nonzero(d <= radius)``; in one dimension few near places are found much faster."""
    return np.divmod(np.flatnonzero(d <= radius), d.shape[1])


# ------------------------------------------------------------------ in Spark


def _blocks(rows: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """The number of blocks of each dataset."""
    return rows.groupBy("dataset_id").agg(F.ceil(F.count(F.lit(1)) / (size or TILE)).cast("int").alias(name))


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def _upto(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _compared(tiles: DataFrame, fn: Tile, schema: str, same: bool) -> DataFrame:
    """``fn`` on the rows of both sides of each tile; its columns follow the dataset's id.

    A side is the lists of its rows' ids, texts and, where ``tiles`` has it, ``more``. ``same`` if
    both sides are of one table, whose blocks meet themselves where x = y.
    """
    types = pa.schema([pa.field("dataset_id", pa.string())] + [pa.field(c.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in schema.split(", ")])

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        side = rows["side"].to_numpy()
        given = [rows[c].to_pylist() for c in ("id", "text", "more") if c in rows.column_names]
        of = lambda s: tuple([c[k] for k in np.flatnonzero(side == s)] for c in given)
        own = same and key[1].as_py() == key[2].as_py()
        first = of(0)
        for columns in fn(first, first if own else of(1), own):
            made = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, list(types)[1:])]
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(made[0])), *made], schema=types)

    # so many partitions by number: tiles are little data and much work, so they are not to be put together
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["dataset_id", "x", "y"]
    return tiles.repartition(n, *by).groupBy(*by).applyInArrow(tile, f"dataset_id string, {schema}")


def _all_tiles(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Each pair of a dataset's blocks once, and each block with itself."""
    cut = rows.join(_blocks(rows, "blocks", size), "dataset_id").withColumn("block", _block("blocks")).withColumn("other", _upto("blocks"))
    side = (F.col("block") > F.col("other")).cast("int")
    return cut.select("dataset_id", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), *[c for c in rows.columns if c != "dataset_id"])


def pairs(rows: DataFrame, radius: int | None = None) -> DataFrame:
    """``rows(dataset_id, id, text)`` -> ``(dataset_id, i, j, d)``: pairs i < j, all or those within a radius.

    Of all pairs those without a distance have a null; ids are integers.
    """

    kind = rows.schema["id"].dataType.simpleString()

    def found(left, right, own):
        one, two = (np.asarray(side[0], dtype="i8" if kind == "bigint" else "i4") for side in (left, right))
        for a, b, d in distances(left[1], right[1], radius is None, own):
            if radius is None:  # most or all of a piece stays, so it is taken as it lies
                i, j = one[a][:, None], two[b]
                keep = i != j
                if own:
                    keep &= a[:, None] < b
                taken = np.ravel if keep.all() else lambda x, keep=keep: x[keep]
                far = pa.nulls(int(keep.sum()), pa.int32()) if d is None else taken(d).astype(np.int32)
                yield taken(np.minimum(i, j)), taken(np.maximum(i, j)), far
                continue
            at, to = _near(d, radius)
            if own:
                once = a[at] < b[to]
                at, to = at[once], to[once]
            i, j, far = one[a[at]], two[b[to]], d[at, to].astype(np.int32)
            if (i == j).any():
                apart = i != j
                i, j, far = i[apart], j[apart], far[apart]
            yield np.minimum(i, j), np.maximum(i, j), far

    return _compared(_all_tiles(rows), found, f"i {kind}, j {kind}, d int", True)


def all_pairs(rows: DataFrame) -> DataFrame:
    """As `pairs` without a radius. Datasets of short ASCII texts are joined by Spark on tiles, of
    which rows come out faster than from Python workers; `pairs` has the others."""
    n = F.char_length("text")
    fits = F.coalesce((F.octet_length("text") == n) & (n <= PACKED * WORDS), F.lit(False))
    kinds = rows.groupBy("dataset_id").agg(F.min(fits).alias("plain"), F.max(n).alias("longest"))
    most = kinds.where("plain").agg(F.max("longest")).first()[0]
    rest = pairs(rows.join(kinds.where(~F.col("plain")), "dataset_id", "left_semi"))
    if most is None:
        return rest
    count = max(1, -(-most // PACKED))
    words = [F.coalesce(F.conv(F.hex(F.substring("text", PACKED * k + 1, PACKED)), 16, 10).cast("long"), F.lit(0)).alias(f"p{k}") for k in range(count)]
    plain = rows.join(kinds.where("plain"), "dataset_id", "left_semi").select("dataset_id", "id", n.alias("n"), *words)
    by, of = ["dataset_id", "x", "y"], [c for c in plain.columns if c != "dataset_id"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _all_tiles(plain, JOINED).repartition(parts, *by)
    side = lambda df, s: df.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in of])
    both = side(met.where("side = 0"), "a").join(side(met.where("side = 1 OR x = y"), "b").hint("merge"), by).where("x <> y OR id_a < id_b")
    d = reduce(lambda x, y: x + y, [packed_difference(F.col(f"p{k}_a"), F.col(f"p{k}_b")) for k in range(count)])
    made = both.select("dataset_id", F.least("id_a", "id_b").alias("i"), F.greatest("id_a", "id_b").alias("j"), F.when(F.col("n_a") == F.col("n_b"), d).alias("d"))
    return made.unionByName(rest)


def weights_near(rows: DataFrame, radius: int) -> DataFrame:
    """``rows(dataset_id, id, text, more)`` -> ``(dataset_id, id, others)``: for each row that has
    others within the radius the sum of their ``more``. Pairs are counted where they meet, so a
    large group of near rows gives no more rows than its own."""
    kind = rows.schema["id"].dataType.simpleString()

    def found(left, right, own):
        weight = tuple(np.asarray(side[2], dtype=np.int64) for side in (left, right))
        near = tuple(np.zeros(len(w), dtype=np.int64) for w in weight)
        for a, b, d in distances(left[1], right[1], own=own):
            at, to = _near(d, radius)
            u, v = a[at], b[to]
            if own:
                once = u < v
                u, v = u[once], v[once]
            np.add.at(near[0], u, weight[1][v])
            np.add.at(near[1], v, weight[0][u])
        for side, others in [(left, near[0] + near[1])] if own else [(left, near[0]), (right, near[1])]:
            some = np.flatnonzero(others)
            yield [side[0][k] for k in some], others[some]

    met = _compared(_all_tiles(rows), found, f"id {kind}, others bigint", True)
    return met.groupBy("dataset_id", "id").agg(F.sum("others").alias("others"))


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u[k] and v[k]; ``root`` has each place's root before and after."""
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while ((up := root[root]) != root).any():
            root[:] = up


def links(rows: DataFrame, radius: int) -> DataFrame:
    """``rows(dataset_id, id, text, more)`` -> ``(dataset_id, i, j)``: links enough to join all that
    pairs within the radius join. ``more`` is 1 for a core row and else 0.

    Core rows of a tile that near pairs of core rows join are linked to one of them, so there are
    no more links than rows of a tile. A near pair of another row i and a core row j is given as
    it is; those of two other rows are not.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def found(left, right, own):
        ids = np.asarray(left[0] if own else [*left[0], *right[0]], dtype="i8" if kind == "bigint" else "i4")
        core = np.asarray(left[2] if own else [*left[2], *right[2]], dtype=bool)
        root, shift = np.arange(len(ids)), 0 if own else len(left[0])
        for a, b, d in distances(left[1], right[1], own=own):
            at, to = _near(d, radius)
            u, v = a[at], b[to] + shift
            if own:
                once = u < v
                u, v = u[once], v[once]
            both = core[u] & core[v]
            _join(root, u[both], v[both])
            if not both.all():
                edge = core[u] != core[v]
                u, v = u[edge], v[edge]
                yield ids[np.where(core[u], v, u)], ids[np.where(core[u], u, v)]
        joined = np.flatnonzero(root != np.arange(len(root)))
        yield ids[joined], ids[root[joined]]

    return _compared(_all_tiles(rows), found, f"i {kind}, j {kind}", True)


def extremes(rows: DataFrame) -> DataFrame:
    """``rows(dataset_id, id, text)`` -> least and largest distance of a pair, ``(dataset_id, lo, hi)``."""

    def found(left, right, own):
        lo, hi = None, None
        for a, b, d in distances(left[1], right[1], own=own):
            if own and len(b) == 1:
                continue
            most = int(d.max())
            least = int(np.where(a[:, None] == b, most, d).min() if own else d.min())
            lo, hi = least if lo is None else min(lo, least), most if hi is None else max(hi, most)
        yield [lo], [hi]

    return _compared(_all_tiles(rows), found, "lo int, hi int", True).groupBy("dataset_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def farthest(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct ``texts(dataset_id, text)`` and ``rows(dataset_id, text)`` -> each text's largest
    distance from its dataset's rows and a row that far, ``(dataset_id, text, d, far)``; nulls
    where no row has its length. Texts of datasets without rows are left out."""

    def found(left, right, own):
        if not right[1]:
            return
        d, far = np.full(len(left[1]), -1, dtype=np.int32), np.zeros(len(left[1]), dtype=np.int64)
        for a, b, n in distances(left[1], right[1]):
            at = n.argmax(axis=1)
            d[a], far[a] = n[np.arange(len(a)), at], b[at]
        yield left[1], pa.array(d, mask=d < 0), [right[1][k] if n >= 0 else None for k, n in zip(far, d)]

    side = lambda df: df.select("dataset_id", F.col("text").alias("id"), "text")
    mine, theirs = side(texts.where("text IS NOT NULL")), side(rows)
    # each row meets all blocks of the other side
    blocks = _blocks(mine, "xs").join(_blocks(theirs, "ys"), "dataset_id")
    a = mine.join(blocks, "dataset_id").select("dataset_id", _block("xs").alias("x"), _upto("ys").alias("y"), F.lit(0).alias("side"), "id", "text")
    b = theirs.join(blocks, "dataset_id").select("dataset_id", _upto("xs").alias("x"), _block("ys").alias("y"), F.lit(1).alias("side"), "id", "text")
    met = _compared(a.unionByName(b), found, "text string, d int, far string", False)
    return met.groupBy("dataset_id", "text").agg(F.max("d").alias("d"), F.max_by("far", "d").alias("far"))


class _Joined:
    """Which texts, of a beginning and an end, are at most ``most`` away from all rows shown so far.

    For each largest distance from ``most`` down it holds bits of the pairs that stay within it, as
    long as there are any; so a pair's largest distance is the least whose bits have it. A row bars
    all ends that are too far for a beginning's distance from it, which are one string of bits. Few
    pairs left are held one by one.
    """

    def __init__(self, lefts: list[str], rights: list[str], most: int):
        self.texts, self.most, self.pairs, self.far = (lefts, rights), most, None, None
        self.words = -(-len(rights) // 64)
        everything = self._bits(np.ones((1, len(rights)), dtype=bool))
        # a level that is not there yet stands for the pairs of the one above
        self.levels, self.begun = [np.repeat(everything, len(lefts), axis=0)], False

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.words * 8), dtype=np.uint8)
        packed = np.packbits(flags, axis=1)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    @property
    def over(self) -> bool:
        return not len(self.levels) if self.pairs is None else not len(self.far)

    def show(self, heads: list[str], tails: list[str]) -> None:
        """Rows, cut where beginnings end."""
        a, b = _matrix(heads, self.texts[0]), _matrix(tails, self.texts[1])
        if self.pairs is None:
            self._bar(a, b)
            if self.levels and np.bitwise_count(self.levels[0]).sum() <= FEW:
                self._single()
        else:
            self._raise(a, b)

    def _bar(self, a: np.ndarray, b: np.ndarray) -> None:
        level = 0
        while level < len(self.levels):
            kept = self._within(self.levels[level], a, b, self.most - level)
            if not kept.any():  # nor is there any below
                del self.levels[level:]
                break
            self.levels[level] = kept
            level += 1
            if not self.begun and level == len(self.levels) and level <= self.most:
                self.levels.append(kept)
        self.begun = True

    def _within(self, kept: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        kept, top = kept.copy(), int(b.max())
        values = [v for v in np.unique(a) if int(v) + top > most]
        if not values:
            return kept
        barred = np.concatenate([self._bits(b > most - int(v)) for v in values])
        # the place of a row's bits for a beginning at that distance
        place = np.full(int(a.max()) + 1, -1, dtype=np.int64)
        place[values] = np.arange(len(values)) * len(a)
        for i in np.flatnonzero(kept.any(axis=1)):
            at = place[a[:, i]]
            rows = np.flatnonzero(at >= 0)
            kept[i] &= ~np.bitwise_or.reduce(barred[at[rows] + rows], axis=0)
        return kept

    def _single(self) -> None:
        i, j = self.pairs = np.nonzero(np.unpackbits(self.levels[0].view(np.uint8), axis=1, count=len(self.texts[1])))
        self.far = np.full(len(i), self.most + 1, dtype=np.int64)
        for x in self.levels:
            self.far -= x.view(np.uint8)[i, j >> 3] >> (7 - (j & 7)) & 1
        self.levels = []

    def _raise(self, a: np.ndarray, b: np.ndarray) -> None:
        (i, j), step = self.pairs, max(1, CHARS // len(a))
        for at in range(0, len(i), step):
            cut = slice(at, at + step)
            self.far[cut] = np.maximum(self.far[cut], (a[:, i[cut]] + b[:, j[cut]]).max(axis=0))
        stay = self.far <= self.most
        self.pairs, self.far = (i[stay], j[stay]), self.far[stay]

    def best(self) -> tuple[int, int, int] | None:
        """The least largest distance, and the first beginning and end that have it."""
        if self.over:
            return None
        if self.pairs is None:
            i = int(np.flatnonzero(self.levels[-1].any(axis=1))[0])
            ends = np.unpackbits(self.levels[-1][i].view(np.uint8), count=len(self.texts[1]))
            return self.most + 1 - len(self.levels), i, int(np.flatnonzero(ends)[0])
        at = np.lexsort((self.pairs[1], self.pairs[0], self.far))[0]
        return int(self.far[at]), int(self.pairs[0][at]), int(self.pairs[1][at])


def _matrix(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of texts that are all of one length."""
    out = None
    for a, b, d in distances(left, right):
        if out is None:
            out = np.empty((len(left), len(right)), dtype=d.dtype)
        out[np.ix_(a, b)] = d
    return out


def best_joined(lefts: DataFrame, rights: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of a beginning and an end that are nearest to all rows, if near enough.

    ``lefts`` and ``rights(dataset_id, cut, no, text)``: beginnings, of ``cut`` characters, and what
    may follow them; ``rows(dataset_id, text, most)`` of the length of both. Gives
    ``(dataset_id, d, text)``, of the texts whose largest distance from the rows is least and not
    above ``most`` the one with the first ``no`` on the left, then on the right. All pairs are held
    against rows until one bars them, blocks of beginnings and ends in a task, rows in passing.
    """
    by = ["dataset_id", "cut", "x", "y"]
    schema = pa.schema([("dataset_id", pa.string()), ("d", pa.int32()), ("left_no", pa.int64()), ("right_no", pa.int64()), ("text", pa.string())])

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, held, waiting, seen = ([], []), None, ([], []), 0
        for batch in batches:
            if held is not None and held.over:
                continue
            side = batch["side"].to_numpy()
            if len(side) and (side[0] < seen or (np.diff(side) < 0).any()):
                raise ValueError("rows came before what they are compared with")
            for s in np.unique(side):
                part = batch.filter(pa.array(side == s))
                seen = int(s)
                if s < 2:
                    sides[s].extend(zip(part["no"].to_pylist(), part["text"].to_pylist()))
                    continue
                if held is None:
                    for x in sides:
                        x.sort()
                    held = _Joined([t for _, t in sides[0]], [t for _, t in sides[1]], part["no"][0].as_py())
                waiting[0].extend(part["text"].to_pylist())
                waiting[1].extend(part["tail"].to_pylist())
            while held is not None and len(waiting[0]) >= ROWS and not held.over:
                held.show(waiting[0][:ROWS], waiting[1][:ROWS])
                waiting = waiting[0][ROWS:], waiting[1][ROWS:]
        if held is not None and waiting[0] and not held.over:
            held.show(*waiting)
        if held is not None and (best := held.best()):
            d, i, j = best
            (a, head), (b, tail) = sides[0][i], sides[1][j]
            yield pa.RecordBatch.from_pylist([{"dataset_id": key[0].as_py(), "d": d, "left_no": a, "right_no": b, "text": head + tail}], schema=schema)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, size, name: df.groupBy("dataset_id", "cut").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    blocks = count(lefts, LEFTS, "xs").join(count(rights, RIGHTS, "ys"), ["dataset_id", "cut"])
    own = lambda size: F.pmod(F.xxhash64("no"), F.col(size)).cast("int")
    nothing = F.lit(None).cast("string").alias("tail")
    a = lefts.join(blocks, ["dataset_id", "cut"]).select("dataset_id", "cut", own("xs").alias("x"), _upto("ys").alias("y"), F.lit(0).alias("side"), "no", "text", nothing)
    b = rights.join(blocks, ["dataset_id", "cut"]).select("dataset_id", "cut", _upto("xs").alias("x"), own("ys").alias("y"), F.lit(1).alias("side"), "no", "text", nothing)
    met = rows.join(blocks, "dataset_id").withColumn("x", _upto("xs")).withColumn("y", _upto("ys"))
    head, tail = F.substring("text", F.lit(1), F.col("cut")), F.substring("text", F.col("cut") + 1, F.char_length("text"))
    c = met.select("dataset_id", "cut", "x", "y", F.lit(2).alias("side"), F.col("most").cast("bigint").alias("no"), head.alias("text"), tail.alias("tail"))
    dealt = a.unionByName(b).unionByName(c).repartition(n, *by).sortWithinPartitions(*by, "side")
    found = dealt.groupBy(*by).applyInArrow(tile, "dataset_id string, d int, left_no bigint, right_no bigint, text string")
    return found.groupBy("dataset_id").agg(F.min(F.struct("d", "left_no", "right_no", "text")).alias("b")).select("dataset_id", "b.d", "b.text")
