"""Fuzzy line dedup: MinHash bands propose, exact Jaccard decides, union-find keeps one line a component.

Lines of at least ``SHINGLE`` characters have signatures over their distinct shingles of that
many characters: ``BANDS`` bands of ``ROWS`` minima, which find a pair at Jaccard 0.8
with probability 0.995 and one at 0.9 almost surely. Lines that share a band are candidates.
Each is compared with its band's pivot (the smallest line hash), not with all others. Where
that leaves a band's lines in several components, the lines across these are compared as well.
Bands come to tasks in parts of ``PART`` lines, two at a time, so none is gathered whole; bands
above ``HOT`` lines are cut by ``CUTS`` further triples of minima first, of which a pair at 0.8
shares one with probability 0.9998.

Candidates are compared by ``MINIMA`` more minima of one byte each before their shingles are.
A pair goes on unless its agreements are five standard deviations below those of a pair at the
threshold. Only lines that are candidates have such minima. Which
lines these are reaches the scan as a Bloom filter of fixed size, and an exact join follows.

Shorter lines have no shingles. They stay, or with ``short_lines`` are alike if they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_apart, is_empty, stage, unstage, unused
from ..operators.components import connected_components

SHINGLE = 7
#: Shorter lines have no signature.
LEAST_CHARS = SHINGLE
JACCARD = 0.8
BANDS, ROWS = 10, 4
MINIMA = 128
PART = 512
HOT, CUTS = 4096, 12
#: Bits of the Bloom filter that a scan gets: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: Line hashes that a task remembers, so as not to give a line twice; beyond it starts anew.
REMEMBERED = 1 << 17

_rng = np.random.default_rng(20240229)
_BAND_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MINIMA_FACTORS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are worked on at once, so that the arrays stay in the processor's cache.
_BLOCK = 1 << 15


def line_hash(line: bytes, seed: int = 42) -> int:
    """XXH64 of the UTF-8 line as a signed long, as Spark's xxhash64 gives it for seed 42."""
    h = xxhash.xxh64_intdigest(line, seed)
    return h - (1 << 64) if h >> 63 else h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def _shingle_hashes(points: np.ndarray) -> np.ndarray:
    """32-bit hashes of all runs of SHINGLE code points."""
    h = np.zeros(len(points) - SHINGLE + 1, np.uint32)
    for k in range(SHINGLE):
        h *= np.uint32(0x01000193)
        h += points[k : k + len(h)]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    return h ^ (h >> np.uint32(16))


def minima(lines: list[str], factors: np.ndarray) -> np.ndarray:
    """The least of factor * hash over each line's shingles, (factors x lines); all lines have a shingle."""
    out = np.empty((len(factors), len(lines)), np.uint32)
    part: list[str] = []
    begins: list[int] = []  # the lines' first pieces in ``part``
    first = chars = 0

    def flush(until: int) -> None:
        nonlocal part, begins, first, chars
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        own = np.ones(len(points), bool)
        for k in range(1, SHINGLE):  # no shingle runs over an end
            own[np.cumsum(sizes) - k] = False
        h = _shingle_hashes(points)
        h = h[own[: len(h)]]
        at = (np.cumsum(sizes - SHINGLE + 1) - (sizes - SHINGLE + 1))[begins]
        room = np.empty_like(h)
        for row, factor in zip(out, factors):
            np.multiply(h, factor, out=room)
            row[first:until] = np.minimum.reduceat(room, at)
        part, begins, first, chars = [], [], until, 0

    for i, line in enumerate(lines):
        begins.append(len(part))
        if len(line) <= _BLOCK:
            part.append(line)
        else:
            part += [line[k : k + _BLOCK + SHINGLE - 1] for k in range(0, len(line) - SHINGLE + 1, _BLOCK)]
        chars += len(line)
        if chars >= _BLOCK:
            flush(i + 1)
    if part:
        flush(len(lines))
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys (lines x BANDS, int64) of lines that all have at least SHINGLE characters."""
    low = minima(lines, _BAND_FACTORS).reshape(BANDS, ROWS, len(lines)).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(1)
    for r in range(ROWS):
        keys = _mix(keys * _STEP + low[:, r])
    return keys.T.copy().view(np.int64)


def marks(lines: list[str]) -> np.ndarray:
    """A byte of each of MINIMA minima (lines x MINIMA)."""
    return np.ascontiguousarray((minima(lines, _MINIMA_FACTORS) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).T)


def least_agreements(least: float) -> int:
    """Marks in which pairs at this similarity agree, less five standard deviations."""
    return int(MINIMA * least - 5 * (MINIMA * least * (1 - least)) ** 0.5)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def jaccard(a: str, b: str) -> float:
    return _jaccard(shingles(a), shingles(b)) if max(len(a), len(b)) >= SHINGLE else float(a == b)


def _jaccard(x: set[str], y: set[str]) -> float:
    return (n := len(x & y)) / (len(x) + len(y) - n)


def _lines(texts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """(number of the text, number of the line, line) of all lines that aren't blank."""
    for row, text in enumerate(texts.cast(pa.large_binary())):
        for no, line in enumerate((text.as_py() or b"").split(b"\n")):
            if line and not line.isspace():
                yield row, no, line


def line_table(docs: DataFrame, short_lines: bool = False) -> DataFrame:
    """``docs(row, id, text)`` -> a row for each line that counts: row, id, line_no, h, check, bands.

    Bands are null for short lines, and where the same task has given them for an equal line already.
    """
    names = ["row", "id", "line_no", "h", "check", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows: list[tuple[int, int, int, int, bool]] = []
        fresh: list[str] = []
        chars = 0

        def flush(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal rows, fresh, chars
            at, no, h, check, signed = zip(*rows)
            sizes = np.where(np.array(signed), BANDS, 0)
            keys = signatures(fresh).ravel() if fresh else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys), mask=pa.array(sizes == 0))
            own = [b.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
            rows, fresh, chars = [], [], 0
            return pa.RecordBatch.from_arrays([*own, pa.array(no, pa.int32()), pa.array(h, pa.int64()), pa.array(check, pa.int64()), bands], names)

        for b in batches:
            for row, no, raw in _lines(b.column(2)):
                h = line_hash(raw)
                line = raw.decode("utf-8", "replace") if h not in seen or len(raw) < 4 * SHINGLE else None
                short = line is not None and len(line) < LEAST_CHARS
                if short and not short_lines:
                    continue
                rows.append((row, no, h, line_hash(raw, 7), new := not short and h not in seen))
                if new:
                    seen.add(h)
                    fresh.append(line)
                    chars += len(line)
                if chars > 1 << 20 or len(rows) > 1 << 16:
                    yield flush(b)
            if rows:
                yield flush(b)
            if len(seen) > REMEMBERED:
                seen.clear()

    return docs.select("row", "id", "text").mapInArrow(run, "row long, id long, line_no int, h long, check long, bands array<long>")


def _filter_of(values: DataFrame) -> np.ndarray:
    """A Bloom filter of ``values(h)``: each task makes one of fixed size, and they are or-ed in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            for at in _places(np.asarray(b.column(0))):
                np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for k in range(0, len(packed), 1 << 18):
            if (part := packed[k : k + (1 << 18)]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["at", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(part, np.uint8)
                parts[at] = parts[at] | part if at in parts else part
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["at", "part"])

    schema = "at long, part binary"
    merged = values.coalesce(16).mapInArrow(run, schema).repartition(16, "at").mapInArrow(merge, schema)
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in merged.collect():  # FILTER_BITS bits in all
        part = np.frombuffer(bytes(r["part"]), np.uint8)
        out[r["at"] : r["at"] + len(part)] |= part
    return out


def _places(h: np.ndarray) -> list[np.ndarray]:
    x = h.view(np.uint64) if h.dtype == np.int64 else h.astype(np.int64).view(np.uint64)
    x = _mix(x)
    return [((x >> np.uint64(s)) % np.uint64(FILTER_BITS)).astype(np.int64) for s in (0, 20, 39)]


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, text, marks)``, one row for each line hash in ``wanted(h)``."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def given(lines: dict[int, str]) -> pa.RecordBatch:
        texts = list(lines.values())
        low = [x.tobytes() for x in marks(texts)]
        return pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int64()), pa.array(texts, pa.string()), pa.array(low, pa.binary())], ["h", "text", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            raw = [x for _, _, x in _lines(b.column(0)) if len(x) >= SHINGLE]
            h = np.fromiter(map(line_hash, raw), np.int64, len(raw))
            hit = np.ones(len(h), bool)
            for at in _places(h):
                hit &= (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            found, chars = {}, 0
            for i in np.flatnonzero(hit):
                if (x := int(h[i])) in seen or len(line := raw[i].decode("utf-8", "replace")) < SHINGLE:
                    continue
                seen.add(x)
                found[x] = line
                if (chars := chars + len(line)) > 1 << 20:
                    yield given(found)
                    found, chars = {}, 0
            if found:
                yield given(found)
            if len(seen) > REMEMBERED:
                seen.clear()

    found = docs.select("text").mapInArrow(run, "h long, text string, marks binary")
    # of lines whose 64-bit hashes agree the smallest is meant
    return found.join(wanted, "h", "left_semi").groupBy("h").agg(F.min(F.struct("text", "marks")).alias("x")).select("h", "x.*")


def _agreeing(a: pa.Array, b: pa.Array, least: float) -> pa.Array:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, MINIMA) for c in (a, b))
    return pa.array((x == y).sum(axis=1) >= least_agreements(least))


def verified(pairs: DataFrame, texts: DataFrame, least: float = JACCARD) -> DataFrame:
    """The ``pairs(src, dst)`` whose lines have at least this Jaccard similarity."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["src", "dst"]).filter(_agreeing(b.column(2), b.column(3), least))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if x != last:  # pairs come sorted by their pivots
                    last, own = x, shingles(x)
                ok.append(_jaccard(own, shingles(y)) >= least)
            yield b.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    def beside(of: DataFrame, col: str) -> DataFrame:
        for end in ("dst", "src"):
            of = of.join(texts.select(F.col("h").alias(end), F.col(col).alias(f"{col}_{end}")), end)
        return of.select("src", "dst", f"{col}_src", f"{col}_dst")

    schema = "src long, dst long"
    return beside(beside(pairs, "marks").mapInArrow(near, schema), "text").mapInArrow(alike, schema)


def close_pairs(root: np.ndarray, part: np.ndarray, mark: np.ndarray, mixed: bool, least: float = JACCARD) -> tuple[np.ndarray, np.ndarray]:
    """Places a < b of a band's lines that may be similar and are of different components (``mixed``: and parts)."""
    n, bound = len(root), least_agreements(least)
    out = []
    step = max(1, (1 << 22) // (n * MINIMA))
    for at in range(0, n, step):
        rows = slice(at, at + step)
        may = (root[rows, None] != root) & (np.arange(at, min(n, at + step))[:, None] < np.arange(n))
        if mixed:
            may &= part[rows, None] != part
        a, b = np.nonzero(may)
        close = (mark[a + at] == mark[b]).sum(axis=1) >= bound
        out.append((a[close] + at, b[close]))
    return tuple(np.concatenate(x) for x in zip(*out))


def links_across(root: np.ndarray, part: np.ndarray, mark: np.ndarray, texts: pa.Array, mixed: bool, least: float = JACCARD) -> list[tuple[int, int]]:
    """Links between the roots of a band's similar lines (``mixed``: of different parts).

    A link joins its lines' components at once, so that no other pair of these is compared.
    """
    a, b = close_pairs(root, part, mark, mixed, least)
    if not len(a):
        return []
    up = {x: x for x in root.tolist()}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sets = {k: shingles(texts[k].as_py()) for k in set(a.tolist()) | set(b.tolist())}
    out = []
    for i, j, r, s in zip(a.tolist(), b.tolist(), root[a].tolist(), root[b].tolist()):
        if top(r) != top(s) and _jaccard(sets[i], sets[j]) >= least:
            out.append((r, s))
            up[top(r)] = top(s)
    return out


def line_components(docs: DataFrame, lines: DataFrame, least: float = JACCARD) -> DataFrame | None:
    """``(node, root)`` of the line hashes that have a similar line; None if no lines share a band."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = lines.where("bands is not null").select("h", F.explode("bands").alias("key")).repartition(parts, "key")
    shared = bands.groupBy("key").agg(F.min("h").alias("pivot"), F.max("h").alias("last")).where("pivot < last").select("key", "pivot")
    # both sides read the one exchange by key, and the smaller is no larger than its partition's keys;
    # equal lines of several tasks are one member
    members = stage(bands.join(shared.hint("shuffle_hash"), "key").distinct(), "members")
    if is_empty(members):
        return None
    texts = stage(texts_of(docs, members.select("h").distinct()), "texts")
    pairs = members.where("h <> pivot").select(F.col("pivot").alias("src"), F.col("h").alias("dst")).distinct()
    links = stage(verified(pairs, texts, least), "links")  # components read them more than once
    roots = stage(connected_components(links), "components")
    unstage(links)
    more = _open_links(members, roots, texts, least)
    unstage(members, texts)
    if is_empty(more):
        return roots
    wider = stage(connected_components(more), "wider")
    unstage(more)
    # a line that only the second look has linked is its own root so far
    every = roots.unionByName(wider.select("node", F.col("node").alias("root"))).distinct()
    return stage(every.join(wider.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")).distinct(), "components")


def _open_links(members: DataFrame, roots: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links inside bands between the roots of components that the pivots have not joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py()
            rows = b.column(1).flatten()
            root, part = (rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            mark = np.frombuffer(b"".join(rows.field(2).to_pylist()), np.uint8).reshape(-1, MINIMA)
            found = []
            for mixed, lo, hi in zip(b.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                found += links_across(root[lo:hi], part[lo:hi], mark[lo:hi], rows.field(3)[lo:hi], mixed, least)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    of_line = members.select("key", "h").join(roots.withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    count = lambda rows: rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2 and n > 1").select("key", "n")
    # of two lines one is the pivot, and they have been compared
    placed = of_line.join(count(of_line).where("n > 2"), "key").join(texts, "h")
    cuts = F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(CUTS - 1))).otherwise(F.array(F.lit(-1)))
    cut = F.when(F.col("cut") < 0, F.col("key")).otherwise(F.xxhash64("key", "cut", F.substring("marks", 3 * F.col("cut") + 1, F.lit(3))))
    placed = stage(placed.withColumn("cut", F.explode(cuts)).select(cut.alias("key"), "h", "root", "marks", "text"), "placed")
    part = F.pmod(F.xxhash64("h", F.lit(3)), F.col("parts")).cast("int")
    sizes = count(placed).select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = placed.join(sizes, "key").withColumn("part", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * members.sparkSession.sparkContext.defaultParallelism)
    # by number, as few bytes can be much work: a partition's size says little here
    rows = rows.select(F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "key", F.struct("root", "part", "marks", "text").alias("row")).repartition(tasks, "i", "j", "key")
    groups = rows.groupBy("i", "j", "key").agg(F.collect_list("row").alias("rows"))
    found = stage(groups.select((F.col("i") != F.col("j")).alias("mixed"), "rows").mapInArrow(run, "src long, dst long").distinct(), "links")
    unstage(placed)
    return found


def dropped_lines(docs: DataFrame, least: float = JACCARD, short_lines: bool = False) -> DataFrame:
    """``docs(row, id, text)`` -> ``(row, drop array<int>)``: the line numbers that go, of rows that lose any.

    Of each component (equal lines are one) the first line by (id, row, line number) stays; a null
    id comes last. ``row`` tells rows apart, so those with a null or repeated id are documents each.
    """
    lines = stage(line_table(docs, short_lines), "lines")
    roots = line_components(docs, lines, least)
    # a hash that stands for two different lines is told by the second hash: only equals of the smaller count
    named = lines.groupBy("h").agg(F.min("check").alias("check"), F.count(F.lit(1)).alias("n"))
    if roots is None:
        named = named.where("n > 1").withColumn("root", F.col("h"))
    else:
        named = named.join(roots.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "h"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "line_no")
    alike = stage(lines.join(named.select("h", "check", "root"), ["h", "check"]).select("root", place.alias("place")), "alike")
    unstage(lines)
    # written, so that the join reads two shuffles and a component with many lines can be split
    keep = stage(alike.groupBy("root").agg(F.min("place").alias("keep")), "keep")
    gone = alike.join(keep, "root").where(F.col("place") != F.col("keep"))
    return gone.groupBy(F.col("place.row").alias("row")).agg(F.array_sort(F.collect_set("place.line_no")).alias("drop"))


def _between(lines: Column, drop: str) -> Column:
    """The lines less those whose numbers ``drop`` names in order: the stretches between these, in linear time."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1)
    return F.flatten(F.transform(F.concat(drop, F.array(F.size(lines))), lambda d, i: F.slice(lines, begin(i) + 1, d - begin(i))))


def _marked(docs: DataFrame, id_col: str, text_col: str, least: float, short_lines: bool) -> tuple[DataFrame, str, Column, Column]:
    """The input's rows beside the numbers of the lines that go (in a column of the name given), their lines and new text."""
    row, drop = unused(docs, "row"), unused(docs, "drop")
    void = [c for c, kind in docs.dtypes if kind == "void"]  # Parquet has no such columns
    held = stage(columns_apart(docs, *[c for c in docs.columns if c not in void]).withColumn(row, F.monotonically_increasing_id()), "input")
    rows = columns_apart(held, row, id_col, text_col).toDF("row", "id", "text").select("row", F.col("id").cast("long"), F.col("text").cast("string"))
    drops = dropped_lines(rows, least, short_lines).select(F.col("row").alias(row), F.col("drop").alias(drop))
    joined = held.join(drops, row, "left").withColumns({c: F.lit(None) for c in void})
    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    kept = F.array_join(F.transform(F.array(lines), lambda all_: _between(all_, drop))[0], "\n")
    return joined, drop, lines, F.when(F.col(drop).isNull(), F.col(f"`{text_col}`")).otherwise(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = JACCARD, short_lines: bool = False) -> DataFrame:
    """The input's rows and columns, with the text less the lines that go, and ``n_lines``, ``n_dropped``.

    Lines are what stands between line feeds. Blank ones always stay, and those under ``LEAST_CHARS``
    characters stay unless ``short_lines`` says that their equals go as well. A null text stays null with 0 lines; a document may lose all
    its lines and is kept, empty. Rows are numbered as they are written once with the input, since their
    ids may be null or repeat. Columns of the input named ``n_lines`` or ``n_dropped`` give way.
    """
    joined, drop, lines, text = _marked(docs, id_col, text_col, least, short_lines)
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*out, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = JACCARD, short_lines: bool = False) -> DataFrame:
    """As `dedup_lines`, in just the input's columns."""
    joined, _, _, text = _marked(docs, id_col, text_col, least, short_lines)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
