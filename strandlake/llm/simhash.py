"""SimHash near-duplicates: fingerprints, and links within a Hamming radius found in BK-trees.

A 64-bit fingerprint is cut into five blocks. Two fingerprints that differ in at most three
bits agree on at least two whole blocks, so the ten pairs of blocks give ten ways to cut the
distinct fingerprints into shards, and every link lies inside some shard. In a shard a BK-tree
(children keyed by their integer distance to the parent) is searched along the edges within
the radius only, and just the links that join two parts of the shard are handed on, fewer than
it has members.

A shard tree goes to the task that owns the shard's key rather than to all executors: the
trees of a corpus grow with it, so a broadcast of them has no size bound. A shard above
``shard_limit`` members is cut again by the blocks of the bits it does not share yet; each
round fixes at least a quarter of those, so a few rounds bound every tree, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart, is_empty, stage, union_all, unused
from ..operators.components import connected_components

SEED = 42
WIDTH = 3
RADIUS = 3
_CHUNK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text: ASCII-lower-cased words, 3-word shingles, XXH64 with seed 42."""
    words = (text or b"").lower().split()  # bytes.split(): space and \\t..\\r only
    if not words:
        return 0
    width = min(WIDTH, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row: fp is the fingerprint as a signed long; null and wordless texts give 0."""
    return _fingerprints(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))


def _fingerprints(rows: DataFrame) -> DataFrame:
    """``rows(id long, text string, more longs)`` -> ``(id, more, fp)``."""
    more = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fps)], ["id", *more, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *more, "fp")))


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits of ``mask`` cut into so many blocks of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks(radius: int = RADIUS) -> list[int]:
    """radius + 2 blocks, of which two must be equal."""
    return [a | b for a, b in combinations(_blocks((1 << 64) - 1, radius + 2), 2)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Of the free bits' radius + 1 blocks one must be equal."""
    return [mask | b for b in _blocks(~mask & ((1 << 64) - 1), radius + 1) if b]


class BKTree:
    """Integers under Hamming distance; a node is [value, {distance: node}]."""

    def __init__(self, radius: int):
        self.root: list | None = None
        self.radius = radius

    def near(self, x: int) -> list[int]:
        """All values within the radius: along edge k only if \\|k - distance\\| is within it."""
        out, todo, r = [], [self.root] if self.root else [], self.radius
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= r:
                out.append(value)
            if children:
                if len(children) <= 2 * r + 1:
                    todo += [c for k, c in children.items() if -r <= k - d <= r]
                else:
                    todo += [children[k] for k in range(d - r, d + r + 1) if k in children]
        return out

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        value, children = self.root
        while (d := (value ^ x).bit_count()) in children:
            value, children = children[d]
        if d:
            children[d] = [x, {}]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect the shard's members as all links within the radius would."""
    tree, up, out = BKTree(radius), {}, []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x in sorted(set(values)):
        up[x] = x
        for y in tree.near(x):
            if (a := top(x)) != (b := top(y)):
                up[max(a, b)] = min(a, b)
                out.append((y, x))
        tree.add(x)
    return out


def radius_links(fps: DataFrame, radius: int = RADIUS, shard_limit: int = 1024) -> DataFrame:
    """``fps(fp)``, distinct longs -> ``(src, dst)``: links within the radius, enough to connect all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for members in b.column(0):
                found += shard_links([v & 0xFFFFFFFFFFFFFFFF for v in members.as_py()], radius)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in first_masks(radius)])).alias("mask"))
    out = []
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
        sizes = stage(sizes.where("n > 1"), "shards")
        fit = rows.join(sizes.where(f"n <= {shard_limit}").drop("n"), ["mask", "key"])
        shards = fit.groupBy("mask", "key").agg(F.collect_list("fp").alias("members"))
        out.append(stage(shards.select("members").mapInArrow(run, "src long, dst long").distinct(), "links"))
        large = sizes.where(f"n > {shard_limit}")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # as many as there are masks, whatever the input
        if not masks:
            return union_all(out).distinct()
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(_signed(v)) for v in finer_masks(m & 0xFFFFFFFFFFFFFFFF, radius)]))])
        hot = rows.join(large.drop("n"), ["mask", "key"])
        rows = stage(hot.select("fp", F.explode(finer[F.col("mask")]).alias("mask")), "hot")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_limit: int = 1024) -> DataFrame:
    """``(id, fp, component_id)``: one row for each input row, whatever else its columns are.

    component_id is the smallest id that links of at most ``radius`` differing bits reach (itself
    included). Null and wordless texts have fingerprint 0 and are linked like any other. Rows with
    equal ids or a null id are rows of their own; a component of null ids only has a null id.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "fps")
    named = _roots(fps, radius, shard_limit)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("id", "fp", "component_id")


def _roots(fps: DataFrame, radius: int = RADIUS, shard_limit: int = 1024) -> DataFrame:
    """``fps(id, fp)`` -> ``(fp, first, root)``: each fingerprint's smallest id and its component."""
    classes = stage(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    if is_empty(classes):
        return classes.withColumn("root", F.col("fp"))
    roots = connected_components(radius_links(classes.select("fp"), radius, shard_limit)).withColumnRenamed("node", "fp")
    return stage(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, in the input's columns: the one with the smallest id, null ids last.

    Ids may be null or repeat, so a row is told by its id and two hashes of its text. Rows that agree
    in these are in one component, and one of them stays; of different texts under the smallest id it
    is the one with the smallest hashes.
    """
    cols = docs.columns
    text = F.col(f"`{text_col}`").cast("string")
    own, h1, h2 = (unused(docs, c) for c in ("id_of", "h1", "h2"))
    key = {own: F.col(f"`{id_col}`").cast("long"), h1: F.xxhash64(text), h2: F.xxhash64(F.lit(7), text)}
    rows = docs.select(key[own].alias("id"), text.alias("text"), key[h1].alias("h1"), key[h2].alias("h2"))
    fps = stage(_fingerprints(rows), "fps")
    found = fps.join(_roots(fps.select("id", "fp")).select("fp", "root"), "fp")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h1", "h2")).alias("k")).select("k.id", "k.h1", "k.h2")
    kept = docs.withColumns(key)
    first = first.toDF(*[unused(kept, f"first_{c}") for c in ("id", "h1", "h2")])
    same = kept[own].eqNullSafe(F.col(first.columns[0])) & (kept[h1] == F.col(first.columns[1])) & (kept[h2] == F.col(first.columns[2]))
    return kept.join(first, same, "left_semi").dropDuplicates(list(key)).select(*[F.col(f"`{c}`") for c in cols])
