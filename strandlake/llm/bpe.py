"""Byte-level BPE of whole texts by overlapping chunks, and decoding by concatenating raw bytes.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens for itself, in
parallel, so a chunk's first pre-tokens may be cut wrong and its last ones may be unfinished.
Two neighbours are stitched at the first place in their overlap where both have a pre-token
boundary: the pattern looks only ahead, so from a common boundary on they agree. Then each chunk
encodes its pieces, the pre-tokens between its two stitches, and the ids of a text's chunks are
put in order. A text in which some neighbours have no common boundary (a pre-token that fills an
overlap) is split whole, in one task.

Texts of one chunk need no stitches and are encoded where they are read, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_apart, is_empty, stage

#: Code points from one chunk's start to the next, and by how many a chunk reaches into its neighbours.
CHUNK, OVERLAP = 32_768, 1_024
#: Code points behind a match that the pattern may have looked at ("'re" is given up at the third).
LOOK_AHEAD = 2
#: Pre-tokens whose ids a worker remembers; beyond it starts anew, which changes speed only.
CACHE = 200_000
IDS = "id long, ids binary"
DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Coder:
    """Ranks, pre-token pattern and the ids of pre-tokens seen lately.

    The pattern is run by a module whose Unicode version may differ from the one inside the
    tokenizer library, so characters that the two put in different classes are shown to it as
    stand-ins of the class that the tokenizer library sees.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
        self.stand_ins: dict[int, str] = {}
        for kind, stand_in in (("\\s", " "), ("\\p{L}", "a"), ("\\p{N}", "1")):
            only = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            theirs, ours = set(bytes(only.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
            self.stand_ins |= {ord(c): "\uffff" for c in ours - theirs}
            self.stand_ins |= {ord(c): stand_in for c in theirs - ours}
        self.first_odd = chr(min(self.stand_ins, default=sys.maxunicode))

    def _shown(self, text: str) -> str:
        return text.translate(self.stand_ins) if not text.isascii() and max(text) >= self.first_odd else text

    def pre_tokens(self, text: str) -> list[str]:
        shown = self._shown(text)
        if shown == text:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]

    def starts(self, text: str) -> np.ndarray:
        """Where the pre-tokens begin."""
        return np.array([m.start() for m in self.pattern.finditer(self._shown(text))], np.int32)

    def encode(self, pre_tokens: list[str]) -> bytes:
        """Their ids, as little-endian unsigned 32-bit integers."""
        known = self.known
        for w in set(pre_tokens).difference(known):
            known[w] = np.array(self.encoding._encode_single_piece(w), "<u4").tobytes()
        out = b"".join(map(known.__getitem__, pre_tokens))
        if len(known) > CACHE:
            known.clear()
        return out


@cache
def coder(ranks_path: str, pattern: str) -> Coder:
    """One a Python worker, which Spark uses again for later tasks."""
    return Coder(ranks_path, pattern)


@cache
def raw_tokens(ranks_path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = read_ranks(ranks_path)
    raw = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    return raw


def raw_bytes(ids: bytes, ranks_path: str) -> bytes:
    return b"".join(map(raw_tokens(ranks_path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_ranks() -> tuple[str, str]:
    """Path of the ranks and the pre-token pattern that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _texts(column: pa.Array) -> Iterator[str]:
    """Row by row; bytes that are no UTF-8 become replacement characters."""
    for x in column.cast(pa.binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _in_portions(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches whose texts and bytes are of a bounded size together, but for single larger ones."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size > most_bytes or len(held) >= 10_000:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


# ------------------------------------------------------------------ long texts: chunks, stitches, pieces

_CHUNKS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("no", pa.int32()), ("at", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
_SPLIT = pa.schema([*_CHUNKS, ("starts", pa.list_(pa.int32()))])
_PIECE_IDS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("no", pa.int32()), ("ids", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``rows(row, id, text)`` -> chunk ``no`` holds the code points from ``at``, up to ``overlap`` before and behind its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for row, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2))):
                    n = max(1, -(-len(text) // chunk))
                    for no in range(n):
                        at = max(0, no * chunk - overlap)
                        yield row, i, no, at, no == n - 1, text[at : (no + 1) * chunk + overlap]

        yield from _in_portions(each(), _CHUNKS)

    return rows.mapInArrow(cut, _ddl(_CHUNKS))


def pre_tokenised(cut: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Chunks with ``starts``, the text's places where they begin a pre-token that nothing behind the chunk can change."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)

        def each():
            for b in batches:
                for row, i, no, at, last, text in zip(*[c.to_pylist() for c in b.columns]):
                    starts = own.starts(text)
                    if not last:  # a start is sure if the pre-token before it is
                        starts = starts[starts + LOOK_AHEAD <= len(text)]
                    yield row, i, no, at, last, text, starts.tolist()

        yield from _in_portions(each(), _SPLIT)

    return cut.mapInArrow(split, _ddl(_SPLIT))


def stitched(split: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Each chunk's piece ``lo`` to ``hi``, places in the text; ``open`` if any neighbours of the text have no common boundary.

    Only the boundaries inside overlaps are compared, and they are of bounded number.
    """
    border = lambda k: (F.col("no").cast("long") + k) * chunk
    near = lambda k: F.filter(F.transform("starts", lambda s: s + F.col("at")), lambda p: (p >= border(k) - overlap) & (p < border(k) + overlap))
    order = Window.partitionBy("row").orderBy("no")
    edges = split.select("row", "no", near(0).alias("head"), near(1).alias("tail"))
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    lo = F.when(F.col("no") == 0, F.lit(0)).otherwise(common)
    ends = edges.withColumn("lo", lo).withColumn("hi", F.lead("lo").over(order))
    return ends.select("row", "no", "lo", "hi", F.max(F.col("lo").isNull()).over(Window.partitionBy("row")).alias("open"))


def _long_ids(rows: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``(row, id, no, ids)``: the ids of each piece of texts of several chunks."""
    cut = chunks(rows, chunk, overlap).repartition(F.col("row"), F.col("no"))
    split = stage(pre_tokenised(cut, ranks, pattern), "chunks")
    ends = stage(stitched(split, chunk, overlap), "stitches")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)

        def each():
            for b in batches:
                for row, i, no, at, text, starts, lo, hi in zip(*[c.to_pylist() for c in b.columns]):
                    stops = [s for s in starts if lo <= s + at and (hi is None or s + at < hi)]
                    stops.append(len(text) if hi is None else hi - at)
                    yield row, i, no, own.encode([text[a:z] for a, z in zip(stops, stops[1:])])

        yield from _in_portions(each(), _PIECE_IDS)

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        yield from _in_portions(((row, i, 0, own.encode(own.pre_tokens(text))) for b in batches for row, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)))), _PIECE_IDS)

    keys = ["row", "no"]
    done = split.join(ends.where("not open"), keys).select("row", "id", "no", "at", "text", "starts", "lo", "hi").mapInArrow(encode, _ddl(_PIECE_IDS))
    opened = ends.where("open")
    if is_empty(opened):
        return done
    # a chunk's own stretch of the text, without what it shares with its neighbours
    own_part = F.substring("text", (F.col("no").cast("long") * chunk - F.col("at") + 1).cast("int"), F.lit(chunk))
    texts = split.join(opened.select(*keys), keys).select("row", "id", "no", own_part.alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "t"))), lambda x: x["t"])  # one document's text
    return done.unionByName(texts.groupBy("row", "id").agg(F.array_join(parts, "").alias("text")).mapInArrow(encode_whole, _ddl(_PIECE_IDS)))


# ------------------------------------------------------------------ whole texts


def _split_by_length(docs: DataFrame, chunk: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = columns_apart(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_ = F.char_length("text") > chunk
    # numbers of one run of the job only: they tell rows apart up to the table that is written next
    return rows.where(~long_), rows.where(long_).select(F.monotonically_increasing_id().alias("row"), "id", "text")


def _joined(row: tuple, parts: pa.Table) -> pa.Table:
    """The ids of one text's pieces in order; at most the document's own size."""
    parts = parts.sort_by("no")
    return pa.table({"id": parts.column("id").slice(0, 1), "ids": pa.array([b"".join(x.as_py() for x in parts.column("ids"))], pa.binary())})


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: each row's ids as little-endian unsigned 32-bit integers.

    Every row gives a row, repeated rows and null ids too. A null text counts as empty and has no
    ids; an empty table gives an empty result. A pre-token may be of any length.
    """
    if chunk <= 2 * overlap or overlap < 1:
        raise ValueError("a chunk must be longer than its two overlaps")
    ranks, pattern = ranks or default_ranks()[0], pattern or default_ranks()[1]
    short, long_ = _split_by_length(docs, chunk, id_col, text_col)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        yield from _in_portions(((i, own.encode(own.pre_tokens(text))) for b in batches for i, text in zip(b.column(0).to_pylist(), _texts(b.column(1)))), schema)

    found = short.mapInArrow(whole, IDS)
    parts = _long_ids(long_, ranks, pattern, chunk, overlap)
    return found.unionByName(parts.groupBy("row").applyInArrow(_joined, IDS))


def decode(encoded: DataFrame, ranks: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)``: the raw bytes of each row's ids, one after another. Null ids count as none."""
    ranks = ranks or default_ranks()[0]
    schema = pa.schema([("id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_portions(((i, raw_bytes(ids or b"", ranks)) for b in batches for i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), schema)

    return columns_apart(encoded, id_col, ids_col).toDF("id", "ids").select(F.col("id").cast("long"), "ids").mapInArrow(run, "id long, bytes binary")


def digests(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``DIGESTS`` of ``encode``'s rows: how many ids, and SHA-256 of the ids and of what they decode to."""
    ranks = ranks or default_ranks()[0]
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((i, x.as_py()) for i, x in zip(b.column(0).to_pylist(), b.column(1)))
            yield _batch([(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw_bytes(ids, ranks)).hexdigest()) for i, ids in rows], schema)

    return encoded.select("id", "ids").mapInArrow(run, DIGESTS)
