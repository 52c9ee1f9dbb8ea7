"""Quality rules on repetition: how many of a text's characters lie in repeated n-grams and lines.

Per text, words get integer numbers, and an n-gram's rolling hash is that of its first n - 1
words times an odd multiplier plus the last word's number (numpy, 64-bit wrap-around). An n-gram
can only repeat where its first words do, so each length looks at the places the one before left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart

#: Chosen here: the largest share of a text's word characters that may lie in n-grams which
#: repeat an earlier one, by n, and in lines that repeat an earlier one; symbols a word.
NGRAM_SHARES = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
LINE_SHARE = 0.30
SYMBOLS_A_WORD = 0.10
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
MEASURES = ", ".join([f"{c} long" for c in _COUNTS] + [f"dup_chars_{n} long" for n in NGRAM_SHARES])


def _again(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold a value found twice or more, and which hold one found before."""
    order = np.argsort(hashes, kind="stable")
    same = np.diff(hashes[order]) == 0
    before, twice = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    before[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice | before, before


def _covered(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in the n-grams that begin at these places."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes) -> list[int]:
    """The numbers of ``MEASURES`` for one UTF-8 text."""
    words = text.split()
    n_words = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n_words)
    sizes = np.array([len(w.decode()) for w in numbers], np.int64)
    chars = sizes[ids.astype(np.int64)] if n_words else np.zeros(0, np.int64)
    n_symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    seen, n_dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += sum(len(w.decode()) for w in line.split())
        elif line.strip():
            seen.add(line)
    n_repeat, dup = 0, dict.fromkeys(NGRAM_SHARES, 0)
    hashes = ids + np.uint64(1)  # places ascend, so those cut off for lack of room are the last
    places = np.arange(n_words)
    for n in range(2, max(NGRAM_SHARES) + 1):
        places = places[places + n <= n_words]
        if not len(places):
            break
        hashes = hashes[: len(places)] * _MULTIPLIER + ids[places + n - 1] + np.uint64(1)
        if n < 3:
            continue
        twice, before = _again(hashes)
        if n == 3:
            n_repeat = int(_covered(places[twice], 3, n_words).sum())
        if n in dup:
            dup[n] = int(chars[_covered(places[before], n, n_words)].sum())
        places, hashes = places[twice], hashes[twice]
    return [n_words, int(chars.sum()), n_symbols, n_dup_lines, n_repeat, dup_line_chars, *dup.values()]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, MEASURES...)`` for every row; a null text has no words and all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            rows = np.array([measure(t.as_py() or b"") for t in texts], np.int64).reshape(len(texts), -1)
            names = [x.split()[0] for x in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows.T)], ["id", *names])

    rows = columns_apart(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"id long, {MEASURES}")


def verdicts(measures: DataFrame) -> DataFrame:
    """Adds base_failed and kept. No word characters: base_failed, as there are under 50 words."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    fine = (F.col("dup_line_chars") <= LINE_SHARE * F.col("word_chars")) & (F.col("n_symbols") <= SYMBOLS_A_WORD * F.col("n_words"))
    for n, share in NGRAM_SHARES.items():
        fine &= F.col(f"dup_chars_{n}") <= share * F.col("word_chars")
    return measures.withColumn("base_failed", base).withColumn("kept", ~base & fine)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row, repeated ids included: id, measures, base_failed, kept."""
    return verdicts(repetition(docs, id_col, text_col))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, in the input's columns and without moving them.

    The verdict is taken from the text beside the row, so rows with equal or null ids are
    judged one by one.
    """
    wanted = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            yield b.filter(pa.array([good(measure(t.as_py() or b"")) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*[F.col(f"`{c}`") for c in wanted])


def good(row: list[int]) -> bool:
    """``verdicts`` for one row of measures."""
    n_words, word_chars, n_symbols, _, n_repeat, dup_lines, *dups = row
    if n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED_PERCENT * n_words:
        return False
    if dup_lines > LINE_SHARE * word_chars or n_symbols > SYMBOLS_A_WORD * n_words:
        return False
    return all(d <= share * word_chars for d, share in zip(dups, NGRAM_SHARES.values()))
