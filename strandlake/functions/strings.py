"""Column functions on strings: metrics, the hash random numbers, positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def unit(*keys: Column | str | int) -> Column:
    """A number in [0, 1) that the keys determine, whatever the partitioning.

    Strings and integers are literal keys; columns are taken as they are.
    """
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(n: Column | int, *keys: Column | str | int) -> Column:
    """An integer in 0..n-1 that the keys determine."""
    return F.floor(unit(*keys) * n).cast("int")


def symbols(s: Column | str) -> Column:
    """A string's characters as an array; empty for the empty string."""
    col = F.col(s) if isinstance(s, str) else s
    return F.when(F.char_length(col) == 0, F.array().cast("array<string>")).otherwise(F.split(col, ""))


def hamming(a: Column, b: Column, strict: bool = False) -> Column:
    """Positions that differ; unequal lengths give null, or an error if ``strict``."""
    d = F.aggregate(F.zip_with(symbols(a), symbols(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    other = F.raise_error(F.lit("strings of unequal length")).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.char_length(a) == F.char_length(b), d).otherwise(other)


#: Characters in one long of a packed string: a byte each, of which the highest bit stays free.
PACKED = 7


def packed(s: Column) -> Column:
    """A string of ASCII characters as longs of ``PACKED`` bytes each; null for any other string."""
    at = F.sequence(F.lit(1), F.char_length(s), F.lit(PACKED))
    words = F.transform(at, lambda i: F.conv(F.hex(F.substring(s, i, F.lit(PACKED))), 16, 10).cast("long"))
    return F.when(F.octet_length(s) == F.char_length(s), F.when(F.char_length(s) == 0, F.array().cast("array<bigint>")).otherwise(words))


def packed_difference(x: Column, y: Column) -> Column:
    """Characters that differ, of two longs of a packed string.

    The bytes of an exclusive or are below 128, so adding 127 sets a byte's highest bit exactly
    where the characters differ.
    """
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)
    return F.bit_count((x.bitwiseXOR(y) + low).bitwiseAND(high))


def packed_hamming(a: Column, b: Column) -> Column:
    """Positions that differ, of two packed strings of equal length."""
    each = F.zip_with(a, b, packed_difference)
    return F.aggregate(each, F.lit(0), lambda s, n: s + n)


def hamming_of(a: Column, b: Column, packed_a: Column, packed_b: Column) -> Column:
    """As `hamming`, by the packed forms where both strings have one."""
    fast = (F.char_length(a) == F.char_length(b)) & packed_a.isNotNull() & packed_b.isNotNull()
    return F.when(fast, packed_hamming(packed_a, packed_b)).otherwise(hamming(a, b))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


_METRICS: dict[str, Metric] = {"hamming": hamming, "levenshtein": levenshtein}


def register_metric(name: str, fn: Metric) -> None:
    """Make a user's ``Column x Column -> Column`` function a metric by name."""
    _METRICS[name.strip().lower()] = fn


def metric(name: str) -> Metric:
    """The metric of this name, trimmed and in any case; unknown names are an error."""
    try:
        return _METRICS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(_METRICS)}") from None


def replace_at(s: Column, pos: Column, symbol: Column) -> Column:
    """``s`` with the character at a 0-based position replaced."""
    return F.concat(F.substring(s, F.lit(1), pos), symbol, F.substring(s, pos + 2, F.char_length(s)))


def size_text(n_bytes: Column) -> Column:
    """A byte count for people, in B, KB, MB or GB."""
    out = F.concat(n_bytes.cast("string"), F.lit(" B"))
    for power, name in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n_bytes >= 1024**power, F.concat(F.format_number(n_bytes / 1024**power, 1), F.lit(f" {name}"))).otherwise(out)
    return out


def safe_json(text: Column) -> Column:
    """Valid JSON as it is, empty text as null, any other text as a JSON string."""
    return F.when(F.trim(text) == "", F.lit(None).cast("string")).when(F.try_parse_json(text).isNotNull(), text).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))


def register_sql(spark) -> None:
    """The scalar functions as SQL functions whose plan Catalyst sees."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(a STRING, b STRING) RETURNS INT RETURN CASE WHEN length(a) = length(b) THEN aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CAST(x <> y AS INT)), 0, (s, x) -> s + x) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hash_unit(k STRING) RETURNS DOUBLE RETURN CAST(conv(substr(md5(k), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D")
