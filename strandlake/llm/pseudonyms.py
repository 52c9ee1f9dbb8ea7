"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A text is cut at the matches of one pattern, every match is validated and mapped, and the parts
are joined again. Numbers and dates are mapped to coordinates (a, b) of their own format's
domain Z_m1 x Z_m2, and a keyed Feistel network permutes the domain: the rounds add to a a
keyed digest of b modulo m1, then to b one of a modulo m2, and so on. So a pseudonym is valid
in the same format, equal values have equal pseudonyms in all documents, and different values
of a format never share one. What has no such domain (addresses, keys and passwords) gets a
keyed digest in its place.

All repeated groups of the pattern are bounded, as Java matches such groups by recursion: a text
of any length and content is read without a deep stack.
"""

from __future__ import annotations

import warnings
from functools import cache
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_apart

ROUNDS = 8
#: The setting that names the secret key.
KEY_SETTING = "spark.strandlake.pseudonym.key"
#: Only for sessions on one machine that set no key, such as tests.
DEMO_KEY = "strandlake-demo-key"

#: The lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban_form(length: int, countries: str) -> str:
    """In groups of four or without spaces, and not a character longer than the country's numbers are."""
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


_IBAN = "|".join(_iban_form(n, names) for n, names in IBAN_LENGTHS.items())
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The forms that are looked for, in order of preference where several begin at one place.
FORMS = {
    "secret": r"\b(?i:password|passwd|pwd|secret|token|api[_-]?key)\b\s*[=:]\s*(?:\"[^\"\s]+\"|'[^'\s]+'|[^\s\"']+)",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dot_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?!\.?[0-9])",
    "slash_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+(])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])|\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    # a known country's length first, so that no capitals behind the number are taken into it
    "iban": rf"\b(?:{_IBAN})\b|\b[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
}
PATTERN = "|".join(FORMS.values())
#: A cheap sign that a text has anything to look for.
_HINT = r"[0-9@]|AKIA|(?i:password|passwd|pwd|secret|token|key)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, *parts: Column) -> Column:
    """60 bits of a keyed SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m1: Column, m2: Column, key: str, domain: Column) -> Column:
    """A keyed permutation of Z_m1 x Z_m2 as a struct (a, b)."""

    def step(at: Column, i: Column) -> Column:
        even = i % 2 == 0
        add = _digest(key, domain, i, F.when(even, at["b"]).otherwise(at["a"]))
        return F.struct(
            F.when(even, (at["a"] + add % m1) % m1).otherwise(at["a"]).alias("a"),
            F.when(even, at["b"]).otherwise((at["b"] + add % m2) % m2).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """The digits put in the places that ``form`` has digits in."""
    places = F.sequence(F.lit(1), F.char_length(form))
    at = lambda i: F.char_length(_digits(F.substring(form, F.lit(1), i)))
    return F.array_join(F.transform(places, lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))), "")


def permute_digits(digits: Column, key: str, domain: Column) -> Column:
    """A permutation of all digit strings of this length (2 to 34)."""
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    m1, m2 = F.pow(F.lit(10.0), u).cast("long"), F.pow(F.lit(10.0), n - u).cast("long")
    a, b = F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, n - u).cast("long")
    return _let(feistel(a, b, m1, m2, key, F.concat_ws("/", domain, n)), lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), n - u, "0")))


def _luhn_sum(digits: Column, first_doubled: Column) -> Column:
    """Luhn's sum; places are counted from the right, and those with (place % 2 == first_doubled) are doubled."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d: d.cast("int"))
    parts = F.transform(values, lambda d, i: F.when(i % 2 == first_doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda s, d: s + d)


def luhn_valid(digits: Column) -> Column:
    return (_luhn_sum(digits, F.lit(1)) % 10 == 0) & F.char_length(digits).between(13, 19)


def _card(m: Column, key: str) -> Column:
    """First digit kept, the middle permuted, the check digit made anew."""

    def body(d: Column) -> Column:
        n = F.char_length(d)
        front = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), n - 2), key, F.lit("card")))
        new = _let(front, lambda f: F.concat(f, F.pmod(-_luhn_sum(f, F.lit(0)), F.lit(10)).cast("string")))
        return F.when(luhn_valid(d), _refill(m, new)).otherwise(m)

    return _let(_digits(m), body)


def _mod97(letters_and_digits: Column) -> Column:
    """The remainder by 97 of a text whose letters stand for 10 to 35."""
    value = lambda c: F.when(c < "A", c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(letters_and_digits, ""), F.lit(0), lambda s, c: (s * F.when(c < "A", 10).otherwise(100) + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    """Country and letters kept, the account's digits permuted, the check digits made anew."""

    def body(x: Column) -> Column:
        country, account = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.char_length(x))
        digits = _digits(account)
        filled = _refill(account, permute_digits(digits, key, F.concat_ws("/", F.lit("iban"), country)))

        def whole(a: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
            return _respace(m, F.concat(country, check, a))

        valid = (_mod97(F.concat(account, F.substring(x, 1, 4))) == 1) & F.char_length(digits).between(2, 30)
        return F.when(valid, _let(filled, whole)).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), body)


def _respace(form: Column, text: Column) -> Column:
    """The characters of ``text`` with spaces where ``form`` has them."""
    places = F.sequence(F.lit(1), F.char_length(form))
    at = lambda i: F.char_length(F.replace(F.substring(form, F.lit(1), i), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(places, lambda i: F.when(F.substring(form, i, F.lit(1)) == " ", " ").otherwise(F.substring(text, at(i), F.lit(1)))), "")


def _phone(m: Column, key: str) -> Column:
    """North American numbers keep +1 and valid area and exchange codes; others their first two digits, and a trunk zero in brackets."""
    m = F.replace(m, F.lit("(0)"), F.lit("(o)"))
    national = m.rlike(r"^(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}$")

    def north(d: Column) -> Column:
        n = F.char_length(d)
        last = lambda k, size: F.substring(d, n - k + 1, F.lit(size)).cast("long")
        s = feistel(last(10, 3) - 200, (last(7, 3) - 200) * 10_000 + last(4, 4), F.lit(800), F.lit(8_000_000), key, F.lit("phone"))
        pad = lambda x, size: F.lpad(x.cast("string"), size, "0")
        return _let(s, lambda s: F.concat(F.substring(d, F.lit(1), n - 10), pad(s["a"] + 200, 3), pad(F.floor(s["b"] / 10_000) + 200, 3), pad(s["b"] % 10_000, 4)))

    other = lambda d: F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, F.lit(3), F.char_length(d) - 2), key, F.lit("phone")))
    return _let(_digits(m), lambda d: F.replace(_refill(m, F.when(national, north(d)).otherwise(other(d))), F.lit("(o)"), F.lit("(0)")))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999; others are no such numbers and stay."""
    area, group, serial = (F.element_at(F.split(m, "-"), k).cast("long") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    s = feistel(a, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))

    def back(s: Column) -> Column:
        new = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        return F.format_string("%03d-%02d-%04d", new, F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1)

    return F.when(valid, _let(s, back)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    part = lambda k: F.element_at(F.split(m, r"\."), k).cast("long")
    s = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return _let(s, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def _date(m: Column, key: str, style: str) -> Column:
    """Dates of 1900 to 2099: (year, day of a common year); leap days among themselves."""
    real = F.try_to_timestamp(m, F.lit(style)).cast("date")
    leap = F.date_format(real, "MMdd") == "0229"
    year = F.year(real)
    after = (F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366) & (F.month(real) > 2)
    day = F.dayofyear(real) - 1 - after.cast("int")
    common = feistel(year - 1900, day, F.lit(200), F.lit(365), key, F.lit("date"))
    leaps = _leap_years(year, key, F.lit("leap"))
    # the month and day that a day of a common year has
    shape = lambda s: F.make_date((s["a"] + 1900).cast("int"), F.month(d := F.date_add(F.lit("2001-01-01").cast("date"), s["b"].cast("int"))), F.dayofmonth(d))
    new = F.when(leap, _let(leaps, lambda y: F.make_date(y, F.lit(2), F.lit(29)))).otherwise(_let(common, shape))
    return F.when(real.isNull(), m).otherwise(F.date_format(new, style))


def _leap_years(year: Column, key: str, domain: Column) -> Column:
    """A permutation of the 49 leap years from 1904 to 2096, as Z_7 x Z_7."""
    k = F.floor((year - 1904) / 4)
    return _let(feistel(F.floor(k / 7), k % 7, F.lit(7), F.lit(7), key, domain), lambda s: ((s["a"] * 7 + s["b"]) * 4 + 1904).cast("int"))


#: Days after the twelfth of a common year's months, added up: what no month-first date can name.
_LATE_DAYS = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)


def _slash_date(m: Column, key: str) -> Column:
    """Month first where that is a date; else day first, and then its day is above 12 and stays so."""
    late = F.when(F.substring(m, 1, 2).cast("int") > 12, F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date"))
    year, month, day = F.year(late), F.month(late), F.dayofmonth(late)
    before = F.array(*[F.lit(x) for x in _LATE_DAYS])
    common = feistel(year - 1900, F.element_at(before, month) + day - 13, F.lit(200), F.lit(221), key, F.lit("late date"))

    def shape(s: Column) -> Column:
        at = F.size(F.filter(before, lambda b: b <= s["b"]))
        return F.format_string("%02d/%02d/%04d", s["b"] - F.element_at(before, at) + 13, at, s["a"] + 1900)

    leap = _let(_leap_years(year, key, F.lit("late leap")), lambda y: F.format_string("29/02/%04d", y))
    return F.when(late.isNull(), _date(m, key, "MM/dd/yyyy")).when((month == 2) & (day == 29), leap).otherwise(_let(common, shape))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256), 1, 14), F.lit("@pseudonym.invalid"))


def _secret(m: Column, key: str) -> Column:
    """The name and the sign stay, the value becomes a digest of it."""
    head = F.regexp_extract(m, r"^(\w[\w-]*\s*[=:]\s*[\"']?)", 1)
    tail = F.regexp_extract(m, r"([\"']?)$", 1)
    value = F.substring(m, F.char_length(head) + 1, F.char_length(m) - F.char_length(head) - F.char_length(tail))
    return F.concat(head, F.substring(F.sha2(F.concat(F.lit(key + "|secret|"), value), 256), 1, 20), tail)


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(F.sha2(F.concat(F.lit(key + "|key|"), m), 256), 1, 16)))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one match of ``PATTERN``; itself if it isn't valid in its form."""
    whole = lambda name: m.rlike(f"^(?:{FORMS[name]})$")
    styles = {"iso_date": "yyyy-MM-dd", "dot_date": "dd.MM.yyyy"}
    maps = {"secret": _secret, "key": _access_key, "email": _email, "ip": _ip, "slash_date": _slash_date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}
    out = None
    for name in FORMS:
        new = _date(m, key, styles[name]) if name in styles else maps[name](m, key)
        out = F.when(whole(name), new) if out is None else out.when(whole(name), new)
    return out.otherwise(m)


@cache
def _own_key() -> str:
    """A random key of this driver, in no setting and no file."""
    return token_hex(32)


def key_of(spark: SparkSession) -> str:
    """The session's key. A cluster without one gets a random key of the driver, as anybody can undo a key that is known.

    With a random key equal values have equal pseudonyms in all jobs of the driver, but not in those of another one.
    """
    found = spark.sparkContext.getConf().get(KEY_SETTING) or spark.conf.get(KEY_SETTING, None)
    if not found and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms of this application are linked to no other's", stacklevel=2)
        return _own_key()
    return found or DEMO_KEY


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """``(doc_id, text, n_found, n_changed)`` per input row; a null text stays null with zeros.

    Nothing is shuffled: equal values are linked by the key alone, which is the session's unless one
    is given. Rows are kept as they come, repeated and null ids too, and an empty table gives an
    empty result.
    """
    key = key or key_of(docs.sparkSession)
    rows = columns_apart(docs, id_col, text_col).toDF("doc_id", "text")
    text = F.col("text")
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    cut = rows.withColumn("found", found)
    cut = cut.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    some = F.size("found") > 0
    between = F.when(some, F.split(text, PATTERN, -1)).otherwise(F.array(text))
    # the i-th part between matches is followed by the i-th pseudonym
    joined = F.array_join(F.zip_with(between, F.col("new"), lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    n = lambda c: F.when(text.isNull(), 0).otherwise(c).cast("long")
    return cut.select("doc_id", F.when(some, joined).otherwise(text).alias("text"), n(F.size("found")).alias("n_found"), n(changed).alias("n_changed"))
