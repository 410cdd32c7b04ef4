"""Normalisation of names, phones, identifiers and addresses, as columns.

Accents are folded in an Arrow UDF, for rows with characters outside ASCII only; all else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that are titles or kinship marks, not names.
NOISE_TOKENS = ("MR", "MRS", "MS", "MISS", "SHRI", "SRI", "SMT", "KUMARI", "KUM", "DR", "PROF", "SO", "WO", "DO", "CO", "S", "W", "D", "C", "OF", "LATE")
#: Spellings in addresses and the word they stand for.
ADDRESS_WORDS = {
    "RD": "ROAD", "ST": "STREET", "CRS": "CROSS", "CROSS": "CROSS", "MN": "MAIN", "MAIN": "MAIN", "APT": "APARTMENT", "APTS": "APARTMENT", "APARTMENT": "APARTMENT",
    "APARTMENTS": "APARTMENT", "NGR": "NAGAR", "NAGAR": "NAGAR", "PO": "POSTOFFICE", "NO": "NUMBER", "NUM": "NUMBER",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upper(x: Column | str) -> Column:
    return F.upper(F.coalesce(_c(x), F.lit("")))


def trim_to_empty(x: Column | str) -> Column:
    """Without characters up to U+0020 at either end; null is empty."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(x: Column | str) -> Column:
    return _c(x).isNull() | _c(x).rlike(r"^\s*$")


def squeeze(x: Column | str) -> Column:
    """Trimmed, with each run of ASCII white space as one space."""
    return F.regexp_replace(trim_to_empty(x), r"\s+", " ")


def alphanum_upper(x: Column | str) -> Column:
    return F.regexp_replace(upper(x), "[^A-Z0-9]", "")


def digits_only(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\D", "")


@F.pandas_udf(T.StringType())
def _folded(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ"))


def strip_accents(x: Column | str, ascii_only: bool = False) -> Column:
    """Without combining marks after decomposition; with ascii_only the caller vouches that there are none."""
    x = F.coalesce(_c(x), F.lit(""))
    other = x.rlike(r"[^\x00-\x7F]")
    # the UDF is called for every row whatever surrounds it, so rows that need no folding reach it as nulls
    return x if ascii_only else F.when(other, _folded(F.when(other, x))).otherwise(x)


def name_tokens(x: Column | str, ascii_only: bool = False) -> Column:
    """Upper-cased tokens without titles and single letters, in order."""
    parts = F.split(strip_accents(upper(squeeze(x)), ascii_only), "[^A-Z0-9]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*NOISE_TOKENS) & ~((F.length(t) == 1) & t.rlike("[A-Z]")))


def name_key(x: Column | str, ascii_only: bool = False) -> Column:
    return F.array_join(F.array_sort(name_tokens(x, ascii_only)), " ")


def phone_key(x: Column | str) -> Column:
    return F.right(digits_only(x), F.lit(10))


def government_id_key(x: Column | str) -> Column:
    """Digits of at least 8, or an opaque token of at least 16 letters and digits; else empty."""
    bare = F.replace(squeeze(x), F.lit(" "), F.lit(""))
    opaque = alphanum_upper(bare)
    return F.when(bare.rlike("^[0-9]+$"), F.when(F.length(bare) >= 8, bare).otherwise("")).otherwise(F.when(F.length(opaque) >= 16, opaque).otherwise(""))


def address_tokens(x: Column | str, ascii_only: bool = False) -> Column:
    """Distinct tokens of two letters or more, spelled out, in order."""
    parts = F.filter(F.split(strip_accents(upper(squeeze(x)), ascii_only), "[^A-Z0-9]+"), lambda t: F.length(t) >= 2)
    words = F.create_map(*[F.lit(y) for k, v in ADDRESS_WORDS.items() for y in (k, v)])
    return F.array_distinct(F.transform(parts, lambda t: F.coalesce(F.try_element_at(words, t), t)))


def soundex(x: Column | str, ascii_only: bool = False) -> Column:
    """Four-character code of the letters of x; empty without letters."""
    letters = F.regexp_replace(strip_accents(upper(x), ascii_only), "[^A-Z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def blocking_keys(ascii_only: bool = False) -> Column:
    """Distinct keys of a row with full_name, government_id, phone, date_of_birth and ward_code."""
    return keys_of(government_id_key("government_id"), phone_key("phone"), name_tokens("full_name", ascii_only), ascii_only)


def keys_of(gid: Column, phone: Column, tokens: Column, ascii_only: bool = False) -> Column:
    """blocking_keys of normalised identifiers and tokens of the name; each is used several times, so columns are cheaper than expressions."""
    year = F.year("date_of_birth").cast("string")
    packed = F.array_join(F.array_sort(tokens), "")
    named = F.size(tokens) > 0
    keys = F.array(
        F.when(gid != "", F.concat(F.lit("GID:"), gid)),
        F.when(F.length(phone) == 10, F.concat(F.lit("PHN:"), phone)),
        F.when(named & year.isNotNull(), F.concat(F.lit("SDX:"), soundex(F.get(tokens, F.lit(0)), ascii_only), F.lit(":"), year)),
        F.when((F.length(packed) >= 4) & F.col("date_of_birth").isNotNull(), F.concat(F.lit("NDB:"), F.left(packed, F.lit(4)), F.lit(":"), F.col("date_of_birth").cast("string"))),
        F.when(named & ~is_blank("ward_code"), F.concat(F.lit("WRD:"), upper(trim_to_empty("ward_code")), F.lit(":"), soundex(F.get(tokens, F.size(tokens) - 1), ascii_only))),
    )
    return F.array_distinct(F.array_compact(keys))


def csv_list(x: Column | str) -> Column:
    """Trimmed, non-empty codes of comma-separated text, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), trim_to_empty), lambda t: t != ""))


def csv_set(x: Column | str) -> Column:
    return F.array_sort(csv_list(x))


def percent_text(x: Column | str) -> Column:
    """Four decimals; a value that needs more is an error, not rounded."""
    exact = _c(x).cast("decimal(7,4)")
    return F.when(exact == _c(x), exact.cast("string")).otherwise(F.raise_error(F.lit("a percentage has more than four decimals")).cast("string"))


def last4(x: Column | str) -> Column:
    digits = digits_only(x)
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise("")


def iso_seconds(x: Column | str) -> Column:
    """UTC time to the second, as ISO 8601 text; the session's zone is UTC."""
    return F.date_format(F.date_trunc("second", _c(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
