"""Scalar text functions as column expressions; Arrow UDFs only where SQL has no equal."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix words of firms that a normalised vendor name leaves out.
SUFFIXES = "private limited pvt ltd llp llc inc corp corporation co company gmbh"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_vendor(c: Column) -> Column:
    """Lower case, without firm suffixes and punctuation."""
    s = F.regexp_replace(F.lower(squeeze(c)), rf"\b(?:{SUFFIXES.replace(' ', '|')})\b\.?", " ")
    return squeeze(F.regexp_replace(s, r"[^a-z0-9 ]", " "))


def normalize_description(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9]", " "))


# Labels before tax numbers.
TAX_LABELS = r"GSTIN|GST\s*NO|GST-NO|GST|VAT|TAX\s*ID"


def normalize_tax_id(c: Column) -> Column:
    s = F.regexp_replace(F.upper(c), rf"^\s*(?:{TAX_LABELS})\s*[:.#-]*\s*", "")
    return F.nullif(F.regexp_replace(s, r"[\s.-]", ""), F.lit(""))


def bank_digits(c: Column) -> Column:
    """The digits of an account number, null below nine of them."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) >= 9, d)


def normalize_amount(c: Column) -> Column:
    """A printed amount as decimal(18,2): lakh and crore, European and Indian grouping, signs and trailing marks."""
    s = F.lower(F.regexp_replace(c, r"(?i)rs\.?|inr|usd|eur|gbp|[₹$€£]|/-", " "))
    scale = F.when(s.rlike(r"\blakhs?\b|\blacs?\b"), 100000).when(s.rlike(r"\bcrores?\b|\bcr\b"), 10000000).otherwise(1)
    number = F.regexp_extract(s, r"(-?\d[\d.,]*)", 1)
    number = F.regexp_replace(number, r"[.,]+$", "")
    comma, dot = F.length(F.substring_index(number, ",", -1)), F.length(F.substring_index(number, ".", -1))
    european = number.contains(",") & ((number.contains(".") & (comma < dot)) | (~number.contains(".") & number.rlike(r"^-?\d+,\d{1,2}$")))
    plain = F.when(european, F.translate(F.regexp_replace(number, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(number, ",", ""))
    return F.bround(plain.try_cast("decimal(24,6)") * scale, 2).cast("decimal(18,2)")


def clean_ocr(c: Column) -> Column:
    """Recognition output without detection blocks, tags and coordinates; lines without trailing blanks."""
    s = F.regexp_replace(c, r"(?s)<\|det\|>.*?<\|/det\|>", "")
    s = F.regexp_replace(s, r"\[\[\s*\d+(?:\s*,\s*\d+){3}\s*\]\]", "")
    s = F.regexp_replace(s, r"<\|/?(?:ref|det)\|>", "")
    return F.regexp_replace(s, r"(?m)[ \t]+$", "")


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def token_set_similarity(a: Column, b: Column) -> Column:
    """Shared words: 0.7 + 0.3 x share of the larger set if one holds the other (fixed values), else Jaccard."""
    x, y = words(a), words(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    least, most = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    return F.when(both == 0, 0.0).when(both == least, 0.7 + 0.3 * both / most).otherwise(both / either)


def token_sort_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the words in sorted order."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        key = lambda s: " ".join(sorted((s or "").lower().split()))
        return pd.Series([SequenceMatcher(None, key(p), key(q)).ratio() if key(p) and key(q) else 0.0 for p, q in zip(x, y)])

    return F.pandas_udf(ratio, "double")(a, b)


def sequence_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the texts as they are; 0 where one is null."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if p is not None and q is not None else 0.0 for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def gstin_status(c: Column) -> Column:
    """ok, format, state or checksum: the first check of a 15-character tax number that fails; null for null."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    s = normalize_tax_id(c)
    value = lambda i: F.instr(F.lit(alphabet), F.substr(s, i, F.lit(1))) - 1
    terms = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: value(i) * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(terms, F.lit(0), lambda acc, p: acc + F.floor(p / 36).cast("int") + p % 36)
    check = F.substr(F.lit(alphabet), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))
    state = F.substring(s, 1, 2).try_cast("int")
    return (
        F.when(s.isNull(), None)
        .when(~s.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"), "format")
        .when(~(state.between(1, 38) | state.isin(97, 99)), "state")
        .when(F.substring(s, 15, 1) != check, "checksum")
        .otherwise("ok")
    )
