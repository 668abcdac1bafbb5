"""Formats of identifiers in texts, and rows of tables printed as plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The formats of Indian tax numbers and bank codes.
GSTIN = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b"
IFSC = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
#: A mail address: no blanks or brackets, one @, a domain that ends in letters.
EMAIL = r"([^\s@<>()\[\],;:]+@[^\s@<>()\[\],;:]+\.\p{L}{2,})"


def plain_rows(regions: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines that end in quantity, rate and total with quantity x rate near the total (1 % or 1)."""
    x = regions.select(doc, "id", F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))
    number = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    pattern = rf"^\s*(.*[A-Za-z].*?)\s+{number}\s+{number}\s+{number}\s*$"
    part = lambda i: F.regexp_replace(F.regexp_extract("line", pattern, i), ",", "").try_cast("double")
    x = x.filter(F.col("line").rlike(pattern)).select(doc, "id", "line_no", F.regexp_extract("line", pattern, 1).alias("description"), part(2).alias("quantity"), part(3).alias("rate"), part(4).alias("total"))
    return x.filter(F.abs(F.col("quantity") * F.col("rate") - F.col("total")) <= F.greatest(F.lit(1.0), F.col("total") * 0.01))
