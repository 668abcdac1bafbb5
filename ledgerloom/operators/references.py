"""References to records that do not exist (problem 7).

References have composite keys whose columns may be partly null. They are grouped by null mask and
each mask is anti-joined on its own non-null columns, by the declared match semantics:

- ``simple``: a null in any column -> no reference, never an orphan;
- ``full``: all null -> no reference; partly null -> always an orphan; else anti-join;
- ``partial``: all null -> no reference; else some target must agree on the non-null columns.

Targets hold for a span of periods [from_period, to_period). They are reduced to the distinct spans
of each key before the join, so a key held by many target rows stays small; hot referring keys are
rows of the streamed side, which adaptive execution splits. Tenant columns (``scope``) are always
compared and a null there never matches. Empty tables, repeated rows and extra columns are allowed;
every referring row counts once per row given.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphan_references(refs: DataFrame, targets: DataFrame, keys: dict[str, str], scope: dict[str, str] | None = None, match: str = "simple", period: str | None = None, valid: tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``refs`` without target. ``keys`` and ``scope``: referring column -> target column;
    ``period``: integer column of ``refs``; ``valid``: target columns of the half-open span it must lie in (null end: open)."""
    if match not in ("simple", "full", "partial"):
        raise ValueError(match)
    scope = scope or {}
    columns = list(keys)
    out: list[DataFrame] = []
    tagged = refs.withColumn("_mask", F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns]))
    for bits in product((False, True), repeat=len(columns)):
        if all(bits) or (match == "simple" and any(bits)):
            continue
        own = tagged.filter(F.col("_mask") == "".join(str(int(b)) for b in bits)).drop("_mask") if len(columns) > 1 else refs.filter(F.col(columns[0]).isNotNull())
        if match == "full" and any(bits):
            out.append(own)
            continue
        live = [c for c, b in zip(columns, bits) if not b]
        pairs = [(c, keys[c]) for c in live] + list(scope.items())
        held = targets.select(*[F.col(t).alias(f"_t{i}") for i, (_, t) in enumerate(pairs)], *([F.col(valid[0]).alias("_from"), F.col(valid[1]).alias("_to")] if valid else [])).distinct()
        on: list[Column] = [F.col(r) == F.col(f"_t{i}") for i, (r, _) in enumerate(pairs)]
        if valid:
            on += [F.col(period) >= F.col("_from"), F.col("_to").isNull() | (F.col(period) < F.col("_to"))]
        out.append(own.join(held, on, "left_anti"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def month_index(c: Column) -> Column:
    """Months since 1970-01 in UTC, whatever the session's zone: days since 1970 are taken from the instant."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(c) / 86_400_000_000).cast("int"))
    return (F.year(day) - 1970) * 12 + F.month(day) - 1


def month_text(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int") + 1970, (index % 12).cast("int") + 1)
