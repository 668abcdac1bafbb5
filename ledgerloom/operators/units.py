"""Quantities, prices and moneys in different units -> base units and INR (problem 6).

A record's unit is read from its unit text or, where that is blank or names only a package, from
its description. Each source (organisation and product) then has a history of log unit prices; an
exact penalised changepoint search (PELT, normal cost) over its daily sums splits it into levels.
A level that stands off the source's main level by a known conversion factor marks a change of unit
nobody stated: ``history_factor`` is what quantities there have to be multiplied by. Records of such a level
are converted by it besides their stated unit (``reversed``), and records without any stated unit take it as
their conversion (``basis`` = history).

Defined results: null quantity or price -> null in base units; a unit that is no measure (lot, job)
and has no telling description -> ``basis`` none unless the history tells it; rows without a source
key have no history. Days are the grain of the search, so a source's history is bounded by its days
however many records it has. Repeated rows are kept; other input columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import fence, spread, stage

# Spellings of each unit code, without dots and in lower case.
SPELLINGS = {
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes",
    "g": "g gm gms gr gram grams gramme grammes",
    "t": "t mt tonne tonnes ton tons metric_ton metric_tons",
    "lb": "lb lbs pound pounds",
    "oz": "oz ounce ounces",
    "quintal": "quintal quintals qtl qtls",
    "m": "m mtr mtrs meter meters metre metres rmt",
    "cm": "cm cms centimetre centimetres centimeter centimeters",
    "mm": "mm mms millimetre millimetres millimeter millimeters",
    "ft": "ft foot feet",
    "in": "in inch inches",
    "yd": "yd yds yard yards",
    "km": "km kms kilometre kilometres kilometer kilometers",
    "l": "l lt ltr ltrs litre litres liter liters",
    "ml": "ml mls millilitre millilitres milliliter milliliters",
    "m3": "m3 m³ cum cu_m cbm kl kilolitre kilolitres cubic_metre cubic_metres",
    "gal": "gal gals gallon gallons us_gal us_gallon us_gallons",
    "cl": "cl centilitre centilitres centiliter centiliters",
    "pcs": "pcs pc piece pieces ea each no nos number numbers unit units",
    "doz": "doz dz dozen dozens",
    "gross": "gross grs gro",
    "pair": "pair pairs pr prs",
    "thousand": "thousand thousands '000 '000_nos '000_pcs 1000 1000_pcs 1000_nos k k_pcs k_nos",
    "h": "h hr hrs hour hours",
    "min": "min mins minute minutes",
}
PACKAGES = "bag|box|pack|carton|drum|case|packet|can|roll|crate|sack|lot|set|job|bundle"
# Currency spellings in lower case without surrounding spaces and dots.
CURRENCIES = {
    "INR": "inr ₹ rs rupee rupees", "USD": "usd $ us$ u.s.dollars us_dollars u.s._dollars dollars dollar", "EUR": "eur € euro euros",
    "GBP": "gbp £ pound_sterling pounds_sterling sterling", "AED": "aed dhs dh dirham dirhams", "JPY": "jpy ¥ yen",
}


def _lookup(spellings: dict[str, str]) -> Column:
    pairs = [(s, code) for code, words in spellings.items() for s in words.split()]
    quote = lambda x: "'" + x.replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in pairs) + ")")


def _tidy(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"[.]", ""), r"^[\s ]+|[\s ]+$", ""), r"[\s ]+", "_")


def unit_of(c: Column) -> Column:
    """The unit code a spelling stands for, null if none."""
    return F.try_element_at(_lookup(SPELLINGS), _tidy(c))


def with_unit(df: DataFrame, unit: str = "unit", description: str = "description") -> DataFrame:
    """Adds ``unit_code``, ``pack_size`` (units of that code in one of what is counted) and ``basis``."""
    u = F.lower(F.regexp_replace(F.coalesce(F.col(unit), F.lit("")), r"[\s ]+", " "))
    d = F.lower(F.regexp_replace(F.coalesce(F.col(description), F.lit("")), r"[\s ]+", " "))
    number = r"(\d+(?:\.\d+)?)"
    named = rf"^\s*(?:{PACKAGES})s?\s+of\s+(?:{number}\s*x\s*)?{number}\s*(\p{{L}}[\p{{L}} .]*)$"
    counted = rf"^\s*(?:{number}\s*x\s*)?{number}\s*(\p{{L}}+)\.?\s+(?:{PACKAGES})s?\s*$"
    in_text = [
        rf",\s*{number}\s*x\s*{number}\s*(\p{{L}}+)\.?\s+(?:{PACKAGES})s?\s*$",
        rf",\s*()?{number}\s*(\p{{L}}+)\.?\s+(?:{PACKAGES})s?\s*$",
        rf"\(\s*{number}\s*x\s*{number}\s*(\p{{L}}+)\.?\s*\)\s*$",
        rf"\b(?:{PACKAGES})\s+{number}\s*x\s*{number}\s*(\p{{L}}+)\.?\s*$",
        rf"\b(?:{PACKAGES})\s+of\s+(?:{number}\s*x\s*)?{number}\s*(\p{{L}}+)\.?\s*$",
    ]
    told = r"(?:\buom\s*:?\s*|\bqty in\s+|\bsold by the\s+|\(in\s+|\bsold in\s+|\bper\s+)(\p{L}[\p{L}.³]*\d?)\s*[\])]?\s*$"

    def packed(text: Column, pattern: str) -> Column:
        """The pattern's unit word and the product of its counts."""
        size = F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(1.0)) * F.regexp_extract(text, pattern, 2).try_cast("double")
        return F.struct(F.regexp_extract(text, pattern, 3).alias("word"), size.alias("size"))

    def plain(word: Column) -> Column:
        return F.struct(word.alias("word"), F.lit(1.0).alias("size"))

    silent = F.trim(u).rlike(rf"^(?:(?:{PACKAGES})s?\.?)?$")
    own = F.array(plain(u), packed(u, named), packed(u, counted))
    described = F.array(plain(F.regexp_extract(d, told, 1)), *[packed(d, p) for p in in_text])
    # the table of spellings stands once in the plan: the readings go through it one by one
    read = F.transform(F.when(silent, described).otherwise(own), lambda r: F.struct(unit_of(r.word).alias("code"), r.size.alias("size")))
    found = F.get(F.filter(read, lambda r: r.code.isNotNull() & (r.size > 0)), F.lit(0))
    kept = df.columns
    df = fence(df.withColumn("_unit", found).withColumn("_silent", silent), *[c for c in kept if c not in ("_unit", "_silent")], "_unit", "_silent")
    df = df.withColumn("basis", F.when(F.col("_unit").isNull(), "none").when(F.col("_silent"), "description").otherwise("unit"))
    return df.withColumn("unit_code", F.col("_unit.code")).withColumn("pack_size", F.col("_unit.size")).drop("_unit", "_silent")


def money_of(c: Column) -> tuple[Column, Column]:
    """(ISO code, scale) of a currency text, e.g. "INR '000" -> INR, 1000."""
    text = F.regexp_replace(F.lower(F.trim(F.translate(c, " \t\r\n", "    "))), r"\s+", " ")
    scale = (
        F.when(text.rlike(r"'?000s?\b|thousand|\(k\)$"), 1e3).when(text.rlike(r"\bla(?:kh|c)s?\b"), 1e5).when(text.rlike(r"\bcrores?\b|\bcr\b"), 1e7).when(text.rlike(r"million|\bmn\b"), 1e6).otherwise(1.0)
    )
    bare = F.regexp_replace(text, r"\(?\b(?:in )?(?:thousands?|la(?:kh|c)s?|crores?|cr|millions?|mn)\b\)?|\(?'?000s?\)?|\bin\b", " ")
    key = F.regexp_replace(F.regexp_replace(bare, r"^[\s.,()-]+|[\s.,()-]+$", ""), r"\s+", "_")
    return F.try_element_at(_lookup(CURRENCIES), key), F.when(c.isNotNull(), scale)


def changepoints(count: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of the exact penalised least-squares segmentation (PELT)."""
    n = len(count)
    c, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (count, total, squares))
    best, last, alive = np.zeros(n + 1), np.zeros(n + 1, dtype=int), np.array([0])
    best[0] = -penalty
    for t in range(1, n + 1):
        m = c[t] - c[alive]
        value = best[alive] + (q[t] - q[alive] - (s[t] - s[alive]) ** 2 / np.maximum(m, 1e-12))
        k = int(np.argmin(value))
        best[t], last[t] = value[k] + penalty, alive[k]
        alive = np.append(alive[value <= best[t]], t)
    starts, t = [], n
    while t > 0:
        t = int(last[t])
        starts.append(t)
    return starts[::-1]


def by_group(df: DataFrame, keys: list[str], order: list[str], each: Callable[[tuple, pd.DataFrame], list[tuple]], schema: str, least: int = 1) -> DataFrame:
    """``each`` over every group of ``least`` rows or more, in key order within hash partitions. Far cheaper
    than a pandas call per group where groups are many and small; a group must fit in memory. The number of
    partitions is fixed, as the work of Python is not told by the bytes that adaptive execution merges by."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of the group that is not yet complete

        def close() -> pd.DataFrame:
            whole = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held.clear()
            return pd.DataFrame(each(tuple(whole[k].iat[0] for k in keys), whole) if len(whole) >= least else [], columns=names)

        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), dtype=bool)
            new[0] = bool(held) and any(held[-1][k].iat[-1] != pdf[k].iat[0] for k in keys)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            if len(starts) == 0:
                held.append(pdf)
                continue
            if held or starts[0] > 0:
                if starts[0] > 0:
                    held.append(pdf.iloc[: starts[0]])
                yield close()
            out = [r for a, b in zip(starts, starts[1:]) if b - a >= least for r in each(tuple(pdf[k].iat[a] for k in keys), pdf.iloc[a:b])]
            held.append(pdf.iloc[starts[-1] :])
            yield pd.DataFrame(out, columns=names)
        if held:
            yield close()

    # by a hash of the keys: a partitioning by the keys themselves is left out where a join before has the same, and adaptive
    # execution may then make that a broadcast join, which keeps no partitioning
    return spread(df, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def history_levels(records: DataFrame, source: list[str], factors: DataFrame, sigma: float = 0.05, tolerance: float = 0.02) -> DataFrame:
    """``records``: source columns, ``stated`` boolean, ``dimension``, ``day`` (days since 1970), ``level`` (log price) ->
    source columns, stated, first_day, last_day, log_shift, history_factor, dimension.

    The known factors are those of ``factors`` (unit_ref: a few rows, fixed whatever the data)."""
    ref = [(r.dimension, math.log(r.factor)) for r in factors.select("dimension", "factor").distinct().collect()]
    scales = [0.0, math.log(1e3), math.log(1e5), math.log(1e7)]
    known = {d: sorted({round(f, 9) for x, f in ref if x == d} | set(scales)) for d, _ in ref}

    def each(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        out, main = [], None
        for stated in (True, False):
            part = pdf[pdf.stated == stated]
            if not len(part):
                continue
            n, s, q = (part[c].to_numpy(float) for c in ("n", "total", "squares"))
            starts = changepoints(n, s, q, 2 * sigma**2 * math.log(max(n.sum(), 2)) * 4)
            ends = [*starts[1:], len(part)]
            days = part.day.to_numpy()
            levels = [(s[a:b].sum() / n[a:b].sum(), n[a:b].sum(), int(days[a]), int(days[b - 1])) for a, b in zip(starts, ends)]
            if stated:
                main, dimension = max(levels, key=lambda x: (x[1], -x[2]))[0], part.dimension.iloc[0]
            for level, _, first, last in levels:
                shift, factor, kind = None, None, None
                if main is not None:
                    # prices a hundred times too high mean quantities counted in units a hundred times larger
                    shift, kind = level - main, dimension
                    near = min((f for x in known.get(dimension, scales) for f in ((x, -x) if stated else (x,))), key=lambda f: abs(shift - f), default=None)
                    if near is not None and abs(shift - near) <= tolerance and (not stated or abs(near) > 3 * tolerance):
                        factor = math.exp(near)
                out.append((*key, stated, first, last, shift, factor, kind))
        return out

    daily = records.groupBy(*source, "stated", "day").agg(F.count("level").alias("n"), F.sum("level").alias("total"), F.sum(F.col("level") * F.col("level")).alias("squares"), F.min("dimension").alias("dimension"))
    columns = ", ".join(f"{c} string" for c in source)
    return by_group(daily.filter("n > 0"), source, ["stated", "day"], each, f"{columns}, stated boolean, first_day int, last_day int, log_shift double, history_factor double, dimension string")


def normalise_units(lines: DataFrame, unit_ref: DataFrame, source: list[str], day: str, quantity: str = "quantity", price_inr: str = "price_inr") -> DataFrame:
    """Adds unit_code, pack_size, basis, dimension, factor, quantity_base, price_base (INR per base unit),
    log_shift, history_factor and reversed to ``lines``. ``price_inr`` is the money of one counted unit in INR."""
    ref = F.broadcast(unit_ref.select("unit_code", F.col("dimension"), F.col("factor").alias("_factor")))  # 25 fixed rows
    x = with_unit(lines).join(ref, "unit_code", "left").withColumn("factor", F.col("_factor") * F.col("pack_size")).drop("_factor")
    x = x.withColumn("basis", F.when(F.col("factor").isNull(), "none").otherwise(F.col("basis"))).withColumn("stated", F.col("basis") != "none")
    x = x.withColumn("_day", F.unix_date(F.col(day).cast("date")))
    price = F.col(price_inr).cast("double") / F.coalesce("factor", F.lit(1.0))
    x = stage(x)  # read by the history and by what follows, twice there
    records = x.filter((F.col(price_inr) > 0) & F.col("_day").isNotNull()).filter(" and ".join(f"{c} is not null" for c in source)).select(*source, "stated", "dimension", F.col("_day").alias("day"), F.log(price).alias("level"))
    levels = stage(history_levels(records, source, unit_ref))
    told = levels.filter("history_factor is not null").select(*[F.col(c).alias(f"_{c}") for c in source], F.col("stated").alias("_stated"), "first_day", "last_day", "log_shift", "history_factor", F.col("dimension").alias("_dimension"))
    on = [F.col(c) == F.col(f"_{c}") for c in source] + [F.col("stated") == F.col("_stated"), F.col("_day").between(F.col("first_day"), F.col("last_day"))]
    x = x.join(told, on, "left").drop(*[f"_{c}" for c in source], "_stated", "first_day", "last_day")
    x = x.withColumn("basis", F.when(~F.col("stated") & F.col("history_factor").isNotNull(), "history").otherwise(F.col("basis")))
    x = x.withColumn("reversed", F.col("stated") & F.col("history_factor").isNotNull())
    x = x.withColumn("dimension", F.coalesce("dimension", F.when(F.col("basis") == "history", F.col("_dimension"))))
    x = x.withColumn("factor", F.when(F.col("basis") == "history", F.col("history_factor")).when(F.col("reversed"), F.col("factor") * F.col("history_factor")).otherwise(F.col("factor")))
    return x.withColumn("quantity_base", F.col(quantity).cast("double") * F.col("factor")).withColumn("price_base", F.col(price_inr).cast("double") / F.col("factor")).drop("_day", "_dimension", "stated")
