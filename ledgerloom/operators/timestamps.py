"""Mixed timestamp notations -> one UTC instant (problem 1).

``normalise_timestamps`` reads printed dates and times with JVM string functions only. Every
value yields the set of notations under which it is a possible date; per source an
expectation-maximisation run over the histogram of those sets gives each notation its weight, and
the posterior chooses the reading or marks the value ambiguous. A declared day-month order of the
source gives the contrary notations weight zero; where none is declared the mixture decides.

Defined results: null, blank and other text -> ``unparsed``; a date that is on no calendar ->
``impossible``; a local time skipped by the clock -> ``nonexistent``; one that happened twice ->
``repeated``; two readings left with neither over the threshold -> ``ambiguous``. ``utc_second`` is
null for all of these. Years outside 1970..2100 are impossible. Input columns other than the named
ones are not carried; names cannot clash. Repeated input rows give repeated output rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import fence

# Month names as printed by the feeds (English, German, French, Spanish).
MONTHS = [
    "january jan januar janvier janv enero ene",
    "february feb februar février fevrier févr febrero",
    "march mar märz maerz mrz mars marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juni juin junio",
    "july jul juli juillet juil julio",
    "august aug août aout agosto ago",
    "september sep sept septembre septiembre",
    "october oct oktober okt octobre octubre",
    "november nov novembre noviembre",
    "december dec dezember dez décembre decembre diciembre dic",
]
# UTC offsets in minutes a zone abbreviation may stand for, the commonest first.
ABBREVIATIONS = {
    "z": [0], "utc": [0], "gmt": [0], "wet": [0], "west": [60],
    "ist": [330, 60, 120], "npt": [345], "pkt": [300], "gst": [240], "sgt": [480], "hkt": [480], "jst": [540], "kst": [540],
    "cet": [60], "cest": [120], "eet": [120], "eest": [180], "msk": [180], "bst": [60, 360],
    "est": [-300, 600], "edt": [-240, 660], "cst": [-360, 480, 570], "cdt": [-300], "mst": [-420], "mdt": [-360], "pst": [-480, 480], "pdt": [-420],
    "aest": [600], "aedt": [660], "acst": [570], "acdt": [630], "awst": [480], "nzst": [720], "nzdt": [780],
}
FORMATS = ["iso", "week", "compact", "epoch_s", "epoch_ms", "epoch_us", "named", "dmy", "mdy"]

_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)\p{L}*\.?,?\s+)?"
_LABEL = r"(?i)^(?:(?:invoice|due|issue|payment)\s+)?(?:on|dt|dated?)\b\s*[.:]?\s*"
#: Each rewrites a value of its notation to tag|year|month|day|rest; tagged text matches no later one.
_REWRITES = [
    (rf"(?iu)^{_WEEKDAY}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?!\d)(.*)$", "#iso|$1|$2|$3|$4"),
    (r"(?i)^(\d{4})-?W(\d{2})-?(\d)(?!\d)(.*)$", "#week|$1|$2|$3|$4"),
    (r"(?i)^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?!\d)(.*)$", "#compact|$1|$2|$3|$4:$5:$6$7"),
    (r"(?i)^(\d{4})(\d{2})(\d{2})(?!\d)(.*)$", "#compact|$1|$2|$3|$4"),
    (r"^(\d{9,10})(?:\.\d+)?$", "#epoch_s|$1|||"),
    (r"^(\d{9,10})\d{3}$", "#epoch_ms|$1|||"),
    (r"^(\d{9,10})\d{6}$", "#epoch_us|$1|||"),
    (rf"(?iu)^{_WEEKDAY}(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?!\d)(.*)$", "#figures|$4|$1|$3|$5"),
    (rf"(?iu)^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|er|\.|º)?[\s.-]*(?:de\s+)?(\p{{L}}+)\.?[\s.,'-]*(?:de\s+)?(\d{{4}}|\d{{2}})(?!\d)(.*)$", "#named|$3|$2|$1|$4"),
    (rf"(?iu)^{_WEEKDAY}(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)(.*)$", "#named|$3|$1|$2|$4"),
]
_REST = (
    r"(?iu)^[\s,T]*(?:(?:at|à|um|a las)\s+)?(?:(\d{1,2})[:h](\d{2})(?:[:](\d{2})(?:[.,]\d+)?)?\s*(?:([ap])\.?m\.?(?!\p{L}))?\s*(?:(?:uhr|hrs|h)(?!\p{L}))?)?"
    r"\s*(?:[\[(]?((?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z_+-]+)+|[A-Za-z]{1,5})[\])]?)?$"
)


def _map(d: dict) -> Column:
    """A literal map, built in one call: a call per entry is slow."""
    return F.expr("map(" + ", ".join(f"'{k}', {v!r}" for k, v in d.items()) + ")")


def _zones(df: DataFrame) -> DataFrame:
    """The zones the JVM knows, some 600 rows whatever the data: lower-cased name and name."""
    spark = df.sparkSession
    names = [z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z]
    return F.broadcast(spark.createDataFrame([(z.lower(), z) for z in [*names, "UTC", "GMT"]], "zone_key string, zone_id string"))


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, null where the calendar has no such day or the year is out of range."""
    return F.when(y.between(1970, 2100), F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")))


def _int(c: Column) -> Column:
    return F.expr("try_cast(null as int)") if c is None else c.try_cast("int")


def parse(df: DataFrame, raw: str, zone: str) -> DataFrame:
    """Adds ``tag``, the time of day, the zone text and ``readings``: the possible (format, local day)."""
    odd = "|\t\r\n\u00a0\u202f\u2009\u2212\u2010\u2011\u2013\u2014"
    clean = F.regexp_replace(F.translate(F.col(raw), odd, "       -----"), r"^\s+|[\s.,;]+$", "")
    s = F.regexp_replace(clean, _LABEL, "")
    for pattern, to in _REWRITES:
        s = F.regexp_replace(s, pattern, to)
    kept = df.columns
    df = fence(df.withColumn("_p", F.split(s, r"\|", 5)), *kept, "_p")
    df = df.withColumn("_ok", F.col("_p")[0].startswith("#") & (F.size("_p") == 5))
    part = lambda i: F.when(F.col("_ok"), F.get("_p", F.lit(i)))
    df = df.withColumn("tag", F.substring(part(0), 2, 99)).withColumn("_r", F.split(F.regexp_replace(F.coalesce(part(4), F.lit("")), _REST, "@|$1|$2|$3|$4|$5"), r"\|"))
    rest = lambda i: F.nullif(F.get("_r", F.lit(i)), F.lit(""))
    hour, minute, second, half, ztext = _int(rest(1)), _int(rest(2)), _int(rest(3)), F.lower(rest(4)), rest(5)
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    timed = rest(1).isNotNull()
    ok_time = (F.get("_r", F.lit(0)) == "@") & (~timed | (hour.between(0, 23) & minute.between(0, 59) & F.coalesce(second, F.lit(0)).between(0, 59)))
    df = df.withColumn("_tod", F.when(F.coalesce(ok_time, F.lit(False)), F.when(timed, hour * 3600 + minute * 60 + F.coalesce(second, F.lit(0))).otherwise(0))).withColumn("_zt", ztext)
    month = _map({name: i + 1 for i, names in enumerate(MONTHS) for name in names.split()})
    a, b, c = part(1), part(2), part(3)
    year = F.when(F.length(a) == 2, _int(a) + 2000).otherwise(_int(a))
    thursday = lambda day: F.year(F.date_from_unix_date(day))
    jan4 = _day(year, F.lit(1), F.lit(4))
    monday = jan4 - F.weekday(F.date_from_unix_date(jan4))
    in_week = monday + (_int(b) - 1) * 7
    tag = F.col("tag")
    text8 = F.concat(a, b, c)
    eight = lambda i, n: _int(F.substring(text8, i, n))
    epoch_day = F.floor(a.try_cast("bigint") / 86400).cast("int")
    day = {
        "iso": F.when(tag == "iso", _day(year, _int(b), _int(c))),
        "week": F.when((tag == "week") & _int(c).between(1, 7) & _int(b).between(1, 53) & (thursday(in_week + 3) == year), in_week + _int(c) - 1),
        "compact": F.when(tag == "compact", _day(year, _int(b), _int(c))),
        **{f: F.when(tag == f, epoch_day) for f in ("epoch_s", "epoch_ms", "epoch_us")},
        "named": F.when(tag == "named", _day(year, F.try_element_at(month, F.lower(b)), _int(c))),
        "dmy": F.when(tag == "figures", _day(year, _int(c), _int(b))).when(tag == "compact", _day(eight(5, 4), eight(3, 2), eight(1, 2))),
        "mdy": F.when(tag == "figures", _day(year, _int(b), _int(c))).when(tag == "compact", _day(eight(5, 4), eight(1, 2), eight(3, 2))),
    }
    readings = F.filter(F.array(*[F.struct(F.lit(f).alias("format"), day[f].alias("day")) for f in FORMATS]), lambda x: x.day.isNotNull())
    df = df.withColumn("readings", readings).withColumn("_epoch", F.when(tag.startswith("epoch"), a.try_cast("bigint")))
    return fence(df, *kept, "tag", "_tod", "_zt", "readings", "_epoch")


def fit_formats(histogram: DataFrame, rounds: int = 50, threshold: float = 0.95) -> DataFrame:
    """EM per source. ``histogram``: source, declared, formats (comma-joined set), n. A source's
    histogram has at most one row per set of formats, whatever the number of its values."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        against = {"DMY": {"mdy"}, "MDY": {"dmy"}}.get(pdf.declared.iloc[0], set())
        # the declared order speaks of figures that do not lead with the year
        sets = [[f for f in s.split(",") if f not in against] for s in pdf.formats]
        used = sorted({f for s in sets for f in s})
        weight = dict.fromkeys(used, 1.0)
        for _ in range(rounds):
            new = dict.fromkeys(used, 1e-6)
            for s, n in zip(sets, pdf.n):
                total = sum(weight[f] for f in s)
                for f in s:
                    new[f] += n * weight[f] / total
            total = sum(new.values())
            weight = {f: x / total for f, x in new.items()}
        out = []
        for key, s in zip(pdf.formats, sets):
            best = max(s, key=lambda f: (weight[f], f), default=None)
            p = weight[best] / sum(weight[f] for f in s) if best else 0.0
            out.append((pdf.source.iloc[0], key, ",".join(s), best, float(p), bool(best) and p < threshold))
        return pd.DataFrame(out, columns=["source", "formats", "allowed", "format", "posterior", "unsure"])

    return histogram.groupBy("source").applyInPandas(fit, "source string, formats string, allowed string, format string, posterior double, unsure boolean")


def normalise_timestamps(values: DataFrame, profiles: DataFrame, id_col: str, raw: str, source: str, threshold: float = 0.95) -> DataFrame:
    """``values``(id, raw, source) and ``profiles``(source, zone_name, date_order) ->
    id, source, format, posterior, status, utc_second, local_date (in the source's zone)."""
    at = lambda month: F.timestamp_seconds(F.lit(1735689600 + month * 86400 * 30))
    shift = lambda month: ((F.unix_seconds(F.from_utc_timestamp(at(month), F.col("zone"))) - F.unix_seconds(at(month))) / 60).cast("int")
    zones = _zones(profiles)
    prof = profiles.select(F.col(source).alias("source"), F.lower("zone_name").alias("zone_key"), F.upper("date_order").alias("declared"))
    prof = prof.join(zones, "zone_key", "left").withColumnRenamed("zone_id", "zone").groupBy("source").agg(F.min("zone").alias("zone"), F.min("declared").alias("declared"))
    prof = prof.withColumn("_own", F.array(shift(0), shift(6)))
    rows = values.select(F.col(id_col).alias("id"), F.col(raw).alias("raw"), F.col(source).alias("source")).join(prof, "source", "left")
    rows = parse(rows, "raw", "zone").withColumn("formats", F.array_join(F.col("readings.format"), ","))
    chosen = fit_formats(rows.filter(F.col("formats") != "").groupBy(F.coalesce("source", F.lit("")).alias("source"), "declared", "formats").agg(F.count("*").alias("n")), threshold=threshold)
    rows = rows.withColumn("_s", F.coalesce("source", F.lit("")))
    rows = rows.join(chosen.withColumnRenamed("source", "_s"), ["_s", "formats"], "left")

    days = F.array_distinct(F.transform(F.filter("readings", lambda x: F.array_contains(F.split("allowed", ","), x.format)), lambda x: x.day))
    day = F.get(F.transform(F.filter("readings", lambda x: x.format == F.col("format")), lambda x: x.day), F.lit(0))
    rows = rows.withColumn("_local", F.when(F.col("_epoch").isNull(), day.cast("bigint") * 86400 + F.col("_tod"))).withColumn("_unsure", F.coalesce(F.col("unsure") & (F.size(days) > 1), F.lit(False)))

    z = F.lower("_zt")
    numeric = F.regexp_replace(z, "^(utc|gmt)(?=[+-])", "")
    digits = F.regexp_replace(numeric, "[^0-9]", "")
    hours = F.when(F.length(digits) <= 2, _int(digits)).when(F.length(digits) == 3, _int(F.substring(digits, 1, 1))).otherwise(_int(F.substring(digits, 1, 2)))
    minutes = F.when(F.length(digits) > 2, _int(F.substring(digits, -2, 2))).otherwise(0)
    signed = F.when(numeric.rlike(r"^[+-]\d") & hours.between(0, 15) & minutes.between(0, 59), F.when(numeric.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
    abbreviations = F.expr("map(" + ", ".join(f"'{k}', array({', '.join(map(str, v))})" for k, v in ABBREVIATIONS.items()) + ")")
    meant = F.try_element_at(abbreviations, z)
    offset = F.coalesce(signed, F.get(F.array_intersect(meant, "_own"), F.lit(0)), F.get(meant, F.lit(0)))
    rows = rows.withColumn("_offset", offset).withColumn("zone_key", F.when(z.contains("/"), z)).join(zones, "zone_key", "left")
    rows = rows.withColumn("_zone", F.coalesce("zone_id", F.when(F.col("_zt").isNull(), F.col("zone"))))
    local = F.timestamp_seconds("_local")
    safe = F.coalesce("_zone", F.lit("UTC"))
    utc = F.unix_seconds(F.to_utc_timestamp(local, safe))
    back = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), safe))
    rows = fence(rows.withColumn("_utc", utc), "id", "source", "zone", "tag", "_tod", "_epoch", "_unsure", "format", "posterior", "_local", "_offset", "_zone", "_utc")
    local, safe = F.timestamp_seconds("_local"), F.coalesce("_zone", F.lit("UTC"))
    u = F.col("_utc")
    gap, twice = back(u) != F.col("_local"), (back(u + 1800) == F.col("_local")) | (back(u + 3600) == F.col("_local")) | (back(u + 7200) == F.col("_local")) | (back(u - 3600) == F.col("_local"))
    fixed = F.col("_offset").isNotNull()
    status = (
        F.when(F.col("tag").isNull() | F.col("_tod").isNull(), "unparsed")
        .when(F.col("_epoch").isNotNull(), F.when(F.col("_epoch") < 4133980800, "resolved").otherwise("impossible"))
        .when(F.col("_unsure"), "ambiguous")
        .when(F.col("_local").isNull(), "impossible")
        .when(fixed, "resolved")
        .when(F.col("_zone").isNull(), "unparsed")
        .when(gap, "nonexistent")
        .when(twice, "repeated")
        .otherwise("resolved")
    )
    rows = fence(rows.withColumn("status", status), *rows.columns, "status")
    instant = F.when(F.col("status") == "resolved", F.coalesce("_epoch", F.when(fixed, F.col("_local") - F.col("_offset") * 60).otherwise(u)))
    rows = rows.withColumn("utc_second", instant)
    # to_date of a shifted instant in whole days, free of the session's zone
    here = F.date_from_unix_date(F.floor(F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds("utc_second"), F.coalesce("zone", F.lit("UTC")))) / 86400).cast("int"))
    return rows.select("id", "source", "format", "posterior", "status", "utc_second", here.alias("local_date"))
