"""One-to-one matching of lines and fuzzy vendor candidates."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import normalize_description, token_set_similarity, token_sort_similarity, words
from ledgerloom.operators.units import by_group


def match_lines(a: DataFrame, b: DataFrame, scope: list[str], code: str = "product_code", description: str = "description", least: float = 0.8) -> DataFrame:
    """scope, a_id, b_id, how: lines matched by code, then by equal description, then greedily by likeness.

    The first two passes number equal keys on both sides and join on the number; only what is left of a
    scope (one invoice and its order) is compared in Python."""

    def numbered(df: DataFrame, key: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy(*scope, key).orderBy("id")))

    def one_pass(x: DataFrame, y: DataFrame, key: str, how: str) -> DataFrame:
        left, right = numbered(x, key).withColumnRenamed("id", "a_id"), numbered(y, key).withColumnRenamed("id", "b_id")
        return left.select(*scope, key, "n", "a_id").join(right.select(*scope, key, "n", "b_id"), [*scope, key, "n"]).select(*scope, "a_id", "b_id", F.lit(how).alias("how"))

    x = a.select(*scope, "id", F.col(code).alias("code"), F.nullif(normalize_description(F.col(description)), F.lit("")).alias("text"))
    y = b.select(*scope, "id", F.col(code).alias("code"), F.nullif(normalize_description(F.col(description)), F.lit("")).alias("text"))
    by_code = one_pass(x, y, "code", "CODE")
    rest = lambda df, m, c: df.join(m.select(*scope, F.col(c).alias("id")), [*scope, "id"], "left_anti")
    x2, y2 = rest(x, by_code, "a_id"), rest(y, by_code, "b_id")
    by_text = one_pass(x2, y2, "text", "DESCRIPTION")
    x3, y3 = rest(x2, by_text, "a_id"), rest(y2, by_text, "b_id")
    left = x3.withColumn("side", F.lit("a")).unionByName(y3.withColumn("side", F.lit("b"))).filter("text is not null")

    def each(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        xs, ys = ([(i, t) for i, t, s in zip(pdf.id, pdf.text, pdf.side) if s == side] for side in "ab")
        scored = sorted(((-SequenceMatcher(None, t, u).ratio(), i, j) for i, t in xs for j, u in ys))
        used, out = set(), []
        for r, i, j in scored:
            if -r >= least and ("a", i) not in used and ("b", j) not in used:
                used |= {("a", i), ("b", j)}
                out.append((*key, i, j, "SIMILAR"))
        return out

    schema = ", ".join(f"{c} string" for c in scope) + ", a_id string, b_id string, how string"
    return by_code.unionByName(by_text).unionByName(by_group(left, scope, ["id"], each, schema, least=2))


def fuzzy_vendors(names: DataFrame, vendors: DataFrame, least: float = 0.88, aliases: DataFrame | None = None) -> DataFrame:
    """Best vendor for each name by the larger of token-set and token-sort likeness, within the organisation.

    A name is compared with the texts of every vendor, its normalised name and its ``aliases``, behind two
    complete filters; nothing is capped. Of two token sets that reach ``least`` one of the rarest words of one
    is in the other. Two sorted texts that reach it leave over at most ``(1 - least)`` of their letters; cut
    into more segments than that, one keeps at least one segment whole within the other, moved no further than
    the letters left over allow. Names and vendors are distinct texts first."""
    if not 0.8 <= least <= 1:
        raise ValueError("least must lie between 0.8 and 1")
    n = names.filter("name is not null").select("organization_id", "name").distinct()
    v = vendors.filter("normalized_name is not null").select("organization_id", F.col("normalized_name").alias("vname"), F.lit(0).alias("alias"), F.col("id").alias("vendor_id"))
    if aliases is not None:
        known = aliases.join(vendors.select("organization_id", F.col("id").alias("vendor_id")), ["organization_id", "vendor_id"], "left_semi")
        v = v.unionByName(known.filter("normalized_alias is not null").select("organization_id", F.col("normalized_alias").alias("vname"), F.lit(1).alias("alias"), "vendor_id"))
    v = v.groupBy("organization_id", "vname").agg(F.min(F.struct("alias", "vendor_id")).alias("held"))
    slack = 1 - least + 0.00005  # the score is rounded to four places
    pairs = _word_pairs(n, v, slack).unionByName(_letter_pairs(n, v, slack)).distinct()
    scored = pairs.withColumn("score", F.round(F.greatest(token_set_similarity(F.col("name"), F.col("vname")), token_sort_similarity(F.col("name"), F.col("vname"))), 4)).filter(F.col("score") >= least)
    w = Window.partitionBy("organization_id", "name").orderBy(F.desc("score"), "held.alias", "vname")
    return scored.join(v, ["organization_id", "vname"]).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("organization_id", "name", F.col("held.vendor_id").alias("vendor_id"), "score")


def _word_pairs(n: DataFrame, v: DataFrame, slack: float) -> DataFrame:
    """Pairs that can reach the token-set likeness: one of the ``slack * words + 1`` rarest words of either is in the other."""
    x = n.select("organization_id", "name", F.size(words(F.col("name"))).alias("n"), F.explode(words(F.col("name"))).alias("word"))
    y = v.select("organization_id", "vname", F.size(words(F.col("vname"))).alias("m"), F.explode(words(F.col("vname"))).alias("word"))
    often = x.select("organization_id", "word").unionByName(y.select("organization_id", "word")).groupBy("organization_id", "word").agg(F.count("*").alias("often"))

    def rarest(z: DataFrame, text: str, size: str) -> DataFrame:
        w = Window.partitionBy("organization_id", text).orderBy("often", "word")
        return z.join(often, ["organization_id", "word"]).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.floor(F.col(size) * slack) + 1).drop("rn", "often")

    # a subset reaches 0.7 + 0.3 x the ratio of the sizes, other sets at most that ratio
    ratio = F.least("n", "m") / F.greatest("n", "m")
    reach = 0.7 + 0.3 * ratio >= 1 - slack
    meet = lambda a, b: a.join(b, ["organization_id", "word"]).filter(reach).select("organization_id", "name", "vname")
    return meet(rarest(x, "name", "n"), y).unionByName(meet(x, rarest(y, "vname", "m")))


def _letter_pairs(n: DataFrame, v: DataFrame, slack: float) -> DataFrame:
    """Pairs that can reach the token-sort likeness. Matching letters keep their order, so at most
    ``slack`` x both lengths letters are left over; each spoils at most one segment."""
    text = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")), " ")
    share = 2 * slack / (1 - slack)  # letters left over for a letter of the vendor's text, with the longest partner
    longest = math.ceil(1 / share)  # letters of a segment
    x = n.select("organization_id", "name", text(F.col("name")).alias("s")).filter("s <> ''").withColumn("n", F.length("s"))
    y = v.select("organization_id", "vname", text(F.col("vname")).alias("t")).filter("t <> ''").withColumn("m", F.length("t")).withColumn("k", (F.floor(F.col("m") * share + 1e-6) + 1).cast("int"))
    cut = lambda i: F.floor(i * F.col("m") / F.col("k")).cast("int")
    part = lambda s, at, size: F.struct(F.substr(s, at + 1, size).alias("part"), at.alias("at"))
    y = y.select("organization_id", "vname", "t", "m", F.inline(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: part(F.col("t"), cut(i), cut(i + 1) - cut(i)))))
    grams = lambda g: F.when(F.col("n") >= g, F.transform(F.sequence(F.lit(0), F.col("n") - g), lambda i: part(F.col("s"), i, F.lit(g)))).otherwise(F.array().cast("array<struct<part:string,at:int>>"))
    x = x.select("organization_id", "name", "s", "n", F.inline(F.concat(*[grams(g) for g in range(1, longest + 1)]))).withColumnRenamed("at", "place")
    over = F.floor((F.col("n") + F.col("m")) * slack + 1e-6).cast("int")
    moved = F.col("place") - F.col("at")
    met = x.join(y, ["organization_id", "part"]).filter(F.abs(moved) + F.abs(F.col("n") - F.col("m") - moved) <= over)
    met = met.select("organization_id", "name", "vname", "s", "t", over.alias("over")).distinct()
    return met.filter(F.call_function("levenshtein", "s", "t", "over") >= 0).select("organization_id", "name", "vname")
