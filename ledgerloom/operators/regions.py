"""Layout regions of scanned pages: order, duplicates, neighbours, tables, page text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.geometry import centre_distance, containment, iou
from ledgerloom.functions.text import sequence_similarity
from ledgerloom.operators.units import by_group

PAGE = ["doc_id", "page_number"]


def reading_order(regions: DataFrame) -> DataFrame:
    """Places 1..n on each page: the given order where it is unique and positive, else rows of 40 pixels, then left to right."""
    usable = regions.groupBy(*PAGE).agg(((F.countDistinct("reading_order") == F.count("*")) & (F.min("reading_order") >= 1)).alias("usable"))
    x = regions.join(usable, PAGE)
    key = F.when(F.col("usable"), F.struct(F.col("reading_order").alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.floor(F.col("bbox.y1") / 40).cast("int").alias("a"), F.col("bbox.x1").alias("b")))
    w = Window.partitionBy(*PAGE).orderBy(key, "id")
    return x.select(*PAGE, "id", F.row_number().over(w).alias("place"))


def near_duplicates(regions: DataFrame, least_iou: float = 0.65, least_containment: float = 0.7, near: float = 40.0, least_table_iou: float = 0.85, least_likeness: float = 0.9) -> DataFrame:
    """Pairs on one page with equal or like text near each other, or one text inside the other in overlapping
    boxes; where one is a table, only equal texts in almost the same box.

    The pairs are joined on page and cell of a grid as wide as the search distance, so a page of many
    regions is not paired with itself; the less confident of a pair (then the later, of tables always the
    later) is suppressed. Likeness is computed only for near pairs that no other rule names and whose lengths allow it."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw_ocr_output"), r"[^a-z0-9\s]", ""), r"\s+", " "))
    x = regions.filter("bbox is not null").withColumn("t", text).filter("t <> ''").select(*PAGE, "id", "bbox", "confidence", "t", F.coalesce(F.col("region_type") == "table", F.lit(False)).alias("tabular"))
    cell = lambda a, b: F.sequence(F.floor(a / 200), F.floor(b / 200))
    c = x.withColumn("cx", F.explode(cell(F.col("bbox.x1") - near, F.greatest(F.col("bbox.x2"), F.col("bbox.x1")) + near))).withColumn("cy", F.explode(cell(F.col("bbox.y1") - near, F.greatest(F.col("bbox.y2"), F.col("bbox.y1")) + near)))
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*PAGE, "cx", "cy")] + [F.col("a.id") < F.col("b.id")])
    same, inside = F.col("a.t") == F.col("b.t"), F.col("a.t").contains(F.col("b.t")) | F.col("b.t").contains(F.col("a.t"))
    A, B = F.col("a.bbox"), F.col("b.bbox")
    tables = F.col("a.tabular") | F.col("b.tabular")
    rule = F.when(tables, F.when(same & (iou(A, B) >= least_table_iou), "table_exact_duplicate_high_iou")).when(same & ((centre_distance(A, B) <= near) | (iou(A, B) >= least_iou)), "exact_duplicate_with_spatial_proximity").when(inside & (containment(A, B) >= least_containment), "overlapping_substring")
    la, lb = F.length("a.t"), F.length("b.t")
    close = (containment(A, B) >= least_containment) | (iou(A, B) >= least_iou) | (centre_distance(A, B) <= near)
    open_ = ~tables & close & (2.0 * F.least(la, lb) >= least_likeness * (la + lb))
    kept_first = tables | (F.coalesce(F.col("a.confidence"), F.lit(0.0)) >= F.coalesce(F.col("b.confidence"), F.lit(0.0)))
    met = pairs.select(F.col("a.doc_id").alias("doc_id"), F.when(kept_first, F.col("b.id")).otherwise(F.col("a.id")).alias("suppressed"), F.when(kept_first, F.col("a.id")).otherwise(F.col("b.id")).alias("kept"), rule.alias("rule"), *[F.when(rule.isNull() & open_, F.col(f"{k}.t")).alias(f"{k}_t") for k in "ab"])
    met = met.filter("rule is not null or a_t is not null").distinct()
    like = F.when(sequence_similarity(F.col("a_t"), F.col("b_t")) >= least_likeness, "fuzzy_text_overlap")
    return met.select("doc_id", "suppressed", "kept", F.coalesce("rule", like).alias("rule")).filter("rule is not null")


def suppressed(pairs: DataFrame) -> DataFrame:
    """doc_id, id: the regions that go. A region that goes itself suppresses no other, so a chain of near duplicates
    loses every second one; pairs run from surer to less sure regions, so there are no rings."""

    def each(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        over: dict[str, list[str]] = {}
        for kept, gone in zip(pdf.kept, pdf.suppressed):
            over.setdefault(gone, []).append(kept)
        gone: dict[str, bool] = {}
        for start in sorted(over):
            stack = [start]
            while stack:
                i = stack[-1]
                open_ = [k for k in over.get(i, ()) if k not in gone]
                if open_:
                    stack += open_
                else:
                    gone[i] = any(not gone[k] for k in over.get(i, ()))
                    stack.pop()
        return [(key[0], i) for i in sorted(over) if gone[i]]

    return by_group(pairs.select("doc_id", "kept", "suppressed").distinct(), ["doc_id"], ["kept"], each, "doc_id string, id string")


def table_rows(regions: DataFrame) -> DataFrame:
    """Cells of pipe tables below their heading: doc_id, id, line_no, cells."""
    x = regions.filter(F.col("raw_ocr_output").contains("|")).select("doc_id", "id", F.posexplode(F.split("raw_ocr_output", "\r?\n")).alias("line_no", "line"))
    x = x.filter(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    heading = F.lower("line").rlike("description|qty|quantity|rate|amount")
    return x.filter(~heading).select("doc_id", "id", "line_no", F.size(cells).alias("cells"), F.get(cells, F.lit(0)).alias("description"), F.get(cells, F.lit(1)).try_cast("double").alias("quantity"), F.get(cells, F.lit(2)).try_cast("double").alias("rate"))


def page_texts(regions: DataFrame) -> DataFrame:
    """Length and region count of each page's text, its regions joined in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "id", F.trim("raw_ocr_output").alias("t"))))
    x = regions.filter("raw_ocr_output is not null").groupBy(*PAGE).agg(ordered.alias("r"))
    return x.select(*PAGE, F.size("r").alias("regions"), F.md5(F.array_join(F.transform("r", lambda y: y.t), "\n\n")).alias("text_md5"))


def page_summary(regions: DataFrame) -> DataFrame:
    """Regions of each page by outcome, their mean confidence and the span of their arrival in seconds."""
    state = lambda v: F.count_if(F.col("processing_status") == v).alias(v.lower())
    seconds = (F.unix_micros(F.max("ingested_at")) - F.unix_micros(F.min("ingested_at"))) / 1_000_000
    return regions.groupBy(*PAGE).agg(F.count("*").alias("regions"), state("COMPLETED"), state("FAILED"), state("SKIPPED"), F.round(F.avg("confidence"), 6).alias("confidence"), seconds.alias("seconds"))


def merge_rows(regions: DataFrame, least: float = 12.0, share: float = 0.6) -> DataFrame:
    """Visual rows: regions of a page from top to bottom; one joins the running row if its top lies within
    ``least``, or within ``share`` of the lower height, of the row's. Depends on the order, so pages are walked one by one."""

    def each(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        out, row, top, height = [], 0, None, 0
        for i, y, h in sorted(zip(pdf.id, pdf.y1, pdf.h), key=lambda r: (r[1], r[0])):
            if top is None or y - top > max(least, share * min(h, height)):
                row, top, height = row + 1, y, h
            out.append((key[0], int(key[1]), i, row))
        return out

    x = regions.filter("bbox is not null and page_number is not null").select(*PAGE, "id", F.col("bbox.y1").alias("y1"), (F.col("bbox.y2") - F.col("bbox.y1")).alias("h"))
    return by_group(x, PAGE, ["y1"], each, "doc_id string, page_number int, id string, row int")
