"""Queries of the general data-preparation problems (1, 6, 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.references import month_index, month_text, orphan_references
from ledgerloom.operators.timestamps import normalise_timestamps
from ledgerloom.operators.units import money_of, normalise_units
from ledgerloom.queries.unit_cases import unit_cases_sql
from ledgerloom.session import first_by_id, table


def _date_fields(spark: SparkSession, sf: str) -> DataFrame:
    return first_by_id(table(spark, sf, "extracted_field").filter(F.col("field_name").isin("invoice_date", "due_date")), "id", "document_id", "feed_id", "field_name", "raw_value")


def p1_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Every printed date with its reading, posterior and UTC second."""
    return normalise_timestamps(_date_fields(spark, sf), table(spark, sf, "feed_profile"), "id", "raw_value", "feed_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    fields = _date_fields(spark, sf)
    read = normalise_timestamps(fields, table(spark, sf, "feed_profile"), "id", "raw_value", "feed_id").filter("status = 'resolved'")
    invoices = first_by_id(table(spark, sf, "invoice").filter("document_id is not null"), "id", "document_id", "invoice_date", "due_date")
    stated = F.when(F.col("field_name") == "invoice_date", F.col("invoice_date")).otherwise(F.col("due_date"))
    return (
        fields.select("id", "document_id", "field_name")
        .join(read, "id")
        .join(invoices.drop("id"), "document_id")
        .filter(stated.isNull() | (stated != F.col("local_date")))
        .select(F.col("id").alias("field_id"), "utc_second")
        .distinct()
    )


def p1_orders(spark: SparkSession, sf: str) -> DataFrame:
    """What the mixture finds where no feed declares its day-month order: per feed and declared order, the values
    of figures read as day first and month first, those left open, and how many agree with the reading under the
    declared order."""
    fields, profiles = _date_fields(spark, sf), table(spark, sf, "feed_profile")
    told = normalise_timestamps(fields, profiles, "id", "raw_value", "feed_id").select("id", F.col("local_date").alias("told"))
    free = normalise_timestamps(fields, profiles.withColumn("date_order", F.lit(None).cast("string")), "id", "raw_value", "feed_id")
    x = free.filter("format in ('dmy', 'mdy')").join(told, "id").join(profiles.select(F.col("feed_id").alias("source"), "date_order"), "source", "left")
    return x.groupBy("source", "date_order").agg(
        F.count_if((F.col("format") == "dmy") & (F.col("status") != "ambiguous")).alias("day_first"), F.count_if((F.col("format") == "mdy") & (F.col("status") != "ambiguous")).alias("month_first"),
        F.count_if(F.col("status") == "ambiguous").alias("open"), F.count_if(F.col("local_date") == F.col("told")).alias("agree"), F.count_if(F.col("local_date") != F.col("told")).alias("differ"),
    )


def _month(c) -> Column:
    return F.date_format(c, "yyyy-MM")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice and order lines in one shape, with the money of a unit in INR at the month's rate."""
    rates = F.broadcast(table(spark, sf, "fx_rate").select("rate_month", F.col("currency").alias("iso"), F.col("inr_rate").cast("double").alias("rate")))  # 216 fixed rows
    invoices = first_by_id(table(spark, sf, "invoice"), "organization_id", "id", "po_number", "currency", "invoice_date").withColumnRenamed("id", "invoice_id")
    lines = first_by_id(table(spark, sf, "invoice_line"), "organization_id", "id", "invoice_id", "product_code", "description", "quantity", "unit", "unit_price")
    orders = first_by_id(table(spark, sf, "purchase_order"), "organization_id", "id", "po_number", "po_date", "currency", "line_items")
    orders = orders.select("organization_id", F.col("id").alias("po_id"), F.trim("po_number").alias("po_key"), "po_date", F.col("currency").alias("po_currency"), "line_items")
    named = orders.filter("po_key <> ''").select("organization_id", "po_key", "po_id", "po_date")
    bought = lines.join(invoices, ["organization_id", "invoice_id"], "left").withColumn("po_key", F.nullif(F.trim("po_number"), F.lit(""))).join(named, ["organization_id", "po_key"], "left")
    code, scale = money_of(F.col("currency"))
    bought = bought.select(
        "organization_id", F.col("id").alias("line_id"), "po_id", "product_code", "description", "unit", "quantity", "unit_price", code.alias("iso"), scale.alias("scale"),
        F.coalesce("po_date", "invoice_date").alias("day"), "po_date",
    )
    ordered = orders.select("organization_id", "po_id", "po_date", "po_currency", F.explode("line_items").alias("x")).select(
        "organization_id", F.lit(None).cast("string").alias("line_id"), "po_id", F.col("x.product_code").alias("product_code"), F.col("x.description").alias("description"), F.col("x.unit").alias("unit"),
        F.col("x.quantity").alias("quantity"), F.col("x.unit_price").alias("unit_price"), F.upper(F.trim("po_currency")).alias("iso"), F.lit(1.0).alias("scale"), F.col("po_date").alias("day"), "po_date",
    )
    both = bought.unionByName(ordered).withColumn("rate_month", _month(F.col("day"))).join(rates, ["rate_month", "iso"], "left")
    return both.withColumn("price_inr", F.col("unit_price").cast("double") * F.col("scale") * F.col("rate")).drop("rate_month")


def p6_units(spark: SparkSession, sf: str) -> DataFrame:
    """Every invoice and order line in base units and INR, with the unit the history tells where none is stated."""
    x = normalise_units(_lines(spark, sf), table(spark, sf, "unit_ref"), ["organization_id", "product_code"], "day")
    return x.select("organization_id", "line_id", "po_id", "product_code", "unit_code", "pack_size", "basis", "dimension", "factor", "quantity_base", "price_base", "log_shift", "history_factor", "reversed")


def p6_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines each basis converts, and how many the history reverses, per dimension."""
    x = p6_units(spark, sf).groupBy("basis", "dimension")
    return x.agg(F.count("*").alias("lines"), F.count_if("reversed").alias("reversed"), F.count_if(F.col("history_factor").isNotNull()).alias("told_by_history"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    x = normalise_units(_lines(spark, sf), table(spark, sf, "unit_ref"), ["organization_id", "product_code"], "day")
    x = x.filter("basis in ('unit', 'description') and po_id is not null and product_code is not null")
    ours = x.filter("line_id is not null").select("organization_id", "po_id", "product_code", "line_id", "dimension", "quantity_base", F.when(F.col("po_date").isNotNull(), F.col("price_base")).alias("price_base"))
    theirs = x.filter("line_id is null").select("organization_id", "po_id", "product_code", F.col("dimension").alias("o_dimension"), F.col("quantity_base").alias("o_quantity"), F.col("price_base").alias("o_price"))
    pairs = ours.join(theirs, ["organization_id", "po_id", "product_code"]).filter("dimension = o_dimension")
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > 0.01 * F.abs(F.col(b))
    measures = F.array_compact(F.array(F.when(off("quantity_base", "o_quantity"), "quantity"), F.when(off("price_base", "o_price"), "unit_price")))
    return pairs.select(F.col("line_id").alias("invoice_line_id"), F.explode(measures).alias("measure")).distinct()


def _lives(df: DataFrame, key: Column) -> DataFrame:
    """organization_id, key and the months [from_month, to_month) at whose end the record existed."""
    x = df.select("organization_id", "id", key.alias("key"), "ingested_at", "deleted_at").groupBy("organization_id", "id", "key")
    x = x.agg(F.min("ingested_at").alias("first_at"), F.max("deleted_at").alias("deleted_at"))
    return x.select("organization_id", "key", month_index(F.col("first_at")).alias("from_month"), month_index(F.col("deleted_at")).alias("to_month"))


def p7_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references with table, field, record and month."""
    invoice, link = table(spark, sf, "invoice"), table(spark, sf, "document_link")
    orders, files = table(spark, sf, "purchase_order"), table(spark, sf, "doc_registry")

    def refs(df: DataFrame, key: Column, *more: str) -> DataFrame:
        x = df.withColumn("key", F.when(F.trim(key) != "", key)).groupBy("organization_id", "id", "key", *more).agg(F.min("ingested_at").alias("first_at"))
        return x.withColumn("month", month_index(F.col("first_at")))

    def orphans(r: DataFrame, t: DataFrame, name: str, field: str) -> DataFrame:
        x = orphan_references(r, t, {"organization_id": "organization_id", "key": "key"}, None, "simple", "month", ("from_month", "to_month"))
        return x.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col("id").alias("record_id"), month_text(F.col("month")).alias("period"))

    linked = refs(link, F.col("target_id"), "target_type")
    sold = invoice.select("organization_id", "id", "ingested_at", "deleted_at")
    targets = _lives(orders, F.col("id")).withColumn("kind", F.lit("PURCHASE_ORDER")).unionByName(_lives(sold, F.col("id")).withColumn("kind", F.lit("INVOICE")))
    by_kind = orphan_references(linked, targets, {"organization_id": "organization_id", "target_type": "kind", "key": "key"}, None, "simple", "month", ("from_month", "to_month"))
    return (
        orphans(refs(invoice, F.trim("po_number")), _lives(orders, F.trim("po_number")), "invoice", "po_number")
        .unionByName(orphans(refs(invoice, F.col("document_id")), _lives(files, F.col("id")), "invoice", "document_id"))
        .unionByName(by_kind.select(F.lit("document_link").alias("ref_table"), F.lit("target_id").alias("ref_field"), F.col("id").alias("record_id"), month_text(F.col("month")).alias("period")))
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_orphans(spark, sf).distinct()


def p7_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices that name an order by vendor and number, either of which may be null: orphans by null mask under
    each match semantics."""
    refs = first_by_id(table(spark, sf, "invoice"), "organization_id", "id", "vendor_id", "po_number").withColumn("po_number", F.nullif(F.trim("po_number"), F.lit("")))
    orders = first_by_id(table(spark, sf, "purchase_order"), "organization_id", "vendor_id", "po_number").withColumn("po_number", F.trim("po_number"))
    keys = {"vendor_id": "vendor_id", "po_number": "po_number"}
    out = None
    for match in ("simple", "full", "partial"):
        x = orphan_references(refs, orders, keys, {"organization_id": "organization_id"}, match)
        x = x.select(F.lit(match).alias("semantics"), *[F.col(c).isNull().alias(f"no_{c}") for c in keys]).groupBy("semantics", *[f"no_{c}" for c in keys]).agg(F.count("*").alias("orphans"))
        out = x if out is None else out.unionByName(x)
    return out


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table, field and period."""
    return p7_orphans(spark, sf).groupBy("ref_table", "ref_field", "period").agg(F.countDistinct("record_id").alias("orphans"))


_P7 = """
WITH po AS (SELECT organization_id, id, trim(po_number) AS pkey, min(ingested_at) f, max(deleted_at) d FROM purchase_order GROUP BY 1, 2, 3),
reg AS (SELECT organization_id, id, min(ingested_at) f, max(deleted_at) d FROM doc_registry GROUP BY 1, 2),
inv AS (SELECT organization_id, id, po_number, document_id, min(ingested_at) f, max(deleted_at) d FROM invoice GROUP BY 1, 2, 3, 4),
lnk AS (SELECT organization_id, id, target_type, target_id, min(ingested_at) f FROM document_link GROUP BY 1, 2, 3, 4),
refs AS (
  SELECT 'invoice' AS ref_table, 'po_number' AS ref_field, id AS record_id, organization_id, trim(po_number) AS k, f FROM inv WHERE trim(po_number) <> ''
  UNION ALL SELECT 'invoice', 'document_id', id, organization_id, document_id, f FROM inv WHERE trim(document_id) <> ''
  UNION ALL SELECT 'document_link', 'target_id', id, organization_id, target_type || '/' || target_id, f FROM lnk WHERE trim(target_id) <> ''),
targets AS (
  SELECT 'po_number' AS ref_field, organization_id, pkey AS k, f, d FROM po
  UNION ALL SELECT 'document_id', organization_id, id, f, d FROM reg
  UNION ALL SELECT 'target_id', organization_id, 'PURCHASE_ORDER/' || id, f, d FROM po
  UNION ALL SELECT 'target_id', organization_id, 'INVOICE/' || id, f, d FROM inv),
orphans AS (
  SELECT ref_table, ref_field, record_id, strftime(r.f AT TIME ZONE 'UTC', '%Y-%m') AS period FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.ref_field = r.ref_field AND t.organization_id = r.organization_id AND t.k = r.k
    AND t.f < (date_trunc('month', r.f AT TIME ZONE 'UTC') + INTERVAL 1 MONTH) AT TIME ZONE 'UTC'
    AND (t.d IS NULL OR t.d >= (date_trunc('month', r.f AT TIME ZONE 'UTC') + INTERVAL 1 MONTH) AT TIME ZONE 'UTC')))
"""
QUERIES = {f.__name__: f for f in (p1_found, p1_timestamps, p1_orders, p6_found, p6_units, p6_conversions, p7_found, p7_report, p7_composite)}
SQL: dict[str, str] = {
    "p6_found": unit_cases_sql(),
    "p7_found": _P7 + "SELECT DISTINCT * FROM orphans",
    "p7_composite": """WITH r AS (SELECT DISTINCT organization_id, id, vendor_id, nullif(trim(po_number), '') AS po_number FROM invoice), o AS (SELECT DISTINCT organization_id, vendor_id, trim(po_number) AS po_number FROM purchase_order),
      m AS (SELECT r.*, vendor_id IS NULL AS no_vendor_id, po_number IS NULL AS no_po_number, EXISTS (SELECT 1 FROM o WHERE o.organization_id = r.organization_id AND (r.vendor_id IS NULL OR o.vendor_id = r.vendor_id) AND (r.po_number IS NULL OR o.po_number = r.po_number)) AS met FROM r)
      SELECT 'simple' AS semantics, no_vendor_id, no_po_number, count(*) AS orphans FROM m WHERE NOT no_vendor_id AND NOT no_po_number AND NOT met GROUP BY ALL
      UNION ALL SELECT 'full', no_vendor_id, no_po_number, count(*) FROM m WHERE (no_vendor_id <> no_po_number) OR (NOT no_vendor_id AND NOT no_po_number AND NOT met) GROUP BY ALL
      UNION ALL SELECT 'partial', no_vendor_id, no_po_number, count(*) FROM m WHERE NOT (no_vendor_id AND no_po_number) AND NOT met GROUP BY ALL""",
    "p7_report": _P7 + "SELECT ref_table, ref_field, period, count(DISTINCT record_id) AS orphans FROM orphans GROUP BY ALL",
}
