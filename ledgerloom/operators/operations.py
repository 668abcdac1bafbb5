"""The approved operations with their arguments. Every one works for all organisations at once and carries
organization_id; ``org`` restricts it to one. Limits hold within each organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.records import OPEN, money

ORG = "organization_id"


def within(df: DataFrame, org: str | None) -> DataFrame:
    return df.filter(F.col(ORG) == org) if org is not None else df


def in_period(df: DataFrame, start: str | None, end: str | None, day: str = "invoice_date") -> DataFrame:
    """Both ends belong to the period, either may be open; undated rows are in none but the open one."""
    for bound, keep in ((start, lambda d: F.col(day) >= d), (end, lambda d: F.col(day) <= d)):
        if bound is not None:
            df = df.filter(keep(F.lit(bound).cast("date")))
    return df


def contains(c: str, text: str) -> Column:
    """Whether a column holds a text, without case; signs that are wildcards in SQL stand for themselves."""
    return F.lower(c).contains(F.lit(text.strip().lower()))


def named(df: DataFrame, name: str | None, *columns: str) -> DataFrame:
    """Rows of which one of the columns holds the name."""
    if name is None:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(contains(c, name), F.lit(False))
    return df.filter(hit)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each organisation's rows with ``place`` and ``total``, the number of rows on all pages."""
    total = df.groupBy(ORG).agg(F.count("*").alias("total"))
    x = df.withColumn("place", F.row_number().over(Window.partitionBy(ORG).orderBy(*order)))
    return x.filter((F.col("place") > offset) & (F.col("place") <= offset + limit)).join(total, ORG)


def display_name() -> Column:
    return F.coalesce(F.nullif("vendor_name_raw", F.lit("")), F.nullif("vendor_name_normalized", F.lit("")), F.lit("Unknown"))


def vendor_total_spend(invoices: DataFrame, org: str | None = None, vendor_id: str | None = None, vendor_name: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Spend and number of invoices; a vendor's id wins over a name, without either the whole organisation."""
    x = in_period(within(invoices, org), start, end)
    x = x.filter(F.col("vendor_id") == vendor_id) if vendor_id is not None else named(x, vendor_name, "vendor_name_normalized", "vendor_name_raw")
    return x.groupBy(ORG).agg(money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_spend"), F.count("*").alias("invoices"))


def monthly_vendor_spend(invoices: DataFrame, org: str | None = None, vendor_id: str | None = None, vendor_name: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    x = in_period(within(invoices, org), start, end).filter("invoice_date is not null and total_amount <> 0")
    x = x.filter(F.col("vendor_id") == vendor_id) if vendor_id is not None else named(x, vendor_name, "vendor_name_normalized", "vendor_name_raw")
    return x.groupBy(ORG, F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(money(F.sum("total_amount")).alias("spend"))


def vendor_invoice_count(invoices: DataFrame, org: str | None = None, vendor_id: str | None = None) -> DataFrame:
    x = within(invoices, org)
    x = x.filter(F.col("vendor_id") == vendor_id) if vendor_id is not None else x
    return x.groupBy(ORG).agg(F.count("*").alias("invoices"))


def unpaid_invoices(invoices: DataFrame, org: str | None = None, vendor_id: str | None = None, limit: int = 100) -> DataFrame:
    """The latest unpaid invoices."""
    x = within(invoices, org).filter(F.lower("payment_status").isin(*OPEN))
    x = x.filter(F.col("vendor_id") == vendor_id) if vendor_id is not None else x
    y = page(x, [F.desc("ingested_at"), F.asc("id")], limit)
    return y.select(ORG, "id", "place", "total", display_name().alias("vendor"), money(F.col("amount_due")).alias("amount_due"))


def overdue_invoices(invoices: DataFrame, as_of: str, org: str | None = None, limit: int = 100) -> DataFrame:
    """The longest overdue invoices."""
    day = F.lit(as_of).cast("date")
    x = within(invoices, org).filter(F.lower("payment_status").isin(*OPEN) & (F.col("due_date") < day))
    return page(x, [F.asc("due_date"), F.asc("id")], limit).select(ORG, "id", "place", "total", F.datediff(day, "due_date").alias("days_overdue"))


def top_vendors(invoices: DataFrame, org: str | None = None, limit: int = 5, start: str | None = None, end: str | None = None) -> DataFrame:
    """Vendors as they are written: one with two spellings is two rows."""
    x = in_period(within(invoices, org), start, end).groupBy(ORG, "vendor_id", "vendor_name_raw", "vendor_name_normalized").agg(F.sum("total_amount").alias("s"), F.count("*").alias("invoices"))
    order = [F.desc_nulls_last("s"), *[F.asc_nulls_last(c) for c in ("vendor_id", "vendor_name_raw", "vendor_name_normalized")]]
    return page(x, order, limit).select(ORG, "vendor_id", display_name().alias("vendor"), money(F.col("s")).alias("spend"), "invoices", "place")


def spend_by_vendor(invoices: DataFrame, org: str | None = None, limit: int = 10) -> DataFrame:
    x = within(invoices, org).groupBy(ORG, F.coalesce("vendor_name_normalized", F.lit("Unknown")).alias("vendor")).agg(F.sum("total_amount").alias("s"), F.count("*").alias("invoices"))
    return page(x, [F.desc_nulls_last("s"), F.asc("vendor")], limit).select(ORG, "vendor", money(F.col("s")).alias("spend"), "invoices", "place")


def invoices_for_period(invoices: DataFrame, start: str | None, end: str | None, org: str | None = None, vendor_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    x = in_period(within(invoices, org), start, end)
    x = x.filter(F.col("vendor_id") == vendor_id) if vendor_id is not None else x
    return page(x, [F.desc_nulls_last("invoice_date"), F.asc("id")], limit, offset).select(ORG, "id", "invoice_date", "place", "total")


def line_items(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines of the given invoices (a semi-join), amounts that are null or zero as 1 and 0.00."""
    mine = lines.join(invoices.select(ORG, F.col("id").alias("invoice_id")).distinct(), [ORG, "invoice_id"], "left_semi")
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(d)).alias(c)
    return mine.select(ORG, "invoice_id", "id", "product_code", filled("quantity", 1.0), filled("unit_price", 0.0), filled("total", 0.0))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Running line numbers of each invoice: the given ones in order, then the id."""
    w = Window.partitionBy(ORG, "invoice_id").orderBy(F.asc_nulls_last("line_number"), "id")
    return lines.select(ORG, "invoice_id", "id", F.row_number().over(w).alias("number"))


def order_detail(orders: DataFrame, links: DataFrame, org: str | None = None, po_id: str | None = None, po_number: str | None = None) -> DataFrame:
    """Orders with their lines and the invoices linked to them; by id or by number without case and blanks."""
    x = within(orders, org)
    x = x.filter(F.col("id") == po_id) if po_id is not None else x
    x = x.filter(F.lower(F.trim("po_number")) == po_number.strip().lower()) if po_number is not None else x
    linked = links.filter("link_type = 'INVOICE_TO_PO' and target_id is not null").groupBy(ORG, F.col("target_id").alias("id")).agg(F.sort_array(F.collect_set("source_id")).alias("invoices"))
    y = x.join(linked, [ORG, "id"], "left")
    return y.select(ORG, "id", F.trim("po_number").alias("po_number"), "line_items", F.coalesce("invoices", F.array().cast("array<string>")).alias("invoices"))


def invoice_detail(invoices: DataFrame, lines: DataFrame, fields: DataFrame, links: DataFrame, vendors: DataFrame, aliases: DataFrame) -> DataFrame:
    """Everything about an invoice in one row: its vendor with aliases, lines, extracted fields, linked orders and
    payments. Children are gathered per parent before the joins, so nothing is multiplied."""
    gather = lambda df, key, struct, name: df.groupBy(ORG, key).agg(F.array_sort(F.collect_set(struct)).alias(name))
    li = gather(lines, "invoice_id", F.struct("id", "product_code", F.col("quantity").cast("double").alias("quantity"), F.col("total").cast("double").alias("total")), "lines").withColumnRenamed("invoice_id", "id")
    fi = gather(fields, "document_id", F.struct("field_name", "id", "field_value"), "fields")
    po = gather(links.filter("link_type = 'INVOICE_TO_PO'"), "source_id", F.struct("target_id", "status"), "orders").withColumnRenamed("source_id", "id")
    pay = gather(links.filter("link_type = 'PAYMENT_TO_INVOICE' and target_id is not null"), "target_id", F.struct("source_id", "status"), "payments").withColumnRenamed("target_id", "id")
    al = gather(aliases.filter("vendor_id is not null"), "vendor_id", F.struct("alias_name"), "aliases")
    ven = vendors.select(ORG, F.col("id").alias("vendor_id"), "canonical_name").join(al, [ORG, "vendor_id"], "left")
    x = invoices.join(ven, [ORG, "vendor_id"], "left").join(fi, [ORG, "document_id"], "left")
    for part in (li, po, pay):
        x = x.join(part, [ORG, "id"], "left")
    return x.select(ORG, "id", "vendor_id", "canonical_name", "aliases", "lines", "fields", "orders", "payments")


def vendor_search(vendors: DataFrame, text: str, org: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Vendors whose name, normalised name or tax number holds a text, by name."""
    x = named(within(vendors, org), text, "canonical_name", "normalized_name", "tax_id")
    return page(x, [F.asc_nulls_last("canonical_name"), F.asc("id")], limit, offset).select(ORG, "id", "canonical_name", "place", "total")


def lookup(df: DataFrame, org: str | None = None, trimmed: tuple[str, ...] = (), order: str = "id", **keys: str) -> DataFrame:
    """The first record of each organisation under the given keys; ``trimmed`` columns are compared without blanks."""
    x = within(df, org)
    for c, v in keys.items():
        x = x.filter((F.trim(c) if c in trimmed else F.col(c)) == (v.strip() if c in trimmed else v))
    return x.withColumn("_rn", F.row_number().over(Window.partitionBy(ORG).orderBy(order, "id"))).filter("_rn = 1").drop("_rn")


def scoped_list(df: DataFrame, order: list[Column], upper: dict[str, str] | None = None, **equal: str) -> DataFrame:
    """Records under equal values, ``upper`` compared in upper case, numbered in order within the organisation."""
    x = df
    for c, v in equal.items():
        x = x.filter(F.col(c) == v)
    for c, v in (upper or {}).items():
        x = x.filter(F.upper(c) == v.upper())
    return x.withColumn("place", F.row_number().over(Window.partitionBy(ORG).orderBy(*order)))


def findings(duplicates: DataFrame, outliers: DataFrame, links: DataFrame, invoices: DataFrame) -> DataFrame:
    """organization_id, invoice_id, kind, impact, detail: repeated invoices, outlying amounts and open links as one table."""
    amount = invoices.select(ORG, F.col("id").alias("invoice_id"), F.col("total_amount").cast("double").alias("amount"))
    dup = duplicates.select(ORG, F.col("duplicate_id").alias("invoice_id"), F.lit("DUPLICATE").alias("kind"), F.to_json(F.struct("original_id")).alias("detail"))
    odd = outliers.select(ORG, F.col("id").alias("invoice_id"), F.lit("OUTLIER").alias("kind"), F.to_json(F.struct(F.col("kind"))).alias("detail"))
    loose = links.filter("source_type = 'INVOICE' and upper(status) = 'UNRESOLVED'").select(ORG, F.col("source_id").alias("invoice_id"), F.lit("UNRESOLVED_LINK").alias("kind"), F.to_json(F.struct("link_type")).alias("detail"))
    return dup.unionByName(odd).unionByName(loose).distinct().join(amount, [ORG, "invoice_id"], "left").select(ORG, "invoice_id", "kind", F.coalesce("amount", F.lit(0.0)).alias("impact"), "detail")


def findings_of_vendor(found: DataFrame, invoices: DataFrame, vendor_id: str | None = None) -> DataFrame:
    mine = invoices.filter(F.col("vendor_id") == vendor_id) if vendor_id is not None else invoices.filter("vendor_id is not null")
    return found.join(mine.select(ORG, F.col("id").alias("invoice_id")), [ORG, "invoice_id"], "left_semi")


def findings_in_period(found: DataFrame, invoices: DataFrame, start: str | None, end: str | None) -> DataFrame:
    return found.join(in_period(invoices, start, end).select(ORG, F.col("id").alias("invoice_id")), [ORG, "invoice_id"], "left_semi")


def ranked_findings(found: DataFrame, limit: int = 50) -> DataFrame:
    """Findings by impact, with the number of all."""
    return page(found, [F.desc("impact"), F.asc("invoice_id"), F.asc("kind")], limit).select(ORG, "invoice_id", "kind", "impact", "place", "total")


def flagged(outliers: DataFrame, invoices: DataFrame, start: str, end: str) -> DataFrame:
    """Outliers with whether their invoice lies in the period: CONFIRMED there, else SUPPORTED."""
    inside = in_period(invoices, start, end).select(ORG, "id", F.lit(True).alias("inside"))
    return outliers.join(inside, [ORG, "id"], "left").select(ORG, "id", "z_score", F.when(F.col("inside"), "CONFIRMED").otherwise("SUPPORTED").alias("state"))


def mean_confidence(fields: DataFrame) -> DataFrame:
    return fields.groupBy("document_id").agg(F.count("*").alias("evidence"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("confidence"))


def longest_mentions(texts: DataFrame, vendors: DataFrame) -> DataFrame:
    """``texts``(organization_id, id, text): the longest vendor name a text mentions as whole words, the least id on ties.

    Names meet texts on their first word, so neither side is compared with all of the other."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    v = vendors.filter("normalized_name is not null").select(ORG, F.col("id").alias("vendor_id"), F.array_join(words(F.col("normalized_name")), " ").alias("name")).filter("name <> ''")
    v = v.withColumn("word", F.split("name", " ")[0])
    t = texts.filter("text is not null").withColumn("ws", words(F.col("text"))).select(ORG, "id", F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")).alias("plain"), F.explode(F.array_distinct("ws")).alias("word"))
    hits = t.join(v, [ORG, "word"]).filter(F.col("plain").contains(F.concat(F.lit(" "), F.col("name"), F.lit(" "))))
    return hits.groupBy(ORG, "id").agg(F.min_by(F.struct("vendor_id", "name"), F.struct((-F.length("name")).alias("n"), "vendor_id")).alias("b")).select(ORG, "id", "b.vendor_id", "b.name")


def new_and_removed(lines: DataFrame, invoices: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """Products of a vendor in only one of two periods: one scan tagged by period, an aggregate instead of two anti-joins."""
    tagged = in_period(invoices, min(before[0], after[0]), max(before[1], after[1])).filter("vendor_id is not null")
    inside = lambda p: F.col("invoice_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    tagged = tagged.withColumn("period", F.when(inside(before), "before").when(inside(after), "after")).filter("period is not null").select(ORG, F.col("id").alias("invoice_id"), "vendor_id", "period")
    x = lines.filter("product_code is not null").join(tagged, [ORG, "invoice_id"]).groupBy(ORG, "vendor_id", "product_code").agg(F.count_if(F.col("period") == "before").alias("b"), F.count_if(F.col("period") == "after").alias("a"), money(F.coalesce(F.sum("total"), F.lit(0))).alias("total"))
    return x.filter("a = 0 or b = 0").select(ORG, "vendor_id", "product_code", F.when(F.col("b") == 0, "NEW").otherwise("REMOVED").alias("change"), "total")


def change_pct(base: Column, target: Column) -> Column:
    """Per cent of change to two places, half even; from nothing to something is 100, to nothing 0."""
    return F.when(base > 0, F.bround((target - base) / base * 100, 2)).when(target > 0, F.lit(100.0)).otherwise(F.lit(0.0))
