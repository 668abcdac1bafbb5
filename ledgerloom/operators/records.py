"""Relational operators over the accounts-payable records, each for all tenants at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import bank_digits, normalize_tax_id
from ledgerloom.session import table

OPEN = ("unpaid", "pending", "partially_paid")
#: Columns that differ between redelivered copies.
DELIVERY = ("ingested_at", "seq")


def records(spark: SparkSession, sf: str, name: str, columns: str) -> DataFrame:
    """organization_id, id and the named columns of a table, one row per record: redelivered copies, which
    are equal but for their delivery, are folded and keep their first. Only these columns are read."""
    wanted = ["organization_id", "id", *[c for c in columns.split() if c not in DELIVERY]]
    delivery = [c for c in columns.split() if c in DELIVERY]
    df = table(spark, sf, name)
    return df.groupBy(*wanted).agg(*[F.min(c).alias(c) for c in delivery]) if delivery else df.select(*wanted).distinct()


def money(c: Column) -> Column:
    """Sums of decimals as double, the same in every engine."""
    return c.cast("double")


def vendor_spend(invoices: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    x = invoices
    if start:
        x = x.filter(F.col("invoice_date") >= F.lit(start).cast("date"))
    if end:
        x = x.filter(F.col("invoice_date") <= F.lit(end).cast("date"))
    return x.groupBy("organization_id", "vendor_id").agg(money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_spend"), F.count("*").alias("invoices"))


def monthly_spend(invoices: DataFrame) -> DataFrame:
    x = invoices.filter("invoice_date is not null and total_amount <> 0")
    return x.groupBy("organization_id", "vendor_id", F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(money(F.sum("total_amount")).alias("spend"), F.count("*").alias("invoices"))


def spend_trend(invoices: DataFrame) -> DataFrame:
    """Each month beside the vendor's month before."""
    w = Window.partitionBy("organization_id", "vendor_id").orderBy("month")  # months of a vendor: bounded by time
    m = monthly_spend(invoices).withColumn("before", F.lag("spend").over(w))
    return m.withColumn("change_pct", F.when(F.col("before") > 0, F.round((F.col("spend") - F.col("before")) / F.col("before") * 100, 2)))


def top_vendors(invoices: DataFrame, k: int = 5) -> DataFrame:
    x = invoices.groupBy("organization_id", "vendor_id").agg(F.sum("total_amount").alias("s"), F.count("*").alias("invoices"))
    w = Window.partitionBy("organization_id").orderBy(F.col("s").desc_nulls_last(), F.col("vendor_id").asc_nulls_last())
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("organization_id", "vendor_id", money(F.col("s")).alias("total_spend"), "invoices", "place")


def open_invoices(invoices: DataFrame) -> DataFrame:
    x = invoices.filter(F.lower("payment_status").isin(*OPEN))
    return x.select("organization_id", "id", "vendor_id", "invoice_number", F.coalesce(F.nullif("vendor_name_raw", F.lit("")), F.nullif("vendor_name_normalized", F.lit("")), F.lit("Unknown")).alias("vendor"), money(F.col("amount_due")).alias("amount_due"))


def overdue_invoices(invoices: DataFrame, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    x = invoices.filter(F.lower("payment_status").isin(*OPEN) & (F.col("due_date") < day))
    return x.select("organization_id", "id", "due_date", F.datediff(day, "due_date").alias("days_overdue"), money(F.col("total_amount")).alias("total_amount"))


def first_by_number(invoices: DataFrame) -> DataFrame:
    """The first delivered invoice of each number, compared without case."""
    w = Window.partitionBy("organization_id", F.lower("invoice_number")).orderBy("seq", "id")
    return invoices.filter("invoice_number is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("organization_id", F.lower("invoice_number").alias("number"), "id")


def compare_spend(invoices: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Two periods in one pass."""
    inside = lambda p: F.col("invoice_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    total = lambda p: money(F.coalesce(F.sum(F.when(inside(p), F.col("total_amount"))), F.lit(0)))
    x = invoices.filter(inside(a) | inside(b)).groupBy("organization_id", "vendor_id").agg(total(a).alias("spend_a"), total(b).alias("spend_b"))
    return x.withColumn("difference", F.round(F.col("spend_b") - F.col("spend_a"), 2)).withColumn("change_pct", F.when(F.col("spend_a") > 0, F.round((F.col("spend_b") - F.col("spend_a")) / F.col("spend_a") * 100, 2)).otherwise(0.0))


def dashboard(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    s = F.lower("payment_status")
    x = invoices.groupBy("organization_id").agg(
        F.count("*").alias("invoices"), F.count_if(s == "paid").alias("paid"), F.count_if(s.isin(*OPEN)).alias("open"), F.count_if(F.col("po_number").isNull()).alias("without_po"),
        money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("spend"), money(F.coalesce(F.sum(F.when(s.isin(*OPEN), F.col("amount_due"))), F.lit(0))).alias("outstanding"),
    )
    return x.join(orders.groupBy("organization_id").agg(F.count("*").alias("orders")), "organization_id", "full").fillna(0, ["invoices", "paid", "open", "without_po", "spend", "outstanding", "orders"])


def link_orders(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Every invoice that names an order beside the first order of that number in its organisation."""
    w = Window.partitionBy("organization_id", "key").orderBy("ingested_at", "id")
    first = orders.withColumn("key", F.trim("po_number")).filter("key <> ''").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    first = first.select("organization_id", "key", F.col("id").alias("po_id"), F.col("vendor_id").alias("po_vendor"), F.col("total_amount").alias("po_total"))
    x = invoices.withColumn("key", F.trim("po_number")).filter("key <> ''").join(first, ["organization_id", "key"], "left")
    return x.select("organization_id", F.col("id").alias("invoice_id"), "po_id", money(F.col("total_amount") - F.col("po_total")).alias("difference"), (F.col("vendor_id") != F.col("po_vendor")).alias("other_vendor"))


def latest_links(links: DataFrame, single_target: bool = False) -> DataFrame:
    """Upsert: the last delivered link of each source (and target, unless single_target)."""
    key = ["organization_id", "link_type", "source_type", "source_id"] + ([] if single_target else ["target_id"])
    order = F.struct("ingested_at", "id")
    return links.groupBy(*key).agg(F.max_by("id", order).alias("id"), F.max_by("status", order).alias("status"))


def duplicate_invoices(invoices: DataFrame) -> DataFrame:
    """Later invoices that repeat number and vendor (by id or by raw name) of an earlier one.

    Vendors and names become keys of groups, so equal numbers of other vendors are never paired:
    the original is the least (seq, id) of the group."""
    base = invoices.filter("invoice_number is not null")
    keys = F.array_compact(F.array(F.when(F.col("vendor_id").isNotNull(), F.concat(F.lit("v"), "vendor_id")), F.when(F.col("vendor_name_raw").isNotNull(), F.concat(F.lit("n"), F.trim(F.lower("vendor_name_raw"))))))
    x = base.select("organization_id", "invoice_number", "id", "seq", F.explode(keys).alias("key"))
    first = x.groupBy("organization_id", "invoice_number", "key").agg(F.min(F.struct("seq", "id")).alias("original"))
    y = x.join(first, ["organization_id", "invoice_number", "key"]).filter(F.struct("seq", "id") > F.col("original"))
    return y.groupBy("organization_id", "id").agg(F.min("original").alias("o")).select("organization_id", F.col("id").alias("duplicate_id"), F.col("o.id").alias("original_id"))


def amount_outliers(invoices: DataFrame, least: int = 5, z: float = 2.5) -> DataFrame:
    """Leave-one-out z-scores within a vendor from (n, sum, sum of squares): one aggregate and a join, no window."""
    x = invoices.filter("vendor_id is not null and total_amount is not null").select("organization_id", "vendor_id", "id", F.col("total_amount").cast("double").alias("a"))
    s = x.groupBy("organization_id", "vendor_id").agg((F.count("*") - 1).alias("n"), F.sum("a").alias("s1"), F.sum(F.col("a") * F.col("a")).alias("s2")).filter(F.col("n") >= least)
    y = x.join(s, ["organization_id", "vendor_id"]).withColumn("mean", (F.col("s1") - F.col("a")) / F.col("n"))
    y = y.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("a") * F.col("a") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1))))
    y = y.filter("sd > 0").withColumn("z_score", F.round((F.col("a") - F.col("mean")) / F.col("sd"), 2)).filter(F.abs("z_score") > z)
    return y.select("organization_id", "id", F.col("n").alias("sample"), F.when(F.col("z_score") > 0, "HIGH").otherwise("LOW").alias("kind"), "z_score")


def history_outliers(invoices: DataFrame, least: int = 5, z: float = 2.5, parts: int = 64) -> DataFrame:
    """The z-score of each amount against the vendor's deliveries before it, as known on arrival.

    A vendor's deliveries are cut into ``parts`` stretches of their order; sums of the stretches before come from
    aggregates, so one vendor with a large share of all rows is no single task. Amounts are taken off the vendor's
    mean first, which keeps the sums of squares exact enough."""
    x = invoices.filter("vendor_id is not null and total_amount is not null").select("organization_id", "vendor_id", "id", "seq", F.col("total_amount").cast("double").alias("a"))
    key = ["organization_id", "vendor_id"]
    spans = x.groupBy(*key).agg(F.round(F.avg("a"), 2).alias("c"), F.min("seq").alias("low"), (F.max("seq") - F.min("seq") + 1).alias("width"))
    x = x.join(spans, key).withColumn("part", F.floor((F.col("seq") - F.col("low")) * parts / F.col("width"))).withColumn("d", F.col("a") - F.col("c"))
    sums = x.groupBy(*key, "part").agg(F.count("*").alias("n"), F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"))
    ahead = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, "part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"b{c}") for c in ("n", "s1", "s2")])
    w = Window.partitionBy(*key, "part").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, e: F.col(f"b{c}") + F.coalesce(e.over(w), F.lit(0))
    y = x.join(before, [*key, "part"]).select("organization_id", "id", "d", upto("n", F.count("d")).alias("n"), upto("s1", F.sum("d")).alias("s1"), upto("s2", F.sum(F.col("d") * F.col("d"))).alias("s2"))
    y = y.filter(F.col("n") >= least).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1))))
    y = y.filter("sd > 1e-6").withColumn("z_score", F.round((F.col("d") - F.col("s1") / F.col("n")) / F.col("sd"), 2)).filter(F.abs("z_score") > z)
    return y.select("organization_id", "id", F.col("n").alias("sample"), "z_score")


def resolve_exact(invoices: DataFrame, vendors: DataFrame, aliases: DataFrame) -> DataFrame:
    """Which vendor a raw name means: by normalised name, else by alias; the least vendor id of each key."""
    v = vendors.filter("normalized_name is not null").groupBy("organization_id", F.col("normalized_name").alias("name")).agg(F.min("id").alias("by_name"))
    a = aliases.filter("vendor_id is not null and normalized_alias is not null").groupBy("organization_id", F.col("normalized_alias").alias("name")).agg(F.min("vendor_id").alias("by_alias"))
    x = invoices.filter("vendor_name_normalized is not null").select("organization_id", "id", F.col("vendor_name_normalized").alias("name"))
    y = x.join(v, ["organization_id", "name"], "left").join(a, ["organization_id", "name"], "left")
    return y.select("organization_id", "id", F.coalesce("by_name", "by_alias").alias("vendor_id"), F.when(F.col("by_name").isNotNull(), "NORMALIZED_NAME").when(F.col("by_alias").isNotNull(), "ALIAS").otherwise("NEW_VENDOR").alias("match_type"))


def resolve_cascade(vendors: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Which known vendor another vendor record is: by tax number, by bank account (with the bank code where both
    have one), by normalised name, by alias; the least id of each key. Four left joins on keys that are unique."""
    least = lambda df, *keys: df.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy("organization_id", *keys)
    bare = lambda df: df.select("organization_id", "id", normalize_tax_id(F.col("tax_id")).alias("tax"), bank_digits(F.col("bank_account")).alias("bank"), F.upper(F.trim("ifsc_swift")).alias("code"), F.col("normalized_name").alias("name"))
    k, x = bare(known), bare(vendors)
    by_tax = least(k, "tax").agg(F.min("id").alias("by_tax"))
    by_code = least(k, "bank", "code").agg(F.min("id").alias("by_code"))
    by_bank = least(k, "bank").agg(F.min("id").alias("any_code"), F.min(F.when(F.col("code").isNull(), F.col("id"))).alias("no_code"))
    by_name = least(k, "name").agg(F.min("id").alias("by_name"))
    by_alias = least(aliases.filter("vendor_id is not null").withColumnRenamed("normalized_alias", "name"), "name").agg(F.min("vendor_id").alias("by_alias"))
    y = x.join(by_tax, ["organization_id", "tax"], "left").join(by_code, ["organization_id", "bank", "code"], "left").join(by_bank, ["organization_id", "bank"], "left")
    y = y.join(by_name, ["organization_id", "name"], "left").join(by_alias, ["organization_id", "name"], "left")
    by_account = F.when(F.col("code").isNull(), F.col("any_code")).otherwise(F.least("by_code", "no_code"))
    order = [("TAX_ID", F.col("by_tax")), ("BANK_ACCOUNT", by_account), ("NORMALIZED_NAME", F.col("by_name")), ("ALIAS", F.col("by_alias"))]
    kind = F.lit("NEW_VENDOR")
    for name, c in reversed(order):
        kind = F.when(c.isNotNull(), name).otherwise(kind)
    return y.select("organization_id", "id", F.coalesce(*[c for _, c in order]).alias("vendor_id"), kind.alias("match_type"))


def drivers(lines: DataFrame, invoices: DataFrame, before: str, after: str) -> DataFrame:
    """Per product: what price and what quantity changed between two months, and new products."""
    x = lines.join(invoices.select("organization_id", F.col("id").alias("invoice_id"), F.date_format("invoice_date", "yyyy-MM").alias("month")), ["organization_id", "invoice_id"]).filter(F.col("month").isin(before, after) & F.col("product_code").isNotNull())
    pick = lambda m, c: F.sum(F.when(F.col("month") == m, F.col(c).cast("double")))
    g = x.groupBy("organization_id", "product_code").agg(*[F.round(pick(m, c), 4).alias(f"{p}_{s}") for p, m in (("b", before), ("a", after)) for c, s in (("quantity", "q"), ("total", "t"))])
    price = lambda p: F.when(F.col(f"{p}_q") > 0, F.col(f"{p}_t") / F.col(f"{p}_q"))
    g = g.withColumn("pb", price("b")).withColumn("pa", price("a"))
    return g.select(
        "organization_id", "product_code", F.round((F.col("pa") - F.col("pb")) * F.col("a_q"), 2).alias("price_effect"), F.round((F.col("a_q") - F.col("b_q")) * F.col("pb"), 2).alias("quantity_effect"),
        F.when(F.col("b_t").isNull(), F.round("a_t", 2)).alias("new_item"),
    )


def best_evidence(fields: DataFrame) -> DataFrame:
    """One value per document and field: the most confident, then the least id."""
    w = Window.partitionBy("document_id", "field_name").orderBy(F.desc("confidence"), "id")
    return fields.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("document_id", "field_name", "id", F.col("confidence").cast("double").alias("confidence"))
