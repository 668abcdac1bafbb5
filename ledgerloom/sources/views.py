"""Payments and the invoices they pay, defined over the order tables: no payment records are supplied.

An invoice is what one supplier delivered of one order; a delivered line of it is paid by one payment, which
names its invoice (with blanks about the number) and one that does not exist. Money is exact: inputs are cast to
decimals before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import table

LINE_TOTAL = "cast(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(5,2))) * (1 + cast(l_tax as decimal(5,2))) as decimal(15,2))"
PAYMENT_ID = "concat('pay_', md5(concat_ws('|', l_orderkey, l_linenumber, l_suppkey, l_partkey, cast(l_quantity as decimal(15,2)), cast(l_extendedprice as decimal(15,2)), cast(l_shipdate as date))))"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    place = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("org_"), F.col("n_regionkey").cast("string")).alias("organization_id"))
    return table(spark, sf, "lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey"))


def delivered_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """organization_id, id, invoice_number, vendor_id, total_amount."""
    x = _lines(spark, sf).groupBy("organization_id", "l_orderkey", "l_suppkey").agg(F.sum(F.expr(LINE_TOTAL)).cast("decimal(15,2)").alias("total_amount"))
    number = lambda p: F.concat(F.lit(p), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return x.select("organization_id", number("inv-").alias("id"), number("INV-").alias("invoice_number"), F.concat(F.lit("ven_"), F.col("l_suppkey").cast("string")).alias("vendor_id"), "total_amount")


def payments(spark: SparkSession, sf: str) -> DataFrame:
    """organization_id, id, reference, amount, status, paid_on, vendor_id, referenced_invoice_numbers."""
    x = _lines(spark, sf).filter("l_linestatus = 'F'")
    return x.select(
        "organization_id", F.expr(PAYMENT_ID).alias("id"), F.expr("concat('UTR-', l_orderkey, '-', l_linenumber)").alias("reference"),
        F.expr(f"cast({LINE_TOTAL} + case when l_linenumber = 1 then 5 else 0 end as decimal(15,2))").alias("amount"), F.expr("case when l_returnflag = 'R' then 'BOUNCED' else 'COMPLETED' end").alias("status"),
        F.col("l_shipdate").cast("date").alias("paid_on"), F.expr("concat('ven_', l_suppkey)").alias("vendor_id"), F.expr("array(concat(' INV-', l_orderkey, '-', l_suppkey, ' '), 'INV-0-0')").alias("referenced_invoice_numbers"),
    ).distinct()


def _box(x1: int, y1: int, x2: int, y2: int):
    return F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))])


def _pages(df: DataFrame, parts: list[tuple]) -> DataFrame:
    """Regions of one-page documents: (id, region type, box, text, confidence); those without text are left out."""
    structs = [F.struct(F.lit(n).alias("id"), F.lit(kind).alias("region_type"), F.lit(i + 1).alias("reading_order"), _box(*box).alias("bbox"), F.lit(conf).cast("double").alias("confidence"), text.alias("raw_ocr_output")) for i, (n, kind, box, text, conf) in enumerate(parts)]
    x = df.select("organization_id", "doc_id", F.lit(1).alias("page_number"), F.inline(F.array(*structs)))
    return x.filter("raw_ocr_output is not null and raw_ocr_output <> ''")


def _pipe_table(rows: Column) -> Column:
    line = lambda r: F.concat_ws(" | ", F.lit("|"), r.description, r.quantity, r.rate, r.total, F.lit("|"))
    body = F.array_join(F.transform(rows, lambda r: F.regexp_replace(line(r), r"^\| \| |\| \|$", "| ")), "\n")
    return F.when(F.size(rows) > 0, F.concat(F.lit("| Description | Qty | Rate | Amount |\n|---|---|---|---|\n"), body))


def printed_invoices(invoices: DataFrame, vendors: DataFrame, lines: DataFrame) -> DataFrame:
    """Each invoice as the regions a layout step would give of its printed page: title, seller, a block of numbers
    and dates, labels with values beside and below them, bill-to, a pipe table, a line in pieces, the bank, and
    the number block once more as it is when two detections overlap."""
    word = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("-")), r"[|\r\n]+", " "))
    money = lambda c: F.col(c).cast("decimal(15,2)").cast("string")
    row = F.struct("line_number", "id", word(F.col("description")).alias("description"), F.col("quantity").cast("decimal(15,4)").cast("string").alias("quantity"), money("unit_price").alias("rate"), money("total").alias("total"))
    whole = lines.filter("quantity is not null and unit_price is not null and total is not null")
    held = whole.groupBy("organization_id", F.col("invoice_id").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    v = vendors.select("organization_id", F.col("id").alias("vendor_id"), "tax_id", "bank_account", "ifsc_swift")
    x = invoices.withColumnRenamed("id", "doc_id").join(v, ["organization_id", "vendor_id"], "left").join(held, ["organization_id", "doc_id"], "left")
    said = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    day = lambda c, f: F.date_format(c, f)
    numbers = F.concat_ws("\n", said("Invoice No: ", F.trim("invoice_number")), said("Invoice Date: ", day("invoice_date", "yyyy-MM-dd")), said("PO Number: ", F.nullif(F.trim("po_number"), F.lit(""))))
    seller = F.concat_ws("\n", word(F.col("vendor_name_raw")), said("GSTIN: ", F.col("tax_id")))
    amount = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("INR "), F.format_number(F.col(c).cast("decimal(15,2)"), 2)))
    label = lambda text, c: F.when(F.col(c).isNotNull(), F.lit(text))
    first = F.get("rows", F.lit(0))
    return _pages(x, [
        ("title", "title", (60, 40, 500, 90), F.lit("TAX INVOICE"), 0.99), ("seller", "text", (60, 100, 660, 180), seller, 0.97), ("numbers", "text", (700, 40, 1150, 200), numbers, 0.96), ("numbers_again", "text", (704, 43, 1152, 204), numbers, 0.6),
        ("due_label", "text", (60, 220, 180, 250), label("Due Date:", "due_date"), 0.95), ("due_value", "text", (200, 222, 340, 252), day("due_date", "dd/MM/yyyy"), 0.95), ("bill_to", "text", (60, 270, 500, 330), F.concat(F.lit("Bill To:\nBranch of "), "organization_id"), 0.95),
        ("lines", "table", (60, 360, 1150, 900), _pipe_table(F.col("rows")), 0.9), ("sub_label", "text", (700, 920, 850, 950), label("Sub Total", "subtotal"), 0.95), ("sub_value", "text", (880, 922, 1100, 950), amount("subtotal"), 0.95),
        ("total_label", "text", (700, 980, 850, 1010), label("Grand Total:", "total_amount"), 0.95), ("total_value", "text", (705, 1030, 900, 1060), amount("total_amount"), 0.95),
        ("pieces", "text", (60, 1100, 400, 1240), F.concat_ws("\n", first.description, first.total, first.quantity, first.rate), 0.9), ("plain", "text", (60, 1260, 1150, 1480), F.array_join(F.transform("rows", lambda r: F.concat_ws("  ", r.description, r.quantity, r.rate, r.total)), "\n"), 0.9), ("bank", "footer", (60, 1500, 900, 1540), F.concat_ws(" ", said("IFSC: ", F.col("ifsc_swift")), said("Account No: ", F.regexp_replace("bank_account", "[^0-9]", ""))), 0.9),
    ])


def printed_orders(orders: DataFrame, vendors: DataFrame) -> DataFrame:
    """Each purchase order as the regions of its printed page."""
    word = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("-")), r"[|\r\n]+", " "))
    text = lambda c, kind: c.cast(kind).cast("string")
    rows = F.transform(F.filter("line_items", lambda r: r.quantity.isNotNull() & r.unit_price.isNotNull() & r.total.isNotNull()), lambda r: F.struct(word(r.description).alias("description"), text(r.quantity, "decimal(15,4)").alias("quantity"), text(r.unit_price, "decimal(15,2)").alias("rate"), text(r.total, "decimal(15,2)").alias("total")))
    x = orders.withColumnRenamed("id", "doc_id").join(vendors.select("organization_id", F.col("id").alias("vendor_id"), "canonical_name"), ["organization_id", "vendor_id"], "left").withColumn("rows", rows)
    said = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    head = F.concat_ws("\n", said("PO Number: ", F.nullif(F.trim("po_number"), F.lit(""))), said("Order Date: ", F.date_format("po_date", "yyyy-MM-dd")), said("Currency: ", F.col("currency")))
    return _pages(x, [
        ("title", "title", (60, 40, 500, 90), F.lit("PURCHASE ORDER"), 0.99), ("head", "text", (700, 40, 1150, 200), head, 0.96), ("vendor", "text", (60, 120, 600, 200), said("Vendor:\n", word(F.col("canonical_name"))), 0.95),
        ("lines", "table", (60, 360, 1150, 900), _pipe_table(F.col("rows")), 0.9), ("total", "text", (700, 980, 1000, 1010), said("Total Amount: ", text(F.col("total_amount"), "decimal(15,2)")), 0.95),
    ])
