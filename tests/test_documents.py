"""Documents from regions: small made-up pages with known answers."""

from pyspark.sql import functions as F

from ledgerloom.operators import documents as d
from ledgerloom.operators import extraction, regions

SCHEMA = "doc_id string, page_number int, id string, region_type string, reading_order int, bbox struct<x1:int,y1:int,x2:int,y2:int>, confidence double, raw_ocr_output string, value string"


def pages(spark, *rows):
    return spark.createDataFrame([(doc, 1, i, kind, n, box, 0.9, text, "clash") for n, (doc, i, kind, box, text) in enumerate(rows)], SCHEMA)


def test_kinds(spark):
    x = pages(
        spark, ("a", "1", "title", (0, 0, 10, 10), "Tax Invoice"), ("a", "2", "table", (0, 900, 10, 1000), "Purchase Order No"), ("b", "1", "text", (0, 0, 10, 10), "CREDIT NOTE"), ("b", "2", "text", (0, 900, 10, 1000), "original invoice no 7"),
        ("c", "1", "text", None, None), ("d", "1", "text", (0, 0, 9, 9), "hello"), ("e", "1", "text", (0, 990, 10, 1000), "bill"), ("f", "1", "text", (0, 0, 10, 1000), "x" * 30000),
    )
    got = {r.doc_id: (r.document_type, r.score) for r in d.classify(x).collect()}
    # a: 2 x (6 + 4) + table 2; b: 2 x 7 + 3; invoices lose 5 for the note, get 4 + 0 for "invoice" in the text
    assert got == {"a": ("INVOICE", 22), "b": ("CREDIT_NOTE", 17), "d": ("UNKNOWN", 0), "e": ("INVOICE", 4), "f": ("UNKNOWN", 0)}
    assert d.classify(x.limit(0)).count() == 0


def test_fields(spark):
    x = pages(
        spark, ("a", "1", "text", (0, 0, 100, 20), "Invoice No: INV-4491\nInvoice Date: 25/12/2025"), ("a", "2", "text", (0, 30, 100, 50), "Invoice No: INV-9\nTotal Amount: ₹45,000.00"), ("a", "3", "text", (0, 200, 100, 220), "Due Date:"), ("a", "4", "text", (120, 202, 220, 222), "1/2/2026"),
        ("a", "5", "text", (110, 500, 220, 520), "9/9/2026"), ("b", "1", "text", (0, 0, 9, 9), "GSTIN 29ABCDE1234F1ZW mail x@y.example 29ABCDE1234F1ZW 07ABCDE1234F1ZW"), ("c", "1", "text", None, "Sub Total: 100\nTax Amount: 18\nDiscount: 8"), ("d", "1", "text", None, None), ("e", "1", "text", (0, 0, 9, 9), ""),
    )
    same = {(r.doc_id, r.field): (r.value, r.region) for r in d.same_region_fields(x).collect()}
    assert same["a", "invoice_number"] == ("INV-4491", "1") and same["a", "invoice_date"] == ("25/12/2025", "1") and same["a", "total_amount"] == ("₹45,000.00", "2")
    assert {(r.doc_id, r.field, r.value) for r in d.neighbour_fields(x).collect()} == {("a", "due_date", "1/2/2026")}
    assert {(r.doc_id, r.field, r.value) for r in d.fallback_fields(x).collect() if r.doc_id == "b"} == {("b", "vendor_tax_id", "29ABCDE1234F1ZW"), ("b", "buyer_tax_id", "07ABCDE1234F1ZW"), ("b", "email", "x@y.example")}
    got = {(r.doc_id, r.field): (r.method, r.score) for r in d.field_waterfall(x).collect()}
    assert got["a", "due_date"][0] == "spatial_proximity" and got["a", "invoice_number"] == ("same_region", 0.95) and got["b", "buyer_tax_id"] == ("regex_fallback", 0.85)
    totals = {r.doc_id: (r.total, r.derived) for r in d.derived_totals(d.field_waterfall(x)).collect()}
    assert totals == {"a": (45000.0, False), "c": (110.0, True)}
    empty = x.limit(0)
    assert d.field_waterfall(empty).count() == 0 and d.documents(empty).count() == 0


def test_tables_and_pieces(spark):
    x = pages(
        spark, ("a", "1", "table", None, "| Item | Qty | Unit Price | Amount |\n|---|---|---|---|\n| Bolt | 2 | 3.50 | 7.00 |\n| Nut | 1.5 | 1,000 | 1,500 |"), ("a", "2", "table", None, "| x | y |\n| 1 | 2 |"), ("a", "3", "table", None, "| Amount | Description |\n| 9 | Late |"),
        ("b", "1", "text", None, "Bush 12MM\n18832.50\n5022\n3.75\nTotal"), ("b", "2", "text", None, "MS BUSH 12MM 5022.00 3.75 18832.50\n1 2 3\nOdd 2 3 7000"), ("c", "1", "text", None, None),
    )
    rows = [(r.number, r.description, r.quantity, r.rate, r.total) for r in d.mapped_rows(x).orderBy("number").collect()]
    assert rows == [(1, "Bolt", 2.0, 3.5, 7.0), (2, "Nut", 1.5, 1000.0, 1500.0), (3, "Late", None, None, 9.0)]
    assert [(r.description, r.quantity, r.rate, r.total) for r in d.pieced_rows(x).collect()] == [("Bush 12MM", 5022.0, 3.75, 18832.5)]
    assert [(r.description, r.quantity, r.total) for r in extraction.plain_rows(x, "doc_id", "raw_ocr_output").collect()] == [("MS BUSH 12MM", 5022.0, 18832.5)]
    taxes = d.full_page_totals(pages(spark, ("a", "1", "text", None, "Grand Total: 10.00\nCGST 9%: 4.50\nSGST 9%: 4.50\nGrand Total: INR 118.00"), ("b", "1", "text", None, "nothing"))).collect()
    assert {r.doc_id: (r.grand_total, r.tax_lines) for r in taxes} == {"a": (118.0, 9.0), "b": (None, 0.0)}


def test_parties_pages_and_routes(spark):
    x = pages(spark, ("a", "1", "title", (0, 0, 10, 20), "TAX INVOICE"), ("a", "2", "text", (0, 30, 10, 60), "Acme Freight Ltd\nGSTIN: 29ABCDE1234F1ZW"), ("a", "3", "text", (0, 900, 10, 1000), "Bill To:\nBeta Works"), ("b", "1", "text", (0, 0, 10, 10), "Vendor:\nGamma Ltd"))
    assert {r.doc_id: (r.vendor, r.buyer) for r in d.parties(x).collect()} == {"a": ("Acme Freight Ltd", "Beta Works"), "b": ("Gamma Ltd", None)}
    whole = d.whole_pages(x, spark.createDataFrame([("a", 1, "full_page", "t"), ("z", 3, "full_page", "text"), ("y", 1, "hybrid", "text")], "doc_id string, page_number int, mode string, text string"))
    assert [(r.id, r.confidence) for r in whole.filter("doc_id in ('z', 'y')").collect()] == [("p3_fullpage", 0.8)]
    big = pages(spark, ("a", "1", "text", (-50, 0, 1300, 800), "x"), ("a", "2", "text", (0, 0, 1200, 900), "x"), ("b", "1", "text", (5, 5, 6, 6), "x"), ("c", "1", "text", (0, 0, 100, 100), "x"))
    got = {r.doc_id: (r.regions, round(r.coverage, 4), r.mode, r.reason) for r in d.page_routes(big).collect()}
    assert got == {"a": (2, 0.5625, "hybrid", "sufficient_layout_coverage"), "b": (0, 0.0, "full_page", "no_layout_regions"), "c": (1, 0.0052, "full_page", "low_layout_coverage")}
    assert d.page_routes(big, mode="hybrid").filter("mode <> 'hybrid'").count() == 0


def test_small_functions(spark):
    df = spark.createDataFrame([("Doc-Title", "Rs. 5"), ("seal", "ten hours"), (None, None), ("Footnote", "US$ 7"), ("math", "£3")], "label string, text string")
    assert [r.k for r in df.select(d.region_kind(F.col("label")).alias("k")).collect()] == ["title", "other", "other", "text", "equation"]
    assert [r.c for r in df.select(d.currency_of(F.col("text")).alias("c")).collect()] == ["INR", "INR", "INR", "USD", "GBP"]
    boxes = spark.createDataFrame([((-5, 2, 30, 40),), ((0, 0, 2, 90),), ((99, 0, 500, 5),)], "b struct<x1:int,y1:int,x2:int,y2:int>")
    assert [r.c and tuple(r.c) for r in boxes.select(d.clamp_box(F.col("b"), 100, 100).alias("c")).collect()] == [(0, 2, 30, 40), None, None]
    rows = pages(spark, *[("a", str(i), "text", (0, y, 10, y + 40), "x") for i, y in enumerate((0, 10, 24, 60, 85))])
    assert [r.row for r in regions.merge_rows(rows).orderBy("id").collect()] == [1, 1, 1, 2, 3]


def test_text_cleaning(spark):
    from ledgerloom.functions.text import clean_ocr, normalize_amount

    dirty = "<|det|>[[1, 2, 3, 4]]<|/det|>Total <|ref|>here<|/ref|> [[5,6,7,8]]  \nnext\t"
    assert spark.createDataFrame([(dirty,), (None,)], "t string").select(clean_ocr(F.col("t")).alias("t")).collect()[0].t == "Total here\nnext"
    amounts = [("2.5 lakh", 250000.0), ("₹1.2 crore", 12000000.0), ("1.234,56", 1234.56), ("12,34,567.80", 1234567.8), ("Rs. 500/-", 500.0), ("-3,5", -3.5), ("none", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in amounts], "t string").select(normalize_amount(F.col("t")).cast("double").alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in amounts]
