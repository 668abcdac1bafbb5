"""Queries over documents printed from the invoice and order records, so that what is read back has a known answer,
and over the supplied page regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import documents as docs
from ledgerloom.operators import regions as reg
from ledgerloom.queries.analytics import _inv, _lines, _po, _regions, _sql, _vendors
from ledgerloom.sources.views import printed_invoices, printed_orders


def _pages(s: SparkSession, d: str) -> DataFrame:
    return printed_invoices(_inv(s, d, "vendor_id vendor_name_raw invoice_number invoice_date due_date po_number subtotal total_amount"), _vendors(s, d, "tax_id bank_account ifsc_swift"), _lines(s, d, "invoice_id line_number description quantity unit_price total"))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return printed_orders(_po(s, d, "vendor_id po_number po_date currency total_amount line_items"), _vendors(s, d, "canonical_name"))


def _supplied(s: SparkSession, d: str) -> DataFrame:
    return _regions(s, d, "page_number region_type reading_order bbox confidence raw_ocr_output")


def printed_documents(s: SparkSession, d: str) -> DataFrame:
    """Every printed invoice read back in one chain."""
    x = docs.documents(_pages(s, d))
    return x.select("doc_id", "document_type", F.try_element_at("fields", F.lit("invoice_number")).alias("invoice_number"), F.coalesce("rows", F.lit(0)).alias("rows"), "total", "buyer")


QUERIES = {
    "document_types": lambda s, d: docs.classify(_supplied(s, d)),
    "printed_types": lambda s, d: docs.classify(_pages(s, d).unionByName(_orders(s, d))),
    "same_region_fields": lambda s, d: docs.same_region_fields(_pages(s, d)).select("doc_id", "field", "value", "region"),
    "neighbour_fields": lambda s, d: docs.neighbour_fields(_pages(s, d)).select("doc_id", "field", "value", "region"),
    "fallback_fields": lambda s, d: docs.fallback_fields(_pages(s, d)).select("doc_id", "field", "value"),
    "field_waterfall": lambda s, d: docs.field_waterfall(_pages(s, d)).groupBy("field", "method").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct")),
    "document_totals": lambda s, d: docs.derived_totals(docs.field_waterfall(_pages(s, d).filter("id not in ('total_label', 'total_value') or doc_id > 'inv_8'"))),
    "document_parties": lambda s, d: docs.parties(_pages(s, d)),
    "mapped_table_rows": lambda s, d: docs.mapped_rows(_pages(s, d)).select("doc_id", "number", "description", "quantity", "rate", "total"),
    "pieced_table_rows": lambda s, d: docs.pieced_rows(_pages(s, d)).select("doc_id", "quantity", "rate", "total"),
    "order_documents": lambda s, d: docs.order_fields(_orders(s, d)),
    "printed_documents": printed_documents,
    "printed_duplicates": lambda s, d: reg.near_duplicates(_pages(s, d)),
    "printed_suppressed": lambda s, d: reg.suppressed(reg.near_duplicates(_pages(s, d))),
    "page_routes": lambda s, d: docs.page_routes(_supplied(s, d)),
    "region_kinds": lambda s, d: _supplied(s, d).groupBy(docs.region_kind(F.col("region_type")).alias("kind")).agg(F.count("*").alias("n"), F.count(docs.clamp_box(F.col("bbox"), 600, 800)).alias("on_page")),
    "record_currencies": lambda s, d: _inv(s, d, "currency").groupBy(docs.currency_of(F.col("currency")).alias("code")).agg(F.count("*").alias("n")),
    "full_page_totals": lambda s, d: docs.full_page_totals(_pages(s, d).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "raw_ocr_output"))), lambda r: r.raw_ocr_output), "\n").alias("raw_ocr_output")).select("*", F.lit("page").alias("id"), F.lit(0).alias("reading_order"))).select("doc_id", "grand_total"),
}

_WORD = "trim(regexp_replace(coalesce({0}, '-'), '[|\r\n]+', ' ', 'g'))"
_GSTIN = "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"
_NUMBER = "nullif(regexp_extract({0}, '^[A-Za-z0-9][A-Za-z0-9_/-]*'), '')"
_I = "i AS (SELECT inv.organization_id, inv.id AS doc_id, invoice_number, trim(invoice_number) AS num, invoice_date, due_date, nullif(trim(po_number), '') AS po, subtotal, total_amount, vendor_name_raw, tax_id, nullif(regexp_replace(bank_account, '[^0-9]', '', 'g'), '') AS bank, ifsc_swift FROM inv LEFT JOIN ven v ON v.organization_id = inv.organization_id AND v.id = inv.vendor_id)"
_L = f"l AS (SELECT invoice_id AS doc_id, {_WORD.format('description')} AS description, quantity, unit_price, total, row_number() OVER (PARTITION BY organization_id, invoice_id ORDER BY line_number NULLS FIRST, id) AS number FROM lin WHERE quantity IS NOT NULL AND unit_price IS NOT NULL AND total IS NOT NULL)"
_SAME = f"""same AS (SELECT doc_id, 'invoice_number' AS field, {_NUMBER.format('num')} AS value, 'numbers' AS region FROM i UNION ALL SELECT doc_id, 'invoice_date', strftime(invoice_date, '%Y-%m-%d'), 'numbers' FROM i UNION ALL SELECT doc_id, 'po_number', {_NUMBER.format('po')}, 'numbers' FROM i
  UNION ALL SELECT doc_id, 'vendor_tax_id', nullif(regexp_extract(tax_id, '^{_GSTIN}', 0, 'i'), ''), 'seller' FROM i UNION ALL SELECT doc_id, 'bank_account', CASE WHEN length(bank) >= 9 THEN bank[1:18] END, 'bank' FROM i UNION ALL SELECT doc_id, 'ifsc_swift', nullif(regexp_extract(ifsc_swift, '^([A-Z]{{4}}0[A-Z0-9]{{6}}|[A-Z]{{6}}[A-Z0-9]{{2,5}})', 0, 'i'), ''), 'bank' FROM i)"""
_BESIDE = "beside AS (SELECT doc_id, 'due_date' AS field, strftime(due_date, '%d/%m/%Y') AS value, 'due_value' AS region FROM i UNION ALL SELECT doc_id, 'subtotal', 'INR ' || format('{:,.2f}', subtotal), 'sub_value' FROM i UNION ALL SELECT doc_id, 'total_amount', 'INR ' || format('{:,.2f}', total_amount), 'total_value' FROM i)"


def _score(kind: str, texts: str = "t") -> str:
    s = ["CASE WHEN tabular THEN 2 ELSE 0 END"] if kind in ("INVOICE", "PURCHASE_ORDER") else ["0"]
    s += [f"CASE WHEN t{i} THEN {2 * w} WHEN a{i} THEN {w} ELSE 0 END" for i, (k, w, _) in enumerate(docs.weighted(docs.TITLES)) if k == kind]
    s += [f"CASE WHEN c{i} THEN {w} ELSE 0 END" for i, (k, w, _) in enumerate(docs.weighted(docs.CONTENTS)) if k == kind]
    return " + ".join(s) + "".join(f" - CASE WHEN n{i} THEN {w} ELSE 0 END" for i, (k, w, _) in enumerate(docs.weighted(docs.AGAINST)) if k == kind)


def _classified() -> str:
    # RE2 knows no look-ahead: the end of a phrase is a word boundary or the text's next sign
    hit = lambda p: "regexp_matches(raw_ocr_output, '(?i)" + p.replace("(?!\\w)", "(?:\\W|$)") + "')"
    flags = [f"bool_or(top AND {hit(p)}) AS t{i}, bool_or({hit(p)}) AS a{i}" for i, (_, _, p) in enumerate(docs.weighted(docs.TITLES))]
    flags += [f"bool_or({hit(p)}) AS c{i}" for i, (_, _, p) in enumerate(docs.weighted(docs.CONTENTS))] + [f"bool_or(top AND {hit(p)}) AS n{i}" for i, (_, _, p) in enumerate(docs.weighted(docs.AGAINST))]
    order = list(docs.TITLES)
    best = "CASE " + " ".join(f"WHEN s_{k} >= " + "greatest(" + ", ".join(f"s_{o}" for o in order) + f") THEN '{k}'" for k in order) + " END"
    return f"""h AS (SELECT doc_id, max(bbox.y2) AS height FROM reg WHERE page_number = 1 GROUP BY 1), x AS (SELECT r.*, coalesce(page_number = 1 AND bbox.y1 <= 0.35 * height, false) AS top FROM reg r LEFT JOIN h USING (doc_id) WHERE raw_ocr_output IS NOT NULL),
    f AS (SELECT doc_id, {", ".join(flags)}, bool_or(region_type = 'table') AS tabular FROM x GROUP BY 1), sc AS (SELECT doc_id, {", ".join(f"{_score(k)} AS s_{k}" for k in order)} FROM f),
    b AS (SELECT doc_id, greatest(0, {", ".join(f"s_{k}" for k in order)}) AS score, {best} AS kind FROM sc)"""


_CLASS = "SELECT doc_id, CASE WHEN score >= 4 THEN kind ELSE 'UNKNOWN' END AS document_type, score, CASE WHEN score >= 4 THEN least(0.99, greatest(0.5, round(1 / (1 + pow(2.71828, -(score - 5) / 2.5)), 2))) ELSE round(greatest(0.1, score / 20.0), 2) END::DOUBLE AS confidence FROM b"
SQL = {
    "document_types": _sql("reg", _CLASS, _classified()),
    "printed_types": _sql(
        "inv ven lin po",
        """SELECT doc_id, kind AS document_type, score, least(0.99, greatest(0.5, round(1 / (1 + pow(2.71828, -(score - 5) / 2.5)), 2)))::DOUBLE AS confidence FROM (
        SELECT i.doc_id, 'INVOICE' AS kind, 20 + 2 + CASE WHEN num IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN invoice_date IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN tax_id IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN due_date IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.doc_id = i.doc_id) THEN 2 ELSE 0 END AS score FROM i
        UNION ALL SELECT id, 'PURCHASE_ORDER', 12 + CASE WHEN nullif(trim(po_number), '') IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN po_date IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(list_filter(line_items, lambda x: x.quantity IS NOT NULL AND x.unit_price IS NOT NULL AND x.total IS NOT NULL)) > 0 THEN 2 ELSE 0 END FROM po)""",
        _I + ", " + _L,
    ),
    "same_region_fields": _sql("inv ven", "SELECT * FROM same WHERE value IS NOT NULL", _I + ", " + _SAME),
    "neighbour_fields": _sql("inv ven", "SELECT * FROM beside WHERE value IS NOT NULL", _I + ", " + _BESIDE),
    "fallback_fields": _sql("inv ven", f"SELECT doc_id, 'vendor_tax_id' AS field, regexp_extract(tax_id, '{_GSTIN}') AS value FROM i WHERE regexp_matches(tax_id, '{_GSTIN}') UNION ALL SELECT doc_id, 'ifsc_swift', regexp_extract(ifsc_swift, '[A-Z]{{4}}0[A-Z0-9]{{6}}') FROM i WHERE regexp_matches(ifsc_swift, '[A-Z]{{4}}0[A-Z0-9]{{6}}')", _I),
    "field_waterfall": _sql("inv ven", "SELECT field, 'same_region' AS method, count(*) AS n, count(DISTINCT value) AS \"distinct\" FROM same WHERE value IS NOT NULL GROUP BY 1 UNION ALL SELECT field, 'spatial_proximity', count(*), count(DISTINCT value) FROM beside WHERE value IS NOT NULL GROUP BY 1", _I + ", " + _SAME + ", " + _BESIDE),
    "document_totals": _sql("inv ven", "SELECT doc_id, coalesce(CASE WHEN doc_id > 'inv_8' THEN total_amount END, subtotal)::DOUBLE AS total, (CASE WHEN doc_id > 'inv_8' THEN total_amount END) IS NULL AS derived FROM i WHERE coalesce(CASE WHEN doc_id > 'inv_8' THEN total_amount END, subtotal) IS NOT NULL", _I),
    "document_parties": _sql("inv ven", f"SELECT doc_id, CASE WHEN regexp_matches({_WORD.format('vendor_name_raw')}, '[A-Za-z]{{2}}') THEN {_WORD.format('vendor_name_raw')} END AS vendor, 'Branch of ' || organization_id AS buyer FROM i", _I),
    "mapped_table_rows": _sql("lin", "SELECT doc_id, number, description, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS rate, total::DOUBLE AS total FROM l", _L),
    "pieced_table_rows": _sql("lin", "SELECT doc_id, CASE WHEN abs(total * quantity - unit_price) <= greatest(1.0, 0.01 * unit_price) THEN total ELSE quantity END::DOUBLE AS quantity, CASE WHEN abs(total * quantity - unit_price) <= greatest(1.0, 0.01 * unit_price) THEN quantity ELSE unit_price END::DOUBLE AS rate, CASE WHEN abs(total * quantity - unit_price) <= greatest(1.0, 0.01 * unit_price) THEN unit_price ELSE total END::DOUBLE AS total FROM (SELECT doc_id, number, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, total::DOUBLE AS total FROM l) WHERE number = 1 AND quantity >= 0 AND (abs(quantity * unit_price - total) <= greatest(1.0, 0.01 * total) OR abs(total * quantity - unit_price) <= greatest(1.0, 0.01 * unit_price) OR abs(total * unit_price - quantity) <= greatest(1.0, 0.01 * quantity))", _L),
    "order_documents": _sql("po ven", f"""SELECT po.id AS doc_id, {_NUMBER.format("nullif(trim(po_number), '')")} AS po_number, strftime(po_date, '%Y-%m-%d') AS po_date, currency, {_WORD.format('canonical_name')} AS vendor, coalesce(total_amount::DOUBLE, t) AS total, n AS lines, t AS line_total FROM
      (SELECT *, len(k) AS n, CASE WHEN len(k) > 0 THEN round(list_sum(list_transform(k, lambda x: x.total::DOUBLE)), 2) END AS t FROM (SELECT *, list_filter(line_items, lambda x: x.quantity IS NOT NULL AND x.unit_price IS NOT NULL AND x.total IS NOT NULL) AS k FROM po)) po LEFT JOIN ven v ON v.organization_id = po.organization_id AND v.id = po.vendor_id"""),
    "printed_documents": _sql("inv ven lin", f"SELECT doc_id, 'INVOICE' AS document_type, {_NUMBER.format('num')} AS invoice_number, (SELECT count(*) FROM l WHERE l.doc_id = i.doc_id) AS rows, coalesce(total_amount, subtotal)::DOUBLE AS total, 'Branch of ' || organization_id AS buyer FROM i", _I + ", " + _L),
    "printed_duplicates": _sql("inv ven", "SELECT doc_id, 'numbers_again' AS suppressed, 'numbers' AS kept, 'exact_duplicate_with_spatial_proximity' AS rule FROM i WHERE num IS NOT NULL OR invoice_date IS NOT NULL OR po IS NOT NULL", _I),
    "printed_suppressed": _sql("inv ven", "SELECT doc_id, 'numbers_again' AS id FROM i WHERE num IS NOT NULL OR invoice_date IS NOT NULL OR po IS NOT NULL", _I),
    "page_routes": _sql(
        "reg",
        "SELECT doc_id, page_number, regions, coverage, largest, CASE WHEN regions = 0 OR coverage < 0.4 THEN 'full_page' ELSE 'hybrid' END AS mode, CASE WHEN regions = 0 THEN 'no_layout_regions' WHEN coverage < 0.4 THEN 'low_layout_coverage' ELSE 'sufficient_layout_coverage' END AS reason FROM (SELECT n.doc_id, n.page_number, regions, coalesce(coverage, 0.0)::DOUBLE AS coverage, largest FROM n LEFT JOIN c USING (doc_id, page_number))",
        """k AS (SELECT doc_id, page_number, greatest(0, least(1200, bbox.x1)) AS x1, greatest(0, least(1600, bbox.y1)) AS y1, greatest(0, least(1200, bbox.x2)) AS x2, greatest(0, least(1600, bbox.y2)) AS y2 FROM reg WHERE page_number IS NOT NULL),
        g AS (SELECT *, x2 - x1 > 2 AND y2 - y1 > 2 AND (x2 - x1) * (y2 - y1) > 4 AS ok FROM k), n AS (SELECT doc_id, page_number, count_if(ok) AS regions, (coalesce(max((x2 - x1) * (y2 - y1)) FILTER (ok), 0)::DOUBLE / 1920000.0::DOUBLE) AS largest FROM g GROUP BY 1, 2),
        cx AS (SELECT doc_id, page_number, y1, y2, unnest(range(x1 // 20, (x2 - 1) // 20 + 1)) AS cx FROM g WHERE ok), cc AS (SELECT DISTINCT doc_id, page_number, cx, unnest(range(y1 // 20, (y2 - 1) // 20 + 1)) AS cy FROM cx), c AS (SELECT doc_id, page_number, (count(*)::DOUBLE / 4800.0::DOUBLE) AS coverage FROM cc GROUP BY 1, 2)""",
    ),
    "region_kinds": _sql("reg", "SELECT CASE WHEN region_type IN ('other') OR region_type IS NULL THEN 'other' ELSE region_type END AS kind, count(*) AS n, count_if(least(600, bbox.x2) - least(600, greatest(0, bbox.x1)) > 2 AND least(800, bbox.y2) - least(800, greatest(0, bbox.y1)) > 2) AS on_page FROM reg GROUP BY 1"),
    "record_currencies": _sql("inv", r"SELECT CASE WHEN contains(c, '₹') OR regexp_matches(c, '\b(inr|gstin|cgst|sgst|ifsc|rupees|udyam|rs)\b') OR contains(c, 'rs.') THEN 'INR' WHEN contains(c, '$') OR regexp_matches(c, '\busd\b') THEN 'USD' WHEN contains(c, '€') OR regexp_matches(c, '\beur\b') THEN 'EUR' WHEN contains(c, '£') OR regexp_matches(c, '\bgbp\b') THEN 'GBP' ELSE 'INR' END AS code, count(*) AS n FROM (SELECT lower(currency) AS c FROM inv) GROUP BY 1"),
    "full_page_totals": _sql("inv ven", "SELECT doc_id, total_amount::DOUBLE AS grand_total FROM i", _I),
}
