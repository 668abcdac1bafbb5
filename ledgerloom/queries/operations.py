"""Registered uses of the operations, over all organisations, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import operations as ops
from ledgerloom.operators import records, vectors
from ledgerloom.operators.records import money
from ledgerloom.queries.analytics import AS_OF, PERIOD_A, PERIOD_B, _aliases, _fields, _inv, _lines, _links, _po, _sql, _TAX, _vendors
from ledgerloom.session import table

NAMES = "vendor_id vendor_name_raw vendor_name_normalized"
SINCE = 1_735_689_600  # 2025-01-01 UTC
START, END = PERIOD_A[0], PERIOD_B[1]


def _findings(s: SparkSession, d: str) -> DataFrame:
    dup = records.duplicate_invoices(_inv(s, d, "invoice_number vendor_id vendor_name_raw seq"))
    odd = records.amount_outliers(_inv(s, d, "vendor_id total_amount"))
    return ops.findings(dup, odd, _links(s, d, "link_type source_type source_id status"), _inv(s, d, "total_amount"))


def invoices_twice(s: SparkSession, d: str, columns: str) -> DataFrame:
    """The invoices and all of them once more under another id: the supplied ones repeat no number."""
    x = _inv(s, d, columns)
    return x.unionByName(x.withColumn("id", F.concat("id", F.lit("_again"))).withColumn("seq", F.col("seq") + 10_000_000))


def order_details(s: SparkSession, d: str) -> DataFrame:
    x = ops.order_detail(_po(s, d, "po_number line_items"), _links(s, d, "link_type source_id target_id"))
    lines = F.aggregate("line_items", F.lit(0.0), lambda a, i: a + F.coalesce(i.total.cast("double"), F.lit(0.0)))
    return x.select("organization_id", "id", "po_number", F.size("line_items").alias("lines"), F.round(lines, 2).alias("line_total"), F.array_join("invoices", ",").alias("invoices"))


def invoice_details(s: SparkSession, d: str) -> DataFrame:
    """Every invoice with its vendor, aliases, lines, fields, orders and payments (nested)."""
    x = ops.invoice_detail(
        _inv(s, d, "vendor_id document_id"), _lines(s, d, "invoice_id product_code quantity total"), _fields(s, d, "document_id field_name field_value"), _links(s, d, "link_type source_id target_id status"),
        _vendors(s, d, "canonical_name"), _aliases(s, d, "vendor_id alias_name"),
    )
    join = lambda c, f: F.array_join(F.transform(c, f), ",", "")
    return x.select(
        "organization_id", "id", "canonical_name", F.coalesce(join("lines", lambda r: r.id), F.lit("")).alias("lines"), F.coalesce(join("fields", lambda r: F.concat(r.field_name, F.lit(":"), r.id)), F.lit("")).alias("fields"),
        F.coalesce(F.size("aliases"), F.lit(0)).alias("aliases"), F.coalesce(F.size("orders"), F.lit(0)).alias("orders"), F.coalesce(F.size("payments"), F.lit(0)).alias("payments"),
    )


def vendor_cascade(s: SparkSession, d: str) -> DataFrame:
    """The vendors received since a day against those received before."""
    v = records.records(s, d, "vendor", "tax_id bank_account ifsc_swift normalized_name ingested_at")
    since = F.col("ingested_at") >= F.timestamp_seconds(F.lit(SINCE))
    return records.resolve_cascade(v.filter(since), v.filter(~since), _aliases(s, d, "vendor_id normalized_alias"))


def mentioned_vendors(s: SparkSession, d: str) -> DataFrame:
    """The vendor an invoice's printed name mentions."""
    return ops.longest_mentions(_inv(s, d, "vendor_name_normalized").withColumnRenamed("vendor_name_normalized", "text"), _vendors(s, d, "normalized_name"))


def vector_stats(s: SparkSession, d: str) -> DataFrame:
    return vectors.stats(table(s, d, "chunk").select("chunk_id", "document_id", "organization_id", "chunk_type").distinct())


QUERIES = {
    "named_vendor_spend": lambda s, d: ops.vendor_total_spend(_inv(s, d, NAMES + " invoice_date total_amount"), vendor_name=" An", start=START, end=END),
    "named_vendor_spend_wildcards": lambda s, d: ops.vendor_total_spend(_inv(s, d, NAMES + " invoice_date total_amount"), vendor_name="&"),
    "monthly_spend_since": lambda s, d: ops.monthly_vendor_spend(_inv(s, d, NAMES + " invoice_date total_amount"), vendor_name="foods", start=START),
    "organization_invoice_counts": lambda s, d: ops.vendor_invoice_count(_inv(s, d, "vendor_id")),
    "unpaid_page": lambda s, d: ops.unpaid_invoices(_inv(s, d, NAMES + " payment_status amount_due ingested_at")),
    "overdue_page": lambda s, d: ops.overdue_invoices(_inv(s, d, "payment_status due_date"), AS_OF),
    "top_vendors_as_written": lambda s, d: ops.top_vendors(_inv(s, d, NAMES + " invoice_date total_amount"), start=START, end=END),
    "spend_by_vendor": lambda s, d: ops.spend_by_vendor(_inv(s, d, "vendor_name_normalized total_amount")),
    "period_second_page": lambda s, d: ops.invoices_for_period(_inv(s, d, "vendor_id invoice_date"), START, END, limit=20, offset=20),
    "overdue_lines": lambda s, d: ops.line_items(_lines(s, d, "invoice_id product_code quantity unit_price total"), records.overdue_invoices(_inv(s, d, "payment_status due_date total_amount"), AS_OF)),
    "numbered_lines": lambda s, d: ops.numbered_lines(_lines(s, d, "invoice_id line_number")),
    "order_details": order_details,
    "invoice_details": invoice_details,
    "vendor_search": lambda s, d: ops.vendor_search(_vendors(s, d, "canonical_name normalized_name tax_id"), "GU"),
    "order_by_number": lambda s, d: ops.lookup(_po(s, d, "po_number ingested_at").filter("po_number is not null"), order="ingested_at").select("organization_id", "id", F.trim("po_number").alias("po_number")),
    "approved_matches": lambda s, d: ops.scoped_list(records.records(s, d, "possible_match", "matched_vendor_id candidate_name status ingested_at"), [F.desc("ingested_at"), F.asc("id")], {"status": "approved"}).select("organization_id", "id", "matched_vendor_id", "place"),
    "unresolved_order_links": lambda s, d: ops.scoped_list(_links(s, d, "link_type status source_id"), [F.asc("id")], {"status": "unresolved"}, link_type="INVOICE_TO_PO").select("organization_id", "id", "source_id", "place"),
    "findings": _findings,
    "ranked_findings": lambda s, d: ops.ranked_findings(_findings(s, d)),
    "vendor_findings": lambda s, d: ops.findings_of_vendor(_findings(s, d), _inv(s, d, "vendor_id")).groupBy("organization_id", "kind").agg(F.count("*").alias("n")),
    "period_findings": lambda s, d: ops.findings_in_period(_findings(s, d), _inv(s, d, "invoice_date"), START, END).groupBy("organization_id", "kind").agg(F.count("*").alias("n")),
    "flagged_outliers": lambda s, d: ops.flagged(records.amount_outliers(_inv(s, d, "vendor_id total_amount")), _inv(s, d, "invoice_date"), START, END),
    "evidence_confidence": lambda s, d: ops.mean_confidence(_fields(s, d, "document_id confidence")),
    "vendor_cascade": vendor_cascade,
    "mentioned_vendors": mentioned_vendors,
    "changed_products": lambda s, d: ops.new_and_removed(_lines(s, d, "invoice_id product_code total"), _inv(s, d, "vendor_id invoice_date"), PERIOD_A, PERIOD_B),
    "spend_change": lambda s, d: records.compare_spend(_inv(s, d, "vendor_id invoice_date total_amount"), PERIOD_A, PERIOD_B).select("organization_id", "vendor_id", ops.change_pct(F.col("spend_a"), F.col("spend_b")).alias("change_pct")),
    "repeated_invoices": lambda s, d: records.duplicate_invoices(invoices_twice(s, d, "invoice_number vendor_id vendor_name_raw seq")),
    "vector_stats": vector_stats,
}

_NAMED = "(contains(lower(vendor_name_normalized), '{0}') OR contains(lower(vendor_name_raw), '{0}'))"
_PERIOD = f"invoice_date BETWEEN DATE '{START}' AND DATE '{END}'"
_OPEN = "lower(payment_status) IN ('unpaid', 'pending', 'partially_paid')"
_SHOWN = "coalesce(nullif(vendor_name_raw, ''), nullif(vendor_name_normalized, ''), 'Unknown')"
_INV = """inv0 AS (SELECT * EXCLUDE (ingested_at, seq), min(seq) AS seq, min(ingested_at) AS ingested_at FROM invoice GROUP BY ALL)"""
_ODD = """s AS (SELECT organization_id, vendor_id, count(*) - 1 AS n, sum(total_amount::DOUBLE) AS s1, sum(total_amount::DOUBLE * total_amount::DOUBLE) AS s2 FROM inv WHERE vendor_id IS NOT NULL AND total_amount IS NOT NULL GROUP BY ALL HAVING count(*) - 1 >= 5),
m AS (SELECT i.organization_id, i.id, i.invoice_date, total_amount::DOUBLE AS a, n, (s1 - total_amount::DOUBLE) / n AS mean, s2 FROM inv i JOIN s USING (organization_id, vendor_id) WHERE total_amount IS NOT NULL),
sd AS (SELECT *, sqrt(greatest(0.0, (s2 - a * a - n * mean * mean) / (n - 1))) AS sd FROM m),
odd AS (SELECT organization_id, id, invoice_date, round((a - mean) / sd, 2) AS z_score FROM sd WHERE sd > 0 AND abs(round((a - mean) / sd, 2)) > 2.5)"""
_FOUND = _ODD + """,
dupk AS (SELECT organization_id, invoice_number, id, seq, unnest(list_filter([('v' || vendor_id), ('n' || trim(lower(vendor_name_raw)))], lambda k: k IS NOT NULL)) AS key FROM inv WHERE invoice_number IS NOT NULL),
dup AS (SELECT organization_id, id, first_value(id) OVER w AS o, row_number() OVER w AS rn FROM dupk WINDOW w AS (PARTITION BY organization_id, invoice_number, key ORDER BY seq, id)),
found AS (SELECT f.organization_id, f.invoice_id, f.kind, coalesce(i.total_amount::DOUBLE, 0.0) AS impact, f.detail FROM (
  SELECT organization_id, id AS invoice_id, 'DUPLICATE' AS kind, '{"original_id":"' || min(o) || '"}' AS detail FROM dup WHERE rn > 1 GROUP BY ALL
  UNION SELECT organization_id, id, 'OUTLIER', '{"kind":"' || CASE WHEN z_score > 0 THEN 'HIGH' ELSE 'LOW' END || '"}' FROM odd
  UNION SELECT organization_id, source_id, 'UNRESOLVED_LINK', '{"link_type":"' || link_type || '"}' FROM lnk WHERE source_type = 'INVOICE' AND upper(status) = 'UNRESOLVED') f
  LEFT JOIN inv i ON i.organization_id = f.organization_id AND i.id = f.invoice_id)"""


def _paged(body: str, order: str, columns: str, limit: int, offset: int = 0) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY {order}) AS place, count(*) OVER (PARTITION BY organization_id) AS total FROM ({body})) WHERE place > {offset} AND place <= {offset + limit}"


_SPEND = "SELECT organization_id, coalesce(sum(total_amount), 0)::DOUBLE AS total_spend, count(*) AS invoices FROM inv WHERE "
SQL = {
    "named_vendor_spend": _sql("inv", _SPEND + _NAMED.format("an") + f" AND {_PERIOD} GROUP BY 1"),
    "named_vendor_spend_wildcards": _sql("inv", _SPEND + _NAMED.format("&") + " GROUP BY 1"),
    "monthly_spend_since": _sql("inv", "SELECT organization_id, strftime(invoice_date, '%Y-%m') AS month, sum(total_amount)::DOUBLE AS spend FROM inv WHERE total_amount <> 0 AND " + _NAMED.format("foods") + f" AND invoice_date >= DATE '{START}' GROUP BY ALL"),
    "organization_invoice_counts": _sql("inv", "SELECT organization_id, count(*) AS invoices FROM inv GROUP BY 1"),
    "unpaid_page": "WITH " + _INV + " " + _paged(f"SELECT * FROM inv0 WHERE {_OPEN}", "ingested_at DESC NULLS LAST, id", f"organization_id, id, place, total, {_SHOWN} AS vendor, amount_due::DOUBLE AS amount_due", 100),
    "overdue_page": _sql("inv", _paged(f"SELECT * FROM inv WHERE {_OPEN} AND due_date < DATE '{AS_OF}'", "due_date, id", f"organization_id, id, place, total, datediff('day', due_date, DATE '{AS_OF}') AS days_overdue", 100)),
    "top_vendors_as_written": _sql("inv", _paged(f"SELECT organization_id, vendor_id, vendor_name_raw, vendor_name_normalized, sum(total_amount) AS s, count(*) AS invoices FROM inv WHERE {_PERIOD} GROUP BY ALL", "s DESC NULLS LAST, vendor_id NULLS LAST, vendor_name_raw NULLS LAST, vendor_name_normalized NULLS LAST", f"organization_id, vendor_id, {_SHOWN} AS vendor, s::DOUBLE AS spend, invoices, place", 5)),
    "spend_by_vendor": _sql("inv", _paged("SELECT organization_id, coalesce(vendor_name_normalized, 'Unknown') AS vendor, sum(total_amount) AS s, count(*) AS invoices FROM inv GROUP BY ALL", "s DESC NULLS LAST, vendor", "organization_id, vendor, s::DOUBLE AS spend, invoices, place", 10)),
    "period_second_page": _sql("inv", _paged(f"SELECT * FROM inv WHERE {_PERIOD}", "invoice_date DESC NULLS LAST, id", "organization_id, id, invoice_date, place, total", 20, 20)),
    "overdue_lines": _sql("inv lin", f"SELECT organization_id, invoice_id, id, product_code, coalesce(nullif(quantity::DOUBLE, 0), 1.0) AS quantity, coalesce(nullif(unit_price::DOUBLE, 0), 0.0) AS unit_price, coalesce(nullif(total::DOUBLE, 0), 0.0) AS total FROM lin WHERE (organization_id, invoice_id) IN (SELECT (organization_id, id) FROM inv WHERE {_OPEN} AND due_date < DATE '{AS_OF}')"),
    "numbered_lines": _sql("lin", "SELECT organization_id, invoice_id, id, row_number() OVER (PARTITION BY organization_id, invoice_id ORDER BY line_number NULLS LAST, id) AS number FROM lin"),
    "order_details": _sql("po lnk", "SELECT organization_id, id, trim(po_number) AS po_number, len(line_items) AS lines, round(coalesce(list_sum(list_transform(line_items, lambda x: coalesce(x.total::DOUBLE, 0.0))), 0.0), 2) AS line_total, coalesce(invoices, '') AS invoices FROM po LEFT JOIN (SELECT organization_id, target_id AS id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS invoices FROM lnk WHERE link_type = 'INVOICE_TO_PO' AND target_id IS NOT NULL GROUP BY 1, 2) USING (organization_id, id)"),
    "invoice_details": _sql(
        "inv lin fld lnk ven ali",
        """SELECT i.organization_id, i.id, v.canonical_name, coalesce(l.x, '') AS lines, coalesce(f.x, '') AS fields, coalesce(a.n, 0) AS aliases, coalesce(o.n, 0) AS orders, coalesce(p.n, 0) AS payments FROM inv i
        LEFT JOIN ven v ON v.organization_id = i.organization_id AND v.id = i.vendor_id
        LEFT JOIN (SELECT organization_id, invoice_id AS id, string_agg(id, ',' ORDER BY id) AS x FROM lin GROUP BY 1, 2) l ON l.organization_id = i.organization_id AND l.id = i.id
        LEFT JOIN (SELECT organization_id, document_id, string_agg(field_name || ':' || id, ',' ORDER BY field_name, id) AS x FROM fld GROUP BY 1, 2) f ON f.organization_id = i.organization_id AND f.document_id = i.document_id
        LEFT JOIN (SELECT organization_id, vendor_id, count(DISTINCT alias_name) AS n FROM ali WHERE vendor_id IS NOT NULL GROUP BY 1, 2) a ON a.organization_id = v.organization_id AND a.vendor_id = v.id
        LEFT JOIN (SELECT organization_id, source_id AS id, count(DISTINCT (target_id, status)) AS n FROM lnk WHERE link_type = 'INVOICE_TO_PO' GROUP BY 1, 2) o ON o.organization_id = i.organization_id AND o.id = i.id
        LEFT JOIN (SELECT organization_id, target_id AS id, count(DISTINCT (source_id, status)) AS n FROM lnk WHERE link_type = 'PAYMENT_TO_INVOICE' AND target_id IS NOT NULL GROUP BY 1, 2) p ON p.organization_id = i.organization_id AND p.id = i.id""",
    ),
    "vendor_search": _sql("ven", _paged("SELECT * FROM ven WHERE contains(lower(canonical_name), 'gu') OR contains(lower(normalized_name), 'gu') OR contains(lower(tax_id), 'gu')", "canonical_name NULLS LAST, id", "organization_id, id, canonical_name, place, total", 50)),
    "order_by_number": _sql("po", "SELECT organization_id, id, trim(po_number) AS po_number FROM po WHERE po_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY ingested_at, id) = 1"),
    "approved_matches": "SELECT organization_id, id, matched_vendor_id, row_number() OVER (PARTITION BY organization_id ORDER BY t DESC, id) AS place FROM (SELECT organization_id, id, matched_vendor_id, candidate_name, status, min(ingested_at) AS t FROM possible_match GROUP BY ALL) WHERE upper(status) = 'APPROVED'",
    "unresolved_order_links": _sql("lnk", "SELECT organization_id, id, source_id, row_number() OVER (PARTITION BY organization_id ORDER BY id) AS place FROM lnk WHERE link_type = 'INVOICE_TO_PO' AND upper(status) = 'UNRESOLVED'"),
    "findings": _sql("inv lnk", "SELECT * FROM found", _FOUND),
    "ranked_findings": _sql("inv lnk", _paged("SELECT * FROM found", "impact DESC, invoice_id, kind", "organization_id, invoice_id, kind, impact, place, total", 50), _FOUND),
    "vendor_findings": _sql("inv lnk", "SELECT organization_id, kind, count(*) AS n FROM found WHERE (organization_id, invoice_id) IN (SELECT (organization_id, id) FROM inv WHERE vendor_id IS NOT NULL) GROUP BY 1, 2", _FOUND),
    "period_findings": _sql("inv lnk", f"SELECT organization_id, kind, count(*) AS n FROM found WHERE (organization_id, invoice_id) IN (SELECT (organization_id, id) FROM inv WHERE {_PERIOD}) GROUP BY 1, 2", _FOUND),
    "flagged_outliers": _sql("inv", f"SELECT organization_id, id, z_score, CASE WHEN {_PERIOD} THEN 'CONFIRMED' ELSE 'SUPPORTED' END AS state FROM odd", _ODD),
    "evidence_confidence": _sql("fld", "SELECT document_id, count(*) AS evidence, round(avg(confidence::DOUBLE), 6) AS confidence FROM fld GROUP BY 1"),
    "vendor_cascade": _sql(
        "ali",
        f"""SELECT x.organization_id, x.id, coalesce(t.id, b.id, n.id, a.id) AS vendor_id, CASE WHEN t.id IS NOT NULL THEN 'TAX_ID' WHEN b.id IS NOT NULL THEN 'BANK_ACCOUNT' WHEN n.id IS NOT NULL THEN 'NORMALIZED_NAME' WHEN a.id IS NOT NULL THEN 'ALIAS' ELSE 'NEW_VENDOR' END AS match_type FROM late x
        LEFT JOIN (SELECT x.id AS xid, x.organization_id AS o, min(k.id) AS id FROM late x JOIN early k ON k.organization_id = x.organization_id AND k.tax = x.tax GROUP BY 1, 2) t ON t.xid = x.id AND t.o = x.organization_id
        LEFT JOIN (SELECT x.id AS xid, x.organization_id AS o, min(k.id) AS id FROM late x JOIN early k ON k.organization_id = x.organization_id AND k.bank = x.bank AND (x.code IS NULL OR k.code IS NULL OR x.code = k.code) GROUP BY 1, 2) b ON b.xid = x.id AND b.o = x.organization_id
        LEFT JOIN (SELECT organization_id, normalized_name AS name, min(id) AS id FROM early GROUP BY 1, 2) n ON n.organization_id = x.organization_id AND n.name = x.normalized_name
        LEFT JOIN (SELECT organization_id, normalized_alias AS name, min(vendor_id) AS id FROM ali WHERE vendor_id IS NOT NULL GROUP BY 1, 2) a ON a.organization_id = x.organization_id AND a.name = x.normalized_name""",
        f"""v0 AS (SELECT *, {_TAX} AS tax, CASE WHEN length(regexp_replace(bank_account, '[^0-9]', '', 'g')) >= 9 THEN regexp_replace(bank_account, '[^0-9]', '', 'g') END AS bank, upper(trim(ifsc_swift)) AS code FROM (SELECT * EXCLUDE (ingested_at), min(ingested_at) AS ingested_at FROM vendor GROUP BY ALL)),
        early AS (SELECT * FROM v0 WHERE epoch_us(ingested_at) < {SINCE}000000), late AS (SELECT * FROM v0 WHERE epoch_us(ingested_at) >= {SINCE}000000)""",
    ),
    "mentioned_vendors": _sql(
        "inv ven",
        """SELECT organization_id, id, vendor_id, name FROM (SELECT t.organization_id, t.id, v.vendor_id, v.name, row_number() OVER (PARTITION BY t.organization_id, t.id ORDER BY length(v.name) DESC, v.vendor_id) AS rn FROM
        (SELECT organization_id, id, trim(regexp_replace(lower(vendor_name_normalized), '[^a-z0-9]+', ' ', 'g')) AS plain FROM inv WHERE vendor_name_normalized IS NOT NULL) t
        JOIN (SELECT organization_id, id AS vendor_id, trim(regexp_replace(lower(normalized_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM ven) v ON v.organization_id = t.organization_id AND v.name <> '' AND contains(' ' || t.plain || ' ', ' ' || v.name || ' ')) WHERE rn = 1""",
    ),
    "changed_products": _sql(
        "inv lin",
        f"""SELECT organization_id, vendor_id, product_code, CASE WHEN b = 0 THEN 'NEW' ELSE 'REMOVED' END AS change, total FROM (SELECT l.organization_id, i.vendor_id, l.product_code, count_if(i.p = 'b') AS b, count_if(i.p = 'a') AS a, coalesce(sum(l.total), 0)::DOUBLE AS total FROM lin l
        JOIN (SELECT *, CASE WHEN invoice_date BETWEEN DATE '{PERIOD_A[0]}' AND DATE '{PERIOD_A[1]}' THEN 'b' WHEN invoice_date BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{PERIOD_B[1]}' THEN 'a' END AS p FROM inv WHERE vendor_id IS NOT NULL) i ON i.organization_id = l.organization_id AND i.id = l.invoice_id
        WHERE i.p IS NOT NULL AND l.product_code IS NOT NULL GROUP BY ALL) WHERE a = 0 OR b = 0""",
    ),
    "spend_change": _sql("inv", f"SELECT organization_id, vendor_id, CASE WHEN a > 0 THEN round_even((b - a) / a * 100, 2) WHEN b > 0 THEN 100.0 ELSE 0.0 END AS change_pct FROM (SELECT organization_id, vendor_id, coalesce(sum(total_amount) FILTER (invoice_date BETWEEN DATE '{PERIOD_A[0]}' AND DATE '{PERIOD_A[1]}'), 0)::DOUBLE AS a, coalesce(sum(total_amount) FILTER (invoice_date BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{PERIOD_B[1]}'), 0)::DOUBLE AS b FROM inv WHERE {_PERIOD} GROUP BY 1, 2)"),
    "repeated_invoices": _sql(
        "inv",
        """SELECT organization_id, id AS duplicate_id, split_part(min(lpad(oseq::VARCHAR, 20, '0') || '#' || o), '#', 2) AS original_id FROM (SELECT organization_id, id, first_value(id) OVER w AS o, first_value(seq) OVER w AS oseq, row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY organization_id, invoice_number, key ORDER BY seq, id)) WHERE rn > 1 GROUP BY 1, 2""",
        """twice AS (SELECT organization_id, id, invoice_number, vendor_id, vendor_name_raw, seq FROM inv UNION ALL SELECT organization_id, id || '_again', invoice_number, vendor_id, vendor_name_raw, seq + 10000000 FROM inv),
        k AS (SELECT organization_id, invoice_number, id, seq, unnest(list_filter([('v' || vendor_id), ('n' || trim(lower(vendor_name_raw)))], lambda k: k IS NOT NULL)) AS key FROM twice WHERE invoice_number IS NOT NULL)""",
    ),
    "vector_stats": "SELECT organization_id, chunk_type, count(DISTINCT chunk_id) AS chunks, count(DISTINCT document_id) AS documents, 128 AS dimensions FROM chunk GROUP BY 1, 2",
}
