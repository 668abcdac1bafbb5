"""Queries over the accounts-payable records with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as tx
from ledgerloom.operators import extraction, graph, matching, records, regions, vectors
from ledgerloom.operators.records import money
from ledgerloom.session import table
from ledgerloom.sources.sinks import markdown

AS_OF = "2026-06-30"
PERIOD_A, PERIOD_B = ("2025-01-01", "2025-03-31"), ("2025-04-01", "2025-06-30")
SPEND, LINK_I, LINK_O = "vendor_id invoice_date total_amount", "vendor_id po_number total_amount", "vendor_id po_number total_amount ingested_at"


def _get(name: str):
    return lambda spark, sf, columns="": records.records(spark, sf, name, columns)


_inv, _lines, _po, _links, _vendors, _aliases, _fields = (_get(n) for n in ("invoice", "invoice_line", "purchase_order", "document_link", "vendor", "vendor_alias", "extracted_field"))


def _regions(spark: SparkSession, sf: str, columns: str) -> DataFrame:
    """Regions without redelivered copies; unlike the records they have no tenant."""
    return table(spark, sf, "page_region").select("doc_id", "id", *columns.split()).distinct()


def _graph(spark: SparkSession, sf: str, aliases: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph as the SQL has it, or with the aliases of the vendors."""
    return graph.build(_vendors(spark, sf, "tax_id bank_account"), _inv(spark, sf, "vendor_id"), _po(spark, sf, "vendor_id"), _links(spark, sf, "link_type source_id target_id"), _aliases(spark, sf, "vendor_id") if aliases else None)


def invoice_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Each invoice with counts and sums of what hangs on it: children are aggregated before they are joined."""
    lines = _lines(spark, sf, "invoice_id total").groupBy("organization_id", F.col("invoice_id").alias("id")).agg(F.count("*").alias("lines"), money(F.sum("total")).alias("line_total"))
    links = _links(spark, sf, "source_type source_id").filter("source_type = 'INVOICE'").groupBy("organization_id", F.col("source_id").alias("id")).agg(F.count("*").alias("links"))
    fields = _fields(spark, sf, "document_id").groupBy("organization_id", "document_id").agg(F.count("*").alias("fields"))
    x = _inv(spark, sf, "document_id").join(lines, ["organization_id", "id"], "left").join(links, ["organization_id", "id"], "left").join(fields, ["organization_id", "document_id"], "left")
    return x.select("organization_id", "id", F.coalesce("lines", F.lit(0)).alias("lines"), "line_total", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("fields", F.lit(0)).alias("fields"))


def vendor_overview(spark: SparkSession, sf: str) -> DataFrame:
    inv = _inv(spark, sf, "vendor_id").groupBy("organization_id", F.col("vendor_id").alias("id")).agg(F.count("*").alias("invoices"))
    po = _po(spark, sf, "vendor_id").groupBy("organization_id", F.col("vendor_id").alias("id")).agg(F.count("*").alias("orders"))
    al = _aliases(spark, sf, "vendor_id").groupBy("organization_id", F.col("vendor_id").alias("id")).agg(F.count("*").alias("aliases"))
    x = _vendors(spark, sf)
    for part in (inv, po, al):
        x = x.join(part, ["organization_id", "id"], "left")
    return x.fillna(0, ["invoices", "orders", "aliases"])


def orders_without_invoice(spark: SparkSession, sf: str) -> DataFrame:
    named = _inv(spark, sf, "po_number").select("organization_id", F.trim("po_number").alias("key"))
    return _po(spark, sf, "po_number").withColumn("key", F.trim("po_number")).join(named, ["organization_id", "key"], "left_anti").select("organization_id", "id")


def organizations(spark: SparkSession, sf: str) -> DataFrame:
    x = [table(spark, sf, t).select("organization_id") for t in ("vendor", "invoice", "purchase_order", "document_link")]
    return x[0].unionByName(x[1]).unionByName(x[2]).unionByName(x[3]).distinct()


def payments_per_invoice(spark: SparkSession, sf: str) -> DataFrame:
    x = _links(spark, sf, "link_type source_id target_id").filter("link_type = 'PAYMENT_TO_INVOICE' and target_id is not null").groupBy("organization_id", F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("payments"))
    return _inv(spark, sf).join(x, ["organization_id", "id"])


def ego_network(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by distance within two steps of every order."""
    nodes, edges = _graph(spark, sf)
    seeds = nodes.filter("label = 'PurchaseOrder'").select("organization_id", F.col("id").alias("root"))
    return graph.neighbourhood(edges, seeds, 2).groupBy("organization_id", "root", "distance").agg(F.count("*").alias("nodes"))


def vendor_order_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    pick = lambda label: nodes.filter(F.col("label") == label).select("organization_id", F.col("id").alias("node"))
    return graph.simple_paths(edges, pick("Vendor"), pick("PurchaseOrder"), 3)


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "embeddings")
    return vectors.search(x.filter("vec_id % 50 = 0"), x, "vec_id", "embedding", 10)


def name_likeness(spark: SparkSession, sf: str) -> DataFrame:
    x = _inv(spark, sf, "vendor_id vendor_name_raw").filter("vendor_name_raw is not null").join(_vendors(spark, sf, "canonical_name").select("organization_id", F.col("id").alias("vendor_id"), "canonical_name"), ["organization_id", "vendor_id"])
    return x.select("organization_id", "id", F.round(tx.token_set_similarity(F.col("vendor_name_raw"), F.col("canonical_name")), 6).alias("score"))


def order_line_matches(spark: SparkSession, sf: str) -> DataFrame:
    linked = records.link_orders(_inv(spark, sf, LINK_I), _po(spark, sf, LINK_O)).filter("po_id is not null").select("organization_id", "invoice_id", "po_id")
    a = _lines(spark, sf, "invoice_id product_code description").join(linked, ["organization_id", "invoice_id"]).select("organization_id", "invoice_id", "id", "product_code", "description")
    b = _po(spark, sf, "line_items").select("organization_id", F.col("id").alias("po_id"), F.explode("line_items").alias("x")).join(linked, ["organization_id", "po_id"])
    b = b.select("organization_id", "invoice_id", F.concat_ws("#", "po_id", F.col("x.line_number").cast("string")).alias("id"), F.col("x.product_code").alias("product_code"), F.col("x.description").alias("description"))
    return matching.match_lines(a, b, ["organization_id", "invoice_id"])


def printed_amounts(spark: SparkSession, sf: str) -> DataFrame:
    x = _fields(spark, sf, "field_name raw_value field_value").filter("field_name = 'total_amount'")
    return x.select("id", money(tx.normalize_amount(F.col("raw_value"))).alias("amount"), money(F.col("field_value").try_cast("decimal(18,2)")).alias("stored"))


def chunk_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest chunks by hashed embedding for every chunk whose id (a hexadecimal number) is divisible by 50."""
    x = table(spark, sf, "chunk").select("chunk_id", "text").distinct()
    dense = vectors.dense_embedding(vectors.sparse_embedding(x, "chunk_id", "text"), "chunk_id")
    chosen = F.conv(F.substring("chunk_id", -12, 12), 16, 10).cast("bigint") % 50 == 0
    return vectors.search(dense.filter(chosen), dense, "chunk_id", "embedding", 5)


def latest_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 latest invoices of each organisation in a period, undated ones left out."""
    x = _inv(spark, sf, "invoice_date").filter(F.col("invoice_date").between(F.lit(PERIOD_A[0]).cast("date"), F.lit(PERIOD_B[1]).cast("date")))
    w = Window.partitionBy("organization_id").orderBy(F.desc("invoice_date"), "id")
    return x.withColumn("place", F.row_number().over(w)).filter("place <= 100").select("organization_id", "id", "invoice_date", "place")


def unresolved_links(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf, "link_type status").filter("upper(status) = 'UNRESOLVED'").groupBy("organization_id", "link_type").agg(F.count("*").alias("links"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return x.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_second"), "event_type", "n", "value")


QUERIES = {
    "vendor_total_spend": lambda s, d: records.vendor_spend(_inv(s, d, "vendor_id total_amount")),
    "monthly_vendor_spend": lambda s, d: records.monthly_spend(_inv(s, d, SPEND)),
    "spend_trend": lambda s, d: records.spend_trend(_inv(s, d, SPEND)),
    "top_vendors": lambda s, d: records.top_vendors(_inv(s, d, "vendor_id total_amount")),
    "unpaid_invoices": lambda s, d: records.open_invoices(_inv(s, d, "vendor_id invoice_number vendor_name_raw vendor_name_normalized payment_status amount_due")),
    "overdue_invoices": lambda s, d: records.overdue_invoices(_inv(s, d, "payment_status due_date total_amount"), AS_OF),
    "invoice_by_number": lambda s, d: records.first_by_number(_inv(s, d, "invoice_number seq")),
    "compare_vendor_spend": lambda s, d: records.compare_spend(_inv(s, d, SPEND), PERIOD_A, PERIOD_B),
    "dashboard": lambda s, d: records.dashboard(_inv(s, d, "payment_status po_number total_amount amount_due"), _po(s, d)),
    "invoice_overview": invoice_overview,
    "vendor_overview": vendor_overview,
    "orders_without_invoice": orders_without_invoice,
    "organizations": organizations,
    "payments_per_invoice": payments_per_invoice,
    "link_orders": lambda s, d: records.link_orders(_inv(s, d, LINK_I), _po(s, d, LINK_O)),
    "latest_links": lambda s, d: records.latest_links(table(s, d, "document_link")),
    "amount_outliers": lambda s, d: records.amount_outliers(_inv(s, d, "vendor_id total_amount")),
    "history_outliers": lambda s, d: records.history_outliers(_inv(s, d, "vendor_id total_amount seq")),
    "resolve_vendors_exact": lambda s, d: records.resolve_exact(_inv(s, d, "vendor_name_normalized"), _vendors(s, d, "normalized_name"), _aliases(s, d, "vendor_id normalized_alias")),
    "resolve_vendors_fuzzy": lambda s, d: matching.fuzzy_vendors(_inv(s, d, "vendor_name_normalized").withColumnRenamed("vendor_name_normalized", "name"), _vendors(s, d, "normalized_name"), aliases=_aliases(s, d, "vendor_id normalized_alias")),
    "spend_drivers": lambda s, d: records.drivers(_lines(s, d, "invoice_id product_code quantity total"), _inv(s, d, "invoice_date"), "2025-03", "2025-04"),
    "best_evidence": lambda s, d: records.best_evidence(_fields(s, d, "document_id field_name confidence")),
    "order_line_matches": order_line_matches,
    "order_line_matches_exact": lambda s, d: order_line_matches(s, d).filter("how <> 'SIMILAR'"),
    "name_likeness": name_likeness,
    "normalized_vendors": lambda s, d: _vendors(s, d, "canonical_name").select("organization_id", "id", tx.normalize_vendor(F.col("canonical_name")).alias("name")),
    "tax_id_status": lambda s, d: _vendors(s, d, "tax_id").filter("tax_id is not null").select("organization_id", "id", tx.gstin_status(F.col("tax_id")).alias("status")),
    "printed_amounts": printed_amounts,
    "graph_stats": lambda s, d: graph.stats(*_graph(s, d)),
    "graph_stats_with_aliases": lambda s, d: graph.stats(*_graph(s, d, aliases=True)),
    "ego_network": ego_network,
    "vendor_order_paths": vendor_order_paths,
    "text_embeddings": lambda s, d: vectors.sparse_embedding(table(s, d, "chunk").select("chunk_id", "text").distinct(), "chunk_id", "text").select("chunk_id", "bucket", F.round("weight", 6).alias("weight")),
    "nearest_vectors": nearest_vectors,
    "region_chunks": lambda s, d: vectors.region_chunks(_regions(s, d, "page_number reading_order clean_content raw_ocr_output")),
    "line_chunks": lambda s, d: vectors.line_chunks(_lines(s, d, "description quantity unit_price total")),
    "reading_order": lambda s, d: regions.reading_order(_regions(s, d, "page_number reading_order bbox")),
    "table_rows": lambda s, d: regions.table_rows(_regions(s, d, "raw_ocr_output")),
    "page_texts": lambda s, d: regions.page_texts(_regions(s, d, "page_number reading_order raw_ocr_output")),
    "page_summary": lambda s, d: regions.page_summary(_regions(s, d, "page_number processing_status confidence ingested_at")),
    "visual_rows": lambda s, d: regions.merge_rows(_regions(s, d, "page_number bbox")),
    "document_markdown": lambda s, d: markdown(_regions(s, d, "page_number region_type reading_order raw_ocr_output")).select("doc_id", F.length("markdown").alias("length"), F.md5("markdown").alias("md5")),
    "chunk_search": chunk_search,
    "latest_invoices": latest_invoices,
    "unresolved_links": unresolved_links,
    "event_windows": event_windows,
}

_R = {
    "inv": "SELECT * EXCLUDE (ingested_at, seq), min(seq) AS seq FROM invoice GROUP BY ALL",
    "lin": "SELECT DISTINCT * EXCLUDE (ingested_at) FROM invoice_line",
    "po": "SELECT * EXCLUDE (ingested_at), min(ingested_at) AS ingested_at FROM purchase_order GROUP BY ALL",
    "lnk": "SELECT DISTINCT * EXCLUDE (ingested_at) FROM document_link",
    "ven": "SELECT DISTINCT * EXCLUDE (ingested_at) FROM vendor",
    "ali": "SELECT DISTINCT * EXCLUDE (ingested_at) FROM vendor_alias",
    "fld": "SELECT DISTINCT * EXCLUDE (ingested_at) FROM extracted_field",
    "reg": "SELECT DISTINCT * EXCLUDE (ingested_at, polygon) FROM page_region",
}


def _sql(names: str, body: str, more: str = "") -> str:
    return "WITH RECURSIVE " + ", ".join([f"{n} AS ({_R[n]})" for n in names.split()] + ([more] if more else [])) + " " + body


_OPEN = "lower(payment_status) IN ('unpaid', 'pending', 'partially_paid')"
_MONTHLY = "SELECT organization_id, vendor_id, strftime(invoice_date, '%Y-%m') AS month, sum(total_amount)::DOUBLE AS spend, count(*) AS invoices FROM inv WHERE invoice_date IS NOT NULL AND total_amount <> 0 GROUP BY ALL"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
_TAX = "nullif(regexp_replace(regexp_replace(upper(tax_id), '^\\s*(GSTIN|GST\\s*NO|GST-NO|GST|VAT|TAX\\s*ID)\\s*[:.#-]*\\s*', ''), '[\\s.-]', '', 'g'), '')"
_GRAPH = f"""
v AS (SELECT organization_id, id, 'tax_' || {_TAX} AS tax, CASE WHEN length(regexp_replace(bank_account, '[^0-9]', '', 'g')) >= 9 THEN 'bank_' || regexp_replace(bank_account, '[^0-9]', '', 'g') END AS bank FROM ven),
edges AS (SELECT DISTINCT * FROM (
  SELECT organization_id, id AS src, tax AS dst, 'HAS_TAX_ID' AS relation FROM v UNION ALL SELECT organization_id, id, bank, 'USES_BANK_ACCOUNT' FROM v
  UNION ALL SELECT organization_id, vendor_id, id, 'ISSUED' FROM inv UNION ALL SELECT organization_id, vendor_id, id, 'RECEIVED_PO' FROM po
  UNION ALL SELECT organization_id, source_id, target_id, 'REFERENCES_PO' FROM lnk WHERE link_type = 'INVOICE_TO_PO') WHERE src IS NOT NULL AND dst IS NOT NULL),
known AS (SELECT DISTINCT * FROM (SELECT organization_id, id, 'Vendor' AS label FROM ven UNION ALL SELECT organization_id, id, 'Invoice' FROM inv UNION ALL SELECT organization_id, id, 'PurchaseOrder' FROM po
  UNION ALL SELECT organization_id, tax, 'TaxIdentifier' FROM v WHERE tax IS NOT NULL UNION ALL SELECT organization_id, bank, 'BankAccount' FROM v WHERE bank IS NOT NULL)),
nodes AS (SELECT * FROM known UNION ALL SELECT organization_id, id, 'Entity' FROM (SELECT organization_id, src AS id FROM edges UNION SELECT organization_id, dst FROM edges) e
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.organization_id = e.organization_id AND k.id = e.id)),
bothways AS (SELECT DISTINCT * FROM (SELECT organization_id, src, dst FROM edges UNION ALL SELECT organization_id, dst, src FROM edges))"""

SQL = {
    "vendor_total_spend": _sql("inv", "SELECT organization_id, vendor_id, coalesce(sum(total_amount), 0)::DOUBLE AS total_spend, count(*) AS invoices FROM inv GROUP BY ALL"),
    "monthly_vendor_spend": _sql("inv", _MONTHLY),
    "spend_trend": _sql("inv", "SELECT *, CASE WHEN before > 0 THEN round((spend - before) / before * 100, 2) END AS change_pct FROM (SELECT *, lag(spend) OVER (PARTITION BY organization_id, vendor_id ORDER BY month) AS before FROM m)", f"m AS ({_MONTHLY})"),
    "top_vendors": _sql("inv", "SELECT organization_id, vendor_id, s::DOUBLE AS total_spend, invoices, place FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY s DESC NULLS LAST, vendor_id ASC NULLS LAST) AS place FROM (SELECT organization_id, vendor_id, sum(total_amount) AS s, count(*) AS invoices FROM inv GROUP BY ALL)) WHERE place <= 5"),
    "unpaid_invoices": _sql("inv", f"SELECT organization_id, id, vendor_id, invoice_number, coalesce(nullif(vendor_name_raw, ''), nullif(vendor_name_normalized, ''), 'Unknown') AS vendor, amount_due::DOUBLE AS amount_due FROM inv WHERE {_OPEN}"),
    "overdue_invoices": _sql("inv", f"SELECT organization_id, id, due_date, date_diff('day', due_date, DATE '{AS_OF}')::INT AS days_overdue, total_amount::DOUBLE AS total_amount FROM inv WHERE {_OPEN} AND due_date < DATE '{AS_OF}'"),
    "invoice_by_number": _sql("inv", "SELECT organization_id, lower(invoice_number) AS number, id FROM inv WHERE invoice_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organization_id, lower(invoice_number) ORDER BY seq, id) = 1"),
    "compare_vendor_spend": _sql("inv", "SELECT *, round(spend_b - spend_a, 2) AS difference, CASE WHEN spend_a > 0 THEN round((spend_b - spend_a) / spend_a * 100, 2) ELSE 0.0::DOUBLE END AS change_pct FROM c", f"c AS (SELECT organization_id, vendor_id, coalesce(sum(total_amount) FILTER (invoice_date BETWEEN '{PERIOD_A[0]}' AND '{PERIOD_A[1]}'), 0)::DOUBLE AS spend_a, coalesce(sum(total_amount) FILTER (invoice_date BETWEEN '{PERIOD_B[0]}' AND '{PERIOD_B[1]}'), 0)::DOUBLE AS spend_b FROM inv WHERE invoice_date BETWEEN '{PERIOD_A[0]}' AND '{PERIOD_A[1]}' OR invoice_date BETWEEN '{PERIOD_B[0]}' AND '{PERIOD_B[1]}' GROUP BY ALL)"),
    "dashboard": _sql("inv po", "SELECT coalesce(i.organization_id, o.organization_id) AS organization_id, coalesce(invoices, 0) AS invoices, coalesce(paid, 0) AS paid, coalesce(open, 0) AS open, coalesce(without_po, 0) AS without_po, coalesce(spend, 0) AS spend, coalesce(outstanding, 0) AS outstanding, coalesce(orders, 0) AS orders FROM i FULL JOIN (SELECT organization_id, count(*) AS orders FROM po GROUP BY 1) o ON i.organization_id = o.organization_id", f"i AS (SELECT organization_id, count(*) AS invoices, count(*) FILTER (lower(payment_status) = 'paid') AS paid, count(*) FILTER ({_OPEN}) AS open, count(*) FILTER (po_number IS NULL) AS without_po, coalesce(sum(total_amount), 0)::DOUBLE AS spend, coalesce(sum(amount_due) FILTER ({_OPEN}), 0)::DOUBLE AS outstanding FROM inv GROUP BY 1)"),
    "invoice_overview": _sql("inv lin lnk fld", "SELECT i.organization_id, i.id, coalesce(lines, 0) AS lines, line_total, coalesce(links, 0) AS links, coalesce(fields, 0) AS fields FROM inv i LEFT JOIN (SELECT organization_id, invoice_id, count(*) AS lines, sum(total)::DOUBLE AS line_total FROM lin GROUP BY ALL) l ON l.organization_id = i.organization_id AND l.invoice_id = i.id LEFT JOIN (SELECT organization_id, source_id, count(*) AS links FROM lnk WHERE source_type = 'INVOICE' GROUP BY ALL) k ON k.organization_id = i.organization_id AND k.source_id = i.id LEFT JOIN (SELECT organization_id, document_id, count(*) AS fields FROM fld GROUP BY ALL) f ON f.organization_id = i.organization_id AND f.document_id = i.document_id"),
    "vendor_overview": _sql("ven inv po ali", "SELECT organization_id, id, (SELECT count(*) FROM inv i WHERE i.organization_id = v.organization_id AND i.vendor_id = v.id) AS invoices, (SELECT count(*) FROM po p WHERE p.organization_id = v.organization_id AND p.vendor_id = v.id) AS orders, (SELECT count(*) FROM ali a WHERE a.organization_id = v.organization_id AND a.vendor_id = v.id) AS aliases FROM ven v"),
    "orders_without_invoice": _sql("po inv", "SELECT organization_id, id FROM po WHERE NOT EXISTS (SELECT 1 FROM inv WHERE inv.organization_id = po.organization_id AND trim(inv.po_number) = trim(po.po_number))"),
    "organizations": "SELECT organization_id FROM vendor UNION SELECT organization_id FROM invoice UNION SELECT organization_id FROM purchase_order UNION SELECT organization_id FROM document_link",
    "payments_per_invoice": _sql("inv lnk", "SELECT i.organization_id, i.id, count(DISTINCT l.source_id) AS payments FROM inv i JOIN lnk l ON l.organization_id = i.organization_id AND l.target_id = i.id WHERE l.link_type = 'PAYMENT_TO_INVOICE' GROUP BY ALL"),
    "link_orders": _sql("inv po", "SELECT i.organization_id, i.id AS invoice_id, f.id AS po_id, (i.total_amount - f.total_amount)::DOUBLE AS difference, i.vendor_id <> f.vendor_id AS other_vendor FROM inv i LEFT JOIN f ON f.organization_id = i.organization_id AND f.k = trim(i.po_number) WHERE trim(i.po_number) <> ''", "f AS (SELECT *, trim(po_number) AS k FROM po WHERE trim(po_number) <> '' QUALIFY row_number() OVER (PARTITION BY organization_id, trim(po_number) ORDER BY ingested_at, id) = 1)"),
    "latest_links": "SELECT organization_id, link_type, source_type, source_id, target_id, arg_max(id, row(ingested_at, id)) AS id, arg_max(status, row(ingested_at, id)) AS status FROM document_link GROUP BY ALL",
    "amount_outliers": _sql("inv", "SELECT organization_id, id, n AS sample, CASE WHEN z_score > 0 THEN 'HIGH' ELSE 'LOW' END AS kind, z_score FROM (SELECT *, round((a - mean) / sqrt(greatest(0.0, (s2 - a * a - n * mean * mean) / (n - 1))), 2) AS z_score FROM (SELECT *, (s1 - a) / n AS mean FROM (SELECT x.*, count(*) OVER w - 1 AS n, sum(a) OVER w AS s1, sum(a * a) OVER w AS s2 FROM x WINDOW w AS (PARTITION BY organization_id, vendor_id))) WHERE n >= 5 AND greatest(0.0, (s2 - a * a - n * mean * mean) / (n - 1)) > 0) WHERE abs(z_score) > 2.5", "x AS (SELECT organization_id, vendor_id, id, total_amount::DOUBLE AS a FROM inv WHERE vendor_id IS NOT NULL AND total_amount IS NOT NULL)"),
    "history_outliers": _sql("inv", "SELECT organization_id, id, n AS sample, round((a - mean) / sd, 2) AS z_score FROM (SELECT organization_id, id, total_amount::DOUBLE AS a, count(total_amount) OVER w AS n, avg(total_amount::DOUBLE) OVER w AS mean, stddev_samp(total_amount::DOUBLE) OVER w AS sd FROM inv WHERE vendor_id IS NOT NULL AND total_amount IS NOT NULL WINDOW w AS (PARTITION BY organization_id, vendor_id ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 5 AND sd > 0 AND abs(round((a - mean) / sd, 2)) > 2.5"),
    "resolve_vendors_exact": _sql("inv ven ali", "SELECT i.organization_id, i.id, coalesce(v.vid, a.vid) AS vendor_id, CASE WHEN v.vid IS NOT NULL THEN 'NORMALIZED_NAME' WHEN a.vid IS NOT NULL THEN 'ALIAS' ELSE 'NEW_VENDOR' END AS match_type FROM inv i LEFT JOIN (SELECT organization_id, normalized_name AS k, min(id) AS vid FROM ven GROUP BY ALL) v ON v.organization_id = i.organization_id AND v.k = i.vendor_name_normalized LEFT JOIN (SELECT organization_id, normalized_alias AS k, min(vendor_id) AS vid FROM ali WHERE vendor_id IS NOT NULL GROUP BY ALL) a ON a.organization_id = i.organization_id AND a.k = i.vendor_name_normalized WHERE i.vendor_name_normalized IS NOT NULL"),
    "spend_drivers": _sql("inv lin", "SELECT organization_id, product_code, round((CASE WHEN a_q > 0 THEN a_t / a_q END - CASE WHEN b_q > 0 THEN b_t / b_q END) * a_q, 2) AS price_effect, round((a_q - b_q) * CASE WHEN b_q > 0 THEN b_t / b_q END, 2) AS quantity_effect, CASE WHEN b_t IS NULL THEN round(a_t, 2) END AS new_item FROM g", "g AS (SELECT l.organization_id, product_code, round(sum(quantity::DOUBLE) FILTER (m = '2025-03'), 4) AS b_q, round(sum(total::DOUBLE) FILTER (m = '2025-03'), 4) AS b_t, round(sum(quantity::DOUBLE) FILTER (m = '2025-04'), 4) AS a_q, round(sum(total::DOUBLE) FILTER (m = '2025-04'), 4) AS a_t FROM lin l JOIN (SELECT organization_id, id, strftime(invoice_date, '%Y-%m') AS m FROM inv) i ON i.organization_id = l.organization_id AND i.id = l.invoice_id WHERE m IN ('2025-03', '2025-04') AND product_code IS NOT NULL GROUP BY ALL)"),
    "best_evidence": _sql("fld", "SELECT document_id, field_name, id, confidence::DOUBLE AS confidence FROM fld QUALIFY row_number() OVER (PARTITION BY document_id, field_name ORDER BY confidence DESC NULLS LAST, id) = 1"),
    "name_likeness": _sql("inv ven", f"SELECT organization_id, id, round(CASE WHEN b = 0 THEN 0.0::DOUBLE WHEN b = least(len(x), len(y)) THEN 0.7::DOUBLE + 0.3::DOUBLE * b / greatest(len(x), len(y)) ELSE b::DOUBLE / e END, 6) AS score FROM (SELECT *, len(list_intersect(x, y)) AS b, len(list_distinct(list_concat(x, y))) AS e FROM (SELECT i.organization_id, i.id, {_WORDS.format('i.vendor_name_raw')} AS x, {_WORDS.format('v.canonical_name')} AS y FROM inv i JOIN ven v ON v.organization_id = i.organization_id AND v.id = i.vendor_id WHERE i.vendor_name_raw IS NOT NULL))"),
    "normalized_vendors": _sql("ven", "SELECT organization_id, id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g'))), '\\b(private|limited|pvt|ltd|llp|llc|inc|corp|corporation|co|company|gmbh)\\b\\.?', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM ven"),
    "tax_id_status": _sql("ven", f"SELECT organization_id, id, CASE WHEN s IS NULL THEN NULL WHEN NOT regexp_full_match(s, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]') THEN 'format' WHEN NOT (try_cast(s[1:2] AS INT) BETWEEN 1 AND 38 OR try_cast(s[1:2] AS INT) IN (97, 99)) THEN 'state' WHEN s[15] <> substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ((36 - list_sum(list_transform(range(1, 15), lambda i: (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', s[i]) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 36 + ((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', s[i]) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) % 36)) % 36) % 36 + 1)::INT, 1) THEN 'checksum' ELSE 'ok' END AS status FROM (SELECT organization_id, id, {_TAX} AS s FROM ven WHERE tax_id IS NOT NULL)"),
    "graph_stats": _sql("ven inv po lnk", "SELECT organization_id, label AS kind, count(*) AS n, 'node' AS what FROM nodes GROUP BY ALL UNION ALL SELECT organization_id, relation, count(*), 'edge' FROM edges GROUP BY ALL", _GRAPH),
    "ego_network": _sql("ven inv po lnk", "SELECT organization_id, root, distance, count(*) AS nodes FROM (SELECT organization_id, root, node, min(d) AS distance FROM walk GROUP BY ALL) GROUP BY ALL", _GRAPH + ", walk AS (SELECT organization_id, id AS root, id AS node, 0 AS d FROM nodes WHERE label = 'PurchaseOrder' UNION SELECT w.organization_id, root, dst, d + 1 FROM walk w JOIN bothways b ON b.organization_id = w.organization_id AND b.src = w.node WHERE d < 2)"),
    "graph_stats_with_aliases": _sql("ven inv po lnk ali", "SELECT organization_id, label AS kind, count(*) AS n, 'node' AS what FROM nodes GROUP BY ALL UNION ALL SELECT organization_id, relation, count(*), 'edge' FROM edges GROUP BY ALL UNION ALL SELECT organization_id, 'VendorAlias', count(DISTINCT id), 'node' FROM held GROUP BY 1 UNION ALL SELECT organization_id, 'HAS_ALIAS', count(DISTINCT (vendor_id, id)), 'edge' FROM held GROUP BY 1", _GRAPH + ", held AS (SELECT * FROM ali WHERE (organization_id, vendor_id) IN (SELECT (organization_id, id) FROM ven))"),
    "order_line_matches_exact": _sql(
        "inv lin po",
        """SELECT organization_id, invoice_id, a_id, b_id, 'CODE' AS how FROM by_code UNION ALL SELECT organization_id, invoice_id, a_id, b_id, 'DESCRIPTION' FROM by_text""",
        """pf AS (SELECT organization_id, trim(po_number) AS key, id AS po_id, row_number() OVER (PARTITION BY organization_id, trim(po_number) ORDER BY ingested_at, id) AS rn FROM po WHERE trim(po_number) <> ''),
        lk AS (SELECT i.organization_id, i.id AS invoice_id, p.po_id FROM inv i JOIN pf p ON p.rn = 1 AND p.organization_id = i.organization_id AND p.key = trim(i.po_number) WHERE trim(i.po_number) <> ''),
        a AS (SELECT l.organization_id, l.invoice_id, l.id, product_code AS code, nullif(trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS text FROM lin l JOIN lk USING (organization_id, invoice_id)),
        b0 AS (SELECT organization_id, id AS po_id, unnest(line_items) AS x FROM po), b AS (SELECT b0.organization_id, lk.invoice_id, b0.po_id || '#' || x.line_number AS id, x.product_code AS code, nullif(trim(regexp_replace(regexp_replace(lower(x.description), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS text FROM b0 JOIN lk USING (organization_id, po_id)),
        ac AS (SELECT *, row_number() OVER (PARTITION BY organization_id, invoice_id, code ORDER BY id) AS n FROM a WHERE code IS NOT NULL), bc AS (SELECT *, row_number() OVER (PARTITION BY organization_id, invoice_id, code ORDER BY id) AS n FROM b WHERE code IS NOT NULL),
        by_code AS (SELECT ac.organization_id, ac.invoice_id, ac.id AS a_id, bc.id AS b_id FROM ac JOIN bc USING (organization_id, invoice_id, code, n)),
        at_ AS (SELECT *, row_number() OVER (PARTITION BY organization_id, invoice_id, text ORDER BY id) AS n FROM a WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM by_code m WHERE m.organization_id = a.organization_id AND m.invoice_id = a.invoice_id AND m.a_id = a.id)),
        bt AS (SELECT *, row_number() OVER (PARTITION BY organization_id, invoice_id, text ORDER BY id) AS n FROM b WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM by_code m WHERE m.organization_id = b.organization_id AND m.invoice_id = b.invoice_id AND m.b_id = b.id)),
        by_text AS (SELECT at_.organization_id, at_.invoice_id, at_.id AS a_id, bt.id AS b_id FROM at_ JOIN bt USING (organization_id, invoice_id, text, n))""",
    ),
    "visual_rows": _sql(
        "reg",
        "SELECT doc_id, page_number, id, row AS row FROM walk",
        """k AS (SELECT DISTINCT doc_id, page_number, id, bbox.y1 AS y1, bbox.y2 - bbox.y1 AS h FROM reg WHERE bbox IS NOT NULL AND page_number IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y1, id) AS n FROM k),
        walk AS (SELECT doc_id, page_number, id, n, 1 AS row, y1 AS top, h FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.page_number, o.id, o.n, CASE WHEN o.y1 - w.top > greatest(12.0, 0.6 * least(o.h, w.h)) THEN w.row + 1 ELSE w.row END, CASE WHEN o.y1 - w.top > greatest(12.0, 0.6 * least(o.h, w.h)) THEN o.y1 ELSE w.top END, CASE WHEN o.y1 - w.top > greatest(12.0, 0.6 * least(o.h, w.h)) THEN o.h ELSE w.h END
          FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.page_number = w.page_number AND o.n = w.n + 1)""",
    ),
    "vendor_order_paths": _sql("ven inv po lnk", "SELECT w.organization_id, array_to_string(path, '>') AS path FROM walk w JOIN nodes n ON n.organization_id = w.organization_id AND n.id = w.tip AND n.label = 'PurchaseOrder' WHERE len(path) > 1", _GRAPH + ", walk AS (SELECT organization_id, id AS tip, [id] AS path FROM nodes WHERE label = 'Vendor' UNION ALL SELECT w.organization_id, e.dst, list_append(path, e.dst) FROM walk w JOIN (SELECT DISTINCT organization_id, src, dst FROM edges) e ON e.organization_id = w.organization_id AND e.src = w.tip WHERE len(path) <= 3 AND NOT list_contains(path, e.dst))"),
    "text_embeddings": "WITH w AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS word FROM (SELECT DISTINCT chunk_id, text FROM chunk)), t AS (SELECT chunk_id, word AS t, 1.0::DOUBLE AS w FROM w UNION ALL SELECT chunk_id, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))), 0.35::DOUBLE FROM w WHERE length(word) >= 3), b AS (SELECT chunk_id, ('0x' || substr(md5(t), 31, 2))::INT % 128 AS bucket, sum(w) AS w FROM t GROUP BY ALL) SELECT chunk_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)), 6) AS weight FROM b",
    "nearest_vectors": "WITH s AS (SELECT q.vec_id AS query, x.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id) SELECT query, id, round(s, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, id) AS place FROM s) WHERE place <= 10",
    "region_chunks": _sql("reg", "SELECT doc_id || '_' || id AS chunk_id, doc_id AS document_id, page_number, 'DOCUMENT_TEXT' AS chunk_type, t AS text FROM x UNION ALL SELECT doc_id || '_p' || page_number || '_page', doc_id, page_number, 'DOCUMENT_PAGE', string_agg(t, E'\n' ORDER BY reading_order NULLS FIRST, id) FROM x WHERE page_number IS NOT NULL GROUP BY ALL", "x AS (SELECT * FROM (SELECT *, trim(coalesce(nullif(trim(clean_content), ''), raw_ocr_output)) AS t FROM reg) WHERE t <> '')"),
    "line_chunks": _sql("lin", "SELECT 'line_' || id AS chunk_id, organization_id, text FROM (SELECT *, concat_ws(' | ', description, 'Qty: ' || quantity::VARCHAR, 'Unit Price: ' || unit_price::VARCHAR, 'Total: ' || total::VARCHAR) AS text FROM lin) WHERE text <> ''"),
    "reading_order": _sql("reg", "SELECT doc_id, page_number, id, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY CASE WHEN usable THEN reading_order ELSE (floor(bbox.y1 / 40))::INT END NULLS FIRST, CASE WHEN usable THEN 0 ELSE bbox.x1 END NULLS FIRST, id) AS place FROM (SELECT *, (SELECT count(DISTINCT reading_order) = count(*) AND min(reading_order) >= 1 FROM reg s WHERE s.doc_id = r.doc_id AND s.page_number = r.page_number) AS usable FROM reg r)"),
    "table_rows": _sql("reg", "SELECT doc_id, id, line_no, len(c) AS cells, c[1] AS description, try_cast(c[2] AS DOUBLE) AS quantity, try_cast(c[3] AS DOUBLE) AS rate FROM (SELECT doc_id, id, line_no, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)) AS c FROM (SELECT doc_id, id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, id, regexp_split_to_array(raw_ocr_output, '\\r?\\n') AS l FROM reg WHERE contains(raw_ocr_output, '|'))) WHERE regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(line, '^[\\s|:-]+$') AND NOT regexp_matches(lower(line), 'description|qty|quantity|rate|amount'))"),
    "page_texts": _sql("reg", "SELECT doc_id, page_number, count(*) AS regions, md5(string_agg(trim(raw_ocr_output), E'\\n\\n' ORDER BY reading_order NULLS FIRST, id)) AS text_md5 FROM reg WHERE raw_ocr_output IS NOT NULL GROUP BY ALL"),
    "page_summary": "SELECT doc_id, page_number, count(*) AS regions, count_if(processing_status = 'COMPLETED') AS completed, count_if(processing_status = 'FAILED') AS failed, count_if(processing_status = 'SKIPPED') AS skipped, round(avg(confidence), 6) AS confidence, (epoch_us(max(ingested_at)) - epoch_us(min(ingested_at))) / 1000000 AS seconds FROM (SELECT DISTINCT doc_id, id, page_number, processing_status, confidence, ingested_at FROM page_region) GROUP BY 1, 2",
    "document_markdown": _sql("reg", "SELECT doc_id, length(m) AS length, md5(m) AS md5 FROM (SELECT doc_id, string_agg(m, E'\\n\\n' ORDER BY page_number) AS m FROM (SELECT doc_id, page_number, '<!-- Page ' || page_number || E' -->\\n\\n' || string_agg(CASE WHEN region_type = 'title' THEN '# ' || t WHEN region_type IN ('header', 'footer') THEN '*' || t || '*' WHEN region_type = 'list' THEN regexp_replace(t, '(?m)^([^-*\\n]|$)', '- \\1', 'g') ELSE t END, E'\\n\\n' ORDER BY reading_order, id) AS m FROM (SELECT *, trim(raw_ocr_output) AS t FROM reg) WHERE t <> '' GROUP BY doc_id, page_number) GROUP BY doc_id)"),
    "printed_amounts": _sql(
        "fld",
        """SELECT id, round_even(scale * CASE WHEN european THEN try_cast(replace(replace(n, '.', ''), ',', '.') AS DECIMAL(24, 6)) ELSE try_cast(replace(n, ',', '') AS DECIMAL(24, 6)) END, 2)::DOUBLE AS amount, try_cast(field_value AS DECIMAL(18, 2))::DOUBLE AS stored FROM (
        SELECT *, contains(n, ',') AND ((contains(n, '.') AND strpos(reverse(n), ',') < strpos(reverse(n), '.')) OR (NOT contains(n, '.') AND regexp_full_match(n, '-?[0-9]+,[0-9]{1,2}'))) AS european FROM (
        SELECT id, field_value, regexp_replace(regexp_extract(lower(raw_value), '(-?[0-9][0-9.,]*)', 1), '[.,]+$', '') AS n, CASE WHEN regexp_matches(lower(raw_value), '\\b(lakhs?|lacs?)\\b') THEN 100000 WHEN regexp_matches(lower(raw_value), '\\b(crores?|cr)\\b') THEN 10000000 ELSE 1 END AS scale FROM fld WHERE field_name = 'total_amount'))""",
    ),
    "chunk_search": "WITH w AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS word FROM (SELECT DISTINCT chunk_id, text FROM chunk)), t AS (SELECT chunk_id, word AS t, 1.0::DOUBLE AS w FROM w UNION ALL SELECT chunk_id, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))), 0.35::DOUBLE FROM w WHERE length(word) >= 3), b AS (SELECT chunk_id, ('0x' || substr(md5(t), 31, 2))::INT % 128 AS bucket, sum(w) AS w FROM t GROUP BY ALL), e AS (SELECT chunk_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM b), s AS (SELECT q.chunk_id AS query, x.chunk_id AS id, sum(q.w * x.w) AS s FROM e q JOIN e x ON q.bucket = x.bucket AND q.chunk_id <> x.chunk_id WHERE ('0x' || right(q.chunk_id, 12))::BIGINT % 50 = 0 GROUP BY ALL) SELECT query, id, round(s, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, id) AS place FROM s) WHERE place <= 5",
    "latest_invoices": _sql("inv", f"SELECT organization_id, id, invoice_date, place FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY invoice_date DESC, id) AS place FROM inv WHERE invoice_date BETWEEN '{PERIOD_A[0]}' AND '{PERIOD_B[1]}') WHERE place <= 100"),
    "unresolved_links": _sql("lnk", "SELECT organization_id, link_type, count(*) AS links FROM lnk WHERE upper(status) = 'UNRESOLVED' GROUP BY ALL"),
    "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_second, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
