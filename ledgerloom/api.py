"""One function for each route of the service: (spark, tables' folder, arguments) -> DataFrame or answer."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph, records, vectors
from ledgerloom.operators import operations as ops
from ledgerloom.operators import payments as pay
from ledgerloom.operators.documents import documents
from ledgerloom.operators.records import records as read
from ledgerloom.plans.investigation import investigate
from ledgerloom.plans.questions import ask, operations
from ledgerloom.session import table
from ledgerloom.sources.files import load_documents, stored_regions, uploads
from ledgerloom.sources.views import delivered_invoices
from ledgerloom.sources.views import payments as all_payments

NAMES = "vendor_id vendor_name_raw vendor_name_normalized "


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(read(s, d, "vendor", "tax_id bank_account"), read(s, d, "invoice", "vendor_id"), read(s, d, "purchase_order", "vendor_id"), read(s, d, "document_link", "link_type source_id target_id"), read(s, d, "vendor_alias", "vendor_id"))


def _findings(s: SparkSession, d: str, org: str, kind: str | None = None) -> DataFrame:
    return operations(s, d, org)["GET_FINDINGS"](kind=kind)


def _around(s: SparkSession, d: str, org: str, node: str, depth: int = 2) -> DataFrame:
    nodes, edges = (ops.within(x, org) for x in _graph(s, d))
    around = graph.neighbourhood(edges, graph.get_node(nodes, node).select("organization_id", F.col("id").alias("root")), depth)
    return graph.induced(edges, around)


def _evidence(s: SparkSession, d: str, org: str, document: str, text: str, top: int = 10) -> DataFrame:
    chunks = ops.within(table(s, d, "chunk"), org).filter(F.col("document_id") == document).dropDuplicates(["chunk_id"])
    rows = vectors.dense_embedding(vectors.sparse_embedding(chunks, "chunk_id", "text"), "chunk_id")
    q = vectors.dense_embedding(vectors.sparse_embedding(s.createDataFrame([("query", text)], "chunk_id string, text string"), "chunk_id", "text"), "chunk_id")
    return vectors.evidence(vectors.search(q, rows, "chunk_id", "embedding", top, positive=True), chunks)


def _payments(s: SparkSession, d: str, org: str) -> DataFrame:
    p, i = ops.within(all_payments(s, d), org), ops.within(delivered_invoices(s, d), org)
    return pay.paid_totals(i, p, pay.payment_links(p, i))


ROUTES: dict[str, Callable] = {
    "health": lambda s, d: s.range(1).select(F.lit("ok").alias("status")),
    "config": lambda s, d: s.createDataFrame([(k, str(s.conf.get(k, ""))) for k in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir", "spark.sql.session.timeZone")], "name string, value string"),
    "ocr": lambda s, d, path, recogniser=None: load_documents(uploads(s, path), recogniser),
    "finance/process": lambda s, d, path, recogniser=None: documents(load_documents(uploads(s, path), recogniser)),
    "finance/extract": lambda s, d, path: documents(stored_regions(s, path)),
    "invoices": lambda s, d, org, start=None, end=None, limit=50, offset=0: ops.invoices_for_period(read(s, d, "invoice", "vendor_id invoice_date"), start, end, org, limit=limit, offset=offset),
    "invoices/id": lambda s, d, org, id: ops.invoice_detail(ops.within(read(s, d, "invoice", "vendor_id document_id"), org).filter(F.col("id") == id), read(s, d, "invoice_line", "invoice_id product_code quantity total"), read(s, d, "extracted_field", "document_id field_name field_value"), read(s, d, "document_link", "link_type source_id target_id status"), read(s, d, "vendor", "canonical_name"), read(s, d, "vendor_alias", "vendor_id alias_name")),
    "finance/payments": _payments,
    "vendors": lambda s, d, org, text="", limit=50, offset=0: ops.vendor_search(read(s, d, "vendor", "canonical_name normalized_name tax_id"), text, org, limit, offset),
    "vendors/id": lambda s, d, org, id: ops.lookup(read(s, d, "vendor", "canonical_name normalized_name tax_id bank_account address"), org, id=id),
    "purchase-orders": lambda s, d, org, limit=50, offset=0: ops.page(ops.within(read(s, d, "purchase_order", "po_number po_date ingested_at"), org), [F.desc("ingested_at"), F.asc("id")], limit, offset),
    "purchase-orders/id": lambda s, d, org, id: ops.order_detail(read(s, d, "purchase_order", "po_number line_items"), read(s, d, "document_link", "link_type source_id target_id"), org, po_id=id),
    "payments": lambda s, d, org, limit=50, offset=0: ops.page(ops.within(all_payments(s, d), org), [F.desc("paid_on"), F.asc("id")], limit, offset),
    "invoices/id/graph": lambda s, d, org, id: _around(s, d, org, id, 1),
    "analytics/dashboard": lambda s, d, org: ops.within(records.dashboard(read(s, d, "invoice", "payment_status po_number total_amount amount_due"), read(s, d, "purchase_order", "")), org),
    "analytics/rule-violations": _findings,
    "analytics/violations": _findings,
    "analytics/duplicates": lambda s, d, org: _findings(s, d, org, "DUPLICATE"),
    "analytics/anomalies": lambda s, d, org: _findings(s, d, org, "OUTLIER"),
    "graph/stats": lambda s, d, org: ops.within(graph.stats(*_graph(s, d)), org),
    "graph/trace": lambda s, d, org, id, depth=2: _around(s, d, org, id, depth),
    "graph/vendor/network": lambda s, d, org, id: _around(s, d, org, id, 2),
    "graph/shared-entities": lambda s, d, org, entity="Vendor", target="BankAccount", least=2: ops.within(graph.shared_entities(*_graph(s, d), entity, target, least), org),
    "graph/sync": lambda s, d: graph.stats(*_graph(s, d)),
    "search/semantic": lambda s, d, org, text, top=10: operations(s, d, org)["DOCUMENT_SEARCH"](text=text, top=top),
    "search/evidence": _evidence,
    "search/stats": lambda s, d, org: ops.within(vectors.stats(table(s, d, "chunk")), org),
    "copilot/ask": lambda s, d, org, question, today, context=None: ask(s, d, org, question, today, context),
    "ask": lambda s, d, org, question, today, context=None: ask(s, d, org, question, today, context),
    "investigate": lambda s, d, org, question, today, vendor_id=None: investigate(question, today, ops.within(read(s, d, "invoice", "vendor_id invoice_date total_amount"), org), ops.within(read(s, d, "invoice_line", "invoice_id product_code quantity total"), org), operations(s, d, org)["GET_FINDINGS"](), vendor_id),
}


def call(route: str, spark: SparkSession, sf: str, **args: object):
    """Calls a route by name; an unknown one is an error that names those there are."""
    if route not in ROUTES:
        raise KeyError(f"{route}: one of {', '.join(sorted(ROUTES))}")
    return ROUTES[route](spark, sf, **args)


def today() -> date:
    """The only reading of the clock: callers hand the day on, nothing below looks it up."""
    return date.today()
