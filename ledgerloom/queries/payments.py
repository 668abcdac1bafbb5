"""Queries over payments with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import payments as ops
from ledgerloom.session import table
from ledgerloom.sources.views import LINE_TOTAL, PAYMENT_ID, delivered_invoices, payments


def _all(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, i = payments(spark, sf), delivered_invoices(spark, sf)
    return p, i, ops.payment_links(p, i)


def payment_links(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf)[2]


def paid_totals(spark: SparkSession, sf: str) -> DataFrame:
    p, i, links = _all(spark, sf)
    return ops.paid_totals(i, p, links)


def settled_counts(spark: SparkSession, sf: str) -> DataFrame:
    return paid_totals(spark, sf).groupBy("organization_id", "settled").agg(F.count("*").alias("invoices"))


def repeated_payments(spark: SparkSession, sf: str) -> DataFrame:
    return ops.repeated_payments(payments(spark, sf))


def payments_of_large_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """The payments of invoices over 200,000."""
    p, i, links = _all(spark, sf)
    return ops.payments_of(i.filter("total_amount > 200000"), p, links)


def payment_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Payments routed through accounts that three vendors share each: nodes and edges by kind."""
    p, i, links = _all(spark, sf)
    accounts = i.select("organization_id", "vendor_id").distinct().withColumn("bank_account", F.format_string("9%011d", F.floor(F.substring("vendor_id", 5, 20).cast("bigint") / 3)))
    nodes, edges = ops.payment_graph(p, links, accounts)
    n = nodes.groupBy("organization_id", F.col("label").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy("organization_id", F.col("relation").alias("kind")).agg(F.count("*").alias("n")))


def payment_months(spark: SparkSession, sf: str) -> DataFrame:
    x = payments(spark, sf).groupBy("organization_id", F.date_format("paid_on", "yyyy-MM").alias("month"), "status")
    return x.agg(F.count("*").alias("payments"), F.sum("amount").cast("double").alias("amount"))


_P = f"""
WITH l AS (SELECT *, 'org_' || n_regionkey AS organization_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
i AS (SELECT organization_id, 'inv-' || l_orderkey || '-' || l_suppkey AS id, 'INV-' || l_orderkey || '-' || l_suppkey AS invoice_number, 'ven_' || l_suppkey AS vendor_id, l_suppkey, sum({LINE_TOTAL})::DECIMAL(15,2) AS total_amount FROM l GROUP BY ALL),
p AS (SELECT DISTINCT organization_id, {PAYMENT_ID} AS id, 'UTR-' || l_orderkey || '-' || l_linenumber AS reference, cast({LINE_TOTAL} + CASE WHEN l_linenumber = 1 THEN 5 ELSE 0 END AS DECIMAL(15,2)) AS amount,
  CASE WHEN l_returnflag = 'R' THEN 'BOUNCED' ELSE 'COMPLETED' END AS status, l_shipdate::DATE AS paid_on, l_suppkey, 'INV-' || l_orderkey || '-' || l_suppkey AS number FROM l WHERE l_linestatus = 'F'),
k AS (SELECT p.organization_id, p.id AS payment_id, i.id AS invoice_id FROM p JOIN i ON i.organization_id = p.organization_id AND i.invoice_number = p.number),
t AS (SELECT k.organization_id, k.invoice_id AS id, sum(amount) AS paid, count(*) AS payments FROM k JOIN p ON p.organization_id = k.organization_id AND p.id = k.payment_id WHERE status = 'COMPLETED' GROUP BY ALL),
s AS (SELECT i.organization_id, i.id, coalesce(paid, 0)::DOUBLE AS paid, coalesce(payments, 0) AS payments,
  CASE WHEN coalesce(paid, 0) = 0 THEN 'unpaid' WHEN total_amount - paid > 1 THEN 'partially_paid' WHEN abs(total_amount - paid) <= 1 THEN 'paid' ELSE 'overpaid' END AS settled FROM i LEFT JOIN t USING (organization_id, id))
"""
QUERIES = {f.__name__: f for f in (payment_links, paid_totals, settled_counts, repeated_payments, payments_of_large_invoices, payment_graph_stats, payment_months)}
SQL = {
    "payment_links": _P + "SELECT * FROM k",
    "paid_totals": _P + "SELECT * FROM s",
    "settled_counts": _P + "SELECT organization_id, settled, count(*) AS invoices FROM s GROUP BY ALL",
    "repeated_payments": _P
    + "SELECT organization_id, id AS duplicate_id, original_id FROM (SELECT *, first_value(id) OVER w AS original_id, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY organization_id, reference ORDER BY paid_on, id)) WHERE rn > 1",
    "payments_of_large_invoices": _P + "SELECT k.organization_id, k.invoice_id, k.payment_id, p.amount::DOUBLE AS amount, p.status FROM k JOIN i ON i.id = k.invoice_id AND i.organization_id = k.organization_id JOIN p ON p.id = k.payment_id AND p.organization_id = k.organization_id WHERE i.total_amount > 200000",
    "payment_graph_stats": _P
    + """SELECT organization_id, 'Payment' AS kind, count(DISTINCT id) AS n FROM p GROUP BY 1 UNION ALL SELECT organization_id, 'APPLIED_TO', count(*) FROM k GROUP BY 1
    UNION ALL SELECT organization_id, 'ROUTED_THROUGH_BANK', count(DISTINCT id) FROM p GROUP BY 1""",
    "payment_months": _P + "SELECT organization_id, strftime(paid_on, '%Y-%m') AS month, status, count(*) AS payments, sum(amount)::DOUBLE AS amount FROM p GROUP BY ALL",
}
