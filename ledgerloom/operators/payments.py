"""Payments: the invoices they name, what is paid of each, records sent twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import bank_digits


def payment_links(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """organization_id, payment_id, invoice_id: each number a payment names, without blanks, beside the least
    invoice that has it; unknown numbers are skipped and a number named twice counts once."""
    first = invoices.filter("invoice_number is not null").groupBy("organization_id", F.trim("invoice_number").alias("number")).agg(F.min("id").alias("invoice_id"))
    named = payments.select("organization_id", F.col("id").alias("payment_id"), F.explode(F.array_distinct(F.transform("referenced_invoice_numbers", lambda n: F.trim(n)))).alias("number"))
    return named.join(first, ["organization_id", "number"]).select("organization_id", "payment_id", "invoice_id")


def paid_totals(invoices: DataFrame, payments: DataFrame, links: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Every invoice with what completed payments give it: sums are formed before the join to the invoices."""
    done = payments.filter("status = 'COMPLETED'").select("organization_id", F.col("id").alias("payment_id"), "amount")
    paid = links.join(done, ["organization_id", "payment_id"]).groupBy("organization_id", F.col("invoice_id").alias("id")).agg(F.sum("amount").alias("paid"), F.count("*").alias("payments"))
    x = invoices.join(paid, ["organization_id", "id"], "left").withColumn("paid", F.coalesce("paid", F.lit(0).cast("decimal(25,2)")))
    rest = F.col("total_amount") - F.col("paid")
    kind = F.when(F.col("paid") == 0, "unpaid").when(rest > tolerance, "partially_paid").when(F.abs(rest) <= tolerance, "paid").otherwise("overpaid")
    return x.select("organization_id", "id", F.col("paid").cast("double").alias("paid"), F.coalesce("payments", F.lit(0)).alias("payments"), kind.alias("settled"))


def repeated_payments(payments: DataFrame) -> DataFrame:
    """Later payments under a reference used before: an aggregate per reference and a join, no self-join of rows."""
    order = F.struct("paid_on", "id")
    first = payments.groupBy("organization_id", F.trim("reference").alias("key")).agg(F.min(order).alias("original"), F.count("*").alias("n")).filter("n > 1")
    x = payments.withColumn("key", F.trim("reference")).join(first, ["organization_id", "key"]).filter(order > F.col("original"))
    return x.select("organization_id", F.col("id").alias("duplicate_id"), F.col("original.id").alias("original_id"))


def payments_of(invoices: DataFrame, payments: DataFrame, links: DataFrame) -> DataFrame:
    """organization_id, invoice_id, payment_id, amount, status of the given invoices."""
    wanted = invoices.select("organization_id", F.col("id").alias("invoice_id"))
    mine = links.join(wanted, ["organization_id", "invoice_id"], "left_semi")
    p = payments.select("organization_id", F.col("id").alias("payment_id"), F.col("amount").cast("double").alias("amount"), "status")
    return mine.join(p, ["organization_id", "payment_id"]).select("organization_id", "invoice_id", "payment_id", "amount", "status")


def payment_graph(payments: DataFrame, links: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of payments: APPLIED_TO their invoices, ROUTED_THROUGH_BANK of their vendor's account.
    ``accounts``(organization_id, vendor_id, bank_account)."""
    nodes = payments.select("organization_id", "id", F.lit("Payment").alias("label")).distinct()
    applied = links.select("organization_id", F.col("payment_id").alias("src"), F.col("invoice_id").alias("dst"), F.lit("APPLIED_TO").alias("relation"))
    bank = accounts.select("organization_id", "vendor_id", F.concat(F.lit("bank_"), bank_digits(F.col("bank_account"))).alias("dst")).filter("dst is not null")
    routed = payments.join(bank, ["organization_id", "vendor_id"]).select("organization_id", F.col("id").alias("src"), "dst", F.lit("ROUTED_THROUGH_BANK").alias("relation"))
    return nodes, applied.unionByName(routed).distinct()
