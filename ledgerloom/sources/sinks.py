"""Sinks: tenant-partitioned tables, upserts, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_table(df: DataFrame, path: str, partition: str | None = "organization_id", mode: str = "overwrite") -> None:
    """Parquet; with dynamic overwrite only the partitions present in ``df`` are replaced."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(partition) if partition else w).parquet(path)


def fan_out(extracted: DataFrame, path: str) -> None:
    """One extraction result (header, lines, fields, issues) into its tables, each by one pass over its columns.
    Every table carries the document and, with a second run over the same documents, replaces their rows."""
    key = ["organization_id", "document_id"]
    parts = {"invoice": extracted.drop("lines", "fields", "issues"), "invoice_line": extracted.select(*key, F.col("id").alias("invoice_id"), F.inline("lines")), "extracted_field": extracted.select(*key, F.inline("fields"))}
    if "issues" in extracted.columns:
        parts["issue"] = extracted.select(*key, F.col("id").alias("invoice_id"), F.inline("issues"))
    for name, df in parts.items():
        write_table(df, f"{path}/{name}", mode="append")


def order_tables(orders: DataFrame, path: str) -> None:
    """Purchase orders and their lines as two tables."""
    write_table(orders.drop("line_items"), f"{path}/purchase_order", mode="append")
    write_table(orders.select("organization_id", F.col("id").alias("po_id"), F.inline("line_items")), f"{path}/purchase_order_line", mode="append")


def new_payments(payments: DataFrame) -> DataFrame:
    """Payments as they are stored: reference without blanks, COMPLETED where no status is given, ids from content."""
    x = payments.withColumn("reference", F.trim("reference")).withColumn("status", F.upper(F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("COMPLETED"))))
    return x.withColumn("id", F.coalesce("id", deterministic_id("pay_", "organization_id", "reference", "amount", "paid_on"))) if "id" in x.columns else x.withColumn("id", deterministic_id("pay_", "organization_id", "reference", "amount", "paid_on"))


def latest_status(events: DataFrame) -> DataFrame:
    """Documents with the state of their last event. ``events``(organization_id, document_id, status, at)."""
    return events.groupBy("organization_id", "document_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.min("at").alias("received_at"), F.max("at").alias("changed_at"), F.count("*").alias("events"))


def write_json(df: DataFrame, path: str, by: str = "doc_id") -> None:
    """One JSON object a document, its regions nested by page, in files of many documents."""
    region = F.struct(*[c for c in df.columns if c not in (by, "page_number")])
    pages = df.groupBy(by, "page_number").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page_number", "regions"))).alias("pages")).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables by organisation; a run over some organisations leaves the others as they are."""
    write_table(nodes, f"{path}/nodes")
    write_table(edges, f"{path}/edges")


def write_index(embedded: DataFrame, path: str) -> None:
    """Chunks with their vectors by organisation, so that a restart reads them and computes none."""
    write_table(embedded, path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both with the last of each key by ``order``; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def deterministic_id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256), 1, 12))


def markdown(regions: DataFrame) -> DataFrame:
    """doc_id and its Markdown: blocks by region type in page and reading order, pages marked."""
    t = F.trim("raw_ocr_output")
    kind = F.col("region_type")
    block = F.when(kind == "title", F.concat(F.lit("# "), t)).when(kind.isin("header", "footer"), F.concat(F.lit("*"), t, F.lit("*"))).when(kind == "list", F.regexp_replace(t, r"(?m)^(?![-*])", "- ")).otherwise(t)
    x = regions.filter(t != "").withColumn("b", block).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "id", "b"))).alias("r"))
    x = x.withColumn("page", F.concat(F.format_string("<!-- Page %d -->\n\n", "page_number"), F.array_join(F.transform("r", lambda y: y.b), "\n\n")))
    pages = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page"))).alias("p"))
    return pages.select("doc_id", F.array_join(F.transform("p", lambda y: y.page), "\n\n").alias("markdown"))
