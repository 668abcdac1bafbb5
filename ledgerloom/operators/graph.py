"""Property graph of vendors, invoices, orders and shared identifiers as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import bank_digits, normalize_tax_id
from ledgerloom.session import stage


def build(vendors: DataFrame, invoices: DataFrame, orders: DataFrame, links: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes(organization_id, id, label) and edges(organization_id, src, dst, relation), distinct; with
    ``aliases`` also those of the vendors given."""
    node = lambda df, c, label: df.select("organization_id", F.col(c).alias("id"), F.lit(label).alias("label"))
    edge = lambda df, s, d, r: df.filter(F.col(s).isNotNull() & F.col(d).isNotNull()).select("organization_id", F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(r).alias("relation"))
    v = vendors.withColumn("tax", F.concat(F.lit("tax_"), normalize_tax_id(F.col("tax_id")))).withColumn("bank", F.concat(F.lit("bank_"), bank_digits(F.col("bank_account"))))
    linked = links.filter("link_type = 'INVOICE_TO_PO' and target_id is not null")
    nodes = node(v, "id", "Vendor").unionByName(node(invoices, "id", "Invoice")).unionByName(node(orders, "id", "PurchaseOrder"))
    nodes = nodes.unionByName(node(v.filter("tax is not null"), "tax", "TaxIdentifier")).unionByName(node(v.filter("bank is not null"), "bank", "BankAccount"))
    edges = edge(v, "id", "tax", "HAS_TAX_ID").unionByName(edge(v, "id", "bank", "USES_BANK_ACCOUNT")).unionByName(edge(invoices, "vendor_id", "id", "ISSUED"))
    edges = edges.unionByName(edge(orders, "vendor_id", "id", "RECEIVED_PO")).unionByName(edge(linked, "source_id", "target_id", "REFERENCES_PO")).distinct()
    if aliases is not None:
        held = aliases.join(v.select("organization_id", F.col("id").alias("vendor_id")), ["organization_id", "vendor_id"], "left_semi")
        nodes, edges = nodes.unionByName(node(held, "id", "VendorAlias")), edges.unionByName(edge(held, "vendor_id", "id", "HAS_ALIAS")).distinct()
    # ends without a record become plain entities
    ends = edges.select("organization_id", F.col("src").alias("id")).unionByName(edges.select("organization_id", F.col("dst").alias("id"))).distinct()
    missing = ends.join(nodes.select("organization_id", "id").distinct(), ["organization_id", "id"], "left_anti").withColumn("label", F.lit("Entity"))
    return nodes.distinct().unionByName(missing), edges


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("organization_id", F.col("label").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    e = edges.groupBy("organization_id", F.col("relation").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return n.unionByName(e)


def shared_entities(nodes: DataFrame, edges: DataFrame, entity: str, target: str, least: int = 2) -> DataFrame:
    """Targets with several neighbours of the entity label, whichever way the edge points."""
    both = edges.select("organization_id", "src", "dst").unionByName(edges.select("organization_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    a = nodes.filter(F.col("label") == entity).select("organization_id", F.col("id").alias("src"))
    b = nodes.filter(F.col("label") == target).select("organization_id", F.col("id").alias("dst"))
    x = both.join(a, ["organization_id", "src"], "left_semi").join(b, ["organization_id", "dst"], "left_semi")
    return x.groupBy("organization_id", F.col("dst").alias("target_id")).agg(F.count("*").alias("entities"), F.min("src").alias("first_entity")).filter(F.col("entities") >= least)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seeds``(organization_id, root) -> every node within ``depth`` undirected steps and its distance.
    Frontier joins: each round joins only the nodes met in the round before."""
    both = edges.select("organization_id", "src", "dst").unionByName(edges.select("organization_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("organization_id", "root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(both, (frontier.organization_id == both.organization_id) & (frontier.node == both.src)).select(frontier.organization_id, "root", F.col("dst").alias("node")).distinct()
        frontier = stage(step.join(seen.select("organization_id", "root", "node"), ["organization_id", "root", "node"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Directed paths without repeated nodes of at most ``most`` edges; parallel edges count once."""
    e = edges.select("organization_id", "src", "dst").distinct()
    now = sources.select("organization_id", F.array("node").alias("path"))
    out = None
    for _ in range(most):
        now = now.withColumn("end", F.element_at("path", -1)).join(e, [now.organization_id == e.organization_id, F.col("end") == e.src]).filter(~F.array_contains("path", F.col("dst"))).select(now.organization_id, F.concat("path", F.array("dst")).alias("path"))
        hit = now.withColumn("node", F.element_at("path", -1)).join(targets, ["organization_id", "node"], "left_semi").select("organization_id", F.array_join("path", ">").alias("path"))
        out = hit if out is None else out.unionByName(hit)
    return out


def get_node(nodes: DataFrame, node: str, org: str | None = None) -> DataFrame:
    x = nodes.filter(F.col("id") == node)
    return x.filter(F.col("organization_id") == org) if org is not None else x


def clear(nodes: DataFrame, edges: DataFrame, org: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph without an organisation, or an empty one."""
    if org is None:
        return nodes.limit(0), edges.limit(0)
    return nodes.filter(F.col("organization_id") != org), edges.filter(F.col("organization_id") != org)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with their attributes (a map): later values win key by key, attributes only the older has stay."""
    key = ["organization_id", "id"]
    x = old.select(*key, F.lit(0).alias("o"), "label", "attributes").unionByName(new.select(*key, F.lit(1).alias("o"), "label", "attributes"))
    none = F.create_map().cast("map<string,string>")
    side = lambda o: F.coalesce(F.first(F.when(F.col("o") == o, F.col("attributes")), ignorenulls=True), none)
    y = x.groupBy(*key).agg(F.max_by("label", "o").alias("label"), side(0).alias("a"), side(1).alias("b"))
    return y.select(*key, "label", F.map_concat(F.map_filter("a", lambda k, v: ~F.map_contains_key("b", k)), "b").alias("attributes"))


def reference_edges(links: DataFrame) -> DataFrame:
    """Invoice to order with the status and match type of the link; the last by id where several join the same two."""
    x = links.filter("link_type = 'INVOICE_TO_PO' and target_id is not null")
    return x.groupBy("organization_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max_by(F.struct("status", "match_type"), "id").alias("a")).select("organization_id", "src", "dst", "a.*")


def induced(edges: DataFrame, around: DataFrame) -> DataFrame:
    """``around``(organization_id, root, node) -> the directed edges both ends of which lie around their root."""
    a = around.select("organization_id", "root", F.col("node").alias("src"))
    b = around.select("organization_id", "root", F.col("node").alias("dst"))
    return edges.join(a, ["organization_id", "src"]).join(b, ["organization_id", "root", "dst"], "left_semi").select("organization_id", "root", "src", "dst", "relation")


def labelled_neighbours(nodes: DataFrame, edges: DataFrame, label: str, of: str) -> DataFrame:
    """organization_id, id, neighbour: nodes of one label beside those of another, whichever way the edge points."""
    both = edges.select("organization_id", "src", "dst").unionByName(edges.select("organization_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    a = nodes.filter(F.col("label") == of).select("organization_id", F.col("id").alias("src"))
    b = nodes.filter(F.col("label") == label).select("organization_id", F.col("id").alias("dst"))
    return both.join(a, ["organization_id", "src"], "left_semi").join(b, ["organization_id", "dst"], "left_semi").select("organization_id", F.col("src").alias("id"), F.col("dst").alias("neighbour"))
