"""Graph and vector operations over all organisations with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import extraction, graph, vectors
from ledgerloom.queries.analytics import _GRAPH, _graph, _links, _sql
from ledgerloom.queries.documents import _L, _pages
from ledgerloom.session import stage, table

TABLES = "ven inv po lnk"


def vendor_networks(s: SparkSession, d: str) -> DataFrame:
    """Nodes and induced edges within two steps of every vendor, by relation."""
    nodes, edges = _graph(s, d)
    roots = nodes.filter("label = 'Vendor'").select("organization_id", F.col("id").alias("root"))
    around = stage(graph.neighbourhood(edges, roots, 2))
    return graph.induced(edges, around).groupBy("organization_id", "root", "relation").agg(F.count("*").alias("edges"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks without redelivered copies; metadata as text, since maps cannot be compared."""
    x = table(s, d, "chunk").withColumn("m", F.to_json("metadata"))
    return x.groupBy("chunk_id", "document_id", "organization_id", "chunk_type", "text", "page_number", "bbox", "m").agg(F.lit(1).alias("_")).withColumn("metadata", F.from_json("m", "map<string,string>")).drop("m", "_")


def _embedded(s: SparkSession, d: str) -> DataFrame:
    x = _chunks(s, d)
    dense = vectors.dense_embedding(vectors.sparse_embedding(x.select("chunk_id", "text"), "chunk_id", "text"), "chunk_id")
    return x.join(dense, "chunk_id")


CHOSEN = "cast(conv(substring(chunk_id, -12, 12), 16, 10) as bigint) % 50 = 0"


def _search(chunk_type: str | None = None, metadata: dict[str, str] | None = None):
    def query(s: SparkSession, d: str) -> DataFrame:
        x = _embedded(s, d)
        rows = x.filter(F.col("chunk_type") == chunk_type) if chunk_type else x
        return vectors.search(x.filter(CHOSEN), vectors.metadata_filter(rows, metadata or {}), "chunk_id", "embedding", 5, scope="organization_id", positive=True)

    return query


def evidence_search(s: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of the same document that have a place on a page."""
    x = _embedded(s, d)
    return vectors.evidence(vectors.search(x.filter(CHOSEN), x, "chunk_id", "embedding", 5, scope="document_id", positive=True), x).select("query", "id", "document_id", "score", "place", "context")


QUERIES = {
    "vendor_networks": vendor_networks,
    "vendor_bank_accounts": lambda s, d: graph.labelled_neighbours(*_graph(s, d), "BankAccount", "Vendor"),
    "invoice_orders": lambda s, d: graph.labelled_neighbours(*_graph(s, d), "PurchaseOrder", "Invoice"),
    "connected_documents": lambda s, d: graph.labelled_neighbours(*_graph(s, d), "Invoice", "PurchaseOrder"),
    "tax_number_neighbours": lambda s, d: graph.labelled_neighbours(*_graph(s, d), "Vendor", "TaxIdentifier"),
    "shared_vendors": lambda s, d: graph.shared_entities(*_graph(s, d), "PurchaseOrder", "Vendor"),
    "reference_edges": lambda s, d: graph.reference_edges(_links(s, d, "link_type source_id target_id status match_type")),
    "semantic_search": _search(),
    "line_item_search": _search("LINE_ITEM"),
    "document_search": _search("DOCUMENT_TEXT", {"region_type": "table"}),
    "evidence_search": evidence_search,
    "plain_table_rows": lambda s, d: extraction.plain_rows(_pages(s, d), "doc_id", "raw_ocr_output").select("doc_id", "quantity", "rate", "total"),
}

_BESIDE = "SELECT b.organization_id, b.src AS id, b.dst AS neighbour FROM bothways b JOIN nodes s ON s.organization_id = b.organization_id AND s.id = b.src AND s.label = '{1}' JOIN nodes t ON t.organization_id = b.organization_id AND t.id = b.dst AND t.label = '{0}'"
_EMBED = """c AS (SELECT DISTINCT chunk_id, document_id, organization_id, chunk_type, text, bbox, metadata['region_type'] AS region_type FROM chunk),
w AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS word FROM c),
t AS (SELECT chunk_id, word AS t, 1.0::DOUBLE AS w FROM w UNION ALL SELECT chunk_id, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))), 0.35::DOUBLE FROM w WHERE length(word) >= 3),
b AS (SELECT chunk_id, ('0x' || substr(md5(t), 31, 2))::INT % 128 AS bucket, sum(w) AS w FROM t GROUP BY ALL), e AS (SELECT chunk_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM b),
e2 AS (SELECT e.*, c.organization_id, c.document_id, c.chunk_type, c.region_type FROM e JOIN c USING (chunk_id))"""


def _nearest(scope: str, keep: str = "true") -> str:
    return f"""WITH {_EMBED}, s AS (SELECT q.chunk_id AS query, x.chunk_id AS id, sum(q.w * x.w) AS s FROM e2 q JOIN e2 x ON q.bucket = x.bucket AND q.{scope} = x.{scope} AND q.chunk_id <> x.chunk_id WHERE ('0x' || right(q.chunk_id, 12))::BIGINT % 50 = 0 AND {keep} GROUP BY ALL),
    near AS (SELECT query, id, round(s, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, id) AS place FROM s WHERE round(s, 6) > 0) WHERE place <= 5) """


SQL = {
    "vendor_networks": _sql(TABLES, "SELECT organization_id, root, relation, count(*) AS edges FROM (SELECT DISTINCT a.organization_id, a.root, e.src, e.dst, e.relation FROM edges e JOIN near a ON a.organization_id = e.organization_id AND a.node = e.src JOIN near b ON b.organization_id = e.organization_id AND b.node = e.dst AND b.root = a.root) GROUP BY ALL",
        _GRAPH + ", walk AS (SELECT organization_id, id AS root, id AS node, 0 AS d FROM nodes WHERE label = 'Vendor' UNION SELECT w.organization_id, root, dst, d + 1 FROM walk w JOIN bothways b ON b.organization_id = w.organization_id AND b.src = w.node WHERE d < 2), near AS (SELECT DISTINCT organization_id, root, node FROM walk)"),
    "vendor_bank_accounts": _sql(TABLES, _BESIDE.format("BankAccount", "Vendor"), _GRAPH),
    "invoice_orders": _sql(TABLES, _BESIDE.format("PurchaseOrder", "Invoice"), _GRAPH),
    "connected_documents": _sql(TABLES, _BESIDE.format("Invoice", "PurchaseOrder"), _GRAPH),
    "tax_number_neighbours": _sql(TABLES, _BESIDE.format("Vendor", "TaxIdentifier"), _GRAPH),
    "shared_vendors": _sql(TABLES, "SELECT organization_id, neighbour AS target_id, count(*) AS entities, min(id) AS first_entity FROM (" + _BESIDE.format("Vendor", "PurchaseOrder") + ") GROUP BY 1, 2 HAVING count(*) >= 2", _GRAPH),
    "reference_edges": _sql("lnk", "SELECT organization_id, source_id AS src, target_id AS dst, arg_max(status, id) AS status, arg_max(match_type, id) AS match_type FROM lnk WHERE link_type = 'INVOICE_TO_PO' AND target_id IS NOT NULL GROUP BY 1, 2, 3"),
    "semantic_search": _nearest("organization_id") + "SELECT * FROM near",
    "line_item_search": _nearest("organization_id", "x.chunk_type = 'LINE_ITEM'") + "SELECT * FROM near",
    "document_search": _nearest("organization_id", "x.chunk_type = 'DOCUMENT_TEXT' AND coalesce(x.region_type = 'table', true)") + "SELECT * FROM near",
    "evidence_search": _nearest("document_id") + "SELECT query, id, document_id, score, place, concat_ws(': ', chunk_type, text[1:120]) AS context FROM near JOIN c ON c.chunk_id = near.id WHERE bbox IS NOT NULL",
    "plain_table_rows": _sql("lin", "SELECT doc_id, quantity, unit_price AS rate, total FROM (SELECT doc_id, description, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, total::DOUBLE AS total FROM l) WHERE regexp_matches(description, '[A-Za-z]') AND quantity >= 0 AND unit_price >= 0 AND total >= 0 AND abs(quantity * unit_price - total) <= greatest(1.0, total * 0.01)", _L),
}
