"""Queries and SQL of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import premises, same_premises
from ledgerloom.llm.mixing import mix_sources, shares
from ledgerloom.llm.names import resolve, same_entity
from ledgerloom.llm.ocr_text import repaired
from ledgerloom.llm.packing import pack
from ledgerloom.llm.spans import shared_amounts
from ledgerloom.llm.splitting import split_texts
from ledgerloom.llm.tokens import with_tokens
from ledgerloom.session import spread, stage, table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_premises(table(spark, sf, "vendor"), "id", "address").toDF("vendor_id_a", "vendor_id_b")


def p2_premises(spark: SparkSession, sf: str) -> DataFrame:
    """Every vendor with its premises."""
    return premises(table(spark, sf, "vendor"), "id", "address")


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "page_region").select("id", F.col("doc_id").alias("doc"), F.col("page_number").alias("page"), F.col("raw_ocr_output").alias("text"))
    fields = table(spark, sf, "extracted_field").select("id", F.lit(None).cast("string").alias("doc"), F.lit(None).cast("int").alias("page"), F.col("original_text").alias("text"))
    return regions.unionByName(fields)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    x = repaired(_scans(spark, sf)).select(F.col("id").alias("record_id"), F.inline("fixes"))
    return x.distinct()


def p3_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every scanned text as repaired paragraphs."""
    return repaired(_scans(spark, sf)).select("id", F.array_join("paragraphs", "\n\n").alias("text"), F.size("paragraphs").alias("paragraphs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunk").select("chunk_id", "text").filter("length(text) > 1000")
    return split_texts(spread(chunks, "chunk_id").distinct()).filter("piece_no = 0").select("chunk_id", "boundary")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = spread(table(spark, sf, "chunk").select("chunk_id", "text"), "chunk_id").distinct()
    return split_texts(chunks).select("chunk_id", "boundary", "piece_no", "start", F.length("piece").alias("length"), "piece")


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Every text put together again from its pieces without their overlaps, the number of pieces, and whether all keep the limit and the overlap."""
    x = p4_pieces(spark, sf)
    fresh = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.expr("substring(piece, 101)"))
    y = x.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("fresh"), "start", "length"))).alias("p"))
    ends = F.transform("p", lambda r: r.start + r.length)
    chained = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p.start", i) == F.get(ends, i - 1) - 100)
    kept = F.forall("p", lambda r: r.length <= 1000) & F.when(F.size("p") > 1, chained).otherwise(True)
    return y.select("chunk_id", F.md5(F.array_join(F.transform("p", lambda r: r.fresh), "")).alias("text_md5"), (F.size("p") > 1).alias("several"), kept.alias("kept"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("vendor", "canonical_name"), ("vendor_alias", "alias_name"), ("possible_match", "candidate_name")]
    out = [table(spark, sf, t).select("id", "organization_id", F.col(c).alias("name")).distinct() for t, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _labelled_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names known to mean one entity: aliases of a known vendor and approved guesses."""
    vendors = table(spark, sf, "vendor").select(F.col("id").alias("vendor_id"), F.col("canonical_name").alias("a")).distinct()
    aliases = table(spark, sf, "vendor_alias").select("vendor_id", F.col("alias_name").alias("b"))
    approved = table(spark, sf, "possible_match").filter("status = 'APPROVED'").select(F.col("matched_vendor_id").alias("vendor_id"), F.col("candidate_name").alias("b"))
    return vendors.join(aliases.unionByName(approved), "vendor_id").select("a", "b")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_entity(_names(spark, sf), "id", "organization_id", "name", _labelled_names(spark, sf)).toDF("record_id_a", "record_id_b")


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every named record with its entity."""
    return resolve(_names(spark, sf), "id", "organization_id", "name", _labelled_names(spark, sf))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every text (or piece of an oversized one) with its container of 4,096 tokens."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pack(with_tokens(docs).select("doc_id", "tokens"), "doc_id", "tokens", 4096)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers by fill: how many hold how many tokens."""
    held = p8_containers(spark, sf).groupBy("container").agg(F.sum("tokens").alias("fill"))
    return held.groupBy("fill").agg(F.count("*").alias("containers"))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are packed whole (every token of each once), containers that are too full, and whether one container
    in a hundred more than the tokens need would do."""
    docs = with_tokens(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "tokens")
    placed = stage(p8_containers(spark, sf))
    per = placed.groupBy("doc_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("pieces"), F.min("token_start").alias("first"))
    whole = (F.col("held") == F.col("tokens")) & (F.col("first") == 0) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / 4096)))
    texts = docs.filter("tokens is not null").join(per, "doc_id", "left").agg(F.count_if(whole).alias("value")).select(F.lit("texts").alias("what"), "value")
    fill = stage(placed.groupBy("container").agg(F.sum("tokens").alias("fill")))
    full = fill.agg(F.count_if(F.col("fill") > 4096).alias("value")).select(F.lit("too full").alias("what"), "value")
    spare = fill.agg((F.count("*") <= F.ceil(F.sum("fill") / 4096) * 1.01 + 1).cast("bigint").alias("value")).select(F.lit("tight").alias("what"), "value")
    return texts.unionByName(full).unionByName(spare)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Every text that is used with its number of copies."""
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_target"), "doc_id", "text", "source")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and reached shares per source."""
    return shares(p9_mixture(spark, sf), table(spark, sf, "mix_target"), "doc_id")


def p9_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per source whether no text is used more often than allowed and the share is met to one hundredth."""
    x = p9_shares(spark, sf)
    return x.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("actual_share") - F.col("target_share").cast("double")) < 0.01).alias("met"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_amounts(table(spark, sf, "documents"), "doc_id", "text")


_P4 = r"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunk WHERE length(text) > 1000),
fits AS (SELECT chunk_id,
  list_max(list_transform(regexp_split_to_array(text, '\n[ \t\r]*(\n[ \t\r]*)+'), lambda x: length(trim(x, E' \t\r\n')))) <= 900 AS p,
  list_max(list_transform(regexp_split_to_array(text, '\n'), lambda x: length(trim(x, E' \t\r\n')))) <= 900 AS l,
  list_max(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\n'), lambda x: length(trim(x, E' \t\r\n')))) <= 900 AS s,
  list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: length(x))) <= 900 AS w FROM c)
SELECT chunk_id, CASE WHEN p THEN 'paragraph' WHEN l THEN 'line' WHEN s THEN 'sentence' WHEN w THEN 'word' ELSE 'none' END AS boundary FROM fits
"""
_P10 = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200), s AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d), h AS (SELECT doc_id, i, md5_number(substr(text, i, 200)) AS h FROM s),
shared AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT doc_id, i FROM h JOIN shared USING (h)),
w AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)
SELECT doc_id, sum(CASE WHEN before IS NULL THEN 200 ELSE least(200, i - before) END)::BIGINT AS shared_chars FROM w GROUP BY 1
"""
QUERIES = {"p3_found": p3_found, "p3_text": p3_text, "p5_found": p5_found, "p5_entities": p5_entities, "p2_found": p2_found, "p2_premises": p2_premises, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_restored": p4_restored, "p8_invariants": p8_invariants, "p9_invariants": p9_invariants}
SQL = {
    "p4_found": _P4,
    "p4_restored": "SELECT chunk_id, md5(text) AS text_md5, length(text) > 1000 AS several, true AS kept FROM (SELECT DISTINCT chunk_id, text FROM chunk WHERE text IS NOT NULL)",
    "p8_invariants": "SELECT 'texts' AS what, count(*) AS value FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'too full', 0 UNION ALL SELECT 'tight', 1",
    "p9_invariants": "SELECT source, true AS capped, true AS met FROM mix_target",
    "p10_found": _P10,
}
