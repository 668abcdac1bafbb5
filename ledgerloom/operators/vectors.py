"""Text chunks, hashed embeddings and cosine search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket_of(word: Column, size: int = 128) -> Column:
    """md5 of a word modulo a power of two up to 256: its last byte decides."""
    return (F.conv(F.substring(F.md5(word), 31, 2), 16, 10).cast("int") % size).alias("bucket")


def sparse_embedding(df: DataFrame, id_col: str, text: str, size: int = 128) -> DataFrame:
    """id, bucket, weight: words count 1, their character triples 0.35; unit length. Built-in functions only."""
    words = F.filter(F.split(F.lower(F.trim(F.col(text))), r"\s+"), lambda w: w != "")
    w = df.select(id_col, F.explode(words).alias("word"))
    grams = F.when(F.length("word") >= 3, F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substr(F.col("word"), i, F.lit(3)))).otherwise(F.array())
    parts = F.concat(F.array(F.struct(F.col("word").alias("t"), F.lit(1.0).alias("w"))), F.transform(grams, lambda g: F.struct(g.alias("t"), F.lit(0.35).alias("w"))))
    x = w.select(id_col, F.inline(parts)).select(id_col, bucket_of(F.col("t"), size), "w").groupBy(id_col, "bucket").agg(F.sum("w").alias("w"))
    norm = x.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).filter("norm > 1e-9")
    return x.join(norm, id_col).select(id_col, "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def dense_embedding(sparse: DataFrame, id_col: str, size: int = 128) -> DataFrame:
    """id and array<double>: one row per id, the weights set in their places (an id has at most ``size`` buckets)."""
    m = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def metadata_filter(df: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    """Rows whose metadata do not contradict: a key that is absent says nothing."""
    for k, v in wanted.items():
        df = df.filter(~F.coalesce(F.map_contains_key(column, F.lit(k)), F.lit(False)) | (F.try_element_at(column, F.lit(k)) == v))
    return df


def search(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int = 10, block: int = 1024, batch: int = 16384, scope: str | None = None, positive: bool = False) -> DataFrame:
    """query, id, score, place: the k nearest rows by cosine for each query, itself left out. ``scope`` keeps to rows
    with the query's value in that column, ``positive`` to scores above 0.

    A stated query set against all rows, in blocks: rows fall into batches and queries into blocks of
    bounded size, each batch meets each block in one matrix product and keeps k + 1 per query; the
    final top-k works on those alone. Both sides are copied once per opposite block, never per row."""
    own = F.lit("").alias("scope") if scope is None else F.col(scope).alias("scope")
    q = queries.select(F.col(id_col).alias("query"), F.col(vector).alias("qv"), own).filter("qv is not null")
    x = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), own).filter("v is not null")
    blocks, batches = max(1, -(-q.count() // block)), max(1, -(-x.count() // batch))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = x.withColumn("batch", part("id", batches)).withColumn("block", every(blocks)).groupBy("scope", "batch", "block")
    right = q.withColumn("block", part("query", blocks)).withColumn("batch", every(batches)).groupBy("scope", "batch", "block")

    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": b["query"][:0], "id": a["id"][:0], "score": np.zeros(0)})
        ids, s = a.id.to_numpy(), unit(b.qv) @ unit(a.v).T
        if len(ids) > k + 1:  # the (k + 1)-th best score bounds what has to be sorted; ties with it stay in
            bound = np.partition(np.round(s, 6), len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
        else:
            bound = np.full(len(s), -np.inf)
        keys, found, scores = [], [], []
        for i, key in enumerate(b["query"]):
            near = np.flatnonzero(np.round(s[i], 6) >= bound[i])
            order = near[np.lexsort((ids[near], -np.round(s[i][near], 6)))[: k + 1]]
            keys += [key] * len(order)
            found.append(ids[order])
            scores.append(s[i][order])
        return pd.DataFrame({"query": keys, "id": np.concatenate(found), "score": np.concatenate(scores)})

    kind = rows.schema[id_col].dataType.simpleString()
    best = left.cogroup(right).applyInPandas(meet, f"query {kind}, id {kind}, score double").filter("query <> id")
    if positive:
        best = best.filter(F.round("score", 6) > 0)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "id")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query", "id", F.round("score", 4).alias("score"), "place")


def evidence(hits: DataFrame, chunks: DataFrame, length: int = 120) -> DataFrame:
    """Hits that have a place on a page: after the k nearest are taken, those without a box are dropped."""
    c = chunks.select(F.col("chunk_id").alias("id"), "document_id", "page_number", "bbox", F.concat_ws(": ", "chunk_type", F.substring("text", 1, length)).alias("context"))
    return hits.join(c, "id").filter("bbox is not null").select("query", "id", "document_id", "page_number", "score", "place", "context")


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks replace old ones of their id; within a batch the first delivered wins."""
    w = Window.partitionBy("chunk_id").orderBy("ingested_at", *[F.col(c) for c in new.columns if c not in ("ingested_at", "chunk_id", "metadata")])
    first = new.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return old.join(first.select("chunk_id"), "chunk_id", "left_anti").unionByName(first)


def region_chunks(regions: DataFrame) -> DataFrame:
    """A chunk of every region with text, and one of each page's whole text in reading order."""
    text = F.trim(F.coalesce(F.nullif(F.trim("clean_content"), F.lit("")), F.col("raw_ocr_output")))
    x = regions.withColumn("t", text).filter("t <> ''")
    own = x.select(F.concat_ws("_", "doc_id", "id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "page_number", F.lit("DOCUMENT_TEXT").alias("chunk_type"), F.col("t").alias("text"))
    whole = x.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "id", "t"))).alias("r")).filter("page_number is not null")
    page = whole.select(F.concat(F.col("doc_id"), F.lit("_p"), F.col("page_number").cast("string"), F.lit("_page")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "page_number", F.lit("DOCUMENT_PAGE").alias("chunk_type"), F.array_join(F.transform("r", lambda y: y.t), "\n").alias("text"))
    return own.unionByName(page)


def line_chunks(lines: DataFrame) -> DataFrame:
    part = lambda label, c, kind: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c).cast(kind)))
    text = F.concat_ws(" | ", "description", part("Qty: ", "quantity", "decimal(15,4)"), part("Unit Price: ", "unit_price", "decimal(15,2)"), part("Total: ", "total", "decimal(15,2)"))
    return lines.select(F.concat(F.lit("line_"), "id").alias("chunk_id"), "organization_id", text.alias("text")).filter("text <> ''")


def stats(chunks: DataFrame, size: int = 128) -> DataFrame:
    """Chunks and documents in the index by organisation and type."""
    return chunks.groupBy("organization_id", "chunk_type").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.lit(size).alias("dimensions"))
