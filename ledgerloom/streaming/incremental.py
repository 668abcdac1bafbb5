"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.sinks import upsert


def unique_deliveries(stream: DataFrame, key: str = "id", time: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """Redelivered copies within the watermark are dropped; state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_spend(stream: DataFrame, time: str = "ingested_at", delay: str = "2 days", length: str = "1 day") -> DataFrame:
    x = stream.withWatermark(time, delay).groupBy(F.window(time, length), "organization_id")
    return x.agg(F.sum("total_amount").alias("spend"), F.count("*").alias("invoices")).select(F.col("window.start").alias("start"), "organization_id", "spend", "invoices")


def late_order_links(invoices: DataFrame, orders: DataFrame, delay: str = "30 days") -> DataFrame:
    """Invoices joined to orders that arrive up to ``delay`` before or after them; unmatched ones come out with a null order."""
    i = invoices.filter(F.trim("po_number") != "").select("organization_id", F.col("id").alias("invoice_id"), F.trim("po_number").alias("k"), F.col("ingested_at").alias("i_at")).withWatermark("i_at", "1 hour")
    o = orders.select(F.col("organization_id").alias("o_org"), F.col("id").alias("po_id"), F.trim("po_number").alias("o_k"), F.col("ingested_at").alias("o_at")).withWatermark("o_at", "1 hour")
    on = (F.col("organization_id") == F.col("o_org")) & (F.col("k") == F.col("o_k")) & F.expr(f"o_at between i_at - interval {delay} and i_at + interval {delay}")
    return i.join(o, on, "left_outer").select("organization_id", "invoice_id", "po_id")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number and content of the last complete manifest: part -> folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0, {}
    found = sorted(n for f in fs.listStatus(p) if (n := f.getPath().getName()).startswith("manifest-") and not n.endswith(".tmp"))
    if not found:
        return 0, {}
    text = "".join(r.value for r in spark.read.text(f"{path}/{found[-1]}").collect())  # one line a part at most
    return int(found[-1].split("-")[1]), json.loads(text)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows an upserting sink holds, None before the first batch."""
    _, held = _manifest(spark, path)
    return spark.read.parquet(*held.values()) if held else None


def upsert_batches(path: str, keys: list[str], order: str, parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of each key. Rows lie in ``parts`` folders by hash of the key; a
    batch reads and rewrites those it touches and then replaces the manifest that names the folders in force, so
    a batch that fails leaves the state before it. Applying a batch twice changes nothing, whatever its number, so a
    replay or a new checkpoint is safe. Folders no manifest names any longer are deleted."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last, held = _manifest(spark, path)
        tagged = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string"))
        touched = [r[0] for r in tagged.select("_part").distinct().collect()]  # ``parts`` at most
        if not touched:
            return
        old = [held[p] for p in touched if p in held]
        state = spark.read.parquet(*old) if old else batch.limit(0)
        merged = upsert(state, batch, keys, order).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string"))
        folder = f"{path}/rows-{uuid.uuid4().hex}"
        merged.write.partitionBy("_part").parquet(folder)
        now = {**held, **{p: f"{folder}/_part={p}" for p in touched}}
        fs, target = _fs(spark, f"{path}/manifest-{last + 1:012d}")
        _, draft = _fs(spark, f"{path}/manifest-{last + 1:012d}.tmp")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        fs.rename(draft, target)
        for p in touched:
            if p in held:
                fs.delete(_fs(spark, held[p])[1], True)
        if last:
            fs.delete(_fs(spark, f"{path}/manifest-{last:012d}")[1], False)

    return write
