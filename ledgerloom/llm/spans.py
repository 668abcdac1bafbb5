"""Long exact spans shared between records (problem 10).

A relative Lempel-Ziv parse. Every text is cut into phrases at content-defined anchors: the anchor of
a span of ``span`` characters is the least-hashed ``k``-gram in it, so equal spans have equal anchors
in whichever record they lie, and a phrase is the text under all spans of one anchor. The phrases of
all records, hash-partitioned by anchor, are the indexed reference blocks; each record is factored
against every one of them:

1. a phrase found whole in another record is a factor, and neighbouring factors run together;
2. at factor boundaries, that is in phrases with an anchor known from other records but found whole in
   none, each single span is compared with those of the same anchor.

The result is exact but for collisions of 64-bit hashes (128 bits in step 1). No pairs of records are
formed: counts of records per phrase are min/max aggregates, and an anchor held by more than
``group_limit`` boundary phrases is resolved by aggregating hashes of single spans instead of in one
group.

Defined results: null or short text, empty tables -> no row; ids are taken as unique, a repeated id is
the same record and shares nothing with itself; characters are code points; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.operators.units import by_group
from ledgerloom.session import stage, unstage

_CHARS = 1_000_000

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Prefix sums of a rolling hash modulo 2^64 over many texts at once; any span's hash in O(1)."""

    power = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        if len(Hashes.power) <= n:
            size = max(n + 1, 1 << 20)
            for name, b in (("power", _B), ("inverse", _BINV)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(Hashes, name, np.cumprod(a))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * Hashes.power[:n], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Hashes.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = max(len(self.codes) - k + 1, 0)
        return mix((self.sums[k:] - self.sums[: n]) * Hashes.inverse[:n] + np.uint64(k))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def phrases(texts: list[str], span: int, k: int) -> tuple[np.ndarray, ...]:
    """The runs of span starts governed by one anchor: (text number, start in the text, starts, anchor, context hash)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    h = Hashes(texts)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(h.codes) < span:
        return empty
    shift = np.uint64(22)  # the low bits hold the place: equal hashes resolve to the first
    packed = (h.grams(k) >> shift << shift) | np.arange(len(h.codes) - k + 1, dtype=np.uint64)
    least = window_min(packed, span - k + 1)
    anchor = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    n = len(anchor)
    valid = text[:n] == text[span - 1 : span - 1 + n]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    # a run ends before the next run or at the last valid start of its text
    last = np.minimum(np.append(first[1:], n) - 1, ends[text[first]] - span)
    return text[first], first - (ends - lengths)[text[first]], last - first + 1, h.span(anchor[first], anchor[first] + k), h.span(first, last + span)


def _portions(texts: list[str], span: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(row numbers, offsets, pieces) of at most some _CHARS characters; a longer text comes in pieces overlapping by span - 1."""
    rows, offsets, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        step = _CHARS - span + 1
        for a in range(0, max(len(t) - span + 1, 1), step):
            piece = t[a : a + _CHARS]
            if held and size + len(piece) > _CHARS:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
            rows.append(i)
            offsets.append(a)
            held.append(piece)
            size += len(piece)
    if held:
        yield rows, offsets, held


def phrase_table(docs: DataFrame, span: int = 200, k: int = 64) -> DataFrame:
    """``docs``(id, text) -> id, start, starts, anchor, context: a row for each phrase."""
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for rows, offsets, pieces in _portions(texts, span):
                t, start, starts, anchor, context = phrases(pieces, span, k)
                place = np.array(rows, dtype=np.int64)[t]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(place)), pa.array((start + np.array(offsets, dtype=np.int64)[t]).astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))],
                    names=["id", "start", "starts", "anchor", "context"],
                )

    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.IntegerType()) for c in ("start", "starts")], *[T.StructField(c, T.LongType()) for c in ("anchor", "context")]])
    return docs.filter(F.length("text") >= span).mapInArrow(run, schema)


def shared_spans(df: DataFrame, id_col: str, text_col: str, span: int = 200, k: int = 64, group_limit: int = 1000) -> DataFrame:
    """id, start, end of stretches covered by spans that other records hold too; they may overlap."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    kind = docs.schema["id"].dataType
    name = kind.simpleString()
    found = stage(phrase_table(docs, span, k))
    known = found.groupBy("anchor", "context").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    anchors = known.groupBy("anchor").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.count("*").alias("_n"), F.bool_or(F.col("lo") == F.col("hi")).alias("_open"))
    anchors = anchors.filter("_lo < _hi")
    keyed = known.join(anchors, "anchor").select("anchor", "context", "lo", (F.col("lo") < F.col("hi")).alias("whole"), "_open", (F.col("_n") > group_limit).alias("large"))
    hits = stage(found.join(keyed, ["anchor", "context"]))
    unstage(found)
    factors = hits.filter("whole").select("id", "start", (F.col("start") + F.col("starts") + F.lit(span - 1)).alias("end"))

    # boundaries: open phrases, and one holder of each whole phrase of the same anchor to compare with; a phrase
    # that a record repeats is one row with the list of its places
    ask = hits.filter("not whole or (_open and id = lo)").groupBy("id", "anchor", "context", "starts", "whole", "large").agg(F.collect_list("start").alias("at"))
    ask = ask.withColumn("at", F.when(F.col("whole"), F.slice("at", 1, 1)).otherwise(F.col("at")))
    by_record = lambda x: x.groupBy("id").agg(F.collect_list(F.struct("anchor", "at", "starts", "whole")).alias("asked")).join(docs, "id")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, r["anchor"], r["at"], r["whole"], t[r["at"][0] : r["at"][0] + r["starts"] + span - 1]) for i, t, rs in zip(pdf.id, pdf.text, pdf.asked) for r in rs]
            yield pd.DataFrame(out, columns=["id", "anchor", "at", "whole", "piece"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t, rs in zip(pdf.id, pdf.text, pdf.asked):
                for r in rs:
                    g = Hashes([t[r["at"][0] : r["at"][0] + r["starts"] + span - 1]]).grams(span)
                    for start in r["at"]:
                        yield pd.DataFrame({"id": i, "gram": g.view(np.int64), "start": np.arange(start, start + len(g), dtype=np.int32), "whole": r["whole"]})

    def compare(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        holder: dict[str, object] = {}
        rows = list(zip(pdf.id, pdf["at"], pdf.whole, pdf.piece))
        several = object()
        for i, _, whole, piece in rows:
            for a in range(len(piece) - span + 1):
                g = piece[a : a + span]
                if whole or holder.setdefault(g, i) != i:  # a whole phrase has other holders, who are not here
                    holder[g] = several
        out = []
        for i, at, whole, piece in rows:
            if whole:
                continue
            begin = None
            for a in range(len(piece) - span + 2):
                hit = a + span <= len(piece) and holder[piece[a : a + span]] is several
                if hit and begin is None:
                    begin = a
                elif not hit and begin is not None:
                    out.append((i, at, begin, a - 1 + span))
                    begin = None
        return out

    pieces = by_record(ask.filter("not large")).mapInPandas(contexts, f"id {name}, anchor bigint, at array<int>, whole boolean, piece string")
    small = by_group(pieces, ["anchor"], [], compare, f"id {name}, at array<int>, begin int, finish int", least=2)
    small = small.select("id", F.explode("at").alias("start"), "begin", "finish").select("id", (F.col("start") + F.col("begin")).alias("start"), (F.col("start") + F.col("finish")).alias("end"))
    if hits.filter("large").isEmpty():  # the texts are not shuffled a second time for nothing
        return factors.unionByName(small)
    singles = by_record(ask.filter("large")).mapInPandas(grams, f"id {name}, gram bigint, start int, whole boolean")
    singles = stage(singles)
    several = singles.groupBy("gram").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.bool_or("whole").alias("_whole")).filter("_lo < _hi or _whole").select("gram")
    large = singles.filter("not whole").join(several, "gram").select("id", "start", (F.col("start") + F.lit(span)).alias("end"))
    return factors.unionByName(small).unionByName(large)


def shared_amounts(df: DataFrame, id_col: str, text_col: str, span: int = 200) -> DataFrame:
    """id and shared_chars: the number of positions of a record in spans that other records hold too."""
    spans = shared_spans(df, id_col, text_col, span)
    w = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    return spans.select("id", fresh.alias("fresh"), "end").groupBy("id").agg(F.sum("fresh").alias("shared_chars")).withColumnRenamed("id", id_col)
