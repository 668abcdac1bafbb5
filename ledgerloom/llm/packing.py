"""Filling fixed-capacity containers (problem 8).

Planning works on the histogram of lengths, not on documents: best-fit-decreasing over counts. A text
larger than a container is cut into full containers and a rest, the only case of splitting; texts of no
tokens take no room and go to containers already planned (or to one of their own if there is none).
The histogram has at most ``capacity`` entries whatever the data, and so has the plan at most about
as many runs of equal containers times the slots in one; the documents then take the planned slots by
joining on their rank within their length. The rank is counted in two steps (buckets by hash, then
within a bucket), so one length holding a third of all rows is not ranked in one task.

Defined results: null text or null size -> no row; empty table -> no row; repeated rows are separate
items; extra columns are ignored. Containers are numbered from 0.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import stage

PLAN = "size int, first_rank bigint, last_rank bigint, first_container bigint, per_container int"


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for counts of sizes 1..capacity: (size, first rank, last rank, first container, items of that
    size in each container), and the number of containers.

    Best-fit decreasing over counts: runs of containers with equal content are filled at once. ``rooms``
    maps free room to runs (first container, number); an item size goes to the run with the least room
    that holds it, and only when none does to new containers."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the free rooms in use, ascending
    slots, made = [], 0

    def put(room: int, first: int, number: int) -> None:
        if number > 0:
            if room not in rooms:
                bisect.insort(order, room)
                rooms[room] = []
            rooms[room].append((first, number))

    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                room = order[at]
                first, number = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first, number = capacity, made, -(-left // (capacity // size))
                made += number
            each = min(room // size, left)
            full = min(number, left // each)
            slots.append((size, rank, rank + full * each - 1, first, each))
            left, rank = left - full * each, rank + full * each
            put(room - each * size, first, full)
            put(room, first + full, number - full)
    return slots, made


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 4096, bucket_rows: int = 1_000_000) -> DataFrame:
    """id, piece_no, token_start, tokens, container. ``items``: one row per document with its size.
    A length is ranked in buckets of about ``bucket_rows`` pieces at most, 64 at least."""
    x = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size")).filter("size is not null")
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / capacity).cast("bigint")))
    x = x.select("id", "size", F.explode(pieces).alias("piece_no"))
    x = x.withColumn("token_start", F.col("piece_no") * capacity).withColumn("tokens", F.least(F.lit(capacity), F.col("size") - F.col("token_start")).cast("int"))
    x = stage(x.drop("size"))
    buckets = max(64, x.count() // bucket_rows)
    x = x.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)).cast("int"))

    by_bucket = x.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_bucket.select("tokens", "bucket", before.alias("offset"))
    # at most capacity + 1 rows
    counts = {r.tokens: r.n for r in by_bucket.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    zero = counts.pop(0, 0)
    slots, made = plan_containers(counts, capacity)
    if zero:
        slots.append((0, 0, zero - 1, 0, -(-zero // max(made, 1))))
    plan = items.sparkSession.createDataFrame(slots, PLAN)
    if len(slots) <= 200_000:  # a size of rows that is seen here; a larger plan is joined by its size
        plan = F.broadcast(plan)
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("id", "piece_no")) - 1
    ranked = x.join(offsets, ["tokens", "bucket"]).withColumn("rank", rank)
    taken = ranked.join(plan, (F.col("tokens") == F.col("size")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_container")).cast("bigint")
    return taken.select(F.col("id").alias(id_col), F.col("piece_no").cast("int").alias("piece_no"), F.col("token_start").cast("bigint").alias("token_start"), "tokens", container.alias("container"))
