"""Best-fit packing planned on the histogram of lengths, placed by rank within length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_text, constant, cut, shuffle_tasks, small_batches
from .encoding import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: its ids plus ``end``, cut from the back into ``capacity`` where longer.

    Only the first piece of a longer document may be shorter. Null text is empty text (one piece, only ``end``).
    ``with_ids`` adds the piece's ids. Repeated rows give equal pieces each, null ids stay null; whole texts of any length come in small batches;
    extra columns are ignored whatever their names; an empty table gives no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in small_batches(batches, "text"):
            out: list[tuple] = []
            held: list[np.ndarray] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_text(batch, "text")):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                cuts = [*range(len(ids), 0, -capacity)][::-1]
                for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if with_ids:
                        held.append(ids[a:b].astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: slots ``(length, first_rank, ranks, first_sequence, per_sequence, offset)``.

    Sequences with the same room left are one group (room, first id, number), so the work and the plan depend on the
    number of lengths, not of documents. The tightest group that can take a length takes as many of it as fit, sequence
    after sequence, which is what best fit does one document at a time; at most one sequence of a group is left part-filled.
    Every length splits off at most two groups, so the plan has O(capacity) groups and slots for each length.
    """
    rooms: list[tuple[int, int, int]] = []  # (room, first sequence, how many), sorted
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, (length, -1, -1))
            if at < len(rooms):
                room, first, many = rooms.pop(at)
            else:
                per = capacity // length
                room, first, many = capacity, opened, -(-left // per)
                opened += many
            per = room // length
            full = min(many, left // per)
            if full:
                slots.append((length, rank, full * per, first, per, capacity - room))
                rank, left = rank + full * per, left - full * per
                if room - per * length:
                    insort(rooms, (room - per * length, first, full))
                first, many = first + full, many - full
            if many and 0 < left < per:
                slots.append((length, rank, left, first, left, capacity - room))
                if room - left * length:
                    insort(rooms, (room - left * length, first, 1))
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            if many:
                insort(rooms, (room, first, many))
    return slots


def pack(cut_pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``(sequence_id, offset)`` to pieces of at most ``capacity`` tokens, in about as few sequences as there can be.

    The histogram of lengths (at most ``capacity`` rows) is planned on the driver; pieces then take the planned slots
    by joining on their length and finding the slot of their rank by search, so no row is multiplied. A length that very many pieces share is ranked
    in buckets of bounded size, whose counts are summed first, so no length is gathered by one task, nor rows that repeat everything. The plan's
    size depends on ``capacity`` alone and the buckets' on the number of shuffle tasks, so both are broadcast. Repeated rows are packed as often
    as they come; an empty table gives an empty result.
    """
    spark = cut_pieces.sparkSession
    row = next(n for n in (f"row_{k}" for k in range(len(cut_pieces.columns) + 1)) if n not in cut_pieces.columns)
    own = cut(cut_pieces.withColumn(row, F.monotonically_increasing_id()))
    histogram = {x["length"]: x["n"] for x in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    share = max(64, total // (8 * shuffle_tasks(spark)))
    buckets = [1] * (capacity + 1)
    for length, n in histogram.items():
        buckets[length] = ceil(n / share)
    # dealt by row number, so that rows that repeat everything part as well
    deal = F.pmod(F.xxhash64(row), F.element_at(constant(buckets, "array<int>"), F.col("length").cast("int") + 1))
    dealt = own.withColumn("bucket", deal)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", row)
    ranked = dealt.withColumn("rn", F.row_number().over(inside)).join(F.broadcast(starts), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rn") - 1).drop("bucket", "rn", "before", row)
    slots: dict[int, list[tuple[int, ...]]] = {}
    for length, *slot in plan(histogram, capacity):
        slots.setdefault(length, []).append(tuple(slot))
    kind = "array<struct<first_rank: bigint, ranks: bigint, first_sequence: bigint, per: bigint, at: bigint>>"
    planned = F.broadcast(spark.createDataFrame([*slots.items()], f"length long, slots {kind}"))
    slot = F.element_at("slots", _last_at_most(F.col("slots"), F.col("rank")))
    placed = ranked.join(planned, "length").select(*cut_pieces.columns, "rank", slot.alias("slot"))
    nth = F.col("rank") - F.col("slot.first_rank")
    return placed.select(
        *cut_pieces.columns,
        (F.col("slot.first_sequence") + F.floor(nth / F.col("slot.per"))).alias("sequence_id"),
        (F.col("slot.at") + F.pmod(nth, F.col("slot.per")) * F.col("length")).alias("offset"),
    )


def _last_at_most(slots: Column, rank: Column) -> Column:
    """Place (from 1) of the slot that has ``rank``: a binary search in slots by their first rank, the first of which is 0."""

    def step(at: Column, s: Column) -> Column:
        return F.when(F.coalesce(F.try_element_at(slots, at + s)["first_rank"] <= rank, F.lit(False)), at + s).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(16)))), F.lit(0), step)
