"""Sharding by sampled splitters: key order, near-equal bytes, overfull ranges subdivided. DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import constant, cut, shuffle_tasks

KEY = "struct<h: bigint, id: bigint>"


def _uniform(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _position(splitters: Column, count: int, key: Column) -> Column:
    """How many of the sorted ``splitters`` are at most ``key``: a binary search of fixed depth."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, count.bit_length())))))

    def step(at: Column, s: Column) -> Column:
        inside = (at + s <= count) & (F.try_element_at(splitters, at + s) <= key)
        return F.when(F.coalesce(inside, F.lit(False)), at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step) if count else F.lit(0)


def splitters(rows: DataFrame, ranges: int, per_range: int = 48) -> list[dict]:
    """Range boundaries from size-weighted key samples: ``rows(key, size, tie)`` to at most ``ranges - 1`` sorted keys.

    A row is drawn with probability proportional to its size (at most 1), about ``ranges * per_range`` in all, and
    stands for size / probability bytes; boundaries are the quantiles of that weight. ``ranges`` is set by the tasks, not by the table, so
    the samples, which one window ranks, and the boundaries, which alone reach the driver, stay as few on any table.
    """
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    if total <= 0:
        return []
    chance = F.least(F.lit(1.0), F.col("size") * (ranges * per_range / total))
    drawn = rows.withColumn("p", chance).where(_uniform(F.col("key"), F.col("tie"), F.lit("draw")) < F.col("p"))
    before = Window.orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("size") / F.col("p")
    placed = drawn.select("key", F.coalesce(F.sum(weight).over(before), F.lit(0.0)).alias("at"), weight.alias("w"))
    all_weight = placed.agg(F.sum("w").alias("w")).first()["w"]
    if not all_weight:
        return []
    firsts = placed.groupBy(F.floor(F.col("at") * (ranges / all_weight)).alias("r")).agg(F.min("key").alias("key"))
    return [{"h": x["key"]["h"], "id": x["key"]["id"]} for x in firsts.where("r > 0").select("key").distinct().orderBy("key").collect()]


def _at_text_edges(bounds: list[dict]) -> list[dict]:
    """Boundaries moved to the first row of their text, but where a text is so large that several fall into it."""
    out: list[dict] = []
    for k, x in enumerate(bounds):
        alone = (k == 0 or bounds[k - 1]["h"] != x["h"]) and (k + 1 == len(bounds) or bounds[k + 1]["h"] != x["h"])
        out.append({"h": x["h"], "id": None} if alone else x)
    return out


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, whole: float = 1 / 256) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes (law ``bytes``).

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row: ``size`` is the text's
    UTF-8 bytes plus 8, ``slot`` runs from 0 without gaps in each shard, ``grown_shard`` is null under this law. With
    ``carry`` a struct column ``record`` holds the input row, for :func:`write_shards`.

    Rows are ordered by (hash of the text, id). Size-weighted samples give splitters at the edges of texts; each range is then measured
    exactly, and where the rows of one key overfill theirs they are subdivided by a row hash, before the range's other keys. Prefix sums over
    the measured ranges turn positions inside a range into global byte offsets. A group of equal texts of up to ``whole`` of a shard's fair share
    goes whole into the shard in which its middle byte falls; of larger groups, which may cross into the next shards, each row goes by its own. So shards
    differ from the fair share by no more than the larger of that and the largest row, and equal texts are in one shard or in consecutive ones.

    Null text: size 8, CRC 0. Null id: allowed, first in its group. Ties and repeated rows: split by row number. Empty
    table: empty result. Extra columns are ignored unless carried.

    Scale: narrow rows (no text) are shuffled once and sorted inside ranges, whose number is a few times that of shards or shuffle tasks
    whatever the table's size; the driver sees the boundaries and two sums per range.
    """
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    crc = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0).cast("long"))
    key = F.struct(F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("id"))
    record = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record")] if carry else []
    rows = docs.select(size.alias("size"), crc.alias("crc"), key.alias("key"), F.monotonically_increasing_id().alias("tie"), *record)
    rows = cut(rows)

    ranges = max(8 * shards, 4 * shuffle_tasks(docs.sparkSession))
    bounds = _at_text_edges(splitters(rows.select("key", "size", "tie"), ranges))
    rows = rows.withColumn("r", _position(constant(bounds, f"array<{KEY}>"), len(bounds), F.col("key")))
    # a key that overfills a range begins it, since several quantiles fall on it; the rest of the range stays together behind it
    edge = F.try_element_at(constant(bounds, f"array<{KEY}>"), F.nullif(F.col("r"), F.lit(0)))
    rows = rows.withColumn("hot", F.col("r").cast("boolean") & F.col("key").eqNullSafe(edge))

    measured = rows.groupBy("r", "hot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    total, count = sum(x["bytes"] for x in measured), sum(x["rows"] for x in measured)
    fair_bytes, fair_rows = max(1.0, 2 * total / ranges), max(1.0, 2 * count / ranges)
    pieces = [1] * (len(bounds) + 1)
    for x in measured:
        if x["hot"]:
            pieces[x["r"]] = ceil(max(1, x["bytes"] / fair_bytes, x["rows"] / fair_rows))
    many = F.element_at(constant(pieces, "array<int>"), F.col("r") + 1)
    rows = rows.withColumn("q", F.when(F.col("hot"), F.pmod(F.xxhash64("tie", F.lit("piece")), many)).otherwise(many)).drop("hot")

    # One key alone or with its range's others: bounded by a few times the ranges, so broadcast below.
    sums = rows.groupBy("r", "q").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("r", "q").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(cut(sums.select("r", "q", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))))
    inside, group = Window.partitionBy("r", "q").orderBy("key", "tie"), Window.partitionBy("r", "q", "key.h")
    fair = total / shards
    placed = rows.withColumns({"end": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(inside)})
    placed = placed.withColumns({"first": F.min(F.col("end") - F.col("size")).over(group), "last": F.max("end").over(group)})
    own = F.when(F.col("last") - F.col("first") <= whole * fair, (F.col("first") + F.col("last")) / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = (
        placed.join(starts, ["r", "q"])
        .withColumn("middle", F.col("start") + own)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * (shards / max(total, 1)))).cast("int"))
    )
    placed = cut(placed.select("size", "crc", "key", "r", "q", "rn", "shard", *(["record"] if carry else [])))
    runs = placed.groupBy("r", "q", "shard").agg(F.min("rn").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("r", "q").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("r", "q", "shard", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(runs), ["r", "q", "shard"]).select(
        F.col("key.id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rn") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["record"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows under ``path/shard=N``, each task one part of a shard, in slot order.

    All columns of ``docs`` but one named ``shard``, which the folders' name would shadow, are read back as they were; null, repeated and empty rows are
    rows like others. An empty table writes no folder.
    """
    out = assign_shards(docs, shards, id_col, text_col, carry=True).select("shard", "slot", "record.*")
    pieces = F.floor(F.col("slot") / 100_000)
    (out.repartition("shard", pieces).sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path))
