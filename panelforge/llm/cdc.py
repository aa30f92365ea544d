"""Document fingerprints: content-defined chunks by a normalised gear hash, compared by contained length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, constant, cut, shuffle_tasks, small_batches
from .sharding import KEY, _position, splitters

WINDOW = 32
#: Bytes of a chunk: the least (a window, so that no hash reaches before the text), the wanted, the most.
LEAST, WANTED, MOST = WINDOW, 64, 256
#: Leading zero bits that end a chunk before and after the wanted length: normalised chunking.
HARD_BITS, EASY_BITS = 7, 5


@lru_cache(maxsize=1)
def gears() -> np.ndarray:
    """A 32-bit number for every byte, by rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 32) for b in range(256)], dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte over the last 32 bytes: the sum of gears, each shifted by its age, by doubling spans."""
    h = gears()[data]
    span = 1
    while span < WINDOW:
        older = h[:-span] << np.uint32(span)
        h[span:] += older
        span *= 2
    return h


def boundaries(data: np.ndarray, starts: list[int], stops: list[int]) -> list[list[int]]:
    """Chunk ends for each of the texts ``data[start:stop]``."""
    h = rolling(data)
    at = np.nonzero(h >> np.uint32(32 - EASY_BITS) == 0)[0]
    hard = (h[at] >> np.uint32(32 - HARD_BITS) == 0).tolist()
    lows, highs = np.searchsorted(at, starts).tolist(), np.searchsorted(at, stops).tolist()
    at = (at + 1).tolist()
    out = []
    for start, stop, low, high in zip(starts, stops, lows, highs):
        ends, begun = [], start
        for i in range(low, high):
            end = at[i]
            while end - begun > MOST:
                begun += MOST
                ends.append(begun)
            size = end - begun
            if size >= LEAST and (size >= WANTED or hard[i]):
                ends.append(end)
                begun = end
        while stop - begun > MOST:
            begun += MOST
            ends.append(begun)
        if stop > begun:
            ends.append(stop)
        out.append(ends)
    return out


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text, the lengths of its distinct chunks by digest."""
    raw = b"".join(texts)
    stops = np.cumsum([len(t) for t in texts]).tolist()
    starts = [0, *stops[:-1]]
    digest, out = xxhash.xxh3_64_intdigest, []
    for start, ends in zip(starts, boundaries(np.frombuffer(raw, dtype=np.uint8), starts, stops) if raw else [[]] * len(texts)):
        chunks = {}
        for end in ends:
            chunks[digest(raw[start:end])] = end - start
            start = end
        out.append(chunks)
    return out


def written(chunks: dict[int, int]) -> str:
    """A fingerprint: digest:length of every distinct chunk, by digest."""
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(chunks.items())])


def contained(own: dict[int, int], other: dict[int, int]) -> float:
    """The share of ``own``'s chunk length that ``other`` has too; of an empty text, 1 in another empty one, else 0."""
    if not own:
        return float(not other)
    return sum([n for d, n in own.items() if d in other]) / sum(own.values())


def containment(own: Column, other: Column) -> Column:
    """:func:`contained` for two columns of written fingerprints."""

    def weight(chunks: Column) -> Column:
        return F.aggregate(chunks, F.lit(0).cast("long"), lambda s, x: s + F.substring_index(x, ":", -1).cast("long"))

    mine, theirs = F.split(own, ","), F.split(other, ",")
    return F.when(own == "", (other == "").cast("double")).otherwise(weight(F.array_intersect(mine, theirs)) / weight(mine))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, fingerprint)``, one per document; null text is empty text and has the empty fingerprint.

    Equal texts have equal fingerprints; repeated rows stay repeated, null ids stay null. Whole texts in small batches, no shuffle; extra columns are
    ignored whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = [t.encode("utf-8") for t in as_text(batch, "text")]
            prints = pa.array([written(c) for c in chunk_sets(texts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], names=["doc_id", "fingerprint"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fingerprint string")


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``(r, lent, doc_id, text)`` dealt so that a task reads, range by range, each document and then its follower; and ``(doc_id, text, more)``.

    Rows that repeat id and text more often than a share of the table are followed by their own text, all but the last: one of them is dealt, and the
    second result says how many ``more`` there are. They are few for each task, and counted before they move.

    Documents are ordered by descending id (null ids last, repeated ids by their text's hash). Sampled splitters cut
    that order into ranges of like bytes; the first row of every range is also lent to the range before it (the first
    range's to the last), so no window spans the table. There are four ranges to a shuffle task whatever the table's size, so boundaries and
    lent rows' keys are as few on any table; a range is sorted outside memory and read as a stream. Ranges follow one another inside a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # ~id reverses the order without overflow
    key = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("h"), F.xxhash64("text").alias("id"))
    rows = rows.withColumn("key", key)
    keys = cut(rows.select("key", (F.octet_length("text") + 8).cast("long").alias("size"), F.lit(0).alias("tie")))
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    share = max(64, keys.count() // (8 * shuffle_tasks(docs.sparkSession)))
    hot = F.broadcast(cut(counted.where(F.col("n") > share).select("key", "size", F.lit(0).alias("tie"))))  # fewer than 8 a task
    keys = keys.join(hot, "key", "left_anti").union(hot)
    often = cut(rows.join(hot.select("key"), "key", "left_semi").groupBy("key", "doc_id", "text").agg((F.count("*") - 1).alias("more")))
    rows = rows.select("key", "doc_id", "text").join(hot, "key", "left_anti").union(often.select("key", "doc_id", "text"))
    bounds = splitters(keys, 4 * shuffle_tasks(docs.sparkSession))
    place = _position(constant(bounds, f"array<{KEY}>"), len(bounds), F.col("key"))
    firsts = keys.withColumn("r", place).groupBy("r").agg(F.min("key").alias("key")).orderBy("r").collect()
    before = {x["r"]: y["r"] for x, y in zip(firsts, [firsts[-1], *firsts[:-1]])} if firsts else {}
    lenders: list[dict | None] = [None] * (len(bounds) + 1)
    for x in firsts:
        lenders[x["r"]] = {"h": x["key"]["h"], "id": x["key"]["id"], "to": before[x["r"]]}
    mine = F.element_at(constant(lenders, "array<struct<h: bigint, id: bigint, to: int>>"), F.col("r") + 1)
    first = (mine["h"] == F.col("key.h")) & (mine["id"] == F.col("key.id"))
    own = F.struct(F.col("r").alias("r"), F.lit(False).alias("lent"))
    deals = F.when(first, F.array(own, F.struct(mine["to"].alias("r"), F.lit(True).alias("lent")))).otherwise(F.array(own))
    dealt = rows.withColumn("r", place).select(F.explode(deals).alias("d"), "key", "doc_id", "text")
    dealt = dealt.select("d.r", "d.lent", "key", "doc_id", "text").repartition(shuffle_tasks(docs.sparkSession), "r")
    return dealt.sortWithinPartitions("r", "lent", "key").select("r", "lent", "doc_id", "text"), often.where("more > 0").select("doc_id", "text", "more")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how far the text is contained in that and in its follower.

    The edited form replaces the last floor(n / 2) code points by the first as many (or all) of the next document in
    descending id order (after the last: the first). Returns ``(doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)``. Null text is empty text; equal texts have equal fingerprints; a table of
    one row is its own follower; an empty table gives an empty result; extra columns are ignored.

    One shuffle of the texts, by range; each task streams through its sorted rows and keeps a few at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # a row that waits for its follower: (range, doc_id, text)
        for batch in small_batches(batches, "text", 2_000_000):
            rows = [*zip(batch.column("r").to_pylist(), batch.column("lent").to_pylist(), batch.column("doc_id").to_pylist(), as_text(batch, "text"))]
            ready = []
            for r, lent, doc, text in rows:
                if last is not None and last[0] == r:
                    ready.append((last[1], last[2], text))
                    last = None
                if not lent:
                    last = (r, doc, text)
            if ready:
                yield measured(ready)

    def measured(ready: list[tuple]) -> pa.RecordBatch:
        texts = [t for _, t, _ in ready]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in ready]
        raw = [t.encode("utf-8") for t in edited]
        own = chunk_sets([t.encode("utf-8") for t in texts])
        changed = chunk_sets(raw)
        # nearly always the next row of the same batch: its set is at hand
        after = [own[i + 1] if i + 1 < len(ready) and texts[i + 1] == n else chunk_sets([n.encode("utf-8")])[0] for i, (_, _, n) in enumerate(ready)]
        columns = {
            "doc_id": pa.array([d for d, _, _ in ready], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
            "fingerprint": pa.array([written(c) for c in own], pa.string()),
            "edited_fingerprint": pa.array([written(c) for c in changed], pa.string()),
            "near_edited": pa.array([contained(a, b) for a, b in zip(own, changed)], pa.float64()),
            "near_next": pa.array([contained(a, b) for a, b in zip(own, after)], pa.float64()),
        }
        return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def followed_by_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            if batch.num_rows:
                done = measured([(d, t, t) for d, t in zip(batch.column("doc_id").to_pylist(), as_text(batch, "text"))])
                yield pa.RecordBatch.from_arrays([*done.columns, batch.column("more")], names=[*done.schema.names, "more"])

    followed, often = with_following(docs, id_col, text_col)
    out = followed.mapInArrow(run, schema)
    # parts of the copies are dealt before they are spread out to rows
    parts = often.mapInArrow(followed_by_itself, schema + ", more long").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("more") - 1) / 1024))))
    copies = parts.repartition(shuffle_tasks(docs.sparkSession)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(1024), F.col("more") - F.col("part") * 1024))))
    return out.union(copies.select(*out.columns))
