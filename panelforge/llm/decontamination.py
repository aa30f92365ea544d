"""Benchmark decontamination: windows of test words as a broadcast set, looked up in every window of training words. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constant, cut

WINDOW = 10
SEGMENT = 4096  # words of a text that are looked at together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words of lower-cased text
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word in text as it was written, and what stands between those
WORD_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The filter before the set: bits for each window, and the most bits (it sits in the plan; a fuller filter only lets more windows through to the set).
BITS_EACH, MOST_BITS = 64, 1 << 23


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, whatever the optimiser collapses."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """A text's words with A-Z lower-cased; none of null."""
    parts = F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def _starts(count: Column) -> Column:
    """0 to ``count - 1``; empty below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class TestWindows:
    """The distinct windows of a benchmark.

    ``windows``: ``(len, h, window, set_id)``; ``sets``: ``(set_id, items)``, the sorted ids of the items that hold the windows of that set;
    ``lengths``: the windows' lengths in words; ``bits``: a filter over their hashes; ``small``: whether both tables are within the broadcast's bound.
    """

    windows: DataFrame
    sets: DataFrame
    lengths: list[int]
    bits: list[int]
    small: bool

    def near(self, table: DataFrame) -> DataFrame:
        """With a broadcast hint if the size was checked to allow it."""
        return F.broadcast(table) if self.small else table


def test_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = 64_000_000) -> TestWindows:
    """Normalised windows of all benchmark items: ``window`` consecutive words; an item of fewer, but not none, is one window.

    The set is measured; up to ``broadcast_bytes`` of it are broadcast, a larger one is joined by shuffles. Windows that the same items share
    name those items once. Items without an id have windows like others, but are never counted or named; equal ids count once, whatever their texts.
    """
    item = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    count = F.size("w")
    length = F.least(F.lit(window), count)
    cuts = F.when(count > 0, F.transform(_starts(count - length + 1), lambda i: F.slice("w", i + 1, length))).otherwise(F.array().cast("array<array<string>>"))
    each = item.select("item", F.explode(cuts).alias("w"))
    each = each.select("item", F.size("w").alias("len"), F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("window"))
    held = cut(each.groupBy("len", "h", "window").agg(F.array_sort(F.collect_set("item")).alias("items")))
    sets = cut(held.select("items").distinct().select(F.monotonically_increasing_id().alias("set_id"), "items"))
    windows = cut(held.join(sets, "items").select("len", "h", "window", "set_id"))
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window") + 32), F.lit(0)).alias("bytes"), F.collect_set("len").alias("lengths")).first()
    named = sets.agg(F.coalesce(F.sum(F.aggregate("items", F.lit(16).cast("long"), lambda s, x: s + F.octet_length(x) + 8)), F.lit(0)).alias("bytes")).first()["bytes"]
    count_bits = min(MOST_BITS, max(1024, 1 << (BITS_EACH * size["n"]).bit_length()))
    marks = windows.select(F.explode(F.array(*_bits(F.col("h"), count_bits))).alias("bit"))
    filled = marks.distinct().groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    bits = [0] * (count_bits // 64)
    for x in filled.collect():  # at most MOST_BITS / 64 rows
        bits[x["at"]] = x["v"]
    return TestWindows(windows, sets, sorted(size["lengths"]), bits, size["bytes"] + named <= broadcast_bytes)


def _bits(h: Column, count: int) -> list[Column]:
    """The two bits of a hash in a filter of ``count`` bits."""
    return [h.bitwiseAND(F.lit(count - 1).cast("long")), F.shiftrightunsigned(h, 36).bitwiseAND(F.lit(count - 1).cast("long"))]


def _passes(h: Column, bits: Column, count: int) -> Column:
    first, second = (F.getbit(F.element_at(bits, F.shiftright(b, 6).cast("int") + 1), b.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1 for b in _bits(h, count))
    return first & second


def hits(rows: DataFrame, tests: TestWindows) -> tuple[DataFrame, DataFrame]:
    """For ``rows(uid, text, …)``: ``(uid, …, n_words)`` of every row, and ``(uid, hit, set_ids)`` of those that hold a test window.

    ``hit`` has disjoint, ordered word ranges ``(start, stop)`` that all occurrences cover; ``set_ids`` the sets they belong to. Texts are looked at
    in segments of 4,096 words and what a window needs beyond, so the arrays of a row stay short. Each window's hash is looked up in the
    filter; what passes carries its words and is verified against the set by an equi-join on them.
    """
    kept = [c for c in rows.columns if c != "text"]
    count = len(tests.bits) * 64
    bits = constant(tests.bits, "array<bigint>")
    longest = max(tests.lengths, default=1)

    def segments(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(SEGMENT))
        return F.transform(at, lambda s: F.struct(s.alias("at"), F.least(F.lit(SEGMENT), F.size(w) - s).alias("own"), F.slice(w, s + 1, SEGMENT + longest - 1).alias("w")))

    def found(length: int) -> Column:
        windows = F.transform(_starts(F.least(F.col("s.own"), F.size("s.w") - length + 1)), lambda i: F.xxhash64(F.slice("s.w", i + 1, length)))
        places = F.array_compact(F.transform(windows, lambda h, i: F.when(_passes(h, bits, count), F.struct(i.alias("i"), h.alias("h")))))
        return F.transform(
            places,
            lambda p: F.struct((F.col("s.at") + p["i"]).alias("at"), F.lit(length).alias("len"), p["h"].alias("h"), F.array_join(F.slice("s.w", p["i"] + 1, length), " ").alias("window")),
        )

    none = F.array().cast("array<struct<at: int, len: int, h: bigint, window: string>>")
    parts = rows.select(*kept, F.explode(_let(words(F.col("text")), segments)).alias("s"))
    parts = cut(parts.select(*kept, F.col("s.own").alias("own"), (F.concat(*map(found, tests.lengths)) if tests.lengths else none).alias("found")))
    counted = parts.groupBy("uid").agg(*(F.first(c).alias(c) for c in kept if c != "uid"), F.sum("own").cast("long").alias("n_words"))
    passed = parts.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    real = passed.join(tests.near(tests.windows), ["len", "h", "window"])
    spans = F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("stop"))))
    met = real.groupBy("uid").agg(spans.alias("spans"), F.collect_set("set_id").alias("set_ids"))
    return counted, met.select("uid", _merged(F.col("spans")).alias("hit"), "set_ids")


def _merged(spans: Column) -> Column:
    """The word ranges that ``(start, stop)`` spans cover: disjoint, ordered, as long as can be."""

    def ranges(at: Column) -> Column:
        starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) != x - 1, F.lit(True)))
        stops = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))

    covered = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["stop"] - 1)))
    return _let(F.array_sort(F.array_distinct(covered)), ranges)


def _named(found: DataFrame, tests: TestWindows) -> DataFrame:
    """``found(uid, hit, set_ids)`` with ``items``, the distinct ids of all its sets in order, in place of ``set_ids``."""
    each = found.select("uid", "hit", F.explode("set_ids").alias("set_id")).join(tests.near(tests.sets), "set_id")
    return each.groupBy("uid").agg(F.first("hit").alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _numbered(docs: DataFrame, text_col: str, **columns: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in columns.items()))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, item_col: str = "item_id") -> DataFrame:
    """Rows ``(doc_id, n_words, n_hit, hit, items)``, one per document: its words, those inside any test window, their ranges, and the items' ids.

    Null and empty texts have no words. Repeated rows stay repeated with equal results, null ids stay null, an empty table gives an empty result, and an
    empty benchmark hits nothing; other columns are ignored whatever their names.

    Scale: texts are read once and never shuffled; what moves is a number for each segment of 4,096 words and the verified hits. A hot window or a
    passage that all documents share meets a broadcast set, so no key gathers its rows; hits and items are gathered by document.
    """
    tests = test_windows(benchmark, item_col, text_col, window)
    counted, met = hits(_numbered(docs, text_col, doc_id=F.col(id_col).cast("long")), tests)
    words_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    ranges = F.array().cast("array<struct<start: int, stop: int>>")
    return counted.join(_named(met, tests), "uid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(words_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hit", ranges).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without(text: Column, ranges: Column) -> Column:
    """A text without the words of disjoint, ordered word ranges and what stands between them; all else stays as it was written."""

    def rest(own: Column, gaps: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["stop"]))
        stops = F.concat(F.transform(ranges, lambda r: r["start"]), F.array(F.size(own)))

        def piece(a: Column, b: Column) -> Column:
            both = F.zip_with(F.slice(gaps, a + 1, b - a), F.slice(own, a + 1, b - a), lambda g, w: F.concat(g, w))
            return F.concat(F.array_join(both, ""), F.get(gaps, b))

        return F.array_join(F.zip_with(starts, stops, piece), "")

    in_order = F.array_remove(F.split(text, WORD_BETWEEN), "")
    return _let(in_order, lambda own: _let(F.split(text, WORD), lambda gaps: rest(own, gaps)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """``docs`` without what the benchmark has too: whole documents that hold a test window, or (``remove="spans"``) the words of the windows.

    All columns come back whatever their names, in ``spans`` mode with ``text_col`` shortened; clean rows, null and empty texts are as they were.
    Repeated rows stay repeated. Texts move once, by row number, to meet their ranges.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    held = cut(_numbered(docs, text_col, record=F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    _, met = hits(held.select("uid", "text"), test_windows(benchmark, item_col, text_col, window))
    if remove == "documents":
        return held.join(met, "uid", "left_anti").select("record.*")
    changed = F.when(F.col("hit").isNotNull(), without(F.col("text"), F.col("hit"))).otherwise(F.col("text"))
    return held.join(met, "uid", "left").withColumn("text", changed).select(*((F.col("text") if c == text_col else F.col(f"record.`{c}`")).alias(c) for c in docs.columns))
