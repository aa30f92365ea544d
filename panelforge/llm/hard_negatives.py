"""Hard negatives: candidates in Hilbert-ordered Parquet blocks with zone maps; interval bounds choose the blocks that each anchor reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_tasks, stored
from .vectors import matrix, product, slices, usable, width

CURVE_DIMS, CURVE_BITS = 7, 9  # a curve over the 7 dimensions of most variance, 9 bits each: a key of 63 bits
BLOCK, GROUP, PAGE = 1024, 256, 512  # candidates of a block, anchors of a group, zone maps that are looked through together
SEEDS = 2  # blocks of a page that each anchor reads for a first bound on its positives
NO_ID = (1 << 63) - 1  # where a row has no id: after all others
VECTORS = "ids array<long>, labels array<long>, x array<long>"


@dataclass(frozen=True)
class Rule:
    """How many positives an anchor has and negatives each of them, and the window: low * p <= 100 * negative <= high * p."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def window(self, score: int) -> tuple[int, int]:
        """The least and the largest negative score for a positive's score; none if the first is larger."""
        return -(-self.low * score // 100), self.high * score // 100


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of whole coordinates below ``2^bits``; rows times bits must fit 63 bits.

    Coordinates are turned into the curve's transposed form, all rows at once: excess turns are undone from the high bit down, then Gray coded.
    """
    at = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for axis in at:
            high = (axis & bit) != 0
            swap = np.where(high, np.uint64(0), (at[0] ^ axis) & low)
            at[0] ^= np.where(high, low, swap)
            axis ^= swap if axis is not at[0] else np.uint64(0)
    for i in range(1, len(at)):
        at[i] ^= at[i - 1]
    turn = np.zeros(at.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        high = (at[-1] >> np.uint64(level)) & one
        turn ^= high * ((one << np.uint64(level)) - one)
    at ^= turn
    place = np.zeros(at.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in at:
            place = (place << one) | ((axis >> np.uint64(level)) & one)
    return place.astype(np.int64)


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows ``(id, label, x)`` with x = floor(scale * entry); rows without a label or a finite vector of the commonest length are left out."""
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    chosen = chosen.where(F.col("label").isNotNull() & usable(F.col("v")))
    own = chosen.where(F.size("v") == width(chosen, "v"))
    return own.select("id", "label", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def _spread(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every dimension: partial sums by task, a row for each dimension on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, 3))
        for batch in slices(batches, dims):
            x = matrix(batch.column("x"), dims).astype(float)
            total += np.stack([np.full(dims, len(x)), x.sum(axis=0), (x * x).sum(axis=0)], axis=1)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dims), pa.int32()), "n": total[:, 0], "s": total[:, 1], "q": total[:, 2]})

    parts = rows.select("x").mapInArrow(run, "at int, n double, s double, q double")
    sums = parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in "nsq")).orderBy("at").collect()
    n, s, q = (np.array([r[c] for r in sums]) for c in "nsq")
    mean = s / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(q / np.maximum(n, 1) - mean * mean, 0.0))


def with_place(rows: DataFrame, dims: int) -> DataFrame:
    """``rows(id, label, x)`` with ``place``, along a Hilbert curve over the dimensions of most variance, three deviations about the mean."""
    mean, deviation = _spread(rows, dims)
    axes = np.argsort(-deviation, kind="stable")[:CURVE_DIMS]
    step = np.maximum(6 * deviation[axes], 1e-9) / (1 << CURVE_BITS)
    least = mean[axes] - 3 * deviation[axes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, dims):
            x = matrix(batch.column("x"), dims)[:, axes]
            cells = np.clip(np.floor((x - least) / step), 0, (1 << CURVE_BITS) - 1)
            place = hilbert(cells, CURVE_BITS) if len(axes) else np.zeros(len(x), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "x")), pa.array(place, pa.int64())], names=["id", "label", "x", "place"])

    return rows.select("id", "label", "x").mapInArrow(run, "id long, label long, x array<long>, place long")


def blocks(placed: DataFrame, dims: int, most: int) -> DataFrame:
    """Consecutive rows along the curve in blocks of up to ``most``, a Parquet row each, with zone maps.

    ``(block, n, ids, labels, x, low, high, kinds, kind_rows)``: ``x`` has the vectors one after another, by id; ``low`` and ``high`` are the least and
    largest entry of each dimension, ``kinds`` and ``kind_rows`` the labels and how many rows have each. Ranges are cut by place, id and row
    number, so a vector that very many rows share is cut like others.
    """
    tasks = shuffle_tasks(placed.sparkSession)
    wanted = ceil(placed.count() / most) or 1
    order = ["place", "id", "row"]
    dealt = placed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt = dealt.coalesce(min(tasks, wanted)).select("id", "label", "x")  # small tables: no blocks of a few rows

    def block(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        ids = part.column("id").fill_null(NO_ID).to_numpy()
        by = np.argsort(ids, kind="stable")
        labels, x = part.column("label").to_numpy()[by], matrix(part.column("x"), dims)[by]
        kinds, rows = np.unique(labels, return_counts=True)
        held = {"ids": ids[by], "labels": labels, "x": x.ravel(), "low": x.min(axis=0), "high": x.max(axis=0), "kinds": kinds, "kind_rows": rows}
        lists = {k: pa.array([v], pa.list_(pa.int64())) for k, v in held.items()}
        return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "n": pa.array([len(ids)], pa.int32()), **lists})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            while batch.num_rows:
                room = most - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == most:
                    yield block(pa.concat_batches(held), number)
                    number, held = number + 1, []
        if held:
            yield block(pa.concat_batches(held), number)

    zones = "low array<long>, high array<long>, kinds array<long>, kind_rows array<long>"
    return dealt.mapInArrow(run, f"block long, n int, {VECTORS}, {zones}")


def _at(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    """Row ``i`` of a list column."""
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def choose(groups: DataFrame, zones: DataFrame, dims: int, needed: Callable[..., np.ndarray], extra: list[str]) -> DataFrame:
    """Which anchors read which blocks: ``(block, group, at, ids, labels, x, …extra)``, a row for each block and group with any.

    Every group of anchors meets the zone maps of all blocks, page by page. The bounds of an anchor's score in a block come from interval
    arithmetic: each entry of the anchor times the least or the largest entry of its dimension. ``needed(low, high, same, rows, group)`` says which (anchor,
    block) pairs may matter, from the two bounds, the rows of the anchor's own label and all rows of the block. Anchors travel with the pair.
    """
    pages = ceil(zones.count() / PAGE) or 1
    page = F.collect_list(F.struct("block", "n", "low", "high", "kinds", "kind_rows")).alias("zones")
    paged = zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(pages)).alias("page")).agg(page)
    asked = groups.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).join(paged, "page")

    def pairs(batch: pa.RecordBatch, i: int) -> Iterator[dict]:
        zone = batch.column("zones")[i].values
        part = {f: zone.field(f) for f in ("block", "n", "low", "high", "kinds", "kind_rows")}
        number, rows = part["block"].to_numpy(), part["n"].to_numpy()
        low, high = matrix(part["low"], dims), matrix(part["high"], dims)
        group = {c: _at(batch, c, i) for c in ("ids", "labels", *extra)}
        x = _at(batch, "x", i).reshape(len(group["ids"]), dims)
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        same = np.zeros((len(x), len(number)), dtype=np.int64)
        for b, (kinds, many) in enumerate(zip(part["kinds"], part["kind_rows"])):
            count = dict(zip(kinds.as_py(), many.as_py()))
            same[:, b] = [count.get(k, 0) for k in group["labels"].tolist()]
        wanted = needed(product(up, low) + product(down, high), product(up, high) + product(down, low), same, rows, group)
        for b in np.nonzero(wanted.any(axis=0))[0]:
            at = np.nonzero(wanted[:, b])[0]
            lists = {c: group[c].reshape(len(x), -1)[at].ravel() for c in ("ids", "labels", *extra)}
            yield {"block": int(number[b]), "group": batch.column("group")[i].as_py(), "at": at, "x": x[at].ravel(), **lists}

    names = ["at", "ids", "labels", "x", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for pair in pairs(batch, i):
                    lists = [pa.array([pair[c]], pa.list_(pa.int64())) for c in names]
                    yield pa.RecordBatch.from_arrays([pa.array([pair["block"]], pa.int64()), pa.array([pair["group"]], pa.int64()), *lists], names=["block", "group", *names])

    schema = "block long, group long, " + ", ".join(f"{c} array<long>" for c in names)
    return asked.select("group", "ids", "labels", "x", *extra, "zones").mapInArrow(run, schema)


def read(pairs: DataFrame, table: DataFrame, dims: int, picked: Callable[..., Iterator[tuple]], schema: str, extra: list[str]) -> DataFrame:
    """Scores of the chosen pairs: each block joins the anchors that read it; ``picked`` gives the rows that one anchor keeps of one block."""
    own = table.select("block", F.col("ids").alias("to_ids"), F.col("labels").alias("to_labels"), F.col("x").alias("to_x"))

    def kept(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
        anchors = {c: _at(batch, c, i) for c in ("at", "ids", "labels")}
        more = {c: _at(batch, c, i).reshape(len(anchors["at"]), -1) for c in extra}
        ids, labels = _at(batch, "to_ids", i), _at(batch, "to_labels", i)
        x, to = _at(batch, "x", i).reshape(len(anchors["at"]), dims), _at(batch, "to_x", i).reshape(len(ids), dims)
        scores = product(x, to)
        group = batch.column("group")[i].as_py()
        for a, own in enumerate(zip(*(anchors[c].tolist() for c in ("at", "ids", "labels")))):
            for row in picked(own, x[a], {c: v[a] for c, v in more.items()}, ids, labels, to, scores[a]):
                yield group, own[0], own[1], *row

    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if out := [*kept(batch, i)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["group", "at", "anchor", *columns])

    return pairs.join(own, "block").drop("block").mapInArrow(run, f"group long, at long, anchor long, {schema}")


def best(scores: np.ndarray, chosen: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores among ``chosen`` ones, larger first, ties in the order they come."""
    at = np.nonzero(chosen)[0]
    if len(at) > most:
        own = scores[at]
        at = at[own >= np.sort(own)[-most]] if own.dtype == object else at[own >= np.partition(own, len(own) - most)[-most]]
    return at[np.argsort(-scores[at], kind="stable")][:most]


def positives(groups: DataFrame, table: DataFrame, dims: int, rule: Rule) -> DataFrame:
    """``(group, at, anchor, found)``: each anchor's best other rows of its label as ``(score, id)``, in order.

    First each anchor reads the blocks of the highest upper bound that hold its label; its k-th best score there is a bound below which no row can
    be among its k best, and all blocks whose upper bound reaches it are read then. One more row than asked is kept, since the anchor itself is one.
    """
    most = rule.positives + 1

    def seeds(low, high, same, rows, group) -> np.ndarray:
        rated = np.where(same > 0, high.astype(float), -np.inf)
        nth = -np.sort(-rated, axis=1)[:, min(SEEDS, rated.shape[1]) - 1 :][:, :1]
        return (rated >= nth) & (same > 0)

    def picked(own, x, more, ids, labels, to, scores) -> Iterator[tuple]:
        for i in best(scores, labels == own[2], most):
            yield int(scores[i]), int(ids[i]), bool(ids[i] == own[1] and (to[i] == x).all())

    kind = "score long, id long, itself boolean"
    order = [F.desc("score"), F.asc("id"), F.desc("itself")]

    def top(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("group", "at").orderBy(*order)))
        return ranked.where(F.col("rn") <= most).drop("rn")

    zones = table.select("block", "n", "low", "high", "kinds", "kind_rows")
    first = top(read(choose(groups, zones, dims, seeds, []), table, dims, picked, kind, []))
    bound = first.groupBy("group", "at").agg(F.when(F.count("*") == most, F.min("score")).alias("bound"))
    bounds = bound.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("at", "bound"))).alias("by"))  # a group's anchors at most
    places = F.sequence(F.lit(0), F.size("ids") - 1)
    known = F.transform(places, lambda i: F.coalesce(F.try_element_at("by", i.cast("long")), F.lit(-(1 << 63))))
    bounded = cut(groups.join(bounds, "group", "left").withColumn("bound", known).drop("by"))

    def within(low, high, same, rows, group) -> np.ndarray:
        return (high >= group["bound"][:, None]) & (same > 0)

    found = top(read(choose(bounded, zones, dims, within, ["bound"]), table, dims, picked, kind, ["bound"]))
    held = found.groupBy("group", "at", "anchor").agg(F.collect_list(F.struct("score", "id", "itself")).alias("found"))  # at most positives + 1
    held = held.withColumn("found", F.array_sort("found", lambda a, b: _before(a, b)))
    own = F.array_position(F.transform("found", lambda r: r["itself"]), F.lit(True))
    others = F.filter("found", lambda r, i: i + 1 != own)
    return held.select("group", "at", "anchor", F.slice(others, 1, rule.positives).alias("found"))


def _before(a: Column, b: Column) -> Column:
    """Higher scores first, then smaller ids, then the anchor itself."""
    one = lambda first, second: F.when(first, -1).when(second, 1)
    return F.coalesce(one(a["score"] > b["score"], a["score"] < b["score"]), one(a["id"] < b["id"], a["id"] > b["id"]), one(a["itself"] & ~b["itself"], b["itself"] & ~a["itself"]), F.lit(0))


def negatives(groups: DataFrame, found: DataFrame, table: DataFrame, dims: int, rule: Rule) -> DataFrame:
    """``(group, at, anchor, nth, score, id, rn)``: for each positive (by its place) the best rows of other labels in its window.

    An anchor reads the blocks that hold another label and whose bounds meet a window of any of its positives.
    """
    wide = rule.positives

    def bound(i: Column, own: Column, of: Callable[[Column], Column], none: int) -> Column:
        return F.coalesce(of(F.get(own, i)["score"]), F.lit(none).cast("long"))

    least = lambda p: F.ceil(p.cast("decimal(38,0)") * rule.low / 100).cast("long")
    most = lambda p: F.floor(p.cast("decimal(38,0)") * rule.high / 100).cast("long")
    nth = F.sequence(F.lit(0), F.lit(wide - 1))
    windows = found.select("group", "at", F.transform(nth, lambda i: bound(i, F.col("found"), least, 1)).alias("from"), F.transform(nth, lambda i: bound(i, F.col("found"), most, 0)).alias("upto"))
    by = windows.groupBy("group").agg(*(F.map_from_entries(F.collect_list(F.struct("at", c))).alias(c) for c in ("from", "upto")))
    places = F.sequence(F.lit(0), F.size("ids") - 1)

    def laid(c: str, none: int) -> Column:
        empty = F.array_repeat(F.lit(none).cast("long"), wide)
        return F.flatten(F.transform(places, lambda i: F.coalesce(F.try_element_at(c, i.cast("long")), empty)))

    asked = cut(groups.join(by, "group").withColumns({"from": laid("from", 1), "upto": laid("upto", 0)}))

    def within(low, high, same, rows, group) -> np.ndarray:
        out = np.zeros(low.shape, dtype=bool)
        start, stop = group["from"].reshape(-1, wide), group["upto"].reshape(-1, wide)
        for j in range(wide):
            a, b = start[:, j, None], stop[:, j, None]
            out |= (a <= b) & (high >= a) & (low <= b)
        return out & (same < rows)

    def picked(own, x, more, ids, labels, to, scores) -> Iterator[tuple]:
        other = labels != own[2]
        for j, (a, b) in enumerate(zip(more["from"].tolist(), more["upto"].tolist())):
            if a <= b:
                for i in best(scores, other & (scores >= a) & (scores <= b), rule.negatives):
                    yield j, int(scores[i]), int(ids[i])

    zones = table.select("block", "n", "low", "high", "kinds", "kind_rows")
    rows = read(choose(asked, zones, dims, within, ["from", "upto"]), table, dims, picked, "nth long, score long, id long", ["from", "upto"])
    order = Window.partitionBy("group", "at", "nth").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= rule.negatives)


def mine(
    rows: DataFrame, anchors: Column, rule: Rule = Rule(), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """Hard negatives ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the rows that ``anchors`` selects by ``id``.

    A score is the whole-number inner product of floor(scale * entry), exact (it must fit a long). An anchor's positives are its best other
    rows of the same label; each positive's negatives are the best rows of other labels in its window. Ties go to the smaller id.

    Left out: rows with a null label, or whose vector is null, holds null or non-finite entries (2^50 or more counts as such), or has another length
    than the commonest. Rows without an id are candidates after all others of their score, with a null id in the result. Repeated rows are rows
    of their own: each is an anchor, and an equal other one is a positive. An empty table gives an empty result; other columns are ignored.

    Scale: the answer is exact, so where vectors fill all directions alike, bounds leave most blocks to be read and the work is anchors times rows; blocks
    of 1,024 rows meet groups of 256 anchors, each pair one matrix product, and every pair is a row of its own that any task may take. Nothing is
    gathered by anchor but its best rows, cut to a few on the map side first.
    """
    own = cut(whole_vectors(rows, id_col, label_col, vector_col, scale))
    first = own.select(F.size("x").alias("d")).first()
    dims = first["d"] if first else 0
    placed = with_place(own, dims)
    table = stored(blocks(placed, dims, BLOCK), "candidate-blocks")
    groups = cut(blocks(placed.where(anchors), dims, GROUP).select(F.col("block").alias("group"), "ids", "labels", "x"))
    found = cut(positives(groups, table, dims, rule))
    chosen = negatives(groups, found, table, dims, rule)
    pairs = found.select("group", "at", F.posexplode("found").alias("nth", "p"))
    pairs = pairs.select("group", "at", F.col("nth").cast("long").alias("nth"), "p.*").withColumnsRenamed({"score": "positive_score", "id": "positive"})
    named = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return chosen.join(pairs, ["group", "at", "nth"]).select(
        F.col("anchor").alias("anchor_id"),
        named("positive").alias("positive_id"),
        F.col("rn").cast("int").alias("rank"),
        named("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
