"""Personal data: fixed formats, and spans that high-recall generators propose and boosted trees accept."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut, small_batches
from .numbers import GROUP, Run

KINDS = ["email", "ip", "card", "phone", "likely_address", "likely_number"]
SPANS = "array<struct<kind: int, start: int, stop: int, score: double>>"

# The base formats. Runs are possessive or anchored where that changes no match, so no text costs more than its length.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators: addresses written plainly or in disguise, and numbers in any grouping.
AT = re.compile(r"@|[(\[{]\s?(?i:at)\s?[)\]}]|(?<=[A-Za-z0-9])\s(?i:at)\s(?=[A-Za-z0-9.-]++\s(?i:dot)\s)")
HOST = re.compile(r"\s?[\w-]++(?:(?:\.|\s?[(\[{]\s?(?i:dot)\s?[)\]}]\s?|\s(?i:dot)\s)[\w-]++)++")
RUN = re.compile(r"[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+")
#: In every text that proposes anything or has a base span (and in some others); read by Java and Python alike.
TELLING = (
    r"@|[(\[{][^A-Za-z0-9]?[aA][tT]|[aA][tT][^A-Za-z0-9.-][A-Za-z0-9.-]++[^A-Za-z0-9.-][dD][oO][tT]"
    r"|[0-9](?:[\x20().\-/]*+[0-9]){6}|(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
)
LEAST_DIGITS, MOST_DIGITS = 7, 31  # digits of a proposal of several groups inside a longer run; whole runs and whole groups may have any number
CONTEXT = 32
LONG_RUN = 512  # characters of a run from which its proposals are made as arrays
MOST_ROWS = 20_000  # feature rows that a worker holds at a time
STEPS = 1_000  # score steps of the calibration
#: Feature values that the fit tells apart: 64ths below 1, whole numbers to 64, then quarters of octaves.
GRID = np.concatenate([np.arange(64) / 64, np.arange(1.0, 64.0), 2.0 ** np.arange(6, 32, 0.25)])
HINTS = [re.compile(p) for p in (r"tel|phone|call|mobile|fax|cell", r"mail|contact|write", r"card|visa|account|iban|pay", r"\bip\b|addr|host|server")]


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Valid ``(kind, start, stop)`` of the fixed formats by kind, then start; failing matches are dropped, not retried."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def addresses(text: str) -> Iterator[tuple[int, int, int]]:
    """Overlapping ``(kind, start, stop)`` proposals of addresses, with parts of any length."""
    for m in AT.finditer(text):
        start = m.start()
        while start and (text[start - 1] in LOCAL or start == m.start() and text[start - 1].isspace()):
            start -= 1
        host = HOST.match(text, m.end())
        if start < m.start() and host:
            yield 4, start + text[start].isspace(), host.end()


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of 7 digits or more, with at most two marks between two of them."""
    for m in RUN.finditer(text):
        yield m.span()


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Overlapping ``(kind, start, stop)`` proposals: far more than will be kept. Addresses first, then numbers run by run.

    Of every run of 7 digits or more the whole run is proposed, every digit group, and what several neighbouring groups make up to 31 digits; no group is ever cut.
    """
    yield from addresses(text)
    for run in runs(text):
        for a, b in _pieces(text, *run):
            yield 5, a, b


def _marked(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A number, also with a ``+`` or ``(`` just before."""
    yield a, b
    if a and text[a - 1] in "+(":
        yield a - 1, b


def _pieces(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """A run, and its parts that begin and end at borders of its digit groups."""
    yield from _marked(text, start, stop)
    groups = [m.span() for m in GROUP.finditer(text, start, stop)]
    for i, (a, _) in enumerate(groups):
        digits = 0
        for j, (x, b) in enumerate(groups[i : i + MOST_DIGITS]):
            digits += b - x
            if digits > MOST_DIGITS and j:
                break
            if digits >= LEAST_DIGITS and (a, b) != (start, stop):
                yield from _marked(text, a, b)


def _joined(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Base spans as disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for _, x, y in sorted(base, key=lambda s: s[1]):
        if out and x < out[-1][1]:
            x, y = out[-1][0], max(y, out.pop()[1])
        out.append((x, y))
    return out


def _meets(spans: list[tuple[int, int]], start: int, stop: int) -> list[tuple[int, int]]:
    """Those of disjoint ordered intervals that a span meets."""
    return spans[bisect_right(spans, start, key=lambda s: s[1]) : bisect_left(spans, stop, key=lambda s: s[0])]


def clear_of(text: str, proposals: Iterable[tuple[int, int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """The proposals clear of base spans (:func:`_joined`); an address that meets some gives way to what is proposed in its parts outside them.

    The parts of a number are proposals already. Numbers come as a stream; addresses are told apart first, since parts of several may be alike.
    """
    seen: set[tuple[int, int]] = set()
    for k, a, b in proposals:
        met = _meets(taken, a, b)
        if k == 5:
            if not met:
                yield k, a, b
            continue
        parts = zip([a, *(y for _, y in met)], [*(x for x, _ in met), b]) if met else ()
        own = [(x + u, x + v) for x, y in parts if x < y for _, u, v in addresses(text[x:y])] if met else [(a, b)]
        for span in own:
            if span not in seen:
                seen.add(span)
                yield k, *span


def seen_before(before: str) -> list[float]:
    """What the text before a proposal tells: a plus, a letter or digit, and the hints."""
    before = before.lower()
    return [float(before.endswith("+")), float(before[-1:].isalnum()), *(float(bool(h.search(before))) for h in HINTS)]


def features(text: str, kind: int, start: int, stop: int) -> list[float]:
    """Format and context of one proposal."""
    span = text[start:stop]
    plus, joined, *hints = seen_before(text[max(0, start - CONTEXT) : start])
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    quads = span.split(".")
    tail = re.split(r"[^A-Za-z0-9]+", span)[-1]
    return [
        float(kind),
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0),
        float(len(set(re.findall("(?<=[0-9])[^0-9]+(?=[0-9])", span)))),
        float(span.startswith("+") or plus),
        float(span.count(".")),
        float(span.count("-") + span.count(" ") + span.count("/")),
        float("(" in span),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(len(quads) == 4 and all(q.isascii() and q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quads)),
        float(9 <= len(digits) <= 15),
        float("@" in span),
        float(sum(c.isalpha() for c in span)) / max(1, len(span)),
        float(len(tail) if tail.isalpha() else 0),
        float(joined or text[stop : stop + 1].isalnum()),
        *hints,
    ]


def _variants(text: str, kind: int, start: int, stop: int) -> Iterator[tuple[str, int, int, int, float]]:
    """Other ways to write a valid span, and near misses of it, each in its own surroundings: ``(text, kind, start, stop, label)``."""
    left, span, right = text[max(0, start - CONTEXT) : start], text[start:stop], text[stop : stop + CONTEXT]
    d = _digits(span)
    made: list[tuple[int, str, float]] = []
    if kind == 0:
        name, _, host = span.partition("@")
        made = [(4, f"{name} (at) {host}", 1.0), (4, f"{name}[at]{host.replace('.', '[dot]')}", 1.0), (4, f"{name}@{host.replace('.', ' dot ')}", 1.0), (4, f"{name} at {host.replace('.', ' dot ')}", 1.0), (4, f"{name} [ at ] {host}", 1.0), (4, f"{name} [AT] {host.replace('.', ' [DOT] ')}", 1.0), (4, f"{name}@{host.split('.')[0]}.{len(host)}", 0.0)]
    elif kind == 1:
        made = [(5, f"{span}.{d[:2]}", 0.0), (5, ".".join(str(int(p) + 256) for p in span.split(".")), 0.0), (5, span.replace(".", "-"), 0.0)]
    elif kind == 2:
        wrong = d[:-1] + str((int(d[-1]) + 5) % 10)
        grouped = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in (d, wrong)]
        made = [(5, ".".join(d[i : i + 4] for i in range(0, len(d), 4)), 1.0), (5, grouped[1], 0.0), (5, wrong, 0.0), (5, d[:9], 0.0), (5, d + d[:6], 0.0)]
    elif kind == 3:
        own = d[-10:]
        made = [(5, f"{own[:3]}-{own[3:6]}-{own[6:]}", 1.0), (5, f"({own[:3]}) {own[3:6]}-{own[6:]}", 1.0), (5, f"{own[:3]}.{own[3:6]}.{own[6:]}", 1.0), (5, own, 0.0), (5, f"20{own[:2]}-{own[2:4]}-{own[4:6]}", 0.0), (5, own[:7], 0.0)]
    for k, new, label in made:
        yield left + new + right, k, len(left), len(left) + len(new), label
        if k == 5 and label:
            date = f"{left}20{d[:2]}-{d[2:4]}-{d[4:6]} "
            yield f"{date}{new} {new}{right}", k, len(date), len(date) + len(new), label


def _clear(taken: list[tuple[int, int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which spans meet none of disjoint ordered intervals."""
    begins, ends = (np.array([s[k] for s in taken] or [1 << 62]) for k in (0, 1))
    at = np.searchsorted(ends, a, side="right")
    return (at >= len(ends)) | (begins[np.minimum(at, len(ends) - 1)] >= b)


def _examples(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks ``(features, labels)`` of a text's proposals and of its base spans' other forms, with the parts and mergers of the true ones.

    Every proposal counts, however many there are; those of runs of very many groups are made as arrays.
    """
    base = base_spans(text)
    taken, exact = _joined(base), {s[1:] for s in base}
    vast = [s for s in runs(text) if s[1] - s[0] > LONG_RUN]

    def proposed() -> Iterator[tuple[int, int, int]]:
        yield from addresses(text)
        for start, stop in runs(text):
            own = _marked(text, start, stop) if stop - start > LONG_RUN else _pieces(text, start, stop)
            yield from ((5, a, b) for a, b in own)

    def single() -> Iterator[tuple[list[float], float]]:
        for k, a, b in proposed():
            met = any((x, b) in exact for x in (a - 1, a, a + 1))
            if met or not _meets(taken, a, b):
                yield features(text, k, a, b), float(met)
        for s in base:
            for t, k, a, b, label in _variants(text, *s):
                yield features(t, k, a, b), label
                if k == 5 and label:
                    for _, x, y in candidates(t):
                        if x < b and a < y and not (abs(x - a) <= 1 and y == b):
                            yield features(t, k, x, y), 0.0

    made = single()
    while rows := list(islice(made, MOST_ROWS)):
        yield np.array([x for x, _ in rows]), np.array([y for _, y in rows])
    codes = np.array([a * (len(text) + 1) + b for a, b in exact], dtype=np.int64)
    for run in vast:
        for a, b, rows, _ in Run(text, *run).slices(LEAST_DIGITS, MOST_DIGITS, seen_before):
            met = np.isin(np.stack([(a + d) * (len(text) + 1) + b for d in (-1, 0, 1)]), codes).any(axis=0)
            kept = met | _clear(taken, a, b)
            yield rows[kept], met[kept].astype(float)


def _counted(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, counts)``: a text's examples as steps of ``GRID`` with the label last, equal ones of a block together."""
    for x, y in _examples(text):
        if len(x):
            steps = np.searchsorted(GRID, x, side="right") - 1
            yield np.unique(np.column_stack([steps, y]).astype(np.uint8), axis=0, return_counts=True)


@dataclass(frozen=True)
class Model:
    """Boosted trees as arrays: node ``i`` of a tree goes to ``left`` if feature <= threshold; leaves point to themselves.

    ``thresholds`` has the least accepted score of each added kind, ``held`` its recall and precision on held-out proposals, by the kind's name.
    """

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    held: dict[str, dict[str, float]] = field(default_factory=dict)

    def accepts(self, kind: int, score: float) -> bool:
        """Whether a proposal of a kind is kept; a kind without a threshold never is."""
        return score >= self.thresholds.get(kind, 2.0)

    def score(self, rows: list[list[float]]) -> np.ndarray:
        """Probability that each row is personal data."""
        x = np.asarray(rows, dtype=float).reshape(len(rows), -1).T.copy()  # a feature's values side by side
        total = np.zeros(x.shape[1])

        def down(tree: tuple[np.ndarray, ...], node: int) -> np.ndarray | float:
            feature, cut_at, left, right, value = tree
            if left[node] == node:
                return value[node]
            return np.where(x[feature[node]] <= cut_at[node], down(tree, left[node]), down(tree, right[node]))

        for tree in self.trees:
            total += down(tree, 0)
        return 1 / (1 + np.exp(-2 * total))


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows ``(features, label, held, n)``: all examples of all distinct texts, with features rounded down to ``GRID`` and equal ones counted.

    A proposal that covers a valid base span alone is positive, one that meets none is negative, others are left out; valid
    spans also give rewritten forms and near misses with known labels. ``held`` rows, those of a quarter of the texts, calibrate the thresholds.
    Texts without digits or signs that could make an example are not shuffled.
    """
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike(TELLING)).distinct()
    texts = texts.select("text", (F.pmod(F.xxhash64("text", F.lit("hold")), F.lit(4)) == 0).alias("held"))

    def rows(counts: Counter) -> pa.RecordBatch:
        steps = np.frombuffer(b"".join(k for k, _ in counts), dtype=np.uint8).reshape(len(counts), -1)
        values = GRID[steps[:, :-1]]
        offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * values.shape[1])
        columns = [
            pa.ListArray.from_arrays(offsets, pa.array(values.ravel())),
            pa.array(steps[:, -1].astype(float)),
            pa.array([held for _, held in counts], pa.bool_()),
            pa.array(list(counts.values()), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["features", "label", "held", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in small_batches(batches, "text"):
            for text, held in zip(as_text(batch, "text"), batch.column("held").to_pylist()):
                for kinds, often in _counted(text):
                    for k, n in zip(kinds, often.tolist()):
                        counts[k.tobytes(), held] += n
                    if len(counts) >= MOST_ROWS:
                        yield rows(counts)
                        counts.clear()
        if counts:
            yield rows(counts)

    counted = texts.mapInArrow(run, "features array<double>, label double, held boolean, n long")
    return counted.groupBy("features", "label", "held").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", rounds: int = 12, depth: int = 4, precision: float = 0.99) -> Model:
    """Boost trees on all labelled proposals; each added kind's threshold is the least score from which its held rows are ``precision`` pure.

    Equal examples are one row with their number as weight, and the trees may split between any two values of a feature (bins for all of ``GRID``, and
    so many that Spark looks for splits in all rows). Held rows are scored in place and reach the driver as counts of a thousand score steps per kind
    and label. Without both labels nothing is learned, and only the fixed formats count; a kind that no threshold makes pure enough is never accepted.
    Copies of a text count once; null and empty texts teach nothing; an empty table gives the empty model.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = cut(labelled(docs, text_col).withColumnRenamed("features", "raw"))
    sizes = {(x["held"], x["label"]): x["count"] for x in rows.groupBy("held", "label").count().collect()}
    if not {(False, 0.0), (False, 1.0)} <= set(sizes):
        return Model()
    n = sum(v for (held, _), v in sizes.items() if not held)
    given = rows.where("not held").repartition(1 + n // MOST_ROWS, "raw").sortWithinPartitions("raw", "label")  # equal sums in every run
    bins = max(len(GRID) + 1, isqrt(n) + 1)
    fit = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, maxBins=bins, weightCol="n").fit(given.select(array_to_vector("raw").alias("features"), "label", "n"))
    model = Model([_arrays(t.rootNode(), w) for t, w in zip(fit._java_obj.trees(), fit.treeWeights)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            if raw:
                steps = np.floor(model.score(raw) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in raw], pa.int32()), pa.array(steps, pa.int32()), batch.column("label"), batch.column("n")], names=["kind", "step", "label", "n"])

    scored = rows.where("held").select("raw", "label", "n").mapInArrow(score, "kind int, step int, label double, n long")
    counts = np.zeros((len(KINDS), STEPS + 1, 2))
    for x in scored.groupBy("kind", "step", "label").agg(F.sum("n").alias("n")).collect():  # at most kinds x steps x 2 rows
        counts[x["kind"], x["step"], int(x["label"])] = x["n"]
    thresholds, held = {}, {}
    for kind in (4, 5):
        above = counts[kind, ::-1].cumsum(axis=0)[::-1]  # false and true ones from each step up
        pure = np.divide(above[:, 1], above.sum(axis=1), out=np.zeros(STEPS + 1), where=above.sum(axis=1) > 0)
        fine = np.nonzero(pure[STEPS // 2 :] >= precision)[0]
        if len(fine):
            step = STEPS // 2 + int(fine[0])
            thresholds[kind] = step / STEPS
            held[KINDS[kind]] = {"recall": float(above[step, 1] / above[0, 1]), "precision": float(pure[step]), "proposals": float(above[0].sum())}
    return Model(model.trees, thresholds, held)


def _arrays(root: object, weight: float) -> tuple[np.ndarray, ...]:
    """A fitted tree's nodes as arrays; a threshold is set just below the next value of ``GRID``, so that features need no rounding to be scored."""
    rows: list[list[float]] = []
    todo = [(root, -1, 2)]
    while todo:
        node, parent, side = todo.pop()
        at = len(rows)
        rows.append([0, 0.0, at, at, float(node.prediction()) * weight])
        if parent >= 0:
            rows[parent][side] = at
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][0], rows[at][1] = split.featureIndex(), np.nextafter(GRID[np.searchsorted(GRID, split.threshold(), side="right")], -np.inf)
            todo += [(node.leftChild(), at, 2), (node.rightChild(), at, 3)]
    f, t, left, right, value = zip(*rows)
    return np.array(f), np.array(t), np.array(left), np.array(right), np.array(value)


class _Choice:
    """The best of a text's accepted proposals that do not meet each other, decided as they come.

    Better is the higher score, then the longer, then the earlier one. One is taken as soon as nothing better that is still open, and nothing that may
    come later, can meet it; so what waits is what lies about the frontier, however long the text.
    """

    def __init__(self) -> None:
        self.open: list[tuple[float, int, int, int, int]] = []
        self.taken: list[tuple[int, int]] = []
        self.found: list[tuple[int, int, int, float]] = []

    def add(self, kind: int, a: int, b: int, score: float) -> None:
        self.open.append((-score, a - b, a, kind, b))

    def settle(self, frontier: float = float("inf")) -> None:
        """Decides what can be decided, if all that comes later begins at or behind ``frontier``."""
        if not self.open:
            return
        low, high = min(x[2] for x in self.open), max(x[4] for x in self.open)
        used, held = bytearray(high - low), bytearray(high - low)  # places of taken and of waiting ones
        for a, b in _meets(self.taken, low, high):
            a, b = max(a, low) - low, min(b, high) - low
            used[a:b] = b"\1" * (b - a)
        waiting, found = [], []
        for x in sorted(self.open):
            a, b = x[2] - low, x[4] - low
            if used.find(1, a, b) >= 0:
                continue
            if x[4] > frontier or held.find(1, a, b) >= 0:
                waiting.append(x)
                held[a:b] = b"\1" * (b - a)
            else:
                used[a:b] = b"\1" * (b - a)
                found.append(x)
        self.open = waiting
        self.taken += sorted((x[2], x[4]) for x in found)
        self.taken.sort()
        self.found += ((kind, a, b, -score) for score, _, a, kind, b in found)


def _long_run(text: str, start: int, stop: int, taken: list[tuple[int, int]], model: Model, choice: _Choice) -> None:
    """Scores and settles the proposals of a run of very many groups slice by slice."""
    run = Run(text, start, stop)

    def scored() -> Iterator[tuple[list[tuple[float, int, int]], int]]:
        for a, b, rows, frontier in run.slices(LEAST_DIGITS, MOST_DIGITS, seen_before):
            free = _clear(taken, a, b)
            a, b, rows = a[free], b[free], rows[free]
            good: list[tuple[float, int, int]] = []
            for k in range(0, len(a), MOST_ROWS):
                scores = model.score(rows[k : k + MOST_ROWS])
                keep = np.nonzero(scores >= model.thresholds.get(5, 2.0))[0]
                good += zip(scores[keep].tolist(), a[k + keep].tolist(), b[k + keep].tolist())
            yield good, frontier

    whole = [s for s in _marked(text, start, stop) if not _meets(taken, *s)]
    scores = model.score([features(text, 5, *s) for s in whole]) if whole else []
    best = [(float(x), *s) for x, s in zip(scores, whole) if model.accepts(5, x)]
    if best and not any(x[2] < stop and x[4] >= start for x in choice.open):
        # the whole run stands against all its parts; if none is better, it alone is open
        top = min((-x, a - b, a) for x, a, b in best)
        if not any((-x, a - b, a) < top for good, _ in scored() for x, a, b in good):
            choice.add(5, top[2], top[2] - top[1], -top[0])
            return
    for x, a, b in best:
        choice.add(5, a, b, x)
    for good, frontier in scored():
        for x, a, b in good:
            choice.add(5, a, b, x)
        choice.settle(frontier)


def find(texts: list[str], model: Model) -> list[list[tuple[int, int, int, float]]]:
    """``(kind, start, stop, score)`` of each text, by kind, then start: all base spans (score 1), and accepted proposals.

    Accepted proposals meet no base span and no better proposal; ties go to the longer, then the earlier one. Proposals are a stream that is
    scored some thousands at a time, and only accepted ones are held until they are decided; runs of very many digit groups are scored as arrays.
    """
    bases = [base_spans(text) for text in texts]
    choices: dict[int, _Choice] = {}
    waiting: list[tuple[int, int, int, int]] = []

    def flush(text: int = -1, frontier: float = float("inf")) -> None:
        """Scores what waits and decides it; ``text`` alone has proposals to come, which begin at or behind ``frontier``."""
        if waiting:
            scores = model.score([features(texts[i], k, a, b) for i, k, a, b in waiting])
            for x, (i, k, a, b) in zip(scores.tolist(), waiting):
                if model.accepts(k, x):
                    choices.setdefault(i, _Choice()).add(k, a, b, x)
            waiting.clear()
        for i, own in choices.items():
            if own.open:
                own.settle(frontier if i == text else float("inf"))

    for i, text in enumerate(texts if model.trees else []):
        taken = _joined(bases[i])
        for k, a, b in clear_of(text, addresses(text), taken):
            waiting.append((i, k, a, b))
            if len(waiting) >= MOST_ROWS:
                flush(i, -1)
        for start, stop in runs(text):
            if stop - start > LONG_RUN:
                flush(i, start - 1)
                _long_run(text, start, stop, taken, model, choices.setdefault(i, _Choice()))
                continue
            waiting += ((i, 5, a, b) for a, b in _pieces(text, start, stop) if not _meets(taken, a, b))
            if len(waiting) >= MOST_ROWS:
                flush(i, start - 1)
    flush()
    return [[(*s, 1.0) for s in base] + sorted(choices[i].found if i in choices else []) for i, base in enumerate(bases)]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, spans)``, one per document: ``(kind, start, stop, score)`` in code points by kind, then start.

    Null and empty texts have no spans. Repeated rows stay repeated with equal spans, null ids stay null; of proposals with equal scores the longer,
    then the earlier one wins. Whole texts, whatever their length, in batches of a few MB; no shuffle. Extra columns are ignored whatever
    their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in small_batches(batches, "text"):
            found = [[dict(zip(("kind", "start", "stop", "score"), s)) for s in spans] for spans in find(as_text(batch, "text"), model)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, spans {SPANS}")


def written(spans):
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def redacted(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """The text with every span, or spans that overlap together, replaced by the first one's kind in brackets."""
    out, end = [], 0
    for kind, start, stop, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``, and ``length_col`` (if there) the new number of code points.

    Rows without a span, null and empty texts and all other columns, whatever their names, are as they were. Spans that overlap are replaced together; every
    row stays, repeated ones alike; an empty table gives an empty one.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            texts = as_text(batch, text_col)
            found = find(texts, model)
            new = [redacted(t, s) if s else t for t, s in zip(texts, found)]
            given = batch.column(text_col).is_valid().to_pylist()
            columns = {n: batch.column(n) for n in names}
            columns[text_col] = pa.array([t if ok else None for t, ok in zip(new, given)], batch.column(text_col).type)
            if length_col in columns:
                lengths = columns[length_col]
                own = [len(t) if s else n for t, s, n in zip(new, found, lengths.to_pylist())]
                columns[length_col] = pa.array(own, lengths.type)
            yield pa.RecordBatch.from_arrays([*columns.values()], names=names)

    return docs.mapInArrow(run, docs.schema)
