"""Language ID: per-language unigrams over a fixed piece vocabulary, summed over all segmentations of each word."""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut, drawn_texts, small_batches

WORD = regex.compile(r"\p{L}+")
UNKNOWN = "und"
RESCALED = 16  # bytes between rescalings, so that no product of probabilities underflows, however long a word is
LONG = 4_096  # bytes from which a word is scored in stretches side by side
STRETCH, STRETCHES = 256, 2_048  # bytes of a stretch, stretches that one pass works on
LEARNED = 1_024  # letters of the parts in which longer words are learned
TOGETHER = 16_384  # words that one pass works on
CELLS = 2_000_000  # numbers that one pass of the training keeps


class Pieces:
    """All pieces of a rank file as a trie: ``step`` walks it for many words at once, ``piece`` gives a node's piece (0: none).

    Nodes are numbered by length, then bytes (the root is 0), so that the keys (parent, byte) of all other nodes are sorted.
    Every byte is a piece, so every word has a segmentation.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        prefixes = sorted({p[:i] for p in pieces for i in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        number = {b"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        self.keys = np.array([number[p[:-1]] * 256 + p[-1] for p in prefixes], dtype=np.int64)
        self.piece = np.zeros(len(number), dtype=np.int64)
        self.piece[[number[p] for p in sorted(set(pieces))]] = np.arange(1, len(set(pieces)) + 1)
        self.count, self.longest = len(set(pieces)), max(map(len, pieces))
        near = np.arange(257 * 256)  # the first two steps are a table
        self.near = self._find(near)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, 0)

    def step(self, nodes: np.ndarray, letters: np.ndarray, depth: int) -> np.ndarray:
        """The nodes that the next letters lead to; 0: no piece begins so."""
        keys = nodes * 256 + letters
        return self.near[keys] if depth <= 2 else self._find(keys)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    """All pieces of a rank file."""
    with open(path, "rb") as f:
        return Pieces([base64.b64decode(line.split()[0]) for line in f])


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall(text.lower())


def unit(word: str) -> bytes:
    """A word as the vocabulary writes it, after a blank."""
    return b" " + word.encode("utf-8")


class Batch:
    """Words of any lengths side by side, longest first: the pieces that begin at one place in all of them."""

    def __init__(self, units: list[bytes], pieces: Pieces) -> None:
        self.pieces = pieces
        self.length = np.array([len(u) for u in units])
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(units), dtype=np.uint8).astype(np.int64)

    def alive(self, at: int) -> int:
        """How many words are longer than ``at``."""
        return int(np.searchsorted(-self.length, -at, side="left"))

    def beginning(self, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, words, piece ids)`` of the pieces that begin at byte ``at``."""
        own = np.arange(self.alive(at))
        nodes = np.zeros(len(own), dtype=np.int64)
        for size in range(1, self.pieces.longest + 1):
            inside = self.alive(at + size - 1)
            if inside < len(self.length):
                own = own[: np.searchsorted(own, inside)]
                nodes = nodes[: len(own)]
            nodes = self.pieces.step(nodes, self.letters[self.start[own] + (at + size - 1)], size)
            on = nodes > 0
            own, nodes = own[on], nodes[on]
            if not len(own):
                return
            ids = self.pieces.piece[nodes]
            whole = ids > 0
            yield size, own[whole], ids[whole]


def grouped(units: list[bytes], most: int, cells: int | None = None) -> Iterator[np.ndarray]:
    """Places of ``units``, longest first, in groups of at most ``most`` words (and ``cells`` bytes, the longest word counted for each)."""
    order = np.argsort([-len(u) for u in units], kind="stable")
    begun = 0
    while begun < len(order):
        own = most if cells is None else max(1, min(most, cells // (len(units[order[begun]]) + 1)))
        yield order[begun : begun + own]
        begun += own


def log_likelihoods(units: list[bytes], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """log P(unit) by language, all segmentations summed by the forward algorithm; units are not empty and may have any length."""
    out = np.zeros((len(units), chances.shape[1]))
    long = [i for i, u in enumerate(units) if len(u) > LONG]
    for i in long:
        out[i] = long_log_likelihood(units[i], pieces, chances)
    short = np.array([i for i, u in enumerate(units) if len(u) <= LONG], dtype=np.int64)
    for own in grouped([units[i] for i in short], TOGETHER):
        places = short[own]
        batch = Batch([units[i] for i in places], pieces)
        ring = min(pieces.longest, int(batch.length[0])) + 1  # no piece is longer than a word
        ahead = np.zeros((ring, len(places), chances.shape[1]))  # sums of the places ahead, over exp(logs)
        logs = np.zeros((len(places), chances.shape[1]))
        ahead[0] = 1.0
        for at in range(int(batch.length[0])):
            live = batch.alive(at)
            if at and at % RESCALED == 0:
                scale = ahead[at % ring, :live].copy()
                ahead[:, :live] /= scale
                logs[:live] += np.log(scale)
            now = ahead[at % ring]
            for size, own, ids in batch.beginning(at):
                ahead[(at + size) % ring, own] += now[own] * chances[ids]
            ahead[at % ring] = 0.0
            ended = batch.alive(at + 1)
            logs[ended:live] += np.log(ahead[(at + 1) % ring, ended:live])
        out[places] = logs
    return out


def long_log_likelihood(unit: bytes, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """:func:`log_likelihoods` of one long unit, exactly, in time and memory that do not grow with a Python step for each byte.

    Sums at a place depend on those at the last few places alone, as many as the longest piece that occurs: a stretch of bytes is a matrix that takes the
    sums before it to those at its end. The matrices of many stretches are made side by side, then multiplied in order.
    """
    languages = chances.shape[1]
    logs = np.zeros(languages)
    letters = np.frombuffer(unit, dtype=np.uint8)
    wide = STRETCH * STRETCHES
    depth = max(len(_occurring(letters[b : b + wide + pieces.longest], pieces)) for b in range(0, len(letters), wide))
    # pieces that repeat one letter may be long: fewer stretches at a time then, so that their matrices stay few MB
    wide = STRETCH * max(1, min(STRETCHES, CELLS // (depth * depth * languages)))
    spans = range(0, len(letters), wide)
    sums = np.zeros((languages, depth))  # at the last places, the latest first
    sums[:, 0] = 1.0
    for begin in spans:
        before = min(begin, depth)
        own = letters[begin - before : begin + wide]
        found = _occurring(own, pieces)[:depth]
        found += [np.zeros(len(own), dtype=np.int32)] * (depth - len(found))
        whole, rest = divmod(len(own) - before, STRETCH)
        for first, many, length in ((before, whole, STRETCH), (before + whole * STRETCH, 1, rest)):
            if not many or not length:
                continue
            matrices, scales = _stretches(found, first, many, length, chances)
            for matrix, scale in zip(matrices, scales):
                sums = np.einsum("lij,lj->li", matrix, sums)
                top = sums.max(axis=1, keepdims=True)
                sums, logs = sums / top, logs + np.log(top[:, 0]) + scale
    return logs + np.log(sums[:, 0])


def _occurring(letters: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """For each size, from 1 to the longest that occurs, the id of the piece that begins at each place (0: none)."""
    letters = letters.astype(np.int64)
    out, own, nodes = [], np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64)
    for size in range(1, pieces.longest + 1):
        inside = own + size <= len(letters)
        own, nodes = own[inside], nodes[inside]
        nodes = pieces.step(nodes, letters[own + size - 1], size)
        own, nodes = own[nodes > 0], nodes[nodes > 0]
        if not len(own):
            break
        ids = np.zeros(len(letters), dtype=np.int32)
        ids[own] = pieces.piece[nodes]
        out.append(ids)
    while len(out) > 1 and not out[-1].any():
        out.pop()
    return out


def _stretches(found: list[np.ndarray], first: int, many: int, length: int, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(matrices, logs)`` of ``many`` stretches of ``length`` bytes from place ``first``: by stretch and language, over exp(logs)."""
    depth, languages = len(found), chances.shape[1]
    starts = first + length * np.arange(many)
    # the sums at the last places (ring), for one unit sum at each of the places before the stretch
    ring = np.zeros((depth, many, languages, depth))
    for k in range(depth):
        ring[-k % depth, :, :, k] = 1.0
    logs = np.zeros((many, languages))
    for t in range(1, length + 1):
        new = np.zeros((many, languages, depth))
        for size, ids in enumerate(found, 1):
            begun = starts + t - size
            at = np.where(begun >= 0, ids[np.maximum(begun, 0)], 0)
            on = np.nonzero(at)[0]
            if len(on):
                new[on] += chances[at[on]][:, :, None] * ring[(t - size) % depth, on]
        ring[t % depth] = new
        if t % RESCALED == 0:
            scale = ring.max(axis=(0, 3))
            ring /= scale[None, :, :, None]
            logs += np.log(scale)
    last = [(length - k) % depth for k in range(depth)]
    return ring[last].transpose(1, 2, 0, 3), logs


def expected_pieces(units: list[bytes], counts: np.ndarray, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``units`` seen ``counts`` times, by forward and backward sums. Memory grows with the longest word."""
    used = np.zeros(len(chances))
    for places in grouped(units, TOGETHER, CELLS):
        batch = Batch([units[i] for i in places], pieces)
        ring = min(pieces.longest, int(batch.length[0])) + 1  # no piece is longer than a word
        n, m = int(batch.length[0]), len(places)
        alpha, scales = np.zeros((n + 1, m)), np.zeros((n + 1, m))  # the sum to a place is alpha times exp(scales)
        alpha[0] = 1.0
        for at in range(n):
            live = batch.alive(at)
            if at and at % RESCALED == 0:
                scale = alpha[at, :live].copy()
                alpha[at : at + ring, :live] /= scale
                scales[at:, :live] += np.log(scale)
            for size, own, ids in batch.beginning(at):
                alpha[at + size, own] += alpha[at, own] * chances[ids]
        row = np.arange(m)
        total = np.log(alpha[batch.length, row]) + scales[batch.length, row]
        beta, after = np.zeros((ring, m)), np.zeros(m)
        for at in range(n - 1, -1, -1):
            live = batch.alive(at)
            ended = slice(batch.alive(at + 1), live)
            beta[(at + 1) % ring, ended] = 1.0
            beta[at % ring, :live] = 0.0
            weight = np.exp(scales[at, :live] + after[:live] - total[:live]) * alpha[at, :live] * counts[places[:live]]
            for size, own, ids in batch.beginning(at):
                rest = chances[ids] * beta[(at + size) % ring, own]
                beta[at % ring, own] += rest
                used += np.bincount(ids, weights=weight[own] * rest, minlength=len(used))
            if at % RESCALED == 0:
                scale = beta[at % ring, :live].copy()
                beta[:, :live] /= scale
                after[:live] += np.log(scale)
    used[0] = 0.0
    return used


@dataclass(frozen=True)
class Model:
    """Languages in order, and for every piece (row 0: no piece) its probability in each."""

    vocabulary: str
    languages: list[str]
    chances: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC of its id as text is 1 modulo 3."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 600, rounds: int = 2, floor: float = 0.02
) -> Model:
    """Fit piece probabilities by expectation maximisation over the words of labelled documents.

    Learns from rows whose id is not held out and whose label is not null, about ``docs_per_language`` distinct texts of each
    language (of the 1,000 with the most texts), chosen by a hash of the text: the documented bound of the fit. Words of more than 1,024 letters are learned
    in parts of so many. Word counts of that sample are one Spark table; every
    round sums expected piece uses over it (at most pieces x languages rows reach the driver). ``floor`` pseudo-uses of each
    piece keep every word possible in every language. No labelled row: a model without languages.
    """
    labelled = docs.where(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    drawn = drawn_texts(labelled, "text", docs_per_language, "langid", by="lang")
    pieces = vocabulary(path).count + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            seen = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), as_text(batch, "text")):
                seen.update((lang, w[k : k + LEARNED]) for w in words(text) for k in range(0, len(w), LEARNED))
            rows = [(k, w, n) for (k, w), n in seen.items()]
            yield pa.RecordBatch.from_pylist([{"lang": k, "word": w, "n": n} for k, w, n in rows], SEEN)

    table = cut(drawn.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(x["lang"] for x in table.select("lang").distinct().collect())
    if not languages:
        return Model(path, [], np.zeros((pieces, 0)))
    column = {k: i for i, k in enumerate(languages)}
    chances = np.full((pieces, len(languages)), 1.0 / (pieces - 1))
    chances[0] = 0.0
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], chances: np.ndarray = chances) -> Iterator[pa.RecordBatch]:
            known = vocabulary(path)
            for batch in batches:
                rows = defaultdict(list)
                for k, w, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                    rows[k].append((unit(w), n))
                for k, own in rows.items():
                    used = expected_pieces([u for u, _ in own], np.array([n for _, n in own], dtype=float), known, chances[:, column[k]])
                    at = np.nonzero(used)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(used[at])], names=["lang", "piece", "used"])

        uses = table.mapInArrow(expect, "lang string, piece long, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used"))
        counts = np.full((pieces, len(languages)), floor)
        counts[0] = 0.0
        for x in uses.toLocalIterator():
            counts[x["piece"], column[x["lang"]]] += x["used"]
        chances = counts / counts.sum(axis=0)
    return Model(path, languages, chances)


SEEN = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


class Scorer:
    """Scores texts with a bounded memory of words seen."""

    def __init__(self, model: Model, evidence: int = 20, remembered: int = 400_000) -> None:
        self.model, self.evidence, self.remembered = model, evidence, remembered
        self.pieces = vocabulary(model.vocabulary)
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.values = np.zeros((0, len(self.model.languages)))

    def sums(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """Words and log-likelihoods of each text, all words counted."""
        if self.held > 10 * self.remembered or len(self.at) > self.remembered:
            self._reset()
        split = [words(t) for t in texts]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.at))
        if new:
            logs = log_likelihoods([unit(w) for w in new], self.pieces, self.model.chances)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.held += sum(map(len, new))
            self.values = np.concatenate([self.values, logs])
        return [(ws, self.values[[self.at[w] for w in ws]].sum(axis=0)) for ws in split]

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text: the language's posterior, all words counted, as from ``evidence`` words at most."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for ws, logs in self.sums(texts):
            if not ws:
                out.append((UNKNOWN, 0.0))
                continue
            logs = logs * min(1.0, self.evidence / len(ws))
            chance = np.exp(logs - logs.max())
            best = int(chance.argmax())
            out.append((self.model.languages[best], float(chance[best] / chance.sum())))
        return out

    def explained(self, texts: list[str]) -> list[bool]:
        """Whether a learned language explains a text's words better than bytes drawn with equal chances do; never without a letter."""
        if not self.model.languages:
            return [False] * len(texts)
        return [bool(ws and logs.max() > -np.log(256) * sum(len(unit(w)) for w in ws)) for ws, logs in self.sums(texts)]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score)``, one per document, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Ties go to the first language
    in order. Repeated rows stay repeated, null ids stay null. No shuffle; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in small_batches(batches, "text", 2_000_000):
            found = scorer.score(as_text(batch, "text"))
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def measured(predicted: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows ``(lang, n, recall, precision)`` over held-out documents with a label, one per label; ids are taken as unique.

    A label that was never predicted has a null precision. Rows of ``labels`` without an id or a label count for nothing.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    pairs = predicted.where("held_out").select("doc_id", "lang_pred").join(known, "doc_id").groupBy("lang", "lang_pred").agg(F.count("*").alias("n"))
    true = pairs.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("lang") == F.col("lang_pred"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col("lang_pred").alias("lang")).agg(F.sum("n").alias("said"))
    out = true.join(said, "lang", "left")
    return out.select("lang", "n", (F.col("hit") / F.col("n")).alias("recall"), F.try_divide(F.col("hit"), F.col("said")).alias("precision"))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text a learned language explains, all columns kept.

    What goes: null texts, texts without a letter, texts whose words equally likely bytes explain at least as well as
    every learned language does (noise, unlearned scripts; a test that does not depend on how many languages there are), and all rows if nothing was learned. Every row is
    judged by its whole text alone: repeated rows stay or go together, ids and other columns (whatever their names) are not looked at. An empty
    table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in small_batches(batches, text_col, 2_000_000):
            yield batch.filter(pa.array(scorer.explained(as_text(batch, text_col)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
