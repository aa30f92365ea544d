"""Byte-level BPE by vectorised pre-tokenisation and cached pair merging, with decoding.

Nothing here calls a tokenizer library: a rank file is the only input. Texts of a batch become one array of code point
classes; a small automaton over the classes says where slices begin. Its transitions are functions from state to
state, whose composition is associative, so blocks of symbols are scanned side by side and joined by a doubling scan.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, small_batches

# Unicode White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What follows the apostrophe of a contraction.
ONE, TWO = "stmd", ("re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: States: what the slice under way can still take in.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_BLANK, ONE_LEFT, TWO_LEFT, CLOSED = range(8)
STATES = 8
#: Symbols: a class, or what the neighbours make of it.
RESET, S_LETTER, S_NUMBER, S_OTHER, QUOTE_ONE, QUOTE_TWO, S_SPACE, LAST_BLANK, LAST_SPACE = range(9)
SYMBOLS = 9
BLOCK = 64


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point (planes from the fifth on hold neither letters nor numbers)."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    table[:0x40000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)]
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, begins a slice)`` for symbol * STATES + state."""
    after = np.full((SYMBOLS, STATES), CLOSED, dtype=np.uint8)
    begins = np.ones((SYMBOLS, STATES), dtype=bool)
    for symbol, run in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS), (QUOTE_ONE, IN_OTHERS), (QUOTE_TWO, IN_OTHERS)):
        after[symbol] = {QUOTE_ONE: ONE_LEFT, QUOTE_TWO: TWO_LEFT}.get(symbol, run)  # a quote that opens a slice is a contraction
        after[symbol, [run, AFTER_BLANK]] = run
        begins[symbol, [run, AFTER_BLANK]] = False
    after[S_LETTER, [ONE_LEFT, TWO_LEFT]] = CLOSED, ONE_LEFT
    begins[S_LETTER, [ONE_LEFT, TWO_LEFT]] = False
    after[S_SPACE] = IN_SPACES
    begins[S_SPACE, IN_SPACES] = False
    after[LAST_BLANK] = AFTER_BLANK
    return after.ravel(), begins.ravel()


def symbols(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``edges`` are the places of the marks between texts."""
    kind = class_table()[points]
    kind[edges] = EDGE
    following = np.append(kind[1:], np.uint8(EDGE))
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE, RESET], dtype=np.uint8)[kind]
    last = (kind == SPACE) & (following != SPACE) & (following != EDGE)
    out[last] = LAST_SPACE
    out[last & (points == 0x20)] = LAST_BLANK
    at = np.nonzero((points == ord("'")) & (kind == OTHER))[0]
    one = points[np.minimum(at + 1, len(points) - 1)]
    two = points[np.minimum(at + 2, len(points) - 1)]
    out[at[np.isin(one, [ord(c) for c in ONE])]] = QUOTE_ONE
    for a, b in TWO:
        out[at[(one == ord(a)) & (two == ord(b))]] = QUOTE_TWO
    return out


def slice_starts(codes: np.ndarray) -> np.ndarray:
    """Where slices begin: for every symbol, whether it does."""
    after, begins = automaton()
    blocks = -(-len(codes) // BLOCK)
    grid = np.zeros(blocks * BLOCK, dtype=np.uint8)
    grid[: len(codes)] = codes
    grid = grid.reshape(blocks, BLOCK).T.astype(np.uint8) * np.uint8(STATES)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in grid:  # each block as one function of the state before it
        whole = after[column[:, None] + whole]
    reach = 1
    while reach < blocks:  # doubling scan: compose with the function that ends ``reach`` blocks before
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].copy(), axis=1)
        reach *= 2
    state = np.append(np.uint8(CLOSED), whole[:-1, CLOSED])
    out = np.empty((BLOCK, blocks), dtype=bool)
    for j, column in enumerate(grid):
        at = column + state
        out[j], state = begins[at], after[at]
    return out.T.ravel()[: len(codes)]


class Bpe:
    """Ranks of a byte-level vocabulary, with a bounded cache of encoded slices."""

    def __init__(self, ranks: dict[bytes, int], cached: int = 150_000, long_slice: int = 256) -> None:
        self.ranks, self.cached, self.long_slice = ranks, cached, long_slice
        size = max(ranks.values()) + 1
        self.size = np.zeros(size, dtype=np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)
        self.first = np.cumsum(self.size) - self.size
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(p for p, _ in ordered), dtype=np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.none = np.int64(1 << 40)
        self._reset()

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of all mergeable pairs of ids, and what they merge to; a worker that only decodes never builds them."""
        ranks = self.ranks
        keys, merged = [], []
        for p, i in ranks.items():
            for k in range(1, len(p)):
                if p[:k] in ranks and p[k:] in ranks:
                    keys.append((ranks[p[:k]] << 32) | ranks[p[k:]])
                    merged.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        return np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order]

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.starts, self.counts = [np.zeros(0, np.int64)] * 3

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or ``none``."""
        pairs, merged = self.merges
        if not len(pairs):
            return np.full(len(left), self.none)
        key = (left << 32) | right
        i = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[i] == key, merged[i], self.none)

    def _pair(self, left: int, right: int) -> int | None:
        pairs, merged = self.merges
        i = int(np.searchsorted(pairs, (left << 32) | right))
        return int(merged[i]) if i < len(pairs) and pairs[i] == (left << 32) | right else None

    def _merge_long(self, piece: bytes) -> list[int]:
        """Lowest pair first, leftmost on ties, by a heap over a linked list: for slices of any length."""
        n = len(piece)
        ids = [int(self.of_byte[b]) for b in piece]
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._pair(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            ahead[i] = ahead[j]
            if ahead[j] < n:
                behind[ahead[j]] = i
            for x in (behind[i], i):
                if x >= 0 and ahead[x] < n and (m := self._pair(ids[x], ids[ahead[x]])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[ahead[x]]))
        return [i for i in ids if i >= 0]

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ids per piece)``: one merge for every unfinished piece at a time, all pieces side by side."""
        lengths = np.array([len(p) for p in pieces])
        ids = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done_ids, done_owner = [], []
        rank = np.full(len(ids), self.none)
        inner = np.nonzero(owner[:-1] == owner[1:])[0]
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            done = least == self.none
            if done.any():
                done_ids.append(ids[done])
                done_owner.append(owner[done])
                ids, owner, rank, least = ids[~done], owner[~done], rank[~done], least[~done]
                if not len(ids):
                    break
            hit = np.nonzero(rank == least)[0]
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]  # the leftmost of each piece
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # each earlier hit removed one place before this one
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for left in (hit, hit[hit > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                same = (right > left) & (owner[left] == owner[right])
                rank[left] = np.where(same, self._rank(ids[left], ids[right]), self.none)
        out, who = np.concatenate(done_ids), np.concatenate(done_owner)
        return out[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(pieces))

    def _learn(self, pieces: list[bytes]) -> None:
        whole = {p: [self.ranks[p]] for p in pieces if p in self.ranks}  # a slice that is a token needs no merging
        whole |= {p: self._merge_long(p) for p in pieces if p not in whole and len(p) > self.long_slice}
        rest = [p for p in pieces if p not in whole]
        ids, counts = self._merge(rest) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat = np.concatenate([ids, np.array([i for x in whole.values() for i in x], dtype=np.int64)])
        counts = np.concatenate([counts, np.array([len(x) for x in whole.values()], dtype=np.int64)])
        for i, p in enumerate([*rest, *whole], start=len(self.starts)):
            self.at[p] = i
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if not texts:
            return []
        joined = "\0" + "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        edges = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        begins = slice_starts(symbols(points, edges))
        begins[edges] = True
        begins[edges[:-1] + 1] = True
        raw = joined.encode("utf-8")
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.cumsum(width) - width
        starts = np.nonzero(begins)[0]
        own = np.ones(len(starts), dtype=bool)
        own[np.searchsorted(starts, edges)] = False  # the marks themselves
        ends = np.append(place[starts[1:]], len(raw))[own].tolist()
        pieces = [raw[a:b] for a, b in zip(place[starts[own]].tolist(), ends)]
        if len(self.at) > self.cached:
            self._reset()
        find = self.at.get
        found = [find(p, -1) for p in pieces]
        if missing := list(dict.fromkeys(p for p, i in zip(pieces, found) if i < 0)):
            self._learn(missing)
            found = [i if i >= 0 else find(p) for p, i in zip(pieces, found)]
        which = np.array(found, dtype=np.int64)
        ids = _gather(self.flat, self.starts[which], self.counts[which])
        upto = np.append(0, np.cumsum(self.counts[which]))
        firsts = upto[np.searchsorted(starts[own], edges)]
        return [ids[a:b] for a, b in zip(firsts, firsts[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id's piece begins, and the end."""
        return np.append(0, np.cumsum(self.size[ids]))

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.bytes, self.first[ids], self.size[ids]).tobytes()


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + count]``, one after another."""
    upto = np.cumsum(counts)
    total = int(upto[-1]) if len(upto) else 0
    return values[np.repeat(starts - (upto - counts), counts) + np.arange(total)]


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One per worker process, from a rank file: base64 of a piece, a blank, its rank."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, ids, offsets)``: ids, and the byte at which each one's piece begins in the text.

    Null text is empty text (no ids). One row per input row, in place (no shuffle); extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(ranks)
        for batch in small_batches(batches, "text", 1_000_000):
            ids = own.encode(as_text(batch, "text"))
            lists = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
            lists.append(pa.array([own.offsets(x)[:-1].astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "ids", "offsets"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded)`` of rows ``(doc_id, ids, …)``.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers; ``decoded`` the bytes that they stand for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(ranks)
        for batch in batches:
            column = batch.column("ids")
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            ids = [flat[a:b] for a, b in zip(ends, ends[1:])]
            arrays = [
                batch.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([own.decode(x) for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")
