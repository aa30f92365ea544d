"""Long runs of digits as arrays: every proposal of :mod:`pii` inside them with its features, slice by slice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

GROUP = re.compile("[0-9]+")
SLICE = 2048  # groups whose proposals are made together


class Run:
    """The digit groups of ``text[start:stop]`` (ASCII digits and the marks between them), and sums that give a proposal's features in a few look-ups."""

    def __init__(self, text: str, start: int, stop: int) -> None:
        self.text, self.start, self.stop = text, start, stop
        raw = np.frombuffer(text[start:stop].encode("ascii"), dtype=np.uint8)
        self.raw = raw
        spans = np.fromiter((v for m in GROUP.finditer(text, start, stop) for v in m.span()), dtype=np.int64).reshape(-1, 2) - start
        self.first, self.last = spans[:, 0], spans[:, 1]
        self.size = self.last - self.first
        digit = (raw >= 48) & (raw <= 57)
        self.digits = self._sum(digit)
        value = raw[digit].astype(np.int64) - 48
        twice = 2 * value - 9 * (value > 4)
        even = np.arange(len(value)) % 2 == 0
        self.luhn = [self._sum(np.where(even, value, twice)), self._sum(np.where(even, twice, value))]  # plain at even places, at odd ones
        self.dots = self._sum(raw == ord("."))
        self.marks = self._sum((raw == ord("-")) | (raw == ord(" ")) | (raw == ord("/")))
        self.opens = self._sum(raw == ord("("))
        gap = raw[self.last[:-1]].astype(np.int64) * 256
        wide = self.first[1:] - self.last[:-1] == 2
        gap[wide] += raw[self.last[:-1][wide] + 1]
        order = np.argsort(gap, kind="stable")
        self.before = np.full(len(gap), -1)  # the last gap before with the same marks
        alike = gap[order[1:]] == gap[order[:-1]]
        self.before[order[1:][alike]] = order[:-1][alike]
        self.only_dot = (gap == ord(".") * 256).astype(np.int64)
        small = np.fromiter((n <= 3 and int(text[start + a : start + a + n]) <= 255 for a, n in zip(self.first.tolist(), self.size.tolist())), dtype=bool)
        self.quad = small.astype(np.int64)
        self.opened = np.zeros(len(self.first), dtype=bool)  # a + or ( just before
        self.opened[1:] = raw[self.first[1:] - 1] == ord("(")
        self.opened[0] = start > 0 and text[start - 1] in "+("

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])

    def context(self, at: np.ndarray, seen: Callable[[str], list[float]]) -> np.ndarray:
        """``seen`` of what stands before places that may see beyond the run; further in there are digits and marks alone."""
        out = np.zeros((len(at), len(seen(""))))
        for k in np.nonzero(at <= 64)[0]:
            a = self.start + int(at[k])
            out[k] = seen(self.text[max(0, a - 32) : a])
        deep = at > 64
        last = self.raw[at[deep] - 1]
        out[deep, 1] = (last >= 48) & (last <= 57)
        return out

    def rows(self, i: np.ndarray, j: np.ndarray, parts: dict[str, np.ndarray], marked: bool, seen: Callable[[str], list[float]]) -> np.ndarray:
        """Features of the proposals from group ``i`` to group ``j``, with the mark before if ``marked``: the columns of :func:`pii.features`."""
        a, b = self.first[i], self.last[j]
        begin = a - marked
        digits = self.digits[b] - self.digits[a]
        p, q = self.digits[a], self.digits[b]
        luhn = np.where((q - 1) % 2 == 0, self.luhn[0][q] - self.luhn[0][p], self.luhn[1][q] - self.luhn[1][p]) % 10 == 0
        head = np.zeros(len(i), dtype=np.uint8)
        if marked:
            at = begin >= 0
            head[at] = self.raw[begin[at]]
            head[~at] = ord(self.text[self.start - 1]) if self.start else 0
        starts, where = np.unique(begin, return_inverse=True)
        near = self.context(starts, seen)[where]
        after = (self.stop < len(self.text) and self.text[self.stop].isalnum()) & (b == len(self.raw))
        zero = np.zeros(len(i))
        columns = [
            zero + 5,
            b - begin,
            digits,
            j - i + 1,
            parts["most"],
            parts["least"],
            self.size[i],
            self.size[j],
            parts["kinds"],
            (head == ord("+")) | (near[:, 0] > 0),
            self.dots[b] - self.dots[a],
            self.marks[b] - self.marks[a],
            (self.opens[b] - self.opens[a] > 0) | (head == ord("(")),
            (digits >= 13) & (digits <= 19) & luhn,
            parts["quads"] & (not marked),
            (digits >= 9) & (digits <= 15),
            zero,
            zero,
            zero,
            (near[:, 1] > 0) | after,
        ]
        return np.concatenate([np.stack([np.asarray(c, dtype=float) for c in columns], axis=1), near[:, 2:]], axis=1)

    def slices(self, least: int, most: int, seen: Callable[[str], list[float]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """``(starts, stops, features, frontier)`` of all parts of up to ``most`` digits (one group: any) and ``least`` or more, without the whole run.

        Parts that begin at or behind ``frontier`` come later.
        """
        n = len(self.first)
        for low in range(0, n, SLICE):
            i = np.arange(low, min(n, low + SLICE))
            best, worst, kinds = self.size[i].copy(), self.size[i].copy(), np.zeros(len(i), dtype=np.int64)
            dots, quads = np.zeros(len(i), dtype=np.int64), self.quad[i].copy()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(min(most, n - low)):
                if k:
                    i = i[i + k < n]
                    best, worst, kinds, dots, quads = (x[: len(i)] for x in (best, worst, kinds, dots, quads))
                    best, worst = np.maximum(best, self.size[i + k]), np.minimum(worst, self.size[i + k])
                    kinds = kinds + (self.before[i + k - 1] < i)
                    dots, quads = dots + self.only_dot[i + k - 1], quads + self.quad[i + k]
                digits = self.digits[self.last[i + k]] - self.digits[self.first[i]]
                fit = (digits >= least) & ((digits <= most) if k else True) & ~((i == 0) & (i + k == n - 1))
                if fit.any():
                    parts = {"most": best[fit], "least": worst[fit], "kinds": kinds[fit], "quads": (k == 3) & (dots[fit] == 3) & (quads[fit] == 4)}
                    found.append(self._both(i[fit], i[fit] + k, parts, seen))
            frontier = self.start + (int(self.first[low + SLICE]) - 1 if low + SLICE < n else len(self.raw))
            if found:
                starts, stops, rows = (np.concatenate(x) for x in zip(*found))
                yield starts, stops, rows, frontier

    def _both(self, i: np.ndarray, j: np.ndarray, parts: dict[str, np.ndarray], seen: Callable[[str], list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, stops and features of the parts, and of those with a mark just before."""
        a, b, rows = self.start + self.first[i], self.start + self.last[j], self.rows(i, j, parts, False, seen)
        own = self.opened[i]
        if own.any():
            more = self.rows(i[own], j[own], {k: v[own] for k, v in parts.items()}, True, seen)
            a, b, rows = np.concatenate([a, a[own] - 1]), np.concatenate([b, b[own]]), np.concatenate([rows, more])
        return a, b, rows
