"""Periodic runs of words by suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run has a root that is a Lyndon
word for one of two opposite orders of the words, and that root is the longest Lyndon word at its start. So there are two
candidates a position: the longest Lyndon words there, which end where the next smaller suffix starts. A candidate is extended
to the right by the longest common extension of its two ends, a query to the suffix tree, and to the left by the same
query to the tree of the reversal. Trees are built by Ukkonen's algorithm; a query is the least depth between two
leaves of the Euler tour, found in constant time from tables of block minima.

Only runs of ``LEAST_WORDS`` words and ``LEAST_TIMES`` periods are asked for. In such a run every window of 8 words
stands twice, and every word ``LEAST_TIMES`` times. So trees are built only of the stretches of a document where that
is so, set apart by marks that stand nowhere else; a run lies in one such stretch as a whole, and no run is lost. Everything
happens inside a row: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillwork.llm.common import append_columns, raw_texts
from quillwork.llm.words import hashes, repeating, stretches

LEAST_WORDS, LEAST_TIMES = 24, 3
BLOCK = 32  # of the tour, for minima
RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])


class Minima:
    """Least value of any range in constant time: minima from and to the ends of blocks, and of blocks in powers of two."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        blocks = np.full((-(-n // BLOCK), BLOCK), np.iinfo(np.int32).max, dtype=np.int32)
        blocks.ravel()[:n] = values
        self.values = blocks.ravel()
        self.to_here = np.minimum.accumulate(blocks, axis=1).ravel()
        self.from_here = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        step = 1
        while 2 * step <= len(blocks):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value of each range, both ends included."""
        a, b = first // BLOCK, last // BLOCK
        out = np.minimum(self.from_here[first], self.to_here[last])
        inner = b - a - 1
        level = np.zeros(len(inner), dtype=np.int64)
        many = inner > 0
        level[many] = np.log2(inner[many]).astype(np.int64)
        for k in np.unique(level[many]).tolist():
            at = np.flatnonzero(many & (level == k))
            table = self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(table[a[at] + 1], table[b[at] - (1 << k)]))
        at = np.flatnonzero(a == b)
        if len(at):
            within = self.values[first[at]]
            for step in range(1, BLOCK):
                within = np.minimum(within, self.values[np.minimum(first[at] + step, last[at])])
            out[at] = within
        return out


class SuffixTree:
    """The suffix tree of whole numbers from 1 on, by Ukkonen's algorithm; an end mark 0 is added."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.text = [*symbols, 0]
        self.width = max(symbols, default=0) + 1
        self.build()
        self.tour()

    def build(self) -> None:
        text, width, n = self.text, self.width, len(self.text)
        child: dict[int, int] = {}  # parent * width + first symbol of the edge
        begin, end, link = [0], [0], [0]
        node = edge = length = rest = 0
        for i, c in enumerate(text):
            rest += 1
            inner = 0  # the node made last that still lacks its suffix link
            while rest:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    stop = end[below]
                    span = (stop if stop <= i else i + 1) - begin[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[begin[below] + length] == c:
                        if inner:
                            link[inner] = node
                        length += 1
                        break
                    middle = len(begin)
                    child[key] = middle
                    child[middle * width + c] = middle + 1
                    begin += (begin[below], i)
                    end += (begin[below] + length, n)
                    link += (0, 0)
                    begin[below] += length
                    child[middle * width + text[begin[below]]] = below
                    if inner:
                        link[inner] = middle
                    inner = middle
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        self.parent, self.symbol = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        self.parent[nodes], self.symbol[nodes] = keys // width, keys % width
        self.length = np.array(end) - np.array(begin)

    def walk(self, key: np.ndarray) -> list[int]:
        """All nodes from the root down, children by rising ``key``."""
        m = len(self.parent)
        order = np.lexsort((-key[1:], self.parent[1:])) + 1
        last = np.cumsum(np.bincount(self.parent[1:], minlength=m)).tolist()
        kids = order.tolist()
        seen, stack = [], [0]
        while stack:
            v = stack.pop()
            seen.append(v)
            first = last[v - 1] if v else 0
            if first != last[v]:
                stack += kids[first : last[v]]  # the greatest key first, so the least is taken first
        return seen

    def tour(self) -> None:
        self.walked = self.walk(self.symbol)
        parent, length = self.parent.tolist(), self.length.tolist()
        depth = [0] * len(parent)
        for v in self.walked[1:]:
            depth[v] = depth[parent[v]] + length[v]
        self.depth = np.array(depth, dtype=np.int32)
        at = np.array(self.walked)
        self.minima = Minima(self.depth[self.parent[at]])
        self.leaf = np.ones(len(parent), dtype=bool)
        self.leaf[self.parent[1:]] = False
        leaves = np.flatnonzero(self.leaf[at])
        self.place = np.zeros(self.n + 1, dtype=np.int64)  # of each suffix in the tour
        self.place[self.n + 1 - self.depth[at[leaves]]] = leaves

    def ranks(self, opposite: bool) -> np.ndarray:
        """Each suffix' place among all, by rising or by falling symbols; the end is least either way."""
        walked = np.array(self.walk(-self.symbol * (self.symbol > 0) - (self.symbol == 0) * self.width) if opposite else self.walked)
        suffix = self.n + 1 - self.depth[walked[self.leaf[walked]]]
        out = np.zeros(self.n + 1, dtype=np.int64)
        out[suffix] = np.arange(self.n + 1)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, which differ."""
        p, q = self.place[a], self.place[b]
        return self.minima.between(np.minimum(p, q) + 1, np.maximum(p, q)).astype(np.int64)


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each suffix but the end, the first later one that is smaller."""
    r = ranks.tolist()
    stack, out = [len(r) - 1], [0] * (len(r) - 1)
    for i in range(len(r) - 2, -1, -1):
        own = r[i]
        while r[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out)


def all_runs(symbols: list[int], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of numbers from 1 on that has ``least`` numbers and ``times`` periods or more, by
    start and period."""
    n = len(symbols)
    if n < max(least, times):
        return []
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for opposite in (False, True):
        stop = next_smaller(ahead.ranks(opposite))
        start = np.arange(n)
        period = stop - start
        right = ahead.common(start, stop)
        left = np.zeros(n, dtype=np.int64)
        left[1:] = back.common(n - start[1:], n - stop[1:])  # ends before the root and before its repetition
        length = left + period + right
        long = length >= np.maximum(least, times * period)
        found.append(np.stack([start - left, length, period], axis=1)[long])
    both = np.unique(np.concatenate(found), axis=0)
    return [tuple(r) for r in both[np.lexsort((both[:, 2], both[:, 0]))].tolist()]


def candidates(h: np.ndarray, offset: int, least: int, times: int, rounds: int = 6) -> list[tuple[int, int]]:
    """Stretches (half-open) of word hashes outside which no run can be: each window of 8 words (of fewer, for shorter or rarer
    runs) stands twice and each word ``times`` times within. A stretch that still shrinks after some rounds is taken as it is."""
    width = max(1, min(8, least * (times - 2) // times + 1 if times > 2 else 1))
    n = len(h)
    if n < least:
        return []
    if not rounds:
        return [(offset, offset + n)]
    out = [(a, b + width - 1) for a, b in stretches(repeating(h, width)) if b - a + width - 1 >= least]
    if out == [(0, n)]:
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        often = count[which] >= times
        if often.all():
            return [(offset, offset + n)]
        out = stretches(often)
    return [c for a, b in out if b - a >= least for c in candidates(h[a:b], offset + a, least, times, rounds - 1)]


def runs_of(words: list[bytes], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start and period."""
    parts = candidates(hashes(words), 0, least, times)
    if not parts:
        return []
    number: dict[bytes, int] = {}
    symbols: list[int] = []
    origin: list[int] = []  # of each part in symbols
    for a, b in parts:
        origin.append(len(symbols))
        symbols += [number.setdefault(w, len(number) + 1) for w in words[a:b]]
        symbols.append(0)
    for k, (a, b) in enumerate(parts):  # marks between parts, each its own
        symbols[origin[k] + b - a] = len(number) + 1 + k
    found = all_runs(symbols[:-1], least, times)
    which = np.searchsorted(origin, [s for s, _, _ in found], side="right") - 1
    return [(s - origin[k] + parts[k][0], n, p) for (s, n, p), k in zip(found, which.tolist(), strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def find(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """``docs`` with ``runs array<struct<start, length, period>>`` (word numbers from 0; by start, then period) and ``collapsed``, the
    text with each run cut to its first period.

    Null and empty texts have no runs and collapse to the empty text. Every row stays, repeated ones too; columns with the
    new names are replaced. A text of any length is taken whole; memory is in proportion to its repeating stretches.
    """

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            runs, left = [], []
            for raw in raw_texts(batch, text):
                words = raw.split()
                runs.append(runs_of(words, least, times))
                left.append(collapsed(words, runs[-1]).decode())
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            flat = np.array([r for rs in runs for r in rs], dtype=np.int64).reshape(-1, 3)
            fields = [pa.field(f.name, pa.int64(), False) for f in RUN.fields]
            structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=fields)
            return [pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(left, pa.string())]

        return fn

    return append_columns(docs, [StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())], make)
