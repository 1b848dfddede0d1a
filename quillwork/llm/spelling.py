"""Spelling variants: words one edit from a much commoner word, by k-d trees over letter counts.

Words are counted in the map and summed. One edit changes the letter counts by an L1 distance of two at most, by one if it
changes the length. So near words are looked for among vectors of letter counts: for each pair of lengths (equal, or one
apart) a range search in the longer words' k-d tree, box by box, then the order of the letters is verified.

A length with more words than a task should hold is split into cells by the upper levels of such a tree, whose splits are learned
from a bounded sample of words; every word is indexed in its cell, and searches for all cells whose box is within its radius.
A cell that is still too large, or that too many words search, is cut by hash into blocks of indexed words times blocks
of searching words. Each task then builds the lower levels over its block. A task gives back a row for each word with the
number of its near words and the best of them, never the pairs.

Letters are a to z and U+00C0 to U+00FF, one byte each in Latin-1.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quillwork.llm.common import Stage, raw_texts

LEAST_LETTERS, LEAST_SEEN, TIMES = 6, 5, 5
BLOCK, CELLS, A_CELL = 4096, 1024, 16  # words of a task, cells of a length, sampled words of a cell
LEAF, CHUNK = 16, 256
HELD = 200_000  # distinct words a task counts before it hands them on
DIMS = 90
DIM_OF = np.zeros(256, dtype=np.int64)
DIM_OF[97:123] = np.arange(26)
DIM_OF[192:256] = np.arange(26, 90)


def count_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS,
                change: Callable[[int, str], str] | None = None) -> DataFrame:
    """``(word, n)`` for the runs of letters of all texts, A to Z lower-cased, that have ``least`` letters or more.

    ``change`` may turn a run into another word, no longer than it: it gets the CRC-32 of ``<doc>:<run>`` and the run, and is asked once for each
    different run of a row; rows without an id are not changed. Null and empty texts have no words.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{max(1, least)},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, raw in zip(batch.column("doc").to_pylist(), raw_texts(batch), strict=True):
                words = Counter(pattern.findall(raw.lower().decode()))
                if change is not None and key is not None:
                    before = zlib.crc32(f"{key}:".encode())
                    for w, n in list(words.items()):
                        to = change(zlib.crc32(w.encode(), before), w)
                        if to != w:
                            words[w] -= n
                            words[to] += n
                total.update(words)
                if len(total) >= HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    return (rows.mapInArrow(run, "word string, n long").where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
            .where("n > 0"))


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes of all words in a row, and their ends, from 0."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length (n, length)."""
    n, length = codes.shape
    at = np.arange(n)[:, None] * DIMS + DIM_OF[codes]
    return np.bincount(at.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int16 if length < 1 << 15 else np.int32)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words of the same length, row by row, differ in exactly one letter."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each long word, one letter longer, is the short one with a letter put in."""
    n = short.shape[1]
    ahead = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + back >= n


class KdTree:
    """A k-d tree over rows of whole numbers. A leaf holds ``leaf`` rows or fewer, or rows that are all alike.

    ``tight`` boxes are those of the rows; otherwise they are bounded by the splits alone, so that the tree also holds rows that
    it was not built from.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        most = np.iinfo(points.dtype).max
        dim, cut, left, right, low, high, cell = [], [], [], [], [], [], []
        self.rows: list[np.ndarray] = []

        def node(lo, hi) -> int:
            for column, value in ((dim, 0), (cut, 0), (left, -1), (right, -1), (low, lo), (high, hi), (cell, -1)):
                column.append(value)
            return len(dim) - 1

        todo = [(node(np.zeros_like(points[0]) if len(points) else np.zeros(DIMS, points.dtype), np.full(DIMS, most, points.dtype)), np.arange(len(points)))]
        while todo:
            k, rows = todo.pop()
            part = points[rows]
            if tight and len(rows):
                low[k], high[k] = part.min(axis=0), part.max(axis=0)
            split = self.split(part) if len(rows) > leaf else None
            if split is None:
                cell[k] = len(self.rows)
                self.rows.append(rows)
                continue
            dim[k], cut[k] = split
            goes = part[:, dim[k]] <= cut[k]
            lo, hi = low[k].copy(), high[k].copy()
            hi[dim[k]], lo[dim[k]] = cut[k], cut[k] + 1
            left[k], right[k] = node(low[k], hi), node(lo, high[k])
            todo += [(left[k], rows[goes]), (right[k], rows[~goes])]
        self.dim, self.cut, self.left, self.right, self.cell = map(np.array, (dim, cut, left, right, cell))
        self.low, self.high = np.stack(low), np.stack(high)

    @staticmethod
    def split(part: np.ndarray) -> tuple[int, int] | None:
        """The most even cut; None if all rows are alike."""
        top, best = part.max(axis=0), None
        for c in range(min(int(top.max(initial=0)), 8)):
            below = (part <= c).sum(axis=0)
            even = np.minimum(below, len(part) - below)
            d = int(even.argmax())
            if even[d] and (best is None or even[d] > best[0]):
                best = (int(even[d]), d, c)
        if best is not None:
            return best[1:]
        gap = top.astype(np.int64) - part.min(axis=0)
        d = int(gap.argmax())
        return (d, int(top[d]) - int(gap[d] + 1) // 2) if gap[d] else None

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.left[at] >= 0).any():
            down = np.where(x[np.arange(len(x)), self.dim[at]] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)
        return self.cell[at]

    def reach(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, leaf) for every leaf whose box is within the radius."""
        q, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        rows, cells = [], []
        while len(q):
            v = x[q]
            far = np.maximum(self.low[at] - v, 0).sum(axis=1, dtype=np.int64) + np.maximum(v - self.high[at], 0).sum(axis=1, dtype=np.int64)
            near = far <= radius
            q, at = q[near], at[near]
            ends = self.left[at] < 0
            rows.append(q[ends])
            cells.append(self.cell[at[ends]])
            q, at = q[~ends], at[~ends]
            q, at = np.concatenate([q, q]), np.concatenate([self.left[at], self.right[at]])
        return np.concatenate(rows) if rows else q, np.concatenate(cells) if cells else q


def block_of(length: int) -> int:
    """Words of one length that a task holds, fewer if they are very long."""
    return max(16, min(BLOCK, (1 << 25) // length))


def routed(trees: dict[int, KdTree], lengths: set[int]):
    """Rows ``(length, cell, word, n, home, own)`` of a batch of words: once as indexed in its cell (own), and for every cell that it
    searches. Of two cells of one length, the word in the earlier one searches the later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            flat, ends = letters_of(words)
            sizes = np.diff(ends)
            who, size, cell, home, own = [], [], [], [], []

            def add(rows, length, cells, is_home, is_own):
                for column, value, kind in ((size, length, np.int32), (cell, cells, np.int32), (home, is_home, bool), (own, is_own, bool)):
                    column.append(np.broadcast_to(np.asarray(value, kind), len(rows)))
                who.append(rows)

            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                codes = flat[ends[at][:, None] + np.arange(length)]
                x = letter_counts(codes)
                tree = trees.get(length)
                mine = tree.home(x) if tree else np.zeros(len(at), np.int64)
                add(at, length, mine, True, True)
                for start in range(0, len(at), CHUNK):
                    part, first = slice(start, start + CHUNK), at[start : start + CHUNK]
                    q, c = tree.reach(x[part], 2) if tree else (np.arange(len(first)), np.zeros(len(first), np.int64))
                    later = c >= mine[part][q]
                    add(first[q[later]], length, c[later], c[later] == mine[part][q[later]], False)
                    if length + 1 in lengths:
                        longer = trees.get(length + 1)
                        q, c = longer.reach(x[part], 1) if longer else (np.arange(len(first)), np.zeros(len(first), np.int64))
                        add(first[q], length + 1, c, False, False)
            if who:
                take = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(size)), pa.array(np.concatenate(cell)), words.take(take), batch.column("n").take(take),
                     pa.array(np.concatenate(home)), pa.array(np.concatenate(own))], names=ROUTED.names)

    return run


ROUTED = StructType([StructField("length", IntegerType()), StructField("cell", IntegerType()), StructField("word", StringType()),
                     StructField("n", LongType()), StructField("home", BooleanType()), StructField("own", BooleanType())])


def near_pairs(length: int, index: pa.Array, search: pa.Array, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(searching, indexed) positions of words one edit apart. Indexed words have ``length`` letters, searching ones as many or
    one fewer; a word that searches its own cell meets greater words only."""
    flat, _ = letters_of(index)
    codes = flat.reshape(-1, length)
    tree = KdTree(letter_counts(codes), LEAF, True)
    points = letter_counts(codes)
    sizes = np.array([len(r) for r in tree.rows])
    firsts, members = np.cumsum([0, *sizes]), np.concatenate(tree.rows)
    flat, ends = letters_of(search)
    names = np.array([w.encode("latin-1") for w in index.to_pylist()], dtype=object)
    asked = np.array([w.encode("latin-1") for w in search.to_pylist()], dtype=object)
    out_q, out_r = [], []
    for size, radius in ((length, 2), (length - 1, 1)):
        rows = np.flatnonzero(np.diff(ends) == size)
        for start in range(0, len(rows), CHUNK):
            part = rows[start : start + CHUNK]
            own = flat[ends[part][:, None] + np.arange(size)]
            x = letter_counts(own).astype(points.dtype)
            q, leaf = tree.reach(x, radius)
            many = sizes[leaf]
            total = int(many.sum())
            # every row of each leaf reached
            r = members[np.repeat(firsts[leaf] - np.cumsum(many) + many, many) + np.arange(total)]
            q = np.repeat(q, many)
            near = np.abs(points[r] - x[q]).sum(axis=1, dtype=np.int64) <= radius
            q, r = q[near], r[near]
            good = one_replaced(own[q], codes[r]) if size == length else one_inserted(own[q], codes[r])
            q, r = part[q[good]], r[good]
            once = ~home[q] | (asked[q] < names[r])
            out_q.append(q[once])
            out_r.append(r[once])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *out_q]), np.concatenate([nothing, *out_r])


def told(table: pa.Table) -> pa.Table:
    """One task: for each of its words with near words, how many and which is the commonest (ties: the least)."""
    own = table.column("own").to_numpy(zero_copy_only=False)
    table = table.combine_chunks()
    index, search = table.filter(pa.array(own)), table.filter(pa.array(~own))
    empty = {"word": pa.string(), "k": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    if not len(index) or not len(search):
        return pa.table({k: pa.array([], t) for k, t in empty.items()})
    q, r = near_pairs(table.column("length")[0].as_py(), index.column("word").combine_chunks(), search.column("word").combine_chunks(),
                      search.column("home").to_numpy(zero_copy_only=False))
    both = pa.concat_tables([search, index]).select(["word", "n"]).combine_chunks()
    a, b = np.concatenate([q, r + len(search)]), np.concatenate([r + len(search), q])
    words, n = np.array(both.column("word").to_pylist(), dtype=object), both.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.zeros(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, a, rank[b])
    k = np.bincount(a, minlength=len(words))
    some = np.flatnonzero(k)
    first = np.array(order)[best[some]] if len(some) else some
    return pa.table({"word": pa.array(words[some], pa.string()), "k": pa.array(k[some]), "best_n": pa.array(n[first], pa.int64()),
                     "best": pa.array(words[first], pa.string())})


def top_trees(stage_words: DataFrame, sizes: dict[int, int]) -> dict[int, KdTree]:
    """Splits of the lengths that need more than one cell, from ``A_CELL`` sampled words a cell, ``CELLS`` cells a length at most."""
    cells = {length: min(CELLS, -(-count // block_of(length))) for length, count in sizes.items()}
    large = {length: c for length, c in cells.items() if c > 1}
    if not large:
        return {}
    share = F.create_map(*[F.lit(v) for length, c in large.items() for v in (length, max(1, sizes[length] // (A_CELL * c)))])
    taken = (stage_words.where(F.length("word").isin(list(large)))
             .where(F.pmod(F.xxhash64("word", F.lit(1)), share[F.length("word")].cast("long")) == 0).select("word").toArrow())
    words: dict[int, list[bytes]] = {length: [] for length in large}
    for w in taken.column("word").to_pylist():
        words[len(w)].append(w.encode("latin-1"))
    out = {}
    for length, some in words.items():
        if some:
            codes = np.frombuffer(b"".join(sorted(some)), np.uint8).reshape(-1, length)
            out[length] = KdTree(letter_counts(codes), max(1, len(some) // large[length]), False)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` for each word of ``words(word, n)`` (distinct, of letters only) that has words one edit away; best
    is the commonest of them, and of equally common ones the first in the order of code points."""
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}  # one row a length
    sent = Stage(words.sparkSession, "spelling").put(words.mapInArrow(routed(top_trees(words, sizes), set(sizes)), ROUTED))
    size = F.col("length")
    limit = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(1 << 25) / size)))
    parts = sent.groupBy("length", "cell").agg(  # CELLS or so rows a length at most
        F.ceil(F.count_if("own") / limit).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("own")) / limit).cast("int").alias("asks"))
    cut = lambda salt, n: F.pmod(F.xxhash64("word", F.lit(salt)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = (sent.join(F.broadcast(parts.where("blocks > 0 AND asks > 0")), ["length", "cell"])
              .withColumn("block", F.explode(F.when(F.col("own"), F.array(cut(2, F.col("blocks")))).otherwise(every("blocks"))))
              .withColumn("ask", F.explode(F.when(F.col("own"), every("asks")).otherwise(F.array(cut(3, F.col("asks")))))))
    found = (placed.select(*ROUTED.names, "block", "ask").groupBy("length", "cell", "block", "ask")
             .applyInArrow(told, "word string, k long, best_n long, best string"))
    return (found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")))


def variants(counted: DataFrame, seen: int = LEAST_SEEN, least: int = LEAST_LETTERS, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for the words of ``counted(word, n)`` with ``least`` letters and ``seen`` occurrences.

    ``form`` is the commonest near word if it is ``times`` times as common or more (more than 1), else null. ``root`` is where forms lead in
    the end. Words must be distinct. Each step multiplies n, so a chain has few words: their ends are found by
    doubling, with a fixed number of joins. An empty table gives an empty table.
    """
    stage = Stage(counted.sparkSession, "variants")
    words = stage.put(counted.where((F.length("word") >= least) & (F.col("n") >= seen)).select("word", "n"))
    near = near_words(words)
    formed = stage.put(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best_n")).alias("form_n")))
    most = formed.agg(F.max("form_n")).first()[0]
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    steps = math.log(most / max(seen, 1), times) + 1 if most else 1
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1)))) if most else 0):
        after = up.select(F.col("word").alias("at"), F.col("to").alias("next"))
        up = stage.put(up.join(after, F.col("to") == F.col("at"), "left").select("word", F.coalesce("next", "to").alias("to")))
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
