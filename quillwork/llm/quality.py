"""Quality of whole texts: gradient-boosted trees over document statistics, with monotonic constraints.

One map describes every text by counts and shares. The trees learn ``labels.quality`` from the statistics of a bounded
sample of labelled rows, ``SAMPLE`` of each class by hash of the id, so fitting does not grow with the corpus. Trees are grown
on quantile bins, a split at a time; where a feature must not raise the score, a split is taken only if its right side
scores no more than its left, and both sides stay on their side of the middle further down. The fitted trees are flattened
into arrays of nodes, and a task walks a whole slice of texts through all trees at once. No shuffle but that of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField

from quillwork.llm.common import append_columns, raw_texts
from quillwork.llm.words import hashes, repeating

SAMPLE = 6000  # labelled rows of each class at most that the trees are grown on
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 64
LEAST = 5  # sample rows in a leaf
SHRINK = 1.0  # added to a leaf's curvature
WINDOW = 8  # words
LEAST_WORDS, MOST_REPEATED = 20, 30  # of the base rule; the second in percent

SYMBOLS = b"#*$%&|<>"
SPACES = bytes([32, *range(9, 14)])
INSIDE = bytes(range(0x80, 0xC0))  # bytes that continue a character
CAPITALS, SMALLS, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
LEADS = bytes(range(0xC0, 0x100))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features, and the direction a score may go as they rise: -1 never up, 0 any.
FEATURES = {
    "symbols": -1, "duplicate_lines": -1, "repeated_words": -1, "exclaimed": -1, "shouted": -1,
    "words": 0, "word_length": 0, "short_words": 0, "distinct": 0, "capitals": 0, "digits": 0, "stops": 0, "commas": 0,
    "words_a_line": 0, "ended_lines": 0, "bars": 0,
}


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def held(raw: bytes, chars: bytes) -> int:
    """How many bytes of ``raw`` are among ``chars``."""
    return len(raw) - len(raw.translate(None, chars))


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included."""
    maybe = np.flatnonzero(repeating(hashes(words), width)) if len(words) > width else np.zeros(0, np.int64)
    if not len(maybe):
        return 0
    windows: dict[tuple, list[int]] = {}
    for i in maybe.tolist():
        windows.setdefault(tuple(words[i : i + width]), []).append(i)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    for at in windows.values():
        if len(at) > 1:
            inside[at] += 1
            inside[np.array(at) + width] -= 1
    return int((np.cumsum(inside[:-1]) > 0).sum())


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``FEATURES`` of a UTF-8 text; all 0 for an empty one."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(raw.translate(None, SPACES + INSIDE))
    symbols, duplicate, repeated = held(raw, SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)
    capitals = held(raw, CAPITALS)
    letters = capitals + held(raw, SMALLS) + held(raw, LEADS)
    lengths = np.fromiter(map(len, words), np.int64, n)
    features = [
        symbols / n, share(duplicate, len(lines)), repeated / n, held(raw, b"!?") / n, sum(map(bytes.isupper, words)) / n,
        float(np.log1p(n)), chars / n, float((lengths <= 3).mean()), len(set(words)) / n, share(capitals, letters),
        held(raw, DIGITS) / chars, held(raw, b".") / n, held(raw, b",;:") / n, n / len(lines),
        sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / len(lines), held(raw, b"|") / n,
    ]
    return [n, chars, symbols, duplicate, repeated], features


def described(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``COUNTS`` (long) and ``features array<double>``. Null and empty texts, and texts without a word, are all 0."""

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            told = [statistics(t) for t in raw_texts(batch, text)]
            counts = np.array([c for c, _ in told], dtype=np.int64).reshape(-1, len(COUNTS))
            flat = np.array([f for _, f in told], dtype=float).ravel()
            ends = np.arange(0, batch.num_rows * len(FEATURES) + 1, len(FEATURES), dtype=np.int32)
            return [*(pa.array(c) for c in counts.T), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return fn

    return append_columns(df, [*(StructField(c, LongType()) for c in COUNTS), StructField("features", ArrayType(DoubleType(), False))], make)


@dataclass
class Forest:
    """Trees as arrays of nodes, one row a tree. Node k's children are 2k + 1 (feature at most the threshold) and 2k + 2; a node
    without a split has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of features."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += value[node]
        return 1 / (1 + np.exp(-total))


def best_split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, low: float, high: float, sign: list[int], sizes: list[int]):
    """(gain, feature, bin, left value, right value) of the best allowed split of ``rows``, or None."""

    def worth(gs, hs, v):  # what a node of value v takes off the loss
        return -(gs * v + 0.5 * (hs + SHRINK) * v * v)

    gs, hs = g[rows].sum(), h[rows].sum()
    own = worth(gs, hs, np.clip(-gs / (hs + SHRINK), low, high))
    best = None
    for f, size in enumerate(sizes):
        if size < 2:
            continue
        b = bins[rows, f]
        left_n = np.cumsum(np.bincount(b, minlength=size))[:-1]
        left_g = np.cumsum(np.bincount(b, weights=g[rows], minlength=size))[:-1]
        left_h = np.cumsum(np.bincount(b, weights=h[rows], minlength=size))[:-1]
        right_g, right_h = gs - left_g, hs - left_h
        left, right = np.clip(-left_g / (left_h + SHRINK), low, high), np.clip(-right_g / (right_h + SHRINK), low, high)
        gain = worth(left_g, left_h, left) + worth(right_g, right_h, right) - own
        allowed = (left_n >= LEAST) & (len(rows) - left_n >= LEAST)
        if sign[f]:
            allowed &= (right - left) * sign[f] >= 0
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), f, at, float(left[at]), float(right[at]))
    return best


def grow(x: np.ndarray, y: np.ndarray, sign: list[int]) -> Forest:
    """Trees for logistic loss on rows of both classes; ``sign`` as in ``FEATURES``."""
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    sizes = [len(c) + 1 for c in cuts]
    nodes = (1 << (DEPTH + 1)) - 1
    mean = y.mean()
    start = float(np.log(mean / (1 - mean)))
    feature, threshold, value = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    total = np.full(len(x), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        g_all, h_all = g.sum(), h.sum()
        open_nodes = [(0, np.arange(len(x)), -np.inf, np.inf, -g_all / (h_all + SHRINK))]
        while open_nodes:
            node, rows, low, high, v = open_nodes.pop()
            split = best_split(bins, g, h, rows, low, high, sign, sizes) if 2 * node + 2 < nodes and len(rows) >= 2 * LEAST else None
            if split is None:
                value[t, node] = RATE * v
                total[rows] += RATE * v
                continue
            _, f, at, left, right = split
            feature[t, node], threshold[t, node] = f, cuts[f][at]
            goes_left = bins[rows, f] <= at
            middle = (left + right) / 2
            bounds = [(low, high), (low, high)] if not sign[f] else [(low, middle), (middle, high)] if sign[f] > 0 else [(middle, high), (low, middle)]
            open_nodes.append((2 * node + 1, rows[goes_left], *bounds[0], left))
            open_nodes.append((2 * node + 2, rows[~goes_left], *bounds[1], right))
    return Forest(feature, threshold, value, start)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text", label: str = "quality") -> Forest | None:
    """Trees grown on the labelled rows, ``sample`` of each class at most; None where the labels don't show both classes.

    Labels other than 0 and 1, labels of no document and documents of no label teach nothing. A document labelled both ways
    counts as good. Of several rows with one id the least text is taken.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("id"))
             .agg(F.max(label).cast("int").alias("label")))
    taken = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    ids = taken[0].union(taken[1])  # 2 * sample ids at most
    rows = (docs.select(F.col(f"`{doc}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
            .join(F.broadcast(ids), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")))
    told = described(rows).select("id", "label", "features").toPandas().sort_values("id")  # 2 * sample rows of len(FEATURES) numbers
    if told.label.nunique() < 2:
        return None
    return grow(np.array(told.features.tolist()), told.label.to_numpy(dtype=float), list(FEATURES.values()))



def judge(docs: DataFrame, trees: Forest | None, text: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS``, ``score double`` (0 to 1, higher: better), ``base_failed`` and ``kept``.

    A text is kept if the base rule (too few words, too many of them repeated) does not fail it and the trees give it 0.5 or
    more; without trees the score is 1. Null and empty texts have no word and fail. Every row stays, repeated ones
    too; input columns with the new names are replaced.
    """

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            told = [statistics(t) for t in raw_texts(batch, text)]
            counts = np.array([c for c, _ in told], dtype=np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in told], dtype=float).reshape(-1, len(FEATURES))
            score = np.ones(len(x)) if trees is None else trees.score(x)
            n, repeated = counts[:, 0], counts[:, -1]
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
            return [*(pa.array(c) for c in counts.T), pa.array(score), pa.array(failed), pa.array(~failed & (score >= 0.5))]

        return fn

    return append_columns(docs, [*(StructField(c, LongType()) for c in COUNTS), StructField("score", DoubleType()),
                                 StructField("base_failed", BooleanType()), StructField("kept", BooleanType())], make)
