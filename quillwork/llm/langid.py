"""Language identification with hyperdimensional profiles.

Every class of letters has a fixed random vector of signs. An n-gram of letters binds the vectors of its letters, each
permuted by its place, into one vector (their product). A document's vector is the bundle (sum) of its n-grams' vectors, a
language's prototype the bundle of its documents, each scaled to one n-gram in all. A document gets the language whose
prototype has the greatest cosine with its vector.

Learning is one map (each task bundles what it sees of a language into one vector) and one small sum by (language,
component). Prediction is one map with the prototypes in hand: languages times ``DIM`` numbers, whatever the corpus' size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from quillwork.llm.common import append_columns, texts

DIM = 1024
CLASSES = 64  # 0 for what is no letter, 1 to 26 for a to z, the rest shared by all other letters
GRAM = 3
TURN = 1 << 14  # n-gram vectors turned to floats at a time
ROWS = 64  # documents counted at a time
UNKNOWN = "und"
SPREADS, HALF = 4, 0.5
CHANCE = 2 / DIM**0.5  # two deviations of one random cosine


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, dtype=np.int32)
    letters = np.array([c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"])
    out[letters] = 27 + letters % (CLASSES - 27)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


class Profiles:
    """N-gram vectors by code, bound when first seen."""

    def __init__(self):
        self.letter = np.random.default_rng(11).choice(np.array([-1, 1], dtype=np.int8), (CLASSES, DIM))
        self.row = np.full(CLASSES**GRAM, -1, dtype=np.int32)
        self.rows, self.n = np.zeros((1024, DIM), dtype=np.int8), 0  # n are bound; there is room for more

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.row[codes] < 0]
        if len(new):
            bound = np.ones((len(new), DIM), dtype=np.int8)
            for place in range(GRAM):
                which = new // CLASSES ** (GRAM - 1 - place) % CLASSES
                bound *= np.roll(self.letter, GRAM - 1 - place, axis=1)[which]
            self.row[new] = self.n + np.arange(len(new))
            while self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n : self.n + len(new)] = bound
            self.n += len(new)
        return self.rows[self.row[codes]].astype(np.float32)

    def bundles(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The sums of the n-grams' vectors by the rows of ``table``, a bounded number of n-grams at a time."""
        out = np.zeros((len(table), DIM), dtype=np.float32)
        for at in range(0, len(codes), TURN):
            out += table[:, at : at + TURN] @ self.vectors(codes[at : at + TURN])
        return out

    def counts(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(documents by n-grams, the n-grams' codes). Runs of other marks count as one gap, as do both ends."""
        classes = letter_classes()
        codes, owner = [], []
        for k, text in enumerate(docs):
            c = classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            if not c.any():
                continue
            c = np.concatenate([[0], c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)], [0, 0]])
            grams = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            codes.append(grams[(c[1:-1] != 0) | (c[2:] != 0)])
            owner.append(np.full(len(codes[-1]), k))
        if not codes:
            return np.zeros((len(docs), 0), np.float32), np.zeros(0, np.int64)
        codes, owner = np.concatenate(codes), np.concatenate(owner)
        seen = np.zeros(CLASSES**GRAM, dtype=bool)
        seen[codes] = True
        used = np.flatnonzero(seen)
        place = np.zeros(CLASSES**GRAM, dtype=np.int64)
        place[used] = np.arange(len(used))
        table = np.bincount(owner * len(used) + place[codes], minlength=len(docs) * len(used))
        return table.reshape(len(docs), len(used)).astype(np.float32), used


@lru_cache(maxsize=1)
def profiles() -> Profiles:
    return Profiles()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language from every row with a language and a letter. The result is as large as the set of languages."""
    pairs = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                table, codes = profiles().counts(list(texts(part)))
                if not len(codes):
                    continue
                table /= np.maximum(table.sum(axis=1, keepdims=True), 1)
                names = np.array(part.column("lang").to_pylist(), dtype=object)
                own = sorted(set(names))
                bundles = profiles().bundles(np.stack([table[names == n].sum(axis=0) for n in own]), codes)
                for name, bundle in zip(own, bundles.astype(np.float64), strict=True):
                    sums[name] = sums.get(name, 0) + bundle
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(map(list, sums.values())), pa.list_(pa.float64()))],
                                         names=["lang", "bundle"])

    parts = pairs.mapInArrow(run, "lang string, bundle array<double>")
    # whole numbers, so that the sums don't hang on the order of the tasks
    summed = (parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i")
              .agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x")))
    out: dict[str, np.ndarray] = {}
    for row in summed.collect():
        out.setdefault(row["lang"], np.zeros(DIM))[row["i"]] = row["x"] / 1e6
    return {k: out[k] / max(np.linalg.norm(out[k]), 1e-12) for k in sorted(out) if np.any(out[k])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", worth: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred string`` and ``score double`` (the cosine, 0 to 1). A map without a shuffle. With ``worth``, a
    column of that name tells how many different, equally frequent n-grams the text's vector is worth.

    Texts that are null or have no letter get ``und`` and 0, as do all if no prototype is given. Equal cosines go to the
    first language by name. Whole texts count, of any length. Columns with the new names are replaced.
    """
    names = np.array(list(prototypes), dtype=object)
    against = np.stack(list(prototypes.values())).astype(np.float32).T if prototypes else None

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            table, codes = profiles().counts(list(texts(batch, text)))
            lang, score, count = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            some = table.any(axis=1) if len(codes) else np.zeros(batch.num_rows, bool)
            if against is not None and some.any():
                vectors = profiles().bundles(table[some], codes)
                length = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                cosines = vectors @ against / length
                lang[some] = names[cosines.argmax(axis=1)]
                score[some] = np.clip(cosines.max(axis=1), 0, 1)
                count[some] = DIM * (table[some].sum(axis=1) / length[:, 0]) ** 2
            return [pa.array(lang, pa.string()), pa.array(score), pa.array(count)][: len(fields)]

        return fn

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), *([StructField(worth, DoubleType())] if worth else [])]
    return append_columns(docs, fields, make, ROWS)


def usual(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang: str = "lang") -> dict[str, tuple[float, float]]:
    """(mean, spread) by language over the rows of ``docs`` that are told right: a text worth m n-grams usually has the cosine
    mean times the root of m, and spread is the deviation from that. A language spreads as far as all together at least.
    """
    rows = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return usual_told(predict(rows, prototypes, worth="worth"))


def usual_told(told: DataFrame) -> dict[str, tuple[float, float]]:
    """``usual`` of rows of ``lang`` with what ``predict`` told of them: ``lang_pred``, ``score`` and ``worth``."""
    told = told.where("lang_pred = lang AND worth > 0")
    root = F.sqrt("worth")  # the squared deviations are made of plain sums
    sums = told.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("score") / root).alias("mean"), F.sum(F.col("score") ** 2).alias("cc"),
                                    F.sum(F.col("score") * root).alias("cr"), F.sum("worth").alias("rr")).collect()
    off = {r["lang"]: max(r["cc"] - 2 * r["mean"] * r["cr"] + r["mean"] ** 2 * r["rr"], 0.0) for r in sums}
    least = max((sum(off.values()) / max(sum(r["n"] for r in sums), 1)) ** 0.5, DIM**-0.5)
    return {r["lang"]: (r["mean"], max((off[r["lang"]] / r["n"]) ** 0.5, least)) for r in sums}


def usual_enough(learned: dict[str, tuple[float, float]], lang: str = "lang_pred", score: str = "score", worth: str = "worth") -> Column:
    """Whether a cosine is in keeping with the language told: above chance, and at most ``SPREADS`` spreads under the usual one of
    a text worth as many n-grams. From ``HALF`` on it always is, so texts in two languages are. A language never told right
    has only the bound of chance."""
    bound = F.lit(0.0)
    for name, (mean, spread) in learned.items():
        bound = F.when(F.col(lang) == name, F.sqrt(worth) * mean - SPREADS * spread).otherwise(bound)
    return F.col(score) >= F.greatest(F.least(bound, F.lit(HALF)), F.lit(CHANCE))


def held_out(doc: str = "doc_id") -> Column:
    """Whether a row is kept from learning; rows without an id are learned from by neither part and count as held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc}`").cast("string").cast("binary")) % 4 == 2, F.lit(True))
