"""Toxicity of whole texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of lexicon words and how near they stand to words for "you", capitals, marks and
obfuscated spellings. The lexicon is a short seed list plus words and word beginnings that the labelled rows of the training
part show to be much commoner in toxic texts. A training row's own count is taken off before it is described, so that
the trees see a word as they will meet it in new texts.

Learning uses a bounded sample of labelled rows, ``SAMPLE`` of each class by hash of the id, so its cost does not grow with
the corpus. Scoring is one map for the features and the models' own transforms, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from quillwork.llm.common import Stage, apart, append_columns, texts

SAMPLE = 6000  # labelled rows of each class at most that the model is fitted on
SEEN, LIFT, DOUBT = 5, 2.0, 1.5  # a learned term: in so many toxic texts at least, with log odds so high when so many standard errors less
BEGIN = 5  # letters of a word's beginning
NEAR = 5  # words between an insult and a "you"
TREES, DEPTH, CALIBRATE = 20, 3, 10  # one training row in CALIBRATE / 3 is kept for the calibration

SEED = set("idiot idiots moron morons loser losers stupid dumb trash scum clown pathetic worthless disgusting fool imbecile jerk "
           "garbage vermin filth hate kill dumpf blödmann trottel abschaum dreck widerlich connard crétin imbécile ordure "
           "débile minable idiota imbécil estúpido basura asqueroso inútil escoria".split())
YOU = set("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted "
          "ustedes vosotros os".split())
EDGE = ".,;:!?\"'()[]{}<>«»“”„…-–—*_|/\\¡¿"
LEET = str.maketrans("013457@$!|", "oieastasil")
MIXED = re.compile(r"[^\W\d_]+[\d@$!|*#_.-]+[^\W\d_]|[\d@$!|*]+[^\W\d_]{2,}")
NAMES = ["seed", "learned", "hits", "strongest", "near_you", "you", "capitals", "shouted", "exclaimed", "marks", "mixed",
         "unmasked", "begun"]


def held_out(doc: str = "doc_id") -> Column:
    """Whether a row is kept from learning; rows without an id are."""
    return F.coalesce(F.crc32(F.col(f"`{doc}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def terms(text: str) -> set[str]:
    """The distinct words and beginnings of a text."""
    words = {w.strip(EDGE) for w in text.lower().split()}
    return {w for w in words if w} | {f"{w[:BEGIN]}*" for w in words if len(w) >= BEGIN}


def neighbours(text: str, wanted: dict) -> Iterator[tuple[str, str]]:
    """Each wanted term of a text with the words around its first place."""
    words = ["", *(w for w in (w.strip(EDGE) for w in text.lower().split()) if w), ""]
    met: set[str] = set()
    for before, word, after in zip(words, words[1:], words[2:], strict=False):
        for term in (word, f"{word[:BEGIN]}*"):
            if term in wanted and term not in met:
                met.add(term)
                yield term, f"{before} {after}"


class Lexicon:
    """Counts of terms in toxic and other texts, and the log odds they give, less what chance may have added."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, other: int):
        self.counts, self.toxic, self.other = counts, toxic, other
        self.weight = {t: w for t in counts if (w := self.odds(t, 0, 0)) >= LIFT}

    def odds(self, term: str, own_toxic: int, own_other: int) -> float:
        """Cautious log odds without a text of one's own; 0 if the term is then too rare."""
        toxic, other = self.counts[term]
        toxic, other = toxic - own_toxic, other - own_other
        if toxic < SEEN:
            return 0.0
        lift = np.log((toxic + 0.5) / (self.toxic + 1)) - np.log((other + 0.5) / (self.other + 1))
        return float(lift - DOUBT * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)))

    def seen_without(self, label: int | None):
        """The weight of a term, for a new text or for one of the training texts with ``label``."""
        if label is None:
            return self.weight.get

        def of(term: str) -> float | None:
            if term not in self.weight:
                return None
            w = self.odds(term, label, 1 - label)
            return w if w >= LIFT else None

        return of


def features(text: str, weight) -> list[float]:
    """One number for each of ``NAMES``; all 0 for an empty text."""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    words = [w.strip(EDGE) for w in text.lower().split()]
    n_words = max(1, len(words))
    distinct = Counter(words)
    bad: dict[str, float] = {}
    begun = 0.0
    for w in distinct:
        got = weight(w) or (LIFT if w in SEED else None)
        if got:
            bad[w] = got
        if len(w) >= BEGIN and (b := weight(f"{w[:BEGIN]}*")):
            begun += b * distinct[w]
    hits = sum(distinct[w] for w in bad)
    near = 0
    n_you = sum(distinct[w] for w in distinct.keys() & YOU)
    if bad and n_you:
        at = np.array([i for i, w in enumerate(words) if w in bad])
        ys = np.array([i for i, w in enumerate(words) if w in YOU])
        right = np.searchsorted(ys, at)
        gap = np.minimum(np.abs(ys[np.minimum(right, len(ys) - 1)] - at), np.abs(ys[np.maximum(right - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    # most words are letters only, in lower case, so characters are looked at in the others only
    other = [w for w in distinct if not w.isalpha()]
    letters = max(1, sum(map(len, words)) - sum(distinct[w] * (len(w) - sum(map(str.isalpha, w))) for w in other))
    loud = [w for w in raw if not w.islower()]
    odd = [w for w in other if MIXED.search(w)]
    plain = [re.sub(r"[^\w]|_", "", w.translate(LEET)) for w in odd]
    unmasked = sum(distinct[o] for o, p in zip(odd, plain, strict=True) if p in SEED or weight(p))
    return [sum(distinct[w] for w in distinct.keys() & SEED) / n_words,
            sum(w * distinct[t] for t, w in bad.items()) / n_words, float(np.log1p(hits)), max(bad.values(), default=0.0),
            near / n_words, n_you / n_words, sum(sum(map(str.isupper, w)) for w in loud) / letters,
            sum(len(w) > 2 and w.isupper() for w in loud) / n, (text.count("!") + text.count("?")) / n,
            sum(map(text.count, ".,;:!?*#@|")) / len(text), sum(distinct[o] for o in odd) / n_words, unmasked / n_words,
            begun / n_words]


def described(df: DataFrame, lexicon: Lexicon, text: str = "text", label: str | None = None) -> DataFrame:
    """``df`` with ``features array<double>``. With ``label``, each row is described without its own counts."""

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            labels = batch.column(label).to_pylist() if label else [None] * batch.num_rows
            flat = np.array([features(t, lexicon.seen_without(y)) for t, y in zip(texts(batch, text), labels, strict=True)])
            ends = np.arange(0, batch.num_rows * len(NAMES) + 1, len(NAMES), dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))]

        return fn

    return append_columns(df, [StructField("features", ArrayType(DoubleType(), False))], make)


class Model:
    """A fitted scorer. ``constant`` stands in where the labels show one class only."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score double`` (0 to 1) and ``predicted int`` (1 from 0.5 on). Every row stays; null and empty texts
        are scored as texts without words. Columns with the new names, or the model's own, are replaced."""
        kept, names = apart(docs, text=text)
        rows = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c.lower() not in ("score", "predicted")]
        if self.trees is None:
            scored = kept.withColumn("score", F.lit(float(self.constant)))
        else:
            told = described(kept, self.lexicon).withColumn("features", array_to_vector("features"))
            scored = self.trees.transform(told).withColumn("raised", vector_to_array("probability")[1])
            if self.calibration is None:
                scored = scored.withColumn("score", F.col("raised"))
            else:
                scored = self.calibration.transform(scored.drop("prediction")).withColumn("score", F.col("prediction"))
        score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
        return scored.select(*rows, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows that ``held_out`` leaves, ``sample`` of each class at most.

    Labels other than 0 and 1, labels of no document and documents of no label teach nothing. A document labelled both ways
    counts as toxic. Without rows of both classes the score is the share of toxic rows.
    """
    stage = Stage(docs.sparkSession, "toxicity")
    known = (labels.where(F.col(label).isin(0, 1) & ~held_out(doc)).groupBy(F.col(doc).alias("id"))
             .agg(F.max(label).cast("int").alias("label")))
    taken = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    ids = taken[0].union(taken[1])  # 2 * sample ids at most
    # one text for each id, so that repeated rows don't weigh more
    rows = stage.put(docs.select(F.col(f"`{doc}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
                     .join(F.broadcast(ids), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")))
    sizes = dict(rows.groupBy("label").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return Model(constant=float(bool(sizes.get(1))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for t, y in zip(texts(b), b.column("label").to_pylist(), strict=True):
                counts.update((term, y) for term in terms(t))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()),
                                              pa.array(list(counts.values()), pa.int64())], names=["term", "label", "n"])

    both = (rows.mapInArrow(split, "term string, label int, n long").groupBy("term")
            .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
                 F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("other")))
    odds = (F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("other") + 0.5) / (sizes[0] + 1))
            - DOUBT * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5)))
    best = both.where((F.col("toxic") >= SEEN) & (odds >= LIFT)).orderBy(odds.desc(), "term")
    # terms of SEEN toxic texts or more of the ``sample`` taken, so their number does not grow with the documents
    counted = {r["term"]: (r["toxic"], r["other"]) for r in best.collect()}

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(t, near) for text in texts(b) for t, near in neighbours(text, counted)}
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())],
                                             names=["term", "near"])

    # copies of a text repeat its words in their places; a word of its own stands among others each time
    places = (rows.where("label = 1").mapInArrow(stand, "term string, near string").distinct().groupBy("term").count()).collect() if counted else []
    seen = {r["term"]: r["count"] for r in places}
    lexicon = Lexicon({t: (min(toxic, seen.get(t, 0)), other) for t, (toxic, other) in counted.items()}, sizes[1], sizes[0])

    told = stage.put(described(rows, lexicon, label="label").select("id", "label", "features"))
    told = told.withColumn("features", array_to_vector("features")).withColumn("kept", F.pmod(F.xxhash64("id"), F.lit(CALIBRATE)) < 3)
    train = told.where("not kept").withColumn("label", F.col("label").cast("double"))
    if train.select("label").distinct().count() < 2:
        train = told.withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=5, maxBins=64, minInstancesPerNode=5).fit(train.coalesce(4))
    after = (trees.transform(told.where("kept").coalesce(4)).withColumn("raised", vector_to_array("probability")[1])
             .select(F.col("label").cast("double").alias("label"), "raised"))
    calibration = None
    if after.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="raised", labelCol="label").fit(after)
    return Model(lexicon, trees, calibration)
