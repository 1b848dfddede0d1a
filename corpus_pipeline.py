"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's ``docs``. A stage works on all that its predecessor kept. The first three return the columns they were
given; the last returns the pieces of the packed sequences. Rows without text, repeated rows and an empty table pass as each
operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import langid, near, packing, toxicity
from quillwork.llm.common import Stage, apart, read
from quillwork.llm.queries import WORDS

def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a known language: those with a letter and a cosine with its prototype in keeping with the learning part's texts
    of the language."""
    plain, names = apart(docs, doc_id="doc_id", text="text", lang="lang")
    prototypes = langid.learn(plain.where(~langid.held_out()))
    # staged, so that what is usual is learned from the same cosines
    told = Stage(spark, "language").put(langid.predict(plain, prototypes, worth="worth"))
    known = langid.usual_enough(langid.usual_told(told.where(~langid.held_out())))
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & known).select(*names).toDF(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that are not predicted to be toxic. The model learns from the labels of the documents it is given."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    plain, names = apart(docs, text="text")
    return model.score(plain).where("predicted = 0").select(*names).toDF(*docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: SimHash candidates of five-word shingles, held against each other by the
    exact resemblance of their shingles, 0.8 or more."""
    return near.single(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 4096 tokens."""
    pieces = packing.pack(docs, WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", languages), ("toxicity", clean), ("near_dedup", single), ("packing", packed)]

ORACLE_SQL = None  # SQL can express none of the stages; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` applied to ``documents``, each stage's rows staged for the next."""
    docs = read(spark, sf_dir, "documents")
    stage = Stage(spark, "pipeline")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage.put(docs)
    return docs
