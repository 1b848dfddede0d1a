"""Document search: terms, prefix matching over an inverted index, ranking, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.stages import Stages

# --- fixed values of ours: none of these is prescribed anywhere ---------------------------
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "how", "i", "in",
              "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "with", "you"]
QUESTION_WORDS = ["who", "what", "when", "where", "why", "how", "is", "are", "can", "do", "does"]
TITLE_WEIGHT = 10
BODY_WEIGHT = 1
FAQ_BONUS = 25
SNIPPET = 160
LEAD = 60
KEY = 4
KIND_LABELS = {"lesson": "Lesson", "faq": "Question", "install": "Install guide"}
# ------------------------------------------------------------------------------------------
SPLIT = r"[^\p{L}\p{N}]+"


def words(c: str) -> str:
    """SQL for the lower-case words of a text column."""
    return f"filter(split(lower({c}), r'{SPLIT}'), w -> w <> '')"


def index(docs: DataFrame) -> DataFrame:
    """One searchable entry per document; docs(doc_id, kind, title, body)."""
    label = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_LABELS.items()])
    return docs.select("doc_id", "kind", label.alias("kind_label"), "title", "body",
                       F.lower(F.concat_ws(" ", "title", "body")).alias("haystack"))


def terms(queries: DataFrame) -> DataFrame:
    """Query terms without stop words, unless nothing else is there; queries(query_id, query)."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    q = queries.selectExpr("*", f"array_distinct({words('query')}) AS all_words")
    return q.selectExpr(
        *queries.columns,
        f"CASE WHEN size(filter(all_words, w -> w NOT IN ({stop}))) > 0"
        f" THEN filter(all_words, w -> w NOT IN ({stop})) ELSE all_words END AS terms")


def postings(docs: DataFrame) -> DataFrame:
    """Inverted index: word, doc_id, in_title. Repeats within a document are dropped in place."""
    return docs.selectExpr(
        "doc_id", "kind", f"array_distinct({words('title')}) AS t", f"array_distinct({words('body')}) AS b").selectExpr(
        "doc_id", "kind", "explode(concat(transform(t, w -> struct(w AS word, true AS in_title)),"
                          " transform(b, w -> struct(w AS word, false AS in_title)))) AS e").select(
        "doc_id", "kind", "e.word", "e.in_title")


def write_index(docs: DataFrame, path: str) -> DataFrame:
    """Postings kept at ``path`` for many batches of queries: a range of words a file, sorted, so that a word's entries lie
    together, compress well and are skipped by a reader that asks for others."""
    postings(docs).repartitionByRange("word", "doc_id").sortWithinPartitions("word", "doc_id").write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def match(queries: DataFrame, docs: DataFrame | None, index: DataFrame | None = None) -> DataFrame:
    """D3: documents with a word beginning with each term of the query, and in which field.

    The documents are cut into words once: without a kept ``index`` (``write_index``) their postings are staged as Parquet, as the
    documents lie, and both the vocabulary and the join read them; the staged table stays in the shared folder, since the result
    reads it. The prefix match is made on the vocabulary: its words are handed out under
    their beginnings of up to four letters and meet the terms that begin alike.

    A document must hold all terms, so a query looks only at the documents with its rarest one (by the postings of the words that
    begin with it; a query with a term that begins no word has none). Of those documents the words that were hit meet the query's
    terms by equality. Which term is the rarest changes the work and not the result.
    """
    q = terms(queries).select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    need = q.select("term").distinct().withColumn("key", F.expr(f"left(term, {KEY})"))
    st = Stages(queries.sparkSession, "search")
    p = index if index is not None else st.put("postings", lambda: postings(docs))
    v = p.groupBy("word").agg(F.count("*").alias("n")).selectExpr(
        "*", f"explode(transform(sequence(1, least({KEY}, length(word))), n -> left(word, n))) AS key")
    hit = st.put("hit", lambda: v.join(need, (v["key"] == need["key"]) & F.expr("startswith(word, term)")).select("word", "term", "n"))
    rare = q.join(hit.groupBy("term").agg(F.sum("n").alias("n")), "term", "left").groupBy("query_id").agg(
        F.min_by("term", F.struct("n", "term")).alias("term"), F.count_if(F.col("n").isNull()).alias("lost")).where("lost = 0")
    among = hit.join(rare, "term").select("word", "query_id")
    pairs = st.put("pairs", lambda: p.join(among, "word").select("query_id", "doc_id").distinct())
    asked = pairs.join(q, "query_id")
    near = p.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    found = near.join(hit.select("word", "term"), "word").groupBy("doc_id", "kind", "term").agg(
        F.max("in_title").alias("in_title"), F.max(~F.col("in_title")).alias("in_body"))
    return found.join(asked, ["doc_id", "term"]).groupBy("query_id", "doc_id", "kind", "n_terms").agg(
        F.count("*").alias("n"), F.count_if(F.col("in_title")).alias("title_hits"),
        F.count_if(F.col("in_body")).alias("body_hits")).where("n = n_terms").drop("n")


def rank(matches: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Documents of each query, best first; a question leans towards answers. ``k`` keeps the first so many only."""
    ask = ", ".join(f"'{w}'" for w in QUESTION_WORDS)
    q = queries.selectExpr("query_id", f"query LIKE '%?' OR lower(split(trim(query), ' ')[0]) IN ({ask}) AS asks")
    m = matches.join(q, "query_id").withColumn(
        "score", F.col("title_hits") * TITLE_WEIGHT + F.col("body_hits") * BODY_WEIGHT
        + F.when(F.col("asks") & (F.col("kind") == "faq"), FAQ_BONUS).otherwise(0))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = m.withColumn("k", F.row_number().over(w)).select("query_id", "k", "doc_id", "kind", "score")
    return ranked if k is None else ranked.where(F.col("k") <= k)


def snippets(ranked: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Text around the first place a term is found, cut to a bounded length.

    Only the ranked documents are joined with their text.
    """
    q = terms(queries).select("query_id", "terms")
    d = ranked.join(q, "query_id").join(docs.select("doc_id", "body"), "doc_id")
    d = d.selectExpr(
        "*", r"concat(' ', regexp_replace(lower(body), r'[^\p{L}\p{N}]', ' ')) AS plain")
    d = d.selectExpr("*", "array_min(filter(transform(terms, t -> locate(concat(' ', t), plain)), p -> p > 0)) AS p")
    d = d.selectExpr("*", f"greatest(1, coalesce(p, 1) - {LEAD}) AS s")
    return d.selectExpr(
        "query_id", "k", "doc_id",
        f"concat(IF(s > 1, '…', ''), substring(body, s, {SNIPPET}), IF(s + {SNIPPET} <= length(body), '…', '')) AS snippet")
