"""The operators over their whole tables, as registered queries, next to the SQL that gives the same table where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import (bpe, chat, embedding, langid, ngram_lm, packing, periodic, quality, sharding, simhash, spelling, topk,
                           toxicity)
from quillwork.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 8


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = re.sub(r"\n\s*\n", "\n", sql.strip())
        return fn

    return wrap


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to ids and decoded again, as digests."""
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids.drop("text"), RANKS, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", "n_tokens", F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens along the curve."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# CRC-32 bit by bit: 3988292384 is its polynomial, reversed
OP3 = """
WITH b AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents
), s AS (
  SELECT doc_id, len(bytes) + 1 AS size, xor(list_reduce(bytes, lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda r, z: xor(r >> 1, 3988292384 * (r & 1)), xor(c, x)), 4294967295), 4294967295) AS text_crc32 FROM b
), g AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s),
d AS (SELECT *, least(((2 * upto - size) * 8) // (2 * total), 7)::INT AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM d
"""


@query("op3_sharding", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of near equal bytes."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sized = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.shard(sized, SHARDS, ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a model of the labels of the training part."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op5_langid")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by prototypes of the training part."""
    docs = read(spark, sf_dir, "documents")
    prototypes = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the class of near duplicates it is in."""
    return simhash.grouped(read(spark, sf_dir, "documents"))


OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON v.vec_id = least.vec_id
"""


@query("op7_embedding_dedup", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every vector."""
    return embedding.grouped(read(spark, sf_dir, "embeddings"))


OP8 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM documents),
g AS (SELECT doc_id, unnest([' '] || x[1:len(x) - 1]) AS b, unnest(x) AS w FROM texts WHERE len(x) > 0),
pairs AS (SELECT b, w, count(*) AS n FROM g GROUP BY b, w),
begins AS (SELECT b, count(*) AS n FROM g GROUP BY b),
words AS (SELECT w, count(*) AS n FROM g GROUP BY w),
scored AS (
  SELECT p.b, p.w, CASE WHEN p.n >= 2 THEN ln(p.n::DOUBLE / begins.n)
                        ELSE ln(0.4) + ln(words.n::DOUBLE / (SELECT count(*) FROM g)) END AS s
  FROM pairs p JOIN begins ON begins.b = p.b JOIN words ON words.w = p.w
), sums AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM g JOIN scored ON scored.b = g.b AND scored.w = g.w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_grams, round(coalesce(s, 0), 3) AS score, round(s / n, 6) AS mean_score
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""


@query("op8_ngram_lm", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score under the model of word pairs of all documents."""
    told = ngram_lm.score(read(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_grams", F.round("score", 3).alias("score"), F.round("mean_score", 6).alias("mean_score"))


OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op9_topk", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth one."""
    rows = read(spark, sf_dir, "embeddings").where(
        F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("v"))
    return topk.search(whole, F.col("vec_id") % 20 == 0)


#: The tool of each kind of message that asks for something.
SCHEMAS = {
    f"chat.{role}": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
                     "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}
    for role in ("system", "user")
}


def messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``conversations`` as calls and results: whatever is not said by the assistant calls for an answer, and an assistant's turn
    answers the turn before it. A call uses the answer two turns before it, or the call right before it."""
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda back: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    asks = F.coalesce(F.col("role") != "assistant", F.lit(True))
    before = said.select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), F.col("role").alias("r")).groupBy("c", "t").agg(F.min("r").alias("r"))
    calls = said.where(asks).join(before, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        F.col("conv_id").alias("conv"), "turn", name(0).alias("call_id"), F.concat(F.lit("chat."), "role").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.when(F.col("t").isNull(), None).when(F.col("r") == "assistant", name(2)).otherwise(name(1)).alias("after"))
    results = said.where(~asks).select(F.col("conv_id").alias("conv"), "turn", name(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


OP10 = """
WITH RECURSIVE said AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT s.conv_id, s.turn, 'call_' || s.conv_id || '_' || s.turn AS call_id, 'chat.' || s.role AS name, s.text,
    CASE WHEN p.turn IS NULL THEN NULL WHEN p.role = 'assistant' THEN 'call_' || s.conv_id || '_' || (s.turn - 2)
      ELSE 'call_' || s.conv_id || '_' || (s.turn - 1) END AS after
  FROM said s LEFT JOIN said p ON p.conv_id = s.conv_id AND p.turn = s.turn - 1 WHERE s.role <> 'assistant'
), results AS (
  SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text FROM said WHERE role = 'assistant'
), levels AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.after = l.call_id
), told AS (
  SELECT c.conv_id AS conv, c.turn, c.call_id, 'call' AS kind,
    CASE WHEN r.turn IS NULL THEN 'unanswered'
      WHEN c.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after) THEN 'unknown_after'
      ELSE 'linked' END AS status,
    CASE WHEN c.name NOT IN ('chat.system', 'chat.user') THEN 'unknown_tool' WHEN c.text IS NULL THEN '$.text:required'
      WHEN c.text = '' THEN '$.text:minLength' END AS errors, l.level,
    '{"after":' || coalesce(to_json(c.after)::VARCHAR, 'null') || ',"function":{"arguments":{'
      || coalesce('"text":' || to_json(c.text)::VARCHAR || ',', '') || '"turn":' || c.turn || '},"name":' || to_json(c.name)::VARCHAR || '},"id":'
      || to_json(c.call_id)::VARCHAR || ',"result":' || CASE WHEN r.turn IS NULL THEN 'null' ELSE '{"content":'
      || coalesce(to_json(r.text)::VARCHAR, 'null') || ',"turn":' || r.turn || '}' END || '}' AS message
  FROM calls c JOIN levels l USING (conv_id, call_id) LEFT JOIN results r USING (conv_id, call_id)
  UNION ALL
  SELECT r.conv_id, r.turn, r.call_id, 'result', 'orphan', NULL, NULL,
    '{"id":' || to_json(r.call_id)::VARCHAR || ',"result":{"content":' || coalesce(to_json(r.text)::VARCHAR, 'null') || ',"turn":' || r.turn || '}}'
  FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
)
SELECT conv, turn, call_id, kind, status, errors, level,
  row_number() OVER (PARTITION BY conv ORDER BY level NULLS LAST, turn, kind, call_id, message) - 1 AS position, message FROM told
"""


@query("op10_chat", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message that calls for an answer with the answer, in topological order and as canonical JSON."""
    return chat.link(*messages(spark, sf_dir), SCHEMAS)


OP11 = """
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
    FROM documents) WHERE length(w) >= 6 GROUP BY ALL
), b AS (
  SELECT w, c, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || w)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM runs
), hashed AS (
  SELECT w, c, xor(list_reduce(bytes, lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda r, z: xor(r >> 1, 3988292384 * (r & 1)), xor(c, x)), 4294967295), 4294967295) AS h FROM b
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5
), gaps AS (
  SELECT word, n, left(word, i) || '-' || substr(word, i + 2) AS gapped, left(word, i) || substr(word, i + 2) AS shorter
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), inserted AS (SELECT DISTINCT g.word AS l, g.n AS ln, w.word AS s, w.n AS sn FROM gaps g JOIN words w ON w.word = g.shorter),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.gapped = b.gapped AND a.word <> b.word
  UNION ALL SELECT l, s, sn FROM inserted UNION ALL SELECT s, l, ln FROM inserted
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), up AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, u.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN up u ON u.word = f.word JOIN formed e ON e.word = u.at AND e.form IS NULL
"""


def dropped_letter(h: int, run: str) -> str:
    """One in 199 runs loses the letter that its hash names."""
    at = h % len(run)
    return run if h % 199 else run[:at] + run[at + 1 :]


@query("op11_spelling_variants", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, form and root."""
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"), change=dropped_letter))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where one text in ten repeats its own words from some place to its end."""
    found = "regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    a, p = "cast(g % size(w) AS int)", "cast(1 + floor((size(w) - a) / (3 + g % 8)) AS int)"
    # lambdas over arrays of one element, so that each step is made once a row
    tail = f"transform(array({p}), p -> array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((size(w) - a) / p) AS int))), 1, size(w) - a)), ' '))[0]"
    text = f"transform(array({found}), w -> IF(size(w) = 0, '', transform(array({a}), a -> {tail})[0]))[0]"
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return hashed.selectExpr("doc_id", "h div 10 AS g", "h % 10 AS k", "text").selectExpr("doc_id", f"IF(k = 0, {text}, text) AS text")


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, the one of the greatest exponent, and the text without their repetitions."""
    found = periodic.find(with_periodic_ends(read(spark, sf_dir, "documents")))
    best = F.expr("aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>),"
                  " (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))").alias("best")
    told = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
                          F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return digest.selectExpr("doc_id", "n_runs", "best.start", "best.length", "best.period", "1000 * best.length div best.period AS exponent_milli",
                             "runs_sha256", "collapsed_sha256")


@query("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every text, the base rule and the trees' verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, trees).select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")
