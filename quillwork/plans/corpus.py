"""Queries over text, links, files and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.functions.num import r6
from quillwork.operators import corpus as X
from quillwork.operators import search as D
from quillwork.operators import triage as S
from quillwork.plans import ctes as C
from quillwork.plans.metrics import KERN, shape_kerning, shape_spacing
from quillwork.plans.registry import query
from quillwork.sources import adapters as A

CHARS = """chars AS (SELECT {keys}, unnest(string_split(text, '')) AS ch FROM documents)"""


@query("charset_dim", f"""WITH {C.CHARSET},
c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c GROUP BY ch)
SELECT s.ord, s.ch, s.name, s.zone, s.unicode, s.parts, s.grp, s.kind, coalesce(n.n, 0) AS n FROM charset s LEFT JOIN n ON n.ch = s.ch""")
def charset_dim(spark, sf):
    """Every entry of the inventory, derived ones too, and how often a text corpus uses it."""
    n = X.characters(A.table(spark, sf, "documents").select("text"))
    return dims.charset(spark).join(n, "ch", "left").na.fill(0, ["n"])


@query("sheet_layout", f"""WITH {C.SHEETS},
c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c GROUP BY ch)
SELECT s.sheet_no, s.sheet_id, s.tier, s.rw, s.col, s.k, s.ch, coalesce(n.n, 0) AS n FROM sheets s LEFT JOIN n ON n.ch = s.ch""")
def sheet_layout(spark, sf):
    """S3: every place of every sheet (row, column, writing order), and how often a text corpus uses its character."""
    n = X.characters(A.table(spark, sf, "documents").select("text"))
    return dims.sheets(spark).join(n, "ch", "left").na.fill(0, ["n"])


FONTS = """fonts AS (SELECT lang, (ascii(lang) + ascii(substring(lang, 2, 1)))
    % (SELECT max(p_partkey // 112) + 1 FROM part) AS font_id FROM (SELECT DISTINCT lang FROM documents))"""


def set_texts(spark, sf, *cols):
    """Documents with the font their language is set in: the languages share out the fonts."""
    n = A.table(spark, sf, "part").select(F.expr("max(p_partkey div 112) + 1")).scalar()
    font = (F.ascii("lang") + F.ascii(F.substring("lang", 2, 1))) % n
    return A.table(spark, sf, "documents").select(*cols, "text", font.alias("font_id"))


@query("text_coverage", f"""WITH {C.OBS}, {FONTS},
c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT lang, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT lang, font_id, n.ch, n, EXISTS (SELECT 1 FROM obs o WHERE o.font_id = f.font_id AND o.ch = n.ch) AS covered
FROM n JOIN fonts f USING (lang)""")
def text_coverage(spark, sf):
    n = X.characters(set_texts(spark, sf, "lang"), "lang", "font_id")
    return X.text_coverage(n, A.glyph_observations(spark, sf)).select("lang", "font_id", "ch", "n", "covered")


@query("text_width", f"""WITH {KERN}, {FONTS},
d AS (SELECT doc_id, font_id, string_split(text, '') AS c FROM documents JOIN fonts USING (lang)),
b AS (SELECT doc_id, font_id, c[i] AS ch, c[i + 1] AS nx FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM d)),
g AS (SELECT doc_id, font_id, ch, nx, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT doc_id, g.font_id, sum(coalesce(advance, 0) * n) AS plain, sum(coalesce(value, 0) * n) AS kern
  FROM g LEFT JOIN spaced s ON s.font_id = g.font_id AND s.ch = g.ch
  LEFT JOIN kern k ON k.font_id = g.font_id AND k.left_ch = g.ch AND k.right_ch = g.nx GROUP BY ALL)
SELECT doc_id, font_id, round(plain, 3) AS plain, round(plain + kern, 3) AS kerned, round(kern::DOUBLE / nullif(plain, 0) * 100, 6) + 0.0 AS shift_pct FROM w""")
def text_width(spark, sf):
    w = X.text_width(set_texts(spark, sf, "doc_id"), shape_spacing(spark, sf), shape_kerning(spark, sf))
    return w.select("doc_id", "font_id", F.round("plain", 3).alias("plain"), F.round("kerned", 3).alias("kerned"),
                    r6(F.col("shift_pct")).alias("shift_pct"))


@query("digraph_frequency", f"""WITH d AS (SELECT string_split(lower(text), '') AS c FROM documents),
b AS (SELECT c[i] || c[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(c))) AS i FROM d)),
n AS (SELECT pair, count(*) AS n FROM b WHERE regexp_full_match(pair, '[a-z][a-z]') GROUP BY pair)
SELECT pair, n, pair IN ({", ".join(f"'{s}'" for s in dims.LIGATURES)}) AS covered FROM n ORDER BY n DESC, pair LIMIT 50""")
def digraph_frequency(spark, sf):
    return X.digraph_frequency(A.table(spark, sf, "documents").select("text"), 50)


LINKS = """hrefs AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages
  UNION ALL SELECT page_id, url, unnest(['HTTPS://Other.example.org/', 'mailto:me@example.org', '//cdn.example.net/a/../b?x=1#top',
    '#here', '?page=9', '../up', 'http://other.example.org:80/./c', url]) FROM pages)"""


def links(spark, sf):
    """Links of the pages as written, and for each page a few of every other kind."""
    p = A.table(spark, sf, "pages")
    own = p.selectExpr("page_id", "url AS base", "explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href")
    more = p.selectExpr(
        "page_id", "url AS base", "explode(array('HTTPS://Other.example.org/', 'mailto:me@example.org',"
        " '//cdn.example.net/a/../b?x=1#top', '#here', '?page=9', '../up', 'http://other.example.org:80/./c', url)) AS href")
    return own.unionByName(more)


@query("outbound_links", f"""WITH {LINKS},
v(href, scheme, host, rest) AS (VALUES ('HTTPS://Other.example.org/', 'https', 'other.example.org', ''),
  ('//cdn.example.net/a/../b?x=1#top', NULL, 'cdn.example.net', '/b?x=1#top'),
  ('http://other.example.org:80/./c', 'http', 'other.example.org', '/c'))
SELECT page_id, h.href, host, rest, coalesce(scheme, split_part(base, ':', 1)) = 'https' AS secure FROM hrefs h JOIN v ON v.href = h.href""")
def outbound_links(spark, sf):
    return X.outbound_links(links(spark, sf))


FILES = """files AS (SELECT page_id, regexp_extract(href, '([^/]*)$', 1) || coalesce(sfx, '') AS name,
    CASE WHEN page_id % 7 = 0 THEN 'Audio/ogg' WHEN page_id % 11 = 0 THEN 'image/png' END AS type
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
    (SELECT unnest([NULL, '.JPG', '.tar.gz', '.Py', '.woff2', '.', '.mp3', '.exe']) AS sfx))"""


def files(spark, sf):
    """A file manifest: the last path segment of every link, bare and with endings of every group."""
    p = A.table(spark, sf, "pages").selectExpr(
        "page_id", "explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href")
    return p.selectExpr("page_id", "href", "explode(array('', '.JPG', '.tar.gz', '.Py', '.woff2', '.', '.mp3', '.exe')) AS sfx").selectExpr(
        "page_id", "concat(regexp_extract(href, '([^/]*)$', 1), sfx) AS name",
        "CASE WHEN page_id % 7 = 0 THEN 'Audio/ogg' WHEN page_id % 11 = 0 THEN 'image/png' END AS type")


EXT = f"exts AS ({dims.values_sql(S.extension_rows(), 'ext, what, rank', duck=True)})"


@query("file_classify", f"""WITH {FILES}, {EXT},
e AS (SELECT *, CASE WHEN strpos(name, '.') > 0 AND NOT ends_with(name, '.') AND
   length(name) - length(list_last(string_split(name, '.'))) > 1 THEN lower(list_last(string_split(name, '.'))) ELSE '' END AS ext FROM files),
c AS (SELECT page_id, name, type, e.ext, CASE WHEN type = 'image/png' THEN NULL WHEN type IS NOT NULL AND (rank IS NULL OR rank > 3) THEN 'sound'
   ELSE what END AS what FROM e LEFT JOIN exts x ON x.ext = e.ext)
SELECT *, what IS NULL AS ok FROM c""")
def file_classify(spark, sf):
    return S.classify(files(spark, sf))


MAGIC = ["FFD8FFE000104A46494600", "89504E470D0A1A0A0000", "474946383961010001", "524946460000000057454250",
         "255044462D312E340A25", "504B0304140000000800", "00000018667479704865494300", "", "0000001866747970717420"]


@query("file_sniff", """WITH m AS (SELECT page_id, page_id % 9 AS k, html FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'pdf'
  WHEN 5 THEN 'zip' WHEN 6 THEN 'heic' END AS kind FROM m""")
def file_sniff(spark, sf):
    """S5 over page bodies stored behind the opening bytes of nine kinds of file."""
    arr = "array(" + ", ".join(f"'{m}'" for m in MAGIC) + ")"
    b = A.table(spark, sf, "pages").selectExpr(
        "page_id", f"concat(unhex(element_at({arr}, cast(page_id % 9 AS int) + 1)), encode(html, 'UTF-8')) AS content")
    return b.select("page_id", S.sniff("content").alias("kind"))


@query("jpeg_carve", """WITH d AS (SELECT doc_id AS id, octet_length(encode(text)) + 5 AS n, (octet_length(encode(text)) * 2) + 5 AS n2 FROM documents)
SELECT id, (CASE WHEN n >= 2048 THEN 1 ELSE 0 END + CASE WHEN n2 >= 2048 THEN 1 ELSE 0 END) AS n_found, greatest(n, n2) AS n_bytes
FROM d WHERE greatest(n, n2) >= 2048""")
def jpeg_carve(spark, sf):
    """S6 over files that hold two pictures, one of twice the size, between noise."""
    b = A.table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "concat(X'00FFD9FFD8', encode(text, 'UTF-8'), X'FFD8FF', encode(text, 'UTF-8'), X'FFD9',"
                        " encode(text, 'UTF-8'), X'FFD8FF', encode(text, 'UTF-8'), encode(text, 'UTF-8'), X'FFD9FFD8FF00') AS content")
    return S.carve_jpegs(b).select("id", "n_found", "n_bytes")


# --- search -----------------------------------------------------------------------------
QUERIES = "qs AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 3 = 0 THEN '?' ELSE '' END AS query FROM benchmark)"
RX = r"[^\p{L}\p{N}]+"


def _words(c):
    return f"list_filter(regexp_split_to_array(lower({c}), '{RX}'), lambda w: w <> '')"


STOP = ", ".join(f"'{w}'" for w in D.STOP_WORDS)
TERMS = QUERIES + f""",
t0 AS (SELECT query_id, query, list_distinct({_words('query')}) AS al FROM qs),
tm AS (SELECT query_id, query, CASE WHEN len(list_filter(al, lambda w: w NOT IN ({STOP}))) > 0
  THEN list_filter(al, lambda w: w NOT IN ({STOP})) ELSE al END AS terms FROM t0)"""
MATCH = C.DOCS + "," + TERMS + f""",
ps AS (SELECT doc_id, kind, unnest(list_distinct({_words('title')})) AS word, true AS in_title FROM docs
  UNION ALL SELECT doc_id, kind, unnest(list_distinct({_words('body')})), false FROM docs),
qt AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM tm),
hit AS (SELECT DISTINCT term, word FROM (SELECT DISTINCT word FROM ps) w JOIN (SELECT DISTINCT term FROM qt) t ON starts_with(word, term)),
fnd AS (SELECT doc_id, kind, term, bool_or(in_title) AS in_title, bool_or(NOT in_title) AS in_body FROM ps JOIN hit USING (word) GROUP BY ALL),
mt AS (SELECT query_id, doc_id, kind, n_terms, count(*) FILTER (WHERE in_title) AS title_hits, count(*) FILTER (WHERE in_body) AS body_hits
  FROM fnd JOIN qt USING (term) GROUP BY ALL HAVING count(*) = n_terms)"""
ASK = ", ".join(f"'{w}'" for w in D.QUESTION_WORDS)
RANK = MATCH + f""",
sc AS (SELECT mt.*, title_hits * 10 + body_hits + CASE WHEN kind = 'faq' AND (query LIKE '%?' OR lower(string_split(trim(query), ' ')[1]) IN ({ASK}))
   THEN 25 ELSE 0 END AS score FROM mt JOIN qs USING (query_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM sc)"""


def search_queries(spark, sf):
    """What people look for: whole passages, every third as a question."""
    return A.table(spark, sf, "benchmark").selectExpr("item_id AS query_id", "concat(text, IF(item_id % 3 = 0, '?', '')) AS query")


@query("search_index", f"""WITH {C.DOCS}
SELECT doc_id, kind, CASE kind WHEN 'lesson' THEN 'Lesson' WHEN 'faq' THEN 'Question' ELSE 'Install guide' END AS kind_label,
  length(title) + length(body) + 1 AS n, md5(lower(title || ' ' || body)) AS digest FROM docs""")
def search_index(spark, sf):
    return D.index(A.search_docs(spark, sf)).selectExpr(
        "doc_id", "kind", "kind_label", "length(haystack) AS n", "md5(haystack) AS digest")


@query("search_terms", f"WITH {TERMS} SELECT query_id, array_to_string(list_sort(terms), ' ') AS terms FROM tm")
def search_terms(spark, sf):
    return D.terms(search_queries(spark, sf)).selectExpr("query_id", "concat_ws(' ', array_sort(terms)) AS terms")


@query("search_match", f"WITH {MATCH} SELECT query_id, doc_id, title_hits, body_hits FROM mt")
def search_match(spark, sf):
    return D.match(search_queries(spark, sf), A.search_docs(spark, sf)).select(
        "query_id", "doc_id", "title_hits", "body_hits")


@query("search_rank", f"WITH {RANK} SELECT query_id, k, doc_id, kind, score FROM rk")
def search_rank(spark, sf):
    q = search_queries(spark, sf)
    return D.rank(D.match(q, A.search_docs(spark, sf)), q)


@query("search_snippet", f"""WITH {RANK},
b AS (SELECT rk.query_id, k, rk.doc_id, body, terms, ' ' || regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]', ' ', 'g') AS plain
  FROM rk JOIN tm USING (query_id) JOIN docs USING (doc_id)),
p AS (SELECT *, greatest(1, coalesce(list_min(list_filter(list_transform(terms, lambda t: strpos(plain, ' ' || t)), lambda p: p > 0)), 1) - 60) AS s FROM b)
SELECT query_id, k, doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || substring(body, s, 160) || CASE WHEN s + 160 <= length(body) THEN '…' ELSE '' END AS snippet FROM p""")
def search_snippet(spark, sf):
    q, d = search_queries(spark, sf), A.search_docs(spark, sf)
    return D.snippets(D.rank(D.match(q, d), q), q, d)
