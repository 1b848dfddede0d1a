"""DuckDB twins of the adapters, as WITH-clause fragments."""

from __future__ import annotations

from quillwork.functions import dims

CHARSET = f"charset AS ({dims.values_sql(dims.charset_rows(), dims.CHARSET_COLS, duck=True)})"
SHEETS = f"sheets AS ({dims.values_sql(dims.sheet_rows(), dims.SHEET_COLS, duck=True)})"
STYLES = f"styles AS ({dims.values_sql(dims.STYLES, dims.STYLE_COLS, duck=True)})"
DERIVED = f"derived AS ({dims.values_sql(dims.derived_rows(), dims.DERIVED_COLS, duck=True)})"

SCANS = """
scan0 AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
scans AS (SELECT vec_id AS scan_id, CASE WHEN list_max(e) > list_min(e)
   THEN list_transform(e, lambda v: CAST(floor(255 * (v - list_min(e)) / (list_max(e) - list_min(e))) AS INT))
   ELSE list_transform(e, lambda v: 0) END AS gray FROM scan0)"""
PIXELS = SCANS + """,
pixels AS (SELECT scan_id, (i // 8)::INT AS y, (i % 8)::INT AS x, gray[i + 1] AS gray
   FROM scans, range(64) r(i))"""
# sheet pages made of the 8x8 images
PAGES = SCANS + "," + SHEETS + """,
placed AS (SELECT font_id * 14 + s.sheet_no AS scan_id, font_id, s.sheet_no, s.sheet_id, s.ch, s.col,
     (12 * (max(s.col) OVER (PARTITION BY font_id, s.sheet_no) + 1) + 6)::INT AS w, 20 AS h,
     6 + s.col * 12 AS x0, 6 AS y0, gray
   FROM (SELECT scan_id // 112 AS font_id, scan_id % 112 AS k, gray FROM scans) g
   JOIN sheets s ON s.k = g.k AND s.sheet_no < 14)"""
PAGE_INK = PAGES + """,
ink AS (SELECT scan_id, w, h, (y0 + i // 8)::INT AS y, (x0 + i % 8)::INT AS x
   FROM placed, range(64) r(i) WHERE gray[i + 1] < 128)"""
PAGE_PIXELS = PAGES + """,
pixels AS (SELECT scan_id, w, h, y::INT AS y, x::INT AS x,
     CASE WHEN x >= x0 AND x < x0 + 8 AND y >= y0 AND y < y0 + 8
       THEN gray[(y - y0) * 8 + x - x0 + 1] ELSE 255 END AS gray
   FROM placed, range(20) a(y), range(170) b(x)
   WHERE x >= CASE WHEN col = 0 THEN 0 ELSE x0 END AND x <= x0 + 11)"""
OBS = CHARSET + """,
li AS (SELECT l_orderkey AS rw, l_orderkey // 30 AS font_id, l_orderkey % 14 AS sheet_no,
     l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, c.ord, c.ch, c.zone, c.grp,
     300 + l_orderkey % 7 AS base, CAST(floor(l_quantity) AS INT) % 5 - 2 AS j,
     l_returnflag = 'R' AND l_linenumber = 1 AND l_orderkey % 10 = 0 AS stated
   FROM lineitem JOIN charset c ON c.ord = l_partkey % 112 AND c.kind = 'required'),
obs AS (SELECT font_id, sheet_no, rw, ord, ch, zone, grp, stated, base,
     row(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS o,
     j + CASE WHEN zone IN ('x', 'desc') THEN base - 100 WHEN zone = 'base' THEN base - 20
       WHEN zone = 'mid' THEN base - 60 ELSE base - 181 END - CASE WHEN l_quantity = 50 THEN 120 ELSE 0 END AS y0,
     j + CASE WHEN zone IN ('x', 'asc', 'base') THEN base WHEN zone IN ('desc', 'full') THEN base + 59
       WHEN zone = 'mid' THEN base - 40 ELSE base - 150 END AS y1,
     20 + l_partkey % 40 AS w
   FROM li)"""
SHAPES = CHARSET + """,
shapes AS (SELECT p_partkey AS glyph_id, p_partkey // 112 AS font_id, c.ord, c.ch, c.name, c.zone,
     CAST(200 + p_size * 8 AS DOUBLE) AS width,
     ['flat', 'round', 'up', 'down'][p_partkey % 4 + 1] AS shape,
     CAST(CASE WHEN zone IN ('desc', 'full') THEN -200 WHEN zone = 'mid' THEN 150
       WHEN zone = 'high' THEN 500 ELSE 0 END AS DOUBLE) AS y0,
     CAST(CASE WHEN zone IN ('x', 'desc') THEN 500 WHEN zone = 'base' THEN 100
       WHEN zone = 'mid' THEN 350 ELSE 700 END AS DOUBLE) AS y1
   FROM part JOIN charset c ON c.ord = p_partkey % 112 AND c.kind = 'required')"""
PROFILES = SHAPES + """,
prof0 AS (SELECT *, y1 - i * (y1 - y0) / 40 AS y, i / CAST(40 AS DOUBLE) AS t FROM shapes, range(41) r(i)),
prof1 AS (SELECT *, CASE shape WHEN 'flat' THEN 0 WHEN 'up' THEN width / 2 * (1 - t)
     WHEN 'down' THEN width / 2 * t
     ELSE width / 2 * (1 - sqrt(greatest(0, 1 - (2 * t - 1) * (2 * t - 1)))) END AS lft FROM prof0),
profiles AS (SELECT glyph_id, font_id, ord, ch, name, zone, width, y0, y1, i, y, lft, width - lft AS rgt
   FROM prof1)"""
HITS = """hits AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ts_ms, event_id AS hit_id FROM events)"""
DOCS = """docs AS (
  SELECT 'd' || doc_id AS doc_id, 'lesson' AS kind, string_split(text, chr(10))[1] AS title, text AS body FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, 'faq', role, text FROM conversations
  UNION ALL SELECT 'p' || page_id, 'install', regexp_extract(html, '<title>([^<]*)</title>', 1),
    regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g') FROM pages)"""
PATHS = CHARSET + """,
pth AS (SELECT *, 60 * f AS a, (60 + 2 * width) * f AS b, 2 * f * y0 AS c, 2 * f * y1 AS d, (2 * width + 150) * f AS adv FROM (
  SELECT p_partkey AS glyph_id, p_partkey // 260 AS font_id, c.ord, c.ch, c.name, c.kind, c.unicode, CAST(200 + p_size * 8 AS DOUBLE) AS width,
     p_partkey % 4 AS shape, 1 + (p_partkey // 260) % 3 * 0.25::DOUBLE AS f,
     CAST(CASE WHEN zone IN ('desc', 'full') THEN -200 WHEN zone = 'mid' THEN 150 WHEN zone = 'high' THEN 500 ELSE 0 END AS DOUBLE) AS y0,
     CAST(CASE WHEN zone IN ('x', 'desc') THEN 500 WHEN zone = 'base' THEN 100 WHEN zone = 'mid' THEN 350 ELSE 700 END AS DOUBLE) AS y1
  FROM part JOIN charset c ON c.ord = CASE WHEN p_partkey % 130 < 112 THEN p_partkey % 130 ELSE p_partkey % 130 + 8 END)),
rng AS (SELECT *, CASE shape WHEN 0 THEN [{'x': a, 'y': c}, {'x': a, 'y': d}, {'x': b, 'y': d}, {'x': b, 'y': c}]
    WHEN 1 THEN [{'x': a, 'y': (c + d) / 2}, {'x': (a + b) / 2, 'y': d}, {'x': b, 'y': (c + d) / 2}, {'x': (a + b) / 2, 'y': c}]
    WHEN 2 THEN [{'x': a, 'y': c}, {'x': (a + b) / 2, 'y': d}, {'x': b, 'y': c}]
    ELSE [{'x': a, 'y': d}, {'x': b, 'y': d}, {'x': (a + b) / 2, 'y': c}] END AS p,
    [{'x': a, 'y': d}, {'x': b, 'y': d}, {'x': b, 'y': c}, {'x': a, 'y': c}] AS q FROM pth),
seg AS (SELECT *, i AS seq, p[i + 1] AS u, p[(i + 1) % len(p) + 1] AS v, q[i + 1] AS w FROM (SELECT *, unnest(range(0, len(p))) AS i FROM rng)),
cv AS (SELECT glyph_id, font_id, seq::INT AS seq, u.x AS p0x, u.y AS p0y, v.x AS p3x, v.y AS p3y,
    CASE WHEN shape = 1 THEN u.x + 2 / 3::DOUBLE * (w.x - u.x) ELSE u.x + (v.x - u.x) / 3 END AS c1x, CASE WHEN shape = 1 THEN u.y + 2 / 3::DOUBLE * (w.y - u.y) ELSE u.y + (v.y - u.y) / 3 END AS c1y,
    CASE WHEN shape = 1 THEN v.x + 2 / 3::DOUBLE * (w.x - v.x) ELSE u.x + 2 * (v.x - u.x) / 3 END AS c2x, CASE WHEN shape = 1 THEN v.y + 2 / 3::DOUBLE * (w.y - v.y) ELSE u.y + 2 * (v.y - u.y) / 3 END AS c2y FROM seg),
scl AS (SELECT font_id, CASE WHEN max(CASE WHEN ch = 'x' THEN d - greatest(0, c) END) > 100 THEN 500 / max(CASE WHEN ch = 'x' THEN d - greatest(0, c) END) ELSE 0.5 END::DOUBLE AS scale FROM pth GROUP BY 1),
imp AS (SELECT glyph_id, p.font_id, ord, ch, name, kind, unicode, (b - a) * scale AS ink_width, c * scale AS ink_y0, d * scale AS ink_y1, a * scale AS lsb, (adv - b) * scale AS rsb, adv * scale AS advance
   FROM pth p JOIN scl USING (font_id)),
icv AS (SELECT cv.glyph_id, cv.font_id, seq, p0x * scale - lsb AS p0x, p0y * scale AS p0y, c1x * scale - lsb AS c1x, c1y * scale AS c1y, c2x * scale - lsb AS c2x, c2y * scale AS c2y, p3x * scale - lsb AS p3x, p3y * scale AS p3y
   FROM cv JOIN scl USING (font_id) JOIN imp USING (glyph_id))"""
