"""Small fixed dimensions: characters, sheets, styles.

Each is a literal relation of bounded size (at most a few hundred rows, whatever the corpus),
so joining with it by broadcast is always safe.
"""

from __future__ import annotations

import string
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
# Characters, glyph names, vertical zones, ink parts, derivations, sheets and styles that a
# result has to agree with. Zones: x, asc, desc, full, base, mid, high.
LOWER_ZONE = {
    "a": "x", "b": "asc", "c": "x", "d": "asc", "e": "x", "f": "full", "g": "desc",
    "h": "asc", "i": "asc", "j": "full", "k": "asc", "l": "asc", "m": "x", "n": "x",
    "o": "x", "p": "desc", "q": "desc", "r": "x", "s": "x", "t": "asc", "u": "x",
    "v": "x", "w": "x", "x": "x", "y": "desc", "z": "x",
}
DIGIT_NAMES = "zero one two three four five six seven eight nine".split()
# char  name  zone  parts  group
OTHER_CHARS = """
. period base 1 punct
, comma base 1 punct
: colon x 2 punct
; semicolon desc 2 punct
! exclam asc 2 punct
? question asc 2 punct
' quotesingle high 1 punct
" quotedbl high 2 punct
( parenleft full 1 punct
) parenright full 1 punct
[ bracketleft full 1 punct
] bracketright full 1 punct
{ braceleft full 1 punct
} braceright full 1 punct
- hyphen mid 1 punct
_ underscore base 1 punct
/ slash full 1 punct
\\ backslash full 1 punct
| bar full 1 punct
* asterisk high 1 punct
& ampersand asc 1 punct
# numbersign asc 1 symbol
% percent asc 3 symbol
@ at desc 1 symbol
$ dollar full 1 symbol
^ asciicircum high 1 symbol
~ asciitilde mid 1 symbol
€ Euro asc 1 symbol
£ sterling asc 1 symbol
¥ yen asc 1 symbol
¢ cent asc 1 symbol
© copyright asc 1 symbol
® registered asc 1 symbol
° degree high 1 symbol
+ plus mid 1 math
= equal mid 2 math
< less mid 1 math
> greater mid 1 math
× multiply mid 1 math
÷ divide mid 3 math
± plusminus mid 2 math
≠ notequal mid 1 math
≤ lessequal mid 2 math
≥ greaterequal mid 2 math
∞ infinity mid 1 math
√ radical full 1 math
→ arrowright mid 1 arrow
← arrowleft mid 1 arrow
↑ arrowup mid 1 arrow
↓ arrowdown mid 1 arrow
"""
# char  name  zone  source glyph  operation  factor-or-count  gap
DERIVED = """
’ quoteright high quotesingle copy 0 0
‘ quoteleft high quotesingle mirror 0 0
” quotedblright high quotedbl copy 0 0
“ quotedblleft high quotedbl mirror 0 0
… ellipsis base period repeat 3 0.55
– endash mid hyphen stretch 1.7 0
— emdash mid hyphen stretch 2.6 0
− minus mid hyphen stretch 1.25 0
"""
LIGATURES = "th he in er an re on ed st ll oo ee ff tt ss ch fi fl".split()
ROW_LENGTH = 13
LIGATURE_ROW_LENGTH = 6
# sheet id, tier, characters in writing order
SHEETS = [
    ("lower-1", "essential", "abcdefghijklm"),
    ("lower-2", "essential", "nopqrstuvwxyz"),
    ("marks", "essential", ".,'-?!"),
    ("caps-1", "recommended", "ABCDEFGHIJKLM"),
    ("caps-2", "recommended", "NOPQRSTUVWXYZ"),
    ("digits", "recommended", "0123456789"),
    ("punct-pairs", "recommended", "()[]{}\":;"),
    ("punct-lines", "recommended", "/\\|_*&"),
    ("symbols", "extra", "#%@$^~"),
    ("currency", "extra", "€£¥¢"),
    ("legal-marks", "extra", "©®°"),
    ("maths-1", "extra", "+=<>×÷"),
    ("maths-2", "extra", "±≠≤≥∞√"),
    ("arrows", "extra", "→←↑↓"),
]
# name, bold factor, slant factor, weight class, selection bits, italic
STYLES = [
    ("Regular", 0, 0, 400, 0x40, False),
    ("Bold", 1, 0, 700, 0x20, False),
    ("Italic", 0, 1, 400, 0x01, True),
    ("Bold Italic", 1, 1, 700, 0x21, True),
]
# Marks that are small by nature and so are never reported as faint.
SMALL_MARKS = [".", ",", "'", '"', ":", ";", "-", "`", "°", "_"]
UNITS_PER_EM = 1000
TARGET_X = 500
# ----------------------------------------------------------------------------------------


def _zone_of_letters(seq: str) -> str:
    zones = {LOWER_ZONE.get(c, "x") for c in seq}
    tall, low = bool(zones & {"asc", "full"}), bool(zones & {"desc", "full"})
    return {(True, True): "full", (True, False): "asc", (False, True): "desc"}.get((tall, low), "x")


@lru_cache
def charset_rows() -> list[tuple]:
    """(ord, ch, name, zone, unicode, parts, grp, kind); kind: required, derived, ligature."""
    rows = []
    for c in string.ascii_uppercase:
        rows.append((c, c, "full" if c == "Q" else "asc", ord(c), 1, "upper", "required"))
    for c, z in LOWER_ZONE.items():
        rows.append((c, c, z, ord(c), 2 if c in "ij" else 1, "lower", "required"))
    for i, n in enumerate(DIGIT_NAMES):
        rows.append((str(i), n, "asc", ord(str(i)), 1, "digit", "required"))
    for line in OTHER_CHARS.strip().splitlines():
        c, n, z, p, g = line.split(" ")
        rows.append((c, n, z, ord(c), int(p), g, "required"))
    for line in DERIVED.strip().splitlines():
        c, n, z = line.split(" ")[:3]
        rows.append((c, n, z, ord(c), 1, "derived", "derived"))
    for s in LIGATURES:
        rows.append((s, "_".join(s), _zone_of_letters(s), None, 1, "ligature", "ligature"))
    return [(i, *r) for i, r in enumerate(rows)]


@lru_cache
def sheet_rows() -> list[tuple]:
    """(sheet_no, sheet_id, tier, rw, col, k, ch): one row per cell; k is the writing order."""
    out, k = [], 0
    for no, (sid, tier, chars) in enumerate(SHEETS):
        for i, c in enumerate(chars):
            out.append((no, sid, tier, i // ROW_LENGTH, i % ROW_LENGTH, k, c))
            k += 1
    for i, s in enumerate(LIGATURES):
        out.append((len(SHEETS), "ligatures", "extra", i // LIGATURE_ROW_LENGTH,
                    i % LIGATURE_ROW_LENGTH, k, s))
        k += 1
    return out


@lru_cache
def derived_rows() -> list[tuple]:
    """(name, ch, src, op, amount, gap, ord)"""
    out = []
    for i, line in enumerate(DERIVED.strip().splitlines()):
        c, n, _, src, op, amount, gap = line.split(" ")
        out.append((n, c, src, op, float(amount), float(gap), i))
    return out


def _lit(v, duck: bool = False) -> str:
    if v is None:
        return "CAST(NULL AS INT)"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, str):
        body = v.replace("'", "''") if duck else v.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{body}'"
    return str(v)


def values_sql(rows, cols: str, duck: bool = False) -> str:
    """A literal relation as SQL text, for Spark or for DuckDB."""
    body = ", ".join("(" + ", ".join(_lit(v, duck) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({cols})"


CHARSET_COLS = "ord, ch, name, zone, unicode, parts, grp, kind"
SHEET_COLS = "sheet_no, sheet_id, tier, rw, col, k, ch"
STYLE_COLS = "style, bold, lean, weight_class, fs_selection, italic"
DERIVED_COLS = "name, ch, src, op, amount, gap, ord"


def _dim(spark: SparkSession, sql: str) -> DataFrame:
    """A dimension: a literal table of some hundred rows at most."""
    return F.broadcast(spark.sql(sql))


def charset(spark: SparkSession) -> DataFrame:
    return _dim(spark, values_sql(charset_rows(), CHARSET_COLS))


def required(spark: SparkSession) -> DataFrame:
    rows = [r for r in charset_rows() if r[-1] == "required"]
    return _dim(spark, values_sql(rows, CHARSET_COLS))


def sheets(spark: SparkSession, ligatures: bool = True) -> DataFrame:
    rows = [r for r in sheet_rows() if ligatures or r[1] != "ligatures"]
    return _dim(spark, values_sql(rows, SHEET_COLS))


def styles(spark: SparkSession) -> DataFrame:
    return _dim(spark, values_sql(STYLES, STYLE_COLS))


def derived(spark: SparkSession) -> DataFrame:
    return _dim(spark, values_sql(derived_rows(), DERIVED_COLS))
