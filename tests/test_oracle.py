"""Registered queries against their DuckDB twins at the smallest scale."""

import math

import duckdb
import pytest

from quillwork import plans

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# one query of every module; the driver compares all of them
SAMPLE = ["solve_rows", "kerning", "health_score", "device_limit", "progress_eta", "text_width", "search_rank", "outbound_links",
          "sauvola", "components", "remove_rules", "page_skew", "merge_stacked", "trace_loops", "smooth_contour", "embolden",
          "derived_glyphs", "style_boxes", "svg_path"]


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", SAMPLE)
def test_same_table(spark, sf, duck, key):
    df = plans.QUERIES[key](spark, sf)
    rel = duck.sql(plans.ORACLES[key])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    key_of = lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    ours = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=key_of)
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(canon(r[i]) for i in at) for r in rel.fetchall()), key=key_of)
    assert len(ours) == len(theirs) and ours == theirs


def test_every_query_has_a_name_and_most_have_a_twin():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert len(plans.ORACLES) > 100
