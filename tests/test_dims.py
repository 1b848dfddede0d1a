from quillwork.functions import dims
from quillwork.operators import segment as G


def test_inventory_counts():
    rows = dims.charset_rows()
    kinds = [r[-1] for r in rows]
    assert kinds.count("required") == 112 and kinds.count("derived") == 8 and kinds.count("ligature") == 18
    assert len({r[1] for r in rows}) == len(rows)


def test_every_required_character_is_laid_out_once():
    laid = [r[-1] for r in dims.sheet_rows() if r[1] != "ligatures"]
    need = [r[1] for r in dims.charset_rows() if r[-1] == "required"]
    assert sorted(laid) == sorted(need)
    assert [r[5] for r in dims.sheet_rows()] == list(range(len(dims.sheet_rows())))


def test_ligature_zones():
    zone = {r[1]: r[3] for r in dims.charset_rows()}
    assert zone["th"] == "asc" and zone["on"] == "x" and zone["fi"] == "full"


def test_joined_pairs_come_in_rows_of_six(spark):
    rows = {(r.sheet_no, r.rw): r.want for r in G.sheet_rows(spark).collect()}
    assert [rows[14, k] for k in range(3)] == [6, 6, 6]
