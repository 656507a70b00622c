"""Table structure, layout, claims and decisions on small cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from brightvein.functions import layout as L
from brightvein.functions import text as X
from brightvein.operators import evidence, tables

GRID = [
    ["(Rs in crore)", "", ""],
    ["", "Year ended", None],
    ["", "2025", "2024"],
    ["Assets", "", ""],
    ["Deposits (a)", "10", "(9)"],
    ["Of which term", "4", "3"],
    ["Total", "14", ""],
]
INDENTS = {4: 10.0, 5: 20.0, 6: 10.0}


@pytest.fixture(scope="module")
def derived(spark):
    cells = [(1, r, c, x or "", x is not None, INDENTS.get(r) if c == 0 else None) for r, row in enumerate(GRID) for c, x in enumerate(row)]
    got = tables.derive(spark.createDataFrame(cells, "table_id int, r int, c int, text string, present boolean, text_left double"))
    return {(x["r"], x["c"]): x for x in got.collect()}


def test_header_spans_both_columns(derived):
    assert derived[4, 1]["header_path"] == ["Year ended", "2025"]
    assert derived[4, 2]["header_path"] == ["Year ended", "2024"]
    assert derived[1, 1]["column_span"] == 2 and derived[1, 2]["column_span"] is None


def test_labels_nest_by_indent_under_their_section(derived):
    assert derived[5, 1]["row_label_path"] == ["Assets", "Deposits", "Of which term"]
    assert derived[6, 1]["row_label_path"] == ["Assets", "Total"]


def test_units_markers_and_totals(derived):
    assert derived[4, 1]["units"] == "(Rs in crore)" and derived[2, 1]["units"] is None
    assert derived[4, 0]["footnote"] == "a" and derived[4, 2]["footnote"] is None
    assert derived[6, 2]["is_total"] and not derived[5, 2]["is_total"]


@pytest.mark.parametrize("text,numeric,units,marker", [("(1,234)", True, False, None), ("12 %", True, False, None), ("Rs in crore", False, True, None), ("1 crore", False, False, None), ("Shares (RSU)", False, False, None), ("Cash (ii)", False, False, "ii"), ("Cash **", False, False, "**"), ("(45)", True, False, None), ("", False, False, None)])
def test_cell_predicates(spark, text, numeric, units, marker):
    x = F.lit(text)
    got = spark.range(1).select(X.looks_numeric(x).alias("n"), X.states_units(x).alias("u"), X.footnote_marker(x).alias("m")).first()
    assert tuple(got) == (numeric, units, marker)


def test_name_uuid(spark):
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    names = ["", "a", "chunk:model:1", "ü"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", L.name_uuid(space, F.col("n")).alias("u")).collect()
    assert {r["n"]: r["u"] for r in got} == {n: str(uuid.uuid5(space, n)) for n in names}


def test_page_labels(spark):
    got = spark.range(1).select(*(L.page_label(F.array(*map(F.lit, p)).cast("array<int>")) for p in ([3], [5, 3], []))).first()
    assert list(got) == ["Page: 3", "Pages: 3-5", None]


def test_claims_and_decisions(spark):
    claims = spark.createDataFrame([(1, 0, "It earned 12 million USD"), (1, 1, "It lost 7"), (2, 0, "Sales were 5"), (3, 0, "Nothing cited")], "answer_id int, claim int, text string")
    cited = spark.createDataFrame([(1, 0, 0, "p"), (1, 1, 0, "p"), (1, 1, 1, "x"), (2, 0, 0, "p"), (2, 0, 1, "q")], "answer_id int, claim int, position int, passage_id string")
    passages = spark.createDataFrame([("p", "USD 12 million, 5", "A", "2024", None), ("q", "5 again", "B", "2024", None), ("e", "", "B", None, None)], "passage_id string, span string, issuer string, period string, basis string")
    checked = evidence.findings(claims, cited, passages)
    codes = {(r["answer_id"], r["claim"]): [f["code"] for f in r["findings"]] for r in checked.collect()}
    assert codes == {(1, 0): [], (1, 1): ["citation_not_in_evidence", "unsupported_numeral"], (2, 0): ["mixed_issuer"], (3, 0): ["no_citation"]}
    answers = spark.createDataFrame([(1, True, []), (2, True, []), (3, False, ["dense"])], "answer_id int, answerable boolean, degraded array<string>")
    got = {r["answer_id"]: (r["decision"], r["support_band"], r["reason_codes"]) for r in evidence.decide(checked, answers).collect()}
    assert got[1] == ("partial", "weak", ["citation_not_in_evidence", "unsupported_numeral"])
    assert got[2] == ("answered", "moderate", ["mixed_issuer"])
    assert got[3] == ("abstained", "none", ["model_reported_unanswerable", "no_claim_survived_validation", "no_citation"])
