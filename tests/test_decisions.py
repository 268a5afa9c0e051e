"""Decisions against plain cases on small rows."""

import datetime as dt

import pytest

from ledgerloom.operators import decisions

CANDIDATES = "g_idx long, p_idx long, status string, reciprocal boolean"


def test_single_decisions(spark):
    open_, no = "NEAR_MATCH_PROPOSED", "MATERIAL_MISMATCH"
    candidates = spark.createDataFrame([(1, 10, open_, True), (2, 20, open_, False), (3, 30, open_, True), (4, 40, no, True), (5, 50, open_, True), (6, 50, open_, True), (7, 70, open_, True), (8, 80, open_, True)], CANDIDATES)
    consumed = spark.createDataFrame([(99, 30)], "g_idx long, p_idx long")
    choices = spark.createDataFrame([(1, 10, "approve"), (2, 20, "approve"), (3, 30, "approve"), (4, 40, "reject"), (5, 50, "approve"), (6, 50, "approve"), (7, 70, "reject")], "g_idx long, p_idx long, action string")
    got = {r.g_idx: (r.status, r.problem) for r in decisions.decided(candidates, consumed, choices).collect()}
    assert got == {
        1: ("NEAR_MATCH_APPROVED", None), 2: (open_, "NOT_ELIGIBLE"), 3: (open_, "CONSUMED"), 4: (no, "NOT_PENDING"), 5: ("NEAR_MATCH_APPROVED", None), 6: (open_, "CONSUMED"), 7: ("REJECTED_CANDIDATE", None), 8: (open_, None),
    }
    none = decisions.decided(candidates.limit(0), consumed, choices)
    assert none.count() == 0


def test_selection_problems(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12), (4, 13), (4, 14)], "g_idx long, p_idx long")
    consumed = spark.createDataFrame([(12,)], "p_idx long")
    choices = spark.createDataFrame([(1, 10), (2, 10), (3, 12), (4, 99), (9, 10)], "g_idx long, p_idx long").unionByName(spark.createDataFrame([(4, None)], "g_idx long, p_idx long"))
    got = {(r.g_idx, r.p_idx): r.problem for r in decisions.selected(pairs, consumed, choices).collect()}
    assert got == {(1, 10): None, (2, 10): "CONSUMED", (3, 12): "CONSUMED", (4, 99): "NOT_A_CANDIDATE", (4, None): "LEFT_UNRESOLVED", (9, 10): "NOT_AMBIGUOUS"}
    after = {(r.g_idx, r.p_idx): r.status for r in decisions.after_selection(pairs, decisions.selected(pairs, consumed, choices)).collect()}
    assert after[1, 10] == "NEAR_MATCH_APPROVED" and after[1, 11] == "REJECTED_CANDIDATE" and {after[2, 10], after[3, 12], after[4, 13]} == {"AMBIGUOUS"}


@pytest.mark.parametrize("yes, no, found", [(4, 0, False), (5, 0, True), (8, 2, True), (7, 2, False), (40, 0, True)])
def test_separator_pattern(spark, yes, no, found):
    rows = [(i, i, "NEAR_MATCH_APPROVED", True, True, False, f"A/{i}", f"A{i}") for i in range(yes)] + [(100 + i, i, "REJECTED_CANDIDATE", True, True, False, "x", "y") for i in range(no)] + [(200, 1, "NEAR_MATCH_APPROVED", False, True, False, "x", "y")]
    got = decisions.separator_pattern(spark.createDataFrame(rows, "g_idx long, p_idx long, status string, same_vendor boolean, norm_equal boolean, raw_equal boolean, g_doc string, p_doc string")).collect()
    assert len(got) == found
    if found:
        assert (got[0].observations, got[0].ratio) == (yes, round(yes / (yes + no), 4)) and got[0].evidence.split("|")[0] == "A/0 ↔ A0" and len(got[0].evidence.split("|")) == min(yes, 30)


def test_near_summary(spark):
    ids = lambda n: spark.range(n)
    near = spark.createDataFrame([(1, "NEAR_MATCH_PROPOSED"), (2, "NEAR_MATCH_APPROVED"), (3, "AMBIGUOUS"), (3, "AMBIGUOUS"), (4, "REJECTED_CANDIDATE")], "g_idx long, status string")
    got = decisions.near_summary(ids(20), ids(18), ids(7), ids(2), near).first().asDict()
    assert got == {"g_records": 20, "p_records": 18, "exact": 7, "tolerance": 2, "proposals": 1, "near": 1, "ambiguous": 1, "resolved": 10, "g_left": 10, "p_left": 8, "state": "AWAITING_NEAR_MATCH_APPROVAL"}
    assert decisions.near_summary(ids(0), ids(0), ids(0), ids(0), near.limit(0)).first().state == "COMPLETED"


def test_search_without_values(spark):
    """A row without candidate, date, amount or class against each predicate."""
    rows = spark.createDataFrame([("R1", "GST_ONLY", None, None, None, None)], "record_id string, status string, vendor string, gstin string, amount double, d date")
    candidates = spark.createDataFrame([], "record_id string, other_id string, score double, variance double")
    classes = spark.createDataFrame([], "record_id string, category string, confidence double, review_status string, needs_review boolean")
    base = decisions.exceptions(rows, candidates, classes)
    passes = {"statuses": ("GST_ONLY",), "amount_max": 0, "amount_min": 0, "variance_min": 5, "variance_max": 0, "score_min": 0.9, "score_max": 0.1, "record_id": "r"}
    fails = {"vendor": "v", "gstin": "v", "date_from": "2000-01-01", "date_to": "2030-01-01", "category": "x", "confidence_min": 0, "confidence_max": 1, "review_status": ("ai_proposed",), "needs_review": False, "amount_min": 1}
    for name, value in passes.items():
        assert decisions.search(base, decisions.Search(**{name: value})).count() == 1, name
    for name, value in fails.items():
        assert decisions.search(base, decisions.Search(**{name: value})).count() == 0, name
    assert decisions.search(base, decisions.Search(), offset=0, limit=1).count() == 1


def test_advice_of_blank_and_equal_rows(spark):
    day = dt.date(2024, 1, 1)
    schema = "row_idx long, g_vendor string, p_vendor string, g_doc string, p_doc string, g_date date, p_date date, g_taxable double, p_taxable double, g_igst double, p_igst double"
    rows = [(1, "V", "V", "A-1", "A-1", 100.0, 100.0), (2, "V", "V", "A-1", "A1", 100.0, 100.0), (3, "V", "V", "A-1", "A1", 100.0, 700.0), (4, "V", "V", "A", "B", 100.0, 105.0), (5, None, "V", None, "B", 0.0, 5.0), (6, "—", "V", "", "B", 0.0, 5.0), (7, "V", None, "A", "", 9.0, 0.0), (8, "V", "V", "A", "B", 100.0, 200.0), (9, None, None, None, None, 0.0, 0.0)]
    df = spark.createDataFrame([(i, a, b, c, d, day, day, x, y, 0.0, 0.0) for i, a, b, c, d, x, y in rows], schema)
    got = {r.row_idx: (r.recommended, r.confidence) for r in decisions.advice(df).collect()}
    assert got == {
        1: ("EXACT_MATCH", 98), 2: ("NEAR_MATCH", 94), 3: ("TOLERANCE_MATCH", 85), 4: ("TOLERANCE_MATCH", 91), 5: ("PR_ONLY", 96), 6: ("PR_ONLY", 96), 7: ("GSTR_ONLY", 96), 8: ("NEAR_MATCH", 72), 9: ("EXACT_MATCH", 98),
    }


def test_runs_without_durations(spark):
    schema = "client long, status string, duration_ms long, n_steps long, n_errors long, tokens long, cost double, itc double"
    got = decisions.run_stats(spark.createDataFrame([(1, "FAILED", 10, 2, 1, 7, 0.5, None), (1, "COMPLETED", 0, 3, 0, 8, None, 2e7)], schema)).first()
    assert (got.runs, got.success_rate, got.failed, got.mean_ms, got.steps, got.errors, got.crores, got.tokens, got.tokens_per_run, got.cost) == (2, 50.0, 1, None, 5, 1, 2.0, 15, 15.0, 0.5)
    assert decisions.run_stats(spark.createDataFrame([], schema)).first().runs == 0
