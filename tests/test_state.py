"""Versioned tables, governed rules, kept-up sums, decided outcomes and the gate on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import export, governance, summary
from ledgerloom.sources import versions

LINKS = versions.LINKS


def test_merges_keep_links_one_to_one(spark, tmp_path):
    at = str(tmp_path / "links")
    merge = lambda rows, token: sorted(map(tuple, versions.merge_links(spark, at, spark.createDataFrame(rows, LINKS), token).collect()), key=str)
    now = lambda: {r.g_idx: r.p_idx for r in versions.latest(spark, at, LINKS, "g_idx").collect()}
    assert versions.latest(spark, at, LINKS, "g_idx").count() == 0
    assert merge([(1, 10), (2, 20), (3, 20), (4, 40), (4, 41), (5, None)], "a") == [(3, 20, "P_ASKED_TWICE"), (4, 41, "G_ASKED_TWICE")]
    assert now() == {1: 10, 2: 20, 4: 40, 5: None}
    assert merge([(1, None), (6, 10), (7, 40), (2, 20), (8, 80)], "b") == [(6, 10, "P_HELD"), (7, 40, "P_HELD")]
    assert merge([(6, 10)], "c") == []  # released in the version before
    before = now()
    assert before == {1: None, 2: 20, 4: 40, 5: None, 6: 10, 8: 80}
    state = versions.manifest(spark, at).collect()
    merge([(9, 90)], "c")  # a known token: nothing happens
    assert now() == before and versions.manifest(spark, at).collect() == state and versions.last_version(spark, at) == 3
    spark.createDataFrame([(9, 99)], LINKS).write.parquet(f"{at}/rows/version=4")  # a broken writer left this
    assert now() == before
    merge([(9, 90)], "d")
    assert now() == before | {9: 90}
    merge([(9, None)], "e")
    merge([(9, 90)], "f")
    exports = spark.createDataFrame([(i, i) for i in range(1, 8)], "export_id long, version long")
    assert {r.export_id: r.stale for r in versions.stale(exports, spark, at).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True}  # 4 and 6 have the same links


def test_requests_fold(spark):
    day = dt.date(2024, 1, 1)
    said = ["approve", "draft", "draft", "activate", "approve!", "approve", "approve", "activate!", "activate", "disable", "disable", "new_version", "approve", "activate", "new_version", "disable", "approve", "activate", "fly"]
    rows = [("R", day + dt.timedelta(i // 2), i, x.rstrip("!"), x.endswith("!")) for i, x in enumerate(said)] + [("SAFE-D001", day, 0, "draft", False), (None, day, 0, "draft", False)]
    rows += [("S", day, i, x, False) for i, x in enumerate(("draft", "approve", "activate", "new_version", "approve", "activate"))]
    changes = governance.transitions(spark.createDataFrame(rows, "rule_id string, asked_on date, seq long, request string, blocked boolean"))
    got = [(r.version, r.status, r.refused) for r in changes.where("rule_id = 'R'").orderBy("seq").collect()]
    assert got == [
        (None, None, "NO_SUCH_RULE"), (1, "DRAFT", None), (1, None, "ALREADY_DRAFTED"), (1, None, "NOT_APPROVED"), (1, None, "BLOCKED_BY_CONFLICTS"), (1, "APPROVED", None), (1, None, "NOT_A_DRAFT"), (1, None, "BLOCKED_BY_CONFLICTS"), (1, "ACTIVE", None), (1, "DISABLED", None),
        (1, None, "NOT_ACTIVE"), (2, "DRAFT", None), (2, "APPROVED", None), (2, "ACTIVE", None), (3, "DRAFT", None), (2, "DISABLED", None), (3, "APPROVED", None), (3, "ACTIVE", None), (3, None, "UNKNOWN_REQUEST"),
    ]
    assert [r.refused for r in changes.where("rule_id = 'SAFE-D001'").collect()] == ["LOCKED_GUARDRAIL"]
    assert {(r.version, r.status) for r in changes.where("rule_id = 'S' AND seq = 5").collect()} == {(1, "SUPERSEDED"), (2, "ACTIVE")}
    spans = governance.intervals(changes)
    assert {(r.rule_id, r.version, r.status) for r in spans.where("last").collect()} == {("R", 1, "DISABLED"), ("R", 2, "DISABLED"), ("R", 3, "ACTIVE"), ("S", 1, "SUPERSEDED"), ("S", 2, "ACTIVE")}
    seen = [("c", day + dt.timedelta(n), True, n % 2 == 0) for n in (3, 4, 5, 6, 7, 8, 20)] + [("other", day, True, True), ("c", dt.date(2000, 1, 1), True, True)]
    rules = spark.createDataFrame([("R", 1, "gstin", "EXACT"), ("R", 2, "document_number", "NORMALIZED_EXACT"), ("R", 3, "document_number", "CONTAINS")], "rule_id string, version int, field string, operator string")
    done = governance.executions(spark.createDataFrame(seen, "client string, seen_on date, vendor_equal boolean, document_equal boolean"), spans.where("rule_id = 'R'").withColumn("client", F.lit("c")), rules)
    assert {(r.version, r.evaluated, r.affected, r.automatic) for r in done.collect()} == {(1, 0, 0, 0), (2, 1, 1, 0), (3, 2, 2, 0)}


def test_sums_are_kept_up(spark):
    rows = spark.createDataFrame([(i, "AB"[i % 2], 1.25 * i, 2.0, 0.1 * i, 0.2) for i in range(40)], "row_idx long, verdict string, g_taxable double, p_taxable double, g_tax double, p_tax double")
    sums = summary.totalled(summary.contributions(rows, ["verdict"]), ["verdict"])
    changed, gone = F.col("row_idx") % 5 == 0, F.col("row_idx") % 5 == 1
    after = rows.where(~gone).withColumn("verdict", F.when(changed, "C").otherwise(F.col("verdict")))
    got = summary.kept_up(sums, rows.where(changed | gone), after.where(changed), ["verdict"])
    want = summary.totalled(summary.contributions(after, ["verdict"]), ["verdict"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    everything = summary.kept_up(sums, rows, rows.limit(0), ["verdict"])
    assert everything.count() == 0


def test_gate_codes(spark):
    sessions = spark.createDataFrame([("ok", True, True, True, None), ("bad", False, False, False, 7), ("dup", True, True, True, 1)], "session string, mapping_confirmed boolean, policy_confirmed boolean, stages_done boolean, profile_id long")
    pending = spark.createDataFrame([("dup",), ("dup",), ("bad",)], "session string")
    links = spark.createDataFrame([("dup", 1, 10), ("dup", 1, 11), ("dup", 2, 11), ("ok", 1, 1)], "session string, g_idx long, p_idx long")
    profiles = spark.createDataFrame([(1,)], "profile_id long")
    got = {(r.session, r.code, r.n) for r in export.gate_codes(sessions, pending, links, profiles, []).collect()}
    assert got == {("bad", "mapping_not_confirmed", 1), ("bad", "policy_not_confirmed", 1), ("bad", "matching_incomplete", 1), ("bad", "profile_reference_invalid", 1), ("dup", "pending_match_decisions", 2), ("dup", "duplicate_consumption", 2)}
    assert export.gate_codes(sessions, pending, links, profiles, ["Reason"]).where("code = 'target_fields_missing'").count() == 3
