"""The rule-driven engine, ambiguity candidates and the export package against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalize, similarity
from ledgerloom.operators import export, profile, rules, summary, waterfall, wide
from test_matching import DAY, ledger


def random_ledgers(seed, n=60):
    r = random.Random(seed)
    docs = ["INV-001", "INV/1", "BILL:77", "77", "0077X", "ABC-9", "ABC 9", "abc9", ""]
    row = lambda: {"vendor": r.choice(("A", "B", "")), "doc": r.choice(docs), "taxable": r.choice((100, 105, 109, 149, 300)), "d": r.choice((DAY, DAY + dt.timedelta(20), DAY + dt.timedelta(44), None)), "igst": r.choice((0, 18))}
    return [row() for _ in range(n)], [row() for _ in range(n)]


def chained(text):
    """The document rule's normalisers, step by step."""
    import re

    text = " ".join(text.split()).upper()
    text = re.sub(r"^((INV|BILL|TAX|GST|REF|DN|CN)[-_ /:]*)+", "", text)
    return (re.sub("[^A-Za-z0-9]", "", text).lstrip("0") or "0").strip()


def passes_brute(g, p):
    vendor = lambda x: x["vendor"].strip().upper()
    gap = lambda a, b: abs((a["d"] - b["d"]).days) if a["d"] and b["d"] else 0
    doc = lambda x: chained(x["doc"])
    money = lambda a, b: abs(a["taxable"] - b["taxable"])
    free_g, free_p, out, hold = dict(enumerate(g)), dict(enumerate(p)), set(), {}

    def block(a, key):
        return [j for j, b in free_p.items() if vendor(a) and vendor(a) == vendor(b) and key(a) and key(a) == key(b)]

    for i, a in enumerate(g):
        for j in block(a, doc):
            b = free_p[j]
            if money(a, b) <= 0.05 and a["d"] and a["d"] == b["d"]:
                out.add((i, j, 1))
                del free_g[i], free_p[j]
                break
    raw = lambda x: " ".join(x["doc"].upper().split())
    for i, a in list(free_g.items()):
        ok = [j for j in block(a, doc) or block(a, raw) if money(a, free_p[j]) <= 10.001 and gap(a, free_p[j]) <= 30]
        if len(ok) == 1:
            out.add((i, ok[0], 2))
            del free_g[i], free_p[ok[0]]
        elif ok:
            hold[i] = ok
    for i, a in list(free_g.items()):
        if i in hold:
            continue
        x = doc(a)
        ok = [j for j, b in free_p.items() if vendor(a) == vendor(b) and money(a, b) <= 50 and gap(a, b) <= 45 and (x == (y := doc(b)) or len(x) >= 3 and x in y or len(y) >= 3 and y in x or similarity.guarded(x, y) >= 0.85)]
        if len(ok) == 1:
            out.add((i, ok[0], 3))
            del free_g[i], free_p[ok[0]]
        elif ok:
            hold[i] = ok
    for i, a in free_g.items():
        mine = [j for j, b in free_p.items() if vendor(a) == vendor(b)]
        cand = hold.get(i) or (sorted(mine, key=lambda j: money(a, p[j]))[:3] if len(mine) >= 2 else [])
        cand = [j for j in cand if j in free_p]
        out |= {(i, j, 4) for j in cand} if len(cand) >= 2 else {(i, None, 5)}
    return out | {(None, j, 5) for j in free_p}


@pytest.mark.parametrize("seed", [1, 2])
def test_four_passes(spark, seed):
    g, p = random_ledgers(seed)
    got = rules.four_passes(ledger(spark, g), ledger(spark, p, "P")).collect()
    assert {(x.g_idx, x.p_idx, x["pass"]) for x in got} == passes_brute(g, p)
    for i in {x.g_idx for x in got if x["pass"] == 4}:
        scores = [x.score for x in sorted((x for x in got if x.g_idx == i), key=lambda x: x["rank"])]
        assert scores == sorted(scores, reverse=True) and 0 <= scores[-1] and scores[0] <= 100


def test_simulate_and_yields(spark):
    g, p = random_ledgers(3)
    gl, pl = ledger(spark, g), ledger(spark, p, "P")
    for chosen in (rules.DEFAULT, (rules.AMOUNT, rules.DAY), (rules.Rule("type", "doc_type", "guard"), rules.DAY)):
        free, want = dict(enumerate(p)), set()
        for i, a in enumerate(g):
            for j, b in free.items():
                text = rules.DOC not in chosen or a["vendor"].upper() == b["vendor"].upper() != "" and chained(a["doc"]) == chained(b["doc"])
                if text and (rules.AMOUNT not in chosen or abs(a["taxable"] - b["taxable"]) <= 10) and a["d"] and b["d"] and abs((a["d"] - b["d"]).days) <= 30:
                    want.add((i, j))
                    del free[j]
                    break
        assert set(map(tuple, rules.simulate(gl, pl, chosen).collect())) == want
    with pytest.raises(ValueError):
        rules.simulate(gl, pl, (rules.Rule("share", "taxable", "number", 5.0, percent=True),))
    for rule, key in ((rules.AMOUNT, lambda x: x["taxable"]), (rules.DAY, lambda x: x["d"] and x["d"].toordinal())):
        a, b, n = sorted(key(x) for x in g if key(x) is not None), sorted(key(x) for x in p if key(x) is not None), 0
        while a and b:
            if b[0] < a[0] - rule.tolerance:
                b.pop(0)
            elif b[0] <= a[0] + rule.tolerance:
                a.pop(0), b.pop(0)
                n += 1
            else:
                a.pop(0)
        assert rules.rule_yield(gl, pl, rule).collect()[0].pairs == n
    assert normalize.in_days(2, "MONTHS") == 60


def test_normaliser_chain(spark):
    texts = ["INV:12", " 0012.0 ", "inv- bill/007", "   ", "", "000", "A  b\tc", "GST-", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(normalize.chain(F.col("c"), list(rules.FULL))).collect()]
    assert got == ["12", "12", "7", "0", "0", "0", "ABC", "0", None]
    plain = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(normalize.chain(F.col("c"), list(rules.PLAIN))).collect()]
    assert plain == ["INV:12", "0012", "INV- BILL/007", None, None, "000", "A B C", "GST-", None]
    within = spark.range(1).select(normalize.within(F.lit(200.0), F.lit(210.0), 5.0, percent=True), normalize.within(F.lit(200.0), F.lit(210.1), 5.0, percent=True), normalize.within(F.lit(1.0), F.lit(2.0), 1.0)).first()
    assert tuple(within) == (True, False, True)


def test_clusters_rank_and_take_the_first(spark):
    g = ledger(spark, [{"vendor": "C", "doc": "MMMM1", "taxable": 1000}, {"vendor": "C", "doc": "MMMM2", "taxable": 1000}])
    p = ledger(spark, [{"vendor": "C", "doc": f"N{i}", "taxable": 1000 + i} for i in range(6)], "P")
    got = waterfall.ambiguity_clusters(waterfall.prepare(g), waterfall.prepare(p), waterfall.Limits()).collect()
    assert [(x.g_idx, x.p_idx, x["rank"], x["of"]) for x in got] == [(0, j, j + 1, 6) for j in range(4)] + [(1, j + 1, j + 1, 5) for j in range(4)]
    assert got[0].amount == 100.0 and got[1].amount == 96.0
    share = waterfall.batch_pass(waterfall.prepare(ledger(spark, [{"doc": "X1", "taxable": 1000}, {"doc": "X2", "taxable": 497}])), waterfall.prepare(ledger(spark, [{"doc": "Y", "taxable": 1500}], "P")), waterfall.Limits())
    assert sorted(x.share for x in share.collect()) == [33.1, 66.7]


def wide_rows(spark, rows):
    """(row_idx, g_vendor, p_vendor, g_doc, p_doc, g_date, p_date, g_taxable, p_taxable)"""
    full = [(*r, r[7] * 0.18, r[8] * 0.18, r[7] * 0.18, r[8] * 0.18) for r in rows]
    return spark.createDataFrame(full, "row_idx long, g_vendor string, p_vendor string, g_doc string, p_doc string, g_date date, p_date date, g_taxable double, p_taxable double, g_igst double, p_igst double, g_tax double, p_tax double")


def test_missing_dates_and_bank_vouchers(spark):
    rows = [(1, "V", "V", "D", "D", None, None, 10.0, 10.0), (2, "V", "V", "D", "D", DAY, None, 10.0, 10.0), (3, "V", "V", "Q7", "BANK CHG", DAY, DAY, 90.0, 500.0), (4, None, None, None, None, None, None, 0.0, 0.0)]
    got = {r.row_idx: (r.verdict, r.tier) for r in wide.verdicts(wide_rows(spark, rows)).collect()}
    assert got == {1: ("Exact Match", 1), 2: ("Near Match", 3), 3: ("Consolidated Match", 4), 4: ("Ambiguous", 5)}


def test_candidates(spark):
    r = random.Random(5)
    rows = [(i, "V", "V", f"G{i:04d}", f"P{r.randrange(9999):04d}", DAY, DAY + dt.timedelta(r.choice((0, 5, 20, 50, 90))), float(r.choice((100, 250, 900))), float(r.choice((100, 103, 400, 2000)))) for i in range(1, 30)]
    rows += [(50, "W", "U", "SAME", "OTHER", DAY, DAY, 5.0, 700.0), (51, None, "X", None, "SAME", None, DAY, 0.0, 6.0), (52, None, "Y", None, "SAME", None, DAY, 0.0, 7.0)]
    table = wide.verdicts(wide_rows(spark, rows))
    verdict = {x.row_idx: (x.verdict, x.days, x.g_core, x.p_core, x.p_doc, x.g_doc) for x in table.collect()}
    want = {}
    for i, gv, _, _, _, _, _, ga, _ in rows:
        v, _, core, _, _, gd = verdict[i]
        if v != "Ambiguous":
            continue
        pool = [(j, pa) for j, _, pv, _, _, _, _, _, pa in rows if pv == gv]
        near = sorted(pool, key=lambda x: abs(x[1] - ga))[:4]
        same = [j for j, *_ in rows if verdict[j][3] == core and core][:3]
        found = []
        for j in {i, *(j for j, _ in near), *same}:
            pa, days = next(x[8] for x in rows if x[0] == j), verdict[j][1]
            alike = round(max(similarity.guarded(gd, verdict[j][4]), similarity.guarded(core, verdict[j][3])) * 100, 1)
            fit = lambda a, b: round(max(0.0, 100 - abs(a - b) / max(a, b, 1.0) * 100), 1)
            date = 95 if days == 0 else 88 if days <= 7 else 75 if days <= 30 else 60 if days <= 60 else 40
            found.append((-round(alike * 0.4 + fit(ga, pa) * 0.3 + fit(ga * 0.18, pa * 0.18) * 0.15 + date * 0.15, 1), j))
        if len(found) >= 2:
            want[i] = sorted(found)[:3]
    got = {}
    for x in sorted(wide.candidates(table).collect(), key=lambda x: (x.row_idx, x["rank"])):
        got.setdefault(x.row_idx, []).append((-x.score, x.p_idx))
    assert got.keys() == want.keys() and got
    for i in want:
        assert all(abs(a[0] - b[0]) <= 0.11 for a, b in zip(got[i], want[i]))
    assert {j for _, j in got[50]} >= {51, 52} or len(want[50]) == 3
    assert sum(x.n for x in summary.triage(wide.candidates(table)).collect()) == len(want)


def test_export_and_profile(spark, tmp_path):
    g = ledger(spark, [{"doc": "A", "cgst": 9, "sgst": 9}, {"doc": "=B"}]).withColumn("Notes", F.lit("from G"))
    p = ledger(spark, [{"doc": "A", "taxable": 990}], "P").withColumn("Notes", F.lit("from P")).withColumn("CPPOS", F.lit("29"))
    links = spark.createDataFrame([(0, 0, "TOLERANCE_MATCHED"), (1, None, "GST_ONLY")], "g_idx long, p_idx long, status string")
    got = {r.g_idx: r for r in export.package(links, g, p).collect()}
    assert tuple(got[0].asDict())[2:] == export.PACKAGE and len(export.PACKAGE) == 57
    assert got[0].TaxableDifference == -10 and got[0].CPValue == 1000 + 180 + 18 and got[0].Notes == "from G" and got[0].CPPOS == "29"
    assert got[1].PRValue is None and got[1].ValueDifference is None and got[1].CPDocumentNumber == "'=B" and got[1].ReconciliationSection == "GST Only"
    flagged = export.flags(g, {"is_b": ("doc", "CONTAINS", "b"), "big": ("taxable", "BETWEEN", (1, 5)), "none": ("doc", "IS_EMPTY", None)}).collect()
    assert [(r.is_b, r.big, r.none) for r in flagged] == [(False, False, False), (True, False, False)]
    export.write_delimited(g, str(tmp_path / "csv"), {"doc": "Document"}, ";")
    from ledgerloom.sources.tables import read_text

    assert sorted(r.doc for r in read_text(spark, str(tmp_path / "csv"), {"Document": "doc"}, ";").collect()) == ["=B", "A"]
    export.write_json(g.select("doc"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    got = profile.profile(spark.createDataFrame([("9",), ("10",), ("-5",), (None,)], "n string")).first()
    assert (got.lowest, got.highest, got.non_null, got.null_percent, got.numeric_share) == ("-5", "10", 3, 25.0, 1.0)


def test_resolve(spark):
    rows = [("INV-1", "INV1", 10.0, 10.0, DAY, DAY, True), ("INV-1", "INV-1", 10.0, 19.0, DAY, DAY + dt.timedelta(30), True), ("A", "B", 10.0, 10.0, DAY, DAY, True), ("A", "A", 1.0, 1.0, DAY, DAY, False)]
    got = rules.resolve(spark.createDataFrame(rows, "g_doc string, p_doc string, g_taxable double, p_taxable double, g_date date, p_date date, accepted boolean")).collect()
    assert [r.bucket for r in got] == ["EXACT_MATCH", "TOLERANCE_MATCH", "NEAR_MATCH", "GSTR_ONLY"]
