"""What the waterfall's passes cost: rows are dealt by block once, sums and likenesses are looked at only where they can decide."""

import random
from itertools import combinations

import pytest

from ledgerloom.functions.similarity import guarded
from ledgerloom.operators import waterfall
from test_matching import ledger


def test_exact_pass_deals_rows_by_block_once(spark):
    row = lambda k: {"vendor": f"V{k % 5}", "doc": f"D{k}", "taxable": 100 + k}
    links = waterfall.exact_pass(*(waterfall.prepare(ledger(spark, [row(k) for k in range(20)], side)) for side in "GP"))
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and links.count() == 20


def test_a_block_goes_to_the_first_case_then_to_the_first_row(spark):
    """Tax heads come after all other cases, though their row stands first; blocks with two P rows or no key stay."""
    money = lambda **x: {"vendor": "V", "doc": "A1", "taxable": 1000, "igst": 180, "cgst": 0, "sgst": 0} | x
    g = [money(igst=0, cgst=90, sgst=90), money(taxable=1004), money(taxable=1003), money(doc="B2", taxable=7), money(vendor="", doc="", taxable=9)]
    p = [money(), money(doc="B2", taxable=8), money(doc="B2", taxable=9), money(vendor="", doc="", taxable=9)]
    gl, pl = waterfall.prepare(ledger(spark, g)), waterfall.prepare(ledger(spark, p, "P"))
    t = waterfall.Limits()
    rows = waterfall.in_blocks(waterfall.together(gl, pl), [waterfall.one_to_one_case(t), waterfall.tax_head_case(t)])
    ids = [[x.row_idx for x in df.orderBy("row_idx").collect()] for df in (gl, pl)]
    assert [tuple(x) for x in waterfall.linked(rows).select("g_idx", "p_idx", "sub").collect()] == [(ids[0][1], ids[1][0], "COMMERCIAL_TOLERANCE")]
    left = [sorted(x.row_idx for x in df.collect()) for df in waterfall.unlinked(rows)]
    assert left == [[i for i in ids[0] if i != ids[0][1]], ids[1][1:]]


def plain(rows, p, tol):
    """many_to_one() as it reads: every sum by itself."""
    fits = lambda found: len(found) >= 2 and abs(sum(r[2] for r in found) - p[2]) <= tol
    able = [r for r in rows if 0 < r[2] <= p[2] + tol]
    if len(able) < 2:
        return None
    for found in (able, [r for r in able if p[1] and (p[1] in r[1] or r[1] in p[1] or guarded(r[1], p[1]) >= 0.6)]):
        if fits(found):
            return found
    few = sorted(able, key=lambda r: abs(r[2] - p[2] / 2.5))[:8] if len(able) > 8 else able
    return next((list(c) for k in range(2, min(len(few), 5) + 1) for c in combinations(few, k) if fits(c)), None)


@pytest.mark.parametrize("seed", range(4))
def test_sums_are_those_added_one_by_one(seed):
    """Amounts of cents, so that many sums lie on the border of what is allowed."""
    r, hits = random.Random(seed), 0
    for _ in range(400):
        rows = [(i, "INV" + "".join(r.choices("0123", k=4)), r.randrange(1, 4000) / 10) for i in range(r.randrange(1, 14))]
        p = (99, "INV" + "".join(r.choices("0123", k=4)), r.randrange(1, 12000) / 10)
        want = plain(rows, p, 5.0)
        assert waterfall.many_to_one(waterfall.Pool(rows), p, 5.0) == want
        hits += want is not None
    assert 50 < hits < 400


def test_rows_that_are_too_few_are_not_compared():
    asked = []
    pool = waterfall.Pool([(1, "A", 10.0), (2, "B", 20.0)])
    assert pool.fitting(2, 100.0, 5.0, lambda doc: bool(asked.append(doc))) is None and not asked


def test_sums_that_cannot_be_reached_compare_no_documents(monkeypatch):
    monkeypatch.setattr(waterfall, "guarded", None)
    rows = [(i, f"D{i}", 100.0 + 40 * i) for i in range(8)]
    assert waterfall.many_to_one(waterfall.Pool(rows), (99, "E1", 261.0), 5.0) is None
    assert waterfall.one_to_many((99, "E1", 261.0), waterfall.Pool(rows), 5.0) is None
