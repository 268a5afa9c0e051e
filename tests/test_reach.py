"""First come within reach of numbers: as row by row, by ranges and rounds, and without a list of all near pairs."""

import datetime as dt
import random

import pytest

from ledgerloom.operators import reach, rules
from test_matching import ledger

SHARE = rules.Rule("share", "igst", "number", 20.0, percent=True)


def made(n, seed, span=400, days=40, step=1):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.02 else dt.date(2024, 1, 1) + dt.timedelta(r.randrange(days))
    return [{"taxable": None if r.random() < 0.02 else r.randrange(0, span, step), "d": day(), "igst": r.randrange(1, 9)} for _ in range(n)]


def row_by_row(g, p, rows_of):
    free, out = dict(enumerate(p)), set()
    for i, a in enumerate(g):
        if (j := next((j for j, b in free.items() if rows_of(a, b)), None)) is not None:
            out.add((i, j))
            del free[j]
    return out


def fits(chosen):
    near = lambda a, b, k, most: a[k] is not None and b[k] is not None and abs(a[k] - b[k]) <= most(a[k])
    day = lambda a, b: a["d"] and b["d"] and abs((a["d"] - b["d"]).days) <= 30
    return lambda a, b: near(a, b, "taxable", lambda x: 10) and (rules.DAY not in chosen or day(a, b)) and (SHARE not in chosen or near(a, b, "igst", lambda x: x * 0.2 + 1e-4))


@pytest.fixture
def labels(monkeypatch):
    kept, out = reach.materialize, []
    monkeypatch.setattr(reach, "materialize", lambda df, label, **k: (out.append(label), kept(df, label, **k))[1])
    return out


@pytest.mark.parametrize("chosen, at_once", [((rules.AMOUNT,), 50), ((rules.DAY, rules.AMOUNT), 1_000_000), ((SHARE, rules.AMOUNT, rules.DAY), 50)])
def test_ranges_are_row_order(spark, monkeypatch, labels, chosen, at_once):
    """Many ranges that share rows with their neighbours, so some rows are asked for from both sides, in several rounds."""
    for name, value in {"RANGE": 60, "CROWD": 10_000, "WIDTH": 3, "AROUND": 1.5, "AT_ONCE": at_once}.items():
        monkeypatch.setattr(reach, name, value)
    g, p = made(300, 1, step=5), made(300, 2, step=5)
    got = rules.simulate(ledger(spark, g), ledger(spark, p, "P"), chosen).collect()
    want = row_by_row(g, p, fits(chosen))
    assert set(map(tuple, got)) == want and len(got) == len(want) > 100
    assert labels.count("moved") >= 1


def test_no_pairs_are_written(spark, monkeypatch):
    """All rows are near each other: 90,000 pairs that nobody joins."""
    monkeypatch.setattr(rules, "band_join", None)
    g, p = made(300, 3, span=10), made(300, 4, span=10)
    chosen = (rules.AMOUNT, rules.DAY)
    assert set(map(tuple, rules.simulate(ledger(spark, g), ledger(spark, p, "P"), chosen).collect())) == row_by_row(g, p, fits(chosen))


def test_a_crowd_is_settled_by_classes(spark, monkeypatch, labels):
    """More rows at one place than a range may have: classes of equal values are paired instead."""
    monkeypatch.setattr(reach, "RANGE", 50)
    monkeypatch.setattr(reach, "CROWD", 200)
    g, p = made(300, 5, span=20), made(300, 6, span=20)
    chosen = (rules.AMOUNT, rules.DAY)
    assert set(map(tuple, rules.simulate(ledger(spark, g), ledger(spark, p, "P"), chosen).collect())) == row_by_row(g, p, fits(chosen))
    assert labels == ["reach"]


def test_one_side_is_empty(spark):
    g = made(20, 7)
    assert rules.simulate(ledger(spark, g), ledger(spark, g, "P").limit(0), (rules.AMOUNT, rules.DAY)).count() == 0
    assert rules.simulate(ledger(spark, g).limit(0), ledger(spark, g, "P"), (rules.AMOUNT, rules.DAY)).count() == 0
