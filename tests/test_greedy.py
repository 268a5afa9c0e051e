"""Rounds, bins, ranges and segments against plain Python, with dense groups and tiny limits that force every cut."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import guarded, indel, similar_pairs
from ledgerloom.operators import bands, greedy, rules, scan, waterfall
from test_matching import DAY, ledger


def one_by_one(members, lists):
    free, out = {p for ps in lists.values() for p in ps}, set()
    for g, c in sorted(members):
        if (p := next((p for p in lists.get(c, ()) if p in free), None)) is not None:
            free.discard(p)
            out.add((g, p))
    return out


@pytest.mark.parametrize("kind", ["sparse", "dense", "copies", "shifted"])
def test_first_come_is_row_order(spark, monkeypatch, kind):
    monkeypatch.setattr(scan, "GROUP", 9)  # larger classes are numbered by ranges
    r = random.Random(kind)
    if kind == "copies":  # one class, K against K
        members, lists = [(g, 1) for g in range(120)], {1: list(range(100))}
    elif kind == "shifted":  # single rows take entries out of a large class's list from its start
        members, lists = [(g, 1) for g in range(10, 90)] + [(g, 100 + g) for g in range(6)] + [(200, 7)], {1: list(range(70)), 7: [3, 75]} | {100 + g: [2 * g, 2 * g + 40] for g in range(6)}
    else:
        classes, edges = (60, 4) if kind == "sparse" else (6, 40)
        members = [(g, r.randrange(classes)) for g in range(90)]
        lists = {c: r.sample(range(70), r.randrange(edges + 1)) for c in range(classes)}
    m = spark.createDataFrame(members, "g_idx long, c long")
    edges = spark.createDataFrame([(c, p, k) for c, ps in lists.items() for k, p in enumerate(ps)], "c long, p_idx long, k int")
    assert set(map(tuple, greedy.first_come(m, edges, ["k"]).collect())) == one_by_one(members, lists)


def test_first_come_of_copies_needs_no_pairs(spark, monkeypatch):
    """K rows against K rows are settled in the first round."""
    rounds = []
    kept = greedy.materialize
    monkeypatch.setattr(greedy, "materialize", lambda df, label, **k: (rounds.append(label), kept(df, label, **k))[1])
    m, edges = spark.range(3000).select(F.col("id").alias("g_idx"), F.lit(0).cast("long").alias("c")), spark.range(3000).select(F.lit(0).cast("long").alias("c"), F.col("id").alias("p_idx"))
    assert greedy.first_come(m, edges, []).where("g_idx = p_idx").count() == 3000 and rounds.count("asked") == 1


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(5000, 5000), (-3, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, greedy.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == root
    assert greedy.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("band", [bands.Band("x", "y", 10.0), bands.Band("x", "y", 0.0), bands.Band("x", "y", 20.0, share=0.5), bands.Band("x", "y", 1.0, share=0.9), bands.Band("i", "j", 30, date=True)])
def test_band_join(spark, band):
    r = random.Random(4)
    number = lambda: r.choice((r.uniform(-500, 500), float(r.randrange(-60, 60)), 10.0 * r.randrange(-9, 9), r.lognormvariate(4, 2), 0.0, None))
    row = lambda k: (k, r.choice("AAB"), number(), None if r.random() < 0.1 else DAY + dt.timedelta(r.randrange(-90, 90)))
    left, right = [row(k) for k in range(150)], [row(k) for k in range(150)]
    got = {(x.k, x.m) for x in bands.band_join(spark.createDataFrame(left, "k int, v string, x double, i date"), spark.createDataFrame(right, "m int, v string, y double, j date"), ["v"], [band]).collect()}
    apart = (lambda a, b: abs((a[3] - b[3]).days) <= 30) if band.date else (lambda a, b: abs(a[2] - b[2]) <= max(band.reach, abs(a[2]) * band.share))
    at = 3 if band.date else 2
    assert got == {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[at] is not None and b[at] is not None and apart(a, b)} and got


def test_bins_pair_little_more_than_the_band(spark):
    """A key with all rows: what the join makes before conditions stays within 4 times what is kept."""
    rows = lambda a, b, c: spark.range(4000).select(F.lit("V").alias("v"), F.col("id").alias(a), (F.rand(1 if b == "x" else 2) * 300_000).alias(b), F.date_add(F.lit(DAY), (F.rand(3 if b == "x" else 4) * 2400).cast("int")).alias(c))
    left, right = rows("k", "x", "i"), rows("m", "y", "j")
    for found in ([bands.Band("i", "j", 30, date=True)], [bands.Band("i", "j", 30, date=True), bands.Band("x", "y", 20_000.0, share=0.5)]):
        loose = bands.band_join(left.cache(), right.cache(), ["v"], found)
        kept = loose.count()
        made = sum_of_join(left, right, found)
        assert kept < made <= 4 * kept


def sum_of_join(left, right, found):
    """Pairs of the equi-join alone."""
    from unittest.mock import patch

    with patch.object(bands.Band, "holds", lambda self: F.lit(True)):
        return bands.band_join(left, right, ["v"], found).count()


@pytest.mark.parametrize("limit", [7, 10**6])
def test_nearest(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "GROUP", limit)
    r = random.Random(limit)
    value = lambda: float(r.choice((1, 2, 2, 5, 9, 9.5, 40)) + r.choice((0, 0, 100)))
    items = [(r.choice("AAAB"), k, value()) for k in range(60)] + [("C", 99, 1.0)]
    asked = [(r.choice("AABCD"), 1000 + k, value()) for k in range(40)]
    got = defaultdict(list)
    for x in scan.nearest(spark.createDataFrame(asked, "v string, row long, at double"), spark.createDataFrame(items, "v string, item long, at double"), ["v"], 3).orderBy("row", "rank").collect():
        got[x["row"]].append(x["item"])
    want = {i: [k for _, k in sorted((abs(a - b), k) for w, k, b in items if w == v)[:3]] for v, i, a in asked}
    assert dict(got) == {i: ks for i, ks in want.items() if ks}


def two_pointers(a, b, tol):
    a, b, n = sorted(a), sorted(b), 0
    while a and b:
        if b[0] + tol < a[0]:
            b.pop(0)
        elif b[0] <= a[0] + tol:
            a.pop(0), b.pop(0)
            n += 1
        else:
            a.pop(0)
    return n


@pytest.mark.parametrize("shape", ["dense", "loose", "one side", "repeats"])
def test_range_yield_is_two_pointers(spark, monkeypatch, shape):
    """Segments of 40 values: an island far longer than a segment, with more rows of one side."""
    monkeypatch.setattr(rules, "SEGMENT", 40)
    r = random.Random(shape)
    value = {"dense": lambda: r.randrange(0, 3000) / 4, "loose": lambda: r.randrange(0, 40000) / 4, "one side": lambda: r.randrange(0, 800) / 4, "repeats": lambda: float(r.choice((100, 105, 110, 121, 131.25)))}[shape]
    g, p = [value() for _ in range(300)], [value() for _ in range(40 if shape == "one side" else 280)]
    of = lambda xs, s: ledger(spark, [{"taxable": x, "d": DAY + dt.timedelta(int(x))} for x in xs], s)
    gl, pl = of(g, "G"), of(p, "P")
    assert rules.rule_yield(gl, pl, rules.AMOUNT).first().pairs == two_pointers(g, p, 10)
    assert rules.rule_yield(gl, pl, rules.DAY).first().pairs == two_pointers([int(x) for x in g], [int(x) for x in p], 30)
    assert rules.rule_yield(gl.limit(0), pl, rules.AMOUNT).first().pairs == rules.rule_yield(gl, pl.limit(0), rules.AMOUNT).first().pairs == 0


def plain_batches(gs, ps, tol=5.0):
    """Both batch searches of one vendor, every row compared with every other."""
    from itertools import combinations

    gs, ps, out = list(gs), list(ps), set()
    fits = lambda rows, goal: len(rows) >= 2 and abs(sum(r[2] for r in rows) - goal) <= tol
    for p in list(ps):
        pool = [g for g in gs if 0 < g[2] <= p[2] + tol]
        if p[2] <= 0 or len(pool) < 2:
            continue
        related = [g for g in pool if p[1] and (p[1] in g[1] or g[1] in p[1] or guarded(g[1], p[1]) >= 0.6)]
        few = sorted(pool, key=lambda g: abs(g[2] - p[2] / 2.5))[:8] if len(pool) > 8 else pool
        found = pool if fits(pool, p[2]) else related if fits(related, p[2]) else next((c for k in range(2, min(len(few), 5) + 1) for c in combinations(few, k) if fits(c, p[2])), ())
        if found:
            out |= {(g[0], p[0], "BATCH_N_TO_1") for g in found}
            ps.remove(p)
            gs = [g for g in gs if g not in found]
    for g in gs:
        pool = [p for p in ps if 0 < p[2] <= g[2] + tol]
        related = [p for p in pool if g[1] in p[1] or p[1] in g[1] or guarded(g[1], p[1]) >= 0.7]
        if g[2] > 0 and len(pool) >= 2 and fits(related, g[2]):
            out |= {(g[0], p[0], "BATCH_1_TO_N") for p in related}
            ps = [p for p in ps if p not in related]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batches_look_at_few_rows_and_find_the_same(spark, seed):
    r = random.Random(seed)
    doc = lambda: r.choice(("", "AB12", "ZZ", *("".join(r.choices("ABX12", k=r.randrange(1, 6))) for _ in range(3))))
    amount = lambda: r.choice((0, -5, 100, 100, 250, 400, 400, 655, r.randrange(1, 4000), r.randrange(1, 4000)))
    rows = lambda n, side: [{"vendor": r.choice("AAB"), "doc": doc(), "taxable": amount()} for _ in range(n)]
    g, p = rows((25, 80, 30, 50)[seed], "G"), rows((30, 60, 50, 20)[seed], "P")
    gl, pl = waterfall.prepare(ledger(spark, g)), waterfall.prepare(ledger(spark, p, "P"))
    got = {(x.g_idx, x.p_idx, x["sub"]) for x in waterfall.batch_pass(gl, pl, waterfall.Limits()).collect()}
    side = lambda df, v: [(x.row_idx, x.n, x.taxable) for x in df.where(F.col("v") == v).orderBy("row_idx").collect()]
    assert got == plain_batches(side(gl, "A"), side(pl, "A")) | plain_batches(side(gl, "B"), side(pl, "B")) and got


@pytest.mark.parametrize("least", [0.55, 0.6, 0.75, 0.85, 1.0])
def test_similar_pairs(spark, least):
    r = random.Random(1)
    base = ["".join(r.choices("ABC0123é", k=r.randrange(1, 14))) for _ in range(12)]
    edited = lambda t: "".join(c for c in t if r.random() > 0.1) + r.choice(("", "7", "AA"))
    rows = lambda: [(r.choice("XY"), edited(r.choice(base))) for _ in range(90)] + [("X", None), ("X", ""), ("Y", "AAAAAAAAAA")]
    a, b = rows(), rows()
    got = similar_pairs(spark.createDataFrame(a, "v string, a string"), spark.createDataFrame(b, "v string, b string"), ["v"], least).collect()
    want = {(v, x, y): indel(x, y) for v, x in set(a) for w, y in set(b) if v == w and x and y and indel(x, y) >= least}
    assert len(got) == len(want) > 0 and {(g.v, g.a, g.b): g.alike for g in got} == want
