"""What makes the queries' work grow with their input: rows that don't take part in rounds, values that are computed once, ledgers that are read once."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalize, similarity
from ledgerloom.operators import greedy, rules, waterfall
from ledgerloom.sources import ledgers
from ledgerloom.sources.store import materialize
from test_greedy import one_by_one
from test_matching import ledger


def made(spark, seed):
    """G classes (one in three has a single candidate class), pairs and P classes."""
    r = random.Random(seed)
    gs = [(g, r.randrange(0, 90)) for g in range(400)]
    gs = [(g, min(x for x, c in gs if c == k)) for g, k in gs]
    ps = [(p, r.randrange(0, 90)) for p in range(400)]
    ps = [(p, min(x for x, q in ps if q == k)) for p, k in ps]
    cs, qs = sorted({c for _, c in gs}), sorted({q for _, q in ps})
    pairs = {(c, qs[i]) for i, c in enumerate(cs[:30])} | {(r.choice(cs[30:]), r.choice(qs[30:])) for _ in range(40)}
    pairs = [(c, q, float(r.randrange(3))) for c, q in pairs]
    lists = {c: [p for _, p in sorted((x, p) for k, q, x in pairs if k == c for p, of in ps if of == q)] for c in cs}
    of = spark.createDataFrame
    return (of(gs, "g_idx long, c long"), of(pairs, "c long, q long, place double"), of(ps, "p_idx long, q long")), one_by_one(gs, lists)


@pytest.mark.parametrize("block", [100_000, 40, 0])
def test_matched_is_row_order(spark, monkeypatch, block):
    """Components in one task, some or all of them in rounds: the same either way."""
    monkeypatch.setattr(greedy, "BLOCK", block)
    rows, want = made(spark, 3)
    got = greedy.matched(*rows).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 100


def test_small_components_need_no_rounds(spark, monkeypatch):
    labels = []
    kept = greedy.materialize
    monkeypatch.setattr(greedy, "materialize", lambda df, label, **k: (labels.append(label), kept(df, label, **k))[1])
    row = lambda k: {"vendor": f"V{k % 40}", "doc": f"INV-{k % 7}", "taxable": 100 + k % 3 * 8}
    g, p = ledger(spark, [row(k) for k in range(90)]), ledger(spark, [row(k + 1) for k in range(90)], "P")
    assert rules.simulate(g, p, rules.DEFAULT).count() > 50 and "asked" not in labels


def test_a_rule_names_its_text_once():
    """Each step of a rule is in its expression once, so no row is normalised again and again."""
    text = str(normalize.chain(F.col("doc"), list(rules.FULL)))
    assert text.count("doc") == 1 and str(normalize.number(F.col("taxable"))).count("taxable") == 1


def test_rules_read_odd_texts_as_before(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "000", "INV-", " INV/ 7.0", "12.0", "\n", "A\n", None, "0x", "inv inv 09")], "doc string")
    got = [x[0] for x in rows.select(normalize.chain(F.col("doc"), list(rules.FULL))).collect()]
    assert got == ["0", "0", "0", "70", "12", "0", "A", None, "X", "9"]
    numbers = spark.createDataFrame([("",), ("x",), ("-",), ("1,200.50",), (None,), ("7",)], "c string")
    assert [x[0] for x in numbers.select(normalize.number(F.col("c"))).collect()] == [None, None, None, 1200.5, None, 7.0]


def test_ledgers_join_their_source_once(spark):
    """G and P are read from one table that holds the joined orders."""
    for side in ledgers.ledgers(spark, "/root/testdata/sf0.001"):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "base-" in plan + str(side.inputFiles())


def test_tables_are_not_broadcast_by_their_files(spark):
    """Links of a file below the limit that take more than it as rows in the driver's memory."""
    g, _ = ledgers.ledgers(spark, "/root/testdata/sf0.001")
    links = materialize(g.select(F.col("row_idx").alias("g_idx"), F.col("order_key").alias("p_idx"), F.lit("NEAR_MATCH").alias("bucket")), "links", lean=True)
    files = sum(Path(f.removeprefix("file:")).stat().st_size for f in links.inputFiles())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", files)
    try:
        plan = waterfall.left_over(g, links, "g_idx")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("narrow", [0, 20, 256])
@pytest.mark.parametrize("least", [0.6, 0.85])
def test_similar_pairs_of_small_and_large_groups(spark, monkeypatch, least, narrow):
    """Groups that meet by marks and groups that meet by prefixes, beside each other."""
    monkeypatch.setattr(similarity, "NARROW", narrow)
    r = random.Random(5)
    text = lambda: "INV" + "".join(r.choices("01é", k=r.randrange(0, 9)))
    rows = lambda: [("X", text()) for _ in range(60)] + [("Y", text()) for _ in range(9)] + [("X", None), ("Y", "")]
    a, b = rows(), rows()
    got = similarity.similar_pairs(spark.createDataFrame(a, "v string, a string"), spark.createDataFrame(b, "v string, b string"), ["v"], least).collect()
    want = {(v, x, y) for v, x in set(a) for w, y in set(b) if v == w and x and y and similarity.indel(x, y) >= least}
    assert len(got) == len(want) > 0 and {(x.v, x.a, x.b) for x in got} == want


def test_small_groups_make_no_prefixes(spark, monkeypatch):
    monkeypatch.setattr(similarity, "grams", None)  # the prefixes' q-grams are not asked for
    a, b = spark.createDataFrame([("X", "AB12"), ("X", "ZZ")], "v string, a string"), spark.createDataFrame([("X", "AB1")], "v string, b string")
    assert [(x.a, x.b) for x in similarity.similar_pairs(a, b, ["v"], 0.85).collect()] == [("AB12", "AB1")]


def test_components_compute_their_edges_once(spark):
    """Edges often come from joins and Python; reading them once for each direction would do these again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long").mapInArrow(counted, "a long, b long")
    assert dict(map(tuple, greedy.components(edges).collect())) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and seen.value == 3


def test_a_range_reads_each_distinct_value_once(spark, monkeypatch):
    """Rows are counted by what stands in the column; only the counts are read as numbers, moved and added up."""
    rows, kept = {}, rules.materialize

    def counted(df, label, **k):
        out = kept(df, label, **k)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(rules, "materialize", counted)
    g = ledger(spark, [{"taxable": x} for x in [100, 100, 100, 115, 115, 300, None] * 5])
    p = ledger(spark, [{"taxable": x} for x in [105, 110, 290, 290] * 5], "P")
    assert rules.range_yield(g, p, rules.AMOUNT).first().pairs == 15 and (rows["g_values"], rows["p_values"]) == (3, 3)
