"""Neighbours in a bucket become rows only if they can be linked."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import near_dedup


def generated(df):
    """Rows that explode and inline have made, once df has run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()

    def walk(node):
        yield node
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return sum(n.metrics().apply("numOutputRows").value() for n in walk(plan) if n.nodeName() == "Generate")


def test_only_candidates_become_rows(spark):
    """A bucket of a merged group and a few strangers makes rows for candidates, not REACH for each entry."""
    r = random.Random(4)
    word = lambda: r.getrandbits(64) - (1 << 63)
    like = {w: word() for w in near_dedup.MARKS}
    rows = [{"key": 1, "c": c, "g": 0 if c < 200 else c, "n_1": 100, **{f"{w}_1": like[w] if c < 202 else word() for w in near_dedup.MARKS}} for c in range(230)]
    names = ["key", "c", "g", "n_1", *(f"{w}_1" for w in near_dedup.MARKS)]
    entries = spark.createDataFrame([tuple(x[n] for n in names) for x in rows], ", ".join(f"{n} long" for n in names))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = near_dedup.neighbours(entries, 0, 80)
        # the last of the group stand within REACH of 200 and 201, which are like it
        want = {(a, b) for a in range(202) for b in (200, 201) if a < b <= a + near_dedup.REACH}
        assert set(map(tuple, pairs.collect())) == want and generated(pairs) == len(want) == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_fields_of_columns_and_structs_are_judged_alike(spark):
    r = random.Random(6)
    near = lambda x: x ^ (1 << r.randrange(63)) if r.random() < 0.5 else x
    rows = []
    for _ in range(60):
        a = [100] + [r.getrandbits(62) for _ in near_dedup.MARKS]
        rows.append((*a, r.randrange(70, 130), *(near(x) for x in a[1:])))
    names = ("n", *near_dedup.MARKS)
    df = spark.createDataFrame(rows, ", ".join(f"{x}{e} long" for e in ("_1", "_2") for x in names))
    df = df.withColumn("o", F.struct(*(F.col(f"{x}_2").alias(x) for x in names)))
    got = df.select(near_dedup.able("_1", "_2", 80), near_dedup.able("_1", F.col("o"), 80), near_dedup.apart("_1", "_2"), near_dedup.apart("_1", F.col("o"))).collect()
    assert all(x[0] == x[1] and x[2] == x[3] for x in got) and {x[0] for x in got} == {True, False}
