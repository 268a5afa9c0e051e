"""Rounds of near-dedup don't join all bucket entries by bucket again and again."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import near_dedup


def test_rounds_filter_buckets_twice_at_most(spark, monkeypatch):
    """However many rounds it takes, entries are joined with the buckets that are still open before the first and after the last, by a join that makes no rows."""
    calls = []
    split = near_dedup.still_split
    monkeypatch.setattr(near_dedup, "still_split", lambda rows: (calls.append(rows.columns), split(rows))[1])
    r = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    edited = lambda n: " ".join(w if r.random() > n / 120 else f"x{r.randrange(10**6)}" for w in base)
    rows = [(k, edited(r.choice((1, 3, 5)))) for k in range(60)] + [(99, " ".join(base))]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len(calls) == 2

    entries = spark.createDataFrame([(1, 5, 5), (1, 6, 5), (2, 5, 5), (2, 7, 7)], "key long, c long, g long")
    assert sorted(map(tuple, split(entries).collect())) == [(2, 5, 5), (2, 7, 7)]
