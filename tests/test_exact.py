"""The exact stage deals its rows once."""

from pyspark.sql import functions as F

from ledgerloom.operators import tiers
from test_matching import ledger


def test_exact_deals_rows_once(spark):
    """Rows aren't shuffled by key for their numbers and once more to meet; repeated keys and nulls as before."""
    row = lambda k: {"vendor": f"V{k % 3}", "doc": f"D{k % 4}", "taxable": 100 + k % 2}
    g, p = ledger(spark, [row(k) for k in range(60)]), ledger(spark, [row(k * 5) for k in range(50)] + [row(1)] * 9, "P")
    p = p.withColumn("doc", F.when(F.col("row_idx") % 7 != 0, F.col("doc")))
    left, right = {}, {}
    for side, df in ((left, g), (right, p)):
        for x in sorted(df.collect(), key=lambda x: x.row_idx):
            if x.doc is not None:
                side.setdefault((x.vendor, x.doc, x.taxable), []).append(x.row_idx)
    want = {pair for k in left for pair in zip(left[k], right.get(k, []))}
    got = tiers.exact(g, p)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = got.collect()
    assert set(map(tuple, rows)) == want and len(rows) == len(want) > 20
