"""Hard negatives, exact dedup and source divergence against plain Python on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, exact_dedup, hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows):
    """Brute force of the contract over rows (id, vector, label)."""
    ok = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors, out = {}, set()
    for i, v, l in ok:
        if i % 5 == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, w, l in ok if i != a)
        for s, i in [(-s, i) for s, i, l in scored if l == label][:5]:
            fit = [(j, -t) for t, j, l in scored if l != label and 50 * s <= -100 * t <= 95 * s][:3]
            out |= {(a, i, k, j, s, t) for k, (j, t) in enumerate(fit, 1)}
    return out


def vectors(n, seed, labels=3, width=4):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [float(F32(c + r.gauss(0, 0.3))) for c in r.choice(centre)], r.randrange(labels)) for i in range(n)]


def F32(x):
    import numpy as np

    return np.float32(x)


@pytest.mark.parametrize("shape", ["plain", "hot", "one label", "many labels"])
def test_hard_negatives(spark, monkeypatch, shape):
    monkeypatch.setattr(hard_negatives, "CELL", 20)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    monkeypatch.setattr(hard_negatives, "CHUNK", 30)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40)
    rows = vectors(200, 3, labels={"one label": 1, "many labels": 90}.get(shape, 3))
    if shape == "hot":
        rows = [(i, rows[0][1] if i % 3 == 0 else v, l) for i, v, l in rows]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"vec": F.lit("x"), "goal": F.lit(1), "cell": F.lit(2)})
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows)
    assert got if shape in ("plain", "hot") else not got or shape == "many labels"


def test_bounds_drop_rows(spark, monkeypatch):
    """Tight clusters: few groups get a row, and nothing is lost."""
    monkeypatch.setattr(hard_negatives, "CELL", 30)
    r = random.Random(5)
    at = [[10.0 * (k == j) + 1 for j in range(8)] for k in range(8)]
    rows = [(i, [float(F32(x + r.gauss(0, 0.01))) for x in at[i % 8]], (i // 8) % 2) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    taking = hard_negatives.quantised(df, F.col("vec_id") % 5 == 0)
    space = hard_negatives.space_of(taking)
    cells = hard_negatives.placed(taking, space)
    asked = hard_negatives.placed(taking.where("is_anchor"), space, anchors=True).withColumn("goals", F.array().cast("array<long>"))
    ranged = hard_negatives.ranged(asked, space, hard_negatives.positive_range)
    sent = hard_negatives.sent_rows(cells, space, hard_negatives.plan_of(cells, ranged, space)).count()
    assert sent < 0.7 * len(space.pivots) * len(rows)
    assert set(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())) == mined(rows)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.5]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, [0.9, 0.2], 2), (2, [0.9, 0.2], 2), (3, None, 1), (4, v, None), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (None, v, 1), (8, [], 2), (9, [0.8], 2), (10, [0.0, 0.0], 2), (10, [0.1, 0.0], 2), (11, [-1.0, -1.0], 2), (12, [0.7, 0.4], 3)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))
    padded = [(i, v if v is None or len(v) == 2 else (v + [0.0, 0.0])[:2], l) for i, v, l in rows]
    want = {(a, p, k, n, s, t) for a, p, k, n, s, t in mined(padded)}
    assert set(got) == want
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def grouped(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    best = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
    return Counter((i, best(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_exact_dedup_odd_rows(spark, docs_of, odd_rows):
    rows = [*odd_rows, (900, "hot"), *((i, "hot") for i in range(300, 600)), (None, "hot"), (17, "ß"), (18, "ss"), (19, "a\x00b"), (20, "a")]
    got = exact_dedup.exact_dedup(docs_of(rows, extra=True)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == grouped(rows)
    kept = Counter(r.digest for r in got if r.kept)
    assert set(kept) == {r.digest for r in got} and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0


def test_texts_that_share_a_digest_stay_apart(spark, docs_of, odd_rows):
    """Full texts decide: with a digest of no worth the groups are the same."""
    got = exact_dedup.exact_dedup(docs_of(odd_rows), digest=lambda text: (F.length(text) % 3).cast("string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter(x[:3] for x in grouped([r[:2] for r in odd_rows]).elements())
    assert sum(r.kept for r in got) == len({r[1] or "" for r in odd_rows})


def test_state_goes_on_with_new_files(spark, docs_of, tmp_path):
    """A second run reads new files only and finds copies of what it has seen before."""
    path, index = str(tmp_path / "docs"), str(tmp_path / "index")
    docs_of([(i, f"text {i % 7}") for i in range(20)]).repartition(4).write.parquet(path)
    exact_dedup.exact_dedup_files(spark, path, index).collect()
    before = exact_dedup.current(spark, index).collect()
    done = spark.read.parquet(f"{index}/changes").agg(F.max("batch")).first()[0]
    docs_of([(100, "text 3"), (101, "new"), (102, "text 6"), (1, "new")]).write.mode("append").parquet(path)
    got = exact_dedup.exact_dedup_files(spark, path, index).collect()
    assert sum(r.n for r in before) == 20
    rows = [(i, f"text {i % 7}") for i in range(20)] + [(100, "text 3"), (101, "new"), (102, "text 6"), (1, "new")]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == grouped(rows)
    later = spark.read.parquet(f"{index}/changes").where(F.col("batch") > done)
    assert {r.keep.doc_id for r in later.collect()} <= {1, 100, 101, 102}  # unchanged digests are not touched


def audited(rows):
    """Brute force over rows (text, lang, source)."""
    docs = [((t or ""), lang or "", s or "") for t, lang, s in rows]
    terms = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [(s, ws) for (_, x, s), ws in zip(docs, terms) if x == lang]
        df = Counter(w for _, ws in mine for w in set(ws))
        kept = [w for w in df if df[w] >= 3]
        count = {s: Counter(w for x, ws in mine if x == s for w in ws) for s in {s for s, _ in mine}}
        total = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            words = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(sorted(words), 1) if k <= 200}
    return out


def test_divergence(spark):
    r = random.Random(7)
    words = ["Alpha", "beta", "Ärger", "Ångström", "日本", "don't", "x2y", "ß", "ÉCOLE", "😀", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))]
    rows = [(" ".join(r.choices(words, k=r.randrange(80))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "B", "é", None])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", "x"), ("only here", "fr", "y"), ("\n\t 123", "zz", "alone"), ("Alpha " * 5000, "en", "a"), *[("common " * 3, "en", "hot")] * 60]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(3), "p": F.lit(1), "size": F.lit(1)})
    got = [tuple(x) for x in divergence.divergence(df).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_of_huge_counts(spark):
    """Decimals hold what a long can't."""
    df = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "n long, total long, size long")
    assert df.select(F.expr(divergence.SHARE.format(n="n", total="total"))).first()[0] == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 7)
