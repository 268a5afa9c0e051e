"""Substring, line and near dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, line_dedup, near_dedup, substring_dedup as sub

TOP = (1 << 63) - 1


def words(text):
    return (text or "").encode().split()


def sub_brute(rows, size=sub.WINDOW):
    """Rows of one doc_id never cover each other."""
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            key = b" ".join(w[s : s + size])
            first[key] = min(first.get(key, TOP), TOP if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        cover = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[b" ".join(w[s : s + size])] < (TOP if i is None else i):
                cover[s : s + size] = [True] * size
        out.append((i, len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode()))
    return sorted(out, key=str)


def passages(seed, n=60):
    """Documents that share passages of many lengths, some cut or changed inside."""
    r = random.Random(seed)
    shared = [[f"s{r.randrange(40)}" for _ in range(r.randint(30, 160))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            p = list(r.choice(shared))
            p = p[r.randint(0, 20) : len(p) - r.randint(0, 20)]
            if r.random() < 0.4 and p:
                p[r.randrange(len(p))] = "changed"
            w += [f"u{r.randrange(1000)}" for _ in range(r.randint(0, 30))] + p
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("batches", [1, 6])
def test_substring_passages(docs_of, batches):
    rows = passages(batches)
    rows.append((60, "same " * 300))
    rows.append((61, "same " * 70))
    got = sub.substring_dedup(docs_of(rows), batches).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sub_brute(rows)


def test_substring_odd_rows(docs_of, odd_rows):
    got = sub.substring_dedup(docs_of(odd_rows, extra=True)).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_text) for g in got), key=str) == sub_brute(odd_rows)
    for g in got:
        assert sum(s.end - s.start for s in g.spans) == g.n_removed
    assert sub.substring_dedup(docs_of([])).count() == 0


def test_hot_passage(docs_of, monkeypatch):
    monkeypatch.setattr(sub, "HOT", 30)
    r = random.Random(3)
    common = " ".join(f"c{i}" for i in range(60))
    own = lambda: " ".join(f"o{r.randrange(10**6)}" for _ in range(r.randint(20, 60)))
    rows = [(i, f"{own()} {common} {own()}") for i in range(120)] + [(i + 200, t) for i, t in passages(4, 20)] + [(None, common), (7, common)]
    got = sub.substring_dedup(docs_of(rows), 3).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sub_brute(rows)


def test_index_is_opened_again(spark, docs_of, tmp_path):
    rows = passages(6, 40)
    placed = sub.placed(docs_of(rows))
    one = sub.FingerprintIndex(spark, folder=str(tmp_path / "index"))
    first = one.ingest(placed.where("d < 20"))
    one.close()
    two = sub.FingerprintIndex(spark, folder=str(tmp_path / "index"))
    assert two.runs == one.runs and len(two.runs) == 1
    plan = two.history(spark.range(5).select(F.col("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    second = two.ingest(placed.where("d >= 20"))
    assert len(two.runs) == 2 and two.history().count() > 0
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    got = sub.removed(placed, first[0].unionByName(second[0]), sub.verified(first[1].unionByName(second[1]), placed)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sub_brute(rows)
    two.close()


def test_index_compaction_keeps_results(spark, docs_of):
    rows = passages(9, 80)
    index, covered = sub.FingerprintIndex(spark, max_runs=1), []
    placed = sub.placed(docs_of(rows))
    parts = [index.ingest(placed.where(F.col("d").between(lo, lo + 19))) for lo in range(0, 80, 20)]
    assert len(index.runs) == 1
    covers, suspects = parts[0]
    for c, s in parts[1:]:
        covers, suspects = covers.unionByName(c), suspects.unionByName(s)
    got = sub.removed(placed, covers, sub.verified(suspects, placed)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sub_brute(rows)


def line_brute(rows, depth):
    runs = collections.defaultdict(list)
    seqs = []
    for n, (i, t) in enumerate(rows):
        found = [(k, x) for k, x in enumerate((t or "").encode().split(b"\n")) if x.strip()]
        seqs.append(found)
        for s in range(len(found) - depth + 1):
            runs[tuple(x for _, x in found[s : s + depth])].append((TOP if i is None else i, s, n))
    gone = collections.defaultdict(set)
    for places in runs.values():
        low = min(p[:2] for p in places)
        for d, s, n in places:
            if d > low[0] or s - low[1] >= depth:  # a copy begins behind its original
                gone[n] |= {seqs[n][s + j][0] for j in range(depth)}
    out = []
    for n, (i, t) in enumerate(rows):
        kept = b"\n".join(x for k, x in enumerate((t or "").encode().split(b"\n")) if k not in gone[n]).decode()
        out.append((i, len(seqs[n]), len(gone[n]), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [2, 5])
def test_lines(docs_of, odd_rows, depth):
    r = random.Random(depth)
    rows = [(100 + i, "\n".join(r.choice(["a", "b b", "c", "", " ", "long line d"]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += odd_rows
    got = line_dedup.line_dedup(docs_of(rows, extra=True), depth, None).select("doc_id", "n_lines", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == line_brute(rows, depth)
    assert line_dedup.line_dedup(docs_of([])).count() == 0


def run_brute(rows, lines, words):
    """By the longest earlier copy of every suffix, whatever its length; judged by lines or words. doc_ids are distinct and in order."""
    seqs = [[(k, x) for k, x in enumerate(t.split("\n")) if x.strip()] for _, t in rows]
    bare = [[x for _, x in s] for s in seqs]
    out = []
    for n, (i, t) in enumerate(rows):
        gone = set()
        for s in range(len(bare[n])):
            most, heard = 0, np.cumsum([len(x.split()) for x in bare[n][s:]])
            for m in range(n + 1):
                for b in range(len(bare[m]) if m < n else s):
                    k = 0
                    while s + k < len(bare[n]) and b + k < len(bare[m]) and bare[n][s + k] == bare[m][b + k]:
                        k += 1
                    enough = [d for d in range(1, min(k, lines) + 1) if d == lines or heard[d - 1] >= words]
                    if any(m < n or s - b >= d for d in enough):
                        most = max(most, k)
            gone |= {k for k, _ in seqs[n][s : s + most]}
        out.append((i, len(seqs[n]), len(gone), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("lines", [2, 4])
def test_single_long_lines_go(docs_of, lines):
    r = random.Random(lines)
    passage = [" ".join(f"p{j}w{r.randrange(90)}" for _ in range(n)) for j, n in enumerate((49, 50, 51, 80))]
    rows = [(i, "\n".join(r.choice(["a", "b b", "", " ", "c " * 30, *passage, f"own {i}"]) for _ in range(r.randint(0, 9)))) for i in range(50)]
    rows += [(90, passage[3]), (91, passage[3]), (92, f"x\n{passage[1]}\ny 92"), (93, f"z\n{passage[0]}\ny 93")]
    got = line_dedup.line_dedup(docs_of(rows, extra=True), lines, min_words=50).select("doc_id", "n_lines", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == run_brute(rows, lines, 50)
    kept = {g.doc_id: g.kept_text for g in got}
    assert kept[91] == "" and kept[92] == "x\ny 92" and kept[93] == f"z\n{passage[0]}\ny 93"


def test_the_first_copy_stays_whole(docs_of):
    texts = ["a\na\na\nb", "c\nc\nc\nc", "d\ne\nd\ne\nd\ne", "x\na\na\nb"]
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(docs_of(list(enumerate(texts))), 2, None).collect()}
    assert got == {0: "a\na\na\nb", 1: "c\nc", 2: "d\ne", 3: "x"}


def maximal_brute(rows, depth):
    """Runs by their definition: from every place to the first place of its opening lines, left-maximal, as long as lines agree."""
    seqs = [[x for x in t.split("\n") if x.strip()] for _, t in rows]
    first = {}
    for n, seq in enumerate(seqs):
        for s in range(len(seq) - depth + 1):
            first.setdefault(tuple(seq[s : s + depth]), (n, s))
    at = {(n, s): first[tuple(seq[s : s + depth])] for n, seq in enumerate(seqs) for s in range(len(seq) - depth + 1)}
    out = collections.defaultdict(list)
    for (n, s), (m, t) in at.items():
        if (n != m or s - t >= depth) and at.get((n, s - 1)) != (m, t - 1):
            k = 0
            while s + k < len(seqs[n]) and t + k < len(seqs[m]) and seqs[n][s + k] == seqs[m][t + k]:
                k += 1
            out[rows[n][0]].append((s, k, rows[m][0], t))
    return {i: sorted(r) for i, r in out.items()}


@pytest.mark.parametrize("depth", [1, 3, 50])
def test_maximal_runs(docs_of, depth):
    r = random.Random(depth)
    long = [f"line {i}" for i in range(300)]
    rows = [(i, "\n".join(r.choice("abcd") for _ in range(r.randint(0, 14)))) for i in range(40)]
    rows += [(100 + i, "\n".join(long[a : a + n] + [f"own {i}"])) for i, (a, n) in enumerate([(0, 300), (0, 300), (100, 60), (120, 100), (249, 51), (250, 49)])]
    rows += [(200, "\n".join(["same"] * 120)), (201, "\n".join(["x", *["same"] * 70, "y"]))]
    got = line_dedup.line_dedup(docs_of(rows), depth, None).collect()
    assert {g.doc_id: [tuple(x) for x in g.runs] for g in got if g.runs} == maximal_brute(rows, depth)


def test_rounds_are_logarithmic(docs_of):
    rows = [(i, "\n".join(f"line {j}" for j in range(200))) for i in (1, 2)] + [(3, "\n".join(f"line {j}" for j in range(50)))]
    lines = line_dedup.line_ids(line_dedup.keyed(docs_of(rows)), 2)
    rounds = line_dedup.suffix_ranks(lines)
    assert [r.count() for r in rounds] == [450, 447, 441, 429, 405, 357, 274, 146]  # 2 x (201 - depth), and as many of the third document as are long enough
    body = {(x._d, x.seq): x.id for x in lines.collect()}
    for i, table in enumerate(rounds):
        found = sorted(table.collect(), key=lambda x: x["rank"])
        keys = [tuple(body[x._d, x.seq + j] for j in range(1 << i)) for x in found]
        assert len(set(keys)) == len({x["rank"] for x in found}) == len(set(zip(keys, (x["rank"] for x in found))))
        if i < 2:
            assert keys == sorted(keys, key=lambda k: [keys.index(k)]) and (i or keys == sorted(keys))  # ranks follow the order of the lines


def test_columns_of_any_name_are_carried(docs_of):
    names = ("_d", "_k", "row", "runs", "seq", "td", "length")
    docs = docs_of([(1, "a\nb"), (2, "a\nb\nc"), (2, "a\nb\nc")]).withColumns({c: F.lit(c) for c in names})
    got = line_dedup.line_dedup(docs).collect()
    assert all(g[c] == c for g in got for c in names if c != "runs") and [g.kept_text for g in sorted(got, key=lambda g: g.doc_id)] == ["a\nb", "c", "c"]


def near_brute(rows, k):
    sets = []
    for _, t in rows:
        w = words(t.lower() if t and t.isascii() else t)
        w = [x.lower() for x in w]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), TOP), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def edits(seed, n, base_words=120, change=8):
    r = random.Random(seed)
    bases = [[f"b{b}x{r.randrange(500)}" for _ in range(base_words)] for b in range(4)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, change)):
            w[r.randrange(len(w))] = f"e{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near(docs_of, odd_rows, k):
    rows = [(100 + i, t) for i, t in edits(k, 150)] + odd_rows
    got = near_dedup.near_dedup(docs_of(rows, extra=True), k).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows, k)
    assert near_dedup.near_dedup(docs_of([])).count() == 0


def test_near_large_group_of_loose_copies(docs_of):
    """Many links fall below the threshold, and the group hangs together by chains."""
    rows = edits(3, 300, 100, 7)
    got = near_dedup.near_dedup(docs_of(rows), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows, 2)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def template(n, words, edits):
    """Loose copies of one text: most pairs are near the threshold."""
    r = random.Random(0)
    out = []
    for i in range(n):
        w = [f"t{j}" for j in range(words)]
        for at in r.sample(range(words), edits):
            w[at] = f"e{r.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_loose_copies_make_pairs_in_proportion(docs_of, monkeypatch):
    seen, real = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    pairs = {}
    for n in (150, 600):
        rows = template(n, 150, 4)
        seen.clear()
        got = {g.doc_id: g.component_id for g in near_dedup.near_dedup(docs_of(rows), k=2).collect()}
        pairs[n] = sum(seen)
        assert got == {i: c for i, _, c, _ in near_brute(rows, 2)}
    assert pairs[600] <= 1.3 * 4 * pairs[150] < 10 * 600
