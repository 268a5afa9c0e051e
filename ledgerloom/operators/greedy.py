"""Greedy consumption without a loop over rows: deferred acceptance in rounds, and components of what can compete.

"In row order each G row takes its first free candidate" is the stable matching where every P row prefers the smaller G row. So all G rows ask at once for the best candidate that they may still get, a P row holds the smallest
that asks, the others ask on; the order of asking doesn't change the outcome. Equal G rows (a class) have one candidate list between them. The n-th of a class can't end before the n-th
entry of the list, nor before or at the place of the one before it, so a class asks for different entries from the start: K copies against K copies need one round and K entries, not K rounds and K * K pairs.

Where a step depends on how many candidates are free, rows are dealt by connected component instead: rows of different components never compete.

A round costs some jobs over all rows, so most rows don't take part (matched): two classes that only have each other are numbered through, small components are read in row order, each in its task, and rounds are left for large ones.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators import scan
from ledgerloom.operators.ordered import in_groups
from ledgerloom.sources.store import materialize, remove

#: Rows and list entries of a component that is read in one task.
BLOCK = 100_000


def classed(rows: DataFrame, values: list[str], row: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Classes of rows with equal values: name (the smallest row), values; and members: row, name. Rows with a null among the values are left out."""
    rows = materialize(rows, "values").dropna(subset=values)  # values are computed once, not for the filter as well
    found = materialize(rows.groupBy(*values).agg(F.min("row_idx").alias(name)), "classes")
    return found, materialize(rows.join(found, values).select(F.col("row_idx").alias(row), name), "members")


def first_come(members: DataFrame, lists: DataFrame, order: list[str | Column]) -> DataFrame:
    """g_idx, p_idx: in order of g_idx each G row takes the first free P row of its class's list.

    members: g_idx, c (the class; it may have one member). lists: c, p_idx and what `order` names, without repeats; ties go by p_idx. Each round is a written table; rounds end when nobody is turned away.
    """
    lists, members = materialize(lists, "lists"), materialize(members, "members")
    listed = materialize(scan.numbered(lists, ["c"], [*order, "p_idx"], "pos").select("c", "pos", "p_idx"), "lists")
    asking = scan.numbered(members, ["c"], ["g_idx"], "nth").select("g_idx", "c", "nth", F.col("nth").alias("pos"))
    before = None
    while True:
        held = asking.join(listed, ["c", "pos"])  # who has come to the end of the list drops out
        taken = held.groupBy("p_idx").agg(F.min("g_idx").alias("holder"))
        now = materialize(held.join(taken, "p_idx").withColumn("lost", F.col("g_idx") != F.col("holder")), "asked", lean=True)
        if before is not None:
            remove(before)
        before, lost = now, now.where("lost")
        if lost.isEmpty():
            return now.select("g_idx", "p_idx")
        # entries that a smaller row holds are out of reach for the first loser of a class and all behind it: the k-th of these can't end before the k-th entry that is left
        first = lost.groupBy("c").agg(F.min("g_idx").alias("first"), F.min("nth").alias("start"), F.min("pos").alias("left"))
        left = first.join(listed, "c").where(F.col("pos") > F.col("left")).join(now.where("NOT lost").select("p_idx", "holder"), "p_idx", "left").where("holder IS NULL OR holder > first")
        left = scan.numbered(materialize(left.select("c", "pos"), "left"), ["c"], ["pos"], "k").select("c", "k", F.col("pos").alias("least"))
        moved = now.join(first.select("c", "start"), "c", "left").withColumn("k", F.col("nth") - F.col("start") + 1).join(left, ["c", "k"], "left")
        behind = F.coalesce(F.col("k") >= 1, F.lit(False))
        asking = moved.where(~behind | F.col("least").isNotNull()).select("g_idx", "c", "nth", F.when(behind, F.greatest("pos", "least")).otherwise(F.col("pos")).alias("pos"))


def in_order(rows: list[tuple]) -> list[tuple]:
    """g_idx, p_idx of one component, given as (component, kind, a, b, place): kind 0 a pair c, q with its place, 1 a P row q, p_idx, 2 a G row g_idx, c in order of g_idx."""
    pairs, free, members = defaultdict(list), defaultdict(list), []
    for _, kind, a, b, place in rows:
        if kind == 0:
            pairs[a].append((place, b))
        elif kind == 1:
            free[a].append(b)
        else:
            members.append((a, b))
    used, out, lists = set(), [], {}
    for g, c in members:
        if c not in lists:
            lists[c] = iter([p for _, p in sorted((place, p) for place, q in pairs[c] for p in free[q])])
        # what is taken stays taken, so nobody of a class looks at an entry twice
        if (p := next((p for p in lists[c] if p not in used), None)) is not None:
            used.add(p)
            out.append((g, p))
    return out


def matched(g_rows: DataFrame, pairs: DataFrame, p_rows: DataFrame) -> DataFrame:
    """g_idx, p_idx: what first_come() gives where the list of c has the rows of all its q, by place, then p_idx.

    g_rows: g_idx, c; p_rows: p_idx, q (members of classed()); pairs: c, q, place (a double), each pair once.
    """
    pairs = materialize(pairs.select("c", "q", F.col("place").cast("double").alias("place")), "pairs")
    degrees = pairs.groupBy("c").agg(F.count("*").alias("of_c")), pairs.groupBy("q").agg(F.count("*").alias("of_q"))
    counted = materialize(pairs.join(degrees[0], "c").join(degrees[1], "q"), "pairs")
    alone = counted.where("of_c = 1 AND of_q = 1").select("c", "q")
    left = scan.numbered(g_rows.join(alone, "c").select("q", "g_idx"), ["q"], ["g_idx"], "nth")
    right = scan.numbered(p_rows.join(alone, "q").select("q", "p_idx"), ["q"], ["p_idx"], "nth")
    simple = left.join(right, ["q", "nth"]).select("g_idx", "p_idx")

    tangled = materialize(counted.where("of_c > 1 OR of_q > 1").select("c", "q", "place"), "tangled", lean=True)
    if tangled.isEmpty():
        return simple
    found = components(tangled.select((2 * F.col("c")).alias("a"), (2 * F.col("q") + 1).alias("b")))
    of_c = found.where("node % 2 = 0").select(F.shiftright("node", 1).alias("c"), "component")
    of_q = found.where("node % 2 <> 0").select(F.shiftright("node", 1).alias("q"), "component")
    asking = materialize(g_rows.join(of_c, "c").select("component", "g_idx", "c"), "asking")
    offered = materialize(p_rows.join(of_q, "q").select("component", "q", "p_idx"), "offered")
    tied = tangled.join(of_c, "c")
    listed = tied.join(offered.groupBy("q").agg(F.count("*").alias("n")), "q").groupBy("component").agg(F.sum("n").alias("n"))
    sizes = listed.unionByName(asking.groupBy("component").agg(F.count("*").alias("n"))).groupBy("component").agg(F.sum("n").alias("n"))
    large = materialize(sizes.where(F.col("n") > BLOCK).select("component"), "large", lean=True)
    none = F.lit(0.0).alias("place")
    rows = tied.select("component", F.lit(0).alias("kind"), F.col("c").alias("a"), F.col("q").alias("b"), "place")
    rows = rows.unionByName(offered.select("component", F.lit(1).alias("kind"), F.col("q").alias("a"), F.col("p_idx").alias("b"), none)).unionByName(asking.select("component", F.lit(2).alias("kind"), F.col("g_idx").alias("a"), F.col("c").alias("b"), none))
    some = not large.isEmpty()
    small = in_groups(rows.join(large, "component", "left_anti") if some else rows, ["component"], ["kind", "a", "b"], in_order, "g_idx long, p_idx long")
    if not some:
        return simple.unionByName(small)
    lists = tied.join(large, "component").select("c", "q", "place").join(offered.select("q", "p_idx"), "q").select("c", "p_idx", "place")
    return simple.unionByName(small).unionByName(first_come(asking.join(large, "component").select("g_idx", "c"), lists, ["place"]))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): connected components of a, b (longs).

    Every node points at the smallest node that it knows of among its neighbours and their roots; pointers are followed twice a round, so a path of n nodes takes about log n rounds.
    """
    # every edge both ways, and each node with itself; the edges are computed once
    ways = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")))
    both = materialize(edges.select(F.explode(ways).alias("x")).select("x.*").distinct(), "neighbours")
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "roots", lean=True)
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("seen"))
        hooked = roots.join(seen, F.col("node") == F.col("a")).select("root", "seen").where("seen < root").groupBy("root").agg(F.min("seen").alias("seen"))  # a root learns what its nodes have seen
        jumped = roots.join(hooked, "root", "left").select("node", F.coalesce("seen", "root").alias("root"))
        up = jumped.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = materialize(jumped.join(up, "root").select("node", F.col("above").alias("root"), F.lit(0).alias("_")).drop("_"), "roots", lean=True)
        changed = hooked.isEmpty()
        remove(roots)
        roots = after
        if changed:
            break
    return roots.select("node", F.col("root").alias("component"))
