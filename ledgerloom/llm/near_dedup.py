"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures.

A document is the set of its distinct K-word shingles, ASCII letters lower-cased. Documents with equal sets form a class; all further work is on classes.
A class has a signature of CHUNKS * SYMBOLS b-bit minima (16 bits each). By the pigeonhole principle two signatures that differ in fewer than CHUNKS * 2
symbols have a chunk with at most one differing symbol, so every class is entered under each chunk with each of its
symbols left out: this finds all pairs within signature distance 2 * CHUNKS - 1. A pair of sets of similarity 0.8 is
missed with a probability below 4e-6: each chunk agrees but for one symbol with probability 0.655.

A pair of a common bucket is a candidate if its set sizes allow the similarity, 64 symbols of the two signatures, 4 bits of each,
lie within a Hamming distance that a similar pair exceeds with a probability below 1e-6, and so do parities: for each of 512 ranges of shingle hashes a set has a bit that tells whether it has an odd
number of them, and two sets differ in at least as many shingles as bits, which is exact. Candidates are confirmed on the full sets: linked if PERCENT_DEN * intersection >= PERCENT * union.

Pairs inside a group are not spelled out. Of buckets that hold the same classes one is kept. First each class meets the centres of its buckets with which it shares the most entries; the links found are turned into components. Then come
ROUNDS rounds: in every bucket that had several components, classes in order of one part of their signatures meet the next REACH ones of another component, and of all
its candidates a class takes the PARTNERS nearest; components are merged after each round, so a group that merges stops making pairs. What remains are classes with a candidate of another
component. These meet by the rarest shingles of their full sets: similar sets share one of their first fifth, at places that leave enough to have in common. Such pairs are confirmed too, so
no link between components is lost.

Nulls and edge cases: a null text has the empty set, is linked with nothing and is kept; fewer than K words are one shingle; null doc_ids take part, but no component is named after them unless it has no other; rows
with the same doc_id and text are one document; rows with one doc_id and several texts are judged each; ties of similarity count as links; empty tables give an empty result; only
doc_id and text are read. Sets are told apart by a 64-bit hash: n distinct sets merge wrongly n^2 / 2^65 times on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm._store import materialize
from ledgerloom.llm._text import WordHashes, mixed, shingles, texts
from ledgerloom.llm.components import components
from ledgerloom.sources.session import ensure_importable

CHUNKS, SYMBOLS = 12, 6
K, PERCENT = 5, 80
CENTRES = 3
SEED = 41
LANES = 64
WORDS = ("b0", "b1", "b2", "b3")
PARITY = tuple(f"p{i}" for i in range(8))
MARKS = (*WORDS, *PARITY)
ROUNDS, REACH, PARTNERS = 4, 4, 4
LOW = 0x1111111111111111
ROWS = 1 << 14


def shingle_set(raw: bytes, k: int, table: WordHashes) -> np.ndarray:
    return np.unique(shingles(table.of(raw.lower().split()), k))


def families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    size = CHUNKS * SYMBOLS
    draw = lambda: rng.integers(0, 1 << 63, size, np.uint64, endpoint=True) * np.uint64(2) + np.uint64(1)
    return draw()[:, None], draw()[:, None]


def signature(items: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
    """CHUNKS * SYMBOLS 16-bit minima of a set that isn't empty."""
    least = None
    for at in range(0, len(items), ROWS):
        part = ((items[None, at : at + ROWS] ^ add) * times).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def entries(signatures: np.ndarray) -> np.ndarray:
    """For each signature (a row) its CHUNKS * SYMBOLS bucket keys: each chunk without each of its symbols."""
    parts = signatures.reshape(len(signatures), CHUNKS, SYMBOLS).astype(np.uint64)
    out = np.empty((len(signatures), CHUNKS, SYMBOLS), np.uint64)
    for gap in range(SYMBOLS):
        key = mixed(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(SYMBOLS) + np.uint64(gap))[None, :]
        for j in range(SYMBOLS):
            if j != gap:
                key = mixed(key ^ parts[:, :, j])
        out[:, :, gap] = key
    return out.reshape(len(signatures), -1)


def lanes(symbols: np.ndarray) -> np.ndarray:
    """4 bits of each of the first LANES symbols, in four signed numbers."""
    part = (symbols[:LANES] & 15).astype(np.uint8)
    return (part[::2] << 4 | part[1::2]).view(np.int64)


def parities(items: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * len(PARITY) ranges of hashes, in signed numbers: whether the set has an odd number of them."""
    odd = np.bincount((items >> np.uint64(55)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def farthest(percent: int) -> int:
    """How many lanes may differ: 5.7 deviations above the mean of pairs of this similarity."""
    q = (1 - percent / 100) * 15 / 16
    return int(LANES * q + 5.7 * (LANES * q * (1 - q)) ** 0.5)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, _k, n_shingles, c (the class; null for the empty set), MARKS, sig of every row."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (add, times) = WordHashes(), families()
        for batch in batches:
            sizes, classes, parts, sigs = [], [], [], []
            for raw in texts(batch.column(2)):
                items = shingle_set(raw, k, table)
                sizes.append(len(items))
                classes.append(xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63) if len(items) else None)
                symbols = signature(items, add, times) if len(items) else None
                parts.append(np.zeros(len(MARKS), np.int64) if symbols is None else np.concatenate((lanes(symbols), parities(items))))
                sigs.append(None if symbols is None else symbols.tobytes())
            words = [pa.array(w) for w in np.array(parts, np.int64).reshape(-1, len(MARKS)).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *words, pa.array(sigs, pa.binary())], ["doc_id", "_k", "n_shingles", "c", *MARKS, "sig"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), "text").mapInArrow(run, f"doc_id long, _k long, n_shingles long, c long, {', '.join(f'{m} long' for m in MARKS)}, sig binary")


def bucket_members(classes: DataFrame) -> DataFrame:
    """key, centre, c: for each bucket with several classes its smallest class and each other one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                found = entries(sigs)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), found.shape[1]))], ["key", "c"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch in batches:
            key, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            first[0] = last is None or key[0] != last
            start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            centres = np.where(start >= 0, c[start], 0 if centre is None else centre)
            last, centre = key[-1], centres[-1]
            rest = ~first
            yield pa.RecordBatch.from_arrays([pa.array(key[rest]), pa.array(centres[rest]), pa.array(c[rest])], ["key", "centre", "c"])

    # sorted rows are read as a stream: a very large bucket needs no memory
    return classes.select("c", "sig").mapInArrow(keys, "key long, c long").repartition("key").sortWithinPartitions("key", "c").mapInArrow(runs, "key long, centre long, c long")


def confirmed(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sets = WordHashes(), {}

        def of(c: int, raw: bytes) -> np.ndarray:
            if c not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[c] = shingle_set(raw, k, table)
            return sets[c]

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                good = []
                for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), texts(batch.column(3))):
                    p, q = of(a, x), of(b, y)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    body = lambda c: bodies.select(F.col("c").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(body("a"), "a").join(body("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def part(end: str | Column, name: str) -> Column:
    """A field of a signature, which is a struct or whose columns have this ending."""
    return F.col(f"{name}{end}") if isinstance(end, str) else end[name]


def apart(one: str | Column, other: str | Column) -> Column:
    """How many lanes (WORDS) differ between two signatures."""
    total = F.lit(0)
    for w in WORDS:
        x = part(one, w).bitwiseXOR(part(other, w))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(LOW)))
    return total


def able(one: str | Column, other: str | Column, percent: int) -> Column:
    """Whether sizes (n), signature lanes and parities of two sets allow them to be similar enough."""
    n, m = part(one, "n"), part(other, "n")
    odd = sum((F.bit_count(part(one, w).bitwiseXOR(part(other, w))) for w in PARITY), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (odd * (100 + percent) <= (n + m) * (100 - percent)) & (apart(one, other) <= farthest(percent))


def prefixes(bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """c, h, at, size: the first shingles of each set, the rarest among all these sets first, by place.

    Two sets as similar as percent have a shingle in common among the first size - ceil(percent of size) + 1 of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(raw, k, table) for raw in texts(batch.column(1))]
                long = np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), long)), pa.array(np.repeat(long, long))], ["h", "c", "size"])

    seen = bodies.select("c", "text").mapInArrow(run, "h long, c long, size long")
    counts = seen.groupBy("h").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy("c").orderBy("df", "h")) - 1
    first = F.col("size") - F.ceil(F.col("size") * percent / 100 - 1e-9)
    return seen.join(counts, "h").withColumn("at", order).where(F.col("at") <= first).select("c", "h", "at", "size")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component) after the links a, b. Components are named after their smallest node."""
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"g{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
    joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left_anti").withColumn("component", F.col("node"))
    return materialize(groups.unionByName(ends).join(joined, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "near-groups", lean=True)


def unlike(every: DataFrame) -> DataFrame:
    """key, c, size (other classes of the bucket), alike: of all buckets with the same classes the one with the smallest key; alike tells how many they are.

    Such buckets give the same candidates. Classes are compared by their number and two 64-bit hashes.
    """
    both = (F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(SEED))).alias("y"))
    shapes = every.groupBy("key").agg((F.count("*") - 1).alias("size"), *both)
    kept = materialize(shapes.groupBy("x", "y", "size").agg(F.min("key").alias("key"), F.count("*").alias("alike")).select("key", "size", "alike"), "near-shapes", lean=True)
    return materialize(every.join(kept, "key"), "near-unlike", lean=True)


def labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (key, c and more) with g, the component of c."""
    return rows.join(groups.select(F.col("node").alias("c"), F.col("component").alias("g")), "c", "left").withColumn("g", F.coalesce("g", "c"))


def still_split(rows: DataFrame) -> DataFrame:
    """The rows of the buckets that have classes of several components."""
    split = rows.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi")
    return rows.join(split, "key", "left_semi")


def neighbours(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """a, b: candidates of different components that stand near each other in their bucket, in order of the signature's word number `turn`; for each class the nearest."""
    word = WORDS[turn % len(WORDS)]
    # the word's first lanes divide a bucket that very many classes share
    order = Window.partitionBy("key", F.shiftrightunsigned(f"{word}_1", 56)).orderBy(f"{word}_1", "c")
    other = F.struct("c", "g", *(F.col(f"{x}_1").alias(x) for x in ("n", *MARKS)))
    # what can't be similar is dropped before it becomes a row: an entry whose neighbours are of its own component makes none
    likely = lambda o: (o["g"] != F.col("g")) & able("_1", o, percent)
    ahead = rows.withColumn("ahead", F.array(*(F.lead(other, i).over(order) for i in range(1, REACH + 1))))
    found = ahead.select("c", F.transform(F.filter("ahead", likely), lambda o: F.struct(o["c"].alias("d"), apart("_1", o).alias("apart"))).alias("ahead"))
    pairs = found.select("c", F.inline("ahead")).select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "apart").distinct()
    nearest = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))  # a class has CHUNKS * SYMBOLS * REACH candidates at most after, and as many before it
    return pairs.withColumn("_r", nearest).where(F.col("_r") <= PARTNERS).select("a", "b")


def linked_classes(docs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """node, component: every class that is linked with another one."""
    known = sketches.where("c is not null")
    classes = known.groupBy("c").agg(F.min(F.struct("doc_id", "_k")).alias("rep"), F.first("n_shingles").alias("n"), *(F.first(w).alias(w) for w in MARKS), F.first("sig").alias("sig"))
    members = materialize(bucket_members(classes), "near-members", lean=True)
    wanted = members.select(F.explode(F.array("centre", "c")).alias("c")).distinct()
    needed = materialize(classes.join(wanted, "c").select("c", "n", *MARKS, F.col("rep.doc_id").alias("_id"), F.col("rep._k").alias("_k")), "near-classes", lean=True)
    named = lambda c, end: needed.select(F.col("c").alias(c), *(F.col(x).alias(f"{x}{end}") for x in ("n", *MARKS)))
    held = docs.select(F.col("doc_id").alias("_id2"), F.xxhash64("doc_id", "text").alias("_k"), "text")
    bodies = held.join(needed.select("c", "_id", "_k").hint("shuffle_hash"), (needed["_k"] == held["_k"]) & needed["_id"].eqNullSafe(held["_id2"])).select("c", "text")
    bodies = materialize(bodies, "near-texts")  # a row for each class, more only for repeated rows

    # the centre of a bucket is its class with the most company over all its buckets: of a group of copies the least edited one
    every = unlike(members.select("key", "c").unionByName(members.select("key", F.col("centre").alias("c")).distinct()))
    rank = materialize(every.groupBy("c").agg(F.sum(F.col("size") * F.col("alike")).alias("company")), "near-company", lean=True)
    every = materialize(every.join(rank, "c").select("key", "c", "alike", "company"), "near-buckets", lean=True)
    centres = every.groupBy("key").agg(F.max(F.struct("company", "c")).alias("top"))
    shared = every.join(centres, "key").where(F.col("c") != F.col("top.c")).groupBy(F.col("top.c").alias("a"), F.col("c").alias("b")).agg(F.sum("alike").alias("n"), F.max("top.company").alias("company"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), F.desc("company"), "a"))  # a class has CHUNKS * SYMBOLS entries at most
    first = shared.withColumn("_r", best).where(F.col("_r") <= CENTRES).select("a", "b").join(named("a", "_1"), "a").join(named("b", "_2"), "b")
    tested = materialize(first.where(able("_1", "_2", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs", lean=True)
    one = bodies.dropDuplicates(["c"])
    links = materialize(confirmed(tested, one, k, percent), "near-links", lean=True)
    groups = materialize(components(links), "near-groups", lean=True)

    rows = materialize(still_split(labelled(every.select("key", "c"), groups)).join(named("c", "_1"), "c"), "near-open", lean=True)
    for turn in range(ROUNDS):
        pairs = materialize(neighbours(rows, turn, percent).join(tested, ["a", "b"], "left_anti"), "near-pairs", lean=True)
        tested = tested.unionByName(pairs)
        links = materialize(confirmed(pairs, one, k, percent), "near-links", lean=True)
        if links.isEmpty():
            break
        groups = merged(groups, links)
        # a bucket of one component makes no pairs, so it is not taken out before the last round
        rows = materialize(labelled(rows.drop("g"), groups), "near-open", lean=True)

    rows = materialize(still_split(rows), "near-open", lean=True)
    other = rows.select("key", F.col("g").alias("h"), *(F.col(f"{x}_1").alias(f"{x}_2") for x in ("n", *MARKS)))
    company = (rows["key"] == other["key"]) & (F.col("g") != F.col("h")) & able("_1", "_2", percent)
    still = materialize(rows.join(other, company, "left_semi").select("c", "g", "n_1", *(f"{w}_1" for w in MARKS)).distinct(), "near-able", lean=True)

    first_ones = prefixes(still.select("c").join(one, "c"), k, percent).join(still, "c")
    rows = materialize(first_ones, "near-prefixes", lean=True)
    other = rows.select("h", F.col("c").alias("d"), F.col("g").alias("f"), F.col("at").alias("at_2"), *(F.col(f"{x}_1").alias(f"{x}_2") for x in ("n", *MARKS)))
    # if this is the first shingle in common, what follows in both is all that can be
    most = 1 + F.least(F.col("n_1") - F.col("at") - 1, F.col("n_2") - F.col("at_2") - 1)
    enough = 100 * most >= percent * (F.col("n_1") + F.col("n_2") - most)
    between = (rows["h"] == other["h"]) & (F.col("g") < F.col("f")) & enough & able("_1", "_2", percent)
    rest = rows.join(other, between).select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
    rest = materialize(rest.join(tested, ["a", "b"], "left_anti"), "near-pairs", lean=True)
    return merged(groups, materialize(confirmed(rest, one, k, percent), "near-links", lean=True))


def near_dedup(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, _k (hash of doc_id and text), n_shingles, component_id, kept and group (of linked rows; null without shingles) of every row of docs."""
    sketches = materialize(sketch(docs, k), "near-sketches")
    groups = linked_classes(docs, sketches, k, percent).select(F.col("node").alias("c"), F.col("component").alias("g"))
    rows = sketches.select("doc_id", "_k", "n_shingles", "c").join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
    least = rows.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("_least"))
    out = rows.join(least, "g", "left").withColumn("component_id", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("_least")))
    return out.select("doc_id", "_k", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("g").alias("group"))
