"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its lines that have a word. Suffixes of all sequences get ranks by their first 1, 2, 4, ... lines: a round sorts
the pairs (rank of the first half, rank of the second half) and numbers them in order. Only suffixes that share their prefix with another one go on to the next round, and
rounds end when no two suffixes share a rank: after about the logarithm of the longest repeated run. Ranks at a depth between two powers come from overlapping halves.

Suffixes of one rank at depth MIN_LINES are an interval of the suffix array whose longest common prefix is MIN_LINES or more; its first place, in order of (doc_id, line), is the
original. Every later place is paired with it, and the longest common prefix of the two follows from the round ranks, largest round first: while the ranks at
the present offset agree, the offset grows by the round's depth. Pairs that go on from a pair one line before are dropped, so what is left are the maximal repeated runs: stretches that agree with
the first place of their opening lines and can be extended neither way. A run of fewer lines counts as well if it has MIN_WORDS words. All lines of these runs are deleted: every copy but the first.
Inside one document the opening lines of a copy must not overlap the original's: "a a a b" has no copy of "a a", and "a a a a" has one, lines 2 and 3.

A pair of ranks that very many suffixes share costs no single task: pairs are counted with partial sums, only distinct pairs are sorted, ranks return
by a join whose large keys Spark splits, and an original with very many copies is looked up in several salted copies.

Nulls and edge cases: a null text has no lines and gives an empty kept_text; lines without a word belong to no run and are kept; lines are equal if their bytes are; runs do not cross documents; null doc_ids come after all others;
rows that share a doc_id are no earlier copies of each other at the same line or at one so near that both would overlap in one text; equal rows (doc_id and text) are ranked once and get the same result each; empty tables give an empty result;
other columns are carried along whatever their names are, and NEW replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.llm._store import materialize
from ledgerloom.llm._text import texts
from ledgerloom.sources.session import ensure_importable

MIN_LINES, MIN_WORDS = 2, 50
LAST = (1 << 63) - 1
#: Copies of one original that a salted part looks up.
SPLIT = 10_000
NEW = ("n_lines", "n_removed", "removed", "runs", "kept_text")
PLACE = ["_d", "_k", "seq"]
RUNS = "array<struct<start:int,length:int,first_doc:bigint,first_start:int>>"


def keyed(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), _d, the place of the document in order, and _k, a hash that tells rows of one doc_id apart."""
    row = F.struct(*(docs[c] for c in docs.columns if c not in NEW)).alias("row")
    return docs.select(row, F.coalesce("doc_id", F.lit(LAST)).alias("_d"), F.xxhash64("doc_id", "text").alias("_k"))


def line_ids(docs: DataFrame, min_lines: int) -> DataFrame:
    """_d, _k, seq, id, ahead: one row for each line with a word; seq counts these. ahead: the words of the first 1, 2, ... min_lines - 1 lines from here, as far as there are so many lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, seq, ids, ahead = [], [], [], []
            for i, raw in enumerate(texts(batch.column(2))):
                found = [x for x in raw.split(b"\n") if x.strip()]
                who += [i] * len(found)
                seq += range(len(found))
                ids += [xxhash.xxh3_64_intdigest(x) for x in found]
                words = [len(x.split()) for x in found]
                ahead += [np.cumsum(words[n : n + min_lines - 1]).tolist() for n in range(len(found))]
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(seq, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(ahead, pa.list_(pa.int32()))], [*PLACE, "id", "ahead"])

    lines = materialize(docs.select("_d", "_k", "row.text").mapInArrow(run, "_d long, _k long, seq int, id long, ahead array<int>"), "line-ids")
    twice = lines.where("seq = 0").groupBy("_d", "_k").agg(F.count("*").alias("n")).where("n > 1")
    return lines if twice.isEmpty() else materialize(lines.dropDuplicates(PLACE), "line-ids")


def ordered_ranks(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys (distinct in `by`) with _rank: numbers that grow in sorted order, by range and place in the range, so that no task sees them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(nth, nth + batch.num_rows))], [*batch.schema.names, "_rank"])
            nth += batch.num_rows

    return keys.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("_rank", T.LongType())]))


def ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Suffixes that share `by` with another: PLACE, ahead, rank, first (place of the first among equals) and copies (how many they are)."""
    groups = pairs.groupBy(*by).agg(F.min(F.struct("_d", "seq", "_k")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return pairs.select(*PLACE, "ahead", *by).join(ordered_ranks(groups, by), by).select(*PLACE, "ahead", F.col("_rank").alias("rank"), "first", "copies")


def deeper(ranks: DataFrame, step: int) -> DataFrame:
    """Suffixes ranked `step` lines deeper than ranks, if these are as deep as step or more."""
    onward = ranks.select("_d", "_k", (F.col("seq") - step).alias("seq"), F.col("rank").alias("after"))
    return ranked(ranks.join(onward, PLACE), ["rank", "after"])


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """One written table a round: the suffixes that share their first 1, 2, 4, ... lines with another, until there are none."""
    rounds, now = [], materialize(ranked(lines, ["id"]), "line-suffixes")
    while not now.isEmpty():
        rounds.append(now)
        now = materialize(deeper(now, 1 << len(rounds) - 1), "line-suffixes")
    return rounds


def at_depth(rounds: list[DataFrame], depth: int) -> DataFrame | None:
    """Suffixes that share their first `depth` lines with another, ranked by them."""
    below = depth.bit_length() - 1
    if below >= len(rounds):
        return None
    return deeper(rounds[below], depth - (1 << below)) if depth > 1 << below else rounds[below]


def openings(rounds: list[DataFrame], min_lines: int, min_words: int | None) -> DataFrame | None:
    """PLACE of suffixes that have an earlier copy of min_lines lines, or of fewer lines with min_words words, and the first such place (td, tk, tseq). In one document the copy of these opening lines begins behind the original's last."""
    other, apart = F.col("_d") > F.col("first._d"), F.col("seq") - F.col("first.seq")
    found = None
    for depth in range(min_lines if min_words is None else 1, min_lines + 1):
        if (ranks := at_depth(rounds, depth)) is None:
            continue
        if depth < min_lines:
            ranks = ranks.where((F.size("ahead") >= depth) & (F.element_at("ahead", depth) >= min_words))
        part = ranks.where(other | (apart >= depth)).select(*PLACE, F.col("first._d").alias("td"), F.col("first._k").alias("tk"), F.col("first.seq").alias("tseq"), "copies")
        found = part if found is None else found.unionByName(part)
    return found


def maximal_runs(lines: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """PLACE, td, tk, tseq, length: repeated runs that agree with the first place of their opening lines and can be extended neither way."""
    rounds = suffix_ranks(lines)
    found = openings(rounds, min_lines, min_words)
    pair = [*PLACE, "td", "tk", "tseq"]
    if found is None:
        return lines.where("false").select(*PLACE, F.col("_d").alias("td"), F.col("_k").alias("tk"), F.col("seq").alias("tseq"), F.col("seq").alias("length"))
    found = materialize(found.groupBy(*pair).agg(F.max("copies").alias("copies")), "line-openings")
    before = found.select("_d", "_k", (F.col("seq") + 1).alias("seq"), "td", "tk", (F.col("tseq") + 1).alias("tseq"))
    parts = F.ceil(F.col("copies") / SPLIT).cast("int")
    now = found.join(before, pair, "left_anti").select(*pair, F.lit(0).alias("length"), parts.alias("parts"))
    now = now.withColumn("part", F.pmod(F.xxhash64(*PLACE), "parts").cast("int"))
    for i in reversed(range(len(rounds))):
        now = materialize(now, "line-runs")
        onward: Column = F.col("seq") + F.col("length")
        asked = now.select("td", "tk", (F.col("tseq") + F.col("length")).alias("ty"), "parts").distinct()
        there = rounds[i].select(F.col("_d").alias("td"), F.col("_k").alias("tk"), F.col("seq").alias("ty"), F.col("rank").alias("there"))
        there = asked.join(there, ["td", "tk", "ty"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        here = rounds[i].select("_d", "_k", F.col("seq").alias("y"), F.col("rank").alias("here"))
        now = now.withColumn("y", onward).withColumn("ty", F.col("tseq") + F.col("length")).join(here, ["_d", "_k", "y"], "left").join(there, ["td", "tk", "ty", "part"], "left")
        grown = F.when(F.col("here") == F.col("there"), F.lit(1 << i)).otherwise(0)
        now = now.select(*pair, (F.col("length") + grown).alias("length"), "parts", "part")
    return now.select(*pair, "length")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """docs with runs (the maximal ones: first line and number of lines, counting lines with a word from 0, and where they stand first), removed (line numbers from 0), n_lines (those with a word), n_removed and kept_text.

    min_words None: runs of min_lines lines or more only.
    """
    ensure_importable(docs.sparkSession)
    docs = keyed(docs)
    found = maximal_runs(line_ids(docs, min_lines), min_lines, min_words)
    one = F.struct(F.col("seq").alias("start"), "length", F.when(F.col("td") != LAST, F.col("td")).alias("first_doc"), F.col("tseq").alias("first_start"))
    listed = found.groupBy("_d", "_k").agg(F.sort_array(F.collect_list(one)).cast(RUNS).alias("runs"))  # no more than a document has lines
    both = docs.join(listed, ["_d", "_k"], "left").select("row", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    made = {"n_lines": (pa.int64(), "long"), "n_removed": (pa.int64(), "long"), "removed": (pa.list_(pa.int32()), "array<int>"), "kept_text": (pa.string(), "string")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, runs in zip(texts(batch.column(0).field("text")), batch.column(1).to_pylist()):
                split = raw.split(b"\n")
                worded = [n for n, x in enumerate(split) if x.strip()]
                drop = {worded[i] for r in runs for i in range(r["start"], r["start"] + r["length"])}
                kept = b"\n".join([x for n, x in enumerate(split) if n not in drop]) if drop else raw
                rows.append((len(worded), len(drop), sorted(drop), kept.decode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], t) for i, (t, _) in enumerate(made.values()))], ["row", "runs", *made])

    schema = T.StructType([*both.schema.fields, *(T.StructField(c, T._parse_datatype_string(t)) for c, (_, t) in made.items())])
    return both.mapInArrow(run, schema).select("row.*", *NEW)
