"""SimHash document fingerprints of BITS bits, and the search for all fingerprints within a Hamming radius.

Terms are the words and the 2-word shingles of a text; each distinct term votes with an integer weight that grows with the logarithm of its count
(2-word terms count double) for or against every bit of its hash. Likeness of two fingerprints is the cosine that their share
of differing bits stands for, cos(pi * distance / BITS), and 0 where that is negative.

Search: a fingerprint is cut into radius + 1 blocks; two fingerprints within the radius agree on a whole block, so each of
the permuted tables (one for each leading block) is joined with itself on that block and pairs are confirmed on all bits.
A pair counts in the first table that has it.

Nulls and edge cases: a null text is empty; a text without words has the fingerprint of all zeros; equal texts have equal fingerprints; null doc_ids sort first and are documents like
others; rows that share a doc_id follow each other by text; one row is its own next document; empty tables give an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm._store import materialize
from ledgerloom.llm._text import WordHashes, mixed, shingles
from ledgerloom.sources.session import ensure_importable

BITS = 128
RADIUS = 3
ROWS = 4096


def fingerprint(words: list[bytes], table: WordHashes) -> bytes:
    """BITS bits as bytes."""
    h = table.of(words)
    if not len(h):
        return bytes(BITS // 8)
    votes, total = np.zeros(BITS), 0
    for terms, factor in ((mixed(h), 2), (shingles(h, 2), 4) if len(h) > 1 else (h[:0], 4)):
        terms, counts = np.unique(terms, return_counts=True)
        weights = np.floor(factor * (1 + np.log(counts))).astype(np.float32)
        total += int(weights.sum(dtype=np.float64))
        for at in range(0, len(terms), ROWS):  # small integers: float32 sums of a slice are exact
            part = terms[at : at + ROWS]
            bits = np.unpackbits(np.column_stack((part, mixed(part))).view(np.uint8).reshape(len(part), -1), axis=1)
            votes += weights[at : at + ROWS] @ bits.astype(np.float32)
    return np.packbits(2 * votes > total).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    distance = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return 1.0 if not distance else max(0.0, float(np.cos(np.pi * distance / BITS)))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and its next document in order of doc_id.

    Documents are dealt by ranges of doc_id and sorted within them, so the next document is the next row. A range gives three kinds of rows: 0
    results, 1 its first and 2 its last document; the last ones are then met by the first document of the next range that has any.
    """
    ensure_importable(docs.sparkSession)
    arrow = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows(pairs: list, table: WordHashes, known: dict) -> Iterator[tuple]:
        import hashlib

        def of(text: str) -> bytes:
            if text not in known:
                known.clear()  # the next row's text is asked for once more, others are not
                known[text] = fingerprint(text.encode().split(), table)
            return known[text]

        for doc_id, text, following in pairs:
            own = of(text)
            new = edited(text, following)
            changed = fingerprint(new.encode().split(), table)
            yield 0, None, doc_id, None, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, of(following))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, part, last = WordHashes(), {}, TaskContext.get().partitionId(), None
        end = lambda kind, row: (kind, part, *row, *[None] * 6)
        for batch in batches:
            found, pairs = [], []
            for row in zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist())):
                if last is None:
                    found.append(end(1, row))
                else:
                    pairs.append((*last, row[1]))
                last = row
            yield batch_of([*found, *rows(pairs, table, known)])
        if last is not None:
            yield batch_of([end(2, last)])

    def at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            yield batch_of(list(rows(list(zip(*(batch.column(i).to_pylist() for i in range(3)))), table, {})))

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = materialize(ranged.mapInArrow(in_range, SCHEMA), "simhash-ranges")
    firsts = made.where("kind = 1").select("part", "text")
    order = Window.partitionBy().orderBy("part")  # one small row a range
    follow = made.where("kind = 1").select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    ends = made.where("kind = 2").select("part", "doc_id", "text").join(follow, "part")
    ends = ends.join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select("doc_id", "text", "following")
    return made.where("kind = 0").unionByName(ends.mapInArrow(at_ends, SCHEMA)).drop("kind", "part", "text")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal fingerprints."""
    at = [F.bit_count(F.conv(F.substring(a, i, 16), 16, -10).cast("long").bitwiseXOR(F.conv(F.substring(b, i, 16), 16, -10).cast("long"))) for i in range(1, BITS // 4, 16)]
    return sum(at[1:], at[0])


def neighbours(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b, distance: all pairs a < b of distinct values of column fingerprint within the radius."""
    blocks, digits = radius + 1, BITS // 4
    edge = [digits * i // blocks for i in range(blocks + 1)]
    cut = lambda c, i: F.substring(c, edge[i] + 1, edge[i + 1] - edge[i])
    one = prints.select("fingerprint").where("fingerprint is not null").distinct()
    tables = one.select("fingerprint", F.posexplode(F.array(*(cut("fingerprint", i) for i in range(blocks)))).alias("table", "block"))
    a, b = (tables.withColumnRenamed("fingerprint", c) for c in "ab")
    earlier = F.coalesce(*(F.when((cut("a", i) == cut("b", i)) & (F.col("table") > i), True) for i in range(blocks)), F.lit(False))
    pairs = a.join(b, ["table", "block"]).where(F.col("a") < F.col("b")).where(~earlier)
    return pairs.select("a", "b", distance(F.col("a"), F.col("b")).cast("int").alias("distance")).where(F.col("distance") <= radius)


def with_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints with n_links: how many other distinct fingerprints lie within the radius."""
    pairs = neighbours(prints, radius)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    return prints.join(ends, "fingerprint", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
