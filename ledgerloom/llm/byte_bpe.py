"""Byte-level BPE by monoid tree reduction.

A segment of bytes stands for its BPE token sequence. Sequences are joined like elements of a monoid: a long segment is cut in halves,
each half is encoded recursively, and the neighbours are joined by re-encoding a window around the seam. A token sequence
is the BPE encoding of its bytes exactly when each adjacent pair of its tokens is the encoding of the pair's own bytes (the first
merge across a boundary would also happen in that pair alone), so the join stops as soon as the window's outer tokens pass that test
against their outer neighbours; until then the window doubles on the side that fails. Decoding concatenates byte strings up a tree.

The text is first split by the tokenizer's pattern; every match is encoded separately, and one that is itself in the vocabulary is that token.

Nulls and edge cases: a null or empty text gives no ids and empty bytes; texts and matches of any length are handled whole, a match of n bytes in O(n log n) per tree level; repeated rows are encoded each;
null doc_ids are carried; empty tables give an empty result; other columns are carried along, `token_ids` and `decoded` replace columns of those names.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from ledgerloom.sources.session import ensure_importable

LEAF = 16
CACHE = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Codec:
    """Encoder and decoder of one vocabulary, with bounded caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Merges in order of rank, leftmost first, over a linked list with a heap."""
        ranks, n = self.ranks, len(raw)
        if n < 2:
            return [ranks[raw]] if raw else []
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at i, ends at end[i]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (j := end[i]) >= n or gone[j] or end[j] != stop:
                continue
            gone[j] = 1
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(raw[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their joint bytes."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.table[a] + self.table[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of a and b together."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.merge(b"".join([self.table[t] for t in a[len(a) - i :]] + [self.table[t] for t in b[:j]]))
            left = i == len(a) or self.stable(a[-i - 1], window[0])
            right = j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def tree(self, raw: bytes) -> list[int]:
        """Halves, recursively."""
        if len(raw) <= LEAF:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode()
        known = self.ranks.get(raw)
        ids = (known,) if known is not None else tuple(self.tree(raw))
        if len(raw) <= 64:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> array:
        """Ids of a text. Matches are barriers: across them the join is plain concatenation."""
        out, known = array("i"), self.pieces.get
        for p in self.pattern.findall(text):
            out.extend(known(p) or self.piece(p))
        return out

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join([self.table[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def byte_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """docs with token_ids (array<int>) and decoded (binary, from the ids)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = docs.drop("token_ids", "decoded")
    vocabulary, where = spark.sparkContext.broadcast(ranks), docs.columns.index("text")  # the vocabulary's size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, ends, plain = array("i"), [0], []
                for text in batch.column(where).to_pylist():
                    own = codec.encode(text or "")
                    plain.append(codec.decode(own))
                    ids.extend(own)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(plain, pa.binary())], [*batch.schema.names, "token_ids", "decoded"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))
