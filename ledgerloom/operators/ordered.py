"""Sequential semantics inside groups: rows of a group reach one function in order, groups are streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.sources.session import ensure_importable

ROWS = 10_000


def in_groups(rows: DataFrame, by: list[str], order: list[str], run: Callable[[list[tuple]], list[tuple]], schema: str, even: bool = False) -> DataFrame:
    """What run() makes of the rows of each group of `by`, given as tuples in `order`.

    Rows are dealt by `by` and sorted, and a task reads its groups one after another: one call into Python costs nothing but itself,
    and memory holds one group of narrow rows. even: run() takes much longer than its few bytes suggest, so shuffle partitions stay tasks of their own.
    """
    ensure_importable(rows.sparkSession)
    at = [rows.columns.index(c) for c in by]
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(fields)], schema=fields)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (k := tuple(row[i] for i in at)) != key:
                    if held:
                        out += run(held)
                    key, held = k, []
                    if len(out) >= ROWS:
                        yield batch_of(out)
                        out = []
                held.append(row)
        if held:
            out += run(held)
        yield batch_of(out)

    tasks = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if even else []
    return rows.repartition(*tasks, *by).sortWithinPartitions(*by, *order).mapInArrow(stream, schema)
