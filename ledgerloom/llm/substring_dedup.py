"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words of one document. Every window has an anchor: the leftmost of its GRAM-word grams whose hash is smallest, so equal windows
have equal anchors at equal offsets. Neighbouring windows mostly share their anchor; such a stretch is one index entry with the anchor's hash fp and
a second hash ctx of all its words: a thirteenth as many entries as windows, and still no window is left out.

The index is a list of immutable runs with one entry for each distinct (fp, ctx): its first document in order of doc_id. A run is bucketed by fp and sorted by (fp, ctx). A batch of new
documents is merge-joined with each run, bucket by bucket: no run is dealt out again, and only entries whose fp the batch has come back. Batch and hits are then merged in one pass over fp:
- an entry of the batch whose (fp, ctx) stands in an earlier document is covered as a whole;
- where one fp has several ctx, the stretches agree in part at most; their first documents are verified.
Verification reads these texts again and compares single windows by two hashes of all their words, from independent families. The batch's first entries make a new
run; when there are more than MAX_RUNS, they are compacted into one. A manifest in the index's folder names the runs, so a later session can go on. Batches must come in order of doc_id.

Everything is streamed in sorted order or summed: an fp that very many rows share needs neither a group in memory nor pairs. An fp with more than HOT entries in a batch is dealt by ctx, with all its first
documents verified, and its windows are compared by partial minima instead of one sorted stream.

Nulls and edge cases: a null text has no words; documents of fewer words than a window keep all; null doc_ids come after all others, and rows of one doc_id
(repeated ones, too) never cover each other; repeats inside a document stay; empty tables give an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm._store import materialize, new_path, remove
from ledgerloom.llm._text import WordHashes, mixed, texts
from ledgerloom.sources.session import ensure_importable

WINDOW, GRAM = 50, 25
BATCHES = 6
MAX_RUNS = 4
HOT = 1000
LAST = (1 << 63) - 1
#: Odd multipliers of the two families of polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

RUN = "fp long, ctx long, d long, k long, a int, m int"
ENTRY = RUN + ", old boolean"
DEALT = ENTRY + ", fixed boolean, key long"
MERGED = "kind string, " + ENTRY + ", hot boolean"
FIELDS = ["fp", "ctx", "d", "k", "a", "m", "old", "hot"]


class Rolling:
    """Hashes of word ranges: sums of word hash times base^place, shifted back to place 0."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            for name, by in (("up", self.base), ("down", self.inverse)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate((have, have * (have[-1:] * by))))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self.powers(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def stretches(hashes: np.ndarray, one: Rolling) -> tuple[np.ndarray, ...]:
    """fp, ctx, first window, number of windows of each stretch of windows with one anchor."""
    n = len(hashes)
    if n < WINDOW:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = one.sums(hashes)
    at = np.arange(n - GRAM + 1)
    grams = one.ranges(sums, at, at + GRAM)
    anchor = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1) + np.arange(n - WINDOW + 1)
    a = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    m = np.diff(np.append(a, len(anchor)))
    place = (anchor[a] - a).astype(np.uint64) * np.uint64(WINDOW) + m.astype(np.uint64)
    return grams[anchor[a]], mixed(one.ranges(sums, a, a + m + WINDOW - 1) ^ mixed(place)), a, m


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def placed(docs: DataFrame) -> DataFrame:
    """d (order), k (tells rows of one doc_id apart), text."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("doc_id", "text").alias("k"), "text")


def settled(fp: np.ndarray, ctx: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Entries that an earlier document of the same few rows has too."""
    order = np.lexsort((d, ctx, fp))
    f, c, e = fp[order], ctx[order], d[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    out = np.empty(len(f), bool)
    out[order] = e > e[np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))] if len(f) else new
    return out


def entries(docs: DataFrame) -> DataFrame:
    """Index entries (DEALT) of all windows of placed documents.

    Entries that are covered by another one of their batch are fixed at once. They are dealt out evenly, the others by fp: of an fp that very many
    documents share, a batch sends its first document only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, one = WordHashes(), Rolling(BASES[0])
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                batch = whole.slice(lo, 4000)
                found = [stretches(table.of(raw.split()), one) for raw in texts(batch.column(2))]
                fp, ctx, a, m = (np.concatenate([f[i] for f in found]) for i in range(4))
                who = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                old, d = pa.array(np.zeros(len(fp), bool)), batch.column(0).take(who)
                fixed = settled(fp, ctx, d.to_numpy())
                key = np.where(fixed, mixed(fp + np.arange(len(fp), dtype=np.uint64)), fp)
                yield pa.RecordBatch.from_arrays([signed(fp), signed(ctx), d, batch.column(1).take(who), pa.array(a.astype(np.int32)), pa.array(m.astype(np.int32)), old, pa.array(fixed), signed(key)], ["fp", "ctx", "d", "k", "a", "m", "old", "fixed", "key"])

    return docs.select("d", "k", "text").mapInArrow(run, DEALT)


def merge(rows: DataFrame, with_run: bool) -> DataFrame:
    """One pass over entries (DEALT and hot) in order of fp, ctx, d: rows of kind cover, verify and (with_run) run. Fixed ones come last and are covers."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = ctx = first = None
        nth, waiting = 0, []  # the number of the current ctx in its fp; entries to verify if the fp gets a second ctx
        for dealt in batches:
            fixed = dealt.column(8).to_numpy(zero_copy_only=False)
            whole = dealt.select(FIELDS)
            if fixed.any():
                part = whole.filter(pa.array(fixed))
                yield pa.RecordBatch.from_arrays([pa.array(["cover"] * part.num_rows), *part.columns], ["kind", *part.schema.names])
            batch = whole.filter(pa.array(~fixed))
            n = batch.num_rows
            if not n:
                continue
            f, c, d, old, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 6, 7))
            new_f, new_c = np.ones(n, bool), np.ones(n, bool)
            new_f[1:], new_c[1:] = f[1:] != f[:-1], (f[1:] != f[:-1]) | (c[1:] != c[:-1])
            new_f[0] = fp is None or f[0] != fp
            new_c[0] = new_f[0] or c[0] != ctx
            start = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            least = np.where(start >= 0, d[start], d[0] if first is None else first)
            count = np.cumsum(new_c)
            begin = np.maximum.accumulate(np.where(new_f, np.arange(n), -1))
            number = np.where(begin >= 0, count - count[begin], nth + count)
            ends = np.flatnonzero(np.append(new_f[1:], True))
            several = np.repeat(number[ends] > 0, np.diff(np.append(-1, ends))) | hot
            is_first = d == least
            verify = is_first & several
            if waiting and not new_f[0] and several[0] and not hot[0]:
                yield from waiting
                waiting = []
            out = [("cover", ~is_first & ~old), ("verify", verify)] + [("run", new_c)] * with_run
            for kind, chosen in out:
                if chosen.any():
                    part = batch.filter(pa.array(chosen))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * part.num_rows), *part.columns], ["kind", *part.schema.names])
            if new_f.any():
                waiting = []
            if not several[-1]:
                part = batch.filter(pa.array(is_first & (f == f[-1])))
                waiting.append(pa.RecordBatch.from_arrays([pa.array(["verify"] * part.num_rows), *part.columns], ["kind", *part.schema.names]))
            fp, ctx, first, nth = f[-1], c[-1], least[-1], int(number[-1])

    return rows.select(*FIELDS, "fixed", "key").repartition("key").sortWithinPartitions("fixed", "fp", "ctx", "d", "k").mapInArrow(stream, MERGED)


class FingerprintIndex:
    """Immutable sorted runs under a folder, the shared one if none is given. A folder that has a manifest is opened with its runs; one of the caller's is never cleaned up here."""

    def __init__(self, spark: SparkSession, max_runs: int = MAX_RUNS, folder: str | None = None):
        ensure_importable(spark)
        self.spark, self.max_runs, self.folder, self.version = spark, max_runs, folder or new_path(spark, "index"), 0
        self.tables: dict[str, str] = {}
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in system.listStatus(files)] if system.exists(files) else []
        versions = [int(n.split("-")[1]) for n in found if n.startswith("manifest-")]
        self.runs: list[str] = []
        if versions:
            self.version = max(versions)
            self.runs = [r.value for r in spark.read.text(f"{self.folder}/manifest-{self.version}").collect() if r.value]  # a line a run, MAX_RUNS at most
            for run in self.runs:
                self._register(run)

    def _register(self, run: str) -> None:
        """A table over the files of a run: what tells Spark their buckets, whose number is in the name, and order."""
        name = f"index_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({RUN.replace('long', 'bigint')}) USING parquet CLUSTERED BY (fp) SORTED BY (fp, ctx) INTO {run.split('-')[1]} BUCKETS LOCATION '{self.folder}/{run}'")
        self.tables[run] = name

    def _write(self, rows: DataFrame) -> str:
        """Rows as a run: a sorted file for each bucket, as many as the session has shuffle partitions, so that a task writes one file and a batch that is dealt out meets a run as it lies."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        run, name = f"run-{buckets}-{uuid.uuid4().hex}", f"index_run_{uuid.uuid4().hex}"
        rows.select("fp", "ctx", "d", "k", "a", "m").repartition(buckets, "fp").write.bucketBy(buckets, "fp").sortBy("fp", "ctx").option("path", f"{self.folder}/{run}").saveAsTable(name)
        self.tables[run] = name
        return run

    def _keep(self, runs: list[str]) -> None:
        """The new list of runs takes effect with its manifest; runs that it leaves out are deleted then."""
        self.version += 1
        self.spark.createDataFrame([(r,) for r in runs], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version}")
        for gone in set(self.runs) - set(runs):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(gone)}")
            remove(f"{self.folder}/{gone}", self.spark)
        self.runs = runs

    def close(self) -> None:
        """Forget the tables; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}

    def history(self, fps: DataFrame | None = None) -> DataFrame | None:
        """The entries of all runs, of the given fps only if there are any given."""
        parts = [self.spark.table(self.tables[r]) for r in self.runs]
        if fps is not None:
            parts = [p.join(fps.hint("merge"), "fp", "left_semi") for p in parts]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def ingest(self, docs: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """Merge a batch of placed documents with the runs: entries covered as a whole, entries to verify."""
        return self.add(materialize(entries(docs), "index-entries"), keep)

    def add(self, rows: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """The same for the written entries (DEALT) of a batch, which are read more than once.

        keep: add the batch's new entries to the index as a run. A batch that nothing follows can do without.
        """
        dealt = rows.where("not fixed")
        hot = materialize(dealt.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("fp", F.lit(True).alias("hot")), "index-hot", lean=True)
        if self.runs:
            past = self.history(dealt.select("fp").distinct())
            rows = rows.unionByName(past.withColumns({"old": F.lit(True), "fixed": F.lit(False), "key": F.col("fp")}))
        rows = rows.join(hot, "fp", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        rows = rows.withColumn("key", F.when(F.col("hot") & ~F.col("fixed"), F.xxhash64("fp", "ctx")).otherwise(F.col("key")))
        made = materialize(merge(rows, keep), "index-merge")  # one file a task, whatever the kinds
        if keep:
            # where first documents are older, their entries stay in the runs that have them
            runs = [*self.runs, self._write(made.where("kind = 'run' and not old"))]
            self._keep(runs)
            if len(runs) > self.max_runs:
                self.compact()
        return made.where("kind = 'cover'"), made.where("kind = 'verify'")

    def compact(self) -> None:
        """All runs in one. A batch leaves out each (fp, ctx) that an earlier document has in a run, so nothing is left to aggregate; rows of one doc_id in two batches may both stay, which changes no result."""
        self._keep([self._write(self.history())])


def verified(suspects: DataFrame, docs: DataFrame) -> DataFrame:
    """d, k, a: single windows of the suspected stretches that stand in an earlier document as well."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, one, two = WordHashes(), Rolling(BASES[0]), Rolling(BASES[1])
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch, who, at = whole.slice(lo, 200), [], []
                first, second = [], []
                for i, (raw, spans) in enumerate(zip(texts(batch.column(2)), batch.column(3).to_pylist())):
                    h = table.of(raw.split())
                    s = np.unique(np.concatenate([np.arange(x["a"], x["a"] + x["m"]) for x in spans]))
                    first.append(one.ranges(one.sums(h), s, s + WINDOW))
                    second.append(two.ranges(two.sums(mixed(h)), s, s + WINDOW))
                    who.append(np.full(len(s), i))
                    at.append(s)
                index = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(first)), signed(np.concatenate(second)), batch.column(0).take(index), batch.column(1).take(index), pa.array(np.concatenate(at).astype(np.int32))], ["x", "y", "d", "k", "a"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y, d = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(n, bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            new[0] = last != (x[0], y[0])
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            least = np.where(start >= 0, d[start], d[0] if first is None else first)
            last, first = (x[-1], y[-1]), least[-1]
            yield batch.select(["d", "k", "a"]).filter(pa.array(d > least))

    def single(part: DataFrame) -> DataFrame:
        per_doc = part.groupBy("d", "k").agg(F.collect_set(F.struct("a", "m")).alias("spans"))
        read = docs.join(per_doc.hint("shuffle_hash"), ["d", "k"]).select("d", "k", "text", "spans")
        return read.mapInArrow(windows, "x long, y long, d long, k long, a int")

    found = single(suspects.where("not hot")).repartition("x").sortWithinPartitions("x", "y", "d").mapInArrow(later, "d long, k long, a int")
    if suspects.where("hot").isEmpty():
        return found
    # equal windows have one fp, so hot ones meet each other only: minima of partial sums come back to the windows that several documents share.
    # They are computed twice, not written: a job of their own would deal out all texts once more, this way removed() and all joins here read one exchange
    hot = single(suspects.where("hot"))
    least = hot.groupBy("x", "y").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").drop("most")
    return found.unionByName(hot.join(least, ["x", "y"]).where("d > least").select("d", "k", "a"))


def removed(docs: DataFrame, covers: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first and end word of each removed part), kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                total, gone, parts, kept = [], [], [], []
                for raw, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                    words = raw.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    if spans:
                        np.add.at(edge, [s["a"] for s in spans], 1)
                        np.add.at(edge, [s["e"] for s in spans], -1)
                    cover = np.append(np.cumsum(edge)[:-1] > 0, False)
                    turn = np.flatnonzero(np.diff(np.append(False, cover)))
                    total.append(len(words))
                    gone.append(int(cover.sum()))
                    parts.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
                    kept.append(b" ".join([w for w, c in zip(words, cover.tolist()) if not c] if spans else words).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, span), pa.array(kept, pa.string())], ["d", "n_words", "n_removed", "spans", "kept_text"])

    both = covers.select("d", "k", "a", (F.col("a") + F.col("m") + WINDOW - 1).alias("e")).unionByName(windows.select("d", "k", "a", (F.col("a") + WINDOW).alias("e")))
    spans = both.groupBy("d", "k").agg(F.collect_set(F.struct("a", "e")).alias("_s"))
    out = docs.join(spans.hint("shuffle_hash"), ["d", "k"], "left").select("d", "text", "_s")
    out = out.mapInArrow(run, "d long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")
    return out.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "n_words", "n_removed", "spans", "kept_text")


def substring_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All of docs as batches of ascending doc_id, each merged with the runs of those before. Texts are fingerprinted in one pass, which deals the entries into batches."""
    rows = placed(docs)
    index = FingerprintIndex(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    path = new_path(docs.sparkSession, "index-entries")
    number = reduce(lambda n, cut: n + (F.col("d") > cut).cast("int"), cuts, F.lit(0))
    entries(rows).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    made = docs.sparkSession.read.schema(f"{DEALT}, batch int").parquet(path)
    covers, suspects = [], []
    for i in range(len(cuts) + 1):
        cover, suspect = index.add(made.where(F.col("batch") == i).drop("batch"), keep=i < len(cuts))
        covers.append(cover)
        suspects.append(suspect)
    index.close()
    for done in (path, index.folder):  # what follows reads the merged tables and the texts only
        remove(done, docs.sparkSession)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return removed(rows, union(covers), verified(union(suspects), rows))
