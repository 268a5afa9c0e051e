"""Indel similarity: 2 * LCS / (length + length).

The longest common subsequence comes from one big integer per string pair (bit-parallel rows), in Arrow batches. Call
it on pairs that have passed cheap filters; upper_bound() is one that costs nothing.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ledgerloom.sources.session import ensure_importable
from ledgerloom.sources.store import materialize

#: Texts of one side of a group up to which each meets all of the other side, by one number a text.
NARROW = 256


@lru_cache(1024)
def _places(a: str) -> dict[str, int]:
    """For each character the places where it stands, as bits."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence. A text that is compared with many should be a."""
    at = _places(a).get
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        if hit := row & at(ch, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """1 for two empty strings."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


@pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    return pd.Series([known.get(k) if k in known else known.setdefault(k, indel(*k)) for k in zip(a.fillna(""), b.fillna(""))], dtype="float64")


# as nondeterministic ones they are not copied into the conditions on their outcome, where every pair would be compared twice
_ratio = _ratio.asNondeterministic()


def ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def guarded(a: str, b: str) -> float:
    """0 if one is empty or the lengths differ by more than 35 % of the longer one."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 0.0 if abs(len(a) - len(b)) / max(len(a), len(b)) > 0.35 else indel(a, b)


def upper_bound(a: Column, b: Column) -> Column:
    """No pair is more alike than this."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


@pandas_udf(T.DoubleType())
def _guarded(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    return pd.Series([known[k] if k in known else known.setdefault(k, guarded(*k)) for k in zip(a.fillna(""), b.fillna(""))], dtype="float64")


_guarded = _guarded.asNondeterministic()


def guarded_ratio(a: Column, b: Column) -> Column:
    """guarded() of two columns; null is empty."""
    return _guarded(a, b)


def grams(text: Column, q: int) -> Column:
    """The q-grams of a text with q - 1 marks at either end, each with its number among equal ones, so that common entries of two such arrays are common q-grams with repeats."""
    marked = F.concat(F.lit("\x02" * (q - 1)), text, F.lit("\x03" * (q - 1)))
    found = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) + q - 1), lambda i: F.substring(marked, i, F.lit(q))))
    return F.transform(found, lambda x, i: F.concat(x, F.lit("#"), (i + 1 - F.array_position(found, x)).cast("string")))


def mark(text: str) -> int:
    """64 parities of a text's characters, equal ones told apart by their number: two texts differ in at least as many characters as bits."""
    seen: dict[str, int] = {}
    bits = 0
    for ch in text:
        n = seen[ch] = seen.get(ch, 0) + 1
        bits ^= 1 << ((ord(ch) * 0x9E3779B1 + n * 0x85EBCA6B & 0xFFFFFFFF) * 0xC2B2AE35 >> 20 & 63)
    return bits - (1 << 64) if bits >> 63 else bits


@pandas_udf(T.LongType())
def _mark(texts: pd.Series) -> pd.Series:
    return texts.map(mark)


def similar_pairs(left: DataFrame, right: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, a, b, alike: distinct texts a (of left) and b (of right) of one group whose Indel similarity is `least` or more, found without comparing all texts with all.

    left: by, a; right: by, b; nulls and empty texts have no pairs. In a group of up to NARROW texts a side, a text meets the others by length and by mark(): with a common subsequence of t (m + n) / 2 characters or more, lengths m and n
    leave (1 - t)(m + n) characters that may differ. So a row costs NARROW comparisons of numbers at most. Larger groups meet by prefixes (by_prefixes). The subsequence itself is looked for in what passes.
    """
    ensure_importable(left.sparkSession)
    marks = lambda s: {f"{s}_length": F.length(s), f"{s}_mark": _mark(s)}
    texts = {s: materialize(df.select(*by, s).where(f"{s} != ''").distinct().withColumns(marks(s)), "texts") for s, df in (("a", left), ("b", right))}
    wide = lambda s: texts[s].groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > NARROW).select(*by)
    large = materialize(wide("a").unionByName(wide("b")).distinct(), "large", lean=True)
    some = not large.isEmpty()
    marked = lambda s: texts[s].join(large, by, "left_anti") if some else texts[s]
    total = F.col("a_length") + F.col("b_length")
    near = F.bit_count(F.col("a_mark").bitwiseXOR(F.col("b_mark"))) <= total - 2 * F.ceil(least * total / 2 - 1e-6)
    pairs = marked("a").join(marked("b"), by).where((2.0 * F.least("a_length", "b_length") / total >= least) & near).select(*by, "a", "b")
    if some:
        pairs = pairs.unionByName(by_prefixes(*(texts[s].join(large, by, "left_semi").select(*by, s) for s in "ab"), by, least))
    return pairs.select(*by, "a", "b", ratio(F.col("a"), F.col("b")).alias("alike")).where(F.col("alike") >= least)


def by_prefixes(left: DataFrame, right: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, a, b of similar_pairs() and some more, from distinct texts that aren't empty.

    Two texts of lengths m and n have a common subsequence of t (m + n) / 2 characters or more. A character that is dropped breaks q q-grams at most, one that is put
    in q - 1, so at least `need` q-grams are common: t (m + n) / 2 for q = 1, 1 + (3 t / 2 - 1)(m + n) for q = 2. With all q-grams in one order, rarest first, two such texts share one of their first
    size - need + 1. So texts meet by these prefixes, then lengths and the full number of common q-grams are checked. q is 2 from 0.75 on, where it tells more.
    """
    q = 2 if least >= 0.75 else 1
    need = (lambda total: 1 + (1.5 * least - 1) * total) if q == 2 else (lambda total: least * total / 2)
    texts = {"a": left, "b": right}
    made = {s: df.withColumns({f"{s}_grams": grams(F.col(s), q), f"{s}_length": F.length(s)}) for s, df in texts.items()}
    often = made["a"].select(F.explode("a_grams").alias("gram")).unionByName(made["b"].select(F.explode("b_grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("often"))

    def met(s: str) -> DataFrame:
        """A row for each q-gram of the prefix."""
        rows = made[s].select("*", F.explode(f"{s}_grams").alias("gram")).join(often, "gram")
        ordered = rows.groupBy(*by, s, f"{s}_length").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("found"))  # no more than the text has characters
        size, shortest = F.size("found"), F.col(f"{s}_length") * 2 / (2 - least)  # the two lengths together, where the other text is as short as it can be
        prefix = F.greatest(F.lit(1), F.least(size, size - F.ceil(need(shortest) - 1e-6) + 1)).cast("int")
        ordered = ordered.select(*by, s, f"{s}_length", F.transform("found", lambda x: x["gram"]).alias(f"{s}_grams"), prefix.alias("prefix")).withColumn(f"{s}_first", F.slice(f"{s}_grams", F.lit(1), F.col("prefix")))
        return ordered.drop("prefix").withColumn("gram", F.explode(f"{s}_first"))

    total = F.col("a_length") + F.col("b_length")
    pairs = met("a").join(met("b"), [*by, "gram"]).where(2.0 * F.least("a_length", "b_length") / total >= least)
    pairs = pairs.where(F.element_at(F.array_intersect("a_first", "b_first"), 1) == F.col("gram"))  # a pair that meets at several counts at the first
    return pairs.where(F.size(F.array_intersect("a_grams", "b_grams")) >= need(total) - 1e-6).select(*by, "a", "b")
