"""Source divergence audit: how far the term distribution of each source of a language lies from the others and from the language's own.

Plain relational work on built-in functions: terms are exploded and counted by (lang, source, term); the kept vocabulary of a language is crossed with the language's
groups, so that absent terms have their smoothed share as well; a join of that table with itself on (lang, term) gives the distances of sources, and a window ranks terms.
All arithmetic is in integers or decimals: nothing is rounded.

Only the first aggregation sees the corpus, and it is partial before it shuffles. What follows is of the size vocabulary x sources, and of its square in sources for the pairs, as the result itself is
square in the sources of a language. A language with most of the corpus is no hot key: groups meet the vocabulary on (lang, salt of the term), and everything else is dealt by term. Terms of a language and
groups have numbers there (written once), so the large joins move three numbers a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm._store import materialize, remove

#: Fixed values of the contract: what a term is, in how many documents it must stand, the scale of shares, how many terms a group lists.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Parts that each group is replicated to, so that the vocabulary of one language meets it in many tasks.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Characters beyond ASCII that lower() may change.
CASED = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def folded(text: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does just that where no other character has a case to lose, and it is many times faster."""
    return F.when(text.rlike(CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents that hold it); null text, lang and source count as ''.

    A document hands its terms to the aggregation twice: all of them, and each one once. So both numbers come out of one partial aggregation, and nothing is shuffled by document.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(filled("lang").alias("lang"), filled("source").alias("source"), F.regexp_extract_all(folded(filled("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    both = rows.select("lang", "source", F.explode(F.array(F.struct(F.lit(0).alias("once"), F.col("terms").alias("terms")), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms")))).alias("x"))
    each = both.select("lang", "source", "x.once", F.explode("x.terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").cast("long").alias("df"))


#: 1 + floor(SCALE * (n + 1) / (total + size)): longs where they hold the product, else decimals.
SHARE = f"1L + CASE WHEN {{n}} < 9000000000 THEN ({SCALE} * ({{n}} + 1)) div ({{total}} + size) ELSE (cast({SCALE} AS decimal(10,0)) * cast({{n}} + 1 AS decimal(20,0))) div cast({{total}} + size AS decimal(20,0)) END"
#: floor((p - q)^2 / q): shares are at most SCALE + 1, so the square fits a long.
DISTANCE = "((p - q) * (p - q)) div q"


def groups_of(docs: DataFrame, kept: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """gid (a number), lang, source, total (occurrences of kept terms), lang_total, size (kept terms of the language), least (the share of an absent term): one row for each group that occurs."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = docs.select(filled("lang"), filled("source")).distinct()
    of_lang = vocabulary.groupBy("lang").agg(F.sum("all_n").alias("lang_total"), F.count("*").alias("size"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["total", "lang_total", "size"])
    return groups.withColumns({"gid": F.monotonically_increasing_id(), "least": F.when(F.col("size") > 0, F.expr(SHARE.format(n="0L", total="total")))})


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank (see the module): part 'pair' has every other source of the language, part 'term' the first TOP terms of a group.

    Every row is a document, and rows that are repeated count as often as they are there. Null texts, languages and sources are ''; a group without terms has the smallest shares everywhere; a language
    without kept terms has value 0 in all its pairs and no row of part 'term'; a source alone in its language has no pairs. Other columns don't matter; an empty table gives no rows.
    """
    counts = materialize(term_counts(docs), "divergence-counts", lean=True)
    kept_terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("df").alias("df")).where(F.col("df") >= LEAST_DOCS)
    vocabulary = materialize(kept_terms.select("lang", "term", "all_n", F.monotonically_increasing_id().alias("tid")), "divergence-vocabulary", lean=True)
    kept = materialize(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "divergence-kept", lean=True)
    remove(counts)
    groups = materialize(groups_of(docs, kept, vocabulary), "divergence-groups", lean=True)
    present = kept.join(groups.drop("least"), ["lang", "source"]).withColumns({"p": F.expr(SHARE.format(n="n", total="total")), "q": F.expr(SHARE.format(n="all_n", total="lang_total"))})

    dealt = groups.where("size > 0").select("lang", "gid", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    crossed = vocabulary.select("lang", "tid", F.pmod("tid", F.lit(SALTS)).cast("int").alias("salt")).join(dealt, ["lang", "salt"]).select("tid", "gid", "least")
    dense = crossed.join(present.select("tid", "gid", "p"), ["tid", "gid"], "left").select("tid", "gid", F.coalesce("p", "least").alias("p"))
    dense = materialize(dense, "divergence-dense")

    sums = dense.join(dense.select("tid", F.col("gid").alias("other"), F.col("p").alias("q")), "tid").where("gid != other").groupBy("gid", "other").agg(F.sum(F.expr(DISTANCE)).alias("value"))
    mine, theirs = groups.select("lang", "source", "gid"), groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"))
    pairs = mine.join(theirs, "lang").where("gid != other").join(sums, ["gid", "other"], "left").na.fill(0, ["value"])
    terms = present.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), F.expr(DISTANCE).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term").where(F.col("rank") <= TOP))
