"""Exceptions and what users decide about them: search, look-up, advice, selection, approval, patterns; aggregates of runs and clients.

Decisions are rows. Nothing is changed in place: a decision joined with the candidates gives their new status, or the reason why it can't take effect.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators import wide

#: Fixed buckets and confidences of the advice.
BUCKETS = ("EXACT_MATCH", "TOLERANCE_MATCH", "NEAR_MATCH", "GSTR_ONLY", "PR_ONLY")
#: Fixed limits of pattern mining.
OBSERVATIONS, RATIO, EVIDENCE = 5, 0.8, 30


@dataclass(frozen=True)
class Search:
    """All predicates of the exception search; None does not filter.

    Texts are found anywhere, in any case. A row without a date, category or confidence fails a predicate on it, a missing amount counts as 0, and a row without a candidate passes those on variance and score.
    """

    statuses: tuple[str, ...] | None = None
    vendor: str | None = None
    gstin: str | None = None
    amount_min: float | None = None
    amount_max: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    variance_min: float | None = None
    variance_max: float | None = None
    category: str | None = None
    confidence_min: float | None = None
    confidence_max: float | None = None
    review_status: tuple[str, ...] | None = None
    needs_review: bool | None = None
    score_min: float | None = None
    score_max: float | None = None
    record_id: str | None = None

    def columns(self) -> list[Column]:
        amount, variance, score = F.coalesce("amount", F.lit(0)), F.round("variance", 2), F.col("score")
        within = lambda c, text: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
        bare = lambda test: F.col("n_candidates").eqNullSafe(0) | test
        tests = {
            "statuses": lambda v: F.col("status").isin(*v), "vendor": lambda v: within("vendor", v), "gstin": lambda v: within("gstin", v), "record_id": lambda v: within("record_id", v),
            "amount_min": lambda v: amount >= v, "amount_max": lambda v: amount <= v, "date_from": lambda v: F.col("d") >= F.lit(v).cast("date"), "date_to": lambda v: F.col("d") <= F.lit(v).cast("date"),
            "variance_min": lambda v: bare(variance >= v), "variance_max": lambda v: bare(variance <= v), "score_min": lambda v: bare(score >= v), "score_max": lambda v: bare(score <= v),
            "category": lambda v: F.col("category") == v, "confidence_min": lambda v: F.col("confidence") >= v, "confidence_max": lambda v: F.col("confidence") <= v,
            "review_status": lambda v: F.col("review_status").isin(*v), "needs_review": lambda v: F.col("needs_review") == v,
        }
        return [tests[f.name](getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None]


def exceptions(rows: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (record_id, status, vendor, gstin, amount, d) with their best candidate and class.

    candidates: record_id, other_id, score, variance; the best has the highest score, then the smallest other_id. classes: record_id, category, confidence, review_status, needs_review.
    """
    best = candidates.groupBy("record_id").agg(F.count("*").alias("n_candidates"), F.min(F.struct((-F.col("score")).alias("s"), "other_id", "variance")).alias("_best"))
    best = best.select("record_id", "n_candidates", F.col("_best.other_id").alias("best_id"), (-F.col("_best.s")).alias("score"), F.col("_best.variance").alias("variance"))
    out = rows.join(best, "record_id", "left").join(classes, "record_id", "left")
    return out.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def search(rows: DataFrame, wanted: Search, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Exceptions that pass all predicates; a page of them in order of record_id if a limit is given."""
    for c in wanted.columns():
        rows = rows.where(c)
    return rows if limit is None else rows.orderBy("record_id").offset(offset).limit(limit)


def lookup(g: DataFrame, p: DataFrame, identifier: str) -> DataFrame:
    """At most one row: side, row_idx, record_id, doc, found_by.

    A record id counts first, then a row number ("776" or "row 776"), then a document or vendor; G before P, then the first row. A number counts only if it stands alone, so
    that a year inside a document isn't taken for a row.
    """
    wanted = identifier.strip().upper()
    number = wanted.removeprefix("ROW").strip()
    same = lambda c: F.upper(F.trim(c)) == wanted
    row = F.col("row_idx") == int(number) if number.isdecimal() else F.lit(False)
    by = F.when(same("record_id"), 0).when(row, 1).when(same("doc"), 2).when(same("vendor"), 3)
    side = lambda df, s: df.select(F.lit(s).alias("side"), "row_idx", "record_id", "doc", by.alias("_by"))
    found = side(g, "G").unionByName(side(p, "P")).where("_by is not null")
    names = F.array(*map(F.lit, ("record_id", "row", "document", "vendor")))
    return found.orderBy(F.least("_by", F.lit(2)), "side", "row_idx").limit(1).select("side", "row_idx", "record_id", "doc", names[F.col("_by")].alias("found_by"))


def advice(df: DataFrame) -> DataFrame:
    """Wide rows with recommended bucket, its confidence, the confidence of every bucket and whether policy lets the row into it (OKAY, NOT_OKAY)."""
    rows = wide.compared(df)
    diff, same, alike = F.round("t_diff", 2), F.col("g_doc") == F.col("p_doc"), F.col("g_alnum") == F.col("p_alnum")
    blank = lambda s: F.col(f"{s}_vendor").isin(*wide.BLANKS, "—") & (F.col(f"{s}_alnum") == "")
    no_g, no_p, named = blank("g"), blank("p") & (F.col("p_taxable") == 0), F.col("g_alnum") != ""
    zero = diff < 0.01
    order = [
        (no_g & ~no_p, "PR_ONLY", 96.0), (~no_g & no_p, "GSTR_ONLY", 96.0), (zero & same, "EXACT_MATCH", 98.0), (zero & alike, "NEAR_MATCH", 94.0),
        (diff <= 10, "TOLERANCE_MATCH", 91.0), (alike, "TOLERANCE_MATCH", 85.0), (F.lit(True), "NEAR_MATCH", 72.0),
    ]
    bucket = F.coalesce(*(F.when(c, F.lit(b)) for c, b, _ in order))
    sure = F.coalesce(*(F.when(c, F.lit(v)) for c, _, v in order))
    both = ~no_g & ~no_p
    each = {
        "EXACT_MATCH": F.when(both & zero & same & (F.col("g_doc") != ""), 98.0).when(both & zero & alike & named, 70.0),
        "TOLERANCE_MATCH": F.when(both, F.when(diff <= 10, 91.0).when(alike & named, F.when(diff <= 500, 85.0).otherwise(60.0)).otherwise(25.0)),
        "NEAR_MATCH": F.when(both, F.when(alike & named, F.when(zero, 94.0).otherwise(45.0)).when(diff <= 20, 88.0).otherwise(55.0)),
        "GSTR_ONLY": F.when(~no_g & no_p, 96.0),
        "PR_ONLY": F.when(no_g & ~no_p, 96.0),
    }
    allowed = {
        "EXACT_MATCH": zero & same & (F.col("g_doc") != ""), "TOLERANCE_MATCH": diff <= 10, "NEAR_MATCH": alike | (diff <= 20),
        "GSTR_ONLY": ~((F.col("p_taxable") > 0) | (F.col("p_alnum") != "")), "PR_ONLY": ~((F.col("g_taxable") > 0) | (F.col("g_alnum") != "")),
    }
    rows = rows.withColumns({"recommended": bucket, "confidence": sure})
    rows = rows.withColumns({f"confidence_{b.lower()}": F.when(F.col("recommended") == b, F.col("confidence")).otherwise(F.coalesce(each[b], F.lit(0.0))) for b in BUCKETS})
    return rows.withColumns({f"policy_{b.lower()}": F.when(allowed[b], "OKAY").otherwise("NOT_OKAY") for b in BUCKETS})


def selected(candidates: DataFrame, consumed: DataFrame, choices: DataFrame) -> DataFrame:
    """Outcome of choices (g_idx, p_idx) among the ambiguous candidates (g_idx, p_idx): choice columns, with `problem` or null.

    A choice takes effect if its G row is ambiguous, the pair is a candidate and its P row is free; a null p_idx leaves the row as it is. Of choices for one P row the smallest g_idx goes first.
    """
    ambiguous = candidates.select("g_idx").distinct().withColumn("_open", F.lit(True))
    pairs = candidates.select("g_idx", "p_idx").distinct().withColumn("_pair", F.lit(True))
    used = consumed.select("p_idx").distinct().withColumn("_used", F.lit(True))
    rows = choices.join(ambiguous, "g_idx", "left").join(pairs, ["g_idx", "p_idx"], "left").join(used, "p_idx", "left")
    rows = rows.withColumn("problem", F.when(F.col("_open").isNull(), "NOT_AMBIGUOUS").when(F.col("p_idx").isNull(), "LEFT_UNRESOLVED").when(F.col("_pair").isNull(), "NOT_A_CANDIDATE").when(F.col("_used"), "CONSUMED"))
    nth = F.row_number().over(Window.partitionBy("p_idx", F.col("problem").isNull()).orderBy("g_idx"))
    again = F.col("problem").isNull() & (nth > 1)
    return rows.withColumn("_again", again).withColumn("problem", F.when(F.col("_again"), "CONSUMED").otherwise(F.col("problem"))).select("g_idx", "p_idx", "problem")


def after_selection(candidates: DataFrame, outcome: DataFrame) -> DataFrame:
    """Ambiguous candidates with their status once selected() took effect: the chosen pair is approved, other pairs of its G row are rejected, the rest stay ambiguous."""
    taken = outcome.where("problem is null").select("g_idx", F.col("p_idx").alias("_chosen"))
    status = F.when(F.col("_chosen").isNull(), "AMBIGUOUS").when(F.col("_chosen") == F.col("p_idx"), "NEAR_MATCH_APPROVED").otherwise("REJECTED_CANDIDATE")
    return candidates.join(taken, "g_idx", "left").withColumn("status", status).drop("_chosen")


def decided(candidates: DataFrame, consumed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (g_idx, p_idx, status, reciprocal) with new status and `problem` after single decisions (g_idx, p_idx, action: approve or reject).

    Only proposals can be decided, only reciprocal ones with both rows free be approved; of approvals that share a row the first pair in order goes.
    """
    used = lambda c: consumed.select(c).distinct().withColumn(f"_{c}", F.lit(True))
    rows = candidates.join(decisions.select("g_idx", "p_idx", "action"), ["g_idx", "p_idx"], "left").join(used("g_idx"), "g_idx", "left").join(used("p_idx"), "p_idx", "left")
    approve = F.col("action") == "approve"
    problem = (
        F.when(F.col("action").isNull(), None).when(F.col("status") != "NEAR_MATCH_PROPOSED", "NOT_PENDING").when(approve & ~F.col("reciprocal"), "NOT_ELIGIBLE")
        .when(approve & (F.col("_g_idx").isNotNull() | F.col("_p_idx").isNotNull()), "CONSUMED")
    )
    rows = rows.withColumn("problem", problem).withColumn("_going", approve & F.col("problem").isNull())
    nth = lambda c, other: F.row_number().over(Window.partitionBy(c, "_going").orderBy(other))
    rows = rows.withColumn("_ng", nth("g_idx", "p_idx")).withColumn("_np", nth("p_idx", "g_idx"))
    rows = rows.withColumn("problem", F.when(F.col("_going") & ((F.col("_ng") > 1) | (F.col("_np") > 1)), "CONSUMED").otherwise(F.col("problem")))
    done = F.col("action").isNotNull() & F.col("problem").isNull()
    status = F.when(done & approve, "NEAR_MATCH_APPROVED").when(done, "REJECTED_CANDIDATE").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("action", "_g_idx", "_p_idx", "_going", "_ng", "_np")


def separator_pattern(candidates: DataFrame) -> DataFrame:
    """No row, or one: a rule to suggest, as approved candidates of one vendor differ in separators only often enough.

    candidates: g_idx, p_idx, status, same_vendor, norm_equal, raw_equal, g_doc, p_doc. observations, ratio of approvals, and up to EVIDENCE pairs in order.
    """
    yes = (F.col("status") == "NEAR_MATCH_APPROVED") & F.col("same_vendor") & F.col("norm_equal") & ~F.col("raw_equal")
    no = (F.col("status") == "REJECTED_CANDIDATE") & F.col("norm_equal")
    approved = candidates.where(yes)
    counts = candidates.agg(F.count_if(yes).alias("observations"), F.count_if(no).alias("_no"))
    of = F.col("observations") + F.col("_no")
    counts = counts.where((F.col("observations") >= OBSERVATIONS) & (F.col("observations") / F.nullif(of, F.lit(0)) >= RATIO)).withColumn("ratio", F.round(F.col("observations") / of, 4)).drop("_no")
    shown = approved.orderBy("g_idx", "p_idx").limit(EVIDENCE).agg(F.array_join(F.sort_array(F.collect_list(F.struct("g_idx", "p_idx", F.concat_ws(" ↔ ", "g_doc", "p_doc").alias("t"))))["t"], "|").alias("evidence"))
    return counts.crossJoin(shown)  # one row each


def near_summary(g: DataFrame, p: DataFrame, exact: DataFrame, tolerance: DataFrame, near: DataFrame) -> DataFrame:
    """One row: counts of both ledgers, of the stages' matches and of what is pending, resolved and left. near: candidates with their present status."""
    one = lambda df, **cols: df.agg(*(c.alias(n) for n, c in cols.items()))
    n, status = F.count("*"), F.col("status")
    out = one(g, g_records=n).crossJoin(one(p, p_records=n)).crossJoin(one(exact, exact=n)).crossJoin(one(tolerance, tolerance=n))  # one row each
    rows_of = lambda s: F.count_distinct(F.when(status == s, F.col("g_idx")))
    out = out.crossJoin(one(near, proposals=F.count_if(status == "NEAR_MATCH_PROPOSED"), near=F.count_if(status == "NEAR_MATCH_APPROVED"), ambiguous=rows_of("AMBIGUOUS")))
    out = out.withColumn("resolved", F.col("exact") + F.col("tolerance") + F.col("near"))
    return out.withColumns({"g_left": F.col("g_records") - F.col("resolved"), "p_left": F.col("p_records") - F.col("resolved"), "state": F.when(F.col("proposals") > 0, "AWAITING_NEAR_MATCH_APPROVAL").otherwise("COMPLETED")})


def run_stats(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of runs (client, status, duration_ms, n_steps, n_errors, tokens, cost, itc), of all or per `by` columns.

    Durations of 0 don't count, and without any the mean is null. Money of reconciled credit comes in crores (10 million).
    """
    good, total = F.col("status").isin("COMPLETED", "COMPLETED_WITH_WARNINGS"), lambda c: F.coalesce(F.sum(c), F.lit(0))
    done = F.count_if(good)
    some = lambda x: F.greatest(x, F.lit(1))
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.round(100.0 * done / some(F.count("*")), 1).cast("double").alias("success_rate"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.round(F.avg(F.when(good & (F.col("duration_ms") > 0), F.col("duration_ms"))), 0).alias("mean_ms"), total("n_steps").alias("steps"), total("n_errors").alias("errors"),
        F.round(F.sum(F.col("itc").cast("decimal(18,2)")).cast("double") / 1e7, 2).alias("crores"), total("tokens").alias("tokens"), F.round(total("tokens") / some(done), 0).alias("tokens_per_run"),
        F.round(F.sum(F.col("cost").cast("decimal(18,6)")).cast("double"), 5).alias("cost"),
    )


def recent(rows: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Per key the latest rows, `nth` from 1; ties in order of all columns."""
    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *rest))).where(F.col("nth") <= most)
