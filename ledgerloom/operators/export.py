"""Tables for export: side projections, signed differences, sections, guards, fingerprints and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.normalize import safe_cell

#: Fixed map of verdicts to the sections of the report.
SECTIONS = {
    "Exact Match": "Matched", "Tolerance Match": "Matched", "Consolidated Match": "Matched", "Near Match": "Probable", "Ambiguous": "Review", "Ineligible ITC [Sec 17(5)]": "Review",
    "GST Only": "Missing in P", "PR Only": "Missing in G",
}


def report(rows: DataFrame) -> DataFrame:
    """Ordered columns: identity, both sides with all taxes (null if the side is missing), P minus G differences (null if either is missing), section; text cells are guarded."""
    section = F.coalesce(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[F.col("verdict")], F.lit("Review"))
    both = (F.col("g_vendor") != "") & (F.col("p_vendor") != "")
    side = lambda s: [safe_cell(F.nullif(f"{s}_vendor", F.lit(""))).alias(f"{s}_vendor"), safe_cell(F.nullif(f"{s}_doc", F.lit(""))).alias(f"{s}_doc"), F.col(f"{s}_date"), *(F.when(F.col(f"{s}_vendor") != "", c).alias(f"{s}_{n}") for n, c in (("taxable", F.col(f"{s}_taxable")), ("tax", F.col(f"{s}_tax")), ("value", F.round(F.col(f"{s}_taxable") + F.col(f"{s}_tax"), 2))))]
    diff = lambda c: F.when(both, F.round(F.col(f"p_{c}") - F.col(f"g_{c}"), 2)).alias(f"{c}_diff")
    return rows.select("row_idx", *side("g"), *side("p"), diff("taxable"), diff("tax"), F.when(both, F.datediff("p_date", "g_date")).alias("days_diff"), "verdict", section.alias("section"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the count and an order-free hash of the state, to tell a stale export."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return rows.select(F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("state"))


def gate(links: DataFrame) -> DataFrame:
    """Blocking codes: rows mean that an export must not be made."""
    twice = lambda c, code: links.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("row_idx")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(code).alias("code"), "row_idx")
    return twice("g_idx", "G_USED_TWICE").unionByName(twice("p_idx", "P_USED_TWICE"))


def write_delimited(rows: DataFrame, path: str, columns: dict[str, str], sep: str = ",") -> None:
    """Chosen columns under other names as delimited text with a header."""
    rows.select(*(F.col(c).alias(n) for c, n in columns.items())).write.option("header", True).option("sep", sep).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


#: Fixed values of the report's format: columns in order, by part, and the words of its sections.
HEAD = "LocationGstin LocationName ReconciliationSection SuggReconciliationSection Reason ActionStatus Action ValueDifference TaxableDifference IGSTDifference CGSTDifference SGSTDifference CessDifference"
SIDE = "Gstin TradeName LegalName DocumentNumber DocumentDate DocumentType Value POS ReverseCharge TaxableValue Rate IgstAmount CgstAmount SgstAmount CessAmount"
TAIL = "ReconciliationPercentage ReconciledBy ManualReconciliation ReconciliationDateTime Remarks IMSAction IMSRemarks Gstr1GrcScore Gstr3bGrcScore Notes ReduceITC ReferenceId CPIsReversal Gstr3bNonPayment"
PACKAGE = (*HEAD.split(), *(f"CP{c}" for c in SIDE.split()), *(f"PR{c}" for c in SIDE.split()), *TAIL.split())
NUMBERS = frozenset("ReconciliationPercentage Gstr1GrcScore Gstr3bGrcScore".split())
STATUS = {
    "EXACT_MATCHED": "Matched", "TOLERANCE_MATCHED": "Matched", "NEAR_MATCHED": "Matched", "HUMAN_SELECTED": "Matched", "MATERIAL_MISMATCH": "Mismatched", "AMBIGUOUS": "Unreconciled",
    "GST_ONLY": "GST Only", "PR_ONLY": "PR Only", "UNRESOLVED": "Unreconciled",
}


#: Fixed reason texts of the report.
REASONS = {
    "EXACT_MATCHED": "Canonical GSTIN, document, value, rate, and tax fields matched exactly.",
    "TOLERANCE_MATCHED": "GSTIN and document number matched; differences remained within the confirmed policy tolerances.",
    "NEAR_MATCHED": "Human-approved near match supported by deterministic candidate evidence.",
    "HUMAN_SELECTED": "A human explicitly selected this Purchase Register candidate for the ambiguous Government record.",
    "MATERIAL_MISMATCH": "A potential counterpart exists, but one or more financial differences exceed configured safety limits.",
    "AMBIGUOUS": "Multiple similarly strong Purchase Register candidates require human selection.",
    "GST_ONLY": "No eligible Purchase Register counterpart was identified.",
    "PR_ONLY": "No eligible Government GST counterpart was identified.",
}
UNEXPLAINED = "The record remains unreconciled."
UNRESOLVED = ("AMBIGUOUS", "MATERIAL_MISMATCH", "GST_ONLY", "PR_ONLY")


def looked_up(values: dict[str, str], otherwise: str) -> Column:
    """values[status]."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("status")], F.lit(otherwise))


def decided_outcomes(exact: DataFrame, tolerance: DataFrame, near: DataFrame, approved: DataFrame, selected: DataFrame, g: DataFrame, p: DataFrame) -> DataFrame:
    """g_idx, p_idx, status of every outcome: matches of the stages, approved proposals and selections (g_idx, p_idx each), then ambiguous and mismatched rows with their top candidate, then G rows without and P rows without any strong candidate.

    near: tiers.ranked(). A P row that is a strong candidate only (equal document, or a score close to a proposal's) has no row of its own, as in the near stage's outcomes.
    """
    named = lambda m, name: m.select("g_idx", "p_idx", F.lit(name).alias("status"))
    done = named(exact, "EXACT_MATCHED").unionByName(named(tolerance, "TOLERANCE_MATCHED")).unionByName(named(approved, "NEAR_MATCHED")).unionByName(named(selected, "HUMAN_SELECTED"))
    open_g = g.select(F.col("row_idx").alias("g_idx")).join(done.select("g_idx"), "g_idx", "left_anti")
    top = near.groupBy("g_idx").agg(
        F.min(F.when(F.col("rank") == 1, F.col("p_idx"))).alias("p_idx"), F.bool_or("ambiguous").alias("unsure"), F.bool_or(F.col("norm_equal") & ~F.col("agree")).alias("apart"), F.bool_or(F.col("status") == "NEAR_MATCH_PROPOSED").alias("proposed")
    )
    status = F.when(F.col("unsure"), "AMBIGUOUS").when(F.col("proposed"), "UNRESOLVED").when(F.col("apart"), "MATERIAL_MISMATCH").otherwise("GST_ONLY")
    rest = open_g.join(top, "g_idx", "left").select("g_idx", F.when(status != "GST_ONLY", F.col("p_idx")).alias("p_idx"), status.alias("status"))
    strong = near.where(F.col("norm_equal") | (F.col("score") >= 0.87)).select("p_idx").unionByName(done.select("p_idx"))
    alone = p.select(F.col("row_idx").alias("p_idx")).join(strong, "p_idx", "left_anti").select(F.lit(None).cast("long").alias("g_idx"), "p_idx", F.lit("PR_ONLY").alias("status"))
    return done.unionByName(rest).unionByName(alone)


def unresolved_sheet(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Open rows of a snapshot (package() with status): both record ids, document, reason, difference and how many candidates the G row has."""
    count = near.groupBy("g_idx").agg(F.count("*").alias("candidates"))
    open_ones = rows.where(F.col("status").isin(*UNRESOLVED)).join(count, "g_idx", "left")
    return open_ones.select("status", "g_idx", "p_idx", F.coalesce("CPDocumentNumber", "PRDocumentNumber").alias("document"), "Reason", F.col("TaxableDifference").alias("difference"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def summary_sheet(rows: DataFrame) -> DataFrame:
    """metric, value: records of either side, each status, resolved and unresolved outcomes, coverage of G. One pass over the snapshot."""
    g_rows, resolved = F.count_distinct("g_idx"), F.count_if(~F.col("status").isin(*UNRESOLVED, "UNRESOLVED"))
    wide = rows.agg(g_rows.alias("g_records"), F.count_distinct("p_idx").alias("p_records"), resolved.alias("resolved"), F.count_if(F.col("status").isin(*UNRESOLVED, "UNRESOLVED")).alias("unresolved"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in REASONS))
    wide = wide.withColumn("coverage", F.round(F.col("resolved") / F.nullif(F.col("g_records"), F.lit(0)), 4))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns))).alias("x")).select("x.*")


def gate_codes(sessions: DataFrame, pending: DataFrame, links: DataFrame, profiles: DataFrame, missing: list[str]) -> DataFrame:
    """session, code, n: what stops the export of each session; one that has no row may be exported.

    sessions: session, mapping_confirmed, policy_confirmed, stages_done, profile_id (null: none asked for). pending: session of each proposal without a decision, counted where the stages are done. links: session, g_idx, p_idx of all
    matches. profiles: profile_id of those that exist. missing: fields that the format requires and lacks.
    """
    code = lambda df, name, n: df.select("session", F.lit(name).alias("code"), n.cast("long").alias("n"))
    one = F.lit(1)
    twice = lambda c: links.groupBy("session", c).agg((F.count("*") - 1).alias("again")).where("again > 0").select("session", "again")
    doubled = twice("g_idx").unionByName(twice("p_idx")).groupBy("session").agg(F.sum("again").alias("n"))
    waiting = pending.groupBy("session").agg(F.count("*").alias("n")).join(sessions.where("stages_done").select("session"), "session", "left_semi")
    out = code(sessions.where("NOT mapping_confirmed"), "mapping_not_confirmed", one).unionByName(code(sessions.where("NOT policy_confirmed"), "policy_not_confirmed", one)).unionByName(code(sessions.where("NOT stages_done"), "matching_incomplete", one))
    out = out.unionByName(code(waiting, "pending_match_decisions", F.col("n"))).unionByName(code(doubled, "duplicate_consumption", F.col("n")))
    out = out.unionByName(code(sessions.where("profile_id IS NOT NULL").join(profiles.select("profile_id").distinct(), "profile_id", "left_anti"), "profile_reference_invalid", one))
    return out if not missing else out.unionByName(code(sessions, "target_fields_missing", F.lit(len(missing))))


def package(outcomes: DataFrame, g: DataFrame, p: DataFrame, *more: str) -> DataFrame:
    """The PACKAGE columns (and `more` ones) of outcomes (g_idx, p_idx, status): sections, P minus G differences, both sides; a null column that a ledger has under the same name is filled from G, then from P."""
    heads = ("igst", "cgst", "sgst", "cess")

    def side(df: DataFrame, key: str, prefix: str) -> DataFrame:
        value = F.col("taxable") + sum((F.coalesce(h, F.lit(0)) for h in heads[1:]), F.coalesce(heads[0], F.lit(0)))
        made = {"Gstin": "vendor", "DocumentNumber": "doc", "DocumentType": "doc_type"}
        known = {f"{prefix}{n}": safe_cell(F.col(c)) for n, c in made.items()} | {f"{prefix}DocumentDate": F.col("d")}
        known |= {f"{prefix}{n}": F.col(c).cast("double") for n, c in (("TaxableValue", "taxable"), ("Rate", "rate"), *((f"{h.capitalize()}Amount", h) for h in heads))} | {f"{prefix}Value": value.cast("double")}
        raw = {c: F.col(c).cast("string") for c in df.columns if c in PACKAGE}
        return df.select(F.col("row_idx").alias(key), F.col("record_id").alias(f"{prefix}_record"), *(c.alias(n) for n, c in known.items()), *(c.alias(f"{prefix}_{n}") for n, c in raw.items()))

    left, right = side(g, "g_idx", "CP"), side(p, "p_idx", "PR")
    rows = outcomes.join(left, "g_idx", "left").join(right, "p_idx", "left")
    section, human = looked_up(STATUS, "Unreconciled"), F.col("status") == "HUMAN_SELECTED"
    diff = lambda c: F.round(F.col(f"PR{c}") - F.col(f"CP{c}"), 2)
    made = {"ReconciliationSection": section, "SuggReconciliationSection": section, "Reason": looked_up(REASONS, UNEXPLAINED), "ReconciledBy": F.when(human, "POC user").otherwise("SYSTEM"), "ManualReconciliation": F.when(human, "Yes").otherwise("No")}
    made |= {"ReferenceId": F.coalesce("CP_record", "PR_record"), "ActionStatus": F.lit("Actions Not Taken"), "Action": F.lit("No Action"), "ValueDifference": diff("Value"), "TaxableDifference": diff("TaxableValue")}
    made |= {f"{h.upper() if h != 'cess' else 'Cess'}Difference": diff(f"{h.capitalize()}Amount") for h in heads}

    def column(name: str) -> Column:
        raw = [F.col(f"{s}_{name}") for s, df in (("CP", left), ("PR", right)) if f"{s}_{name}" in df.columns]
        own = [made[name]] if name in made else [F.col(name)] if name in rows.columns else []
        return (F.coalesce(*own, *raw) if own or raw else F.lit(None).cast("double" if name in NUMBERS else "string")).alias(name)

    return rows.select("g_idx", "p_idx", *more, *(column(c) for c in PACKAGE))


REQUIRED = ("ReconciliationSection", "Reason", "ActionStatus", "Action", "CPGstin", "PRGstin", "CPDocumentNumber", "PRDocumentNumber")


def flags(rows: DataFrame, conditions: dict[str, tuple]) -> DataFrame:
    """rows with a boolean column for each condition (column, operator, value): CONTAINS, EQUALS, GREATER_THAN, LESS_THAN, BETWEEN (two values), IS_EMPTY. A null value meets IS_EMPTY only."""
    tests = {
        "CONTAINS": lambda c, v: F.contains(F.lower(c.cast("string")), F.lit(str(v).lower())), "EQUALS": lambda c, v: c == v, "GREATER_THAN": lambda c, v: c > v, "LESS_THAN": lambda c, v: c < v,
        "BETWEEN": lambda c, v: c.between(*v), "IS_EMPTY": lambda c, v: c.isNull() | (F.trim(c.cast("string")) == ""),
    }
    return rows.withColumns({name: F.coalesce(tests[op](F.col(c), v), F.lit(False)) for name, (c, op, v) in conditions.items()})
