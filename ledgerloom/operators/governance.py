"""Governed rules as data: a log of requests folds into transitions and validity intervals, and candidates meet the version that is active at their time.

A rule has versions. Requests (rule_id, asked_on, seq, request, blocked) are read in order of (asked_on, seq) inside a rule; blocked tells that the simulation of that moment has conflicts. What a request does:

    draft, new_version   version 1, or the next one, as DRAFT; a second draft of a rule is refused
    approve              the latest version, if it is a DRAFT and not blocked, becomes APPROVED
    activate             the latest version, if it is APPROVED and not blocked, becomes ACTIVE; a version that was ACTIVE becomes SUPERSEDED
    disable              the ACTIVE version becomes DISABLED

Everything else is refused with a reason, and refused requests are rows, too. Rules never match by themselves: an execution counts what a version would propose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.ordered import in_groups

#: Fixed ids of rules that nobody may change.
LOCKED = (
    "EXACT-D001", "EXACT-D002", "TOL-D003", "NEAR-D001", "NEAR-D002", "NEAR-D003", "NEAR-D004", "NEAR-D005", "GOV-D001", "GOV-D003", "SAFE-D001", "SAFE-D002", "SAFE-D003", "SAFE-D004",
    "DATA-D001", "DATA-D002", "EXCEPT-D001", "EXCEPT-D002", "EXEC-D001",
)
#: Conditions that an execution looks at (field, operator; None: any operator) and the bit of the candidate's feature that each of them needs. Other conditions don't hold a candidate back.
NEEDS = {("gstin", None): 1, ("document_number", "NORMALIZED_EXACT"): 2}


def transitions(requests: DataFrame) -> DataFrame:
    """rule_id, asked_on, seq, request, version, status, refused: what each request has changed, in order. A refused one has a reason and no status; an activation that supersedes a version has a row for each of the two."""

    def run(rows: list[tuple]) -> list[tuple]:
        out, status, latest = [], {}, 0
        for rule, at, seq, request, blocked in rows:
            active = next((v for v, s in status.items() if s == "ACTIVE"), None)
            now = status.get(latest)
            say = lambda reason: out.append((rule, at, seq, request, latest or None, None, reason))  # noqa: E731, B023
            put = lambda version, name: (status.__setitem__(version, name), out.append((rule, at, seq, request, version, name, None)))  # noqa: E731, B023
            if rule in LOCKED:
                say("LOCKED_GUARDRAIL")
            elif request == "draft" and latest or request != "draft" and not latest:
                say("ALREADY_DRAFTED" if latest else "NO_SUCH_RULE")
            elif request in ("draft", "new_version"):
                latest += 1
                put(latest, "DRAFT")
            elif request == "disable":
                put(active, "DISABLED") if active else say("NOT_ACTIVE")
            elif request == "approve" and now != "DRAFT":
                say("NOT_A_DRAFT")
            elif request == "activate" and now != "APPROVED":
                say("NOT_APPROVED")
            elif request not in ("approve", "activate"):
                say("UNKNOWN_REQUEST")
            elif blocked:
                say("BLOCKED_BY_CONFLICTS")
            else:
                if request == "activate" and active:
                    put(active, "SUPERSEDED")
                put(latest, "APPROVED" if request == "approve" else "ACTIVE")
        return out

    rows = requests.select("rule_id", "asked_on", "seq", "request", "blocked").where("rule_id IS NOT NULL")
    return in_groups(rows, ["rule_id"], ["asked_on", "seq"], run, "rule_id string, asked_on date, seq long, request string, version int, status string, refused string")


def intervals(changes: DataFrame) -> DataFrame:
    """rule_id, version, status, since, until (null: still so), last: the stretches in which each version had a status, from transitions(). One that ends the day it begins is kept."""
    order = Window.partitionBy("rule_id", "version").orderBy("asked_on", "seq")
    until = F.lead("asked_on").over(order)
    return changes.where("refused IS NULL").select("rule_id", "version", "status", F.col("asked_on").alias("since"), until.alias("until"), until.isNull().alias("last"))


def masks(conditions: DataFrame) -> DataFrame:
    """rule_id, version, mask: the bits that a candidate must have, out of rows rule_id, version, field, operator. Any number of rules; a rule without a condition that counts has mask 0."""
    bit = F.lit(0)
    for (field, operator), value in NEEDS.items():
        holds = F.col("field") == field if operator is None else (F.col("field") == field) & (F.col("operator") == operator)
        bit = F.when(F.coalesce(holds, F.lit(False)), value).otherwise(bit)
    return conditions.groupBy("rule_id", "version").agg(F.bit_or(bit).cast("int").alias("mask"))


def executions(candidates: DataFrame, spans: DataFrame, conditions: DataFrame) -> DataFrame:
    """rule_id, version, since, evaluated, affected, automatic, result: for each span of an ACTIVE version the candidates of its client that came in it, and how many of these meet all its conditions.

    candidates: client, seen_on, vendor_equal, document_equal. spans: intervals() with client. A candidate's features are bits, and candidates are counted by client, day and bits before they meet a rule, so all
    rules are evaluated in one pass over the candidates and a client with many of them is no hot key. Candidates are taken from since on, up to but without until.
    """
    bits = F.when(F.col("vendor_equal"), 1).otherwise(0) + F.when(F.col("document_equal"), 2).otherwise(0)
    counted = candidates.groupBy("client", "seen_on", bits.alias("bits")).agg(F.count("*").alias("n"))
    active = spans.where("status = 'ACTIVE'").join(masks(conditions), ["rule_id", "version"], "left").na.fill(0, ["mask"])
    inside = (F.col("seen_on") >= F.col("since")) & (F.col("until").isNull() | (F.col("seen_on") < F.col("until")))
    met = active.join(counted.withColumnRenamed("client", "_client"), (F.col("client") == F.col("_client")) & inside, "left")
    hit = F.when(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.col("n")).otherwise(0)
    found = met.groupBy("rule_id", "version", "since", "until").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), F.coalesce(F.sum(hit), F.lit(0)).alias("affected"))
    return found.select("rule_id", "version", "since", "evaluated", "affected", F.lit(0).alias("automatic"), F.when(F.col("affected") > 0, "proposals_created").otherwise("no_trigger").alias("result"))


def simulation(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per group: what a rule of equal vendors and normalised documents would do to known candidates (p_idx, status, norm_equal, ambiguous): would_propose, approvals, rejected, ambiguous_conflicts, duplicates (P rows proposed again), new_cases, conflicts, blocked."""
    rows = candidates.where("norm_equal")
    counts = rows.groupBy(*by, "p_idx").agg(*(F.count_if(c).alias(n) for n, c in (("would", F.lit(True)), ("approvals", F.col("status") == "NEAR_MATCH_APPROVED"), ("rejected", F.col("status") == "REJECTED_CANDIDATE"), ("unsure", F.col("ambiguous")))))
    out = counts.groupBy(*by).agg(F.sum("would").alias("would_propose"), F.sum("approvals").alias("approvals"), F.sum("rejected").alias("rejected"), F.sum("unsure").alias("ambiguous_conflicts"), F.sum(F.col("would") - 1).alias("duplicates"))
    new = F.greatest(F.lit(0), F.col("would_propose") - F.col("approvals") - F.col("rejected"))
    return out.withColumns({"new_cases": new, "conflicts": F.col("rejected") + F.col("duplicates"), "blocked": (F.col("rejected") + F.col("duplicates")) > 0})


def catalog(rules: DataFrame, active: Column | None = None) -> DataFrame:
    """One row: total, locked, configurable, active rules of a table rule_id, status."""
    locked = F.col("rule_id").isin(*LOCKED)
    on = locked | F.col("status").isin("ACTIVE", "SYSTEM", "AUTOMATIC", "SYSTEM_ENFORCED") if active is None else active
    return rules.agg(F.count("*").alias("total"), F.count_if(locked).alias("locked"), F.count_if(~locked).alias("configurable"), F.count_if(F.coalesce(on, F.lit(False))).alias("active"))
