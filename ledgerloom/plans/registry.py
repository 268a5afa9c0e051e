"""Named queries over the standard tables, with the SQL that must give the same rows.

The SQL is written apart from the DataFrame code: similarity comes from common subsequences by recursion, consumption in row order from walks with the list of rows that are used up, requests and range yields from folds.
Only the fingerprint of an export has none. Classified rows include batches; their SQL searches sums of one-sided rows recursively.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import normalize, similarity
from ledgerloom.operators import decisions, explore, export, governance, profile, rules, summary, tiers, waterfall, wide
from ledgerloom.sources.ledgers import ledgers, sql, tranches, wide as wide_table
from ledgerloom.sources import versions
from ledgerloom.sources.store import materialize, new_path
from ledgerloom.sources.tables import read

FLAGSHIP = "wide_verdicts"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(make: Query) -> Query:
        QUERIES[make.__name__] = make
        if oracle is not None:
            ORACLES[make.__name__] = sql(oracle)
        return make

    return add


def lcs_sql(name: str, pairs: str) -> str:
    """CTEs up to `name` (a, b, lcs): the length of the longest common subsequence of the distinct a, b of `pairs`, a character of a at a time."""
    return f"""{name}_rows AS (SELECT DISTINCT a, b, 0 AS i, list_transform(range(length(b)), lambda x: 0::bigint) AS line FROM {pairs}
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(best) + 1), lambda j: list_max(best[1:j])) FROM (
    SELECT *, list_transform(range(1, length(b) + 1), lambda j: greatest(line[j], (CASE WHEN j > 1 THEN line[j - 1] ELSE 0 END) + (CASE WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN 1 ELSE 0 END))) AS best FROM {name}_rows WHERE i < length(a))),
{name} AS (SELECT a, b, coalesce(line[length(b)], 0) AS lcs FROM {name}_rows WHERE i = length(a))"""


LEDGER = "row_idx, record_id, vendor, doc, d, scenario, " + ", ".join(f"cast({c} AS double) AS {c}" for c in ("taxable", "igst", "cgst", "sgst"))
KEY = "vendor, doc, d, doc_type, taxable, rate, igst, cgst, sgst, cess"
EXACT = f""", ng AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY row_idx) AS nth FROM g), np AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY row_idx) AS nth FROM p),
exact AS (SELECT ng.row_idx AS g_idx, np.row_idx AS p_idx FROM ng JOIN np USING ({KEY}, nth))"""
REST = f"""{EXACT}, g1 AS (SELECT * FROM g WHERE row_idx NOT IN (SELECT g_idx FROM exact)), p1 AS (SELECT * FROM p WHERE row_idx NOT IN (SELECT p_idx FROM exact)),
pairs AS (SELECT g1.row_idx AS g_idx, p1.row_idx AS p_idx, abs(g1.taxable - p1.taxable) AS amount_diff, abs(date_diff('day', g1.d, p1.d)) AS day_diff FROM g1 JOIN p1 USING (vendor, doc)
  WHERE abs(g1.taxable - p1.taxable) <= 10 AND abs(date_diff('day', g1.d, p1.d)) <= 5),
counted AS (SELECT *, count(*) OVER (PARTITION BY g_idx) AS of_g, count(*) OVER (PARTITION BY p_idx) AS of_p FROM pairs)"""
BLANK = "('', 'NAN', 'NONE')"
CORE = "regexp_replace(regexp_replace(regexp_replace({0}, '^((INV|BILL|TAX|GST|REF|DN|CN|PO|VCH|[0-9]{{4}}|FY[0-9]{{2}})[/_ :-]*)+', ''), '[^A-Z0-9]', '', 'g'), '^0+', '')"
TIERS_SQL = f""", c AS (
  SELECT row_idx, scenario, upper(trim(coalesce(g_vendor, ''))) AS g_vendor, upper(trim(coalesce(p_vendor, ''))) AS p_vendor, upper(trim(coalesce(g_doc, ''))) AS g_doc, upper(trim(coalesce(p_doc, ''))) AS p_doc,
    g_date, p_date, g_taxable, p_taxable, g_igst, p_igst, g_tax, p_tax FROM {{w}}
), x AS (
  SELECT *, g_vendor IN {BLANK} AND g_doc IN {BLANK} AS g_blank, p_vendor IN {BLANK} AND p_doc IN {BLANK} AS p_blank, regexp_replace(g_doc, '[^A-Z0-9]', '', 'g') AS g_alnum, regexp_replace(p_doc, '[^A-Z0-9]', '', 'g') AS p_alnum,
    coalesce(nullif({CORE.format("g_doc")}, ''), g_doc) AS g_core, coalesce(nullif({CORE.format("p_doc")}, ''), p_doc) AS p_core,
    abs(g_taxable - p_taxable) AS t, abs(g_igst - p_igst) AS i, coalesce(abs(date_diff('day', g_date, p_date)), 999) AS days FROM c
), y AS (
  SELECT *, NOT g_blank AND NOT p_blank AND g_vendor = p_vendor AS vendor, NOT g_blank AND NOT p_blank AND g_doc = p_doc AS doc,
    NOT g_blank AND NOT p_blank AND (g_core = p_core OR g_alnum = p_alnum OR (length(g_alnum) >= 3 AND length(p_alnum) >= 3 AND (ends_with(g_alnum, p_alnum) OR ends_with(p_alnum, g_alnum)))) AS clean,
    coalesce(((month(g_date) = 3 AND month(p_date) = 4) OR (month(g_date) = 4 AND month(p_date) = 3)) AND year(g_date) = year(p_date), false) AND days <= 60 AS turn FROM x
), z AS (
  SELECT *, vendor AND doc AND g_date IS NOT DISTINCT FROM p_date AND t < 0.01 AND i < 0.01 AS tier1, vendor AND doc AND days > 0 AND days <= 30 AND t <= 10 AND i <= 10 AS drift, vendor AND doc AND turn AND t <= 10 AND i <= 10 AS cross_fy,
    vendor AND clean AND NOT doc AND t <= 10 AND days <= 1 AS prefix, vendor AND clean AND NOT doc AND t <= 10 AND days > 1 AND days <= 30 AS compound FROM y
), z2 AS (
  SELECT *, NOT tier1 AND doc AND (drift OR cross_fy OR (t >= 0.01 AND t <= 10) OR (i >= 0.01 AND i <= 10)) AS tier2 FROM z
), z3 AS (
  SELECT *, NOT tier1 AND NOT tier2 AND (prefix OR compound OR (vendor AND clean AND t <= 50)) AS tier3 FROM z2
)"""
VERDICTS_SQL = """, v AS (
  SELECT * EXCLUDE (batch_row), batch_row IS NOT NULL OR (NOT (tier1 OR tier2 OR tier3) AND (regexp_matches(p_doc, 'BANK|CHG|CONSOL|VOUCHER|JV') OR contains(p_core, 'BANK')) AND vendor AND days <= 30) AS consolidated, NOT (tier1 OR tier2 OR tier3) AND vendor AND (doc OR clean) AND days <= 15 AND g_taxable - p_taxable >= 100 AS blocked,
    CASE WHEN tier1 THEN 'Exact Match' WHEN consolidated THEN 'Consolidated Match' WHEN blocked THEN 'Ineligible ITC [Sec 17(5)]' WHEN tier2 THEN 'Tolerance Match' WHEN tier3 THEN 'Near Match' WHEN g_blank AND NOT p_blank THEN 'PR Only' WHEN NOT g_blank AND p_blank THEN 'GST Only' ELSE 'Ambiguous' END AS verdict,
    CASE WHEN tier1 THEN 'EXACT_ZERO_VARIANCE' WHEN consolidated THEN 'BANKING_MULTI_TRANCHE' WHEN blocked THEN 'INELIGIBLE_ITC_17_5' WHEN cross_fy THEN 'CROSS_FY_TIMING' WHEN drift THEN 'DATE_OPERATIONAL_SHIFT' WHEN prefix THEN 'DOC_PREFIX_NORMALIZED' WHEN compound THEN 'COMPOUND_DOC_DATE_VARIATION'
      WHEN tier2 THEN 'COMMERCIAL_TOLERANCE' WHEN tier3 THEN 'NEAR_MATCH' WHEN g_blank AND NOT p_blank THEN 'PR_ONLY' WHEN NOT g_blank AND p_blank THEN 'GST_ONLY' ELSE 'AMBIGUOUS_COLLISION' END AS sub,
    CASE WHEN tier1 THEN 1 WHEN tier2 THEN 2 WHEN tier3 THEN 3 WHEN blocked OR consolidated THEN 4 ELSE 5 END AS tier, coalesce(nullif(g_vendor, ''), p_vendor) AS who, verdict IN ('Exact Match', 'Tolerance Match', 'Near Match', 'Consolidated Match') AS hit, CASE WHEN g_vendor <> '' THEN g_tax ELSE p_tax END AS tax FROM z3 LEFT JOIN (SELECT DISTINCT row_idx AS batch_row FROM batched) ON row_idx = batch_row
)"""


def batch_sql(key: str, rows: str, name: str) -> str:
    """CTE `name`: groups of `rows` with one `key` that sum up."""
    mode = lambda one, many: f"count(*) FILTER ({many} > 0) >= 2 AND count(*) FILTER ({one} > 0) >= 1 AND min(round({one}, 2)) FILTER ({one} > 0) = max(round({one}, 2)) FILTER ({one} > 0) AND round(abs(cast(sum(cast({many} AS decimal(18,2))) FILTER ({many} > 0) AS double) - min(round({one}, 2)) FILTER ({one} > 0)), 2) <= 5"
    return f"""{name}_first AS (SELECT *, first_value(e) OVER (PARTITION BY who, {key} ORDER BY row_idx) AS e0 FROM {rows} WHERE {key} IS NOT NULL),
{name}_sums AS (SELECT who, {key}, min(row_idx) AS batch, CASE WHEN {mode('g_taxable', 'p_taxable')} THEN '1:N' WHEN {mode('p_taxable', 'g_taxable')} THEN 'N:1' END AS mode
  FROM {name}_first GROUP BY who, {key} HAVING count(*) >= 2 AND bool_and(coalesce(abs(date_diff('day', d, e0)) <= 31, true))),
{name} AS (SELECT row_idx, batch, mode FROM {rows} JOIN {name}_sums USING (who, {key}) WHERE mode IS NOT NULL)"""


def wide_sql(w: str = "w") -> str:
    """CTEs up to v, the classified rows of the wide table w: comparisons, document batches, sums of one-sided rows, verdicts.

    Sums: for every target all subsets of 2 to 10 fitting items are listed (sub), in order of larger amounts first; a vendor's targets are walked through in order, each taking all that
    is free if that fits, else its nearest sum of free items. Limits of the search (60 items, 500 steps) aren't reached on these data.
    """
    filled = lambda c: f"CASE WHEN {c} NOT IN ('', 'NAN', 'NONE') THEN {c} END"
    return TIERS_SQL.replace("{w}", w) + f""", o0 AS (SELECT row_idx, coalesce({filled('g_vendor')}, {filled('p_vendor')}) AS who, {filled('p_doc')} AS p_doc, {filled('g_doc')} AS g_doc, coalesce({filled('p_core')}, {filled('g_core')}) AS core,
  coalesce(g_date, p_date) AS d, coalesce(p_date, g_date) AS e, g_taxable, p_taxable FROM z3 WHERE NOT (tier1 OR tier2 OR tier3) AND coalesce({filled('g_vendor')}, {filled('p_vendor')}) IS NOT NULL),
{batch_sql('p_doc', 'o0', 'b1')}, o1 AS (SELECT * FROM o0 WHERE row_idx NOT IN (SELECT row_idx FROM b1)),
{batch_sql('g_doc', 'o1', 'b2')}, o2 AS (SELECT * FROM o1 WHERE row_idx NOT IN (SELECT row_idx FROM b2)),
{batch_sql('core', 'o2', 'b3')}, o3 AS (SELECT * FROM o2 WHERE row_idx NOT IN (SELECT row_idx FROM b3)),
sided AS (SELECT row_idx, who, d, CASE WHEN g_taxable > 0 THEN 'G' ELSE 'P' END AS side, CASE WHEN g_taxable > 0 THEN g_taxable ELSE p_taxable END AS a FROM o3 WHERE (g_taxable > 0) <> (p_taxable > 0)),
goals AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY side DESC, row_idx) AS nth FROM sided),
items AS (SELECT t.who, t.nth, t.a AS goal, i.row_idx, round(i.a, 2) AS a, row_number() OVER (PARTITION BY t.who, t.nth ORDER BY round(i.a, 2) DESC, i.row_idx) AS pos
  FROM goals t JOIN sided i ON i.who = t.who AND i.side <> t.side AND i.a <= t.a + 5.0001 AND coalesce(abs(date_diff('day', t.d, i.d)) <= 31, true)),
able AS (SELECT who, nth, list(struct_pack(id := row_idx, a := a) ORDER BY pos) AS able FROM items GROUP BY who, nth),
sub AS (
  SELECT who, nth, goal, pos, [pos] AS path, [row_idx] AS ids, a AS total FROM items
  UNION ALL
  SELECT s.who, s.nth, s.goal, i.pos, list_append(s.path, i.pos), list_append(s.ids, i.row_idx), s.total + i.a FROM sub s JOIN items i ON i.who = s.who AND i.nth = s.nth AND i.pos > s.pos WHERE s.total + i.a <= s.goal + 5.0001 AND len(s.ids) < 10
),
sums AS (SELECT who, nth, list(ids ORDER BY round(abs(total - goal), 2), path) AS sums FROM sub WHERE len(ids) >= 2 AND abs(total - goal) <= 5.0001 GROUP BY who, nth),
steps AS (SELECT g.who, g.nth, g.row_idx, g.side, g.a AS goal, coalesce(able, []) AS able, coalesce(sums, []) AS sums FROM goals g LEFT JOIN able USING (who, nth) LEFT JOIN sums USING (who, nth)),
walk AS (
  SELECT who, 0::bigint AS nth, 0::bigint AS target, '' AS side, []::bigint[] AS chosen, []::bigint[] AS used FROM (SELECT DISTINCT who FROM sums)
  UNION ALL
  SELECT who, nth, row_idx, side, chosen, CASE WHEN len(chosen) > 0 THEN list_concat(used, list_append(chosen, row_idx)) ELSE used END FROM (
    SELECT s.*, w.used, CASE WHEN list_contains(w.used, s.row_idx) THEN []
      WHEN len(list_filter(s.able, lambda x: NOT list_contains(w.used, x.id))) BETWEEN 2 AND 10 AND abs(round(list_sum(list_transform(list_filter(s.able, lambda x: NOT list_contains(w.used, x.id)), lambda x: x.a)), 2) - s.goal) <= 5
        THEN list_transform(list_filter(s.able, lambda x: NOT list_contains(w.used, x.id)), lambda x: x.id)
      ELSE coalesce(list_filter(s.sums, lambda x: NOT list_has_any(x, w.used))[1], []) END AS chosen
    FROM walk w JOIN steps s ON s.who = w.who AND s.nth = w.nth + 1)
),
b4 AS (SELECT unnest(list_append(chosen, target)) AS row_idx, target AS batch, CASE side WHEN 'P' THEN 'N:1' ELSE '1:N' END AS mode FROM walk WHERE len(chosen) > 0),
batched AS (FROM b1 UNION ALL FROM b2 UNION ALL FROM b3 UNION ALL FROM b4)""" + VERDICTS_SQL


WIDE = wide_sql()


def money(c: str) -> str:
    return f"cast(sum(cast({c} AS decimal(18,2))) AS double)"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With batches."""
    return wide.classified(wide_table(spark, sf_dir))


@query(f"SELECT {LEDGER} FROM g")
def ledger_g(spark, sf_dir):
    return ledgers(spark, sf_dir)[0].selectExpr(*LEDGER.split(", "))


@query(f"SELECT {LEDGER} FROM p")
def ledger_p(spark, sf_dir):
    return ledgers(spark, sf_dir)[1].selectExpr(*LEDGER.split(", "))


@query(f"{EXACT} SELECT g_idx, p_idx FROM exact")
def tiers_exact(spark, sf_dir):
    return tiers.exact(*ledgers(spark, sf_dir))


def after_exact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g, p = ledgers(spark, sf_dir)
    one = materialize(tiers.exact(g, p), "exact", lean=True)
    return tiers.residual(g, one, "g_idx"), tiers.residual(p, one, "p_idx")


@query(f"{REST} SELECT g_idx, p_idx, cast(amount_diff AS double) AS amount_diff, cast(day_diff AS int) AS day_diff FROM counted WHERE of_g = 1 AND of_p = 1")
def tiers_tolerance(spark, sf_dir):
    m = tiers.tolerance(*after_exact(spark, sf_dir))[0]
    return m.withColumn("amount_diff", F.col("amount_diff").cast("double"))


@query(f"{REST} SELECT g_idx, count(*) AS n, min(p_idx) AS first_p FROM counted WHERE NOT (of_g = 1 AND of_p = 1) GROUP BY g_idx")
def tiers_conflicts(spark, sf_dir):
    c = tiers.tolerance(*after_exact(spark, sf_dir))[1]
    return c.select("g_idx", F.size("p_ids").cast("long").alias("n"), F.col("p_ids")[0].alias("first_p"))


@query(
    f"""{REST}, g2 AS (SELECT * FROM g1 WHERE row_idx NOT IN (SELECT g_idx FROM counted WHERE of_g = 1 AND of_p = 1)), p2 AS (SELECT * FROM p1 WHERE row_idx NOT IN (SELECT p_idx FROM counted WHERE of_g = 1 AND of_p = 1))
    SELECT g2.row_idx AS g_idx, p2.row_idx AS p_idx, cast(abs(date_diff('day', g2.d, p2.d)) AS int) AS days, cast(abs(g2.taxable - p2.taxable) AS double) AS amount_diff FROM g2 JOIN p2 USING (vendor, doc_type)
    WHERE abs(date_diff('day', g2.d, p2.d)) <= 30 AND abs(g2.taxable - p2.taxable) <= greatest(20000, abs(g2.taxable) * 0.5)"""
)
def near_blocked_pairs(spark, sf_dir):
    g, p = after_exact(spark, sf_dir)
    two = materialize(tiers.tolerance(g, p)[0].select("g_idx", "p_idx"), "tolerance", lean=True)
    pairs = tiers.blocked_pairs(tiers.residual(g, two, "g_idx"), tiers.residual(p, two, "p_idx"))
    return pairs.select(F.col("g_row_idx").alias("g_idx"), F.col("p_row_idx").alias("p_idx"), "days", F.col("amount_diff").cast("double").alias("amount_diff"))


def fit_sql(diff: str, scale: float) -> str:
    return f"greatest(0.0::double, 1 - cast({diff} AS double) / {scale}::double)"


REST2 = f"""{REST}, g2 AS (SELECT * FROM g1 WHERE row_idx NOT IN (SELECT g_idx FROM counted WHERE of_g = 1 AND of_p = 1)), p2 AS (SELECT * FROM p1 WHERE row_idx NOT IN (SELECT p_idx FROM counted WHERE of_g = 1 AND of_p = 1))"""
HEAD_DIFFS = ", ".join(f"abs(g2.{h} - p2.{h}) AS {h}_diff" for h in tiers.HEADS)
NEAR = f"""{REST2}, npair AS (SELECT g2.row_idx AS g_idx, p2.row_idx AS p_idx, regexp_replace(upper(trim(g2.doc)), '[^A-Z0-9]', '', 'g') AS a, regexp_replace(upper(trim(p2.doc)), '[^A-Z0-9]', '', 'g') AS b, cast(abs(date_diff('day', g2.d, p2.d)) AS int) AS days,
    abs(g2.taxable - p2.taxable) AS amount_diff, {HEAD_DIFFS}, g2.rate IS NOT DISTINCT FROM p2.rate AS same_rate FROM g2 JOIN p2 USING (vendor, doc_type) WHERE abs(date_diff('day', g2.d, p2.d)) <= 30 AND abs(g2.taxable - p2.taxable) <= greatest(20000, abs(g2.taxable) * 0.5)),
{lcs_sql('alike', 'npair')},
feature AS (SELECT npair.*, 2.0::double * lcs / (length(a) + length(b)) AS invoice FROM npair JOIN alike USING (a, b) WHERE 2.0::double * lcs / (length(a) + length(b)) >= 0.55),
rated AS (SELECT *, round_even(invoice * 0.35::double + {fit_sql('amount_diff', 10)} * 0.25::double + ({fit_sql('igst_diff', 2)} + {fit_sql('cgst_diff', 2)} + {fit_sql('sgst_diff', 2)} + {fit_sql('cess_diff', 2)}) / 4 * 0.20::double + {fit_sql('days', 30)} * 0.10::double + (CASE WHEN same_rate THEN 1 ELSE 0 END) * 0.05::double + 0.05::double, 6) AS score FROM feature),
ranked AS (SELECT *, a = b AND a <> '' AS norm_equal, cast(row_number() OVER (PARTITION BY g_idx ORDER BY score DESC, cast(p_idx AS varchar)) AS int) AS rank, amount_diff <= 10 AND greatest(igst_diff, cgst_diff, sgst_diff, cess_diff) <= 2 AS agree FROM rated WHERE score >= 0.45),
judged AS (SELECT *, max(score) FILTER (rank = 1) OVER (PARTITION BY g_idx) AS top, max(score) FILTER (rank = 2) OVER (PARTITION BY g_idx) AS second, count(*) FILTER (score >= 0.92) OVER (PARTITION BY g_idx) AS credible,
  score = max(score) OVER (PARTITION BY p_idx) AND count(*) OVER (PARTITION BY p_idx, score) = 1 AS reciprocal FROM ranked),
settled AS (SELECT *, CASE WHEN second IS NULL THEN 1.0 ELSE top - second END AS space, credible >= 2 OR coalesce(second >= 0.92::double - 0.05::double AND top - second <= 0.05::double, false) AS ambiguous FROM judged),
near AS (SELECT *, CASE WHEN ambiguous THEN 'AMBIGUOUS' WHEN rank = 1 AND score >= 0.92 AND agree AND reciprocal THEN 'NEAR_MATCH_PROPOSED' ELSE 'MATERIAL_MISMATCH' END AS status FROM settled)"""
OUTCOMES = f"""{NEAR}, per AS (SELECT g_idx, bool_or(status = 'AMBIGUOUS') AS amb, bool_or(status = 'NEAR_MATCH_PROPOSED') AS prop, bool_or(norm_equal AND NOT agree) AS mat FROM near GROUP BY g_idx),
outcomes AS (SELECT 'G' AS side, row_idx, CASE WHEN row_idx IN (SELECT g_idx FROM exact) THEN 'EXACT' WHEN row_idx IN (SELECT g_idx FROM counted WHERE of_g = 1 AND of_p = 1) THEN 'TOLERANCE' WHEN amb THEN 'AMBIGUOUS' WHEN prop THEN 'NEAR' WHEN mat THEN 'MISMATCH' ELSE 'G_ONLY' END AS outcome FROM g LEFT JOIN per ON g_idx = row_idx
  UNION ALL SELECT 'P', row_idx, CASE WHEN row_idx IN (SELECT p_idx FROM exact) THEN 'EXACT' WHEN row_idx IN (SELECT p_idx FROM counted WHERE of_g = 1 AND of_p = 1) THEN 'TOLERANCE' WHEN row_idx IN (SELECT p_idx FROM near WHERE norm_equal OR score >= 0.92::double - 0.05::double) THEN 'LINKED' ELSE 'P_ONLY' END FROM p)"""


def near_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = after_exact(spark, sf_dir)
    two = materialize(tiers.tolerance(g, p)[0].select("g_idx", "p_idx"), "tolerance", lean=True)
    return tiers.ranked(tiers.scored(tiers.blocked_pairs(tiers.residual(g, two, "g_idx"), tiers.residual(p, two, "p_idx"))))


@query(f"""{NEAR} SELECT g_idx, p_idx, invoice, norm_equal, days, amount_diff::double AS amount_diff, {', '.join(f'{h}_diff::double AS {h}_diff' for h in tiers.HEADS)}, score, rank, round_even(space, 6) AS gap, ambiguous, reciprocal, agree, status FROM near""")
def near_candidates(spark, sf_dir):
    found = near_stage(spark, sf_dir)
    return found.withColumns({c: F.col(c).cast("double") for c in ("amount_diff", *(f"{h}_diff" for h in tiers.HEADS))})


@query(f""", sdocs AS (SELECT DISTINCT vendor, regexp_replace(upper(trim(g.doc)), '[^A-Z0-9]', '', 'g') AS a, regexp_replace(upper(trim(p.doc)), '[^A-Z0-9]', '', 'g') AS b FROM g JOIN p USING (vendor)), {lcs_sql('alike', 'sdocs')}
    SELECT vendor, a, b, 2.0::double * lcs / (length(a) + length(b)) AS alike FROM sdocs JOIN alike USING (a, b) WHERE 2.0::double * lcs / (length(a) + length(b)) >= 0.85""")
def near_similar_documents(spark, sf_dir):
    """Pairs of similar document numbers of a vendor, without comparing all with all."""
    side = lambda df, s: df.select("vendor", normalize.alnum(F.col("doc")).alias(s))
    g, p = ledgers(spark, sf_dir)
    return similarity.similar_pairs(side(g, "a"), side(p, "b"), ["vendor"], 0.85)


@query(f"{OUTCOMES} FROM outcomes")
def tiers_reconcile(spark, sf_dir):
    return tiers.reconcile(*ledgers(spark, sf_dir))


@query(
    f"""SELECT row_idx, regexp_replace(upper(trim(doc)), '[^A-Z0-9]', '', 'g') AS alnum, coalesce(nullif({CORE.format("upper(trim(doc))")}, ''), upper(trim(doc))) AS core,
    regexp_replace(regexp_replace(regexp_replace(upper(trim(doc)), '^INV/', ''), '[^A-Z0-9]', '', 'g'), '^0+', '') AS light, upper(trim(vendor)) AS vendor FROM p"""
)
def normalizers(spark, sf_dir):
    p = ledgers(spark, sf_dir)[1]
    doc = F.col("doc")
    return p.select("row_idx", normalize.alnum(doc).alias("alnum"), normalize.doc_core(doc).alias("core"), normalize.doc_light(doc).alias("light"), normalize.identifier(F.col("vendor")).alias("vendor"))


@query(
    f"""{WIDE} SELECT row_idx, CASE WHEN g_blank AND NOT p_blank THEN 'PR Only' WHEN NOT g_blank AND p_blank THEN 'GST Only' WHEN vendor AND doc AND t < 0.01 AND i < 0.01 THEN 'Exact Match'
    WHEN vendor AND (doc OR g_alnum = p_alnum) AND t <= 10 AND i <= 10 THEN 'Tolerance Match' WHEN vendor AND t <= 10 THEN 'Near Match' ELSE 'Ambiguous' END AS verdict FROM z3"""
)
def wide_simple_verdicts(spark, sf_dir):
    return wide.simple_verdict(wide_table(spark, sf_dir)).select("row_idx", "verdict")


@query(f"{WIDE} SELECT row_idx, verdict, sub, tier FROM v")
def wide_verdicts(spark, sf_dir):
    return classified(spark, sf_dir).select("row_idx", "verdict", "sub", "tier")


@query(f"{WIDE} FROM b1 UNION ALL FROM b2 UNION ALL FROM b3")
def wide_document_batches(spark, sf_dir):
    return wide.document_batches(materialize(wide.open_rows(wide_table(spark, sf_dir)), "open", lean=True))[0]


@query(f"{WIDE} FROM batched")
def wide_batches(spark, sf_dir):
    return wide.batches(wide_table(spark, sf_dir))


@query(f"{wide_sql('tranches')} FROM batched")
def wide_tranche_batches(spark, sf_dir):
    """Split invoices whose parts carry other documents: only their sums tell."""
    return wide.batches(tranches(spark, sf_dir))


@query(f"{wide_sql('tranches')} SELECT row_idx, verdict, sub, tier FROM v")
def wide_tranche_verdicts(spark, sf_dir):
    return wide.classified(tranches(spark, sf_dir)).select("row_idx", "verdict", "sub", "tier")


def guarded_sql(a: str, b: str, lcs: str) -> str:
    return f"CASE WHEN length({a}) > 0 AND length({b}) > 0 AND abs(length({a}) - length({b})) <= 0.35 * greatest(length({a}), length({b})) THEN 2.0::double * {lcs} / (length({a}) + length({b})) ELSE 0 END"


CLOSE = "round(greatest(0.0::double, 100 - abs({0} - {1}) / greatest({0}, {1}, 1.0::double) * 100), 1)"
#: Ranked candidates of ambiguous rows: their own P side, the four nearest amounts of the vendor, the first three rows of the same core document.
CANDIDATES = f"""{WIDE}, ps AS (SELECT row_idx AS p_idx, p_vendor AS pv, p_core AS pc, p_doc AS pd, p_taxable AS pa, p_igst AS pt, days FROM v WHERE p_vendor NOT IN {BLANK} OR p_core NOT IN {BLANK} OR p_taxable > 0),
asking AS (SELECT row_idx, g_vendor AS gv, g_core AS gc, g_doc AS gd, g_taxable AS ga, g_igst AS gt, p_doc NOT IN {BLANK} OR p_taxable > 0 AS own FROM v WHERE verdict = 'Ambiguous'),
found AS (SELECT row_idx, row_idx AS p_idx FROM asking WHERE own UNION SELECT row_idx, p_idx FROM asking JOIN ps ON pv = gv AND gv NOT IN {BLANK} QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY abs(pa - ga), p_idx) <= 4
  UNION SELECT row_idx, p_idx FROM asking JOIN ps ON pc = gc AND gc NOT IN {BLANK} QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY p_idx) <= 3),
texts AS (SELECT gd AS a, pd AS b FROM found JOIN asking USING (row_idx) JOIN ps USING (p_idx) UNION SELECT gc, pc FROM found JOIN asking USING (row_idx) JOIN ps USING (p_idx)), {lcs_sql('alike', 'texts')},
rated AS (SELECT found.*, asking.* EXCLUDE (row_idx), ps.* EXCLUDE (p_idx), round(greatest({guarded_sql('gd', 'pd', 'x.lcs')}, {guarded_sql('gc', 'pc', 'y.lcs')}) * 100, 1) AS invoice, {CLOSE.format('ga', 'pa')} AS amount, {CLOSE.format('gt', 'pt')} AS tax,
  CASE WHEN days = 0 THEN 95.0 WHEN days <= 7 THEN 88.0 WHEN days <= 30 THEN 75.0 WHEN days <= 60 THEN 60.0 ELSE 40.0 END::double AS dated FROM found JOIN asking USING (row_idx) JOIN ps USING (p_idx) LEFT JOIN alike x ON x.a = gd AND x.b = pd LEFT JOIN alike y ON y.a = gc AND y.b = pc),
scored AS (SELECT *, cast(round(cast(cast(invoice * 0.40::double + amount * 0.30::double + tax * 0.15::double + dated * 0.15::double AS varchar) AS decimal(38,20)), 1) AS double) AS score FROM rated),
placed AS (SELECT *, cast(row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, p_idx) AS int) AS rank FROM scored QUALIFY count(*) OVER (PARTITION BY row_idx) >= 2),
pair AS (SELECT a.row_idx, round(a.score - b.score, 1) AS gap, CASE WHEN trim(a.pd) <> '' AND lower(trim(a.pd)) = lower(trim(b.pd)) AND abs(a.pa - b.pa) < 0.05 THEN 'ERP_DUPLICATE_ENTRY' WHEN a.score >= 90 THEN 'PROBABLE_EXACT_MATCH' WHEN a.invoice >= 90 AND abs(a.gt - a.pt) > 0.01 THEN 'VALUE_ROUNDING_VARIANCE'
  WHEN a.days > 0 THEN 'TIMING_CUTOFF_SHIFT' ELSE 'SPLIT_BATCH_DELIVERY' END AS category FROM placed a JOIN placed b ON a.row_idx = b.row_idx AND a.rank = 1 AND b.rank = 2)"""


@query(f"{CANDIDATES} SELECT row_idx, rank, p_idx, invoice, amount, tax, cast(days AS int) AS days, score, gap, category FROM placed JOIN pair USING (row_idx) WHERE rank <= 3")
def wide_candidates(spark, sf_dir):
    return wide.candidates(materialize(classified(spark, sf_dir), "classified"))


@query(f"{CANDIDATES} SELECT category, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 1) AS percent FROM pair GROUP BY category")
def summary_triage(spark, sf_dir):
    return summary.triage(wide_candidates(spark, sf_dir))


@query(
    f"""{WIDE} SELECT verdict, label, count(*) AS n, count(*) FILTER (WHERE verdict = label) AS agreements FROM (SELECT verdict, CASE WHEN scenario <= 8 THEN 'Exact Match' WHEN scenario <= 11 THEN 'Tolerance Match'
    WHEN scenario IN (12, 14) THEN 'Near Match' WHEN scenario = 16 THEN 'GST Only' WHEN scenario = 17 THEN 'PR Only' ELSE 'Other' END AS label FROM v) AS named GROUP BY verdict, label"""
)
def wide_concurrence(spark, sf_dir):
    s = F.col("scenario")
    label = F.when(s <= 8, "Exact Match").when(s <= 11, "Tolerance Match").when(s.isin(12, 14), "Near Match").when(s == 16, "GST Only").when(s == 17, "PR Only").otherwise("Other")
    named = classified(spark, sf_dir).withColumn("label", label).withColumn("c", wide.concurrence(F.col("verdict"), F.col("label")))
    return named.groupBy("verdict", "label").agg(F.count("*").alias("n"), F.count_if(F.col("c") == "AGREEMENT").alias("agreements"))


@query(
    """, a AS (SELECT row_idx, upper(trim(vendor)) AS v, regexp_replace(regexp_replace(regexp_replace(upper(trim(doc)), '^INV/', ''), '[^A-Z0-9]', '', 'g'), '^0+', '') AS n, d, cast(taxable AS double) AS taxable, cast(igst AS double) AS igst, cast(cgst AS double) AS cgst, cast(sgst AS double) AS sgst FROM g),
    b AS (SELECT row_idx, upper(trim(vendor)) AS v, regexp_replace(regexp_replace(regexp_replace(upper(trim(doc)), '^INV/', ''), '[^A-Z0-9]', '', 'g'), '^0+', '') AS n, d, cast(taxable AS double) AS taxable, cast(igst AS double) AS igst, cast(cgst AS double) AS cgst, cast(sgst AS double) AS sgst,
      count(*) OVER (PARTITION BY v, n) AS rivals FROM p)
    SELECT g_idx, p_idx FROM (SELECT a.row_idx AS g_idx, b.row_idx AS p_idx, row_number() OVER (PARTITION BY b.row_idx ORDER BY a.row_idx) AS nth FROM a JOIN b USING (v, n) WHERE rivals = 1 AND a.d = b.d AND abs(a.taxable - b.taxable) <= 0.05
      AND abs(a.igst + a.cgst + a.sgst - (b.igst + b.cgst + b.sgst)) <= 0.05 AND abs(a.igst - b.igst) <= 0.05 AND abs(a.cgst - b.cgst) <= 0.05 AND abs(a.sgst - b.sgst) <= 0.05) WHERE nth = 1"""
)
def waterfall_exact(spark, sf_dir):
    g, p = ledgers(spark, sf_dir)
    return waterfall.exact_pass(waterfall.prepare(g), waterfall.prepare(p)).select("g_idx", "p_idx")


#: Row order inside groups of rows that share candidates (table cand: g_idx, p_idx), one G row after another with the list of P rows that are used up.
IN_ORDER = """reach AS (SELECT DISTINCT g_idx AS g, g_idx AS h FROM cand UNION SELECT r.g, b.g_idx FROM reach r JOIN cand a ON a.g_idx = r.h JOIN cand b ON a.p_idx = b.p_idx),
steps AS (SELECT root, g_idx, row_number() OVER (PARTITION BY root ORDER BY g_idx) AS nth, ps FROM (SELECT g AS g_idx, min(h) AS root FROM reach GROUP BY g) JOIN (SELECT g_idx, list(p_idx ORDER BY rate DESC, p_idx) AS ps FROM cand GROUP BY g_idx) USING (g_idx)),
walk AS (SELECT root, 0::bigint AS nth, []::bigint[] AS used, 0::bigint AS g_idx, 0::bigint AS p_idx FROM (SELECT DISTINCT root FROM steps)
  UNION ALL SELECT root, nth, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, g_idx, pick FROM (SELECT s.root, s.nth, s.g_idx, w.used, list_filter(s.ps, lambda x: NOT list_contains(w.used, x))[1] AS pick FROM walk w JOIN steps s ON s.root = w.root AND s.nth = w.nth + 1))"""


def prepared_sql(table: str) -> str:
    light = "regexp_replace(regexp_replace(regexp_replace(upper(trim(doc)), '^INV/', ''), '[^A-Z0-9]', '', 'g'), '^0+', '')"
    return f"SELECT row_idx, upper(trim(vendor)) AS v, {light} AS n, d, taxable::double AS a, igst::double AS i, cgst::double AS c, sgst::double AS s, (igst + cgst + sgst)::double AS x FROM {table}"


def similar_sql(a: str, b: str, least: float) -> str:
    """Guarded similarity of two documents, the length rule first; `alike` has the subsequence."""
    return f"length({a}) > 0 AND length({b}) > 0 AND abs(length({a}) - length({b})) <= 0.35 * greatest(length({a}), length({b})) AND 2.0 * lcs / (length({a}) + length({b})) >= {least}"


def single_sql(name: str, g: str, p: str, case: str) -> str:
    """CTE `name`: g_idx, p_idx, sub: the first G row of each block of one P row that has a case."""
    return f"""{name}_pairs AS (SELECT g.row_idx AS g_idx, p.row_idx AS p_idx, abs(g.a - p.a) AS t, abs(g.x - p.x) AS xd, g.a - p.a AS over, p.a AS pa, g.x - p.x AS taxed, coalesce(abs(date_diff('day', g.d, p.d)), 0) AS days, coalesce(least(month(g.d), month(p.d)) = 3 AND greatest(month(g.d), month(p.d)) = 4, false) AS turn,
    greatest(g.i, g.c, g.s, p.i, p.c, p.s) > 0 AND greatest(abs(g.i - p.i), abs(g.c - p.c), abs(g.s - p.s)) > 0.05 AS heads FROM {g} g JOIN (SELECT *, count(*) OVER (PARTITION BY v, n) AS k FROM {p}) p ON g.v = p.v AND g.n = p.n AND k = 1),
{name} AS (SELECT g_idx, p_idx, sub FROM (SELECT *, {case} AS sub FROM {name}_pairs) WHERE sub IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_idx ORDER BY g_idx) = 1)"""


def left_sql(side: str, old: str, links: str) -> str:
    return f"SELECT * FROM {old} WHERE row_idx NOT IN (SELECT {side}_idx FROM {links})"


def batch_walk_sql(name: str, one: str, many: str, least: float, small: bool) -> str:
    """CTE `name`: batches, one row of `one` after another in row order inside a vendor, with the list of rows of `many` that are used up. small: combinations of a few rows count as well."""
    from itertools import combinations

    every = [list(c) for k in range(2, 6) for c in combinations(range(1, 9), k)]
    fits = lambda rows: f"len({rows}) >= 2 AND abs(list_sum(list_transform({rows}, lambda x: x.a)) - goal) <= 5"
    few = "CASE WHEN len(pool) > 8 THEN list_transform(list_sort(list_transform(pool, lambda x: struct_pack(far := abs(x.a - goal / 2.5), id := x.id, a := x.a)))[1:8], lambda x: struct_pack(id := x.id, a := x.a)) ELSE pool END"
    combos = f"coalesce(list_transform(list_filter({every}, lambda c: list_max(c) <= len(few) AND abs(list_sum(list_transform(c, lambda i: few[i].a)) - goal) <= 5)[1], lambda i: few[i]), [])"
    chosen = f"CASE WHEN {fits('pool')} THEN pool WHEN {fits('kin')} THEN kin WHEN len(pool) >= 2 THEN {combos} ELSE [] END" if small else f"CASE WHEN len(pool) >= 2 AND {fits('kin')} THEN kin ELSE [] END"
    return f"""{name}_line AS (SELECT v, list(struct_pack(id := row_idx, a := a) ORDER BY row_idx) AS line FROM {many} WHERE a > 0 GROUP BY v),
{name}_kin AS (SELECT o.row_idx, list(m.row_idx) AS kin FROM {one} o JOIN {many} m USING (v) LEFT JOIN alike ON alike.a = m.n AND alike.b = o.n WHERE {'length(o.n) > 0 AND ' if small else ''}(contains(m.n, o.n) OR contains(o.n, m.n) OR ({similar_sql('m.n', 'o.n', least)})) GROUP BY o.row_idx),
{name}_steps AS (SELECT v, row_idx, a AS goal, coalesce(kin, []) AS kin, line, row_number() OVER (PARTITION BY v ORDER BY row_idx) AS nth FROM {one} JOIN {name}_line USING (v) LEFT JOIN {name}_kin USING (row_idx) WHERE a > 0{'' if small else " AND v <> ''"}),
{name}_walk AS (SELECT v, 0::bigint AS nth, 0::bigint AS row_idx, 0::double AS goal, []::bigint[] AS used, []::struct(id bigint, a double)[] AS chosen FROM (SELECT DISTINCT v FROM {name}_steps)
  UNION ALL SELECT v, nth, row_idx, goal, list_concat(used, list_transform(chosen, lambda x: x.id)), chosen FROM (SELECT *, {chosen} AS chosen FROM (SELECT *, {few} AS few FROM (SELECT *, list_filter(pool, lambda x: list_contains(kids, x.id)) AS kin FROM (
    SELECT s.v, s.nth, s.row_idx, s.goal, s.kin, w.used, list_filter(s.line, lambda x: x.a <= s.goal + 5 AND NOT list_contains(w.used, x.id)) AS pool FROM {name}_walk w JOIN {name}_steps s ON s.v = w.v AND s.nth = w.nth + 1) AS q0(v, nth, row_idx, goal, kids, used, pool))))),
{name} AS (SELECT row_idx AS one_idx, part.id AS many_idx, part.a AS part, goal, list_sum(list_transform(chosen, lambda x: x.a)) AS total FROM {name}_walk, unnest(chosen) AS u(part))"""


SAME = "t <= 0.05 AND xd <= 0.05 AND NOT heads"
ONE_TO_ONE = "CASE WHEN over >= 100 AND pa > 0 AND taxed >= 0 THEN 'INELIGIBLE_ITC_17_5' WHEN turn AND days <= 60 AND t <= 10 THEN 'CROSS_FY' WHEN days > 0 AND days <= 30 AND NOT heads AND t <= 10 THEN 'DATE_PROXIMITY' WHEN days = 0 AND NOT heads AND t <= 10 THEN 'COMMERCIAL_TOLERANCE' END"
#: All passes of the waterfall, each on what the ones before have left. No row of these data lacks a vendor, a document or a date.
WATERFALL = f""", wg AS ({prepared_sql('g')}), wp AS ({prepared_sql('p')}), {single_sql('w1', 'wg', 'wp', f"CASE WHEN {SAME} AND days = 0 THEN 'EXACT_1_TO_1' END")},
wg1 AS ({left_sql('g', 'wg', 'w1')}), wp1 AS ({left_sql('p', 'wp', 'w1')}), docs AS (SELECT DISTINCT g.n AS a, p.n AS b FROM wg1 g JOIN wp1 p USING (v)), {lcs_sql('alike', 'docs')},
{batch_walk_sql('w2', 'wp1', 'wg1', 0.6, True)}, wg2 AS ({left_sql('many', 'wg1', 'w2')}), wp2 AS ({left_sql('one', 'wp1', 'w2')}), alike2 AS (SELECT a AS b, b AS a, lcs FROM alike),
{batch_walk_sql('w3', 'wg2', 'wp2', 0.7, False).replace('LEFT JOIN alike ON', 'LEFT JOIN alike2 AS alike ON')}, wg3 AS ({left_sql('one', 'wg2', 'w3')}), wp3 AS ({left_sql('many', 'wp2', 'w3')}),
{single_sql('w4', 'wg3', 'wp3', ONE_TO_ONE)}, wg4 AS ({left_sql('g', 'wg3', 'w4')}), wp4 AS ({left_sql('p', 'wp3', 'w4')}),
{single_sql('w5', 'wg4', 'wp4', "CASE WHEN heads AND t <= 10 AND xd <= 0.05 THEN 'TAX_HEAD_INTERCHANGE' END")}, wg5 AS ({left_sql('g', 'wg4', 'w5')}), wp5 AS ({left_sql('p', 'wp4', 'w5')}),
cand AS (SELECT g.row_idx AS g_idx, p.row_idx AS p_idx, 2.0 * lcs / (length(g.n) + length(p.n)) AS rate FROM wg5 g JOIN wp5 p ON g.v = p.v AND abs(g.a - p.a) <= 10 JOIN alike ON alike.a = g.n AND alike.b = p.n WHERE {similar_sql('g.n', 'p.n', 0.85)}), {IN_ORDER},
w6 AS (SELECT g_idx, p_idx FROM walk WHERE nth > 0 AND p_idx IS NOT NULL), wg6 AS ({left_sql('g', 'wg5', 'w6')}), wp6 AS ({left_sql('p', 'wp5', 'w6')}),
rivals AS (SELECT g.v, g.row_idx AS g_idx, list(p.row_idx ORDER BY p.row_idx) AS ps FROM wg6 g JOIN wp6 p USING (v) JOIN alike ON alike.a = g.n AND alike.b = p.n WHERE abs(g.a - p.a) <= 25 OR (2.0 * least(length(g.n), length(p.n)) / (length(g.n) + length(p.n)) >= 0.7 AND {similar_sql('g.n', 'p.n', 0.7)}) GROUP BY g.v, g.row_idx),
turns AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY g_idx) AS nth FROM rivals),
w7_walk AS (SELECT v, 0::bigint AS nth, 0::bigint AS g_idx, []::bigint[] AS used, []::bigint[] AS open FROM (SELECT DISTINCT v FROM turns)
  UNION ALL SELECT v, nth, g_idx, CASE WHEN len(open) >= 2 THEN list_append(used, open[1]) ELSE used END, open FROM (SELECT t.v, t.nth, t.g_idx, w.used, list_filter(t.ps, lambda x: NOT list_contains(w.used, x)) AS open FROM w7_walk w JOIN turns t ON t.v = w.v AND t.nth = w.nth + 1)),
w7 AS (SELECT g_idx, open[1] AS p_idx, 'COMPETING_' || len(open) AS sub FROM w7_walk WHERE len(open) >= 2),
waterfall AS (SELECT g_idx, p_idx, 'EXACT_MATCH' AS bucket, sub, 100.0::double AS share FROM w1
  UNION ALL SELECT many_idx, one_idx, 'TOLERANCE_MATCH', 'BATCH_N_TO_1', round(100 * part / goal, 1) FROM w2 UNION ALL SELECT one_idx, many_idx, 'TOLERANCE_MATCH', 'BATCH_1_TO_N', round(100 * part / total, 1) FROM w3
  UNION ALL SELECT g_idx, p_idx, CASE WHEN sub = 'INELIGIBLE_ITC_17_5' THEN 'INELIGIBLE' ELSE 'TOLERANCE_MATCH' END, sub, 100 FROM w4 UNION ALL SELECT g_idx, p_idx, 'NEAR_MATCH', sub, 100 FROM w5 UNION ALL SELECT g_idx, p_idx, 'NEAR_MATCH', 'DOC_PREFIX_NORMALIZED', 100 FROM w6
  UNION ALL SELECT g_idx, p_idx, 'AMBIGUOUS', sub, 100 FROM w7 UNION ALL SELECT row_idx, NULL, 'G_ONLY', 'G_ONLY', NULL FROM wg6 WHERE row_idx NOT IN (SELECT g_idx FROM w7) UNION ALL SELECT NULL, row_idx, 'P_ONLY', 'P_ONLY', NULL FROM wp6 WHERE row_idx NOT IN (SELECT p_idx FROM w7))"""


@query(f"{WATERFALL} FROM waterfall")
def waterfall_links(spark, sf_dir):
    return waterfall.waterfall(*ledgers(spark, sf_dir))


@query(f"{WATERFALL} SELECT DISTINCT 'G' AS side, g_idx AS row_idx, bucket, sub FROM waterfall WHERE g_idx IS NOT NULL UNION ALL SELECT DISTINCT 'P', p_idx, bucket, sub FROM waterfall WHERE p_idx IS NOT NULL")
def waterfall_dispositions(spark, sf_dir):
    return waterfall.dispositions(waterfall.waterfall(*ledgers(spark, sf_dir)))


@query(f"{WIDE} SELECT verdict, count(*) AS n, {money('g_taxable')} AS g_taxable, {money('p_taxable')} AS p_taxable, {money('g_tax')} AS g_tax, {money('p_tax')} AS p_tax FROM v GROUP BY verdict")
def summary_buckets(spark, sf_dir):
    return summary.bucket_counts(classified(spark, sf_dir))


@query(f"{WIDE} SELECT sub, count(*) AS n, {money('g_taxable')} AS g_taxable, {money('p_taxable')} AS p_taxable, {money('g_tax')} AS g_tax, {money('p_tax')} AS p_tax FROM v GROUP BY sub")
def summary_subclasses(spark, sf_dir):
    return summary.bucket_counts(classified(spark, sf_dir), "sub")


@query(f"{WIDE} SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS matched, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1) AS rate FROM v")
def summary_match_rate(spark, sf_dir):
    return summary.match_rate(classified(spark, sf_dir)).withColumn("rate", F.col("rate").cast("double"))


TIERS = ["Exact Match", "Consolidated Match", "Ineligible ITC [Sec 17(5)]", "Tolerance Match", "Near Match", "Ambiguous", "GST Only", "PR Only"]


@query(
    f"""{WIDE}, n AS (SELECT verdict, count(*) AS n, {money('tax')} AS tax, cast(list_position({TIERS!r}, verdict) - 1 AS int) AS tier FROM v GROUP BY verdict),
    r AS (SELECT *, cast(sum(n) OVER (ORDER BY tier) AS bigint) AS running, (SELECT count(*) FROM v) AS total FROM n) SELECT verdict, n, tax, tier, running, cast(round(100.0 * (total - running) / total, 1) AS double) AS left_percent FROM r"""
)
def summary_yields(spark, sf_dir):
    out = summary.yields(classified(spark, sf_dir), TIERS)
    return out.withColumn("left_percent", F.col("left_percent").cast("double"))


@query(
    f"""{WIDE} SELECT who AS vendor, count(*) AS invoices, count(*) FILTER (WHERE hit) AS matched, {money("CASE WHEN hit THEN tax ELSE 0 END")} AS claimable, {money("CASE WHEN hit THEN 0 ELSE tax END")} AS disputed,
    cast(round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1) AS double) AS match_percent,
    CASE WHEN 10 * count(*) FILTER (WHERE hit) < 7 * count(*) THEN 'HIGH' WHEN 10 * count(*) FILTER (WHERE hit) < 9 * count(*) THEN 'MED' ELSE 'LOW' END AS risk FROM v GROUP BY who"""
)
def summary_vendor_risk(spark, sf_dir):
    return summary.vendor_risk(classified(spark, sf_dir)).withColumn("match_percent", F.col("match_percent").cast("double"))


@query(f"{WIDE} SELECT verdict, count(*) AS n, cast(round(100.0 * count(*) / (SELECT count(*) FROM v AS o WHERE CASE WHEN v.verdict = 'PR Only' THEN o.p_vendor ELSE o.g_vendor END <> ''), 1) AS double) AS percent FROM v GROUP BY verdict")
def summary_matrix(spark, sf_dir):
    return summary.disposition_matrix(classified(spark, sf_dir)).withColumn("percent", F.col("percent").cast("double"))


@query(f"{WIDE} SELECT CASE WHEN round(t, 2) < 100 THEN 'below 100' WHEN round(t, 2) <= 1000 THEN '100 to 1000' ELSE 'above 1000' END AS band, count(*) AS n FROM v WHERE g_vendor <> '' AND p_vendor <> '' GROUP BY 1")
def summary_variance_bands(spark, sf_dir):
    return summary.variance_bands(classified(spark, sf_dir))


@query(f"{WIDE} SELECT row_idx, verdict, round(t, 2) AS diff FROM v WHERE NOT hit AND g_vendor <> '' AND p_vendor <> '' ORDER BY diff DESC, row_idx LIMIT 10")
def summary_top_mismatches(spark, sf_dir):
    return summary.top_mismatches(classified(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM g) AS g_rows, (SELECT count(*) FROM p) AS p_rows, cast((SELECT sum(taxable) FROM g) AS double) AS g_taxable, cast((SELECT sum(taxable) FROM p) AS double) AS p_taxable, cast((SELECT sum(taxable) FROM g) - (SELECT sum(taxable) FROM p) AS double) AS net")
def summary_totals(spark, sf_dir):
    return summary.totals(*ledgers(spark, sf_dir))


@query("SELECT cast(sum(least(a.n, b.n)) AS bigint) AS overlap FROM (SELECT taxable, count(*) AS n FROM g GROUP BY taxable) a JOIN (SELECT taxable, count(*) AS n FROM p GROUP BY taxable) b USING (taxable)")
def summary_overlap(spark, sf_dir):
    return summary.multiset_overlap(*ledgers(spark, sf_dir), "taxable")


@query(
    f"""{EXACT}, truth AS (SELECT g.row_idx AS g_idx, p.row_idx AS p_idx FROM g JOIN p USING (order_key) WHERE g.scenario <= 8), h AS (SELECT count(*) AS hits FROM exact SEMI JOIN truth ON exact.g_idx = truth.g_idx AND exact.p_idx = truth.p_idx)
    SELECT hits, (SELECT count(*) FROM exact) AS found, (SELECT count(*) FROM truth) AS expected, round(hits / (SELECT count(*) FROM exact), 4) AS "precision", round(hits / (SELECT count(*) FROM truth), 4) AS recall FROM h"""
)
def evaluation_exact(spark, sf_dir):
    g, p = ledgers(spark, sf_dir)
    truth = g.where("scenario <= 8").select("order_key", F.col("row_idx").alias("g_idx")).join(p.select("order_key", F.col("row_idx").alias("p_idx")), "order_key").drop("order_key")
    return summary.evaluation(tiers.exact(g, p), truth)


@query(f"{WIDE} SELECT row_idx, verdict FROM v WHERE verdict IN ('Ambiguous', 'Near Match') AND (g_vendor LIKE '%V0000001%' OR p_vendor LIKE '%V0000001%' OR g_doc LIKE '%V0000001%' OR p_doc LIKE '%V0000001%') AND round(t, 2) <= 1000 AND coalesce(g_date, p_date) >= date '1996-01-01'")
def explore_search(spark, sf_dir):
    return explore.search(classified(spark, sf_dir), explore.Filter(verdicts=("Ambiguous", "Near Match"), text="v0000001", most_diff=1000, since="1996-01-01")).select("row_idx", "verdict")


@query(
    f"""{REST}, q AS (SELECT abs(g1.taxable - p1.taxable) AS amount_diff, abs(date_diff('day', g1.d, p1.d)) AS days FROM g1 JOIN p1 USING (vendor, doc))
    SELECT amount, day, count(q.days) AS n FROM (SELECT unnest([1.0, 5.0, 10.0, 100.0])::double AS amount) CROSS JOIN (SELECT unnest([0, 5, 30]) AS day) LEFT JOIN q ON amount_diff <= amount AND days <= day GROUP BY amount, day"""
)
def explore_what_if(spark, sf_dir):
    g, p = after_exact(spark, sf_dir)
    pairs = g.select("vendor", "doc", F.col("taxable").alias("a"), F.col("d").alias("x")).join(p.select("vendor", "doc", F.col("taxable").alias("b"), F.col("d").alias("y")), ["vendor", "doc"])
    pairs = pairs.select(F.abs(F.col("a") - F.col("b")).cast("double").alias("amount_diff"), normalize.days_apart(F.col("x"), F.col("y")).alias("days"))
    return explore.what_if(spark, pairs, [1, 5, 10, 100], [0, 5, 30])


@query(
    f"""{WIDE} SELECT row_idx, nullif(g_vendor, '') AS g_vendor, nullif(g_doc, '') AS g_doc, g_date, CASE WHEN g_vendor <> '' THEN g_taxable END AS g_taxable, CASE WHEN g_vendor <> '' THEN g_tax END AS g_tax, CASE WHEN g_vendor <> '' THEN round(g_taxable + g_tax, 2) END AS g_value,
    nullif(p_vendor, '') AS p_vendor, nullif(p_doc, '') AS p_doc, p_date, CASE WHEN p_vendor <> '' THEN p_taxable END AS p_taxable, CASE WHEN p_vendor <> '' THEN p_tax END AS p_tax, CASE WHEN p_vendor <> '' THEN round(p_taxable + p_tax, 2) END AS p_value,
    CASE WHEN g_vendor <> '' AND p_vendor <> '' THEN round(p_taxable - g_taxable, 2) END AS taxable_diff, CASE WHEN g_vendor <> '' AND p_vendor <> '' THEN round(p_tax - g_tax, 2) END AS tax_diff, CASE WHEN g_vendor <> '' AND p_vendor <> '' THEN cast(date_diff('day', g_date, p_date) AS int) END AS days_diff, verdict,
    CASE verdict WHEN 'Exact Match' THEN 'Matched' WHEN 'Tolerance Match' THEN 'Matched' WHEN 'Consolidated Match' THEN 'Matched' WHEN 'Near Match' THEN 'Probable' WHEN 'GST Only' THEN 'Missing in P' WHEN 'PR Only' THEN 'Missing in G' ELSE 'Review' END AS section FROM v"""
)
def export_report(spark, sf_dir):
    return export.report(classified(spark, sf_dir))


@query()
def export_fingerprint(spark, sf_dir):
    return export.fingerprint(classified(spark, sf_dir), ["row_idx", "verdict", "sub"])


SHARE = "coalesce(round(count(*) FILTER ({0}) / count(c), 4), 0)"


def profile_sql(name: str, text: str, kind: str) -> str:
    order = "cast(c AS double)" if kind == "number" else "c"
    return f"""SELECT '{name}' AS "column", count(*) AS "rows", count(c) AS non_null, cast(round(100.0 * (count(*) - count(c)) / count(*), 2) AS double) AS null_percent, count(DISTINCT c) AS "distinct", arg_min(c, {order}) AS lowest, arg_max(c, {order}) AS highest,
    {SHARE.format("regexp_full_match(c, '-?[0-9]*[.]?[0-9]+')")} AS numeric_share, {SHARE.format("try_cast(c AS date) IS NOT NULL")} AS date_share, 0.0::double AS tax_id_share, 0.0::double AS pan_share, 0.0::double AS hex_share, {SHARE.format("regexp_full_match(c, '[0-9]{1,2}([.][0-9]+)?|100([.]0+)?')")} AS percent_share,
    {"'yyyy-MM-dd'" if kind == "date" else "NULL"} AS date_format, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT {text} AS x FROM p ORDER BY x LIMIT 3)) AS samples FROM (SELECT {text} AS c FROM p)"""


@query(" UNION ALL ".join(profile_sql(n, t, k) for n, t, k in (("vendor", "vendor", "text"), ("d", "cast(d AS string)", "date"), ("taxable", "cast(taxable AS string)", "number"), ("rate", "cast(rate AS string)", "number"))))
def profile_ledger(spark, sf_dir):
    out = profile.profile(ledgers(spark, sf_dir)[1], ["vendor", "d", "taxable", "rate"])
    return out.withColumns({"null_percent": F.col("null_percent").cast("double"), "samples": F.array_join("samples", "|")})


@query("""SELECT * FROM (VALUES ('vendor', 'string'), ('d', 'date'), ('taxable', 'number'), ('rate', 'number')) AS t("column", type)""")
def profile_types(spark, sf_dir):
    return profile.inferred_types(profile.profile(ledgers(spark, sf_dir)[1], ["vendor", "d", "taxable", "rate"]))


@query("""SELECT * FROM (VALUES ('vendor', true), ('cess', true), ('nothing', false)) AS t("column", usable)""")
def profile_available_rules(spark, sf_dir):
    return profile.available_rules(ledgers(spark, sf_dir)[1].withColumn("nothing", F.lit(" ")), ["vendor", "cess", "nothing"])


RULED = "regexp_replace(ltrim(regexp_replace(regexp_replace(upper(trim(regexp_replace({0}, '[ ]+', ' ', 'g'))), '^((INV|BILL|TAX|GST|REF|DN|CN)[-_ /:]*)+', ''), '[^A-Za-z0-9]', '', 'g'), '0'), '^$', '0')"
#: One G row at most has a document here, so the first free P row of each G row is the first one that passes.
RULES = f""", rg AS (SELECT *, {RULED.format('doc')} AS n FROM g), rp AS (SELECT *, {RULED.format('doc')} AS n FROM p), rpair AS (SELECT rg.row_idx AS g_idx, rp.row_idx AS p_idx, rg.doc = rp.doc AS raw, abs(rg.taxable - rp.taxable)::double AS t, abs(date_diff('day', rg.d, rp.d)) AS days
  FROM rg JOIN rp USING (vendor, n))"""


@query(f"{RULES} SELECT g_idx, min(p_idx) AS p_idx FROM rpair WHERE t <= 10.0001 AND days <= 30 GROUP BY g_idx")
def rules_simulate(spark, sf_dir):
    return rules.simulate(*ledgers(spark, sf_dir), rules.DEFAULT)


@query(
    f"""{RULES}, tiered AS (SELECT g_idx, min(CASE WHEN raw AND t <= 0.0001 AND days = 0 THEN 'Tier 1: Strict' WHEN t <= 0.0001 AND days = 0 THEN 'Tier 2: Normalized' ELSE 'Tier 3: Tolerance' END) AS tier FROM rpair WHERE t <= 10.0001 AND days <= 30 GROUP BY g_idx),
    y AS (SELECT tier, count(*) AS n, cast(sum(igst + cgst + sgst) AS double) AS tax FROM tiered JOIN g ON g_idx = row_idx GROUP BY tier)
    SELECT tier, n, tax, cast(sum(n) OVER (ORDER BY tier) AS bigint) AS running, cast(round(100.0 * sum(n) OVER (ORDER BY tier) / (SELECT count(*) FROM g), 1) AS double) AS percent FROM y"""
)
def rules_tier_yields(spark, sf_dir):
    g, p = ledgers(spark, sf_dir)
    return rules.tier_yields(rules.tiered(g, p), g)


@query(
    f"""{RULES} SELECT 'vendor' AS rule, cast(sum(least(a.k, b.k)) AS bigint) AS pairs FROM (SELECT vendor, count(*) AS k FROM g GROUP BY vendor) a JOIN (SELECT vendor, count(*) AS k FROM p GROUP BY vendor) b USING (vendor)
    UNION ALL SELECT 'document', cast(sum(least(a.k, b.k)) AS bigint) FROM (SELECT n, count(*) AS k FROM rg GROUP BY n) a JOIN (SELECT n, count(*) AS k FROM rp GROUP BY n) b USING (n)"""
)
def rules_text_yields(spark, sf_dir):
    g, p = ledgers(spark, sf_dir)
    return rules.rule_yield(g, p, rules.VENDOR).unionByName(rules.rule_yield(g, p, rules.DOC))


#: A fold over arrivals of values and their departures a tolerance later: who arrives meets the longest waiting row of the other side. ga, pa: arrived so far; gr, pr: gone so far.
STATE = "struct_pack(side := '', gone := 0, k := 0::bigint, n := {n}, ga := {ga}, gr := {gr}, pa := {pa}, pr := {pr})"


def state(**changed: str) -> str:
    return STATE.format(**{c: f"s.{c}" for c in ("n", "ga", "gr", "pa", "pr")} | {c: f"s.{c} + 1" if v == "+" else v for c, v in changed.items()})


def waiting_sql(name: str, value: str, tolerance: str) -> str:
    zero = STATE.format(n="0::bigint", ga="0::bigint", gr="0::bigint", pa="0::bigint", pr="0::bigint")
    return f"""SELECT '{name}' AS rule, list_reduce(events, lambda s, e: CASE WHEN e.gone = 1 AND e.side = 'G' THEN {state(gr='greatest(s.gr, e.k)')} WHEN e.gone = 1 THEN {state(pr='greatest(s.pr, e.k)')}
    WHEN e.side = 'G' AND s.pa > s.pr THEN {state(n='+', ga='+', gr='+', pr='+')} WHEN e.side = 'G' THEN {state(ga='+')} WHEN s.ga > s.gr THEN {state(n='+', gr='+', pa='+', pr='+')} ELSE {state(pa='+')} END, {zero}).n AS pairs
    FROM (SELECT list({zero.replace("side := ''", "side := side").replace('gone := 0', 'gone := gone').replace('k := 0::bigint', 'k := k')} ORDER BY x, gone, side, k) AS events FROM (
      SELECT side, k, x, gone FROM (SELECT 'G' AS side, {value} AS v, row_number() OVER (ORDER BY {value}) AS k FROM g UNION ALL SELECT 'P', {value}, row_number() OVER (ORDER BY {value}) FROM p), LATERAL (SELECT v AS x, 0 AS gone UNION ALL SELECT v + {tolerance}, 1)))"""


@query(f"""{waiting_sql('amount', 'taxable', '10')} UNION ALL {waiting_sql('date', "date_diff('day', date '1970-01-01', d)", '30')}""")
def rules_range_yields(spark, sf_dir):
    g, p = ledgers(spark, sf_dir)
    return rules.rule_yield(g, p, rules.AMOUNT).unionByName(rules.rule_yield(g, p, rules.DAY))


@query(
    f""", cand AS (SELECT g.row_idx AS g_idx, p.row_idx AS p_idx, 0 AS rate FROM g JOIN p ON p.taxable BETWEEN g.taxable - 10.0001 AND g.taxable + 10.0001 WHERE abs(date_diff('day', g.d, p.d)) <= 30), {IN_ORDER}
    SELECT g_idx, p_idx FROM walk WHERE nth > 0 AND p_idx IS NOT NULL"""
)
def rules_without_text(spark, sf_dir):
    return rules.simulate(*ledgers(spark, sf_dir), (rules.AMOUNT, rules.DAY))


#: One vendor with a third of all rows: orders of every third key are booked under it.
HOT = "CASE WHEN order_key % 3 = 0 THEN 'V99999999' ELSE vendor END"


def hot_ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(df.withColumn("vendor", F.expr(HOT)) for df in ledgers(spark, sf_dir))


#: The four passes: no document here is without a vendor, and equal raw documents are equal by rule, so the second pass has one kind of candidates. fit() is a share of likeness.
FIT = "greatest(0.0::double, 1 - abs({0} - {1}) / greatest({0}, 1.0::double))"
PASSES = f"""{RULES}, r1 AS (SELECT g_idx, min(p_idx) AS p_idx FROM rpair WHERE t <= 0.05 AND days = 0 GROUP BY g_idx),
c2 AS (SELECT g_idx, list(p_idx ORDER BY p_idx) AS ps FROM rpair WHERE t <= 10.001 AND days <= 30 AND g_idx NOT IN (SELECT g_idx FROM r1) AND p_idx NOT IN (SELECT p_idx FROM r1) GROUP BY g_idx), r2 AS (SELECT g_idx, ps[1] AS p_idx FROM c2 WHERE len(ps) = 1),
rg2 AS (SELECT *, taxable::double AS a, (igst + cgst + sgst)::double AS x FROM rg WHERE row_idx NOT IN (SELECT g_idx FROM r1 UNION SELECT g_idx FROM r2)), rp2 AS (SELECT *, taxable::double AS a, (igst + cgst + sgst)::double AS x FROM rp WHERE row_idx NOT IN (SELECT p_idx FROM r1 UNION SELECT p_idx FROM r2)),
rdocs AS (SELECT DISTINCT g.n AS a, p.n AS b FROM rg2 g JOIN rp2 p USING (vendor)), {lcs_sql('alike', 'rdocs')},
r3_near AS (SELECT g.vendor, g.row_idx AS g_idx, list(p.row_idx ORDER BY p.row_idx) AS ps FROM rg2 g JOIN rp2 p USING (vendor) JOIN alike ON alike.a = g.n AND alike.b = p.n WHERE g.row_idx NOT IN (SELECT g_idx FROM c2 WHERE len(ps) > 1) AND abs(g.a - p.a) <= 50 AND abs(date_diff('day', g.d, p.d)) <= 45
  AND (g.n = p.n OR (length(g.n) >= 3 AND contains(p.n, g.n)) OR (length(p.n) >= 3 AND contains(g.n, p.n)) OR ({similar_sql('g.n', 'p.n', 0.85)})) GROUP BY g.vendor, g.row_idx),
r3_steps AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY g_idx) AS nth FROM r3_near),
r3_walk AS (SELECT vendor, 0::bigint AS nth, 0::bigint AS g_idx, []::bigint[] AS used, []::bigint[] AS open FROM (SELECT DISTINCT vendor FROM r3_steps)
  UNION ALL SELECT vendor, nth, g_idx, CASE WHEN len(open) = 1 THEN list_append(used, open[1]) ELSE used END, open FROM (SELECT s.vendor, s.nth, s.g_idx, w.used, list_filter(s.ps, lambda x: NOT list_contains(w.used, x)) AS open FROM r3_walk w JOIN r3_steps s ON s.vendor = w.vendor AND s.nth = w.nth + 1)),
r3 AS (SELECT g_idx, open[1] AS p_idx FROM r3_walk WHERE len(open) = 1),
rg3 AS (SELECT * FROM rg2 WHERE row_idx NOT IN (SELECT g_idx FROM r3)), rp3 AS (SELECT * FROM rp2 WHERE row_idx NOT IN (SELECT p_idx FROM r3)),
met AS (SELECT g_idx, unnest(ps) AS p_idx FROM c2 WHERE len(ps) > 1 UNION ALL SELECT g_idx, unnest(open) FROM r3_walk WHERE len(open) > 1),
offered AS (SELECT g_idx, p_idx, 0::bigint AS nth FROM met WHERE p_idx IN (SELECT row_idx FROM rp3) UNION ALL
  SELECT g.row_idx, p.row_idx, row_number() OVER (PARTITION BY g.row_idx ORDER BY abs(g.a - p.a), p.row_idx) FROM rg3 g JOIN rp3 p USING (vendor) WHERE g.row_idx NOT IN (SELECT g_idx FROM met) QUALIFY row_number() OVER (PARTITION BY g.row_idx ORDER BY abs(g.a - p.a), p.row_idx) <= 3),
r4 AS (SELECT g_idx, p_idx, nth, cast(printf('%.1f', (0.40::double * CASE WHEN abs(length(g.n) - length(p.n)) <= 0.35 * greatest(length(g.n), length(p.n)) THEN 2.0::double * lcs / (length(g.n) + length(p.n)) ELSE 0 END + 0.30::double * {FIT.format('g.a', 'p.a')} + 0.15::double * greatest(0.0::double, 1 - abs(date_diff('day', g.d, p.d)) / 60::double) + 0.15::double * {FIT.format('g.x', 'p.x')}) * 100) AS double) AS score
  FROM offered JOIN rg3 g ON g.row_idx = g_idx JOIN rp3 p ON p.row_idx = p_idx JOIN alike ON alike.a = g.n AND alike.b = p.n QUALIFY count(*) OVER (PARTITION BY g_idx) >= 2),
passes AS (SELECT g_idx, p_idx, 1 AS pass, 'EXACT_MATCH' AS bucket, 1 AS rank, 100.0::double AS score FROM r1 UNION ALL SELECT g_idx, p_idx, 2, 'TOLERANCE_MATCH', 1, 100 FROM r2 UNION ALL SELECT g_idx, p_idx, 3, 'NEAR_MATCH', 1, 100 FROM r3
  UNION ALL SELECT g_idx, p_idx, 4, 'AMBIGUOUS', cast(row_number() OVER (PARTITION BY g_idx ORDER BY score DESC, nth, p_idx) AS int), score FROM r4
  UNION ALL SELECT row_idx, NULL, 5, 'GSTR_ONLY', 1, NULL FROM rg3 WHERE row_idx NOT IN (SELECT g_idx FROM r4) UNION ALL SELECT NULL, row_idx, 5, 'PR_ONLY', 1, NULL FROM rp3)"""


@query(f"{PASSES} FROM passes")
def rules_passes(spark, sf_dir):
    return rules.four_passes(*ledgers(spark, sf_dir))


@query(f"{RULES} SELECT g_idx, min(p_idx) AS p_idx FROM rpair WHERE t <= 0.05 AND days = 0 GROUP BY g_idx")
def rules_pass_exact(spark, sf_dir):
    return rules_passes(spark, sf_dir).where("pass = 1").select("g_idx", "p_idx")


@query(f"{RULES}, r1 AS (SELECT g_idx, min(p_idx) AS p_idx FROM rpair WHERE t <= 0.05 AND days = 0 GROUP BY g_idx) SELECT g_idx, min(p_idx) AS p_idx FROM rpair WHERE t <= 10.001 AND days <= 30 AND g_idx NOT IN (SELECT g_idx FROM r1) AND p_idx NOT IN (SELECT p_idx FROM r1) GROUP BY g_idx HAVING count(*) = 1")
def rules_pass_tolerance(spark, sf_dir):
    return rules_passes(spark, sf_dir).where("pass = 2").select("g_idx", "p_idx")


@query("SELECT side, count(*) AS n FROM (SELECT 'G' AS side FROM g UNION ALL SELECT 'P' FROM p) GROUP BY side")
def rules_passes_cover(spark, sf_dir):
    """Every source row has one outcome: G rows by their first candidate, P rows as matched or residual."""
    links = rules_passes(spark, sf_dir).where("rank = 1")
    g = links.where("g_idx is not null").select(F.lit("G").alias("side"), "g_idx").distinct()
    p = links.where("pass != 4 and p_idx is not null").select(F.lit("P").alias("side"), "p_idx").distinct()
    return g.select("side").unionByName(p.select("side")).groupBy("side").agg(F.count("*").alias("n"))


@query(
    f"""{EXACT.replace('FROM p)', "FROM p2)").replace(', ng AS', ", p2 AS (SELECT * FROM p UNION ALL SELECT * REPLACE (row_idx + 5 AS row_idx) FROM p WHERE scenario = 9), ng AS")}, g1 AS (SELECT * FROM g WHERE row_idx NOT IN (SELECT g_idx FROM exact)), p1 AS (SELECT * FROM p2 WHERE row_idx NOT IN (SELECT p_idx FROM exact)),
    pairs AS (SELECT g1.row_idx AS g_idx, p1.row_idx AS p_idx FROM g1 JOIN p1 USING (vendor, doc) WHERE abs(g1.taxable - p1.taxable) <= 10 AND abs(date_diff('day', g1.d, p1.d)) <= 5), counted AS (SELECT *, count(*) OVER (PARTITION BY g_idx) AS of_g, count(*) OVER (PARTITION BY p_idx) AS of_p FROM pairs)
    SELECT g_idx, count(*) AS n, min(p_idx) AS first_p FROM counted WHERE NOT (of_g = 1 AND of_p = 1) GROUP BY g_idx"""
)
def tiers_conflicts_repeated(spark, sf_dir):
    """Conflicts where P books some documents twice."""
    g, p = ledgers(spark, sf_dir)
    p = p.unionByName(p.where("scenario = 9").withColumn("row_idx", F.col("row_idx") + 5))
    one = tiers.exact(g, p)
    c = tiers.tolerance(tiers.residual(g, one, "g_idx"), tiers.residual(p, one, "p_idx"))[1]
    return c.select("g_idx", F.size("p_ids").cast("long").alias("n"), F.col("p_ids")[0].alias("first_p"))


@query(f"{WIDE} SELECT {money('CASE WHEN hit THEN tax ELSE 0 END')} AS claimable, {money('CASE WHEN hit THEN 0 ELSE tax END')} AS disputed FROM v")
def summary_claims(spark, sf_dir):
    return summary.claims(classified(spark, sf_dir))


@query(f"{WIDE} SELECT who AS vendor, count(*) AS n FROM v WHERE NOT hit GROUP BY who ORDER BY n DESC, vendor LIMIT 5")
def summary_top_vendors(spark, sf_dir):
    return summary.top_vendors(classified(spark, sf_dir))


@query(f"{WIDE}, x2 AS (SELECT *, sum(p_taxable) OVER (PARTITION BY batch) AS total FROM batched JOIN (SELECT row_idx, p_taxable FROM w) USING (row_idx)) SELECT row_idx, batch, CASE WHEN total > 0 THEN round(100 * p_taxable / total, 1) ELSE 0 END AS share FROM x2")
def wide_batch_shares(spark, sf_dir):
    rows = wide_table(spark, sf_dir)
    return wide.shares(wide.batches(rows).join(rows.select("row_idx", "p_taxable"), "row_idx"), "p_taxable").select("row_idx", "batch", "share")


@query(f"{WIDE} SELECT row_idx FROM v WHERE who = (SELECT who FROM v WHERE row_idx = 10) AND row_idx <> 10 ORDER BY row_idx LIMIT 9")
def explore_related(spark, sf_dir):
    return explore.related(classified(spark, sf_dir), 10).select("row_idx")


@query(
    f"""{REST} SELECT g1.row_idx AS g_idx, p1.row_idx AS p_idx, concat_ws(',', CASE WHEN abs(g1.taxable - p1.taxable) > 10 THEN 'taxable_value' END, CASE WHEN abs(date_diff('day', g1.d, p1.d)) > 5 THEN 'document_date' END) AS blockers,
    abs(g1.taxable - p1.taxable) <= 10 AND abs(date_diff('day', g1.d, p1.d)) <= 5 AS passes FROM g1 JOIN p1 USING (vendor, doc)"""
)
def explore_blockers(spark, sf_dir):
    g, p = after_exact(spark, sf_dir)
    side = lambda df, s, i: df.select("vendor", "doc", F.col("row_idx").alias(i), F.col("taxable").alias(f"t{s}"), F.col("d").alias(f"d{s}"))
    pairs = side(g, "g", "g_idx").join(side(p, "p", "p_idx"), ["vendor", "doc"]).withColumns({"amount_diff": F.abs(F.col("tg") - F.col("tp")), "days": normalize.days_apart(F.col("dg"), F.col("dp"))})
    return explore.blockers(pairs, 10, 5).select("g_idx", "p_idx", F.array_join("blockers", ",").alias("blockers"), "passes")


PACKAGE_SIDE = {"Gstin": "vendor", "DocumentNumber": "doc", "DocumentDate": "d", "DocumentType": "doc_type", "TaxableValue": "taxable::double", "Rate": "rate::double", "IgstAmount": "igst::double", "CgstAmount": "cgst::double", "SgstAmount": "sgst::double", "CessAmount": "cess::double", "Value": "(taxable + igst + cgst + sgst + cess)::double"}


#: Decisions of a reviewer: proposals are approved unless their row number is a multiple of 7, and half of the ambiguous rows take their top candidate.
DECIDED = f"""{NEAR}, approved AS (SELECT g_idx, p_idx FROM near WHERE status = 'NEAR_MATCH_PROPOSED' AND g_idx % 7 <> 0), selected AS (SELECT g_idx, p_idx FROM near WHERE ambiguous AND rank = 1 AND g_idx % 40 = 19),
done AS (SELECT g_idx, p_idx, 'EXACT_MATCHED' AS status FROM exact UNION ALL SELECT g_idx, p_idx, 'TOLERANCE_MATCHED' FROM counted WHERE of_g = 1 AND of_p = 1 UNION ALL SELECT g_idx, p_idx, 'NEAR_MATCHED' FROM approved UNION ALL SELECT g_idx, p_idx, 'HUMAN_SELECTED' FROM selected),
tops AS (SELECT g_idx, min(p_idx) FILTER (rank = 1) AS p_idx, bool_or(ambiguous) AS unsure, bool_or(norm_equal AND NOT agree) AS apart, bool_or(status = 'NEAR_MATCH_PROPOSED') AS proposed FROM near GROUP BY g_idx),
out_rows AS (FROM done UNION ALL SELECT row_idx, CASE WHEN unsure OR proposed OR apart THEN p_idx END, CASE WHEN unsure THEN 'AMBIGUOUS' WHEN proposed THEN 'UNRESOLVED' WHEN apart THEN 'MATERIAL_MISMATCH' ELSE 'GST_ONLY' END FROM g LEFT JOIN tops ON g_idx = row_idx WHERE row_idx NOT IN (SELECT g_idx FROM done)
  UNION ALL SELECT NULL, row_idx, 'PR_ONLY' FROM p WHERE row_idx NOT IN (SELECT p_idx FROM done) AND row_idx NOT IN (SELECT p_idx FROM near WHERE norm_equal OR score >= 0.87))"""


def decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Outcomes with these decisions, the near stage, G and P; each written once."""
    g, p = ledgers(spark, sf_dir)
    one = materialize(tiers.exact(g, p), "exact", lean=True)
    g1, p1 = tiers.residual(g, one, "g_idx"), tiers.residual(p, one, "p_idx")
    two = materialize(tiers.tolerance(g1, p1)[0].select("g_idx", "p_idx"), "tolerance", lean=True)
    near = materialize(tiers.ranked(tiers.scored(tiers.blocked_pairs(tiers.residual(g1, two, "g_idx"), tiers.residual(p1, two, "p_idx")))), "near", lean=True)
    approved, selected = near.where("status = 'NEAR_MATCH_PROPOSED' AND g_idx % 7 <> 0"), near.where("ambiguous AND rank = 1 AND g_idx % 40 = 19")
    return materialize(export.decided_outcomes(one, two, near, approved, selected, g, p), "outcomes", lean=True), near, g, p


def snapshot_sql() -> str:
    """CTE snapshot: status and all columns of the package."""
    side = lambda t, prefix: ", ".join(f"{t}.{expr} AS {prefix}{n}" if "(" not in expr else f"({t}.taxable + {t}.igst + {t}.cgst + {t}.sgst + {t}.cess)::double AS {prefix}{n}" for n, expr in PACKAGE_SIDE.items())
    diffs = {"ValueDifference": "Value", "TaxableDifference": "TaxableValue", "IGSTDifference": "IgstAmount", "CGSTDifference": "CgstAmount", "SGSTDifference": "SgstAmount", "CessDifference": "CessAmount"}
    case = lambda values, otherwise: f"CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())} ELSE '{otherwise}' END"
    section = case(export.STATUS, "Unreconciled")
    known = {"ReconciliationSection": section, "SuggReconciliationSection": section, "Reason": case(export.REASONS, export.UNEXPLAINED), "ActionStatus": "'Actions Not Taken'", "Action": "'No Action'", "ReferenceId": "reference"}
    known |= {"ReconciledBy": "CASE WHEN status = 'HUMAN_SELECTED' THEN 'POC user' ELSE 'SYSTEM' END", "ManualReconciliation": "CASE WHEN status = 'HUMAN_SELECTED' THEN 'Yes' ELSE 'No' END"}
    known |= {n: f"round(PR{c} - CP{c}, 2)" for n, c in diffs.items()} | {f"{s}{n}": f"{s}{n}" for s in ("CP", "PR") for n in PACKAGE_SIDE}
    null = lambda c: "cast(NULL AS double)" if c in ("ReconciliationPercentage", "Gstr1GrcScore", "Gstr3bGrcScore") else "cast(NULL AS varchar)"
    return f"""{DECIDED}, both_sides AS (SELECT g_idx, p_idx, status, coalesce(g.record_id, p.record_id) AS reference, {side('g', 'CP')}, {side('p', 'PR')} FROM out_rows LEFT JOIN g ON g.row_idx = g_idx LEFT JOIN p ON p.row_idx = p_idx),
    snapshot AS (SELECT g_idx, p_idx, status, {', '.join(f"{known.get(c) or null(c)} AS {c}" for c in export.PACKAGE)} FROM both_sides)"""


SNAPSHOT = snapshot_sql()


@query(f"{SNAPSHOT} FROM snapshot")
def export_package(spark, sf_dir):
    """The report's columns for all outcomes of the stages and of decisions."""
    outcomes, _, g, p = decided(spark, sf_dir)
    return export.package(outcomes, g, p, "status")


@query(f"{SNAPSHOT} SELECT status, g_idx, p_idx, coalesce(CPDocumentNumber, PRDocumentNumber) AS document, Reason, TaxableDifference AS difference, coalesce(k, 0) AS candidates FROM snapshot LEFT JOIN (SELECT g_idx, count(*) AS k FROM near GROUP BY g_idx) USING (g_idx) WHERE status IN ('AMBIGUOUS', 'MATERIAL_MISMATCH', 'GST_ONLY', 'PR_ONLY')")
def export_unresolved(spark, sf_dir):
    outcomes, near, g, p = decided(spark, sf_dir)
    return export.unresolved_sheet(export.package(outcomes, g, p, "status"), near)


def summary_sheet_sql() -> str:
    open_ones = "status IN ('AMBIGUOUS', 'MATERIAL_MISMATCH', 'GST_ONLY', 'PR_ONLY', 'UNRESOLVED')"
    parts = {"g_records": "count(DISTINCT g_idx)", "p_records": "count(DISTINCT p_idx)", "resolved": f"count(*) FILTER (NOT {open_ones})", "unresolved": f"count(*) FILTER ({open_ones})"}
    parts |= {x.lower(): f"count(*) FILTER (status = '{x}')" for x in export.REASONS} | {"coverage": f"round(count(*) FILTER (NOT {open_ones}) / count(DISTINCT g_idx), 4)"}
    return DECIDED + " UNION ALL ".join(f" SELECT '{k}' AS metric, ({v})::double AS value FROM out_rows" for k, v in parts.items())


@query(summary_sheet_sql())
def export_summary(spark, sf_dir):
    return export.summary_sheet(decided(spark, sf_dir)[0])


#: Vendors as sessions: what a customer's row says stands for confirmations; vendors without booked rows have not been through all stages; the profile of customers in debt is not there.
SESSIONS = "SELECT 'V' || lpad(cast(c_custkey AS string), 8, '0') AS session, c_nationkey % 5 <> 0 AS mapping_confirmed, c_nationkey % 7 <> 0 AS policy_confirmed, booked.vendor IS NOT NULL AS stages_done, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS profile_id FROM {customer} LEFT JOIN (SELECT DISTINCT vendor FROM {p}) AS booked ON booked.vendor = 'V' || lpad(cast(c_custkey AS string), 8, '0')"


@query(
    f"""{DECIDED}, sessions AS ({SESSIONS.format(customer='customer', p='p')}), linked AS (SELECT vendor AS session, g_idx, p_idx FROM done JOIN g ON g.row_idx = g_idx),
    doubled AS (SELECT session, count(*) - 1 AS again FROM linked GROUP BY session, g_idx HAVING count(*) > 1 UNION ALL SELECT session, count(*) - 1 FROM linked GROUP BY session, p_idx HAVING count(*) > 1),
    waiting AS (SELECT g.vendor AS session, count(*) AS n FROM near JOIN g ON g.row_idx = g_idx WHERE status = 'NEAR_MATCH_PROPOSED' AND g_idx % 7 = 0 GROUP BY g.vendor)
    SELECT session, 'mapping_not_confirmed' AS code, 1::bigint AS n FROM sessions WHERE NOT mapping_confirmed UNION ALL SELECT session, 'policy_not_confirmed', 1 FROM sessions WHERE NOT policy_confirmed UNION ALL SELECT session, 'matching_incomplete', 1 FROM sessions WHERE NOT stages_done
    UNION ALL SELECT session, 'pending_match_decisions', n FROM waiting SEMI JOIN sessions ON sessions.session = waiting.session AND stages_done UNION ALL SELECT session, 'duplicate_consumption', sum(again)::bigint FROM doubled GROUP BY session
    UNION ALL SELECT session, 'profile_reference_invalid', 1 FROM sessions WHERE profile_id IS NOT NULL AND profile_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""
)
def export_blocking(spark, sf_dir):
    """Sessions that must not be exported, and why, from the same snapshot; selections of one P row for several G rows are duplicates."""
    outcomes, near, g, p = decided(spark, sf_dir)
    customer = read(spark, sf_dir, "customer")
    sessions = spark.sql(SESSIONS, customer=customer, p=p)
    vendor = g.select(F.col("vendor").alias("session"), F.col("row_idx").alias("g_idx"))
    links = outcomes.where(F.col("status").isin("EXACT_MATCHED", "TOLERANCE_MATCHED", "NEAR_MATCHED", "HUMAN_SELECTED")).join(vendor, "g_idx")
    pending = near.where("status = 'NEAR_MATCH_PROPOSED' AND g_idx % 7 = 0").join(vendor, "g_idx")
    return export.gate_codes(sessions, pending, links, customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("profile_id")), [c for c in export.REQUIRED if c not in export.PACKAGE])


def advice_sql() -> str:
    blank = "{0}_vendor IN ('', 'NAN', 'NONE', '—') AND {0}_alnum = ''"
    bucket = """CASE WHEN no_g AND NOT no_p THEN 'PR_ONLY' WHEN NOT no_g AND no_p THEN 'GSTR_ONLY' WHEN diff < 0.01 AND same THEN 'EXACT_MATCH' WHEN diff < 0.01 AND alike THEN 'NEAR_MATCH' WHEN diff <= 10 OR alike THEN 'TOLERANCE_MATCH' ELSE 'NEAR_MATCH' END"""
    sure = "CASE WHEN no_g <> no_p THEN 96.0 WHEN diff < 0.01 AND same THEN 98.0 WHEN diff < 0.01 AND alike THEN 94.0 WHEN diff <= 10 THEN 91.0 WHEN alike THEN 85.0 ELSE 72.0 END::double"
    each = {
        "EXACT_MATCH": "CASE WHEN no_g OR no_p OR diff >= 0.01 THEN 0 WHEN same AND g_doc <> '' THEN 98 WHEN alike AND g_alnum <> '' THEN 70 ELSE 0 END",
        "TOLERANCE_MATCH": "CASE WHEN no_g OR no_p THEN 0 WHEN diff <= 10 THEN 91 WHEN alike AND g_alnum <> '' AND diff <= 500 THEN 85 WHEN alike AND g_alnum <> '' THEN 60 ELSE 25 END",
        "NEAR_MATCH": "CASE WHEN no_g OR no_p THEN 0 WHEN alike AND g_alnum <> '' AND diff < 0.01 THEN 94 WHEN alike AND g_alnum <> '' THEN 45 WHEN diff <= 20 THEN 88 ELSE 55 END",
        "GSTR_ONLY": "CASE WHEN NOT no_g AND no_p THEN 96 ELSE 0 END",
        "PR_ONLY": "CASE WHEN no_g AND NOT no_p THEN 96 ELSE 0 END",
    }
    policy = {
        "EXACT_MATCH": "diff < 0.01 AND same AND g_doc <> ''", "TOLERANCE_MATCH": "diff <= 10", "NEAR_MATCH": "alike OR diff <= 20",
        "GSTR_ONLY": "p_taxable <= 0 AND p_alnum = ''", "PR_ONLY": "g_taxable <= 0 AND g_alnum = ''",
    }
    columns = [f"CASE WHEN recommended = '{b}' THEN confidence ELSE {c} END::double AS confidence_{b.lower()}" for b, c in each.items()] + [f"CASE WHEN {c} THEN 'OKAY' ELSE 'NOT_OKAY' END AS policy_{b.lower()}" for b, c in policy.items()]
    return f"""{TIERS_SQL.replace('{w}', 'w')}, a0 AS (SELECT *, round(t, 2) AS diff, g_doc = p_doc AS same, g_alnum = p_alnum AS alike, {blank.format('g')} AS no_g, {blank.format('p')} AND p_taxable = 0 AS no_p FROM z3),
    a1 AS (SELECT *, {bucket} AS recommended, {sure} AS confidence FROM a0) SELECT row_idx, recommended, confidence, {', '.join(columns)} FROM a1"""


@query(advice_sql())
def decide_advice(spark, sf_dir):
    """Advice for every row, whatever its verdict."""
    rows = decisions.advice(wide_table(spark, sf_dir))
    return rows.select("row_idx", "recommended", "confidence", *(f"{c}_{b.lower()}" for c in ("confidence", "policy") for b in decisions.BUCKETS))


CLASS = {"category": "'S' || cast(scenario AS string)", "confidence": "cast(scenario AS double) / 20", "review_status": "CASE scenario % 2 WHEN 1 THEN 'ai_proposed' ELSE 'human_confirmed' END", "needs_review": "scenario % 3 = 0"}
EXCEPTIONS = f"""{REST}, q AS (SELECT g1.record_id, p1.record_id AS other_id, abs(g1.taxable - p1.taxable)::double AS variance, round(1 - least(abs(g1.taxable - p1.taxable)::double, 1000) / 1000, 6) AS score FROM g1 JOIN p1 USING (vendor, doc)),
best AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n_candidates, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, other_id) AS nth FROM q),
x AS (SELECT g1.record_id, CASE WHEN best.record_id IS NULL THEN 'GST_ONLY' ELSE 'MATERIAL_MISMATCH' END AS status, vendor, vendor AS gstin, taxable::double AS amount, d, coalesce(n_candidates, 0) AS n_candidates, other_id AS best_id, score, variance,
    {', '.join(f"CASE WHEN scenario <> 16 THEN {e} END AS {c}" for c, e in CLASS.items())} FROM g1 LEFT JOIN best ON best.record_id = g1.record_id AND nth = 1
  UNION ALL SELECT record_id, 'PR_ONLY', vendor, vendor, taxable::double, d, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p1 WHERE record_id NOT IN (SELECT other_id FROM q))"""


def open_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exact stage leaves, with candidates of one vendor and document, and classes by scenario."""
    g, p = after_exact(spark, sf_dir)
    side = lambda df, r, t: df.select("vendor", "doc", F.col("record_id").alias(r), F.col("taxable").alias(t))
    variance = F.abs(F.col("a") - F.col("b")).cast("double")
    pairs = side(g, "record_id", "a").join(side(p, "other_id", "b"), ["vendor", "doc"]).select("record_id", "other_id", variance.alias("variance"), F.round(1 - F.least(variance, F.lit(1000.0)) / 1000, 6).alias("score"))
    fields = lambda df, status: df.select("record_id", status.alias("status"), "vendor", F.col("vendor").alias("gstin"), F.col("taxable").cast("double").alias("amount"), "d")
    mark = lambda c: pairs.select(F.col(c).alias("record_id"), F.lit(True).alias("paired")).distinct()
    rows = fields(g.join(mark("record_id"), "record_id", "left"), F.when(F.col("paired"), "MATERIAL_MISMATCH").otherwise("GST_ONLY")).unionByName(fields(p.join(mark("other_id"), "record_id", "left_anti"), F.lit("PR_ONLY")))
    return decisions.exceptions(rows, pairs, g.where("scenario <> 16").selectExpr("record_id", *(f"{e} AS {c}" for c, e in CLASS.items())))


@query(f"{EXCEPTIONS} FROM x")
def explore_exceptions(spark, sf_dir):
    return open_exceptions(spark, sf_dir)


@query(
    f"""{EXCEPTIONS} FROM x WHERE status <> 'PR_ONLY' AND vendor LIKE 'V0000%' AND gstin LIKE '%V%' AND amount >= 1000 AND amount <= 300000 AND d BETWEEN date '1992-06-01' AND date '1998-06-01' AND record_id LIKE '%1%'
    AND (n_candidates = 0 OR round(variance, 2) BETWEEN 1 AND 600 AND score BETWEEN 0.4 AND 1)"""
)
def explore_exceptions_by_source(spark, sf_dir):
    wanted = decisions.Search(statuses=("MATERIAL_MISMATCH", "GST_ONLY"), vendor="v0000", gstin="v", amount_min=1000, amount_max=300_000, date_from="1992-06-01", date_to="1998-06-01", variance_min=1, variance_max=600, score_min=0.4, score_max=1, record_id="1")
    return decisions.search(open_exceptions(spark, sf_dir), wanted)


@query(f"{EXCEPTIONS} FROM x WHERE category = 'S15' AND confidence BETWEEN 0.5 AND 0.9 AND review_status IN ('ai_proposed') AND needs_review")
def explore_exceptions_by_class(spark, sf_dir):
    wanted = decisions.Search(category="S15", confidence_min=0.5, confidence_max=0.9, review_status=("ai_proposed",), needs_review=True)
    return decisions.search(open_exceptions(spark, sf_dir), wanted)


LOOKUPS = (" g33", "row 32", "350", "v00000001")


@query(
    """, sides AS (SELECT 'G' AS side, row_idx, record_id, doc, vendor FROM g UNION ALL SELECT 'P', row_idx, record_id, doc, vendor FROM p)
    FROM (SELECT side, row_idx, record_id, doc, 'record_id' AS found_by FROM sides WHERE record_id = 'G33' ORDER BY side, row_idx LIMIT 1) UNION ALL FROM (SELECT side, row_idx, record_id, doc, 'row' FROM sides WHERE row_idx = 32 ORDER BY side, row_idx LIMIT 1)
    UNION ALL FROM (SELECT side, row_idx, record_id, doc, 'row' FROM sides WHERE row_idx = 350 ORDER BY side, row_idx LIMIT 1) UNION ALL FROM (SELECT side, row_idx, record_id, doc, 'vendor' FROM sides WHERE vendor = 'V00000001' ORDER BY side, row_idx LIMIT 1)"""
)
def explore_lookup(spark, sf_dir):
    g, p = ledgers(spark, sf_dir)
    found = [decisions.lookup(g, p, x) for x in LOOKUPS]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(
    """, light AS (SELECT g.row_idx AS g_idx, p.row_idx AS p_idx, g.doc AS g_doc, p.doc AS p_doc, g.row_idx % 7 <> 0 AS approved FROM g JOIN p ON g.vendor = p.vendor
      AND regexp_replace(regexp_replace(regexp_replace(upper(trim(g.doc)), '^INV/', ''), '[^A-Z0-9]', '', 'g'), '^0+', '') = regexp_replace(regexp_replace(regexp_replace(upper(trim(p.doc)), '^INV/', ''), '[^A-Z0-9]', '', 'g'), '^0+', '') WHERE g.doc <> p.doc)
    SELECT count(*) FILTER (approved) AS observations, round(count(*) FILTER (approved) / count(*), 4) AS ratio, (SELECT string_agg(g_doc || ' ↔ ' || p_doc, '|' ORDER BY g_idx, p_idx) FROM (FROM light WHERE approved ORDER BY g_idx, p_idx LIMIT 30)) AS evidence
    FROM light HAVING count(*) FILTER (approved) >= 5 AND count(*) FILTER (approved) >= 0.8 * count(*)"""
)
def decide_separator_pattern(spark, sf_dir):
    """Pairs whose documents differ in separators only, six of seven of them approved."""
    g, p = ledgers(spark, sf_dir)
    side = lambda df, s: df.select("vendor", normalize.doc_light(F.col("doc")).alias("light"), F.col("row_idx").alias(f"{s}_idx"), F.col("doc").alias(f"{s}_doc"))
    pairs = side(g, "g").join(side(p, "p"), ["vendor", "light"]).where("g_doc <> p_doc")
    status = F.when(F.col("g_idx") % 7 != 0, "NEAR_MATCH_APPROVED").otherwise("REJECTED_CANDIDATE")
    return decisions.separator_pattern(pairs.withColumns({"status": status, "same_vendor": F.lit(True), "norm_equal": F.lit(True), "raw_equal": F.lit(False)}))


@query(
    """, o AS (SELECT g.row_idx AS g_idx, p.row_idx * 10 + c AS p_idx FROM g JOIN p USING (vendor, doc) CROSS JOIN (SELECT unnest([0, 5]) AS c) WHERE g.scenario = 9),
    choice AS (SELECT DISTINCT g_idx, CASE g_idx % 3 WHEN 0 THEN max(p_idx) OVER (PARTITION BY g_idx) WHEN 1 THEN -1 END AS p_idx FROM o), used AS (SELECT p_idx FROM o WHERE g_idx % 4 = 1),
    taken AS (SELECT * FROM choice WHERE g_idx % 3 = 0 AND p_idx NOT IN (SELECT p_idx FROM used))
    SELECT o.g_idx, o.p_idx, CASE WHEN taken.g_idx IS NULL THEN 'AMBIGUOUS' WHEN taken.p_idx = o.p_idx THEN 'NEAR_MATCH_APPROVED' ELSE 'REJECTED_CANDIDATE' END AS status FROM o LEFT JOIN taken USING (g_idx)"""
)
def decide_selection(spark, sf_dir):
    """Two candidates each: a third of the rows takes the second one, a third names none of its candidates, a third is left; some candidates are consumed."""
    g, p = ledgers(spark, sf_dir)
    pairs = g.where("scenario = 9").select("vendor", "doc", F.col("row_idx").alias("g_idx")).join(p.select("vendor", "doc", F.explode(F.array(F.col("row_idx") * 10, F.col("row_idx") * 10 + 5)).alias("p_idx")), ["vendor", "doc"]).select("g_idx", "p_idx")
    choices = pairs.groupBy("g_idx").agg(F.max("p_idx").alias("p_idx")).withColumn("p_idx", F.when(F.col("g_idx") % 3 == 0, F.col("p_idx")).when(F.col("g_idx") % 3 == 1, F.lit(-1)))
    return decisions.after_selection(pairs, decisions.selected(pairs, pairs.where("g_idx % 4 = 1"), choices))


#: Orders as runs of customers.
RUNS = """SELECT o_custkey AS client, o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'COMPLETED_WITH_WARNINGS' ELSE 'FAILED' END AS status, o_orderkey % 500 AS duration_ms, o_orderkey % 5 AS n_steps,
  CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS n_errors, o_orderkey % 11 AS tokens, cast(o_orderkey % 11 AS decimal(18,6)) / 1000 AS cost, cast(o_totalprice AS decimal(18,2)) AS itc, cast(o_orderdate AS date) AS ended FROM {orders}"""
RUN_STATS = """count(*) AS runs, cast(round(100.0 * count(*) FILTER (status <> 'FAILED') / count(*), 1) AS double) AS success_rate, count(*) FILTER (status = 'FAILED') AS failed, round(avg(duration_ms) FILTER (status <> 'FAILED' AND duration_ms > 0), 0) AS mean_ms,
  cast(sum(n_steps) AS bigint) AS steps, cast(sum(n_errors) AS bigint) AS errors, round(cast(sum(itc) AS double) / 1e7, 2) AS crores, cast(sum(tokens) AS bigint) AS tokens, cast(round(sum(tokens) / greatest(count(*) FILTER (status <> 'FAILED'), 1), 0) AS double) AS tokens_per_run,
  round(cast(sum(cost) AS double), 5) AS cost"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS, orders=read(spark, sf_dir, "orders"))


@query(f", runs AS ({RUNS.format(orders='orders')}) SELECT {RUN_STATS} FROM runs")
def summary_runs(spark, sf_dir):
    return decisions.run_stats(runs(spark, sf_dir))


@query(f", runs AS ({RUNS.format(orders='orders')}) SELECT client, {RUN_STATS} FROM runs GROUP BY client")
def summary_clients(spark, sf_dir):
    return decisions.run_stats(runs(spark, sf_dir), ("client",))


@query(f", runs AS ({RUNS.format(orders='orders')}) SELECT client, run, ended, nth FROM (SELECT client, run, ended, cast(row_number() OVER (PARTITION BY client ORDER BY ended DESC, run) AS int) AS nth FROM runs) WHERE nth <= 3")
def summary_recent_runs(spark, sf_dir):
    return decisions.recent(runs(spark, sf_dir).select("client", "run", "ended"), "client", "ended", 3)


#: Orders as requests about rules: a customer's rule, drafted with the first order; a rule of the first customers is one of the locked ones.
REQUESTS = f"""SELECT rule_id, vendor AS client, asked_on, seq, CASE WHEN nth = 1 THEN 'draft' WHEN seq % 10 IN (0, 3, 6) THEN 'approve' WHEN seq % 10 IN (1, 4, 7, 8) THEN 'activate' WHEN seq % 10 = 2 THEN 'disable' WHEN seq % 10 = 5 THEN 'new_version' ELSE 'draft' END AS request, seq % 13 = 0 AS blocked FROM (
  SELECT CASE {' '.join(f"WHEN o_custkey = {10 * k + 1} THEN '{x}'" for k, x in enumerate(governance.LOCKED))} ELSE 'R' || cast(o_custkey AS string) END AS rule_id, 'V' || lpad(cast(o_custkey AS string), 8, '0') AS vendor, cast(o_orderdate AS date) AS asked_on, o_orderkey AS seq,
    row_number() OVER (PARTITION BY o_custkey ORDER BY cast(o_orderdate AS date), o_orderkey) AS nth FROM {{orders}}) AS numbered"""
#: One request after another, with the latest version, its status and the active version; a supersession is a second row.
HISTORY = f""", requests AS ({REQUESTS.format(orders='orders')}), numbered AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY asked_on, seq) AS nth FROM requests),
fold AS (
  SELECT rule_id, 0::bigint AS nth, NULL::date AS asked_on, 0::bigint AS seq, '' AS request, 0 AS latest, NULL::varchar AS now, NULL::integer AS active, NULL::integer AS version, NULL::varchar AS status, NULL::integer AS over, NULL::varchar AS refused FROM (SELECT DISTINCT rule_id FROM numbered)
  UNION ALL
  SELECT rule_id, nth, asked_on, seq, request, CASE WHEN refused IS NULL AND request IN ('draft', 'new_version') THEN latest + 1 ELSE latest END, CASE WHEN refused IS NOT NULL THEN now WHEN request IN ('draft', 'new_version') THEN 'DRAFT' WHEN request = 'approve' THEN 'APPROVED' WHEN request = 'activate' THEN 'ACTIVE' WHEN active = latest THEN 'DISABLED' ELSE now END,
    CASE WHEN refused IS NOT NULL OR request NOT IN ('activate', 'disable') THEN active WHEN request = 'activate' THEN latest END,
    CASE WHEN refused IS NOT NULL THEN nullif(latest, 0) WHEN request IN ('draft', 'new_version') THEN latest + 1 WHEN request = 'disable' THEN active ELSE latest END,
    CASE WHEN refused IS NULL THEN CASE request WHEN 'approve' THEN 'APPROVED' WHEN 'activate' THEN 'ACTIVE' WHEN 'disable' THEN 'DISABLED' ELSE 'DRAFT' END END, CASE WHEN refused IS NULL AND request = 'activate' THEN active END, refused
  FROM (SELECT r.rule_id, r.nth, r.asked_on, r.seq, r.request, f.latest, f.now, f.active, CASE WHEN r.rule_id NOT LIKE 'R%' THEN 'LOCKED_GUARDRAIL' WHEN r.request = 'draft' AND f.latest > 0 THEN 'ALREADY_DRAFTED' WHEN r.request <> 'draft' AND f.latest = 0 THEN 'NO_SUCH_RULE'
      WHEN r.request = 'disable' AND f.active IS NULL THEN 'NOT_ACTIVE' WHEN r.request = 'approve' AND f.now <> 'DRAFT' THEN 'NOT_A_DRAFT' WHEN r.request = 'activate' AND f.now <> 'APPROVED' THEN 'NOT_APPROVED' WHEN r.request IN ('approve', 'activate') AND r.blocked THEN 'BLOCKED_BY_CONFLICTS' END AS refused
    FROM fold f JOIN numbered r ON r.rule_id = f.rule_id AND r.nth = f.nth + 1)
),
history AS (SELECT rule_id, asked_on, seq, request, version, status, refused FROM fold WHERE nth > 0 UNION ALL SELECT rule_id, asked_on, seq, request, over, 'SUPERSEDED', NULL FROM fold WHERE over IS NOT NULL),
spans AS (SELECT rule_id, version, status, asked_on AS since, lead(asked_on) OVER (PARTITION BY rule_id, version ORDER BY asked_on, seq) AS until FROM history WHERE refused IS NULL)"""
#: Conditions of a rule's versions: odd ones compare vendors, every third one documents, every fifth amounts.
CONDITIONS = "SELECT rule_id, version, field, operator FROM (SELECT DISTINCT rule_id, version FROM {spans}) CROSS JOIN (VALUES (1, 'gstin', 'EXACT'), (3, 'document_number', 'NORMALIZED_EXACT'), (5, 'taxable_value', 'ABSOLUTE_TOLERANCE')) AS c(k, field, operator) WHERE (length(rule_id) + version + k) % 2 = 0 OR k = 3 AND version % 2 = 1"


def rule_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS, orders=read(spark, sf_dir, "orders"))


@query(f"{HISTORY} FROM history")
def rules_history(spark, sf_dir):
    return governance.transitions(rule_requests(spark, sf_dir))


@query(f"{HISTORY} SELECT *, until IS NULL AS last FROM spans")
def rules_intervals(spark, sf_dir):
    return governance.intervals(rules_history(spark, sf_dir))


@query(
    f"""{NEAR.replace(', npair AS', ', npair AS', 1)}{HISTORY}, conditions AS ({CONDITIONS.format(spans='spans')}), seen AS (SELECT g.vendor AS client, g.d AS seen_on, a = b AS same FROM npair JOIN g ON g.row_idx = g_idx),
    active AS (SELECT s.rule_id, client, s.version, since, until, coalesce(bool_or(field = 'document_number'), false) AS strict FROM spans s JOIN (SELECT DISTINCT rule_id, client FROM requests) USING (rule_id) LEFT JOIN conditions c ON c.rule_id = s.rule_id AND c.version = s.version WHERE status = 'ACTIVE' GROUP BY ALL)
    SELECT rule_id, version, since, count(seen.seen_on) AS evaluated, count(*) FILTER (seen.seen_on IS NOT NULL AND (same OR NOT strict)) AS affected, 0 AS automatic, CASE WHEN affected > 0 THEN 'proposals_created' ELSE 'no_trigger' END AS result
    FROM active LEFT JOIN seen ON seen.client = active.client AND seen.seen_on >= since AND (until IS NULL OR seen.seen_on < until) GROUP BY rule_id, version, since, until"""
)
def rules_executions(spark, sf_dir):
    """Candidates of the near stage meet the version of their vendor's rule that is active on their day."""
    requests = rule_requests(spark, sf_dir)
    spans = materialize(governance.intervals(governance.transitions(requests)), "spans", lean=True)
    conditions = spark.sql(CONDITIONS, spans=spans)
    g, p = after_exact(spark, sf_dir)
    two = materialize(tiers.tolerance(g, p)[0], "tolerance", lean=True)
    pairs = tiers.blocked_pairs(tiers.residual(g, two, "g_idx"), tiers.residual(p, two, "p_idx"))
    candidates = pairs.select(F.col("v").alias("client"), F.col("g_d").alias("seen_on"), F.lit(True).alias("vendor_equal"), (F.col("g_norm") == F.col("p_norm")).alias("document_equal"))
    return governance.executions(candidates, spans.join(requests.select("rule_id", "client").distinct(), "rule_id"), conditions)


@query(
    f"""{NEAR}, known AS (SELECT g.vendor, p_idx, ambiguous, CASE WHEN status = 'NEAR_MATCH_PROPOSED' AND amount_diff = 0 THEN 'NEAR_MATCH_APPROVED' WHEN amount_diff > 100 THEN 'REJECTED_CANDIDATE' ELSE status END AS status FROM near JOIN g ON g.row_idx = g_idx WHERE norm_equal)
    SELECT vendor, count(*) AS would_propose, count(*) FILTER (status = 'NEAR_MATCH_APPROVED') AS approvals, count(*) FILTER (status = 'REJECTED_CANDIDATE') AS rejected, count(*) FILTER (ambiguous) AS ambiguous_conflicts, count(*) - count(DISTINCT p_idx) AS duplicates,
    greatest(0, would_propose - approvals - rejected) AS new_cases, rejected + duplicates AS conflicts, conflicts > 0 AS blocked FROM known GROUP BY vendor"""
)
def rules_simulation(spark, sf_dir):
    """A reviewer has approved proposals of equal amounts and rejected candidates more than 100 apart."""
    said = F.when((F.col("status") == "NEAR_MATCH_PROPOSED") & (F.col("amount_diff") == 0), "NEAR_MATCH_APPROVED").when(F.col("amount_diff") > 100, "REJECTED_CANDIDATE").otherwise(F.col("status"))
    vendors = ledgers(spark, sf_dir)[0].select("vendor", F.col("row_idx").alias("g_idx"))
    return governance.simulation(near_stage(spark, sf_dir).withColumn("status", said).join(vendors, "g_idx"), ["vendor"])


@query(f"{HISTORY}, named AS (SELECT rule_id, arg_max(status, (asked_on, seq)) FILTER (refused IS NULL) AS status FROM history GROUP BY rule_id) SELECT count(*) AS total, count(*) FILTER (rule_id NOT LIKE 'R%') AS locked, count(*) FILTER (rule_id LIKE 'R%') AS configurable, count(*) FILTER (rule_id NOT LIKE 'R%' OR rule_id IN (SELECT rule_id FROM spans WHERE status = 'ACTIVE' AND until IS NULL)) AS active FROM named")
def rules_catalog(spark, sf_dir):
    """All rules of the log, active where a version is."""
    changes = materialize(rules_history(spark, sf_dir), "history", lean=True)
    on = governance.intervals(changes).where("last AND status = 'ACTIVE'").select("rule_id", "status").distinct()
    return governance.catalog(changes.select("rule_id").distinct().join(on, "rule_id", "left"))


@query("SELECT row_idx, regexp_replace(upper(trim(doc)), '[^A-Z0-9]', '', 'g') AS folded FROM p")
def normalizers_folded(spark, sf_dir):
    """A seventh of the documents is written in full-width digits and letters; folded, they are what they were."""
    wide_forms = F.translate("doc", "0123456789INVD/", "０１２３４５６７８９ＩＮＶＤ／")
    p = ledgers(spark, sf_dir)[1].select("row_idx", F.when(F.col("row_idx") % 7 == 0, wide_forms).otherwise(F.col("doc")).alias("doc"))
    return normalize.folded_alnum(materialize(p, "documents"), "doc", "folded").select("row_idx", "folded")


#: A batch of decisions: a third of the ambiguous rows is matched, and as many rows that only P has are retired with it (their partner has been found).
CHANGED = "verdict = 'Ambiguous' AND row_idx % 3 = 0"
RETIRED = "verdict = 'PR Only' AND row_idx % 3 = 0"
KEPT_UP = f"""{WIDE}, decided AS (SELECT CASE WHEN {CHANGED} THEN 'Near Match' ELSE verdict END AS verdict, CASE WHEN {CHANGED} THEN 'HUMAN_SELECTED' ELSE sub END AS sub, who, g_taxable, p_taxable, g_tax, p_tax FROM v WHERE NOT ({RETIRED}))"""
SUMMED = ", ".join(f"{money(c)} AS {c}" for c in ("g_taxable", "p_taxable", "g_tax", "p_tax"))


def kept_up(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    rows = materialize(classified(spark, sf_dir).withColumn("who", F.coalesce(F.nullif("g_vendor", F.lit("")), "p_vendor")).select("row_idx", "verdict", "sub", "who", "g_taxable", "p_taxable", "g_tax", "p_tax"), "classified")
    sums = materialize(summary.totalled(summary.contributions(rows, by), by), "sums", lean=True)  # kept from the run before
    after = rows.where(CHANGED).withColumns({"verdict": F.lit("Near Match"), "sub": F.lit("HUMAN_SELECTED")})
    out = summary.kept_up(sums, rows.where(f"{CHANGED} OR {RETIRED}"), after, by)
    return out.withColumns({c: F.col(c).cast("double") for c in summary.SUMS[1:]})


@query(f"{KEPT_UP} SELECT verdict, sub, count(*) AS n, {SUMMED} FROM decided GROUP BY verdict, sub")
def summary_kept_up(spark, sf_dir):
    """Buckets after a batch of decisions, from the buckets before and the changed rows; the SQL counts everything anew."""
    return kept_up(spark, sf_dir, ["verdict", "sub"])


@query(f"{KEPT_UP} SELECT who, verdict, count(*) AS n, {SUMMED} FROM decided GROUP BY who, verdict")
def summary_vendors_kept_up(spark, sf_dir):
    return kept_up(spark, sf_dir, ["who", "verdict"])


#: Links in versions: exact ones, then those within tolerances together with exact rows that ask for the P row of the next order, then releases, then the second batch once more.
MOVES = "SELECT g_idx, p_idx + 10 AS p_idx FROM {exact} WHERE g_idx % 10 = 8"
STATE_SQL = f"""{REST}, asked AS (SELECT g_idx, p_idx FROM counted WHERE of_g = 1 AND of_p = 1 UNION ALL {MOVES.format(exact='exact')}),
judged AS (SELECT g_idx, p_idx, CASE WHEN p_idx IN (SELECT p_idx FROM exact) THEN 'P_HELD' WHEN g_idx > min(g_idx) FILTER (p_idx NOT IN (SELECT p_idx FROM exact)) OVER (PARTITION BY p_idx) THEN 'P_ASKED_TWICE' END AS reason FROM asked),
state1 AS (SELECT g_idx, p_idx, 1::bigint AS version FROM exact), taken AS (SELECT g_idx, p_idx FROM judged WHERE reason IS NULL), state2 AS (SELECT g_idx, p_idx, 2::bigint AS version FROM taken UNION ALL FROM state1 WHERE g_idx NOT IN (SELECT g_idx FROM taken)),
state3 AS (SELECT g_idx, CASE WHEN g_idx % 30 <> 5 THEN p_idx END AS p_idx, CASE WHEN g_idx % 30 = 5 THEN 3 ELSE version END AS version FROM state2)"""


def link_versions(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Folder of the table, and what the second batch was refused."""
    at = new_path(spark, "links")
    g, p = ledgers(spark, sf_dir)
    one = materialize(tiers.exact(g, p), "exact", lean=True)
    two = tiers.tolerance(tiers.residual(g, one, "g_idx"), tiers.residual(p, one, "p_idx"))[0].select("g_idx", "p_idx")
    second = materialize(two.unionByName(spark.sql(MOVES, exact=one)), "asked", lean=True)
    versions.merge_links(spark, at, one, "exact")
    refused = versions.merge_links(spark, at, second, "tolerance")
    versions.merge_links(spark, at, versions.latest(spark, at, versions.LINKS, "g_idx").where("g_idx % 30 = 5").select("g_idx", F.lit(None).cast("long").alias("p_idx")), "released")
    versions.merge_links(spark, at, second, "tolerance")  # a replay
    return at, refused


@query(f"{STATE_SQL} FROM state3")
def state_latest_links(spark, sf_dir):
    at, _ = link_versions(spark, sf_dir)
    return versions.latest(spark, at, versions.LINKS, "g_idx")


@query(f"{STATE_SQL} FROM judged WHERE reason IS NOT NULL")
def state_refused_links(spark, sf_dir):
    return link_versions(spark, sf_dir)[1]


DIFFERS = "(SELECT count(*) FROM (SELECT g_idx, p_idx FROM state3 EXCEPT SELECT g_idx, p_idx FROM {0})) > 0"


@query(f"{STATE_SQL} SELECT o_orderkey AS export_id, 1 + o_orderkey % 3 AS version, CASE 1 + o_orderkey % 3 WHEN 1 THEN {DIFFERS.format('state1')} WHEN 2 THEN {DIFFERS.format('state2')} ELSE false END AS stale FROM orders WHERE o_custkey % 100 = 1")
def state_stale_exports(spark, sf_dir):
    """Exports that some orders stand for, of versions 1 to 3."""
    at, _ = link_versions(spark, sf_dir)
    exports = read(spark, sf_dir, "orders").where("o_custkey % 100 = 1").selectExpr("o_orderkey AS export_id", "1 + o_orderkey % 3 AS version")
    return versions.stale(exports, spark, at)
