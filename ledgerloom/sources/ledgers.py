"""Two ledgers with known differences, derived from orders and lineitem.

The statements run unchanged in Spark SQL and DuckDB, so that queries and their checking SQL start from the same rows. One order gives one row;
order key mod 20 names the scenario of its difference: 0 to 8 equal, 9 amount + 5, 10 date + 4 days, 11 date + 20 days, 12 document without separators, 13 two characters swapped,
14 tax under other heads, 15 amount - 500, 16 only in G, 17 only in P, 18 split in two rows, 19 two rows of one amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.sources.session import SIZES, prefer
from ledgerloom.sources.store import materialize
from ledgerloom.sources.tables import read

MONEY = "decimal(18,2)"

BASE = f"""
SELECT o_orderkey AS k, 'V' || lpad(cast(o_custkey AS string), 8, '0') AS vendor,
  'INV/' || cast(year(o_orderdate) AS string) || '/D' || lpad(cast(o_orderkey AS string), 7, '0') AS doc,
  cast(o_orderdate AS date) AS d, cast(taxable AS {MONEY}) AS taxable, cast(taxable * cast(0.18 AS decimal(4,2)) AS {MONEY}) AS tax, cast(o_orderkey % 20 AS int) AS scenario
FROM {{orders}} JOIN (SELECT l_orderkey, sum(cast(l_extendedprice AS {MONEY})) AS taxable FROM {{lineitem}} GROUP BY l_orderkey) AS sums ON o_orderkey = l_orderkey
"""

TAIL = f"cast(18.00 AS decimal(5,2)) AS rate, cast(0 AS {MONEY}) AS cess, 'Invoice' AS doc_type, scenario, k AS order_key"

G = f"""
SELECT k AS row_idx, 'G' || cast(k AS string) AS record_id, vendor, doc, d, taxable, tax AS igst, cast(0 AS {MONEY}) AS cgst, cast(0 AS {MONEY}) AS sgst, {TAIL}
FROM ({BASE}) AS base WHERE scenario <> 17
"""

P = f"""
SELECT k * 10 + copy AS row_idx, 'P' || cast(k * 10 + copy AS string) AS record_id, vendor,
  CASE WHEN scenario = 12 THEN replace(replace(doc, 'INV/', ''), '/', '')
       WHEN scenario = 13 THEN substr(doc, 1, length(doc) - 2) || substr(doc, length(doc), 1) || substr(doc, length(doc) - 1, 1)
       WHEN scenario = 19 AND copy = 0 THEN doc || 'A' WHEN scenario = 19 THEN doc || 'B' ELSE doc END AS doc,
  CASE WHEN scenario = 10 THEN d + 4 WHEN scenario = 11 THEN d + 20 ELSE d END AS d,
  cast(CASE WHEN scenario = 9 THEN taxable + 5 WHEN scenario = 15 THEN taxable - 500
       WHEN scenario = 18 AND copy = 0 THEN part WHEN scenario = 18 THEN taxable - part ELSE taxable END AS {MONEY}) AS taxable,
  cast(CASE WHEN scenario = 14 THEN 0 WHEN scenario = 18 AND copy = 0 THEN tax_part WHEN scenario = 18 THEN tax - tax_part ELSE tax END AS {MONEY}) AS igst,
  cast(CASE WHEN scenario = 14 THEN half ELSE 0 END AS {MONEY}) AS cgst, cast(CASE WHEN scenario = 14 THEN tax - half ELSE 0 END AS {MONEY}) AS sgst, {TAIL}
FROM (
  SELECT base.*, copy, cast(taxable * cast(0.40 AS decimal(4,2)) AS {MONEY}) AS part, cast(tax * cast(0.40 AS decimal(4,2)) AS {MONEY}) AS tax_part, cast(tax * cast(0.50 AS decimal(4,2)) AS {MONEY}) AS half
  FROM ({BASE}) AS base CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) AS copies
  WHERE scenario <> 16 AND (copy = 0 OR scenario IN (18, 19))
) AS copied
"""

#: One row with both sides, as wide exports have them; a missing side is null with amounts 0.
WIDE = """
SELECT coalesce(g.row_idx * 10, p.row_idx) AS row_idx, g.vendor AS g_vendor, p.vendor AS p_vendor, g.doc AS g_doc, p.doc AS p_doc, g.d AS g_date, p.d AS p_date,
  cast(coalesce(g.taxable, 0) AS double) AS g_taxable, cast(coalesce(p.taxable, 0) AS double) AS p_taxable,
  cast(coalesce(g.igst, 0) AS double) AS g_igst, cast(coalesce(p.igst, 0) AS double) AS p_igst,
  cast(coalesce(g.igst, 0) + coalesce(g.cgst, 0) + coalesce(g.sgst, 0) AS double) AS g_tax, cast(coalesce(p.igst, 0) + coalesce(p.cgst, 0) + coalesce(p.sgst, 0) AS double) AS p_tax, coalesce(g.scenario, p.scenario) AS scenario
FROM {g} AS g FULL OUTER JOIN {p} AS p ON g.order_key = p.order_key AND p.row_idx % 10 = 0
"""

#: The wide form once more, where parts of a split invoice stand alone and carry documents of their own; a tenth of the dates is missing on one side or both.
TRANCHES = WIDE.replace("p.doc AS p_doc", "CASE WHEN p.scenario = 18 THEN 'T' || cast(p.row_idx AS string) ELSE p.doc END AS p_doc").replace("% 10 = 0", "% 10 = 0 AND g.scenario <> 18").replace(
    "g.d AS g_date, p.d AS p_date", "CASE WHEN g.order_key % 10 <> 3 THEN g.d END AS g_date, CASE WHEN p.order_key % 30 <> 3 THEN p.d END AS p_date"
)


def ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """G and P. What both are made of (one row an order) is written once, so a query that reads them many times joins and sums their source once; and from here on tables count for more than their files (SIZES)."""
    prefer(spark, SIZES)
    base = materialize(spark.sql(BASE, **{t: read(spark, sf_dir, t) for t in ("orders", "lineitem")}), "base")
    return tuple(spark.sql(side.replace(f"({BASE})", "{base}"), base=base) for side in (G, P))


def wide(spark: SparkSession, sf_dir: str, form: str = WIDE) -> DataFrame:
    """The single-table form."""
    g, p = ledgers(spark, sf_dir)
    out = spark.sql(form, g=g, p=p)
    return out.withColumns({c: F.col(c).cast("double") for c in ("g_taxable", "p_taxable", "g_igst", "p_igst", "g_tax", "p_tax")})


def tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form TRANCHES."""
    return wide(spark, sf_dir, TRANCHES)


def ctes() -> str:
    """DuckDB text of the CTEs g, p, w (the wide form) and tranches."""
    fill = lambda text: text.replace("{orders}", "orders").replace("{lineitem}", "lineitem").replace("{g}", "g").replace("{p}", "p")
    return f"WITH RECURSIVE g AS ({fill(G)}), p AS ({fill(P)}), w AS ({fill(WIDE)}), tranches AS ({fill(TRANCHES)})"


def sql(body: str) -> str:
    """DuckDB text: body is a SELECT over g, p and w, or more CTEs before one (then it starts with a comma)."""
    return f"{ctes()}{body}" if body.lstrip().startswith(",") else f"{ctes()} {body}"
