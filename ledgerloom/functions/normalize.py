"""Normalisers of identifiers, documents, numbers and dates, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

#: Fixed lists: prefixes that document numbers carry, and the date formats that are read.
PREFIXES = ("INV", "BILL", "TAX", "GST", "REF", "DN", "CN")
STRIPPED_ONCE = ("INV-", "INV/", "BILL-", "BILL/", "TAX-", "TAX/")
LEADING = r"^((INV|BILL|TAX|GST|REF|DN|CN|PO|VCH|[0-9]{4}|FY[0-9]{2})[/_ :-]*)+"
DAY_FIRST = ("dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "dd MMM yyyy", "dd.MM.yyyy")
ISO = ("yyyy-MM-dd", "yyyy/MM/dd")


def blank_to_null(c: Column) -> Column:
    """Trimmed; an empty string is null."""
    return F.nullif(F.trim(c), F.lit(""))


def identifier(c: Column) -> Column:
    """Trimmed upper case; empty is null."""
    return F.upper(blank_to_null(c))


def alnum(c: Column) -> Column:
    """Upper-case letters and digits of any script only; null is empty. Compatibility forms are not folded (see folded_alnum)."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]", "")


@pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x))


def folded_alnum(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with `name`: alnum() of the column's text with compatibility forms folded (NFKC).

    Folding changes no ASCII text, so only rows with a character beyond ASCII go through Python. rows is read twice; it should be a table.
    """
    plain = F.coalesce(F.octet_length(column) == F.length(column), F.lit(True))
    return rows.where(plain).withColumn(name, alnum(F.col(column))).unionByName(rows.where(~plain).withColumn(name, alnum(_folded(F.col(column)))))


def strip_zeros(c: Column) -> Column:
    """Without leading zeros; only zeros give '0'."""
    return F.regexp_replace(c, "^0+(?=.)", "")


def chain(c: Column, steps: list[str]) -> Column:
    """A rule's ordered normalisers over text; a whole number's .0 goes first, the end is trimmed, and what is empty then is null."""
    apply = {
        "TRIM_WHITESPACE": lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " "),
        "STRIP_SPECIAL_CHARS": lambda x: F.regexp_replace(x, r"[^A-Za-z0-9\s]", ""),
        "ALPHANUMERIC_ONLY": lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", ""),
        "UPPERCASE": F.upper,
        "REMOVE_PREFIXES": lambda x: F.regexp_replace(x, rf"(?i)^(({'|'.join(PREFIXES)})[-_ /:]*)+", ""),
        "TRIM_LEADING_ZEROS": lambda x: strip_zeros(F.regexp_replace(x, r"\A\z", "0")),
    }
    start = F.regexp_replace(c, r"^\s*([0-9]+)\.0\s*$", "$1")
    done = F.regexp_replace(reduce(lambda x, step: apply[step](x), steps, start), r"^\s+|\s+$", "")
    # each step is named once: a condition on its outcome (nullif, when) would have it computed twice, and all before it
    return F.get(F.filter(F.array(done), lambda x: x != ""), 0)


def doc_core(c: Column) -> Column:
    """Without any leading prefixes and years, symbols and zeros; what would be empty stays as it was."""
    raw = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, LEADING, ""), "[^A-Z0-9]", ""), "^0+", "")
    return F.when(core == "", raw).otherwise(core)


def doc_light(c: Column) -> Column:
    """One pass over the fixed prefixes, then no symbols and no leading zeros; blank markers are empty."""
    text = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    # each prefix may stand once, in this order
    text = F.regexp_replace(text, rf"^(?:NAN|NONE|NULL)\z|^{''.join(f'(?:{p})?' for p in STRIPPED_ONCE)}", "")
    return strip_zeros(F.regexp_replace(text, "[^A-Z0-9]", ""))


def number(c: Column) -> Column:
    """A number out of text, or null."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def date(c: Column, day_first: bool = True) -> Column:
    """A date out of text: ISO where it starts with a year, else day first (or month first); null if no format fits."""
    text = F.trim(c)
    iso = F.coalesce(*(F.try_to_date(F.substring(text, 1, 10), f) for f in ISO))
    other = DAY_FIRST if day_first else tuple(f.replace("dd-MM", "MM-dd").replace("dd/MM", "MM/dd").replace("dd.MM", "MM.dd") for f in DAY_FIRST)
    return F.when(text.rlike("^[0-9]{4}"), iso).otherwise(F.coalesce(*(F.try_to_date(text, f) for f in other)))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def within(left: Column, right: Column, tolerance: float, percent: bool = False, slack: float = 1e-4) -> Column:
    """Whether right is within an absolute or a relative (percent of left) tolerance."""
    return F.abs(left - right) <= (F.abs(left * tolerance / 100) if percent else F.lit(tolerance)) + slack


def in_days(value: float, unit: str = "DAYS") -> int:
    """Months count 30 days, years 365."""
    return int(value * {"DAYS": 1, "MONTHS": 30, "YEARS": 365}[unit])


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def suffix_match(a: Column, b: Column) -> Column:
    """Both of three characters or more, one ends with the other."""
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (F.endswith(a, b) | F.endswith(b, a))
