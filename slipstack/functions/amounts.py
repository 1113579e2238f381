"""Text and money scalars (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack import fixed

CANDIDATE = f"{fixed.AMOUNT_PREFIX}({fixed.AMOUNT_PATTERN})(?!\\d)"
SIGNED = (
    rf"(?<=(?:^|[^-])-\s?|\(\s?){fixed.AMOUNT_PREFIX}{fixed.AMOUNT_PATTERN}(?!\d)"
)
WHOLE_AMOUNT = r"^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d{1,2}))?$"


def well_formed(col: Column) -> Column:
    """C-01: valid text, never null."""
    return F.coalesce(F.make_valid_utf8(col), F.lit(""))


def collapse_spaces(col: Column) -> Column:
    """C-02: every run of (Unicode) white space becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(well_formed(col), fixed.WIDE_SPACE + "+", " "))


def candidates(col: Column) -> Column:
    """C-03: the two-decimal amounts written in a text, in order."""
    return F.regexp_extract_all(col, F.lit(CANDIDATE), F.lit(1))


def has_signed_amount(clean: Column) -> Column:
    """C-04: some amount follows a minus or an opening bracket (C-02 text only)."""
    return F.regexp_like(clean, F.lit(SIGNED))


def candidate_cents(value: Column) -> Column:
    """Cents of one C-03 candidate; null beyond twelve integer digits."""
    digits = F.translate(value, ",.", "")
    return F.when(F.length(digits) <= 14, digits.try_cast("bigint"))


def has_text(col: Column) -> Column:
    """Same as a non-empty C-02 text, but stops at the first visible character."""
    return F.coalesce(F.regexp_like(col, F.lit(fixed.NOT_SPACE)), F.lit(False))


def with_fast_total(df: DataFrame, text: str = "text", out: str = "total_cents") -> DataFrame:
    """C-05 with A-06: the single distinct amount of a text, else null.

    The steps are separate projections so that the regular expressions are
    evaluated once per row; nothing here moves data.  Every amount contains a digit,
    a point and two digits, and C-02 cannot make that appear, so texts without it
    skip the costly patterns.
    """
    possible = F.regexp_like(F.col(text), F.lit(r"\d\.\d\d"))
    staged = df.withColumn("_clean", F.when(possible, collapse_spaces(F.col(text))))
    staged = staged.withColumn(
        "_cents",
        F.array_distinct(
            F.filter(F.transform(candidates(F.col("_clean")), candidate_cents), lambda c: c.isNotNull())
        ),
    )
    lone = (F.size("_cents") == 1) & ~has_signed_amount(F.col("_clean"))
    return staged.withColumn(out, F.when(lone, F.get("_cents", F.lit(0)))).drop("_clean", "_cents")


def parse_amount(col: Column) -> Column:
    """C-06: a typed amount to cents, null when it is not one."""
    bare = F.regexp_replace(col, "(?:" + fixed.WIDE_SPACE + "|[$€£])", "")
    whole = F.regexp_extract(bare, WHOLE_AMOUNT, 1)
    decimals = F.regexp_extract(bare, WHOLE_AMOUNT, 2)
    digits = F.translate(whole, ",", "")
    good = (
        (whole != "")
        & ~(whole.contains(",") & (decimals == ""))
        & (F.length(digits) <= 12)
    )
    return F.when(
        good,
        digits.try_cast("bigint") * 100 + F.rpad(decimals, 2, "0").try_cast("bigint"),
    )


def editable_amount(cents: Column) -> Column:
    """C-08: grouped amount with two decimals, no symbol."""
    return F.format_number(cents.cast("decimal(20,0)") / F.lit(100), 2)


def format_amount(cents: Column, currency: Column) -> Column:
    """C-07: symbol and grouped amount; unknown currencies read as US$."""
    symbols = fixed.CURRENCY_SYMBOLS
    symbol = F.lit(symbols["USD"])
    for code in ("ARS", "EUR", "BOB"):
        symbol = F.when(currency == code, F.lit(symbols[code])).otherwise(symbol)
    return F.concat(symbol, F.lit(" "), editable_amount(cents))
