"""Column expressions for case records.

Each function takes and returns a ``Column``; nothing here touches a
DataFrame, so everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casoteca.functions import fixed

# A Java double also accepts "1d", "NaN" and hexadecimal; a file's number does not.
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_WHOLE = r"^-?\d+$"
# texts that need no trimming: digits and nothing behind them, not even a line end
_DIGITS = r"^-?\d+\z"
# sign, digits without leading zeros, fraction without trailing zeros
_SPELLING = (rf"^[{fixed.BLANKS}]*\+?(-?)0*(\d+)(?:(\.\d*[1-9])0*|\.0*)?"
             rf"[{fixed.BLANKS}]*$")
_CLOCK_SUFFIX = r"[ T]\d{1,2}:\d{2}.*$"


def to_number(c: Column) -> Column:
    """Double, or NULL for text that is not a number (NaN included).

    Only texts that match the pattern are cast, because a failing ``try_cast``
    raises and catches an exception inside the engine. Plain digits, most of a
    file, are told apart first; the rest is trimmed.
    """
    text = c.cast("string")
    rest = F.regexp_substr(F.trim(text, F.lit(fixed.BLANKS)), F.lit(_NUMBER))
    return F.when(text.rlike(_DIGITS), text).otherwise(rest).try_cast("double")


def to_whole(c: Column, kind: str = "bigint") -> Column:
    """Whole number, or NULL when the text has no number or a fractional one."""
    text, rest = c.cast("string"), F.regexp_substr(canonical_code(c), F.lit(_WHOLE))
    return F.when(text.rlike(_DIGITS), text).otherwise(rest).try_cast(kind)


def canonical_code(c: Column) -> Column:
    """One spelling per number: ``1.0``, ``01`` and `` 1`` become ``1``; other text is kept.

    Most codes need no change and are told apart by a few byte comparisons:
    blanks, signs, points and zero all sort before ``1``, other blanks behind ``~``.
    """
    text = c.cast("string")
    last = F.substring(text, -1, 1)
    suspect = (text < "1") | (text > "~") | text.contains(".") | (last < "!") | (last > "~")
    return F.when(suspect, F.regexp_replace(text, _SPELLING, "$1$2$3")).otherwise(text)


def answered_yes(c: Column) -> Column:
    """Code 1 of a yes/no question, in canonical text or as a number column."""
    return F.coalesce(c.cast("string").isin("1", "1.0"), F.lit(False))


def strip_upper(c: Column) -> Column:
    """Trim every Unicode blank (no-break space too) on both ends, then upper-case."""
    return F.upper(F.trim(c.cast("string"), F.lit(fixed.BLANKS)))


def parse_date(c: Column) -> Column:
    """Day-first date with slashes or hyphens, else ISO date; a value that is neither gives NULL.

    Years of two digits are those from 1969 to 2068. The shape decides which format is tried, because a failing parse is slow.
    """
    text = F.trim(c.cast("string"), F.lit(fixed.BLANKS))
    text = F.when(text.contains(":"), F.regexp_replace(text, _CLOCK_SUFFIX, "")).otherwise(text)
    slashed = F.translate(text, "-", "/")
    short = F.try_to_date(slashed, "d/M/yy")
    return (F.when(text.rlike(r"^\d{1,2}([/-])\d{1,2}\1\d{4}$"), F.try_to_date(slashed, "d/M/yyyy"))
            .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
            .when(text.rlike(r"^\d{1,2}([/-])\d{1,2}\1\d{2}$"),
                  F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)))


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def age_in_years(unit: Column, value: Column) -> Column:
    """Unit 1 counts days, 2 months, 3 years; anything outside 0..120 years is NULL."""
    years = F.when(unit == 1, value / 365.25).when(unit == 2, value / 12.0).when(unit == 3, value)
    return F.when((value >= 0) & (years <= 120), years)


def _band(value: Column, tests: list[tuple[str, Column]]) -> Column:
    first, *rest = tests
    return reduce(lambda acc, t: acc.when(t[1], t[0]), rest, F.when(first[1], first[0]))


def age_band(years: Column) -> Column:
    return _band(years, [
        (label, (years >= lo) if hi is None else (years >= lo) & (years < hi))
        for lo, hi, label in fixed.AGE_BANDS
    ])


def exploratory_age_band(age: Column) -> Column:
    """Right-closed bands; age 0 is in none of them."""
    return _band(age, [
        (label, (age > lo) & (age <= hi)) for label, lo, hi in fixed.EXPLORATORY_AGE_BANDS
    ])


def label_of(number: Column, labels: dict[int, str]) -> Column:
    """Label of a numeric code, NULL for codes outside the code book."""
    (code, label), *rest = labels.items()
    first = F.when(number == code, label)
    return reduce(lambda acc, kv: acc.when(number == kv[0], kv[1]), rest, first)


def yes_no(number: Column) -> Column:
    return F.coalesce(label_of(number, fixed.YES_NO_LABELS),
                      F.when(number.isNull(), fixed.ABSENT).otherwise(fixed.IGNORED))


def outcome(number: Column) -> Column:
    return F.coalesce(label_of(number, fixed.OUTCOME_LABELS),
                      F.when(number.isNull(), fixed.ABSENT).otherwise(fixed.OUTCOME_OTHER))


def final_classification(number: Column, filled: Column) -> Column:
    """No value is "absent"; a value outside the code book, text included, is "other"."""
    return F.coalesce(label_of(number, fixed.FINAL_CLASSIFICATION_LABELS),
                      F.when(filled, fixed.CLASSIFICATION_OTHER).otherwise(fixed.ABSENT))


def detailed_etiology(lab_columns: dict[str, Column]) -> Column:
    """Agent of the first positive test; a test that does not exist is not negative."""
    hits = [F.when(answered_yes(lab_columns[name]), label)
            for name, label in fixed.LAB_AGENTS.items() if name in lab_columns]
    return F.coalesce(*hits, F.lit(fixed.NO_AGENT))


def percentage(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` in per cent, half-even to two places, NULL over zero."""
    return F.bround(F.try_divide(numerator.cast("double"), denominator.cast("double")) * 100, 2)
