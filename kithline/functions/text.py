"""Text expressions: missing values, blanks, names, dates, rounding.  Every function returns a Column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value in the raw feeds.
NA_TOKENS = ("", " ", "  ", "-", "NULL", "NA", "'na")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_token(c: Column | str, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Null for the texts that stand for a missing value."""
    return F.when(~col(c).isin(*tokens), col(c))


def null_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """All string columns with missing values as nulls, in one projection."""
    return df.select(*[null_token(f"`{n}`", tokens).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def any_not_null(*cols: Column | str) -> Column:
    """Whether at least one of the columns has a value."""
    return reduce(lambda a, b: a | b, [col(c).isNotNull() for c in cols])


def trim_blanks(c: Column | str) -> Column:
    """Without white space of any kind at either end (trim removes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def delete_double_spaces(c: Column | str) -> Column:
    """Each pair of spaces is deleted: a run of n spaces becomes n mod 2."""
    return F.regexp_replace(col(c), "  ", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(col(c), " {2,}", " ")


def full_name(first: Column | str, middle: Column | str, last: Column | str, *, na_literal: bool = False, glue_empty: bool = False) -> Column:
    """first, middle and last name in one text.

    A null or blank middle name is left out.  glue_empty: an empty middle name joins first and last without a blank, as a
    literal reading of the double-space rule does.  A null first or last name is left out; na_literal puts NA in its place.
    """
    end = lambda c: F.coalesce(col(c), F.lit("NA" if na_literal else ""))
    mid = col(middle) if glue_empty else F.nullif(trim_blanks(middle), F.lit(""))
    text = F.concat(end(first), F.lit(" "), F.coalesce(mid, F.lit(" ")), F.lit(" "), end(last))
    return trim_blanks(delete_double_spaces(text))


def clean_pieces(c: Column | str) -> Column:
    """Signs within names become spaces, runs of spaces one; the ends are not trimmed."""
    return collapse_spaces(F.regexp_replace(col(c), r"[&_.\-]", " "))


def count_pieces(c: Column | str) -> Column:
    """Spaces plus one; 0 for null.  Expects a cleaned text."""
    return F.when(col(c).isNull(), 0).otherwise(F.regexp_count(col(c), F.lit(" ")) + 1).cast("long")


def parse_date(c: Column | str, pattern: str = "MM/dd/yyyy") -> Column:
    """The date, or null for a text that isn't one."""
    return F.try_to_timestamp(col(c), F.lit(pattern)).cast("date")


def to_number(c: Column | str, kind: str = "bigint") -> Column:
    return col(c).try_cast(kind)


def digits(c: Column | str) -> Column:
    """The digits of a text, such as a phone number written in any way; null if it has none."""
    return F.nullif(F.regexp_replace(col(c), r"[^0-9]", ""), F.lit(""))


def tenth(c: Column | str) -> Column:
    """Rounded to one decimal, exact halves to the even neighbour."""
    return F.bround(col(c), 1)


def pairwise_max(a: Column | str, b: Column | str) -> Column:
    """The larger value; null if either is null (greatest skips nulls)."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(col(a), col(b)))


def pairwise_min(a: Column | str, b: Column | str) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(col(a), col(b)))
