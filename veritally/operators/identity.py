"""What a column header stands for: (year, modifier), and when two headers agree."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veritally.functions import fixed as X
from veritally.functions.text import no_spaces, rx, strip, strip_chars

_QUOTED = X.YEAR_QUOTED


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms folded to plain ones; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def header_year(text: Column) -> Column:
    """The four-digit year of a header in plain forms, or NULL."""
    four = F.nullif(F.regexp_extract(text, rx(X.HEADER_YEAR), 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(text, rx(_QUOTED), 0), F.lit(""))
    return F.coalesce(four, F.concat(F.lit("20"), F.substring(quoted, 2, 2)))


def split_header(text: Column) -> tuple[Column, Column]:
    """(year or NULL, modifier) of a header that is already in plain forms."""
    text = strip(F.coalesce(text, F.lit("")))
    year = header_year(text)
    four = F.regexp_extract(text, rx(X.HEADER_YEAR), 0)
    mark = F.when(four != "", four).otherwise(F.regexp_extract(text, rx(_QUOTED), 0))
    # a longer digit run may hold the same digits earlier, so cut where the pattern matched
    at = F.when(four != "", F.regexp_instr(text, F.lit(rx(X.HEADER_YEAR)))).otherwise(
        F.regexp_instr(text, F.lit(rx(_QUOTED)))
    )
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(mark), F.length(text)))
    rest = strip_chars(rest, X.HEADER_WRAPPERS)
    rest = F.regexp_replace(rest, "^(?:" + "|".join(X.HEADER_YEAR_SUFFIXES) + ")", "")
    modifier = strip_chars(no_spaces(rest), X.HEADER_WRAPPERS)
    return year, F.when(year.isNull(), no_spaces(text)).otherwise(modifier)


def column_identity(headers: DataFrame, column: str = "header") -> DataFrame:
    """Distinct headers with year and modifier; the Python step sees only unusual characters."""
    distinct = headers.select(F.col(column).alias("header")).distinct()
    plain = F.col("header").rlike("^[\\x00-\\x7f가-힣]*$")
    ready = distinct.where(plain).withColumn("_form", F.col("header"))
    folded = distinct.where(~plain).withColumn("_form", _nfkc("header"))
    year, modifier = split_header(F.col("_form"))
    return ready.unionByName(folded).select("header", year.alias("year"), modifier.alias("modifier"))
