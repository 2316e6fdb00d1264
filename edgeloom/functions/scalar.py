"""Scalar and array functions as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def char_code(ch: Column) -> Column:
    """A digit is itself, '!' is -1, anything else is its upper-case code point - 35."""
    return F.when(ch.rlike("^[0-9]$"), ch.try_cast("int")).when(ch == "!", F.lit(-1)).otherwise(F.ascii(F.upper(ch)) - 35)


def pad_code(text: Column, width: int = 8) -> Column:
    """Codes of a text padded with '!' to ``width``; a longer text counts as all padding."""
    fixed = F.when(F.length(text) > width, F.lit("!" * width)).otherwise(F.rpad(text, width, "!"))
    return F.transform(F.split(fixed, ""), char_code)


@F.pandas_udf(T.DoubleType())
def _log2(w: pd.Series) -> pd.Series:
    """The C library's log2.  Spark's own is log(w) / log(2), whose last digits differ from it for every third weight or so."""
    return w.map(math.log2, na_action="ignore")


def log2_weight(w: Column) -> Column:
    """log2 of a weight, of which 0 counts as 1; null for a negative one."""
    known = F.when(w == 0, F.lit(1.0)).when(w > 0, w.cast("double"))
    return F.when(F.isnan(w), w.cast("double")).otherwise(_log2(known))


def parse_epoch(text: Column) -> Column:
    """Seconds since the epoch from a number or a yyyy-MM-dd date (UTC)."""
    return F.coalesce(text.try_cast("long"), F.unix_date(text.try_cast("date")).cast("long") * 86400)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    exps = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, y: a + y))


def one_hot(value: Column, categories: list) -> Column:
    """Array with 1 at the value's place among ``categories``, else 0; all 0 for another or null value."""
    return F.array(*[F.when(value == F.lit(c), 1.0).otherwise(0.0) for c in categories])


#: SQL names of column functions: parameters, result and body.
SQL_FUNCTIONS = {
    "sigmoid": ("x DOUBLE", "DOUBLE", "1.0D / (1.0D + exp(-x))"),
    "log2_weight": ("w DOUBLE", "DOUBLE", "log2(if(w = 0, 1.0D, w))"),
    "feature_clip": ("x DOUBLE, c DOUBLE", "DOUBLE", "if(c > 0, signum(x) * log1p(abs(x) / c) * c, x)"),
    "parse_epoch": ("t STRING", "BIGINT", "coalesce(try_cast(t AS BIGINT), unix_date(try_cast(t AS DATE)) * 86400L)"),
    "pack_pair": ("r BIGINT, c BIGINT", "BIGINT", "(r << 32) | (c & 4294967295L)"),
}


def register(spark) -> list[str]:
    """Create the functions above as temporary SQL functions of the session; Catalyst inlines their bodies."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
