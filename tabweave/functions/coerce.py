"""Logical types of string values: inference, and rendering in canonical form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.text import NUMERIC_NAME, strip

TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
INTEGER = r"(?U)^\s*[+-]?\d(?:_?\d)*\s*$"


@F.pandas_udf(T.StringType())
def _float_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: str(float(v)), na_action="ignore")


def number(c: Column) -> Column:
    """The double that Python's float() reads, null where it reads none."""
    plain = F.replace(strip(c), F.lit("_"), F.lit(""))
    return F.when(c.rlike(NUMERIC_NAME), plain.try_cast("double"))


def coerce(c: Column, kind: str) -> Column:
    """``c`` as its type is written, unchanged where it can't be read; infinities are no integers."""
    if kind == "bool":
        low = F.lower(c)
        return F.when(low.isin(*TRUE), F.lit("True")).when(low.isin(*FALSE), F.lit("False")).otherwise(c)
    if kind == "int":
        n = number(c)
        whole = F.when(F.abs(n) < 9e18, n.cast("bigint").cast("string")).otherwise(F.format_string("%.0f", n))
        return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), whole).otherwise(c)
    if kind == "float":
        return F.coalesce(_float_text(F.when(c.rlike(NUMERIC_NAME), c)), c)
    if kind in ("str", "scientific_name"):
        return c
    raise ValueError(f"unknown type: {kind}")


def infer_type(c: Column) -> Column:
    """bool, int, float or str, whichever reads the value first; null is str."""
    text = strip(c)
    return F.when(c.isNull(), "str").when(F.lower(text).isin("true", "false"), "bool").when(text.rlike(INTEGER), "int").when(text.rlike(NUMERIC_NAME), "float").otherwise("str")
