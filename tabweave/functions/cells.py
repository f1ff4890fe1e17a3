"""Rows of dynamic, ordered columns as ``cells``: array<struct<name, kind, vals>>, where kind is null, str or list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions import batch
from tabweave.functions import text as X

VALS = "array<struct<value:string,agreement_level:int>>"
CELL = f"struct<name:string,kind:string,vals:{VALS}>"
CELLS = f"array<{CELL}>"


def text_cell(name: Column | str, value: Column) -> Column:
    """A cell of one string, or of null."""
    name = F.lit(name) if isinstance(name, str) else name
    one = F.array(F.struct(value.alias("value"), F.lit(None).cast("int").alias("agreement_level")))
    return F.struct(name.alias("name"), F.when(value.isNull(), "null").otherwise("str").alias("kind"), F.when(value.isNull(), F.array().cast(VALS)).otherwise(one).alias("vals"))


def from_columns(*columns: str, **named: Column) -> Column:
    """Cells of a table's own columns, as strings, in their order."""
    pairs = [(c, F.col(c).cast("string")) for c in columns] + [(n, c.cast("string")) for n, c in named.items()]
    return F.array(*(text_cell(n, c) for n, c in pairs))


def named(c: Column, name: Column) -> Column:
    return F.struct(name.alias("name"), c["kind"].alias("kind"), c["vals"].alias("vals"))


def mapped(c: Column, f: Callable[[Column], Column]) -> Column:
    """A cell with ``f`` of each of its strings."""
    vals = F.transform(c["vals"], lambda v: F.struct(f(v["value"]).alias("value"), v["agreement_level"].alias("agreement_level")))
    return F.struct(c["name"].alias("name"), c["kind"].alias("kind"), vals.alias("vals"))


def map_values(cells: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(cells, lambda c: mapped(c, f))


def strings(cells: Column) -> Column:
    """All strings of all cells."""
    return F.flatten(F.transform(cells, lambda c: F.transform(c["vals"], lambda v: v["value"])))


def names(cells: Column) -> Column:
    return F.transform(cells, lambda c: c["name"])


def get(cells: Column, name: Column | str) -> Column:
    """The cell of a name, null if there is none."""
    return F.try_element_at(F.filter(cells, lambda c: c["name"] == name), F.lit(1))


def is_empty_string(v: Column) -> Column:
    return X.normalize_value(v, X.same) == ""


def is_empty(c: Column) -> Column:
    """Null, or nothing but empty strings."""
    return F.forall(c["vals"], lambda v: is_empty_string(v["value"]))


def all_empty(cells: Column) -> Column:
    return F.forall(cells, is_empty)


def first_text(c: Column) -> Column:
    """The first string that isn't blank, stripped; empty if there is none."""
    texts = F.filter(F.transform(c["vals"], lambda v: X.strip(v["value"])), lambda t: t != "")
    return F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit(""))


def display(c: Column) -> Column:
    """A cell's strings in one."""
    return F.array_join(F.transform(c["vals"], lambda v: v["value"]), ", ")


def with_values(df: DataFrame, f: Callable[[X.Form], Callable[[Column], Column]], form: Callable[[str], str] = X.nfc, column: str = "cells") -> DataFrame:
    """``df`` with a function of each string that may use a Unicode form, which lambdas can't compute themselves."""
    df = df.withColumn("__forms", X.forms_map(strings(F.col(column)), form))
    return df.withColumn(column, map_values(F.col(column), f(X.by_map(F.col("__forms"))))).drop("__forms")


def normalized(df: DataFrame, column: str = "cells") -> DataFrame:
    """Rows with normalised values, as merging compares and keeps them."""
    return df.withColumn(column, batch.mapped(F.col(column), batch.normalize_value))
