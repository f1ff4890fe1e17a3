"""Tables and fragments: exploding, and joining what a page break has cut, as gaps and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import text as X


def explode_fragments(fragments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each fragment as a table of its own."""
    w = Window.partitionBy(*by).orderBy("table_idx", "fragment_idx")
    return fragments.withColumn("table_idx", (F.row_number().over(w) - 1).cast("int")).withColumn("fragment_idx", F.lit(0))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], joins_previous: Column) -> DataFrame:
    """``island``: a number for each run of rows that join the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("island", (F.sum(F.when(joins_previous, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))


def _merges(first: Column, last: Column, safe: bool) -> Column:
    """Whether a table whose first fragment is ``first`` goes on from one whose last is ``last``."""
    numbered = lambda names: F.exists(names, lambda n: ~X.is_semantic_name(n))
    bare = (F.size(last["names"]) == 0) | (F.size(first["names"]) == 0)
    if safe:
        alike = ~numbered(last["names"]) & ~numbered(first["names"]) & first["page"].between(last["page"], last["page"] + 1) & (last["names"] == first["names"])
    else:
        both = ~numbered(last["names"]) & ~numbered(first["names"])
        alike = F.when(both, last["names"] == first["names"]).otherwise(F.size(last["names"]) == F.size(first["names"]))
    return F.coalesce(first.isNotNull() & last.isNotNull() & (bare | alike), F.lit(False))


def compact(tables: DataFrame, by: Sequence[str], safe: bool = True) -> DataFrame:
    """``island``: tables (table_idx, first, last: struct<page, names>, null without fragments) with those they go on from."""
    w = Window.partitionBy(*by).orderBy("table_idx")
    df = tables.withColumn("__last", F.lag("last").over(w))
    return islands(df, by, ["table_idx"], _merges(F.col("first"), F.col("__last"), safe)).drop("__last")


def compact_fragments(tables: DataFrame, fragments: DataFrame, rows: DataFrame, by: Sequence[str], safe: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three frames with consecutive tables joined."""
    names = rows.select(*by, "table_idx", "fragment_idx", F.posexplode("cells").alias("i", "c"), "pos").groupBy(*by, "table_idx", "fragment_idx", F.col("c.name").alias("name")).agg(F.min(F.struct("pos", "i")).alias("at"))
    names = names.groupBy(*by, "table_idx", "fragment_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    shape = fragments.join(names, [*by, "table_idx", "fragment_idx"], "left").withColumn("s", F.struct("page", F.coalesce("names", F.array().cast("array<string>")).alias("names")))
    ends = shape.groupBy(*by, "table_idx").agg(F.min_by("s", "fragment_idx").alias("first"), F.max_by("s", "fragment_idx").alias("last"))
    found = compact(tables.select(*by, "table_idx").join(ends, [*by, "table_idx"], "left"), by, safe).select(*by, "table_idx", "island")
    w = Window.partitionBy(*by, "island").orderBy("table_idx", "fragment_idx")
    moved = fragments.join(found, [*by, "table_idx"]).withColumn("__f", (F.row_number().over(w) - 1).cast("int"))
    places = moved.select(*by, "table_idx", "fragment_idx", "island", "__f")
    fragments_ = moved.withColumn("table_idx", F.col("island")).withColumn("fragment_idx", F.col("__f")).select(*fragments.columns)
    rows_ = rows.join(places, [*by, "table_idx", "fragment_idx"]).withColumn("table_idx", F.col("island")).withColumn("fragment_idx", F.col("__f")).select(*rows.columns)
    return found.select(*by, F.col("island").alias("table_idx")).distinct(), fragments_, rows_


def rowspans(df: DataFrame, by: Sequence[str], order: Sequence[str], row: str, value: str) -> DataFrame:
    """``rowspan``: on the first row of a run of equal values within equal ``row`` its length, 0 on the others; 1 for a null ``row``."""
    w = Window.partitionBy(*by).orderBy(*order)
    joins = F.col(row).isNotNull() & (F.col(row) == F.lag(row).over(w)) & F.col(value).eqNullSafe(F.lag(value).over(w))
    df = df.withColumn("__joins", F.coalesce(joins, F.lit(False)))
    runs = islands(df, by, order, F.col("__joins"))
    size = F.count("*").over(Window.partitionBy(*by, "island"))
    return runs.withColumn("rowspan", F.when(F.col("__joins"), 0).otherwise(size).cast("int")).drop("__joins", "island")


def page_batches(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``batch``: consecutive rows in batches of ``size``."""
    if size < 1:
        raise ValueError("the size of a batch must be positive")
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def row_ordinals(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def sample_head(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int = 50) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"__n <= {k}").drop("__n")


def union_with_offset(parts: Sequence[tuple[DataFrame, int]], page: str = "page") -> DataFrame:
    """Batches' results in one, their pages moved to where each batch began."""
    moved = [df.withColumn(page, (F.col(page) + offset).cast(df.schema[page].dataType)) for df, offset in parts]
    out = moved[0]
    for df in moved[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
