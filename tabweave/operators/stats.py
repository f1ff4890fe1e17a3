"""Statistics of papers, tables and columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions import text as X
from tabweave.functions.coerce import infer_type


def shared_values(rows: DataFrame, table: Sequence[str]) -> DataFrame:
    """(table, rows_in_shared_groups, rows_with_shared_values) over groups of rows with one ``row_`` in a table.

    A row counts in the second if it has a value in a column that another row of its group has there too. Values of
    groups are sorted once, so that equal ones lie together; nothing is joined back.
    """
    group = [*table, "row_"]
    some = rows.where("row_ is not null").select(*group, "pos", "cells").withColumn("__n", F.count("*").over(Window.partitionBy(*group))).where("__n > 1")
    one = some.select(*group, "pos", F.explode_outer("cells").alias("c")).select(*group, "pos", F.col("c.name").alias("name"), F.explode_outer("c.vals.value").alias("v"))
    one = one.withColumn("v", F.nullif(X.strip(F.col("v")), F.lit("")))
    w = Window.partitionBy(*group, "name", "v").orderBy("pos")
    beside = [F.coalesce(f("pos").over(w) != F.col("pos"), F.lit(False)) for f in (F.lag, F.lead)]  # one at least of a row's equal values lies beside another row's, if there is any
    each = one.withColumn("shared", F.col("v").isNotNull() & (beside[0] | beside[1])).groupBy(*group, "pos").agg(F.max("shared").alias("shared"))
    return each.groupBy(*table).agg(F.count("*").alias("rows_in_shared_groups"), F.count_if("shared").alias("rows_with_shared_values"))


def percent(part, whole):
    return F.when(whole > 0, part * 100.0 / whole)


def paper_stats(papers: DataFrame, tables: DataFrame, fragments: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each paper: its tables, fragments, rows, distinct ordinals, columns, agreement and shared values.

    ``rows``: paper, table_idx, pos (unique in a table), row_, agreement_level_, cells.
    """
    r = rows.select("paper", "table_idx", "row_", (F.coalesce("agreement_level_", F.lit(1)) > 1).alias("agreed"), C.all_empty(F.col("cells")).alias("empty"))
    r = r.groupBy("paper", "table_idx", "row_").agg(F.count("*").alias("rows"), F.count_if("agreed").alias("rows_with_agreement"), F.count_if("empty").alias("empty"))
    names = rows.select("paper", C.names(F.col("cells")).alias("names")).distinct().select("paper", F.explode("names").alias("name")).where("name is not null").distinct()
    s = shared_values(rows, ["paper", "table_idx"])
    parts = [
        (papers, {"own": F.lit(1)}), (tables, {"tables": F.lit(1)}), (fragments, {"fragments": F.lit(1)}), (names, {"columns": F.lit(1)}),
        (r, {"rows": F.col("rows"), "unique_rows": F.col("row_").isNotNull().cast("bigint"), "rows_with_agreement": F.col("rows_with_agreement"), "empty": F.col("empty")}),
        (s, {c: F.col(c) for c in ("rows_in_shared_groups", "rows_with_shared_values")})]
    every = [n for _, own in parts for n in own]
    # What each part counts is summed by paper in one aggregate, so papers aren't sorted and joined part by part.
    one = [df.select("paper", *(own.get(n, F.lit(0)).cast("bigint").alias(n) for n in every)) for df, own in parts]
    out = reduce(DataFrame.union, one).groupBy("paper").agg(*(F.sum(n).alias(n) for n in every)).where("own > 0")
    return out.select(
        "paper", "tables", "fragments", "rows", "unique_rows", "columns", "rows_with_agreement", "rows_in_shared_groups", "rows_with_shared_values",
        percent(F.col("rows_with_agreement"), F.col("rows")).alias("agreement_percentage"),
        percent(F.col("empty"), F.col("rows")).alias("empty_rows_percentage"),
        percent(F.col("rows_with_shared_values"), F.col("rows_in_shared_groups")).alias("shared_values_percentage"))


def global_stats(per_paper: DataFrame) -> DataFrame:
    """One row over all papers."""
    sums = ["tables", "fragments", "rows", "unique_rows", "rows_with_agreement", "rows_in_shared_groups", "rows_with_shared_values"]
    out = per_paper.agg(F.count("*").alias("papers"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
    return out.withColumn("global_agreement_percentage", percent(F.col("rows_with_agreement"), F.col("rows"))).withColumn("global_shared_values_percentage", percent(F.col("rows_with_shared_values"), F.col("rows_in_shared_groups")))


def sorted_stats(per_paper: DataFrame, how: str = "none") -> DataFrame:
    """Papers by name, or by their number of tables first."""
    order = {"none": ["paper"], "asc": ["tables", "paper"], "desc": [F.desc("tables"), "paper"]}[how]
    return per_paper.orderBy(*order)


def empty_papers(per_paper: DataFrame) -> DataFrame:
    """The PDFs in which no table was found."""
    return per_paper.where("tables = 0").select(F.concat(F.regexp_replace("paper", r"\.tables\.json$", ""), F.lit(".pdf")).alias("pdf"))


def unique_columns(rows: DataFrame, table: Sequence[str]) -> DataFrame:
    """(name, type): named columns of each table's first row of its first fragment with rows; the first table's type counts."""
    w = Window.partitionBy(*table).orderBy("fragment_idx", "pos")
    first = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    one = first.select(F.struct(*table).alias("at"), F.posexplode("cells").alias("i", "c")).where(X.is_semantic_name(F.col("c.name")))
    one = one.select("at", "i", F.col("c.name").alias("name"), infer_type(F.try_element_at("c.vals", F.lit(1))["value"]).alias("type"))
    return one.groupBy("name").agg(F.min_by("type", F.struct("at", "i")).alias("type"))


def format_stats(total: dict, papers: list[dict], columns: dict[str, str] | None = None) -> str:
    """The report as text."""
    titles = [("papers", "Papers"), ("tables", "Tables"), ("fragments", "Fragments"), ("rows", "Rows"), ("unique_rows", "Unique rows"), ("columns", "Columns"), ("rows_with_agreement", "Rows with agreement > 1")]
    shares = [("agreement_percentage", "Agreement percentage"), ("empty_rows_percentage", "Empty rows percentage"), ("shared_values_percentage", "Shared values percentage"), ("global_agreement_percentage", "Global agreement percentage"), ("global_shared_values_percentage", "Global shared values percentage")]

    def block(d: dict, pad: str) -> list[str]:
        return [f"{pad}{t}: {d[k]}" for k, t in titles if k in d] + [f"{pad}{t}: {d[k]:.2f}%" for k, t in shares if d.get(k) is not None]

    out = ["Global Stats:", *block(total, "  "), "", "Per-Paper Stats:"]
    for p in papers:
        out += [f"- {p['paper']}:", *block(p, "    ")]
    if columns is not None:
        out += ["", "Unique Columns:", *(f"{n}:{k}" for n, k in sorted(columns.items()))]
    return "\n".join(out)
