"""What is done to merged tables: dropping, filtering and ordering columns and tables, and types of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions import text as X
from tabweave.functions.coerce import coerce
from tabweave.functions.names import ColumnSchema


def only_semantic_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cells", F.filter("cells", lambda c: X.is_semantic_name(c["name"])))


def empty_columns(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, name) of the columns that are empty in all rows of a fragment."""
    one = rows.select(*by, F.explode("cells").alias("c"))
    return one.groupBy(*by, F.col("c.name").alias("name")).agg(F.bool_and(C.is_empty(F.col("c"))).alias("empty")).where("empty").drop("empty")


def drop_empty_columns(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    gone = empty_columns(rows, by).groupBy(*by).agg(F.collect_set("name").alias("__gone"))
    out = rows.join(gone, list(by), "left")
    kept = F.filter("cells", lambda c: ~F.coalesce(F.array_contains("__gone", c["name"]), F.lit(False)))
    return out.withColumn("cells", kept).select(*rows.columns)


def drop_empty_fragments(fragments: DataFrame, rows: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fragments without a row that isn't empty go, and so tables without fragments."""
    full = rows.where(~C.all_empty(F.col("cells"))).select(*by).distinct()
    return fragments.join(full, list(by), "left_semi"), rows.join(full, list(by), "left_semi")


def filter_schema_tables(rows: DataFrame, table: Sequence[str], schema: Sequence[str]) -> DataFrame:
    """Rows of the tables that share a column with the schema."""
    names = F.array(*map(F.lit, schema)) if schema else F.array().cast("array<string>")
    kept = rows.where(F.arrays_overlap(C.names(F.col("cells")), names)).select(*table).distinct()
    return rows.join(kept, list(table), "left_semi")


def _named(name: str):
    return lambda c: c["name"] == name


def order_cells(cells: Column, schema: Sequence[str]) -> Column:
    """The schema's columns first, in its order, then the others in theirs."""
    first = [F.filter(cells, _named(n)) for n in schema]
    return F.concat(*first, F.filter(cells, lambda c: ~c["name"].isin(*schema))) if schema else cells


def order_schema_columns(rows: DataFrame, schema: Sequence[str]) -> DataFrame:
    return rows.withColumn("cells", order_cells(F.col("cells"), schema))


def coerce_schema_types(rows: DataFrame, schema: ColumnSchema, key: Sequence[str], parse_name=None) -> DataFrame:
    """Values of the schema's columns as their types are written; ``parse_name``: for scientific names, a Column function."""
    kinds = {n: k for n, k in schema.columns if k != "str"}
    if not kinds:
        return rows

    def by_type(v: Column, name: Column) -> Column:
        out = v
        for n, k in kinds.items():
            new = parse_name(v) if k == "scientific_name" and parse_name else coerce(v, k)
            out = F.when(name == n, new).otherwise(out)
        return out

    one = rows.select(*key, F.posexplode("cells").alias("i", "c")).where(F.col("c.name").isin(*kinds)).select(*key, "i", "c.name", F.posexplode("c.vals").alias("j", "v"))
    one = one.withColumn("new", by_type(F.col("v.value"), F.col("name")))
    pairs = one.select(*key, F.struct("name", F.col("v.value").alias("value")).alias("k"), "new").distinct()
    back = pairs.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "new"))).alias("__new"))
    out = rows.join(back, list(key), "left")
    new = F.transform("cells", lambda c: C.mapped(c, lambda v: F.coalesce(F.try_element_at("__new", F.struct(c["name"].alias("name"), v.alias("value"))), v)))
    return out.withColumn("cells", F.when(F.col("__new").isNull(), F.col("cells")).otherwise(new)).select(*rows.columns)


def ordered_columns(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, name, column_pos): columns in the order in which they first appear."""
    one = rows.select(*by, "pos", F.posexplode("cells").alias("i", "c")).groupBy(*by, F.col("c.name").alias("name")).agg(F.min(F.struct("pos", "i")).alias("at"))
    return one.withColumn("column_pos", (F.row_number().over(Window.partitionBy(*by).orderBy("at")) - 1).cast("int")).drop("at")


def common_columns(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, name, is_common, column_pos): columns that all rows have come first, each kind in order of appearance."""
    one = rows.select(*by, "pos", F.posexplode("cells").alias("i", "c")).groupBy(*by, F.col("c.name").alias("name")).agg(F.min(F.struct("pos", "i")).alias("at"), F.count_distinct("pos").alias("n"))
    one = one.join(rows.groupBy(*by).agg(F.count("*").alias("all")), list(by)).withColumn("is_common", F.col("n") == F.col("all"))
    return one.withColumn("column_pos", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("is_common"), "at")) - 1).cast("int")).select(*by, "name", "is_common", "column_pos")
