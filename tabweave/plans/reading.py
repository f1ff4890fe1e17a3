"""Queries over the extraction of tables from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.plans.registry import Tables, query
from tabweave.sources import documents


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS page, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) - 1 AS pos, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) - 1 AS table_idx FROM orders)
SELECT 'customer-' || o_custkey AS path, table_idx, page, pos, 'Order,1' AS names, o_orderkey || '|' || o_orderstatus AS vals FROM o""")
def read_tables(t: Tables) -> DataFrame:
    """Documents, a page of rows for each year, through a reader: first rows that hold a hint name the columns."""
    o = t.orders.select("o_custkey", F.year("o_orderdate").alias("page"), "o_orderkey", F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("row"))
    pages = o.groupBy("o_custkey", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]).alias("body"))
    pages = pages.select("o_custkey", F.struct("page", F.concat(F.array(F.array(F.lit("Order"), F.lit(""))), "body").alias("rows")).alias("p"))
    files = pages.groupBy("o_custkey").agg(F.array_sort(F.collect_list("p")).alias("tables"))
    files = files.select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("path"), F.encode(F.to_json("tables"), "utf-8").alias("content"), F.lit(None).cast("array<int>").alias("pages"))
    out = documents.read_tables(files, documents.READERS["json"], ["order"])
    return out.select("path", "table_idx", "page", "pos", F.array_join("names", ",").alias("names"), F.array_join("vals", "|").alias("vals"))
