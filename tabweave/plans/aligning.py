"""Queries over the names of columns: aliases, hints, shared and similar values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions.names import parse_column_aliases
from tabweave.operators import align
from tabweave.plans.cleaning import _names, sql_name
from tabweave.plans.registry import Tables, query


@query(f"SELECT p_partkey, {sql_name("upper(p_name) || ' – No. ' || p_size")} AS names, p_brand AS value FROM part")
def normalize_column_names(t: Tables) -> DataFrame:
    name = F.concat(F.upper("p_name"), F.lit(" – No. "), F.col("p_size").cast("string"))
    rows = align.normalize_column_names(t.part.select("p_partkey", F.array(C.text_cell(name, F.col("p_brand"))).alias("cells")))
    return rows.select("p_partkey", _names().alias("names"), C.first_text(F.try_element_at("cells", F.lit(1))).alias("value"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'n_nationkey,country' AS names, n_name AS country FROM nation")
def alias_rename(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", C.from_columns("n_nationkey", "n_name", "n_regionkey").alias("cells"))
    out = align.alias_columns(rows, parse_column_aliases("N-Name:country, n_regionkey:<remove>"))
    return out.select("n_nationkey", _names().alias("names"), C.first_text(C.get(F.col("cells"), "country")).alias("country"))


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN r_name = 'ASIA' THEN n_name WHEN r_name LIKE 'A%' THEN r_name || '. ' || n_name ELSE 'x. ' || n_name END AS value
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def rename_collision(t: Tables) -> DataFrame:
    """Cells that share a name after renaming are joined, the one that had it first."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.when(F.col("r_name") == "ASIA", "").when(F.col("r_name").startswith("A"), F.col("r_name")).otherwise("x.")
    own = F.when(own == "x.", F.lit("x.")).otherwise(own)
    rows = n.select("n_nationkey", C.from_columns(b=F.col("n_name"), a=own).alias("cells"))
    m = t.spark.createDataFrame([("b", "a")], "source string, target string")
    return align.apply_mapping(rows, m, []).select("n_nationkey", C.first_text(C.get(F.col("cells"), "a")).alias("value"))


@query("""WITH f AS (SELECT p_brand, arg_min(p_type, p_partkey) AS type FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY p_brand)
SELECT p_brand, source, target FROM (SELECT p_brand, '0' AS source, 'product_name' AS target FROM f UNION ALL SELECT p_brand, '1', lower(type) FROM f)""")
def hints_alignment(t: Tables) -> DataFrame:
    """Fragments whose first row holds a hint: what it calls the numbered columns."""
    head = t.part.groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("b")).select("p_brand", F.lit(-1).cast("bigint").alias("pos"), F.when(F.col("p_brand").startswith("Brand#1"), "Product Name").otherwise("unheard of").alias("a"), "b")
    body = t.part.select("p_brand", F.col("p_partkey").alias("pos"), F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    rows = head.unionByName(body).select("p_brand", "pos", C.from_columns(**{"0": F.col("a"), "1": F.col("b"), "named": F.col("a")}).alias("cells"))
    return align.hints_mapping(rows, ["p_brand"], ["product_name"])


SETS = "SELECT o_custkey, list(DISTINCT lower(o_orderstatus)) AS a, list(DISTINCT lower(o_orderpriority)) AS b FROM (SELECT * FROM orders {0} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 50) GROUP BY o_custkey"
JACCARD = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"


@query(f"""WITH l AS ({SETS.format("")}), r AS ({SETS.format("WHERE o_orderstatus <> 'P'")}),
s AS (SELECT o_custkey, '0' AS source, 'status' AS target, {JACCARD.format("l.a", "r.a")} AS score FROM l JOIN r USING (o_custkey) UNION ALL SELECT o_custkey, '1', 'priority', {JACCARD.format("l.b", "r.b")} FROM l JOIN r USING (o_custkey))
SELECT o_custkey, source, target, round(score, 6) AS score FROM s WHERE score >= 0.5""")
def jaccard_alignment(t: Tables) -> DataFrame:
    """Numbered columns of one source by the values they share with the named ones of another."""
    cells = lambda a, b: C.from_columns(**{a: F.col("o_orderstatus"), b: F.col("o_orderpriority")}).alias("cells")
    left = t.orders.select("o_custkey", F.col("o_orderkey").alias("pos"), cells("0", "1"))
    right = t.orders.where("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderkey").alias("pos"), cells("status", "priority"))
    found = align.jaccard_mapping(align.value_sets(left, ["o_custkey"]), align.value_sets(right, ["o_custkey"]), ["o_custkey"])
    return found.withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag AS source, l_linestatus AS target, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, source, target) = 1),
b AS (SELECT s.* FROM s JOIN a ON s.l_orderkey = a.l_orderkey AND s.source <> a.source AND s.target <> a.target QUALIFY row_number() OVER (PARTITION BY s.l_orderkey ORDER BY s.score DESC, s.source, s.target) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def greedy_match(t: Tables) -> DataFrame:
    """One-to-one matches, the best scores first (with two targets there are two at most)."""
    s = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target")).agg(F.max("l_quantity").alias("score"))
    return align.greedy_match(s.withColumn("source_ord", F.col("source")).withColumn("target_ord", F.col("target")), ["l_orderkey"])


@query()
def semantic_alignment(t: Tables) -> DataFrame:
    """Numbered columns by the likeness of their values to the schema's names; embeddings can't be had in SQL."""
    rows = t.part.select("p_brand", F.col("p_partkey").alias("pos"), C.from_columns(**{"0": F.col("p_name"), "1": F.col("p_brand")}).alias("cells"))
    return align.semantic_mapping(rows, ["p_brand"], ["small_widget_ring", "brand"], 0.1)
