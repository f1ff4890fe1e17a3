"""Queries over schemas, types, statistics, validation and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions.coerce import coerce, infer_type
from tabweave.operators import dedupe, post, stats, validate
from tabweave.plans.registry import Tables, query
from tabweave.session import spread


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def schema_filter(t: Tables) -> DataFrame:
    """Rows of the tables that share a column with the schema."""
    rows = t.events.select("user_id", "event_type", "event_id", F.array(C.text_cell(F.col("event_type"), F.col("props"))).alias("cells"))
    return post.filter_schema_tables(rows, ["user_id", "event_type"], ["view", "nothing", "click"]).select("event_id")


@query("SELECT o_orderkey, 'o_custkey,o_orderstatus,o_orderpriority' AS names, o_custkey || '|' || o_orderstatus || '|' || o_orderpriority AS vals FROM orders")
def schema_order(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", C.from_columns("o_orderstatus", "o_orderpriority", "o_custkey").alias("cells"))
    out = post.order_schema_columns(rows, ["o_custkey", "missing", "o_orderstatus"])
    return out.select("o_orderkey", F.array_join(C.names(F.col("cells")), ",").alias("names"), F.array_join(C.strings(F.col("cells")), "|").alias("vals"))


RAW = "CASE event_type WHEN 'click' THEN value::VARCHAR WHEN 'view' THEN regexp_extract(props, '(\\d+)', 1) WHEN 'error' THEN 'Yes' WHEN 'signup' THEN 'off' ELSE event_type END"


def _raw(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "click", F.col("value").cast("string")).when(kind == "view", F.regexp_extract("props", r"(\d+)", 1)).when(kind == "error", "Yes").when(kind == "signup", "off").otherwise(kind)
    return t.events.select("event_id", raw.alias("raw"))


@query(f"""SELECT event_id, CASE WHEN d IS NULL THEN raw ELSE trunc(d)::BIGINT::VARCHAR END AS as_int, coalesce(d::VARCHAR, raw) AS as_float, CASE WHEN lower(raw) IN ('true', '1', 'yes', 'on') THEN 'True' WHEN lower(raw) IN ('false', '0', 'no', 'off') THEN 'False' ELSE raw END AS as_bool
FROM (SELECT event_id, {RAW} AS raw, try_cast({RAW} AS DOUBLE) AS d FROM events)""")
def coerce_types(t: Tables) -> DataFrame:
    return _raw(t).select("event_id", *(coerce(F.col("raw"), k).alias(f"as_{k}") for k in ("int", "float", "bool")))


@query(f"""SELECT event_id, CASE WHEN lower(raw) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(raw, '[+-]?\\d+') THEN 'int' WHEN try_cast(raw AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS type FROM (SELECT event_id, {RAW} AS raw FROM events)""")
def infer_types(t: Tables) -> DataFrame:
    return _raw(t).select("event_id", infer_type(F.col("raw")).alias("type"))


def _event_rows(t: Tables) -> DataFrame:
    """Each user's events as a table, each day as a fragment; the second column depends on the event."""
    e = t.events.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    raw = F.when(F.col("event_type") == "click", F.col("value").cast("string")).otherwise(F.regexp_extract("props", r"(\d+)", 1))
    cells = F.array(C.text_cell("value", F.col("value").cast("string")), C.text_cell(F.col("event_type"), raw), C.text_cell("7", F.col("props")))
    return e.select("user_id", F.dayofyear("ts").alias("fragment_idx"), "event_id", "pos", cells.alias("cells"))


FIRST = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"


@query(FIRST + """, f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY dayofyear(ts), pos) = 1),
c AS (SELECT user_id, 0 AS i, 'value' AS name, 'float' AS type FROM f UNION ALL SELECT user_id, 1, event_type, CASE event_type WHEN 'click' THEN 'float' ELSE 'int' END FROM f)
SELECT name, arg_min(type, (user_id, i)) AS type FROM c GROUP BY name""")
def unique_columns(t: Tables) -> DataFrame:
    """Named columns of the tables' first rows, with their types."""
    return stats.unique_columns(_event_rows(t), ["user_id"])


@query(FIRST + """, n AS (SELECT user_id, 'value' AS name, pos, 0 AS i FROM e UNION ALL SELECT user_id, event_type, pos, 1 FROM e UNION ALL SELECT user_id, '7', pos, 2 FROM e)
SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY min(pos * 10 + i)) - 1 AS column_pos FROM n GROUP BY user_id, name""")
def ordered_columns(t: Tables) -> DataFrame:
    """Columns by first appearance."""
    return post.ordered_columns(_event_rows(t), ["user_id"])


@query(FIRST + """, n AS (SELECT user_id, 'value' AS name, pos, 0 AS i FROM e UNION ALL SELECT user_id, event_type, pos, 1 FROM e UNION ALL SELECT user_id, '7', pos, 2 FROM e),
g AS (SELECT user_id, name, min(pos * 10 + i) AS a, count(*) = (SELECT count(*) FROM e WHERE e.user_id = n.user_id) AS is_common FROM n GROUP BY user_id, name)
SELECT user_id, name, is_common, row_number() OVER (PARTITION BY user_id ORDER BY is_common DESC, a) - 1 AS column_pos FROM g""")
def common_columns(t: Tables) -> DataFrame:
    """Columns that all rows have first, then the others."""
    return post.common_columns(_event_rows(t), ["user_id"])


LINES = """WITH r AS (SELECT l_orderkey AS paper, l_linestatus AS table_idx, l_returnflag AS f, l_linenumber AS row_, l_quantity::INT AS level, l_suppkey::VARCHAR AS supp, l_tax::VARCHAR AS tax,
  row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax) AS pos FROM lineitem),
g AS (SELECT *, count(*) OVER (PARTITION BY paper, table_idx, row_) AS k, count(*) OVER (PARTITION BY paper, table_idx, row_, supp) AS a, count(*) OVER (PARTITION BY paper, table_idx, row_, tax) AS b FROM r),
t AS (SELECT paper, table_idx, count(*) AS n, count(DISTINCT row_) AS u, count(*) FILTER (level > 1) AS agreed, count(*) FILTER (k > 1) AS sg, count(*) FILTER (k > 1 AND (a > 1 OR b > 1)) AS sv FROM g GROUP BY paper, table_idx),
fr AS (SELECT paper, count(DISTINCT (table_idx, f)) AS fragments FROM r GROUP BY paper),
p AS (SELECT paper, count(*) AS tables, any_value(fragments) AS fragments, sum(n)::BIGINT AS rows, sum(u)::BIGINT AS unique_rows, sum(agreed)::BIGINT AS agreed, sum(sg)::BIGINT AS sg, sum(sv)::BIGINT AS sv FROM t JOIN fr USING (paper) GROUP BY paper)"""


def _lines(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    w = Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    cells = C.from_columns(supp=F.col("l_suppkey"), tax=F.col("l_tax"))
    rows = spread(t.lineitem, "l_orderkey").withColumn("pos", F.row_number().over(w)).select(F.col("l_orderkey").alias("paper"), F.col("l_linestatus").alias("table_idx"), F.col("l_returnflag").alias("fragment_idx"), "pos", F.col("l_linenumber").alias("row_"), F.col("l_quantity").cast("int").alias("agreement_level_"), cells.alias("cells"))
    fragments = t.lineitem.select(F.col("l_orderkey").alias("paper"), F.col("l_linestatus").alias("table_idx"), F.col("l_returnflag").alias("fragment_idx")).distinct()
    tables = fragments.select("paper", "table_idx").distinct()
    return tables.select("paper").distinct(), tables, fragments, rows


@query(LINES + """ SELECT paper, tables, fragments, rows, unique_rows, 2::BIGINT AS columns, agreed AS rows_with_agreement, sg AS rows_in_shared_groups, sv AS rows_with_shared_values,
round(agreed * 100.0 / rows, 4) AS agreement_percentage, 0.0::DOUBLE AS empty_rows_percentage, CASE WHEN sg > 0 THEN round(sv * 100.0 / sg, 4) END AS shared_values_percentage FROM p""")
def paper_stats(t: Tables) -> DataFrame:
    """What each paper's tables hold."""
    out = stats.paper_stats(*_lines(t))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("percentage")})


@query(LINES + """ SELECT count(*) AS papers, sum(tables)::BIGINT AS tables, sum(fragments)::BIGINT AS fragments, sum(rows)::BIGINT AS rows, sum(unique_rows)::BIGINT AS unique_rows, sum(agreed)::BIGINT AS rows_with_agreement, sum(sg)::BIGINT AS rows_in_shared_groups, sum(sv)::BIGINT AS rows_with_shared_values,
round(sum(agreed) * 100.0 / sum(rows), 4) AS global_agreement_percentage, round(sum(sv) * 100.0 / sum(sg), 4) AS global_shared_values_percentage FROM p""")
def global_stats(t: Tables) -> DataFrame:
    """The same over all papers."""
    out = stats.global_stats(stats.paper_stats(*_lines(t)))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("percentage")})


@query(LINES + " SELECT paper, table_idx, sg AS rows_in_shared_groups, sv AS rows_with_shared_values FROM t WHERE sg > 0")
def shared_values(t: Tables) -> DataFrame:
    """Rows of one ordinal that have a value in common."""
    return stats.shared_values(_lines(t)[3], ["paper", "table_idx"])


ORDERS = "SELECT c_custkey AS paper, count(o_orderkey) AS tables FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


def _customers(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("paper")).agg(F.count("*").alias("tables"))
    return t.customer.select(F.col("c_custkey").alias("paper")).join(o, "paper", "left").fillna(0)


@query(ORDERS + " ORDER BY tables DESC, paper")
def stats_sorted(t: Tables) -> DataFrame:
    return stats.sorted_stats(_customers(t), "desc")


@query(f"SELECT paper || '.pdf' AS pdf FROM ({ORDERS}) WHERE tables = 0")
def empty_papers(t: Tables) -> DataFrame:
    """Papers in which nothing was found."""
    return stats.empty_papers(_customers(t).withColumn("paper", F.col("paper").cast("string")))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'priority' WHEN o_totalprice < 100000 THEN 'price' WHEN o_custkey NOT BETWEEN 0 AND 1000 THEN 'customer' END AS error FROM orders""")
def validate_rows(t: Tables) -> DataFrame:
    """The first rule that each row breaks."""
    out = validate.validate_rules(t.orders, priority=F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), price=F.col("o_totalprice") >= 100000, customer=F.col("o_custkey").between(0, 1000))
    return out.select("o_orderkey", "error")


@query("""WITH f AS (SELECT doc_id AS pos, text, CASE WHEN lang = 'en' THEN 'Doc ' || doc_id ELSE 'doc_' || doc_id END AS name FROM documents)
SELECT pos, name, md5(text) AS digest, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN name LIKE 'Doc%' THEN 1 ELSE 0 END, length(name), pos) = 1 AS keep FROM f""")
def dedupe_md5(t: Tables) -> DataFrame:
    """Which of equal files stays."""
    name = F.when(F.col("lang") == "en", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    files = t.documents.select(F.col("doc_id").alias("pos"), F.encode("text", "utf-8").alias("content"), name.alias("name"))
    return dedupe.dedupe_files(files, F.lower(F.replace("name", F.lit(" "), F.lit("_")))).drop("content")


@query("""SELECT doc_id, CASE WHEN n = 1 THEN source || '.pdf' ELSE source || '_' || (n - 1) || '.pdf' END AS final_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)""")
def rename_collisions(t: Tables) -> DataFrame:
    """Unlike names for all files."""
    files = t.documents.select("doc_id", F.concat("source", F.lit(".pdf")).alias("candidate"))
    return dedupe.resolve_names(files, order="doc_id").select("doc_id", "final_name")
