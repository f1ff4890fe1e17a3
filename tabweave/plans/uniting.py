"""Queries that merge several readings of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.operators import merge, viewer
from tabweave.plans.registry import Tables, query
from tabweave.session import spread
from tabweave.sources import documents
from tabweave.sources.tables import paper_matches

KEY = ["l_orderkey", "l_linenumber"]
CONTENT = ["l_returnflag", "l_linestatus"]
ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", *CONTENT]
SOURCES = f"""SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(ORDER)}) - 1 AS source_ord FROM lineitem"""
READER = "CASE s_nationkey % 5 WHEN 0 THEN 'pdfplumber' WHEN 1 THEN 'camelot' WHEN 2 THEN 'pymupdf' WHEN 3 THEN 'hybrid-camelot-m' ELSE 'model-x' END"


def line_sources(t: Tables) -> DataFrame:
    """Lines with one order and number as the readings of one row by different sources."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    df = spread(t.lineitem.select(*KEY, *ORDER), *KEY)
    return df.withColumn("source_ord", F.row_number().over(w) - 1).withColumn("uuid", F.col("l_suppkey").cast("string")).withColumn("agreement_level_", F.lit(1)).withColumnRenamed("l_linenumber", "row_")


def merged_lines(t: Tables, **options) -> DataFrame:
    return merge.merge_rows(line_sources(t), ["l_orderkey"], content=CONTENT, cells=None, **options)


def readers(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("uuid"), F.expr(READER).alias("reader"))


@query(f"""WITH s AS ({SOURCES})
SELECT l_orderkey, l_linenumber::BIGINT AS row_, l_returnflag, l_linestatus, count(*) AS agreement_level_, min(source_ord) AS first_src
FROM s GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus""")
def merge_simple_count(t: Tables) -> DataFrame:
    """Rows of any number of sources as one, with how many agree."""
    return merged_lines(t).drop("sources_")


@query(f"""WITH s AS ({SOURCES}),
d AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey, min(source_ord) AS o FROM s GROUP BY ALL)
SELECT l_orderkey, l_linenumber::BIGINT AS row_, l_returnflag, l_linestatus, string_agg(l_suppkey::VARCHAR, ',' ORDER BY o) AS sources_
FROM d GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus""")
def merge_sources(t: Tables) -> DataFrame:
    """The distinct sources of each merged row, in the order of the sources."""
    return merged_lines(t).select("l_orderkey", "row_", *CONTENT, F.array_join("sources_", ",").alias("sources_"))


@query(f"""WITH r AS (SELECT s_suppkey, {READER} AS reader FROM supplier),
g AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n,
  count(DISTINCT CASE WHEN reader = 'model-x' THEN l_suppkey END) + count(DISTINCT CASE WHEN reader <> 'model-x' THEN reader END) AS k
  FROM lineitem JOIN r ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus)
SELECT l_orderkey, l_linenumber::BIGINT AS row_, l_returnflag, l_linestatus, CASE WHEN n > 1 THEN greatest(1, k) ELSE 1 END AS agreement_level_ FROM g""")
def merge_distinct_readers(t: Tables) -> DataFrame:
    """Agreement counted by readers: each agent, and each different classic reader once."""
    return merged_lines(t, method="distinct-readers", readers=readers(t)).select("l_orderkey", "row_", *CONTENT, "agreement_level_")


@query("""WITH u AS (SELECT 0 AS s, o_orderkey, o_orderstatus, o_orderpriority FROM orders
UNION ALL SELECT 1, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 2, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || '!' ELSE o_orderpriority END FROM orders)
SELECT o_orderkey, o_orderstatus, o_orderpriority, min(s)::BIGINT AS first_src FROM u GROUP BY o_orderkey, o_orderstatus, o_orderpriority HAVING count(*) = 1""")
def merge_unmatched(t: Tables) -> DataFrame:
    """Rows that only one of three sources has."""
    o = t.orders.select("o_custkey", F.col("o_orderkey").alias("row_"), "o_orderstatus", "o_orderpriority")
    marked = F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    parts = [o, o.where("o_orderstatus <> 'P'"), o.withColumn("o_orderpriority", marked)]
    rows = parts[0].withColumn("source_ord", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("source_ord", F.lit(k)))
    rows = rows.withColumn("uuid", F.concat(F.lit("s"), F.col("source_ord").cast("string"))).withColumn("agreement_level_", F.lit(1))
    out = merge.merge_rows(rows, [], content=["o_orderstatus", "o_orderpriority"], cells=None).where("agreement_level_ = 1")
    return out.select(F.col("row_").alias("o_orderkey"), "o_orderstatus", "o_orderpriority", "first_src")


@query("""WITH u AS (SELECT o_custkey AS paper, 0 AS s, * FROM orders UNION ALL SELECT o_custkey, 1, * FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT paper, s, year(o_orderdate) AS page, row_number() OVER (PARTITION BY paper, s, year(o_orderdate) ORDER BY o_orderkey) - 1 AS row_, lower(o_orderstatus) AS status, lower(o_orderpriority) AS priority FROM u),
m AS (SELECT paper, page, row_, status, priority, count(*) AS agreement_level_, string_agg('s' || s, ',' ORDER BY s) AS sources_, min(s) AS f FROM n GROUP BY paper, page, row_, status, priority)
SELECT paper, page, row_, status, priority, agreement_level_, sources_, row_number() OVER (PARTITION BY paper, page ORDER BY row_, f) - 1 AS pos FROM m""")
def merge_fragments(t: Tables) -> DataFrame:
    """Whole tables of two sources merged: clusters by page, rows by ordinal and content, in order."""
    o = t.orders.select(F.col("o_custkey").alias("paper"), "o_orderkey", F.year("o_orderdate").alias("page"), "o_orderstatus", "o_orderpriority")
    rows = o.withColumn("source_ord", F.lit(0)).unionByName(o.where("o_orderstatus <> 'P'").withColumn("source_ord", F.lit(1))).withColumn("table_idx", F.lit(0))
    source = ["paper", "source_ord", "table_idx"]
    rows = rows.withColumn("fragment_idx", F.col("page")).withColumn("pos", F.col("o_orderkey")).withColumn("agreement_level_", F.lit(1))
    rows = rows.withColumn("cells", C.from_columns(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")))
    fragments = rows.select(*source, "fragment_idx", "page").distinct()
    files = rows.select("paper", "source_ord").distinct().withColumn("uuid", F.concat(F.lit("s"), F.col("source_ord").cast("string"))).withColumn("page_offset", F.lit(0))
    _, out = merge.merge_fragments(files, fragments, rows)
    text = lambda n: C.first_text(C.get(F.col("cells"), n)).alias(n)
    return out.select("paper", "page", "row_", text("status"), text("priority"), "agreement_level_", F.array_join("sources_", ",").alias("sources_"), "pos")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, name, value, count(*) AS agreement_level_ FROM (
SELECT l_orderkey, l_linenumber, 'l_returnflag' AS name, l_returnflag AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_linestatus', l_linestatus FROM lineitem)
WHERE value IS NOT NULL GROUP BY l_orderkey, l_linenumber, name, value""")
def column_agreement(t: Tables) -> DataFrame:
    """How many sources have each value of each column."""
    return merge.column_agreement(t.lineitem, KEY, CONTENT).withColumnRenamed("agreement_level", "agreement_level_")


@query(f"""WITH s AS ({SOURCES}),
p AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag, l_linestatus ORDER BY source_ord) - 1) // 2 AS pair FROM s)
SELECT l_orderkey, l_linenumber::BIGINT AS row_, l_returnflag || l_linestatus AS content, pair::BIGINT AS pair, count(*) AS agreement_level_, min(source_ord) AS first_src
FROM p GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus, pair""")
def merge_pairwise(t: Tables) -> DataFrame:
    """Two at a time, as rows merge that keep the agreement of each value."""
    return merge.merge_pairwise(line_sources(t).withColumn("content", F.concat(*CONTENT)), ["l_orderkey"])


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN count(*) <= 1 THEN 'low' WHEN count(*) = 2 THEN 'medium' ELSE 'high' END AS bucket
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus) GROUP BY bucket""")
def agreement_bucket(t: Tables) -> DataFrame:
    """How many merged rows are of low, medium and high agreement."""
    return merged_lines(t).groupBy(merge.agreement_bucket(F.col("agreement_level_")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'm' || user_id WHEN 'view' THEN 'hybrid-camelot-m' || user_id ELSE event_type END AS label FROM events""")
def reader_label(t: Tables) -> DataFrame:
    """What results are signed with."""
    reader = F.when(F.col("event_type") == "signup", "agent").when(F.col("event_type") == "view", "hybrid").otherwise(F.col("event_type"))
    return t.events.select("event_id", merge.reader_label(reader, F.concat(F.lit("m"), F.col("user_id").cast("string")), F.lit("camelot")).alias("label"))


@query("""SELECT user_id, event_id, dayofyear(ts) AS adj_page, row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts, event_id) - 1 AS position FROM events""")
def fragment_clusters(t: Tables) -> DataFrame:
    """Fragments by page, and their places on it."""
    e = t.events.select("user_id", "event_id", "ts")
    return merge.fragment_clusters(e, ["user_id"], F.dayofyear("ts"), ["ts", "event_id"]).drop("ts")


@query("""SELECT s_suppkey, coalesce(r_name, n_name) AS paper, CASE WHEN r_name IS NULL THEN 0 ELSE n_nationkey END::BIGINT AS page_offset
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name < 'EUROPE') ON r_regionkey = n_regionkey""")
def paper_alias(t: Tables) -> DataFrame:
    """Papers under their canonical names, with the offsets of their pages."""
    aliases = t.nation.join(t.region.where("r_name < 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"), F.col("n_nationkey").alias("offset"))
    papers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("paper"))
    return merge.resolve_papers(papers, aliases)


def _order_sources(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("sources_"))


@query("""WITH d AS (SELECT l_orderkey, n_name, min(l_suppkey::VARCHAR) AS o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT l_orderkey AS paper, string_agg(n_name, ',' ORDER BY o) AS readers_ FROM d GROUP BY l_orderkey""")
def readers_lookup(t: Tables) -> DataFrame:
    """The readers of each row's sources, each once, in order."""
    who = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("uuid"), F.col("n_name").alias("reader"))
    return viewer.readers_of(_order_sources(t), who, ["paper"]).select("paper", F.array_join("readers_", ",").alias("readers_"))


@query("""SELECT DISTINCT l_orderkey AS paper, s_suppkey::VARCHAR AS uuid, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def paper_sources(t: Tables) -> DataFrame:
    """The sources that a paper's rows name."""
    return viewer.paper_sources(t.supplier.select(F.col("s_suppkey").cast("string").alias("uuid"), "s_name"), _order_sources(t)).select("paper", "uuid", "s_name")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def skip_curated(t: Tables) -> DataFrame:
    """Papers whose output nobody has curated yet."""
    done = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return documents.unread(t.orders.select("o_orderkey", "o_custkey"), done, "o_custkey")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_skip(t: Tables) -> DataFrame:
    """Documents that the result set hasn't got yet."""
    return documents.unread(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE regexp_full_match(s_name, 'Supplier#0+1\\d*')""")
def paper_filter(t: Tables) -> DataFrame:
    """Papers whose whole name is what a pattern describes."""
    return t.supplier.where(paper_matches(F.col("s_name"), r"Supplier#0+1\d*.tables.json")).select("s_suppkey", "s_name")
