"""Queries over the shape of tables: fragments, pages, runs and ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.operators import shape, viewer
from tabweave.plans.registry import Tables, query
from tabweave.sources import documents, sinks

NAMES = "CASE event_type WHEN 'error' THEN [] WHEN 'click' THEN ['0', '1'] ELSE [event_type] END"
LAGGED = f"""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS table_idx, dayofyear(ts) AS page, {NAMES}::VARCHAR[] AS names FROM events),
l AS (SELECT *, lag(page) OVER w AS pp, lag(names) OVER w AS pn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY table_idx))"""


def _event_tables(t: Tables) -> DataFrame:
    """Each event as a table of one fragment: its page is the day, its columns depend on its type."""
    kind = F.col("event_type")
    names = F.when(kind == "error", F.array().cast("array<string>")).when(kind == "click", F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(kind))
    e = shape.row_ordinals(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "table_idx")
    one = F.struct(F.dayofyear("ts").alias("page"), names.alias("names"))
    return e.select("user_id", "event_id", "table_idx", one.alias("first"), one.alias("last"))


def _island(goes_on: str) -> str:
    return f"{LAGGED} SELECT user_id, event_id, (sum(CASE WHEN pn IS NOT NULL AND (len(pn) = 0 OR len(names) = 0 OR {goes_on}) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY table_idx ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS island FROM l"


SEMANTIC = "(NOT list_contains(names, '0') AND NOT list_contains(pn, '0'))"


@query(_island(f"({SEMANTIC} AND page BETWEEN pp AND pp + 1 AND pn = names)"))
def safe_compact(t: Tables) -> DataFrame:
    """Tables joined with those they go on from: same names, same or next page."""
    return shape.compact(_event_tables(t), ["user_id"]).select("user_id", "event_id", "island")


@query(_island(f"CASE WHEN {SEMANTIC} THEN pn = names ELSE len(pn) = len(names) END"))
def unsafe_compact(t: Tables) -> DataFrame:
    """The same whatever the page, and for numbered columns by their count."""
    return shape.compact(_event_tables(t), ["user_id"], safe=False).select("user_id", "event_id", "island")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY dayofyear(ts), event_id) - 1 AS table_idx, 0::BIGINT AS fragment_idx FROM events""")
def explode_fragments(t: Tables) -> DataFrame:
    """Each fragment as a table of its own."""
    e = t.events.select("user_id", "event_id", F.dayofyear("ts").alias("table_idx"), F.col("event_id").alias("fragment_idx"))
    return shape.explode_fragments(e, ["user_id"])


SPANS = """WITH e AS (SELECT user_id, event_id, dayofyear(ts) AS row_, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
j AS (SELECT *, CASE WHEN row_ = lag(row_) OVER w AND value = lag(value) OVER w THEN 1 ELSE 0 END AS joins FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
i AS (SELECT *, sum(1 - joins) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM j)"""


@query(SPANS + " SELECT user_id, event_id, CASE WHEN joins = 1 THEN 0 ELSE count(*) OVER (PARTITION BY user_id, island) END AS rowspan FROM i")
def rowspans(t: Tables) -> DataFrame:
    """Lengths of runs of equal values within a row group."""
    e = t.events.select("user_id", "event_id", "ts", F.dayofyear("ts").alias("row_"), F.col("event_type").alias("value"))
    return shape.rowspans(e, ["user_id"], ["ts", "event_id"], "row_", "value").select("user_id", "event_id", "rowspan")


@query(SPANS + " SELECT user_id, pos, 0::BIGINT AS column_pos, 'type' AS name, value, CASE WHEN joins = 1 THEN 0 ELSE count(*) OVER (PARTITION BY user_id, island) END AS rowspan, 'low' AS level FROM i")
def viewer_cells(t: Tables) -> DataFrame:
    """Every cell that the viewer shows, with its place, rowspan and class of agreement."""
    e = shape.row_ordinals(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "pos")
    rows = e.select("user_id", "pos", F.dayofyear("ts").alias("row_"), F.lit(1).alias("agreement_level_"), C.from_columns(type=F.col("event_type")).alias("cells"))
    return viewer.display_cells(rows, ["user_id"])


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, ((row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY page_id) - 1) // 3)::BIGINT AS batch FROM pages""")
def page_batches(t: Tables) -> DataFrame:
    """Pages in batches of three for each document."""
    p = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return shape.page_batches(p, ["host"], ["page_id"], 3)


@query("""SELECT page_id, url AS path, page_id % 9 + 1 AS first_page, page_id % 9 + 4 AS last_page FROM pages""")
def page_range(t: Tables) -> DataFrame:
    """path:from:to taken apart."""
    text = F.concat_ws(":", "url", (F.col("page_id") % 9 + 1).cast("string"), (F.col("page_id") % 9 + 4).cast("string"))
    return t.pages.select("page_id", documents.page_range(text).alias("r")).select("page_id", "r.*")


@query("""SELECT event_id, dayofyear(ts) AS page FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, dayofyear(ts) + 100 FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, dayofyear(ts) + 200 FROM events WHERE event_type = 'error'""")
def page_offset_union(t: Tables) -> DataFrame:
    """Results of batches in one, their pages moved."""
    e = t.events.select("event_id", "event_type", F.dayofyear("ts").alias("page"))
    return shape.union_with_offset([(e.where(F.col("event_type") == k).drop("event_type"), n) for k, n in (("click", 0), ("view", 100), ("error", 200))])


ROWS = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


@query(f"""SELECT l_orderkey, {ROWS}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROWS}) - 1 AS row_ FROM lineitem""")
def row_ordinals(t: Tables) -> DataFrame:
    """Rows with their places in their fragment."""
    cols = ROWS.split(", ")
    return shape.row_ordinals(t.lineitem.select("l_orderkey", *cols), ["l_orderkey"], cols)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 50""")
def sample_head(t: Tables) -> DataFrame:
    """The first 50 rows of each fragment, as alignment samples them."""
    return shape.sample_head(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""SELECT p_partkey::VARCHAR AS part_no, replace(p_name, chr(10), ' ') AS product_name, p_size::VARCHAR AS size FROM part""")
def mapped_projection(t: Tables) -> DataFrame:
    """Columns by number under new names."""
    return documents.mapped_projection(t.part, [(0, "Part No."), (1, "Product name"), (4, "Size")])


KINDS = ("click", "view", "signup", "purchase", "error")


@query(f"""SELECT event_id, {", ".join(f"CASE WHEN event_type = '{k}' THEN props END AS {k}" for k in KINDS)}, user_id::VARCHAR AS "user" FROM events""")
def csv_flatten(t: Tables) -> DataFrame:
    """Ragged rows as one flat table."""
    props = C.text_cell(F.col("event_type"), F.col("props"))
    rows = t.events.select("event_id", F.array(props, C.text_cell("user", F.col("user_id").cast("string"))).alias("cells"))
    return sinks.flatten(rows, ["event_id"], [*KINDS, "user"])


@query("""SELECT r_name AS paper, '{"tables":[{"table_fragments":[{"rows":[' || string_agg('{"key":"' || n_nationkey || '","name":"' || n_name || '","agreement_level_":1,"sources_":null,"row_":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || '],"page":1}]}],"citation":null}' AS doc
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def nested_json(t: Tables) -> DataFrame:
    """Tables nested into one JSON document for each paper."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("r_name").alias("paper"), F.lit(0).alias("table_idx"), F.lit(0).alias("fragment_idx"), F.lit(1).alias("page"), F.col("n_nationkey").alias("pos"), F.lit(1).alias("agreement_level_"), F.lit(None).cast("array<string>").alias("sources_"), F.col("n_nationkey").alias("row_"), C.from_columns(key=F.col("n_nationkey"), name=F.col("n_name")).alias("cells"))
    places = rows.select("paper", "table_idx", "fragment_idx", "page").distinct()
    return sinks.nested(places.select("paper", "table_idx"), places, rows)
