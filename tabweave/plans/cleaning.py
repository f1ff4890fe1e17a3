"""Queries over scalar normalisation, filters and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions import scientific
from tabweave.functions import text as X
from tabweave.operators import clean, post
from tabweave.plans.registry import Tables, query

CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{0080}-\x{009f}\x{fffd}]"
DASHES = r"[\x{2010}-\x{2015}\x{2212}]"


def sql_normalized(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(regexp_replace(nfc_normalize({x}), '{CONTROLS}', '', 'g'), '{DASHES}', '-', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g')"


def sql_name(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({sql_normalized(x)}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"


@query(f"SELECT doc_id, {sql_normalized('text')} AS text FROM documents")
def normalize_str(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_str(F.col("text")).alias("text"))


@query(f"""SELECT event_id, CASE WHEN v IN ('no data', 'none', 'not identified') THEN '' ELSE v END AS value FROM
(SELECT event_id, lower({sql_normalized("CASE event_type WHEN 'error' THEN '  None ' WHEN 'view' THEN 'No  Data' ELSE upper(event_type) || ' ' || props END")}) AS v FROM events)""")
def normalize_value(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "error", "  None ").when(kind == "view", "No  Data").otherwise(F.concat_ws(" ", F.upper(kind), "props"))
    return t.events.select("event_id", X.normalize_value(raw).alias("value"))


@query(f"SELECT page_id, {sql_name('url')} AS name, {sql_name('html')} AS other FROM pages")
def normalize_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.normalize_name(F.col("url")).alias("name"), X.normalize_name(F.col("html")).alias("other"))


@query(f"""SELECT doc_id, {sql_normalized("'  ' || upper(source) || ' – ' || lang || ' '")} AS citation FROM documents""")
def citation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_citation(F.concat(F.lit("  "), F.upper("source"), F.lit(" – "), "lang", F.lit(" "))).alias("citation"))


@query(r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '#[^\n]*', '', 'g'), '[\s,]+'), lambda x: x <> ''), ' ') AS tokens FROM documents""")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


def _sql_punctuation(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '{DASHES}', '-', 'g'), '[«»‹›]', '', 'g')"
    x = f"""regexp_replace({x}, '[“”"]', '''', 'g')"""
    for plain, acute in zip("aeiouAEIOU", "áéíóúÁÉÍÓÚ"):
        x = f"replace({x}, '{plain}´', '{acute}')"
    x = f"regexp_replace({x}, '[‘’´`ʹʻʼʽ′‵]', '''', 'g')"
    return rf"replace(regexp_replace({x}, '^(.*\S{{5,}})\.$', '\1'), '…', '...')"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, {_sql_punctuation("line")} AS line FROM l""")
def normalize_punctuation(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = clean.normalize_punctuation(lines.select("doc_id", "pos", F.array(C.text_cell("line", F.col("line"))).alias("cells")))
    return rows.select("doc_id", "pos", F.try_element_at(F.try_element_at("cells", F.lit(1))["vals"], F.lit(1))["value"].alias("line"))


def _part_rows(t: Tables, value) -> DataFrame:
    return t.part.select("p_brand", F.col("p_partkey").alias("pos"), F.array(C.text_cell("name", value)).alias("cells"))


def _value(column: str = "cells"):
    return F.try_element_at(F.try_element_at(column, F.lit(1))["vals"], F.lit(1))["value"]


@query("""WITH r AS (SELECT p_brand, p_partkey AS pos, CASE WHEN p_size < 10 THEN 'Table ' || p_size || '. ' || p_name WHEN p_size < 20 THEN 'Fig.' || p_size ELSE p_name END AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_size FROM part)
SELECT p_brand, pos, value FROM r WHERE n > 3 OR p_size >= 20""")
def filter_title_rows(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") < 10, F.concat(F.lit("Table "), size, F.lit(". "), "p_name")).when(F.col("p_size") < 20, F.concat(F.lit("Fig."), size)).otherwise(F.col("p_name"))
    return clean.filter_title_rows(_part_rows(t, value), ["p_brand"]).select("p_brand", "pos", _value().alias("value"))


@query("""WITH r AS (SELECT p_brand, p_partkey AS pos, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand, pos, CASE WHEN p_brand LIKE 'Brand#1%' THEN p_name WHEN p_brand LIKE 'Brand#2%' THEN (1000000000 - n) || '. ' || p_name ELSE p_name END AS value FROM r""")
def strip_leading_numbers(t: Tables) -> DataFrame:
    """Numbers that count upwards go; those that count down stay."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    numbered = lambda k: F.concat(k.cast("string"), F.lit(". "), "p_name")
    value = F.when(F.col("p_brand").startswith("Brand#1"), numbered(n)).when(F.col("p_brand").startswith("Brand#2"), numbered(1000000000 - n)).otherwise(F.col("p_name"))
    part = t.part.withColumn("v", value)
    rows = part.select("p_brand", F.col("p_partkey").alias("pos"), F.array(C.text_cell("name", F.col("v"))).alias("cells"))
    return clean.strip_leading_numbers(rows, ["p_brand"]).select("p_brand", "pos", _value().alias("value"))


@query("""SELECT n_regionkey::BIGINT AS n_regionkey, n_name AS value FROM nation""")
def filter_header_rows(t: Tables) -> DataFrame:
    """Rows that repeat the names of their columns, here one added to each fragment and one that holds a hint, go."""
    body = t.nation.select("n_regionkey", "n_name", F.col("n_nationkey").cast("string").alias("key"))
    heads = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.lit("N Name").alias("n_name"), F.lit("-").alias("key"))
    hinted = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.lit("x").alias("n_name"), F.lit("Clé").alias("key"))
    rows = body.unionByName(heads).unionByName(hinted).select("n_regionkey", C.from_columns("n_name", **{"1": F.col("key")}).alias("cells"))
    return clean.filter_header_rows(rows, ["cle"]).select("n_regionkey", _value().alias("value"))


VALUE = "CASE event_type WHEN 'error' THEN ' Not  identified' WHEN 'view' THEN '' WHEN 'click' THEN NULL ELSE props END"


@query("SELECT event_id, event_type IN ('error', 'view', 'click') AS empty FROM events")
def empty_values(t: Tables) -> DataFrame:
    cells = C.text_cell("v", F.expr(VALUE))
    return t.events.select("event_id", cells.alias("c")).select("event_id", C.is_empty(F.col("c")).alias("empty"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view', 'click') OR value >= 10")
def filter_empty_rows(t: Tables) -> DataFrame:
    other = F.when(F.col("value") >= 10, F.col("value").cast("string"))
    return clean.filter_empty_rows(t.events.select("event_id", C.from_columns(a=F.expr(VALUE), b=other).alias("cells"))).select("event_id")


@query("""SELECT p_partkey, name, try_cast(name AS DOUBLE) IS NULL AS is_semantic FROM (SELECT p_partkey, unnest([p_size::VARCHAR, p_name, p_size || 'e2', ' -' || p_size || '.5 ', p_brand, 'nan', p_size || 'f']) AS name FROM part)""")
def semantic_columns(t: Tables) -> DataFrame:
    """Whether names are names, or numbers."""
    size = F.col("p_size").cast("string")
    names = F.array(size, F.col("p_name"), F.concat(size, F.lit("e2")), F.concat(F.lit(" -"), size, F.lit(".5 ")), F.col("p_brand"), F.lit("nan"), F.concat(size, F.lit("f")))
    return t.part.select("p_partkey", F.explode(names).alias("name")).withColumn("is_semantic", X.is_semantic_name(F.col("name")))


def _names(column: str = "cells"):
    return F.array_join(C.names(F.col(column)), ",")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'brand,' || p_name ELSE 'brand' END AS names FROM part")
def only_semantic(t: Tables) -> DataFrame:
    last = F.when(F.col("p_size") > 20, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    cells = F.array(C.text_cell("0", F.col("p_name")), C.text_cell("brand", F.col("p_brand")), C.text_cell("1e3", F.col("p_type")), C.text_cell(last, F.col("p_type")))
    return post.only_semantic_columns(t.part.select("p_partkey", cells.alias("cells"))).select("p_partkey", _names().alias("names"))


DROPPED = "CASE WHEN event_type IN ('error', 'view', 'click') THEN"


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, bool_or(value >= 50) OVER (PARTITION BY user_id, event_type) AS big FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('error', 'view', 'click') THEN 'a' END, CASE WHEN big THEN 'b' END, 'c'], lambda x: x IS NOT NULL), ',') AS names FROM e""")
def drop_empty_columns(t: Tables) -> DataFrame:
    """Columns that are empty in all rows of their fragment go."""
    big = F.when(F.col("value") >= 50, F.col("value").cast("string"))
    rows = t.events.select("user_id", "event_type", "event_id", C.from_columns(a=F.expr(VALUE), b=big, c=F.col("props")).alias("cells"))
    return post.drop_empty_columns(rows, ["user_id", "event_type"]).select("event_id", _names().alias("names"))


@query("""SELECT DISTINCT user_id, event_type FROM events WHERE event_type NOT IN ('error', 'view', 'click')""")
def drop_empty_tables(t: Tables) -> DataFrame:
    """Fragments without a row that isn't empty go."""
    rows = t.events.select("user_id", "event_type", C.from_columns(a=F.expr(VALUE)).alias("cells"))
    fragments = t.events.select("user_id", "event_type").distinct()
    return post.drop_empty_fragments(fragments, rows, ["user_id", "event_type"])[0]


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS "left", split_part(p_name, ' ', 2) AS "right" FROM part""")
def split_conjunction_names(t: Tables) -> DataFrame:
    """Names like a_and_b as two."""
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_and_"))
    return t.part.select("p_partkey", X.conjunction_split(name).alias("s")).select("p_partkey", "s.*")


@query()
def split_conjunction_values(t: Tables) -> DataFrame:
    """Values of such columns as two, where they are most like the names; embeddings can't be had in SQL."""
    rows = t.part.select("p_partkey", F.array(C.text_cell("size_and_thing", F.col("p_name"))).alias("cells"))
    out = clean.split_conjunction_columns(rows, ["p_partkey"])
    return out.select("p_partkey", C.first_text(C.get(F.col("cells"), "size")).alias("size"), C.first_text(C.get(F.col("cells"), "thing")).alias("thing"))


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
r AS (SELECT p_brand, p_partkey AS pos, CASE WHEN p_brand LIKE '%1%' THEN reverse(p_name) ELSE p_name END AS value FROM part),
w AS (SELECT p_brand, unnest(string_split(lower(value), ' ')) AS word, -1 AS k FROM r WHERE length(value) > 2 UNION ALL SELECT p_brand, unnest(string_split(lower(reverse(value)), ' ')), 1 FROM r WHERE length(value) > 2),
b AS (SELECT p_brand FROM w JOIN v USING (word) GROUP BY p_brand HAVING sum(k) > 0)
SELECT p_brand, pos, CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN reverse(value) ELSE value END AS value FROM r""")
def reverse_values(t: Tables) -> DataFrame:
    """Fragments that read better backwards are turned round."""
    words = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    value = F.when(F.col("p_brand").contains("1"), F.reverse("p_name")).otherwise(F.col("p_name"))
    return clean.reverse_values(_part_rows(t, value), ["p_brand"], words).select("p_brand", "pos", _value().alias("value"))


@query("""SELECT p_partkey, upper(p_name[1]) || p_name[2:] || ', ' || upper(p_type[1]) || lower(p_type[2:]) AS name FROM part""")
def scientific_name(t: Tables) -> DataFrame:
    """Names with authors and years in canonical form."""
    text = F.concat(F.upper("p_name"), F.lit(" (L.) Mill., 1768"), F.lit("/"), F.lower("p_type"))
    return t.part.select("p_partkey", scientific.scientific_name(text).alias("name"))
