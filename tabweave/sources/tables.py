"""Result sets of table files as DataFrames: files, tables, fragments and rows."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions.names import PaperAlias
from tabweave.sources import storage

SUFFIX, METADATA, SETTINGS = ".tables.json", "tables.metadata.json", "settings.merge.json"
RESERVED = ("agreement_level_", "sources_", "row_")
FILE = "tables array<string>, citation variant, metadata string, uuid string"


@dataclass
class ResultSets:
    files: DataFrame  # paper, source_ord, path, file, page_offset, uuid, reader, citation (cell), metadata, has_curations
    tables: DataFrame  # paper, source_ord, table_idx
    fragments: DataFrame  # paper, source_ord, table_idx, fragment_idx, page
    rows: DataFrame  # paper, source_ord, table_idx, fragment_idx, page, pos, row_, agreement_level_, sources_, cells


def read_path(path: str | None, inline: str | None = None) -> str | None:
    """A file's text, or else what was given inline."""
    return storage.read_text(path) if path else inline


def read_resultset_metadata(directory: str) -> dict:
    p = f"{directory}/{METADATA}"
    return json.loads(storage.read_text(p)) if storage.exists(p) else {}


def read_with_settings(directory: str) -> tuple[dict, dict]:
    """A result set's metadata and the settings it was merged with."""
    meta = read_resultset_metadata(directory)
    if "sources" in meta:  # a merged set
        meta.setdefault("agreement_method", "simple-count")
    own = meta.get("settings")
    there = storage.names(directory, "settings.*.json")
    for name in [SETTINGS] * (SETTINGS in there) + there:
        return meta, json.loads(storage.read_text(f"{directory}/{name}"))
    return meta, own if isinstance(own, dict) else {}


def paper_matches(stem: Column, pattern: str) -> Column:
    """Whether a paper's name is what a pattern describes, throughout; the files' ending doesn't count."""
    return stem.rlike("^(?:" + re.sub(re.escape(SUFFIX) + "$", "", pattern) + ")$")


def read_texts(spark: SparkSession, directories: Sequence[str], pattern: str | None = None) -> DataFrame:
    """(source_dir_ord, dir, file, stem, path, text), files of a pattern only, before any is parsed.

    A folder that is named more than once is a source each time, but its files are read once.
    """
    dirs = [storage.absolute(d) for d in directories]
    text = spark.read.option("pathGlobFilter", "*" + SUFFIX).text(list(dict.fromkeys(dirs)), wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///" if any(d.startswith("file:") for d in dirs) else "/")
    df = text.select(path.alias("path"), F.col("value").alias("text")).withColumn("file", F.url_decode(F.regexp_extract("path", "([^/]+)$", 1))).withColumn("dir", F.url_decode(F.regexp_replace("path", "/[^/]+$", "")))
    df = df.withColumn("stem", F.regexp_replace("file", re.escape(SUFFIX) + "$", ""))
    if pattern:
        df = df.where(paper_matches(F.col("stem"), pattern))
    order = spark.createDataFrame(list(enumerate(dirs)), "source_dir_ord int, dir string")
    return df.join(F.broadcast(order), "dir").select("source_dir_ord", "dir", "file", "stem", "path", "text")


def cell_of(name: Column, v: Column) -> Column:
    """A cell of a JSON value; numbers and booleans become strings."""
    kind = F.schema_of_variant(v)
    vals = F.try_variant_get(v, "$", C.VALS)
    text = F.try_variant_get(v, "$", "string")
    one = F.array(F.struct(text.alias("value"), F.lit(None).cast("int").alias("agreement_level")))
    k = F.when(v.isNull() | (kind == "VOID"), "null").when(kind.startswith("ARRAY"), "list").otherwise("str")
    return F.struct(name.alias("name"), k.alias("kind"), F.when(k == "list", F.coalesce(vals, F.array().cast(C.VALS))).when(k == "str", one).otherwise(F.array().cast(C.VALS)).alias("vals"))


def parse(texts: DataFrame, aliases: Mapping[str, PaperAlias] | None = None, strict: bool = True) -> ResultSets:
    """Files of :func:`read_texts` taken apart. ``strict``: a malformed file is an error, else it has no tables."""
    spark = texts.sparkSession
    readers = [(d, m.get("uuid"), m.get("reader")) for d in [r.dir for r in texts.select("dir").distinct().collect()] for m in [read_resultset_metadata(d)]]
    meta = spark.createDataFrame(readers, "dir string, set_uuid string, reader string")
    names = spark.createDataFrame([(a, p.canonical, p.offset) for a, p in (aliases or {}).items()], "stem string, canonical string, offset int")
    df = texts.join(F.broadcast(meta), "dir", "left").join(F.broadcast(names), "stem", "left")
    df = df.withColumn("paper", F.coalesce("canonical", "stem")).withColumn("page_offset", F.coalesce("offset", F.lit(0))).withColumn("d", F.from_json("text", FILE))
    df = df.withColumn("bad", F.col("d.tables").isNull())
    if strict:
        df = df.withColumn("bad", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("malformed file: "), F.col("path")))).otherwise(F.lit(False)).cast("boolean"))
    from pyspark.sql import Window

    df = df.where("not bad or bad is null").withColumn("source_ord", (F.row_number().over(Window.partitionBy("paper").orderBy("source_dir_ord", "file")) - 1).cast("int"))
    files = df.select(
        "paper", "source_ord", "path", "file", "page_offset", F.coalesce("set_uuid", F.col("d.uuid")).alias("uuid"), "reader", cell_of(F.lit("citation"), F.col("d.citation")).alias("citation"),
        F.col("d.metadata").alias("metadata"), F.coalesce(F.size(F.from_json("d.metadata", "curations array<string>")["curations"]) > 0, F.lit(False)).alias("has_curations"))
    tables = df.select("paper", "source_ord", F.posexplode("d.tables").alias("table_idx", "t"))
    tables = tables.withColumn("t2", F.from_json("t", "rows array<string>, page int, table_fragments array<string>"))
    whole = F.when(F.col("t2.table_fragments").isNotNull(), F.col("t2.table_fragments")).otherwise(F.array("t"))
    frag = tables.select("paper", "source_ord", "table_idx", F.posexplode(whole).alias("fragment_idx", "f")).withColumn("f2", F.from_json("f", "rows array<string>, page int"))
    rows = frag.select("paper", "source_ord", "table_idx", "fragment_idx", F.col("f2.page").alias("page"), F.posexplode("f2.rows").alias("pos", "r"))
    rows = rows.withColumn("m", F.from_json("r", "map<string,variant>")).withColumn("own", F.from_json("r", "row_ int, agreement_level_ int, sources_ array<string>"))
    keys = F.filter(F.json_object_keys("r"), lambda k: ~k.isin(*RESERVED))
    rows = rows.select("paper", "source_ord", "table_idx", "fragment_idx", "page", "pos", "own.row_", "own.agreement_level_", "own.sources_", F.transform(keys, lambda k: cell_of(k, F.try_element_at("m", k))).alias("cells"))
    return ResultSets(files, tables.select("paper", "source_ord", "table_idx"), frag.select("paper", "source_ord", "table_idx", "fragment_idx", F.col("f2.page").alias("page")), rows)


def read_resultsets(spark: SparkSession, directories: Sequence[str], aliases: Mapping[str, PaperAlias] | None = None, pattern: str | None = None, strict: bool = True) -> ResultSets:
    return parse(read_texts(spark, directories, pattern), aliases, strict)


def curated_papers(spark: SparkSession, directory: str) -> DataFrame:
    """(paper): outputs that somebody has curated; malformed ones count as not curated."""
    if not storage.names(directory, "*" + SUFFIX):
        return spark.createDataFrame([], "paper string")
    return read_resultsets(spark, [directory], strict=False).files.where("has_curations").select("paper")
