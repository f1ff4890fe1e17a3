"""The n-way merge: the same table, read several times, as one with agreement counts and lineage.

Rows of all sources meet by (cluster, row ordinal, content) in one groupBy; nothing is folded in order, so a
cluster of any size is spread over the cluster's machines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import batch
from tabweave.functions import cells as C

CLASSIC = ("pdfplumber", "camelot", "pymupdf")


def is_agent(reader: Column) -> Column:
    """Anything that isn't a known classic or hybrid reader counts as an agent, as does no name at all."""
    return ~F.coalesce(reader.isin(*CLASSIC) | reader.startswith("hybrid-"), F.lit(False))


def reader_label(reader: Column, model: Column, inner: Column) -> Column:
    """What a result is signed with: an agent's model, or hybrid-reader-model."""
    return F.when(reader == "agent", model).when(reader == "hybrid", F.concat_ws("-", F.lit("hybrid"), inner, model)).otherwise(reader)


def agreement_bucket(level: Column) -> Column:
    return F.when(level <= 1, "low").when(level == 2, "medium").otherwise("high")


def fragment_clusters(df: DataFrame, source: Sequence[str], page: Column, order: Sequence[str]) -> DataFrame:
    """``adj_page`` and ``position``: which fragment on its page of its source this is."""
    df = df.withColumn("adj_page", page)
    return df.withColumn("position", (F.row_number().over(Window.partitionBy(*source, "adj_page").orderBy(*order)) - 1).cast("int"))


def merge_rows(df: DataFrame, cluster: Sequence[str], ordinal: str = "row_", content: str | Sequence[str] = "content", source: str = "source_ord", uuid: str = "uuid", level: str = "agreement_level_", cells: str | None = "cells", method: str = "simple-count", readers: DataFrame | None = None) -> DataFrame:
    """One row for each distinct content of an ordinal: summed levels, sources in order, and the first source's values.

    Columns: cluster, ordinal, content, agreement_level_, sources_, first_src and, if ``cells`` names a column, the
    first source's cells in the last one's column order. ``distinct-readers`` counts each agent and each different
    classic reader once, 1 at least, where rows merged.
    """
    keys = [*cluster, ordinal, *([content] if isinstance(content, str) else content)]
    aggs = [
        F.sum(F.coalesce(F.col(level), F.lit(1))).cast("int").alias("agreement_level_"),
        F.count("*").alias("__n"),
        F.array_sort(F.collect_list(F.struct(F.col(source).alias("o"), F.col(uuid).alias("u")))).alias("__s"),
        F.min(source).alias("first_src"),
    ]
    if cells:
        aggs += [F.min_by(cells, source).alias("__first"), F.max_by(F.transform(F.col(cells), lambda c: c["name"]), source).alias("__names")]
    out = df.groupBy(*keys).agg(*aggs)
    us = F.array_distinct(F.filter(F.transform("__s", lambda x: x["u"]), lambda u: u.isNotNull()))
    out = out.withColumn("sources_", F.when(F.size(us) > 0, us)).drop("__s")
    if cells:
        out = out.withColumn(cells, F.transform("__names", lambda n: C.get(F.col("__first"), n))).drop("__first", "__names")
    if method == "distinct-readers":
        if readers is None:
            raise ValueError("distinct-readers needs the readers (uuid, reader)")
        out = _distinct_readers(out, keys, readers)
    elif method != "simple-count":
        raise ValueError(f"unknown agreement method: {method}")
    return out.drop("__n")


def _distinct_readers(out: DataFrame, keys: list[str], readers: DataFrame) -> DataFrame:
    """Levels by readers; the lookup (uuid, reader) travels as one small map if it is small, else as a join."""
    one = out.where("__n > 1").select(*keys, F.explode("sources_").alias("uuid")).join(readers.select("uuid", "reader"), "uuid", "left")
    agents = F.count(F.when(is_agent(F.col("reader")), 1))
    classic = F.count_distinct(F.when(~is_agent(F.col("reader")), F.col("reader")))
    levels = one.groupBy(*keys).agg(F.greatest(F.lit(1), agents + classic).cast("int").alias("__level"))
    levels = levels.select(*(F.col(k).alias(f"__{k}") for k in keys), "__level")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = out.join(levels, on, "left").drop(*(f"__{k}" for k in keys))
    return joined.withColumn("agreement_level_", F.when(F.col("__n") > 1, F.coalesce("__level", F.lit(1))).otherwise(F.col("agreement_level_"))).drop("__level")


def column_agreement(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, name, value, agreement_level): how many sources have each value of each column; nulls don't count."""
    one = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(*keys, "x.*")
    return one.where("value is not null").groupBy(*keys, "name", "value").agg(F.count("*").alias("agreement_level"))


def merge_pairwise(df: DataFrame, cluster: Sequence[str], content: str = "content", source: str = "source_ord") -> DataFrame:
    """Two at a time, as rows merge when values keep their own agreement: a merged row equals no plain one again."""
    w = Window.partitionBy(*cluster, "row_", content).orderBy(source)
    df = df.select(*cluster, "row_", content, source, F.row_number().over(w).alias("__n"), F.lead(F.lit(1)).over(w).alias("__more"), F.lead(source).over(w).alias("__next")).where("__n % 2 = 1")
    level = F.when(F.col("__more").isNull(), 1).otherwise(2).cast("bigint")
    return df.select(*cluster, "row_", content, F.floor((F.col("__n") - 1) / 2).alias("pair"), level.alias("agreement_level_"), F.least(source, "__next").alias("first_src"))


def resolve_papers(df: DataFrame, aliases: DataFrame, paper: str = "paper") -> DataFrame:
    """Canonical ``paper`` and ``page_offset`` by aliases (alias, canonical, offset)."""
    a = aliases.select(F.col("alias").alias(paper), "canonical", "offset")
    return df.join(a, paper, "left").withColumn("page_offset", F.coalesce("offset", F.lit(0))).withColumn(paper, F.coalesce("canonical", F.col(paper))).drop("canonical", "offset")


def merge_fragments(files: DataFrame, fragments: DataFrame, rows: DataFrame, method: str = "simple-count", readers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged (fragments, rows) of all papers.

    ``files``: paper, source_ord, uuid, page_offset. Fragments of one table index meet by adjusted page and by
    their place on it; a merged fragment keeps the first source's own page. Row ordinals count the rows as given.
    """
    source = ["paper", "source_ord", "table_idx"]
    placed = fragment_clusters(fragments.join(files.select("paper", "source_ord", "uuid", "page_offset"), ["paper", "source_ord"]), source, (F.col("page") + F.col("page_offset")).cast("int"), ["fragment_idx"])
    cluster = ["paper", "table_idx", "adj_page", "position"]
    heads = placed.groupBy(*cluster).agg(F.min_by("page", "source_ord").alias("page"))
    w = Window.partitionBy("paper", "table_idx").orderBy("adj_page", "position")
    heads = heads.withColumn("fragment_idx", (F.row_number().over(w) - 1).cast("int"))
    full = rows.drop("page").join(placed.select(*source, "fragment_idx", "adj_page", "position", "uuid"), [*source, "fragment_idx"])
    order = Window.partitionBy(*source, "fragment_idx").orderBy("pos")
    full = full.withColumn("row_", (F.row_number().over(order) - 1).cast("int"))
    full = full.withColumn("__c", batch.compared(F.col("cells"))).where("not __c.empty").withColumn("cells", F.col("__c.cells")).withColumn("content", F.col("__c.content")).drop("__c")
    merged = merge_rows(full, cluster, method=method, readers=readers)
    out = merged.join(heads, cluster).withColumn("pos", (F.row_number().over(Window.partitionBy(*cluster).orderBy("row_", "first_src")) - 1).cast("int"))
    keep = ["paper", "table_idx", "fragment_idx", "page"]
    return heads.select(*keep), out.select(*keep, "pos", "row_", "agreement_level_", "sources_", "cells")
