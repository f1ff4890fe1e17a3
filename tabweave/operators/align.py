"""Which column is which: renamings inferred from names, hints, aliases, and shared or similar values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions import batch
from tabweave.functions import cells as C
from tabweave.functions import text as X
from tabweave.operators.clean import Embedder, ngram_embedder
from tabweave.operators.shape import sample_head

REMOVE = "<remove>"


def apply_mapping(rows: DataFrame, mapping: DataFrame, by: Sequence[str]) -> DataFrame:
    """Renames by (by, source, target); cells that then share a name are joined, the one that had it first, then in order."""
    maps = mapping.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("__m"))
    out = rows.join(maps, list(by), "left") if by else rows.crossJoin(maps)  # without ``by`` the map is one row
    return out.withColumn("cells", batch.renamed(F.col("cells"), F.col("__m"), REMOVE)).select(*rows.columns)


def normalize_column_names(rows: DataFrame) -> DataFrame:
    """Every column under its normalised name."""
    return rows.withColumn("cells", batch.renamed_by(F.col("cells"), batch.normalize_name))


def alias_columns(rows: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Renames by normalised alias; the target <remove> drops the column."""
    if not aliases:
        return rows
    known = {a: None if t == REMOVE else t for a, t in aliases.items()}
    return rows.withColumn("cells", batch.renamed_by(F.col("cells"), lambda n: known.get(batch.normalize_name(n), n)))


def hints_mapping(rows: DataFrame, by: Sequence[str], hints: Sequence[str], safe: bool = True) -> DataFrame:
    """(by, source, target): if the first row that isn't empty holds a hint, its cells name the columns; ``safe``: numbered ones."""
    w = Window.partitionBy(*by).orderBy("pos")
    first = rows.where(~C.all_empty(F.col("cells"))).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    cells = first.select(*by, F.explode("cells").alias("c")).where(~X.is_semantic_name(F.col("c.name")) if safe else F.lit(True))
    found = cells.select(*by, F.col("c.name").alias("source"), X.normalize_name(C.first_text(F.col("c"))).alias("target"))
    hit = found.groupBy(*by).agg(F.bool_or(F.col("target").isin(*hints)).alias("hit")).where("hit").drop("hit")
    return found.where("target != ''").join(hit, list(by), "left_semi")


def greedy_match(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, source, target, score): one to one, the best scores first; ties by ``source_ord``, then ``target_ord``."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "source_ord", "target_ord", "source", "target", "score")))
    kind = "array<struct<source:string,target:string,score:double>>"
    taken = lambda acc, x: F.exists(acc, lambda a: (a["source"] == x["source"]) | (a["target"] == x["target"]))
    pick = F.aggregate(F.col("__c"), F.array().cast(kind), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(F.struct(x["source"].alias("source"), x["target"].alias("target"), x["score"].cast("double").alias("score"))))))
    return scores.groupBy(*by).agg(order.alias("__c")).select(*by, F.explode(pick).alias("m")).select(*by, "m.*")


def value_sets(rows: DataFrame, by: Sequence[str], sample: int = 50) -> DataFrame:
    """(by, name, ord, vals): the comparable values of each column in the first rows."""
    head = sample_head(rows, by, ["pos"], sample)
    one = head.select(*by, "pos", F.posexplode("cells").alias("i", "c")).select(*by, "pos", "i", F.col("c.name").alias("name"), F.explode_outer("c.vals.value").alias("v"))
    one = one.withColumn("v", X.comparable(F.col("v")))
    return one.groupBy(*by, "name").agg(F.min(F.struct("pos", "i")).alias("ord"), F.collect_set(F.when(F.col("v") != "", F.col("v"))).alias("vals"))


def renamable(name: Column, schema: Sequence[str] | None, source: bool = True) -> Column:
    """Sources of renamings are columns outside the schema, or without one numbered columns; targets are the others."""
    inside = name.isin(*schema) if schema else X.is_semantic_name(name)
    return ~inside if source else inside


def jaccard_mapping(left: DataFrame, right: DataFrame, by: Sequence[str], threshold: float = 0.5, schema: Sequence[str] | None = None) -> DataFrame:
    """(by, source, target, score) where exactly one side has columns to rename and the other has names for them.

    ``left`` and ``right``: value sets of the first and the second fragment of each cluster.
    """
    sides = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    src = renamable(F.col("name"), schema)
    gate = sides.groupBy(*by).agg(F.count_if(src & (F.col("side") == 0)).alias("ls"), F.count_if(src & (F.col("side") == 1)).alias("rs"), F.count_if(~src & (F.col("side") == 0)).alias("lt"), F.count_if(~src & (F.col("side") == 1)).alias("rt"))
    gate = gate.withColumn("from", F.when((F.col("rs") > 0) & (F.col("lt") > 0) & (F.col("ls") == 0), 1).when((F.col("ls") > 0) & (F.col("rt") > 0) & (F.col("rs") == 0), 0)).where("`from` is not null").select(*by, "from")
    a = sides.where(src).join(gate, list(by)).where("side = `from`").select(*by, F.col("name").alias("source"), F.col("ord").alias("source_ord"), F.col("vals").alias("a"))
    b = sides.where(~src).join(gate, list(by)).where("side != `from`").select(*by, F.col("name").alias("target"), F.col("ord").alias("target_ord"), F.col("vals").alias("b"))
    union = F.size(F.array_union("a", "b"))
    scored = a.join(b, list(by)).withColumn("score", F.when(union > 0, F.size(F.array_intersect("a", "b")) / union).otherwise(F.lit(0.0))).where(F.col("score") >= threshold)
    return greedy_match(scored, by)


def similarity_udf(embed: Embedder = ngram_embedder):
    """Cosine of the embeddings of two string columns, as an Arrow function."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        texts = sorted({*a.dropna(), *b.dropna()})
        if not texts:
            return pd.Series([None] * len(a), dtype=float)
        at, v = {t: i for i, t in enumerate(texts)}, embed(texts)
        return pd.Series([None if x is None or y is None else float(v[at[x]] @ v[at[y]]) for x, y in zip(a, b)], dtype=float)

    return run


def semantic_mapping(rows: DataFrame, by: Sequence[str], schema: Sequence[str], threshold: float = 0.5, embed: Embedder = ngram_embedder, sample: int = 50) -> DataFrame:
    """(by, source, target, score): columns outside the schema by the mean similarity of their values to its names.

    A named column is renamed only if its values are more like the schema's name than like its own.
    """
    head = sample_head(rows, by, ["pos"], sample)
    one = head.select(*by, "pos", F.posexplode("cells").alias("i", "c")).select(*by, "pos", "i", F.col("c.name").alias("source"), F.substring(X.strip(F.try_element_at("c.vals", F.lit(1))["value"]), 1, 128).alias("v")).where("v != ''")
    one = one.where(renamable(F.col("source"), schema))
    words = lambda c: F.translate(c, "_-", "  ")
    targets = F.array(*(F.struct(F.lit(i).alias("target_ord"), F.lit(n).alias("target")) for i, n in enumerate(schema)), F.struct(F.lit(-1).alias("target_ord"), F.col("source").alias("target")))
    pairs = one.withColumn("t", F.explode(targets)).select("*", "t.*").withColumn("s", similarity_udf(embed)(F.col("v"), words(F.col("target"))))
    mean = pairs.groupBy(*by, "source", "target_ord", "target").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("score"), F.min(F.struct("pos", "i")).alias("source_ord"))
    own = mean.where("target_ord < 0").select(*by, "source", F.when(X.is_semantic_name(F.col("source")), F.col("score")).alias("own"))
    scored = mean.where("target_ord >= 0").where(F.col("score") >= threshold).join(own, [*by, "source"]).where("own is null or own < score")
    return greedy_match(scored, by)


def value_semantic_mapping(left: DataFrame, right: DataFrame, by: Sequence[str], threshold: float = 0.5, schema: Sequence[str] | None = None, embed: Embedder = ngram_embedder) -> DataFrame:
    """As :func:`jaccard_mapping`, by the similarity of values to the other side's names."""
    words = lambda c: F.translate(c, "_-", "  ")
    sides = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    src = renamable(F.col("name"), schema)
    gate = sides.groupBy(*by).agg(F.count_if(src & (F.col("side") == 0)).alias("ls"), F.count_if(src & (F.col("side") == 1)).alias("rs"))
    gate = gate.withColumn("from", F.when((F.col("ls") == 0) & (F.col("rs") > 0), 1).when((F.col("rs") == 0) & (F.col("ls") > 0), 0)).where("`from` is not null").select(*by, "from")
    a = sides.where(src).join(gate, list(by)).where("side = `from`").select(*by, F.col("name").alias("source"), F.col("ord").alias("source_ord"), F.explode("vals").alias("v"))
    b = sides.where(~src).join(gate, list(by)).where("side != `from`").select(*by, F.col("name").alias("target"), F.col("ord").alias("target_ord"))
    s = a.join(b, list(by)).withColumn("s", similarity_udf(embed)(F.substring("v", 1, 128), words(F.col("target"))))
    scored = s.groupBy(*by, "source", "source_ord", "target", "target_ord").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("score")).where(F.col("score") >= threshold)
    return greedy_match(scored, by)


def align_clusters(rows: DataFrame, cluster: Sequence[str], source: str = "source_ord", threshold: float = 0.5, schema: Sequence[str] | None = None, semantic: bool = False, jaccard: bool = True) -> DataFrame:
    """Columns of all sources of a cluster renamed by what its first two sources show."""
    rank = F.dense_rank().over(Window.partitionBy(*cluster).orderBy(source))
    two = rows.withColumn("__r", rank)
    left, right = (value_sets(two.where(f"__r = {k}").drop("__r"), cluster) for k in (1, 2))
    if jaccard:
        found = jaccard_mapping(left, right, cluster, threshold, schema)
        rows = apply_mapping(rows, found.select(*cluster, "source", "target"), cluster)
    if semantic:
        if jaccard:
            two = rows.withColumn("__r", rank)
            left, right = (value_sets(two.where(f"__r = {k}").drop("__r"), cluster) for k in (1, 2))
        found = value_semantic_mapping(left, right, cluster, threshold, schema)
        rows = apply_mapping(rows, found.select(*cluster, "source", "target"), cluster)
    return rows
