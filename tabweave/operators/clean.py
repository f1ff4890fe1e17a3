"""Filters and repairs of the rows of fragments. ``by`` names the columns of a fragment, ``pos`` orders its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions import cells as C
from tabweave.functions import text as X

TITLE = r"(?i)^((figure|table|figura|tabla)\s+|fig\.\s*)\d+"
LEADING = r"^(\d+)\.\s+"
PAIR = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])


def filter_empty_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~C.all_empty(F.col("cells")))


def is_title(cells: Column) -> Column:
    full = F.filter(cells, lambda c: ~C.is_empty(c))
    return X.strip(F.array_join(F.transform(full, C.first_text), "")).rlike(TITLE)


def filter_title_rows(rows: DataFrame, by: Sequence[str], head: int = 3) -> DataFrame:
    """Without title rows among the first ``head`` of each fragment."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    return rows.withColumn("__n", n).where((F.col("__n") > head) | ~is_title(F.col("cells"))).drop("__n")


def _plain(rows: DataFrame) -> DataFrame:
    """Adds ``__low``: the cells with normalised strings, and ``__as``: those as names."""
    rows = rows.withColumn("__forms", X.forms_map(C.strings(F.col("cells")), X.nfc)).withColumn("__ascii", X.forms_map(C.strings(F.col("cells")), lambda t: X.to_ascii(X.nfc(t))))
    form, plain = X.by_map(F.col("__forms")), X.by_map(F.col("__ascii"))
    rows = rows.withColumn("__low", C.map_values(F.col("cells"), lambda v: X.normalize_value(v, form)))
    return rows.withColumn("__as", C.map_values(F.col("cells"), lambda v: X.normalize_name(v, X.same, plain))).drop("__forms", "__ascii")


def _is_header(low: Column, as_name: Column, hints: Sequence[str]) -> Column:
    full = F.filter(F.sequence(F.lit(1), F.size(low)), lambda i: ~C.is_empty(F.element_at(low, i)))
    full = F.when(F.size(low) > 0, full).otherwise(F.array().cast("array<int>"))

    def own(i: Column) -> Column:
        c = F.element_at(as_name, i)
        words = F.filter(c["vals"], lambda v: X.strip(v["value"]) != "")
        return X.is_semantic_name(c["name"]) & (F.size(words) > 0) & F.forall(words, lambda v: v["value"] == c["name"])

    found = F.exists(full, own)
    if hints:
        found = found | F.exists(full, lambda i: F.exists(F.element_at(as_name, i)["vals"], lambda v: v["value"].isin(*hints)))
    return found


def filter_header_rows(rows: DataFrame, hints: Sequence[str] = ()) -> DataFrame:
    """Without rows where a named column holds its own name, or any column a hint."""
    return _plain(rows).where(~_is_header(F.col("__low"), F.col("__as"), hints)).select(*rows.columns)


def strip_leading_numbers(rows: DataFrame, by: Sequence[str], samples: int = 5) -> DataFrame:
    """Drops ``1. `` and the like from columns whose first non-empty values count upwards."""
    one = rows.select(*by, "pos", F.explode("cells").alias("c")).where(~C.is_empty(F.col("c"))).withColumn("t", C.first_text(F.col("c"))).where("t != ''").withColumn("name", F.col("c.name"))
    w = Window.partitionBy(*by, "name").orderBy("pos")
    one = one.withColumn("k", F.row_number().over(w)).where(f"k <= {samples}").withColumn("n", F.when(F.col("t").rlike(LEADING), F.regexp_extract("t", LEADING, 1).cast("decimal(38,0)")))
    one = one.withColumn("up", F.col("n").isNotNull() & ((F.col("k") == 1) | F.coalesce(F.col("n") > F.lag("n").over(w), F.lit(False))))
    chosen = one.groupBy(*by, "name").agg(F.count("*").alias("k"), F.bool_and("up").alias("up")).where("k >= 2 and up").groupBy(*by).agg(F.collect_set("name").alias("__strip"))
    out = rows.join(chosen, list(by), "left")
    new = F.transform("cells", lambda c: F.when(F.array_contains("__strip", c["name"]), C.mapped(c, lambda v: F.regexp_replace(v, LEADING, ""))).otherwise(c))
    return out.withColumn("cells", F.when(F.col("__strip").isNull(), F.col("cells")).otherwise(new)).select(*rows.columns)


def normalize_punctuation(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cells", C.map_values(F.col("cells"), X.normalize_punctuation))


def reverse_values(rows: DataFrame, by: Sequence[str], vocabulary: DataFrame) -> DataFrame:
    """Reverses all strings of a fragment if more known words (``word``, in lower case) are in them then."""
    words = rows.select(*by, F.explode(C.strings(F.col("cells"))).alias("v")).where(F.length("v") > 2)
    both = words.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("v")), F.struct(F.lit(1).alias("back"), F.reverse("v").alias("v")))).alias("x"))
    both = both.select(*by, "x.back", F.explode(F.split(F.lower(X.strip(F.col("x.v"))), X.BLANKS)).alias("word"))
    hits = both.join(vocabulary.select("word").distinct(), "word").groupBy(*by).agg((F.sum(F.when(F.col("back") == 1, 1).otherwise(-1)) > 0).alias("__back"))
    out = rows.join(hits, list(by), "left")
    return out.withColumn("cells", F.when(F.coalesce("__back", F.lit(False)), C.map_values(F.col("cells"), F.reverse)).otherwise(F.col("cells"))).select(*rows.columns)


Embedder = Callable[[list[str]], np.ndarray]


def ngram_embedder(texts: list[str], dims: int = 512, n: int = 3) -> np.ndarray:
    """Unit vectors of hashed character n-grams: a stand-in, the same everywhere, for word vectors."""
    import zlib

    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for k in range(max(1, len(t) - n + 1)):
            out[i, zlib.crc32(t[k : k + n].encode()) % dims] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def best_split(value: str, left: str, right: str, embed: Embedder) -> tuple[str, str]:
    """The parts of ``value`` at the word boundary where they are most like their headers, the earliest of equals."""
    words = value.split()
    if len(words) <= 1:
        return value, ""
    parts = [" ".join(words[:i]) for i in range(1, len(words))] + [" ".join(words[i:]) for i in range(1, len(words))]
    v = embed([left.replace("_", " "), right.replace("_", " "), *parts])
    half = len(words) - 1
    at = int((v[2 : 2 + half] @ v[0] + v[2 + half :] @ v[1]).round(12).argmax())
    return parts[at], parts[half + at]


def split_conjunction_columns(rows: DataFrame, key: Sequence[str], language: str = "en", embed: Embedder = ngram_embedder) -> DataFrame:
    """Columns named a_and_b as two, each value split in two; ``key`` tells rows apart."""

    @F.pandas_udf(PAIR)
    def split(values: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else best_split(v, a, b, embed) for v, a, b in zip(values, left, right)], columns=["left", "right"])

    one = rows.select(*key, F.posexplode("cells").alias("i", "c")).withColumn("h", X.conjunction_split(F.col("c.name"), language))
    vals = one.select(*key, "i", "c", "h", F.posexplode_outer("c.vals").alias("j", "v"))
    vals = vals.withColumn("p", split(F.when(F.col("h").isNotNull(), F.col("v.value")), F.col("h.left"), F.col("h.right")))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("j").isNotNull(), F.struct("j", X.split_part(F.col(f"p.{s}")).alias("value"), F.col("v.agreement_level").alias("agreement_level"))))), lambda x: F.struct(x["value"].alias("value"), x["agreement_level"].alias("agreement_level")))
    again = vals.groupBy(*key, "i").agg(F.first("c").alias("c"), F.first("h").alias("h"), side("left").alias("l"), side("right").alias("r"))
    cell = lambda s, v: F.struct(F.col(f"h.{s}").alias("name"), F.col("c.kind").alias("kind"), F.col(v).alias("vals"))
    again = again.withColumn("cs", F.when(F.col("h").isNull(), F.array("c")).otherwise(F.array(cell("left", "l"), cell("right", "r"))))
    new = again.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "cs"))).alias("__x"))
    out = rows.join(new, list(key), "left")
    return out.withColumn("cells", F.coalesce(F.flatten(F.transform("__x", lambda x: x["cs"])), F.col("cells"))).select(*rows.columns)
