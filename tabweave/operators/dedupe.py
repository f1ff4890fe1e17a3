"""Which of equal files to keep, and names for those that stay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, content: Column, preference: list[Column]) -> DataFrame:
    """``digest``, ``keep``: of rows with equal content the first by preference stays."""
    df = df.withColumn("digest", F.md5(content))
    return df.withColumn("keep", F.row_number().over(Window.partitionBy("digest").orderBy(*preference)) == 1)


def dedupe_files(files: DataFrame, normal: Column) -> DataFrame:
    """``files`` (name, content, pos): a name that is normal already is preferred, then the shorter one, then the first."""
    return dedupe(files, F.col("content"), [F.when(F.col("name") == normal, 0).otherwise(1), F.length("name"), F.col("pos")])


def settled_names(names: list[str]) -> list[str]:
    """Unlike names for names in their order: a repeated one gets _1, _2, ... before its extension, the first that is free."""
    taken: set[str] = set()
    tried: dict[str, int] = {}
    out = []
    for n in names:
        base, dot, end = n.rpartition(".") if "." in n else (n, "", "")
        new, k = n, tried.get(n, 0)
        while new in taken:
            k += 1
            new = f"{base}_{k}{dot}{end}"
        tried[n] = k
        taken.add(new)
        out.append(new)
    return out


def resolve_names(df: DataFrame, name: str = "candidate", order: str = "pos") -> DataFrame:
    """``final_name``: unlike names for all rows; the first of a name keeps it, others get _1, _2, ... before the extension.

    A name so made may be another row's own. Names can only be mixed up within one stem without such endings. Where
    all names of a stem are one, numbering the rows is enough; the other stems are settled each by itself, in order.
    """
    stem = F.regexp_replace(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), r"(_\d+)+$", "")
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    per = Window.partitionBy("__stem", "__ext")
    df = df.withColumns({"__stem": stem, "__ext": ext})
    df = df.withColumns({"__one": F.min(name).over(per) == F.max(name).over(per), "__n": F.row_number().over(per.orderBy(order)) - 1})
    columns = [c for c in df.columns if not c.startswith("__")]
    base = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    new = F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(base, F.lit("_"), F.col("__n").cast("string"), F.col("__ext")))
    plain = df.where("__one").select(*columns, new.alias("final_name"))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        return group.assign(final_name=settled_names(group[name].tolist()))[[*columns, "final_name"]]

    mixed = df.where("not __one").groupBy("__stem", "__ext").applyInPandas(settle, kinds + ", final_name string")
    return plain.unionByName(mixed)
