"""Whether files of tables keep to their format."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def problems(text: str | None, strict: bool = False) -> list[str]:
    """What is wrong with a file's text, empty if nothing is. ``strict``: numbers and booleans are no cells."""
    try:
        doc = json.loads(text or "")
    except ValueError as e:
        return [f"malformed: {e}"]
    out: list[str] = []

    def need(ok: bool, what: str) -> bool:
        if not ok:
            out.append(what)
        return ok

    def cell(v: Any, at: str) -> None:
        if isinstance(v, list):
            for x in v:
                need(isinstance(x, dict) and isinstance(x.get("value"), str) and type(x.get("agreement_level")) is int, f"{at}: not a list of values with agreement levels")
        else:
            need(v is None or isinstance(v, str) or (not strict and isinstance(v, (int, float))), f"{at}: not a cell")

    def fragment(f: Any, at: str) -> None:
        if not need(isinstance(f, dict) and isinstance(f.get("rows"), list), f"{at}: no rows") or not need(type(f.get("page")) is int, f"{at}: no page"):
            return
        for k, row in enumerate(f["rows"]):
            if need(isinstance(row, dict), f"{at}: row {k} is no object"):
                for name, v in row.items():
                    if name in ("agreement_level_", "row_"):
                        need(v is None or type(v) is int, f"{at}: row {k}: {name} is no integer")
                    elif name == "sources_":
                        need(v is None or (isinstance(v, list) and all(isinstance(x, str) for x in v)), f"{at}: row {k}: sources_ is no list of strings")
                    else:
                        cell(v, f"{at}: row {k}: {name}")

    if not need(isinstance(doc, dict), "no object"):
        return out
    if need("citation" in doc, "no citation"):
        cell(doc["citation"], "citation")
    meta = doc.get("metadata")
    if meta is not None and need(isinstance(meta, dict) and "filename" in meta, "metadata without filename"):
        for c in meta.get("curations") or []:
            need(isinstance(c, dict) and isinstance(c.get("curator"), str) and set(c) <= {"curator", "description", "timestamp"}, "not a curation")
    if need(isinstance(doc.get("tables"), list), "no tables"):
        for k, t in enumerate(doc["tables"]):
            if isinstance(t, dict) and isinstance(t.get("table_fragments"), list):
                for j, f in enumerate(t["table_fragments"]):
                    fragment(f, f"table {k}: fragment {j}")
            else:
                fragment(t, f"table {k}")
    return out


def validate_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """``files`` (path, text) with ``error`` (malformed, invalid or null) and ``problems``."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: problems(t, strict))

    out = files.withColumn("problems", run("text"))
    return out.withColumn("error", error_label(F.col("problems")))


def error_label(found: Column) -> Column:
    return F.when(F.size(found) == 0, F.lit(None)).when(F.element_at(found, 1).startswith("malformed"), "malformed").otherwise("invalid")


def validate_rules(df: DataFrame, **rules: Column) -> DataFrame:
    """``error``: the first rule that a row breaks, null if it keeps to all."""
    error = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        error = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(error)
    return df.withColumn("error", error)
