"""Writers: table files, result-set metadata, CSV, statistics and settings."""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid as uuid_
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.operators.post import ordered_columns
from tabweave.sources import storage
from tabweave.sources.tables import METADATA, SUFFIX


def nested(tables: DataFrame, fragments: DataFrame, rows: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """(paper, doc): each paper's tables as one JSON text, in order; rows keep the order of their columns."""
    value = lambda c: F.when(c["kind"] == "null", F.lit("null")).when(c["kind"] == "list", F.to_json(c["vals"])).otherwise(_quoted(F.try_element_at(c["vals"], F.lit(1))["value"]))
    fields = F.transform("cells", lambda c: F.concat(_quoted(c["name"]), F.lit(":"), value(c)))
    own = [F.concat(F.lit(f'"{n}":'), F.coalesce(F.to_json(F.col(n)) if n == "sources_" else F.col(n).cast("string"), F.lit("null"))) for n in ("agreement_level_", "sources_", "row_")]
    row = F.concat(F.lit("{"), F.array_join(F.concat(fields, F.array(*own)), ","), F.lit("}"))
    key = ["paper", "table_idx", "fragment_idx"]
    packed = rows.select(*key, F.struct("pos", row.alias("j")).alias("x")).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ",").alias("rows"))
    frags = fragments.select(*key, "page").join(packed, key, "left").withColumn("j", F.concat(F.lit('{"rows":['), F.coalesce("rows", F.lit("")), F.lit('],"page":'), F.col("page").cast("string"), F.lit("}")))
    per = frags.groupBy("paper", "table_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fragment_idx", "j"))), lambda x: x["j"]), ",").alias("f"))
    full = tables.select("paper", "table_idx").distinct().join(per, ["paper", "table_idx"], "left").withColumn("j", F.concat(F.lit('{"table_fragments":['), F.coalesce("f", F.lit("")), F.lit("]}")))
    docs = full.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "j"))), lambda x: x["j"]), ",").alias("t"))
    if citations is not None:
        docs = citations.select("paper", "citation").join(docs, "paper", "left").withColumn("c", F.coalesce(_quoted(F.col("citation")), F.lit("null")))
    else:
        docs = docs.withColumn("c", F.lit("null"))
    return docs.select("paper", F.concat(F.lit('{"tables":['), F.coalesce("t", F.lit("")), F.lit('],"citation":'), F.col("c"), F.lit("}")).alias("doc"))


def _quoted(c):
    return F.expr("to_json(array(x))") if c is None else F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def write_papers(docs: DataFrame, out: str, pretty: bool = False) -> int:
    """One file for each paper, written where its row is; how many. ``out`` must be a folder that all machines share."""
    storage.make_folder(out)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for paper, doc in zip(b.paper, b.doc):
                storage.write_text(f"{out}/{paper}{SUFFIX}", json.dumps(json.loads(doc), ensure_ascii=False, indent=2 if pretty else None))
            yield pd.DataFrame({"n": [len(b)]})

    return docs.select("paper", "doc").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_merge_metadata(out: str, sources: Sequence[tuple[str, Mapping]], settings: Mapping | None = None, **extra) -> dict:
    """What was merged, when, under a new uuid."""
    meta = {"reader": "merge", "uuid": str(uuid_.uuid4()), "datetime": datetime.now(timezone.utc).isoformat(), "sources": [{"path": p, **{k: m[k] for k in ("uuid", "reader") if m.get(k)}} for p, m in sources], **extra}
    if settings:
        meta["settings"] = dict(settings)
    write_json(f"{out}/{METADATA}", meta)
    return meta


def write_json(path: str, value, pretty: bool = True) -> None:
    storage.write_text(path, json.dumps(value, ensure_ascii=False, indent=2 if pretty else None))


def write_stdout(docs: DataFrame) -> None:
    """A line of JSON for each paper."""
    for r in docs.orderBy("paper").toLocalIterator():
        sys.stdout.write(r.doc + "\n")


def write_resultset(docs: DataFrame, out: str, reader: str, resultset: str | None = None) -> str:
    """A new result set under ``out``: its papers and, once, its metadata; the folder."""
    name = resultset or str(uuid_.uuid4())
    folder = f"{out}/{name}"
    write_papers(docs, folder)
    if not storage.exists(f"{folder}/{METADATA}"):
        write_json(f"{folder}/{METADATA}", {"reader": reader, "uuid": name, "datetime": datetime.now(timezone.utc).isoformat()})
    return folder


def flatten(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows as a flat table: a column for each name, null where a row has none; list cells are joined."""
    cols = [C.display(C.get(F.col("cells"), n)).alias(n) if n not in by else C.display(C.get(F.col("cells"), n)).alias(f"{n}_") for n in names]
    return rows.select(*by, *cols)


def csv_rows(rows: DataFrame) -> DataFrame:
    """(paper, table_idx, pos, names, vals): each row under all columns of its table, by first appearance, and ``$page``.

    A row's values are strings, empty where it has no such column; list cells are joined.
    """
    key = ["paper", "table_idx"]
    seq = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("fragment_idx", "pos")))
    columns = ordered_columns(seq, key).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("column_pos", "name"))), lambda x: x["name"]).alias("names"))
    one = F.transform("names", lambda n: F.coalesce(C.display(C.get(F.col("cells"), n)), F.lit("")))
    return seq.join(columns, key).select(*key, "pos", F.concat("names", F.array(F.lit("$page"))).alias("names"), F.concat(one, F.array(F.col("page").cast("string"))).alias("vals"))


def write_csv(rows: DataFrame, out: str) -> list[str]:
    """<paper>_<table>.csv for each table, all in one job: a task writes its tables row by row as they come sorted."""
    storage.make_folder(out)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, text, done = None, io.StringIO(), []

        def end() -> None:
            if now is not None:
                path = f"{out}/{now[0]}_{now[1]}.csv"
                storage.write_text(path, text.getvalue())
                done.append(path)

        for b in batches:
            for paper, k, names, vals in zip(b.paper, b.table_idx, b.names, b.vals):
                if (paper, k) != now:
                    end()
                    now, text = (paper, k), io.StringIO()
                    csv.writer(text).writerow(names)
                csv.writer(text).writerow(["" if v is None else v for v in vals])
        end()
        yield pd.DataFrame({"path": done}, dtype=str)

    sorted_ = csv_rows(rows).repartition("paper", "table_idx").sortWithinPartitions("paper", "table_idx", "pos")
    return sorted(r.path for r in sorted_.mapInPandas(write, "path string").toLocalIterator())
