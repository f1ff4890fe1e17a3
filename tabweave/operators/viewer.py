"""A result set as a page to look at. All text is escaped."""

from __future__ import annotations

from collections.abc import Mapping
from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.operators.merge import agreement_bucket
from tabweave.operators.post import common_columns
from tabweave.operators.shape import rowspans

CLASSIC = ("pdfplumber", "camelot", "pymupdf")
CSS = ".low{background:#fdd}.medium{background:#ffd}.high{background:#dfd}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px}"


def flat(data: Mapping, prefix: str = "") -> list[tuple[str, str]]:
    """Nested settings as (dotted key, text); lists are joined."""
    out: list[tuple[str, str]] = []
    for k, v in data.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, Mapping):
            out += flat(v, key)
        else:
            out.append((key, ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)))
    return out


def metadata_pairs(meta: Mapping) -> list[tuple[str, str]]:
    return [p for k, v in meta.items() if k not in ("sources", "settings", "agreement_method") for p in (flat(v) if isinstance(v, Mapping) else flat({k: v}))]


def reader_mark(reader: str | None) -> str:
    return "" if not reader else "💻" if reader in CLASSIC else "☯️" if reader.startswith("hybrid-") else "🤖"


def source_keys(sources: list[Mapping]) -> list[str]:
    """uuid, reader and path first, the rest by name."""
    keys, first = {k for s in sources for k in s}, ["uuid", "reader", "path"]
    return [k for k in first if k in keys] + sorted(keys - set(first))


def source_cell(source: Mapping, key: str) -> str:
    mark = reader_mark(source.get("reader")) if key == "uuid" else ""
    return f"{mark} {source.get(key, '')}".strip()


def readers_of(rows: DataFrame, readers: DataFrame, key: list[str]) -> DataFrame:
    """``readers_``: names of the readers of a row's sources, each once, in order."""
    one = rows.select(*key, F.posexplode("sources_").alias("i", "uuid")).join(readers.select("uuid", "reader"), "uuid").where("reader is not null")
    names = one.groupBy(*key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "reader"))), lambda x: x["reader"])).alias("readers_"))
    return rows.join(names, key, "left")


def paper_sources(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """The sources (uuid, ...) that a paper's rows name: (paper, ...)."""
    used = rows.select("paper", F.explode("sources_").alias("uuid")).distinct()
    return used.join(sources, "uuid")


def display_cells(rows: DataFrame, fragment: list[str]) -> DataFrame:
    """(fragment, pos, column_pos, name, value, rowspan, level): every cell to be shown."""
    cols = common_columns(rows, fragment)
    one = rows.select(*fragment, "pos", "row_", F.coalesce("agreement_level_", F.lit(1)).alias("level"), "cells").join(cols, fragment)
    one = one.withColumn("value", F.coalesce(C.display(C.get(F.col("cells"), F.col("name"))), F.lit("")))
    spans = rowspans(one.drop("cells"), [*fragment, "name"], ["pos"], "row_", "value")
    return spans.withColumn("level", agreement_bucket(F.col("level"))).select(*fragment, "pos", "column_pos", "name", "value", "rowspan", "level")


def fragment_tables(rows: DataFrame) -> DataFrame:
    """(paper, table_idx, fragment_idx, page, html): each fragment as an HTML table, put together where its rows are."""
    key = ["paper", "table_idx", "fragment_idx", "page"]
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    shown = display_cells(rows, key)
    td = F.when(F.col("rowspan") == 0, F.lit("")).otherwise(F.concat(F.lit("<td"), F.when(F.col("rowspan") > 1, F.concat(F.lit(' rowspan="'), F.col("rowspan").cast("string"), F.lit('"'))).otherwise(F.lit("")), F.lit(">"), safe(F.col("value")), F.lit("</td>")))
    line = shown.withColumn("td", td).groupBy(*key, "pos", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_pos", "td"))), lambda x: x["td"]), "").alias("tds"))
    line = line.withColumn("tr", F.concat(F.lit('<tr class="'), F.col("level"), F.lit('">'), F.col("tds"), F.lit("</tr>")))
    body = line.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tr"))), lambda x: x["tr"]), "\n").alias("body"))
    head = shown.select(*key, "column_pos", "name").distinct().groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_pos", "name"))), lambda x: F.concat(F.lit("<th>"), safe(x["name"]), F.lit("</th>"))), "").alias("head"))
    return body.join(head, key).select(*key, F.concat(F.lit("<table><tr>"), F.col("head"), F.lit("</tr>\n"), F.col("body"), F.lit("</table>")).alias("html"))


def build_html(fragments: DataFrame, rows: DataFrame, papers: list[tuple[str, str]], metadata: Mapping, settings: Mapping) -> str:
    """The whole report; ``papers``: (name, citation) in order."""
    key = ["paper", "table_idx", "fragment_idx", "page"]
    tables = fragments.select(*key).join(fragment_tables(rows), key, "left")
    by: dict[str, list] = {}
    for r in tables.withColumn("n", F.dense_rank().over(Window.partitionBy("paper").orderBy("table_idx"))).orderBy("paper", "table_idx", "fragment_idx").toLocalIterator():
        by.setdefault(r.paper, []).append(r)
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><style>{CSS}</style></head><body>", '<nav id="toc"><b>Contents</b><ul>']
    anchor = lambda k, r: f"paper-{k}-table-{r.n}-page-{r.page}"
    for k, (name, _) in enumerate(papers):
        inner = "".join(f'<li><a href="#{anchor(k, r)}">Table {r.n}, p.&nbsp;{r.page}</a></li>' for r in by.get(name, []))
        out.append(f'<li><a href="#paper-{k}">{escape(name)}</a>' + (f"<ul>{inner}</ul>" if inner else "") + "</li>")
    out.append("</ul></nav>")
    for title, pairs in (("Metadata", metadata_pairs(metadata)), ("Settings", flat(settings))):
        if pairs:
            out.append(f"<h2>{title}</h2><table>" + "".join(f"<tr><th>{escape(a)}</th><td>{escape(b).replace(chr(10), '<br>')}</td></tr>" for a, b in pairs) + "</table>")
    if sources := list(metadata.get("sources") or []):
        keys = source_keys(sources)
        out.append("<h3>Sources</h3><table><tr>" + "".join(f"<th>{escape(k)}</th>" for k in keys) + "</tr>" + "".join("<tr>" + "".join(f"<td>{escape(source_cell(s, k))}</td>" for k in keys) + "</tr>" for s in sources) + "</table>")
    for k, (name, citation) in enumerate(papers):
        out.append(f'<h2 id="paper-{k}">{escape(name)}</h2><p>{escape(citation or "")}</p>')
        out += [f'<h3 id="{anchor(k, r)}">Table {r.n}, p.&nbsp;{r.page}</h3>{r.html or ""}' for r in by.get(name, [])]
    return "\n".join([*out, "</body></html>"])
