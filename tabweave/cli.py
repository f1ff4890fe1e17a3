"""Command line: ``python -m tabweave.cli COMMAND ...`` for merging, statistics, validation, CSV, HTML, extraction and file names."""

from __future__ import annotations

import argparse
import hashlib
import os
import re
import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions.names import parse_hints
from tabweave.operators import stats, validate, viewer
from tabweave.operators.dedupe import settled_names
from tabweave.plans.merging import merge_directories
from tabweave.plans.settings import MergeSettings
from tabweave.session import ship, store
from tabweave.sources import documents, sinks, storage, tables

TEXTS = ("column_aliases", "column_names_hints", "paper_aliases", "schema")
CHOICES = {"agreement_method": ("simple-count", "distinct-readers"), "hints_column_alignment": ("safe", "unsafe"), "transform_tablesfile": ("explode", "safe-compact", "unsafe-compact"), "semantic_language": ("en", "es")}


def session() -> SparkSession:
    """The running session, or one with what spark-submit or the environment say."""
    spark = SparkSession.builder.appName("tabweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def _flag(name: str) -> str:
    return "--" + name.replace("_", "-")


def merge_parser() -> argparse.ArgumentParser:
    """A flag for each setting; those on by default have a --no- form. Texts come inline or, with -path, from a file."""
    p = argparse.ArgumentParser(prog="merge", argument_default=argparse.SUPPRESS)
    p.add_argument("paths", nargs="*")
    p.add_argument("-o", "--output-directory", default=None)
    for f in fields(MergeSettings):
        if f.name == "paths":
            continue
        if f.name in TEXTS:
            p.add_argument(_flag(f.name), dest=f.name)
            p.add_argument(*(["-p"] if f.name == "schema" else []), _flag(f.name) + "-path", dest=f.name + "_path")
        elif isinstance(f.default, bool):
            p.add_argument(("--no-" if f.default else "--") + f.name.replace("_", "-"), dest=f.name, action="store_false" if f.default else "store_true")
        else:
            p.add_argument(_flag(f.name), dest=f.name, choices=CHOICES.get(f.name), type=float if f.name.endswith("threshold") else str)
    p.add_argument("--paper", default=None, help="only papers whose whole name is what this pattern describes")
    p.add_argument("--metadata-only", action="store_true", default=False)
    p.add_argument("--force-update", action="store_true", default=False, help="also papers whose output somebody has curated")
    p.add_argument("--settings", default=None)
    p.add_argument("--export-settings", default=None)
    p.add_argument("--vocabulary", default=None, help="a file of known words, one a line, for --fix-reversed-column-values")
    p.add_argument("-j", "--workers", default=None, help="accepted and ignored: the cluster decides")
    return p


def merge_settings(args: argparse.Namespace) -> MergeSettings:
    """The file's settings, with what the command line says over them; a text's file goes before its inline form."""
    base = MergeSettings.read(args.settings).to_dict() if args.settings else {}
    given = {k: v for k, v in vars(args).items() if k in {f.name for f in fields(MergeSettings)} and not (k == "paths" and not v)}
    for t in TEXTS:
        if path := getattr(args, t + "_path", None):
            given[t] = tables.read_path(path)
    return MergeSettings.from_dict({**base, **given})


def merge(argv: Sequence[str]) -> int:
    args = merge_parser().parse_args(argv)
    s = merge_settings(args)
    try:
        s.check()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if args.export_settings:
        s.write(args.export_settings)
    spark = session()
    words = spark.read.text(args.vocabulary).select(F.lower(F.trim("value")).alias("word")) if args.vocabulary else None
    docs = merge_directories(spark, s, args.output_directory, args.paper, args.metadata_only, args.force_update, words)
    if docs is not None and not args.output_directory:
        sinks.write_stdout(docs)
    return 0


def statistics(argv: Sequence[str]) -> int:
    p = argparse.ArgumentParser(prog="stats")
    p.add_argument("path")
    p.add_argument("-o", "--out")
    p.add_argument("-s", "--sort", choices=("none", "asc", "desc"), default="none")
    p.add_argument("-e", "--empty", action="store_true")
    p.add_argument("-C", "--columns", action="store_true")
    args = p.parse_args(argv)
    found = tables.read_resultsets(session(), [args.path])
    key = ["paper", "table_idx"]
    rows = found.rows.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("fragment_idx", "pos")))
    per = stats.paper_stats(found.files, found.tables, found.fragments, rows)
    if args.empty:
        for r in stats.empty_papers(per).orderBy("pdf").toLocalIterator():
            print(r.pdf)
        return 0
    total = stats.global_stats(per).first().asDict()
    papers = [r.asDict() for r in stats.sorted_stats(per, args.sort).toLocalIterator()]
    columns = {r.name: r.type for r in stats.unique_columns(found.rows, key).collect()} if args.columns else None
    if args.out:
        sinks.write_json(args.out, {"global": total, "papers": papers, **({"columns": columns} if columns is not None else {})})
    else:
        print(stats.format_stats(total, papers, columns))
    return 0


def validation(argv: Sequence[str]) -> int:
    """Ends at the first bad file with 1; with -a tells of all and ends with 0; with -q tells nothing."""
    p = argparse.ArgumentParser(prog="validate")
    p.add_argument("paths", nargs="+")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-a", "--all", action="store_true")
    args = p.parse_args(argv)
    paths = [x for x in args.paths if Path(x).name != tables.METADATA and not Path(x).name.startswith("settings.")]
    there = [x for x in paths if storage.exists(x)]
    spark = session()
    bad = {x: ("not found", []) for x in paths if x not in there}
    if there:
        files = spark.read.text([storage.absolute(x) for x in there], wholetext=True).select(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")).alias("path"), F.col("value").alias("text"))
        by = {storage.absolute(x): x for x in there}
        bad |= {by[r.path]: (r.error, list(r.problems)) for r in validate.validate_files(files).where("error is not null").collect()}
    for x in paths:
        if x in bad:
            if not args.quiet:
                print(f"{x}: {bad[x][0]}", *bad[x][1], sep="\n  ")
            if not args.all:
                return 1
        elif args.all and not args.quiet:
            print(f"{x}: ok")
    return 0


def to_csv(argv: Sequence[str]) -> int:
    p = argparse.ArgumentParser(prog="csv")
    p.add_argument("path")
    p.add_argument("-o", "--out", required=True)
    args = p.parse_args(argv)
    for x in sinks.write_csv(tables.read_resultsets(session(), [args.path]).rows, args.out):
        print(x)
    return 0


def to_html(argv: Sequence[str]) -> int:
    p = argparse.ArgumentParser(prog="html")
    p.add_argument("path")
    p.add_argument("--out", required=True)
    args = p.parse_args(argv)
    found = tables.read_resultsets(session(), [args.path])
    meta, settings = tables.read_with_settings(args.path)
    papers = [(r.paper, r.c) for r in found.files.select("paper", C.display(F.col("citation")).alias("c")).orderBy("paper").collect()]
    storage.write_text(args.out, viewer.build_html(found.fragments, found.rows, papers, meta, settings))
    return 0


def extraction(argv: Sequence[str]) -> int:
    p = argparse.ArgumentParser(prog="extract")
    p.add_argument("paths", nargs="+", help="documents, or path:from:to")
    p.add_argument("-o", "--out", required=True, help="folder of result sets")
    p.add_argument("--reader", choices=sorted(documents.READERS), required=True)
    p.add_argument("--hints-path")
    p.add_argument("--mapping-path")
    p.add_argument("--append", help="an existing result set's name: documents that it has are left out")
    args = p.parse_args(argv)
    spark = session()
    files = documents.read_files(spark, args.paths)
    if args.append:
        folder = f"{args.out}/{args.append}"
        if tables.read_resultset_metadata(folder).get("reader", args.reader) != args.reader:
            print("the result set was made by another reader", file=sys.stderr)
            return 2
        have = spark.createDataFrame([(x[: -len(tables.SUFFIX)],) for x in storage.names(folder, "*" + tables.SUFFIX)], "paper string")
        files = documents.unread(files.withColumn("paper", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)), have).drop("paper")
    hints = parse_hints(tables.read_path(args.hints_path)) if args.hints_path else []
    mapping = documents.TableMapping.parse(tables.read_path(args.mapping_path)) if args.mapping_path else None
    read = documents.read_tables(files, documents.READERS[args.reader], hints, mapping)
    read = store(read)  # documents are opened once
    for r in read.where("error is not null").select("path", "error").toLocalIterator():
        print(f"{r.path}: {r.error}", file=sys.stderr)
    rows = read.where("error is null").withColumn("paper", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)).withColumn("fragment_idx", F.lit(0))
    cells = F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: C.text_cell(F.element_at("names", k), F.try_element_at("vals", k)))
    rows = rows.withColumn("cells", cells).withColumns({"row_": F.lit(None).cast("int"), "agreement_level_": F.lit(None).cast("int"), "sources_": F.lit(None).cast("array<string>")})
    places = rows.select("paper", "table_idx", "fragment_idx", "page").distinct()
    print(sinks.write_resultset(sinks.nested(places.select("paper", "table_idx"), places, rows), args.out, args.reader, args.append))
    return 0


def normal_name(name: str) -> str:
    """Lower-case ASCII with underscores, and its extension."""
    base, dot, end = name.rpartition(".") if "." in name[1:] else (name, "", "")
    base = unicodedata.normalize("NFKD", base).encode("ascii", "ignore").decode().lower()
    return re.sub("_+", "_", re.sub("[^a-z0-9_-]", "_", base)).strip("_") + dot + end.lower()


def file_names(argv: Sequence[str]) -> int:
    """Renames and removes files of this machine's folder, so it is done here and not by Spark."""
    p = argparse.ArgumentParser(prog="names")
    p.add_argument("folder")
    p.add_argument("-y", "--yes", action="store_true", help="do it without asking")
    p.add_argument("-q", "--quiet", action="store_true")
    args = p.parse_args(argv)
    by: dict[str, list[Path]] = {}
    for f in sorted(x for x in Path(args.folder).iterdir() if x.is_file()):
        with f.open("rb") as h:
            by.setdefault(hashlib.file_digest(h, "md5").hexdigest(), []).append(f)
    keep = [min(fs, key=lambda f: (f.name != normal_name(f.name), len(f.name))) for fs in by.values()]
    keep.sort()
    plan = [("remove", f, None) for fs in by.values() for f in fs if f not in keep]
    plan += [("rename", f, f.with_name(n)) for f, n in zip(keep, settled_names([normal_name(f.name) for f in keep])) if n != f.name]
    for what, a, b in plan:
        if not args.quiet:
            print(what, a.name, *([b.name] if b else []))
    if plan and (args.yes or input("Go on? [y/N] ").strip().lower() == "y"):
        moved = []
        for what, a, b in plan:
            if what == "remove":
                a.unlink()
            else:
                part = a.with_name(f".{hashlib.md5(a.name.encode()).hexdigest()}.part")
                os.rename(a, part)  # in two steps: names may be swapped
                moved.append((part, b))
        for part, b in moved:
            os.rename(part, b)
    return 0


COMMANDS = {"merge": merge, "stats": statistics, "validate": validation, "csv": to_csv, "html": to_html, "extract": extraction, "names": file_names}


def main(argv: Sequence[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in COMMANDS:
        print(f"usage: python -m tabweave.cli {{{','.join(COMMANDS)}}} ...", file=sys.stderr)
        return 2
    return COMMANDS[argv[0]](argv[1:])


if __name__ == "__main__":
    sys.exit(main())
