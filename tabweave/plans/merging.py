"""The whole merge of result sets, from folders to merged tables, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions import text as X
from tabweave.functions.names import ColumnSchema, parse_column_aliases, parse_hints, parse_paper_aliases
from tabweave.operators import align, clean, merge, post, shape
from tabweave.plans.settings import MergeSettings
from tabweave.session import ship, store
from tabweave.sources import sinks
from tabweave.sources.tables import SETTINGS, ResultSets, curated_papers, read_resultset_metadata, read_resultsets

FRAGMENT = ["paper", "source_ord", "table_idx", "fragment_idx"]
FILE = ["paper", "source_ord"]


def load(found: ResultSets, s: MergeSettings, vocabulary: DataFrame | None = None) -> ResultSets:
    """Rows as each source has them, cleaned and under their best-known names."""
    rows, fragments, tables = found.rows, found.fragments, found.tables
    hints = parse_hints(s.column_names_hints) if s.column_names_hints else []
    schema = ColumnSchema.parse(s.schema) if s.schema else None
    if s.fix_reversed_column_values:
        if vocabulary is None:
            raise ValueError("fix_reversed_column_values needs a vocabulary")
        rows = clean.reverse_values(rows, FRAGMENT, vocabulary)
    if s.filter_title_rows:
        rows = clean.filter_title_rows(rows, FRAGMENT)
    if s.strip_leading_row_numbers:
        rows = clean.strip_leading_numbers(rows, FRAGMENT)
    if s.normalize_punctuation:
        rows = clean.normalize_punctuation(rows)
    if s.split_conjunction_columns:
        rows = clean.split_conjunction_columns(rows, [*FRAGMENT, "pos"], s.semantic_language)
    rows = clean.filter_empty_rows(rows)
    if s.transform_tablesfile == "explode":
        places = shape.explode_fragments(fragments.withColumn("t", F.col("table_idx")).withColumn("f", F.col("fragment_idx")), FILE)
        back = places.select(*FILE, F.col("t").alias("table_idx"), F.col("f").alias("fragment_idx"), F.col("table_idx").alias("t2"))
        rows = rows.join(back, FRAGMENT).withColumn("table_idx", F.col("t2")).withColumn("fragment_idx", F.lit(0)).select(*rows.columns)
        fragments = places.select(*fragments.columns)
        tables = fragments.select(*FILE, "table_idx")
    elif s.transform_tablesfile:
        tables, fragments, rows = shape.compact_fragments(tables, fragments, rows, FILE, s.transform_tablesfile == "safe-compact")
    rows = align.normalize_column_names(rows)
    if s.hints_column_alignment:
        rows = align.apply_mapping(rows, align.hints_mapping(rows, FRAGMENT, hints, s.hints_column_alignment == "safe"), FRAGMENT)
    if s.column_aliases:
        rows = align.alias_columns(rows, parse_column_aliases(s.column_aliases))
    if s.column_name_semantic_alignment and schema:
        found_ = align.semantic_mapping(rows, FRAGMENT, schema.names, s.column_alignment_threshold)
        rows = align.apply_mapping(rows, found_.select(*FRAGMENT, "source", "target"), FRAGMENT)
    if s.remove_header_rows:
        rows = clean.filter_header_rows(rows, hints)
    return ResultSets(found.files, tables, fragments, rows)


def merged(found: ResultSets, s: MergeSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, fragments, rows) of all papers that any source has a table of."""
    schema = ColumnSchema.parse(s.schema) if s.schema else None
    rows = found.rows
    if s.jaccard_column_alignment or s.column_value_semantic_alignment:
        source = ["paper", "source_ord", "table_idx"]
        placed = merge.fragment_clusters(found.fragments.join(found.files.select(*FILE, "page_offset"), FILE), source, (F.col("page") + F.col("page_offset")).cast("int"), ["fragment_idx"])
        full = rows.join(placed.select(*source, "fragment_idx", "adj_page", "position"), [*source, "fragment_idx"])
        full = align.align_clusters(full, ["paper", "table_idx", "adj_page", "position"], threshold=s.column_alignment_threshold, schema=schema.names if schema else None, semantic=s.column_value_semantic_alignment, jaccard=s.jaccard_column_alignment)
        rows = full.select(*rows.columns)
    readers = found.files.select("uuid", "reader").where("uuid is not null").distinct()
    fragments, rows = map(store, merge.merge_fragments(found.files, found.fragments, store(rows), s.agreement_method, readers))
    tables = found.tables.select("paper", "table_idx").distinct()
    if s.only_semantic_columns:
        rows = post.only_semantic_columns(rows)
    if s.drop_empty_columns:
        rows = post.drop_empty_columns(rows, ["paper", "table_idx", "fragment_idx"])
    if s.drop_empty_tables:
        fragments, rows = post.drop_empty_fragments(fragments, rows, ["paper", "table_idx", "fragment_idx"])
        tables = fragments.select("paper", "table_idx").distinct()
    if schema:
        if s.filter_schema_columns:
            rows = post.filter_schema_tables(rows, ["paper", "table_idx"], schema.names)
            kept = rows.select("paper", "table_idx").distinct()
            tables, fragments = tables.join(kept, ["paper", "table_idx"], "left_semi"), fragments.join(kept, ["paper", "table_idx"], "left_semi")
        if s.order_schema_columns:
            rows = post.order_schema_columns(rows, schema.names)
        if s.coerce_schema_column_types:
            rows = post.coerce_schema_types(rows, schema, ["paper", "table_idx", "fragment_idx", "pos"])
    return tables, fragments, rows


def merge_directories(spark: SparkSession, s: MergeSettings, out: str | None = None, paper: str | None = None, metadata_only: bool = False, force: bool = False, vocabulary: DataFrame | None = None) -> DataFrame | None:
    """Merges the folders of ``s.paths``; (paper, doc), written to ``out`` if given.

    Papers whose output somebody has curated are left alone unless ``force``; papers without any table are skipped.
    """
    s.check()
    ship(spark)
    if out:
        sinks.write_merge_metadata(out, [(p, read_resultset_metadata(p)) for p in s.paths], agreement_method=s.agreement_method)
        s.write(f"{out}/{SETTINGS}")
    if metadata_only:
        return None
    found = read_resultsets(spark, s.paths, parse_paper_aliases(s.paper_aliases) if s.paper_aliases else None, paper)
    found = ResultSets(*map(store, (found.files, found.tables, found.fragments, found.rows)))  # files are parsed once
    some = found.tables.select("paper").distinct()
    files = found.files.join(some, "paper", "left_semi")
    if out and not force:
        done = curated_papers(spark, out)
        files = files.join(done, "paper", "left_anti")
    keep = files.select("paper").distinct()
    pick = lambda df: df.join(keep, "paper", "left_semi")
    loaded = load(ResultSets(files, pick(found.tables), pick(found.fragments), pick(found.rows)), s, vocabulary)
    tables, fragments, rows = merged(loaded, s)
    first = Window.partitionBy("paper").orderBy("source_ord")
    cited = files.withColumn("n", F.row_number().over(first)).where("n = 1").select("paper", X.normalize_citation(F.when(F.col("citation.kind") != "null", C.display(F.col("citation")))).alias("citation"))
    docs = sinks.nested(tables, fragments, rows, cited)
    if out:
        sinks.write_papers(docs, out, s.pretty)
    return docs
