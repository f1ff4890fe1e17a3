"""Tables out of documents: readers plug in as functions from a file's bytes to its tables.

A reader takes (content, pages, hints, mapping) and gives (page, names, rows) for each table; the ones for PDF libraries
are registered when the library is installed. Documents are read where they lie, a task for each few files, and
what goes wrong with one is its ``error``.
"""

from __future__ import annotations

import importlib.util
import io
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.names import plain_name

Table = tuple[int, list[str], list[list[str | None]]]
Reader = Callable[[bytes, Sequence[int] | None, Sequence[str], dict | None], Iterable[Table]]
READERS: dict[str, Reader] = {}
RESULT = "path string, table_idx int, page int, pos int, names array<string>, vals array<string>, error string"
ARROW = pa.schema([("path", pa.string()), ("table_idx", pa.int32()), ("page", pa.int32()), ("pos", pa.int32()), ("names", pa.list_(pa.string())), ("vals", pa.list_(pa.string())), ("error", pa.string())])


def reader(name: str, needs: str | None = None) -> Callable[[Reader], Reader]:
    """Registers a reader, if the library it needs is installed."""

    def add(f: Reader) -> Reader:
        if needs is None or importlib.util.find_spec(needs) is not None:
            READERS[name] = f
        return f

    return add


def first_row_is_header(row: Sequence[str | None], hints: Sequence[str]) -> bool:
    return any(plain_name(c or "") in hints for c in row)


def with_header(rows: list[list[str | None]], hints: Sequence[str], skip_first: bool = False) -> tuple[list[str], list[list[str | None]]]:
    """Names and rows: the first row gives the names if it must or a hint is in it, else they are numbers."""
    if rows and (skip_first or first_row_is_header(rows[0], hints)):
        return [c or str(k) for k, c in enumerate(rows[0])], rows[1:]
    return [str(k) for k in range(max(map(len, rows), default=0))], rows


@dataclass
class TableMapping:
    """Which columns of which pages are wanted, under which names."""

    title: str
    header_mode: str
    first_page: int
    last_page: int
    columns: list[tuple[int, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> list[TableMapping]:
        return [cls(t["title"], t["header_mode"], t["first_page"], t["last_page"], [(m["from_column_number"], m["to_column_name"]) for m in t["column_mappings"]]) for t in json.loads(text)["tables"]]


def mapped_projection(df: DataFrame, columns: Sequence[tuple[int, str]]) -> DataFrame:
    """Columns by number, under normalised new names, without line breaks in them."""
    return df.select(*(F.replace(F.col(f"`{df.columns[k]}`").cast("string"), F.lit("\n"), F.lit(" ")).alias(plain_name(n)) for k, n in columns))


def page_batches(pages: Sequence[int], size: int) -> list[list[int]]:
    if size < 1:
        raise ValueError("the size of a batch must be positive")
    return [list(pages[k : k + size]) for k in range(0, len(pages), size)]


@reader("json")
def read_json(content: bytes, pages: Sequence[int] | None, hints: Sequence[str], mapping: dict | None) -> Iterable[Table]:
    """Pages as JSON: [{page, rows: [[cell, ...], ...]}], for tests and for extraction done elsewhere."""
    for t in json.loads(content):
        if pages is None or t["page"] in pages:
            yield t["page"], *with_header(t["rows"], hints)


@reader("pdfplumber", "pdfplumber")
def read_pdfplumber(content: bytes, pages: Sequence[int] | None, hints: Sequence[str], mapping: dict | None) -> Iterable[Table]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for k, page in enumerate(pdf.pages, 1):
            if pages is None or k in pages:
                for t in page.extract_tables():
                    yield k, *with_header(t, hints)


@reader("pymupdf", "pymupdf")
def read_pymupdf(content: bytes, pages: Sequence[int] | None, hints: Sequence[str], mapping: dict | None) -> Iterable[Table]:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        for k, page in enumerate(pdf, 1):
            if pages is None or k in pages:
                for t in page.find_tables():
                    yield k, *with_header(t.extract(), ())


@reader("camelot", "camelot")
def read_camelot(content: bytes, pages: Sequence[int] | None, hints: Sequence[str], mapping: dict | None) -> Iterable[Table]:
    import camelot

    for t in camelot.read_pdf(io.BytesIO(content), flavor="hybrid", pages="all" if pages is None else ",".join(map(str, pages))):
        yield int(t.page), *with_header(t.df.values.tolist(), ())


@reader("img2table", "img2table")
def read_img2table(content: bytes, pages: Sequence[int] | None, hints: Sequence[str], mapping: dict | None) -> Iterable[Table]:
    from img2table.document import PDF
    from img2table.ocr import TesseractOCR

    for k, tables in PDF(src=io.BytesIO(content)).extract_tables(ocr=TesseractOCR()).items():
        if pages is None or k + 1 in pages:
            for t in tables:
                yield k + 1, *with_header(t.df.values.tolist(), hints)


def read_tables(files: DataFrame, read: Reader, hints: Sequence[str] = (), mapping: Sequence[TableMapping] | None = None, first_only: bool = False) -> DataFrame:
    """``files`` (path, content, pages: array<int> or null) to one row for each row of each table, or with an ``error``.

    With a mapping only its pages and columns are read. ``first_only``: its first table alone.
    """
    wanted = list(mapping or [])[: 1 if first_only else None]

    def one(path: str, content: bytes, pages: Sequence[int] | None) -> Iterator[tuple]:
        try:
            found: list[Table] = []
            if wanted:
                for m in wanted:
                    for page, names, rows in read(content, range(m.first_page, m.last_page + 1), hints, None):
                        rows = rows[1:] if m.header_mode == "all_pages" or (m.header_mode == "first_page_only" and page == m.first_page) else rows
                        found.append((page, [plain_name(n) for _, n in m.columns], [[(r[k] or "").replace("\n", " ") if k < len(r) else None for k, _ in m.columns] for r in rows]))
            else:
                found = list(read(content, pages, hints, None))
            for t, (page, names, rows) in enumerate(found):
                page, names = _whole(page), [None if n is None else str(n) for n in names]
                for pos, r in enumerate(rows):
                    yield path, t, page, pos, names, [None if v is None else str(v) for v in r], None
        except Exception as e:  # noqa: BLE001 - one document's failure is its own result
            yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(row for b in batches for path, content, pages in zip(*b.columns) for row in one(path.as_py(), content.as_py(), pages.as_py()))

    return files.select("path", "content", "pages").mapInArrow(run, RESULT)


def _whole(page) -> int | None:
    """A page's number; what isn't whole or doesn't fit an integer is an error of its document."""
    n = None if page is None else int(page)
    if n is not None and (isinstance(page, float) and n != page or not -(2**31) <= n < 2**31):
        raise ValueError(f"not a page: {page}")
    return n


def packed(rows: Iterable[tuple], most: int = 8192, characters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Result rows in Arrow batches, of many small documents or of part of a long one: a batch costs far more than a row."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += sum(len(v) for v in row[5] or () if v)
        if len(out) >= most or held >= characters:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, content, pages) of documents, which may be path:from:to."""
    from tabweave.functions.names import parse_page_range

    ranges = [parse_page_range(p) for p in paths]
    pages = spark.createDataFrame([(str(Path(p).resolve()), list(r) if r else None) for p, r in ranges], "path string, pages array<int>")
    files = spark.read.format("binaryFile").load([p for p, _ in ranges]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    return files.join(F.broadcast(pages), "path")


def unread(files: DataFrame, done: DataFrame, key: str = "paper") -> DataFrame:
    """Those that are not in the result set yet."""
    return files.join(done.select(key), key, "left_anti")


def uncached(files: DataFrame, cache: DataFrame, key: str = "paper") -> DataFrame:
    """Those that have no mapping yet."""
    return files.join(cache.select(key), key, "left_anti")


def write_mapping(path: str, mapping: dict, model: str, date: str) -> None:
    Path(path).write_text(json.dumps({**mapping, "metadata": {"model": model, "date": date}}, ensure_ascii=False, indent=2), encoding="utf-8")


def page_range(c: Column) -> Column:
    """(path, first_page, last_page) of path:from:to; any other text is a path, without pages."""
    pattern = r"(?s)^(.+):(\d+):(\d+)$"
    hit = c.rlike(pattern)
    number = lambda k: F.when(hit, F.regexp_extract(c, pattern, k)).cast("bigint")
    return F.struct(F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise(c).alias("path"), number(2).alias("first_page"), number(3).alias("last_page"))
