"""Row keys that outlive a plan, and lookups by them, so that texts stay where they are.

A row's key is the file that holds it and its number there; it doesn't depend on how a scan is cut into tasks, nor on
which executors are there. What was found out about a few rows is written to the shared folder in blocks of
neighbouring rows, and the scan that needs it reads the blocks of the rows it meets: only keys are exchanged, never
texts. A lost task reads the same again.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.session import Stored, shared_dir
from tabweave.sources import storage

BLOCK = 18  # bits: rows of a file that share a block


def _scan(df: DataFrame, dense: bool) -> bool:
    """Whether the plan is a Parquet scan with nothing but projections and, unless ``dense``, filters."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter")[: 1 if dense else 2] and plan.children().size() == 1:
        plan = plan.children().head()
    if not plan.nodeName().startswith(("LogicalRelation", "Relation")) or any(c.lower() == "_metadata" for c in df.columns):
        return False
    try:
        df.select("_metadata.row_index").schema  # noqa: B018 - Parquet alone has it
    except AnalysisException:
        return False
    return True


class Rows:
    """A table with keys (f, i): a Parquet scan as it is, anything else as written to the shared folder.

    ``dense``: each file's rows are all there, so their numbers have no gaps.
    """

    def __init__(self, df: DataFrame, dense: bool = False):
        self.schema, self.columns, self.spark = df.schema, df.columns, df.sparkSession
        if _scan(df, dense):
            self.df, self.names = df, df.columns
        else:
            self.names = [f"c{k}" for k in range(len(df.columns))]
            self.df = Stored(df.toDF(*self.names)).df
        self.rows = self.df.count()
        self.blocks = max(1, -(-self.rows >> BLOCK))

    def col(self, name: str) -> Column:
        return F.col(f"`{self.names[self.columns.index(name)]}`")

    def keys(self) -> list[Column]:
        return [F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")]

    def select(self, **columns: Column) -> DataFrame:
        """The keys and expressions over :meth:`col`, under names of the operator's own."""
        return self.df.select(*self.keys(), *(c.alias(n) for n, c in columns.items()))

    def place(self) -> Column:
        return F.pmod(F.xxhash64("f", F.shiftright("i", BLOCK)), F.lit(self.blocks))

    def lookup(self, found: DataFrame) -> Lookup:
        """``found`` (f, i, ...), one row a key at most, written for lookups."""
        return Lookup(self, found)

    def mapped(self, lookup: Lookup, run: Callable[[list[pa.Array], np.ndarray, pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
        """``run`` of the table's columns in batches, the place in the lookup's rows of each row (-1 for none), and those rows."""
        n, read = len(self.names), lookup.reader()
        own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(self.names)]
        keyed = self.df.select(*own, *self.keys()).withColumn("b", self.place())

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = read()
            for batch in batches:
                b = batch.column(n + 2).to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else []
                for lo, hi in zip(edges[:-1], edges[1:]):
                    part = batch.slice(lo, hi - lo)
                    at, table = find(int(b[lo]), part.column(n).to_numpy(), part.column(n + 1).to_numpy())
                    yield from run(part.columns[:n], at, table)

        return keyed.mapInArrow(go, schema)


class Lookup:
    def __init__(self, rows: Rows, found: DataFrame):
        self.path = f"{shared_dir(rows.spark)}/tabweave-lookup-{uuid.uuid4().hex}"
        self.schema = found.schema
        keyed = found.withColumn("b", rows.place())
        keyed.repartition("b").sortWithinPartitions("b", "f", "i").write.partitionBy("b").parquet(self.path)

    def reader(self) -> Callable[[], Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, pa.Table]]]:
        path = self.path

        def start() -> Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, pa.Table]]:
            known: OrderedDict[int, tuple] = OrderedDict()

            def block(b: int) -> tuple:
                if b not in known:
                    folder = f"{path}/b={b}"
                    parts = [_table(f"{folder}/{x}") for x in storage.names(folder, "*.parquet")]
                    table = pa.concat_tables(parts).sort_by([("f", "ascending"), ("i", "ascending")]).combine_chunks() if parts else None
                    known[b] = (table, *(table[c].to_numpy() for c in ("f", "i"))) if parts else (None, None, None)
                    while len(known) > 4:
                        known.popitem(last=False)
                known.move_to_end(b)
                return known[b]

            def find(b: int, f: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, pa.Table]:
                table, own_f, own_i = block(b)
                at = np.full(len(f), -1)
                for v in np.unique(f) if table is not None else ():
                    lo, hi = np.searchsorted(own_f, v, "left"), np.searchsorted(own_f, v, "right")
                    if lo < hi:
                        mine = np.flatnonzero(f == v)
                        near = np.minimum(np.searchsorted(own_i[lo:hi], i[mine]), hi - lo - 1) + lo
                        at[mine] = np.where(own_i[near] == i[mine], near, -1)
                return at, table

            return find

        return start


def _table(path: str) -> pa.Table:
    system, p = storage.opened(path)
    with system.open_input_file(p) as f:
        return pq.read_table(f)


def filtered(rows: Rows, gone: DataFrame) -> DataFrame:
    """The table's rows, all columns as they are, but for those with keys in ``gone``."""

    def run(columns: list[pa.Array], at: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = pa.array(at < 0)
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[f"c{k}" for k in range(len(columns))])

    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(rows.schema)])
    return restored(rows.mapped(rows.lookup(gone.select("f", "i")), run, plain), rows.schema)


def restored(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The names of a table again, whatever they are."""
    return df.toDF(*schema.names)
