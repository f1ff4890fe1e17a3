"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; each half has a codebook of its own, by k-means over a bounded sample
(``sample`` vectors, the whole table if it has no more), and the pairs of codewords are the grid's cells. The codebooks
grow with the square root of the table, so that a cell has some 256 vectors; one of more than ``most`` is dealt into
pieces, and each pair of its pieces is a task. A vector visits cells in the order of a bound on how far its near-duplicates must have strayed
to lie there (the multi-sequence order: the next cell is always a neighbour in rank of one visited), and stops
where the target recall is met: a near-duplicate differs by at most r = sqrt(2 - 2 * threshold), and the share of r
that falls on the two lines that a cell's bound measures, from codeword to codeword, is taken from the data: the
largest of what falls there of the variance of all rows, of the variance of what their codewords leave of them, and
of noise in all dimensions alike. In these scales the stray is about Rayleigh-distributed. Cells beyond r itself
can't hold any and are left out. Of two cells only one side visits the other. What meets in a
cell is verified by its cosine.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.components import connected_components
from tabweave.llm.vectors import kmeans, lists, matrix, nearest, sampled, usable
from tabweave.session import Stored, ship

THRESHOLD, RECALL, ROUNDS, SAMPLE, MOST = 0.95, 0.99, 6, 65_536, 16_384


def margins(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword of each row, and how far it is from the border to each other codeword's region."""
    own = nearest(x, book)
    d = ((x * x).sum(1, keepdims=True) + (book * book).sum(1) - 2 * (x @ book.T)).clip(0)
    apart = np.sqrt(((book[own] ** 2).sum(1)[:, None] + (book * book).sum(1) - 2 * (book[own] @ book.T)).clip(1e-12))
    out = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart)
    out[np.arange(len(x)), own] = 0
    return own, out.clip(0)


def shares(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """(2, k, k): the largest share of the squared length of differences that may fall on the line between two codewords.

    From second moments of all rows; only their sums, four matrices of half the dimensions, reach the driver.
    """
    k, width = books.shape[1:]
    names = [f"s{j}" for j in range(width)]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width + 1, width))
        n = 0
        for b in batches:
            x = matrix(b.column(0))
            n += len(x)
            for h in range(2 if len(x) else 0):
                mine = x[:, h * width : (h + 1) * width].astype(float)
                rest = mine - shared.value[h][nearest(mine.astype(np.float32), shared.value[h])]
                for m, y in ((h, mine), (2 + h, rest)):
                    total[m, :width] += y.T @ y
                    total[m, width] += y.sum(0)
        flat = total.reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), n)), *(pa.array(flat[:, j].copy()) for j in range(width))], names=["i", "n", *names])

    got = rows.mapInArrow(moments, "i bigint, n bigint, " + ", ".join(f"{s} double" for s in names)).groupBy("i").agg(*(F.sum(s).alias(s) for s in ["n", *names])).collect()
    out = np.full((2, k, k), 1 / max(2 * width, 1))
    if not got or not got[0].n:
        return out
    total = np.zeros((4 * (width + 1), width))
    for r in got:
        total[r.i] = r[2:]
    total = total.reshape(4, width + 1, width) / got[0].n
    spread = total[:, :width] - total[:, width, :, None] * total[:, width, None, :]
    for two in (spread[:2], spread[2:]):
        whole = np.trace(two[0]) + np.trace(two[1])
        for h in range(2 if whole > 1e-12 else 0):
            book, on = books[h].astype(float), books[h].astype(float) @ two[h]
            own = (on * book).sum(1)
            line = own[:, None] + own - 2 * (on @ book.T)
            apart = ((book * book).sum(1)[:, None] + (book * book).sum(1) - 2 * (book @ book.T)).clip(1e-12)
            out[h] = np.maximum(out[h], line / apart / whole)
    return out.clip(max=1)


def cells_in_order(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of codewords with a[i]**2 + b[j]**2 up to ``most``, the least sums first, by multi-sequence traversal."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = (a[ia] ** 2).tolist(), (b[ib] ** 2).tolist()
    out, heap, seen = [], [(sa[0] + sb[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        out.append((int(ia[i]), int(ib[j])))
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(sa) and n[1] < len(sb) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (sa[n[0]] + sb[n[1]], *n))
    return out


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """(id, duplicate_of) of each vector that has one with a smaller id in its group of near-duplicates.

    Groups are the connected components of pairs with a cosine of at least ``threshold``; ``duplicate_of`` is the
    group's least id. Ids may be of any type that can be ordered. Null ids, null vectors, vectors with null, NaN or infinite numbers, of an uncommon length,
    or of length 0 take no part. Equal vectors always meet. Rows that repeat an id and its vector are one; an id
    is never its own duplicate. Empty table: no rows. Other columns are not read, so they can't clash.
    """
    spark = df.sparkSession
    ship(spark)
    rows, d = usable(df, id_col, vector_col)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1)).astype(float)
            n = np.sqrt((x * x).sum(1))
            ok = n > 0
            x = (x[ok] / n[ok, None]).astype(np.float32)
            x = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), lists(x)], names=["id", "vec"])

    d += d % 2
    unit = Stored(rows.mapInArrow(scaled, T.StructType([rows.schema["id"], T.StructField("vec", T.ArrayType(T.FloatType()))]))).df
    unit = unit.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec")
    same = unit.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.first("vec").alias("vec"))
    one = Stored(same.withColumn("h", F.monotonically_increasing_id()))  # written once, so numbers stay
    n = one.df.count()
    x = sampled(one.df, n, sample) if n else np.zeros((0, max(d, 2)), np.float32)
    books = kmeans(x, 2, max(1, min(math.ceil(math.sqrt(n) / 16), len(x) // 8)), ROUNDS)
    shared = spark.sparkContext.broadcast((books, np.sqrt(shares(one.df.select("vec"), books))))
    k = books.shape[1]
    sure = (2 - 2 * threshold) * 1.001 + 1e-6
    reach = (2 - 2 * threshold) * -2 * math.log(max(1 - recall, 1e-12))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value[0]
        for b in batches:
            x = matrix(b.column(0))
            half = x.shape[1] // 2
            if len(x):
                cells, size = np.unique(nearest(np.ascontiguousarray(x[:, :half]), first) * k + nearest(np.ascontiguousarray(x[:, half:]), second), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(size)], names=["cell", "n"])

    sizes = one.df.select("vec").mapInArrow(home, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(f"n > {most}")
    pieces = {r.cell: -(-r.n // most) for r in sizes.collect()}  # of overfull cells alone
    wide = max(pieces.values(), default=1)

    def spread(cells: np.ndarray, guests: np.ndarray, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, task) of each: overfull cells have a task for each pair of their pieces, a guest goes to those of a piece with itself."""
        where = np.flatnonzero(np.isin(cells, list(pieces))) if pieces else np.zeros(0, np.int64)
        rest = np.setdiff1d(np.arange(len(cells)), where)
        at, task = [rest], [cells[rest] * wide * wide]
        for r in where.tolist():
            p = pieces[int(cells[r])]
            j = np.arange(p)
            i = j if guests[r] else np.full(p, int(hs[r]) % p)
            at.append(np.full(p, r))
            task.append((cells[r] * wide + np.minimum(i, j)) * wide + np.maximum(i, j))
        return np.concatenate(at), np.concatenate(task)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, second), scale = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                x = matrix(b.column(1).slice(lo, 1024))
                half = x.shape[1] // 2
                (own1, m1), (own2, m2) = margins(x[:, :half], first), margins(x[:, half:], second)
                s1, s2 = m1 / scale[0][own1], m2 / scale[1][own2]
                at, cell, guest = [], [], []
                for i in range(len(x)):
                    home = int(own1[i]) * k + int(own2[i])
                    for c1, c2 in cells_in_order(s1[i], s2[i], reach):
                        if (c := c1 * k + c2) >= home and m1[i, c1] ** 2 + m2[i, c2] ** 2 <= sure:
                            at.append(i)
                            cell.append(c)
                            guest.append(c != home)
                at, guest, hs = np.array(at, np.int64), np.array(guest, bool), b.column(0).slice(lo, 1024).to_numpy()
                row, task = spread(np.array(cell, np.int64), guest, hs[at])
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(guest[row]), pa.array(hs[at[row]]), lists(x[at[row]])], names=["cell", "guest", "h", "vec"])

    met = one.df.select("h", "vec").mapInArrow(visits, "cell bigint, guest boolean, h bigint, vec array<float>")
    met = met.repartition("cell").sortWithinPartitions("cell", "guest", "h")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a cell come first; guests are held against them as they pass."""
        now, names, own, joined, us, vs = None, np.zeros(0, np.int64), np.zeros((0, d), np.float32), {}, [], []

        def root(a: int) -> int:
            while (b := joined.get(a, a)) != a:
                joined[a] = joined.get(b, b)
                a = b
            return a

        def compare(ids: np.ndarray, x: np.ndarray, mine: np.ndarray, others: np.ndarray) -> None:
            for lo in range(0, len(others), 1024):
                hit = (x @ others[lo : lo + 1024].T) >= threshold
                for i, j in zip(*np.nonzero(hit)):
                    a, b = root(int(ids[i])), root(int(mine[lo + j]))
                    if a != b:
                        joined[max(a, b)] = min(a, b)
                        us.append(a)
                        vs.append(b)

        for b in batches:
            cells, guests, hs, x = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), matrix(b.column(3))
            edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (guests[1:] != guests[:-1]), [True]])) if len(x) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if cells[lo] != now:
                    now, names, own, joined = cells[lo], np.zeros(0, np.int64), np.zeros((0, x.shape[1]), np.float32), {}
                for s in range(lo, hi, 1024):
                    e = min(hi, s + 1024)
                    if not guests[lo]:
                        names, own = np.concatenate([names, hs[s:e]]), np.concatenate([own, x[s:e]])
                    if len(own):
                        compare(hs[s:e], x[s:e], names, own)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                del us[:], vs[:]

    found = connected_components(met.mapInArrow(verified, "u bigint, v bigint"))
    named = found.join(one.df.select(F.col("h").alias("node"), "first"), "node")
    keep = named.groupBy("component").agg(F.min("first").alias("keep"))
    keep = named.join(keep, "component").select(F.col("node").alias("h"), "keep")
    ids = unit.select("id", "h1", "h2").join(one.df.select("h1", "h2", "h", "first"), ["h1", "h2"]).join(keep, "h", "left").withColumn("keep", F.coalesce("keep", "first"))
    return ids.where("id != keep").select(F.col("id").alias(id_col), F.col("keep").alias("duplicate_of")).distinct()
