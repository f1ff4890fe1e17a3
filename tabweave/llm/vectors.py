"""Vector columns as NumPy matrices, and k-means over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as float32."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows, np.float32).reshape(-1)))


def usable(df: DataFrame, id_col: str, vector_col: str, id_type: str | None = None) -> tuple[DataFrame, int]:
    """(id, vec) of the rows with an id and a vector of finite numbers of the commonest length (of equals the longest), and that length.

    With ``id_type`` ids are cast, and those that can't be are none.
    """
    own = F.col(f"`{id_col}`")
    rows = df.select((own.try_cast(id_type) if id_type else own).alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("vec")).where("id is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top[0] if top else 0
    return rows.where(F.size("vec") == d), d


def sampled(rows: DataFrame, n: int, bound: int) -> np.ndarray:
    """At most ``bound`` of the n vectors of ``rows``, all of them if there are no more; which ones is left to a hash of the row."""
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("vec", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    return matrix(rows.select("vec").limit(bound).toArrow()["vec"].combine_chunks())


def nearest(x: np.ndarray, centres: np.ndarray, price: np.ndarray | None = None) -> np.ndarray:
    """Of each row the centre with the least squared distance, plus its price."""
    cost = (centres * centres).sum(1) if price is None else (centres * centres).sum(1) + price
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (cost - 2 * (x[lo : lo + 4096] @ centres.T)).argmin(1)
    return out


def kmeans(x: np.ndarray, parts: int, k: int, rounds: int, balance: float = 0.0) -> np.ndarray:
    """(parts, k, dims / parts) centres of a sample: each part of the vectors has a codebook of its own.

    Lloyd's rounds from k vectors by lot. ``balance`` makes a centre dearer by that share of the mean squared distance
    for each time its mean size that it holds.
    """
    width = x.shape[1] // parts
    rng = np.random.Generator(np.random.PCG64(1))
    first = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    k = len(first)
    centres = np.zeros((parts, k, width), np.float32)
    for p in range(parts if k else 0):
        mine = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        c, price = first[:, p * width : (p + 1) * width].astype(np.float32), np.zeros(k, np.float32)
        for _ in range(rounds):
            at = nearest(mine, c, price)
            size, order = np.bincount(at, minlength=k), np.argsort(at, kind="stable")
            some = np.flatnonzero(size)
            sums = np.add.reduceat(mine[order].astype(float), (np.cumsum(size) - size)[some], axis=0)
            spread = float(((mine - c[at]) ** 2).sum()) / len(mine)
            c = c.copy()
            c[some] = sums / size[some, None]
            price = (balance * spread * (size * k / len(mine) - 1)).astype(np.float32)
        centres[p] = c
    return centres
