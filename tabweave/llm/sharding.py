"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

All rows get a place in one random order, of which shards are consecutive cuts. The order is dealt out in units of
consecutive places, each an exchange partition. How many rows of block p of the table (consecutive rows of a file) go
to unit u is a matrix of hypergeometric draws whose margins are the blocks' and the units' sizes. It is never built:
the blocks are the leaves of a binary tree, each inner node splits its unit counts between its children by draws with
a seed of its own, and a task repeats the draws on the way from the root to its blocks. So a task needs the blocks'
sizes only, and a lost task, or one of a scan that is cut otherwise, draws the same again.

A task gives a block's rows a random arrangement of their unit numbers (the local permutation), one exchange by unit
follows, and a random key orders each unit (the second permutation).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.rows import BLOCK, Rows, restored
from tabweave.llm.text import mix
from tabweave.session import ship

MOST = 10**9 - 1  # the largest population that NumPy draws from


def sizes_of(rows: int, parts: int) -> np.ndarray:
    """Sizes that differ by 1 at most, the larger ones first."""
    return np.full(parts, rows // parts, np.int64) + (np.arange(parts) < rows % parts)


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """log x! in extended precision: Stirling's series eight places on, whose error is below 1e-14."""
    z = x.astype(np.longdouble) + 9
    shift = sum(np.log(z - k) for k in range(1, 9))
    return (z - 0.5) * np.log(z) - z + np.longdouble(0.91893853320467274178) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def large_draws(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hypergeometric draws from populations of any size up to 2**60, by ratio of uniforms from the mode.

    The hat of Stadlober's ratio-of-uniforms method; a draw is accepted by the logarithm of its probability against
    the mode's. In extended precision that is right to 1e-5 for 10**12 rows. Two uniforms and a few logarithms a trial,
    about 1.3 trials a draw, whatever the sizes are.
    """
    few, many, all_ = np.minimum(good, bad), np.maximum(good, bad), good + bad
    m = np.minimum(n, all_ - n)
    share = few / all_
    centre = m * share + 0.5
    wide = np.sqrt((all_ - m) / np.maximum(all_ - 1, 1) * m * share * (1 - share) + 0.5)
    reach = 1.7155277699214135 * wide + 0.8989161620588988
    mode = np.floor((m.astype(np.longdouble) + 1) * (few + 1) / (all_ + 2)).astype(np.int64)
    weight = lambda k: _log_factorial(k) + _log_factorial(few_ - k) + _log_factorial(m_ - k) + _log_factorial(many_ - m_ + k)
    few_, m_, many_ = few, m, many
    top = weight(mode)
    end = np.minimum(np.minimum(m, few) + 1.0, np.floor(centre + 16 * wide))
    out, left = np.zeros(len(good), np.int64), np.arange(len(good))
    while len(left):
        x, y = 1 - rng.random(len(left)), rng.random(len(left))
        w = centre[left] + reach[left] * (y - 0.5) / x
        ok = (w >= 0) & (w < end[left])
        k = np.where(ok, np.floor(w), 0).astype(np.int64)
        few_, m_, many_ = few[left], m[left], many[left]
        ok &= 2 * np.log(x) <= (top[left] - weight(k)).astype(float)
        out[left[ok]] = k[ok]
        left = left[~ok]
    out = np.where(good > bad, m - out, out)
    return np.where(m < n, good - out, out)


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of n rows without replacement are good, element by element."""
    out = np.zeros(len(good), np.int64)
    sure = (good == 0) | (bad == 0) | (n == 0) | (n == good + bad)
    out[sure] = np.minimum(good, n)[sure]
    small = ~sure & (good + bad <= MOST)
    out[small] = rng.hypergeometric(good[small], bad[small], n[small])
    large = ~sure & ~small
    if large.any():
        out[large] = large_draws(rng, good[large], bad[large], n[large])
    return out


def draw(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """``size`` rows drawn without replacement from ``counts`` rows of each unit: halves of the units, halves of those, and so on."""
    levels = [np.asarray(counts, np.int64)]
    while len(levels[-1]) > 1:
        x = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], 0)
        levels.append(x[::2] + x[1::2])
    out = np.array([size], np.int64)
    for below in levels[-2::-1]:
        left, right = below[::2], below[1::2] if len(below) % 2 == 0 else np.append(below[1::2], 0)
        got = hypergeometric(rng, left, right, out)
        out = np.stack([got, out - got], 1).reshape(-1)[: len(below)]
    return out


def matrix_row(sizes: np.ndarray, part: int, units: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: how many of its rows go to each unit."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo, hi, at, counts = 0, len(sizes), np.arange(len(units)), np.asarray(units, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(counts, int(sums[mid] - sums[lo]), np.random.Generator(np.random.PCG64([seed, lo, hi])))
        if part < mid:
            hi, counts = mid, left
        else:
            lo, counts = mid, counts - left
        some = np.flatnonzero(counts)  # units that no row of this node goes to need no more draws
        at, counts = at[some], counts[some]
    out = np.zeros(len(units), np.int64)
    out[at] = counts
    return out


def shuffle_into_shards(df: DataFrame, shards: int | None = None, seed: int = 0, rows_per_shard: int = 8192, rows_per_unit: int = 16384, units: int = 100_000) -> DataFrame:
    """All rows and columns of ``df`` with ``shard_id`` (from 0) and ``shard_pos`` (from 0 in each shard).

    Shards have rows // shards rows or one more; without ``shards`` there is one for each ``rows_per_shard`` rows
    begun. An exchange partition takes ``rows_per_unit`` rows, or more where there would be over ``units`` of them.
    Whatever isn't a plain Parquet scan is first written to the shared folder. Nulls, empty and long texts, ties and
    repeated rows: rows are never looked at, each one gets its own place. Empty table: no rows. Columns named
    ``shard_id`` or ``shard_pos`` are replaced; no other name matters.
    """
    if shards is not None and shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    ship(spark)
    rows = Rows(df.drop("shard_id", "shard_pos"), dense=True)
    counted = rows.select().groupBy("f", F.shiftright("i", BLOCK).alias("k")).agg(F.count("*").alias("n"))
    found = sorted((r.f, r.k, r.n) for r in counted.collect())  # three numbers for each 262,144 rows of a file
    blocks = {(f, k): p for p, (f, k, _) in enumerate(found)}
    sizes = np.array([n for *_, n in found], np.int64)
    total = int(sizes.sum())
    shards = shards or max(1, -(-total // rows_per_shard))
    parts = max(1, min(units, -(-total // rows_per_unit)))
    unit_sizes, shard_sizes = sizes_of(total, parts), sizes_of(total, shards)
    shared = spark.sparkContext.broadcast((blocks, sizes))
    width = len(rows.names)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, all_sizes = shared.value
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            f, i = b.column(width).to_numpy(), b.column(width + 1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (i[1:] >> BLOCK != i[:-1] >> BLOCK), [True]])) if len(f) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                p = where[int(f[lo]), int(i[lo]) >> BLOCK]
                if p not in known:
                    if len(known) > 3:
                        known.clear()
                    rng = np.random.Generator(np.random.PCG64([seed, p]))
                    known[p] = rng.permutation(np.repeat(np.arange(parts, dtype=np.int32), matrix_row(all_sizes, p, unit_sizes, seed)))
                place = i[lo:hi] & ((1 << BLOCK) - 1)
                key = mix(mix(np.uint64(p) + mix(np.full(hi - lo, seed % (1 << 63), np.uint64))) + place.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(lo, hi - lo).columns[:width], pa.array(known[p][place]), pa.array(key.view(np.int64))],
                    names=[*(f"c{k}" for k in range(width)), "u", "key"])

    plain = [T.StructField(f"c{k}", x.dataType) for k, x in enumerate(rows.schema)]
    keyed = rows.df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rows.names)), *rows.keys())
    labelled = keyed.mapInArrow(label, T.StructType([*plain, T.StructField("u", T.IntegerType()), T.StructField("key", T.LongType())]))
    starts = np.concatenate([[0], np.cumsum(unit_sizes)])
    big, more = total // shards, total % shards  # ``more`` shards have one row more, the first ones

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for b in batches:
            u = b.column(width).to_numpy()
            new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
            since = np.arange(len(u)) - np.repeat(new, np.diff(np.append(new, len(u))))
            if len(u) and u[0] == now:
                since[: new[1] if len(new) > 1 else len(u)] += seen
            if len(u):
                now, seen = u[-1], int(since[-1]) + 1
            place = starts[u] + since
            front = place < more * (big + 1)
            rest = place - more * (big + 1)
            shard = np.where(front, place // (big + 1), more + rest // max(big, 1))
            pos = np.where(front, place % (big + 1), rest % max(big, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(shard.astype(np.int32)), pa.array(pos)], names=[*(f"c{k}" for k in range(width)), "shard_id", "shard_pos"])

    new = [T.StructField("shard_id", T.IntegerType()), T.StructField("shard_pos", T.LongType())]
    dealt = labelled.repartitionById(parts, F.col("u")).sortWithinPartitions("u", "key")
    return restored(dealt.mapInArrow(numbered, T.StructType([*plain, *new])), T.StructType([*rows.schema, *new]))
