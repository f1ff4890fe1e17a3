"""Approximate nearest neighbours of chosen vectors in a whole table, by balanced posting lists.

Balanced k-means over a bounded sample (``sample`` vectors, the whole table if it has no more) gives about sqrt(n) / 4
centroids, an eighth of the sample at most. Every vector is filed under its nearest centroid and, at a boundary, under
others that are nearly as near, unless a nearer one of its lists lies closer to that centroid than the vector does. A
list of more than ``most`` vectors is dealt into pieces, so that no task holds more; a query of the list asks them all.
Filing holds each vector against all centroids, in matrix products. Queries search the centroids by a graph in memory:
links to near centroids that don't lie behind one another, a few by lot, and a beam that widens until it finds the
sample's nearest centroids and has room beyond the reach asked for. A query takes the lists whose centroids are within
``ratio`` times the distance of its nearest one. That ratio is not guessed: the exact neighbours of ``probes`` queries
in the whole table, searched by the same graph, tell how far it must reach for the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.vectors import kmeans, lists, matrix, sampled, usable
from tabweave.session import Stored, ship

K, RECALL, PROBES, BOUNDARY, ROUNDS, SAMPLE, MOST = 10, 0.95, 256, 1.05, 6, 65_536, 32_768
LINKS, LOTS, ENTRIES, BEAM = 24, 4, 32, 32
NEAR = 1e-6  # distances below it count as it, for ratios


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, of all rows of ``a`` to all of ``b``."""
    return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).clip(0)


def links_of(centres: np.ndarray) -> np.ndarray:
    """(k, LINKS + LOTS) links of each centroid: near ones of which none lies nearer to an earlier one, and some by lot."""
    k, rng = len(centres), np.random.Generator(np.random.PCG64(2))
    out = rng.integers(0, max(k, 1), (k, LINKS + LOTS))
    near = min(k - 1, 3 * LINKS)
    for lo in range(0, k, 1024):
        d = distances(centres[lo : lo + 1024], centres)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        close = np.argpartition(d, near - 1, 1)[:, :near] if near else np.zeros((len(d), 0), np.int64)
        for i, c in enumerate(close):
            c = c[np.argsort(d[i, c])]
            between, mine = distances(centres[c], centres[c]), []
            for j in range(len(c)):
                if len(mine) < LINKS and all(between[j, m] > d[i, c[j]] for m in mine):
                    mine.append(j)
            out[lo + i, : len(mine)] = c[mine]
    return out


class Centroids:
    """All centroids, and the graph by which queries search them."""

    def __init__(self, centres: np.ndarray, sample: np.ndarray | None = None):
        self.centres, self.links, self.beam = centres, links_of(centres), BEAM
        self.entries = np.unique(np.linspace(0, max(len(centres) - 1, 0), min(ENTRIES, len(centres))).astype(np.int64))
        x = centres if sample is None or not len(sample) else sample[:: max(1, len(sample) // 1024)]
        true = self.far(x).argmin(1) if len(centres) else x
        while self.beam < len(centres) and (self.search(x, self.beam)[0][:, 0] == true).mean() < 0.995:
            self.beam *= 2

    def far(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of the rows to all centroids."""
        return distances(x, self.centres)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), the nearest first, of ``beam`` that the graph leads each row to; all if it is no wider."""
        if beam >= len(self.centres):
            d = self.far(x)
            order = np.argsort(d, 1, kind="stable")
            return order, np.take_along_axis(d, order, 1)
        n, wide = len(x), (self.centres * self.centres).sum(1)
        seen = np.zeros((n, len(self.centres)), bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen[:, self.entries] = True
        d = distances(x, self.centres[self.entries])
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(d, 1, kind="stable")[:, :beam]
            ids, d, done = (np.take_along_axis(a, order, 1) for a in (ids, d, done))
            open_ = np.flatnonzero((~done & np.isfinite(d)).any(1))
            if not len(open_):
                return ids, d
            pick = np.argsort(done[open_] | ~np.isfinite(d[open_]), 1, kind="stable")[:, :4]  # the four nearest that weren't followed
            done[open_[:, None], pick] = True
            near = np.sort(self.links[ids[open_[:, None], pick]].reshape(len(open_), -1), 1)
            old = seen[open_[:, None], near]
            old[:, 1:] |= near[:, 1:] == near[:, :-1]
            seen[open_[:, None], near] = True
            own = (x[open_] ** 2).sum(1)[:, None] + wide[near] - 2 * np.einsum("nd,nmd->nm", x[open_], self.centres[near])
            own = np.where(old, np.inf, own.clip(0))
            more = near.shape[1]
            new = np.full((n, more), np.inf, d.dtype), np.zeros((n, more), np.int64)
            new[0][open_], new[1][open_] = own, near
            ids, d, done = np.concatenate([ids, new[1]], 1), np.concatenate([d, new[0]], 1), np.concatenate([done, np.zeros((n, more), bool)], 1)

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance) of the centroids within ``ratio`` of the row's nearest one; the beam widens where they fill it."""
        rows, out, beam = np.arange(len(x)), [], self.beam
        while len(rows) and len(self.centres):
            ids, d = self.search(x[rows], beam)
            ok = d <= np.maximum(d[:, :1], NEAR**2) * ratio**2
            full = ok.all(1) & (beam < len(self.centres))
            i, j = np.nonzero(ok & ~full[:, None])
            out.append((rows[i], ids[i, j], np.sqrt(d[i, j])))
            rows, beam = rows[full], beam * 2
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def edge(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`within`, from all centroids by matrix products."""
        d = self.far(x)
        i, c = np.nonzero(d <= np.maximum(d.min(1, keepdims=True), NEAR**2) * ratio**2) if d.size else (np.zeros(0, np.int64),) * 2
        return i, c, np.sqrt(d[i, c])

    def filed(self, x: np.ndarray, boundary: float = BOUNDARY) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each row's posting lists, the nearest centroid's and those at its boundary."""
        i, c, d = self.edge(x, boundary)
        order = np.lexsort((c, d, i))
        i, c, d = i[order], c[order], d[order]
        keep, mine, last = np.zeros(len(i), bool), [], -1
        for k, (row, to, far) in enumerate(zip(i.tolist(), c.tolist(), d.tolist())):
            if row != last:
                last, mine = row, []
            if not mine or ((self.centres[mine] - self.centres[to]) ** 2).sum(1).min() > far * far:
                mine.append(to)
                keep[k] = True
        return i[keep], c[keep]


def once(ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``d`` that repeat an id made one, at its nearest; ids in order where any was repeated."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else order
    return (ids, d) if len(first) == len(ids) else (own[first], np.minimum.reduceat(d[:, order], first, axis=1))


def best(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row of ``d``, by distance, of equals by id."""
    k = min(k, d.shape[1])
    if k < d.shape[1]:
        edge = np.partition(d, k - 1, 1)[:, k - 1 : k]
        at = np.lexsort((np.broadcast_to(ids, d.shape), np.where(d <= edge, d, np.inf)), axis=1)[:, :k] if d.shape[1] <= 64 else _cut(ids, d, edge, k)
    else:
        at = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)
    return ids[at], np.take_along_axis(d, at, 1)


def _cut(ids: np.ndarray, d: np.ndarray, edge: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(d), k), np.int64)
    part = np.argpartition(d, k - 1, 1)[:, :k]
    ties = (d <= edge).sum(1) > k
    sub = np.take_along_axis(d, part, 1)
    out[:] = np.take_along_axis(part, np.lexsort((ids[part], sub), axis=1), 1)
    for i in np.flatnonzero(ties):
        c = np.flatnonzero(d[i] <= edge[i])
        out[i] = c[np.lexsort((ids[c], d[i][c]))[:k]]
    return out


def _exact(rows: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The vectors of the k nearest neighbours, of different ids, of a few queries in the whole table, by one pass: (queries, k, dims), NaN where there are fewer."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, mine = shared.value
        top = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, q.shape[1]), np.float32))] * len(q)
        worst = np.full(len(q), np.inf)  # of k, once there are so many
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                ids, x = b.column(0).slice(lo, 2048).to_numpy(), matrix(b.column(1).slice(lo, 2048))
                d = distances(q, x)
                d[mine[:, None] == ids] = np.inf
                for i in np.flatnonzero(d.min(1) <= worst):
                    near = np.flatnonzero((d[i] <= worst[i]) & (d[i] < np.inf))
                    dd, nn, xx = (np.concatenate(p) for p in zip(top[i], (d[i, near], ids[near], x[near])))
                    o = np.lexsort((nn, dd))
                    o = o[np.sort(np.unique(nn[o], return_index=True)[1])[:k]]
                    top[i] = dd[o], nn[o], xx[o]
                    if len(o) == k:
                        worst[i] = dd[o[-1]]
        for i, (dd, nn, xx) in enumerate(top):
            if len(dd):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dd), i)), pa.array(dd.astype(float)), pa.array(nn), lists(xx)], names=["q", "d", "id", "vec"])

    found = rows.mapInArrow(run, "q bigint, d double, id bigint, vec array<float>")
    found = found.groupBy("q", "id").agg(F.min(F.struct("d", "vec")).alias("x")).select("q", F.struct("x.d", "id", "x.vec").alias("x"))
    lows = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("x")).collect()  # probes * k rows
    out = np.full((len(queries), k, queries.shape[1]), np.nan, np.float32)
    for r in lows:
        for j, x in enumerate(r.x):
            out[r.q, j] = x.vec
    return out


def ratio_for(rows: DataFrame, centroids: Centroids, k: int, recall: float, probes: int) -> float:
    """The distance ratio at which ``recall`` of the probes' true neighbours are in a list that is taken."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(probes).collect()
    if not chosen:
        return 1.0
    q, own = np.array([r.vec for r in chosen], np.float32), np.array([r.id for r in chosen])
    need = []
    for x, near in zip(q, _exact(rows, q, own, k)):
        near = near[~np.isnan(near[:, 0])]
        if len(near):
            ids, d = centroids.search(x[None], centroids.beam)
            far = np.full(len(centroids.centres), np.inf)  # what the graph doesn't find isn't in reach
            far[ids[0]] = np.sqrt(d[0])
            i, c = centroids.filed(near)
            least = np.full(len(near), np.inf)
            np.minimum.at(least, i, far[c])
            need.append(least / max(float(far.min()), NEAR))
    if not need:
        return 1.0
    ratio = float(np.quantile(np.concatenate(need), recall, method="higher")) + 1e-6
    if np.isfinite(ratio):
        return ratio
    centroids.beam *= 2  # neighbours' lists lie beyond the beam
    return ratio_for(rows, centroids, k, recall, probes)


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL, probes: int = PROBES, queries: Column | None = None, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """(id, rank, neighbour_id, distance): the k nearest others of each query, by Euclidean distance, among all rows.

    ``queries``: a condition on ``id``; without it every row is a query. Equal distances: the smaller id first. Ids are
    whole numbers; ids that are none (as numbers or as text), null ids, null vectors, vectors with null, NaN or infinite
    numbers or of an uncommon length take no part. Rows that repeat an id are one point: it is no neighbour of itself,
    and counts once, at its nearest. Fewer than k others: all of them. Empty table: no rows. Other columns are not read,
    so they can't clash.
    """
    spark = df.sparkSession
    ship(spark)
    rows, d = usable(df, id_col, vector_col, "bigint")
    n = rows.count()
    x = sampled(rows, n, sample) if n else np.zeros((0, 1), np.float32)
    centroids = Centroids(kmeans(x, 1, max(1, min(math.ceil(math.sqrt(n) / 4), len(x) // 8)), ROUNDS, balance=0.2)[0], x)
    ratio = ratio_for(rows, centroids, k, recall, probes)
    shared = spark.sparkContext.broadcast(centroids)  # at most an eighth of the sample

    def filing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = np.unique(b.column(2).to_numpy(), return_index=True)[1]  # rows that repeat an id and a vector are one
            for lo in range(0, len(first), 512):
                at = pa.array(np.sort(first)[lo : lo + 512])
                v = matrix(b.column(1).take(at))
                i, c = shared.value.filed(v)
                took = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(c), *(b.column(j).take(at).take(took) for j in (0, 2)), lists(v[i])], names=["list", "id", "h", "vec"])

    filed = Stored(rows.select("id", "vec", F.xxhash64("id", "vec").alias("h")).mapInArrow(filing, "list bigint, id bigint, h bigint, vec array<float>")).df
    sizes, pieces = np.zeros(len(centroids.centres), np.int64), np.ones(len(centroids.centres), np.int64)
    for r in filed.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect():  # two numbers for each list
        sizes[r.list], pieces[r.list] = r.ids, -(-r.n // most)
    first = np.cumsum(pieces) - pieces
    enough = 8 * (k + 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(0).to_numpy()
            cell = first[c] + b.column(2).to_numpy() % pieces[c]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(c), bool)), b.column(1), b.column(3)], names=["list", "query", "id", "vec"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x, ids = matrix(b.column(1).slice(lo, 512)), b.column(0).slice(lo, 512)
                qi, qc, _ = g.within(x, ratio)
                most_ = np.zeros(len(x), np.int64)
                np.maximum.at(most_, qi, sizes[qc])
                few = np.flatnonzero((np.bincount(qi, sizes[qc], len(x)) < min(enough, sizes.sum())) | (most_ <= k))
                if len(few):  # lists too short for k: the nearest ones up to those that hold enough, of which one has k others itself, or all
                    near = g.far(x[few]).argsort(1, kind="stable")
                    before = np.concatenate([np.zeros((len(few), 1), np.int64), np.maximum.accumulate(sizes[near], 1)[:, :-1]], 1)
                    more = (np.cumsum(sizes[near], 1) - sizes[near] < enough) | (before <= k)
                    rest = ~np.isin(qi, few)
                    qi, qc = np.concatenate([qi[rest], np.repeat(few, more.sum(1))]), np.concatenate([qc[rest], near[more]])
                per = pieces[qc]
                at, cell = np.repeat(qi, per), np.repeat(first[qc], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.ones(len(at), bool)), ids.take(pa.array(at)), lists(x[at])], names=["list", "query", "id", "vec"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A list's vectors come first; queries are held against them as they pass."""
        now, ids, own = None, np.zeros(0, np.int64), np.zeros((0, max(d, 1)), np.float32)
        for b in batches:
            at, asks, names, x = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), matrix(b.column(3))
            edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (asks[1:] != asks[:-1]), [True]])) if len(x) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if at[lo] != now:
                    now, ids, own = at[lo], np.zeros(0, np.int64), np.zeros((0, x.shape[1]), np.float32)
                if not asks[lo]:
                    ids, own = np.concatenate([ids, names[lo:hi]]), np.concatenate([own, x[lo:hi]])
                    continue
                centre = own.mean(0) if len(ids) else 0  # near vectors far from 0 would lose their distance in rounding
                mine = own - centre
                for s in range(lo, hi if len(ids) else lo, 512):
                    q = names[s : min(hi, s + 512)]
                    far = distances(x[s : s + len(q)] - centre, mine)
                    far[q[:, None] == ids] = np.inf
                    near, far = best(*once(ids, far), k)
                    m = near.shape[1]
                    ends = pa.array(np.arange(len(q) + 1, dtype=np.int32) * m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q), pa.ListArray.from_arrays(ends, pa.array(near.reshape(-1))), pa.ListArray.from_arrays(ends, pa.array(np.sqrt(far).astype(np.float32).reshape(-1)))], names=["id", "near", "far"])

    made = "list bigint, query boolean, id bigint, vec array<float>"
    chosen = rows if queries is None else rows.where(queries)
    met = filed.mapInArrow(dealt, made).union(chosen.mapInArrow(asked, made)).repartition("list").sortWithinPartitions("list", "query", "id")
    parts = met.mapInArrow(searched, "id bigint, near array<bigint>, far array<float>")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of a query's lists; rows come sorted by query."""
        now, near, far = None, [], []

        def out() -> tuple[np.ndarray, np.ndarray]:
            a, b = np.concatenate(near), np.concatenate(far)
            o = np.lexsort((a, b))
            a, b = a[o], b[o]
            first = np.sort(np.unique(a, return_index=True)[1])
            first = first[np.isfinite(b[first])][:k]
            return a[first], b[first]

        for b in batches:
            ids, n_, f_ = b.column(0).to_numpy(), b.column(1), b.column(2)
            o, a, f = n_.offsets.to_numpy(), n_.values.to_numpy(), f_.values.to_numpy()
            o2 = f_.offsets.to_numpy()
            cols: tuple[list, ...] = ([], [], [], [])
            for r, i in enumerate(ids.tolist()):
                if i != now:
                    if now is not None:
                        p, q = out()
                        for col, v in zip(cols, (np.full(len(p), now), np.arange(1, len(p) + 1), p, q)):
                            col.append(v)
                    now, near, far = i, [], []
                near.append(a[o[r] : o[r + 1]])
                far.append(f[o2[r] : o2[r + 1]])
            if cols[0]:
                yield rows_of(cols)
        if now is not None:
            p, q = out()
            yield rows_of(tuple([v] for v in (np.full(len(p), now), np.arange(1, len(p) + 1), p, q)))

    def rows_of(cols: tuple[list, ...]) -> pa.RecordBatch:
        i, r, p, q = (np.concatenate(c) for c in cols)
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(r.astype(np.int32)), pa.array(p.astype(np.int64)), pa.array(q.astype(np.float64).round(6))], names=["id", "rank", "neighbour_id", "distance"])

    top = parts.repartition("id").sortWithinPartitions("id").mapInArrow(merged, "id bigint, rank int, neighbour_id bigint, distance double")
    return top.withColumnRenamed("id", id_col)
