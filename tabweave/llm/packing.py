"""Packing of documents into sequences of one length by a grouping genetic algorithm on islands.

Documents are dealt by hash into groups of about ``group`` documents; a group is one packing problem, so its cost
is bounded and groups run side by side. A document of more than ``capacity`` words gives full sequences of its
own and a rest, which is packed like any other. Best fit comes first; a group that it solves (no packing has fewer
sequences, and at most the share ``slack`` of all room lies outside the emptiest one) is done. Each other group has
``islands`` populations that evolve apart: crossover injects whole well-filled bins of one parent into the other,
removes the bins that would hold a document twice, and best-fits the documents this displaces; mutation empties a few
of the worst bins and best-fits their documents. Between epochs the best solution of each island migrates to the
next one of its group, through an exchange. The best solution of a group's islands is its plan, but for its emptiest
sequence: the documents of those of all groups are packed once more among themselves, so that no group keeps a
half-empty one.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabweave.llm.rows import Rows
from tabweave.llm.text import slices, utf8, words
from tabweave.session import Stored, ship

CAPACITY, GROUP, ISLANDS, EPOCHS, GENERATIONS, POPULATION, SLACK = 2048, 1024, 3, 3, 16, 6, 0.0005
SHIFT = 24
PIECES = "array<struct<bin_id:bigint,position:int,piece:int,start_word:bigint,n_words:int>>"

Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins, free: list[int]) -> None:
    """Puts ``items``, in their order, each into the fullest bin with room; ``free`` is the room of each bin."""
    room = sorted((f, b) for b, f in enumerate(free) if f)
    for i in items:
        n = sizes[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            f, b = room.pop(at)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
            free.append(capacity)
        free[b] = f - n
        if f > n:
            insort(room, (f - n, b))


def fitness(free: list[int], capacity: int) -> float:
    """Falkenauer's measure: the mean of the squared fills, 1 for full bins alone."""
    return sum(((capacity - f) / capacity) ** 2 for f in free) / len(free) if free else 1.0


class Solution:
    def __init__(self, bins: Bins, free: list[int], capacity: int):
        self.bins, self.free, self.fit = bins, free, fitness(free, capacity)

    def places(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def from_places(places: np.ndarray, sizes: list[int], capacity: int) -> Solution:
    bins: Bins = [[] for _ in range(int(places.max()) + 1 if len(places) else 0)]
    for i, b in enumerate(places.tolist()):
        bins[b].append(i)
    return Solution(bins, [capacity - sum(sizes[i] for i in x) for x in bins], capacity)


def _fresh(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Solution:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5)))
    bins: Bins = []
    free: list[int] = []
    best_fit(order, sizes, capacity, bins, free)
    return Solution(bins, free, capacity)


def _refit(keep: Bins, free: list[int], loose: list[int], sizes: list[int], capacity: int) -> Solution:
    best_fit(sorted(loose, key=lambda i: -sizes[i]), sizes, capacity, keep, free)
    return Solution(keep, free, capacity)


def crossover(a: Solution, b: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """``a`` with some of the better-filled whole bins of ``b`` in place of what they clash with."""
    ranked = sorted(range(len(b.bins)), key=lambda k: b.free[k])
    good = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(good, max(1, len(good) // 3))
    taken = {i for k in chosen for i in b.bins[k]}
    bins, free, loose = [list(b.bins[k]) for k in chosen], [b.free[k] for k in chosen], []
    for items, f in zip(a.bins, a.free):
        if taken.isdisjoint(items):
            bins.append(list(items))
            free.append(f)
        else:
            loose += [i for i in items if i not in taken]
    return _refit(bins, free, loose, sizes, capacity)


def mutate(s: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Empties the two worst bins and two others."""
    n = len(s.bins)
    out = {*sorted(range(n), key=lambda k: -s.free[k])[:2], *rng.sample(range(n), min(2, n))}
    keep = [k for k in range(n) if k not in out]
    return _refit([list(s.bins[k]) for k in keep], [s.free[k] for k in keep], [i for k in out for i in s.bins[k]], sizes, capacity)


def solved(free: list[int], capacity: int, slack: float) -> bool:
    """Whether no packing has fewer bins and the room outside the emptiest bin is at most the share ``slack`` of all bins."""
    rest = sum(free) - max(free, default=0)
    return sum(free) < capacity and rest <= slack * capacity * len(free)


def evolve(sizes: list[int], capacity: int, people: list[Solution], generations: int, population: int, rng: random.Random, slack: float = 0.0) -> list[Solution]:
    """The population after some generations, the best first; the best never gets worse. It ends early once solved."""
    while len(people) < population and not (people and solved(people[0].free, capacity, slack)):
        people.append(_fresh(sizes, capacity, rng, 0.0 if not people else rng.choice((0.05, 0.3, 1.0))))
    people = sorted(people, key=lambda s: -s.fit)[:population]
    for _ in range(generations if len(people) > 1 else 0):
        if solved(people[0].free, capacity, slack):
            break
        child = crossover(*(max(rng.sample(people, 2), key=lambda s: s.fit) for _ in range(2)), sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        if child.fit > people[-1].fit and all(child.fit != s.fit for s in people):
            people[-1] = child
            people.sort(key=lambda s: -s.fit)
    return people


def _epoch(rows: DataFrame, capacity: int, generations: int, population: int, slack: float, epoch: int, seed: int) -> DataFrame:
    """Rows (g, island, sizes, people, guest) to (g, island, sizes, people, fit, done); solutions are bin numbers by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            people_out, fits, done = [], [], []
            for g, island, sizes, people, guest in zip(*cols):
                rng = random.Random(f"{seed}:{epoch}:{g}:{island}")
                start = [from_places(np.frombuffer(x, np.int32), sizes, capacity) for x in [*([guest] if guest else []), *(people or [])]]
                got = evolve(sizes, capacity, start, generations, population, rng, slack)
                people_out.append([s.places(len(sizes)).tobytes() for s in got])
                fits.append(got[0].fit)
                done.append(solved(got[0].free, capacity, slack))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(people_out, pa.list_(pa.binary())), pa.array(fits, pa.float64()), pa.array(done, pa.bool_())],
                names=["g", "island", "sizes", "people", "fit", "done"])

    return rows.select("g", "island", "sizes", "people", "guest").mapInArrow(run, "g bigint, island int, sizes array<int>, people array<binary>, fit double, done boolean")


def _best(problems: DataFrame, capacity: int, islands: int, epochs: int, generations: int, population: int, slack: float, seed: int) -> DataFrame:
    """(g, places) of the best solution of each problem (g, sizes), from islands that send their best one on after each epoch.

    A problem that best fit alone solves has no islands, and one that an island has solved has no more epochs.
    """
    first = problems.select("g", F.lit(-1).alias("island"), "sizes", F.lit(None).cast("array<binary>").alias("people"), F.lit(None).cast("binary").alias("guest"))
    tried = Stored(_epoch(first, capacity, 0, 1, slack, -1, seed))
    found = [tried.df.select("g", "island", "fit", F.try_element_at("people", F.lit(1)).alias("places"))]
    open_ = tried.df.where("not done")
    rows = open_.withColumn("guest", F.try_element_at("people", F.lit(1))).withColumn("people", F.lit(None).cast("array<binary>")).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    for k in range(epochs):
        if rows.isEmpty():
            break
        now = Stored(_epoch(rows.repartition("g", "island"), capacity, generations, population, slack, k, seed)).df
        found.append(now.select("g", "island", "fit", F.try_element_at("people", F.lit(1)).alias("places")))
        ring = Window.partitionBy("g").orderBy("island")  # a row for each island
        last = F.last("elite").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = now.withColumn("any", F.bool_or("done").over(Window.partitionBy("g"))).where("not any")
        rows = rows.withColumn("elite", F.try_element_at("people", F.lit(1))).withColumn("guest", F.coalesce(F.lag("elite").over(ring), last))
    all_ = found[0]
    for x in found[1:]:
        all_ = all_.union(x)
    return all_.groupBy("g").agg(F.max_by("places", F.struct("fit", -F.col("island"))).alias("places"))


def word_counts(df: DataFrame) -> DataFrame:
    """(f, i, id, n): words of each text of (f, i, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(3)):
                at = words(*utf8(b.column(3).slice(lo, hi - lo)))[2]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(np.diff(at))], names=["f", "i", "id", "n"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:3], T.StructField("n", T.LongType())]))


def _placed(spark: SparkSession, items: DataFrame, capacity: int, group: int, islands: int, epochs: int, generations: int, population: int, slack: float, seed: int) -> DataFrame:
    """(f, i, id, pieces) of (f, i, id, n): the pieces of a text and where they are; a text may have two such rows.

    The emptiest bin of each group gives its documents back; they are packed again among themselves, in groups, until
    there is but one group, so that rooms of different groups are filled too.
    """
    done, first, now = [], 0, items.withColumn("p", F.lit(0).cast("bigint"))
    made = T.StructType([*items.schema.fields[:3], T.StructField("rest", T.LongType()), T.StructField("p", T.LongType()), T.StructField("pieces", T._parse_datatype_string(PIECES))])
    kinds = [f.type for f in to_arrow_schema(made)]
    while n := now.count():
        groups = -(-n // group)
        # rows that repeat an id go to different groups by their place in the file
        dealt = now.withColumn("g", F.pmod(F.xxhash64("id", "n", "i"), F.lit(groups)) + first)
        docs = dealt.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "n", "i", "f", "p"))).alias("docs"))  # about ``group`` documents
        docs = Stored(docs.withColumn("sizes", F.transform(F.filter("docs", lambda d: d["n"] % capacity > 0), lambda d: (d["n"] % capacity).cast("int")))).df
        best = _best(docs.where("size(sizes) > 0").select("g", "sizes"), capacity, islands, epochs, generations, population, slack, seed)
        more = groups > 1

        def place(batches: Iterator[pa.RecordBatch], more: bool = more) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g, docs_, places in zip(*(c.to_pylist() for c in b.columns)):
                    where = np.frombuffer(places, np.int32) if places else np.zeros(0, np.int32)
                    fill = np.bincount(where, [d["n"] % capacity for d in docs_ if d["n"] % capacity])
                    back = int(fill.argmin()) if more and len(fill) > 1 and fill.min() < capacity else -1  # at least one bin stays
                    base, filled, at, out = (g << SHIFT) + len(fill), {}, iter(where.tolist()), []
                    for d in docs_:
                        full, rest, pieces = d["n"] // capacity, d["n"] % capacity, []
                        for k in range(d["p"], d["p"] + full):
                            pieces.append({"bin_id": base, "position": 0, "piece": k, "start_word": k * capacity, "n_words": capacity})
                            base += 1
                        if rest and (own := next(at)) != back:
                            filled[own], k = filled.get(own, -1) + 1, d["p"] + full
                            pieces.append({"bin_id": (g << SHIFT) + own, "position": filled[own], "piece": k, "start_word": k * capacity, "n_words": rest})
                            rest = 0
                        out.append((d["f"], d["i"], d["id"], rest, d["p"] + full, pieces))
                    for lo in range(0, len(out), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 10_000]), kinds)], names=made.names)

        placed = Stored(docs.select("g", "docs").join(best, "g", "left").mapInArrow(place, made)).df
        done.append(placed.where("size(pieces) > 0").select("f", "i", "id", "pieces"))
        if not more:
            break
        now, first = placed.where("rest > 0").select("f", "i", "id", F.col("rest").alias("n"), "p"), first + groups
    all_ = done[0] if done else spark.createDataFrame([], T.StructType([*items.schema.fields[:3], made.fields[-1]]))
    for x in done[1:]:
        all_ = all_.union(x)
    return all_


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, slack: float = SLACK, seed: int = 0) -> DataFrame:
    """(bin_id, position, id, piece, start_word, n_words): which words of which document each sequence holds.

    Every word of every text is in one place. Null, empty and blank texts have no words, hence no rows. Ids may be of
    any type that can be ordered; null ids and rows that repeat an id are packed each by itself. Ties in size keep the
    order of ids. Long texts are split as described above. Empty table: no rows. Other columns are not read, so they
    can't clash.
    """
    rows, placed = _pieces(df, id_col, text_col, capacity, group, islands, epochs, generations, population, slack, seed)
    return placed.select("id", F.explode("pieces").alias("x")).select("x.bin_id", "x.position", F.col("id").alias(id_col), "x.piece", "x.start_word", "x.n_words")


def _pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, *how) -> tuple[Rows, DataFrame]:
    """The rows and (f, i, id, pieces) of those with words."""
    ship(df.sparkSession)
    rows = Rows(df)
    counted = Stored(word_counts(rows.select(id=rows.col(id_col), text=rows.col(text_col))).where("n > 0")).df
    placed = _placed(df.sparkSession, counted, capacity, *how)
    return rows, placed


def packed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, slack: float = SLACK, seed: int = 0) -> DataFrame:
    """The plan of :func:`pack` with the ``text`` of each piece, as it stands in the document.

    Each row is packed with its own text, whatever its id is: nothing is looked up by id.
    """
    rows, placed = _pieces(df, id_col, text_col, capacity, group, islands, epochs, generations, population, slack, seed)
    own, text = (df.columns.index(c) for c in (id_col, text_col))

    def run(columns: list[pa.Array], at: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            return
        docs, pieces = columns[text].take(pa.array(hit)), table["pieces"].combine_chunks().take(pa.array(at[hit]))
        ids = columns[own].take(pa.array(hit))
        for lo, hi in slices(docs):
            part = pieces.slice(lo, hi - lo)
            per = pc.list_value_length(part).to_numpy(zero_copy_only=False)
            buf, off = utf8(docs.slice(lo, hi - lo))
            start, end, first = words(buf, off)
            raw, flat = buf.tobytes(), part.flatten()
            cols = {n: pc.struct_field(flat, n) for n in ("bin_id", "position", "piece", "start_word", "n_words")}
            x = np.repeat(first[:-1], per) + cols["start_word"].to_numpy()
            y = x + cols["n_words"].to_numpy() - 1
            out = [raw[start[a] : end[b]].decode("utf-8", "surrogatepass") for a, b in zip(x, y)]
            mine = ids.slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), per)))
            yield pa.RecordBatch.from_arrays([cols["bin_id"], cols["position"], mine, cols["piece"], cols["start_word"], cols["n_words"], pa.array(out, pa.string())], names=[f"c{k}" for k in range(7)])

    plan = [("bin_id", T.LongType()), ("position", T.IntegerType()), (id_col, df.schema[id_col].dataType), ("piece", T.IntegerType()), ("start_word", T.LongType()), ("n_words", T.IntegerType()), ("text", T.StringType())]
    made = T.StructType([T.StructField(f"c{k}", t) for k, (_, t) in enumerate(plan)])
    each = placed.groupBy("f", "i").agg(F.flatten(F.collect_list("pieces")).alias("pieces"))
    return rows.mapped(rows.lookup(each), run, made).toDF(*(n for n, _ in plan))
