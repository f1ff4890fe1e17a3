"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A text's shingles are runs of ``shingle`` words, without case and punctuation. Each shingle is hashed once; the
hash's first bits choose a bin and the rest compete for its minimum (one permutation). Empty bins borrow from a
full one that a universal hash of the bin and the attempt chooses (optimal densification). Equal texts are
collapsed first, by 128 bits of hash. Bands of the signature are buckets; each bucket gives edges from its member with
the least number to the others, so a bucket of n texts gives n - 1 candidates, and k texts that share many buckets give
about k, not a star for each bucket. Candidates are verified on the whole signature.

Where a centre turns a member down, its bucket mixes groups, and members that are alike may have had no edge in it. So
the verified edges are joined to connected components, and a mixed bucket whose members aren't all in one component is
compared within, every pair of texts of two components, whatever its size: up to ``block`` texts in one place, a larger
one in pieces, each with each. Two texts that share a bucket and are alike are always connected. Only a bucket of many
components is quadratic. Of each component of all edges the document with the least id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.components import connected_components
from tabweave.llm.rows import Rows, filtered
from tabweave.llm.text import NOT_WORD, mix, runs_hash, slices, spans_hash, word_hashes
from tabweave.session import Stored, ship

BINS, BANDS, SHINGLE, THRESHOLD, BLOCK = 256, 64, 3, 0.5, 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(col: pa.Array, bins: int = BINS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``bins`` minima (uint64) for each text, and which texts have words."""
    h, at = word_hashes(pc.utf8_lower(col), NOT_WORD)
    count = np.diff(at)
    sig = np.full((len(count), bins), _EMPTY, np.uint64)
    if len(h):
        doc = np.repeat(np.arange(len(count)), count)
        runs = runs_hash(h, shingle)
        inside = doc[: len(runs)] == doc[shingle - 1 :] if len(runs) else np.zeros(0, bool)
        short = np.flatnonzero((count > 0) & (count < shingle))  # their one shingle is the whole text
        runs = np.concatenate([runs[inside], spans_hash(h, at[short], at[short + 1])])
        doc = np.concatenate([doc[: len(inside)][inside], short])
        runs = mix(runs)
        place = doc * bins + (runs >> np.uint64(40)).astype(np.int64) % bins
        np.minimum.at(sig.reshape(-1), place, mix(runs ^ np.uint64(0xA5A5A5A5)) >> np.uint64(1))
    return densify(sig, count > 0), count > 0


def densify(sig: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fills each empty bin of the rows marked ``full`` with that of the first full bin its own hashes choose."""
    was = sig == _EMPTY
    row, bin_ = np.nonzero(was & full[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        pick = (mix(bin_.astype(np.uint64) * np.uint64(1000003) + np.uint64(attempt)) % np.uint64(sig.shape[1])).astype(np.int64)
        good = ~was[row, pick]
        sig[row[good], bin_[good]] = sig[row[good], pick[good]]
        row, bin_ = row[~good], bin_[~good]
    return sig


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    flat = np.ascontiguousarray(sig[:, : bands * rows]).reshape(-1)
    i = np.arange(len(sig) * bands) * rows
    if not len(i):
        return np.zeros((0, bands), np.uint64)
    own = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
    out = np.empty((len(sig), bands), np.uint64)
    for lo in range(0, len(sig), 512):
        hi = min(len(sig), lo + 512)
        out[lo:hi] = spans_hash(flat[lo * bands * rows : hi * bands * rows], i[: (hi - lo) * bands], i[: (hi - lo) * bands] + rows).reshape(-1, bands)
    return mix(out ^ own)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of the Jaccard similarity from signatures of one byte a bin."""
    same = (a == b).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _signed(rows: Rows, id_col: str, text_col: str) -> DataFrame:
    """(f, i, id, h1, h2, bands, sig) of each row with an id and a text; texts without words have no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(5)):
                part = b.slice(lo, hi - lo)
                sig, full = signatures(part.column(5))
                bands, low = band_hashes(sig), np.ascontiguousarray((sig & np.uint64(255)).astype(np.uint8))
                n = len(full)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
                lists = pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1).view(np.int64)))
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.array(np.arange(n + 1, dtype=np.int32) * BINS).buffers()[1], pa.py_buffer(low.tobytes())])
                none = pa.array(~full)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pc.if_else(none, None, lists), pc.if_else(none, None, blobs)], names=["f", "i", "id", "h1", "h2", "bands", "sig"])

    src = rows.select(id=rows.col(id_col), text=rows.col(text_col)).where("id is not null and text is not null and text != ''")
    src = src.select("f", "i", "id", F.xxhash64("text", F.length("text")).alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:5], T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]))


def _verified(edges: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Candidate edges (c, n) with whether they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(similarity(x, y) >= threshold)], names=["c", "n", "ok"])

    first, second = sigs.select(F.col("n").alias("c"), F.col("sig").alias("x")), sigs.select("n", F.col("sig").alias("y"))
    return edges.join(first, "c").join(second, "n").select("c", "n", "x", "y").mapInArrow(run, "c bigint, n bigint, ok boolean")


def _stars(rows: DataFrame) -> DataFrame:
    """(b, c, n, m) of the members of each bucket (b, n) but its centre c, with the bucket's size m.

    The centre has the least number, so texts that meet in many buckets have one centre there, and a pair is a candidate
    once, not with each of them. It is found by an aggregate that starts before the exchange, and joined to the members,
    so a bucket of any size is no task of its own.
    """
    own = rows.groupBy("b").agg(F.min("n").alias("c"), F.count("*").alias("m")).where("m > 1")
    return rows.join(own, "b").where("n != c").select("b", "c", "n", "m")


def joined_pairs(groups: np.ndarray, sigs: np.ndarray, threshold: float, split: int = 0) -> list[tuple[int, int]]:
    """Edges that connect all groups of which similar pairs of members lead from one to the other.

    With ``split``, only pairs of a row before it and one from it on are compared. Pairs of one group never are.
    """
    bins, tile, out, up = sigs.shape[1], 64, [], {}
    enough = np.flatnonzero((np.arange(bins + 1) / bins - 1 / 256) / (1 - 1 / 256) >= threshold)
    if not len(enough):
        return out
    first = split or len(groups)
    order = np.concatenate([np.argsort(groups[:first], kind="stable"), first + np.argsort(groups[first:], kind="stable")])
    groups, sigs = groups[order], sigs[order]
    across = np.ascontiguousarray(sigs.T)

    def root(g: int) -> int:
        while up.setdefault(g, g) != g:
            up[g] = g = up[up[g]]
        return g

    for lo in range(0, first, tile):
        hi = min(first, lo + tile)
        there = np.arange(split or lo, len(groups))
        if groups[lo] == groups[hi - 1]:
            there = there[groups[there] != groups[lo]]
        for part in range(0, len(there), BLOCK):
            cols = there[part : part + BLOCK]
            own, other = across[:, lo:hi], across[:, cols[0] : cols[-1] + 1] if cols[-1] - cols[0] + 1 == len(cols) else across[:, cols]
            same, equal = np.zeros((hi - lo, len(cols)), np.uint16), np.empty((hi - lo, len(cols)), bool)
            for at in range(0, bins, 255):  # counts that fit a byte
                count = np.zeros(same.shape, np.uint8)
                for k in range(at, min(bins, at + 255)):
                    np.equal(own[k][:, None], other[k], out=equal)
                    count += equal.view(np.uint8)
                same += count
            x, y = np.nonzero((same >= enough[0]) & (groups[lo:hi, None] != groups[cols]))
            for g, h in np.unique(np.stack([groups[lo + x], groups[cols[y]]], axis=1), axis=0).tolist():
                if root(g) != root(h):
                    up[root(g)] = root(h)
                    out.append((g, h))
    return out


def _joined(met: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) between the groups in each room (b, s, g, sig); if a room has both sides s, those of one with the other."""
    met = met.repartition("b").sortWithinPartitions("b", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, groups, blobs = None, [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            got = joined_pairs(np.array(groups, np.int64), np.frombuffer(b"".join(blobs), np.uint8).reshape(len(groups), -1), threshold, sides.count(0) if sides[-1] else 0) if len(groups) > 1 else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.int64()), pa.array([v for _, v in got], pa.int64())], names=["u", "v"])

        for b in batches:
            for now, s, g, sig in zip(*(c.to_pylist() for c in b.columns)):
                if now != key:
                    yield from out()
                    key, sides, groups, blobs = now, [], [], []
                sides.append(s)
                groups.append(g)
                blobs.append(sig)
        yield from out()

    return met.mapInArrow(run, "u bigint, v bigint")


def _within(rows: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) between the groups of the small mixed buckets (b, n, g), each in one room."""
    return _joined(rows.join(sigs, "n").select("b", F.lit(0).alias("s"), "g", "sig"), threshold)


def _across(rows: DataFrame, sigs: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges (u, v) between the groups of the large mixed buckets (b, n, g, m): pieces of some ``block`` texts, a room for each two.

    A piece by itself has a room of its own. Rooms are named by what makes them, so none is shared.
    """
    cut = rows.join(sigs, "n").withColumn("p", F.ceil(F.col("m") / block)).withColumn("a", F.expr("pmod(xxhash64(n), p)"))
    cut = cut.select("b", "a", "g", "sig", F.explode(F.expr("sequence(0L, p - 1)")).alias("o"))
    room = F.struct("b", F.least("a", "o").alias("x"), F.greatest("a", "o").alias("y"))
    return _joined(cut.select(room.alias("b"), (F.col("a") > F.col("o")).cast("int").alias("s"), "g", "sig"), threshold)


def _edges(texts: DataFrame, threshold: float, block: int) -> tuple[DataFrame, list[Stored]]:
    """(u, v) that connect what verified edges among texts (n, bands, sig) connect, and the tables that they are read from."""
    sigs = texts.select("n", "sig")
    stars = Stored(_stars(texts.select("n", F.explode("bands").alias("b"))))
    told = Stored(_verified(stars.df.select("c", "n").distinct(), sigs, threshold))
    known = Stored(connected_components(told.df.where("ok").select(F.col("c").alias("u"), F.col("n").alias("v"))))
    unlike = stars.df.join(told.df.where("not ok").select("c", "n"), ["c", "n"], "left_semi").select("b").distinct()
    members = stars.df.join(unlike, "b", "left_semi")
    members = members.select("b", "n", "m").union(members.select("b", F.col("c").alias("n"), "m").distinct())
    members = members.join(known.df.withColumnRenamed("node", "n"), "n", "left").select("b", "n", F.coalesce("component", "n").alias("g"), "m")
    several = members.groupBy("b").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x != y").select("b")
    mixed = Stored(members.join(several, "b", "left_semi"))
    parts = [known.df.select(F.col("node").alias("u"), F.col("component").alias("v")), _within(mixed.df.where(f"m <= {block}"), sigs, threshold)]
    large = mixed.df.where(f"m > {block}")
    if not large.isEmpty():
        parts.append(_across(large, sigs, threshold, block))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out, [stars, told, mixed, known]


def _decided(rows: Rows, id_col: str, text_col: str, threshold: float, block: int) -> DataFrame:
    """(f, i, id, keep_f, keep_i, keep_id) of each row of a group or repetition: the row that stays for it."""
    ship(rows.spark)
    signed = Stored(_signed(rows, id_col, text_col))
    same = Stored(signed.df.select("h1", "h2").groupBy("h1", "h2").agg(F.count("*").alias("copies")).withColumn("n", F.monotonically_increasing_id()))  # written once, so numbers stay
    own = Rows(signed.df)
    first = own.select(h1=own.col("h1"), h2=own.col("h2")).groupBy("h1", "h2").agg(F.min(F.struct("f", "i")).alias("x")).join(same.df, ["h1", "h2"]).select("x.f", "x.i", "n")
    texts = Stored(_numbered(own, first))
    edges, kept = _edges(texts.df, threshold, block)
    found = connected_components(edges)
    nodes = same.df.join(found.withColumnRenamed("node", "n"), "n", "left").where("component is not null or copies > 1").select("h1", "h2", F.coalesce("component", "n").alias("g"))
    members = Stored(signed.df.select("f", "i", "id", "h1", "h2").join(nodes, ["h1", "h2"]))
    keep = members.df.groupBy("g").agg(F.min(F.struct("id", "h1", "h2", "f", "i")).alias("k"))
    for x in (*kept, texts):
        x.drop()
    return members.df.join(keep, "g").select("f", "i", "id", "g", F.col("k.f").alias("keep_f"), F.col("k.i").alias("keep_i"), F.col("k.id").alias("keep_id"))


def _numbered(signed: Rows, first: DataFrame) -> DataFrame:
    """(n, bands, sig) of the signed rows that stand for their text and have words."""
    bands, sig = (signed.columns.index(c) for c in ("bands", "sig"))

    def run(columns: list[pa.Array], at: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        hit = np.flatnonzero((at >= 0) & columns[sig].is_valid().to_numpy(zero_copy_only=False))
        if len(hit):
            x = pa.array(hit)
            yield pa.RecordBatch.from_arrays([table["n"].combine_chunks().take(pa.array(at[hit])), columns[bands].take(x), columns[sig].take(x)], names=["n", "bands", "sig"])

    return signed.mapped(signed.lookup(first), run, "n bigint, bands array<bigint>, sig binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, duplicate_of) of each document that a near or exact copy with a smaller id stands for.

    ``duplicate_of`` is the least id of the group, which names it. Ids may be of any type that can be ordered. Null ids
    and null or empty texts take no part. Texts without any letter or digit are grouped only if they are equal. Rows
    that repeat an id and its text are one document. Of different texts under one id, each is compared; a document never
    stands for itself, so such pairs give no row. Ties: the least id stays, and of one id's texts the one with the least
    hash. Empty table: no rows. Other columns are not read, so they can't clash.
    """
    d = _decided(Rows(df), id_col, text_col, threshold, block)
    return d.where("id != keep_id").select(F.col("id").alias(id_col), F.col("keep_id").alias("duplicate_of")).distinct()


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``df`` with one document of each group of near or exact copies; all columns stay as they are, whatever their names.

    Rows with a null id, a null text or an empty text stay. Of rows that repeat an id and its text one stays. Only keys
    of rows are exchanged: texts are read once for the signatures and once for the result.
    """
    rows = Rows(df)
    d = _decided(rows, id_col, text_col, threshold, block)
    return filtered(rows, d.where("f != keep_f or i != keep_i"))
