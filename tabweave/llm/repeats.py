"""Removal of repeated passages by longest-previous-factor arrays over suffix arrays.

A passage repeats if ``least`` words in a row (runs of non-white-space bytes) also stand earlier, in a document
with a smaller id or earlier in the same one. All such windows of words are found:

1. Each window belongs to the least-hashed run of ``anchor`` words in it, the leftmost of equals. Equal windows
   have equal anchors, and neighbouring windows share theirs, so a row for each stretch of windows with one
   anchor, a few for every ``least`` words, is enough to bring equal windows together.
2. Anchors that occur once go, by an aggregate and a join, so that no anchor is one task's, however often it occurs.
   Stretches with equal words throughout are one repeated text: all but the first are passages whose previous factor
   is the first.
3. The first ones of anchors with different stretches go to suffix arrays, in buckets by anchor. In each bucket
   the stretches, with the words up to the end of their last window, are laid out in corpus order; the suffix
   array comes from prefix doubling, previous and next smaller positions in suffix order are the candidates for
   the earlier match, and the longer common prefix with either is the longest previous factor. Windows start a
   repeated passage where it is at least ``least``. An anchor with more than ``crowd`` different stretches would
   overfill a bucket: its windows are dealt out anew by anchors of twice the length, and so on; an anchor as long as
   the window has one kind of stretch only.
4. The passages of a document are cut from its text: later copies go and the first one stays. Where a text
   overlaps its own copy, what the first copy covers stays too.

Texts aren't exchanged: words of stretches and passages to be cut are looked up by row (see :mod:`tabweave.llm.rows`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.rows import Rows, restored
from tabweave.llm.text import mix, runs_hash, slices, spans_hash, utf8, word_hashes, words
from tabweave.session import Stored, ship

LEAST, ANCHOR, CROWD, BUCKET = 50, 12, 20_000, 400_000


def stretches(h: np.ndarray, at: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor's hash, hash of the words) of each stretch of windows with one anchor."""
    n = len(h) - least + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    runs = mix(runs_hash(h, anchor))
    low = np.uint64((1 << 28) - 1)
    key = (runs & ~low) | np.arange(len(runs), dtype=np.uint64)
    wide, size = least - anchor + 1, 1
    while size * 2 <= wide:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if wide > size:
        key = np.minimum(key[: len(key) - (wide - size)], key[wide - size :])
    owner = (key & low).astype(np.int64)
    valid = doc[:n] == doc[least - 1 :]
    new = np.ones(n, bool)
    new[1:] = (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    ends = np.ones(n, bool)
    ends[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(ends & valid)
    d = doc[first]
    return d, first - at[d], last - at[d], runs[owner[first]], spans_hash(h, first, last + least)


def smaller_neighbours(values: list[int]) -> tuple[list[int], list[int]]:
    """Indices of the nearest smaller value before and after each, -1 where there is none."""
    before, after, stack = [-1] * len(values), [-1] * len(values), []
    for i, x in enumerate(values):
        while stack and values[stack[-1]] > x:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    return before, after


def suffix_levels(text: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... values, until all differ: the last gives the suffix array."""
    levels, size, n = [np.unique(text, return_inverse=True)[1].astype(np.int64)], 1, len(text)
    while n and levels[-1].max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = levels[-1][size:] + 1
        levels.append(np.unique(levels[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and ``b``, pair by pair."""
    n = len(levels[0])
    a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        step = same.astype(np.int64) << k
        length, a, b = length + step, a + step, b + step
    return length


def previous_factors(parts: list[np.ndarray], owned: list[int], least: int) -> tuple[np.ndarray, ...]:
    """Windows with an earlier copy: (part, place, earlier part, earlier place), by longest previous factors.

    ``parts`` are word sequences in corpus order; windows start at the first ``owned`` places of each.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.uint64)
    mine = np.zeros(len(text), bool)
    for k, p in enumerate(parts):
        text[begin[k] : begin[k] + len(p)] = p
        mine[begin[k] : begin[k] + owned[k]] = True
    text = np.unique(text, return_inverse=True)[1].astype(np.int64)
    text[begin + sizes - 1] = len(text) + np.arange(len(parts))  # ends that equal nothing
    levels = suffix_levels(text)
    suffixes = np.argsort(levels[-1])
    suffixes = suffixes[mine[suffixes]]
    near = np.zeros(len(suffixes) + 1, bool)
    if len(suffixes) > 1:
        near[1:-1] = common_prefix(levels, suffixes[:-1], suffixes[1:]) >= least
    suffixes = suffixes[near[:-1] | near[1:]]  # the others share too little with any
    before, after = (np.array(x, np.int64) for x in smaller_neighbours(suffixes.tolist()))
    factor, source = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
    for there in (before, after):
        i = np.flatnonzero(there >= 0)
        got = common_prefix(levels, suffixes[i], suffixes[there[i]])
        better = got > factor[i]
        factor[i[better]], source[i[better]] = got[better], suffixes[there[i[better]]]
    hit = factor >= least
    here, there = suffixes[hit], source[hit]
    order = np.argsort(here)
    here, there = here[order], there[order]
    p, q = np.searchsorted(begin, here, "right") - 1, np.searchsorted(begin, there, "right") - 1
    return p, here - begin[p], q, there - begin[q]


def _joined(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans by (d, s), those of one d that touch made one."""
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], e[order]
    if not len(d):
        return d, s, e
    big = int(e.max()) + 1
    reach = np.maximum.accumulate(d * big + e)
    new = np.ones(len(d), bool)
    new[1:] = d[1:] * big + s[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return d[at], s[at], np.append(reach[at[1:] - 1], reach[-1]) - d[at] * big


def _stretch_rows(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    """(h, g, id, th, i0, i1) of the stretches of texts (id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2)):
                d, i0, i1, h, g = stretches(*word_hashes(b.column(2).slice(lo, hi - lo)), least, anchor)
                at = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(i0.astype(np.int32)), pa.array(i1.astype(np.int32))],
                    names=["h", "g", "id", "th", "i0", "i1"])

    return docs.select("id", "th", "text").mapInArrow(run, _kinds("h bigint, g bigint", docs, "i0 int, i1 int"))


def _kinds(before: str, docs: DataFrame, after: str) -> T.StructType:
    """Fields around those of a document's (id, th)."""
    parse = T._parse_datatype_string
    return T.StructType([*parse(before).fields, docs.schema["id"], docs.schema["th"], *parse(after).fields])


def _looked_up(rows: Rows, keyed: DataFrame, wanted: DataFrame, text_col: str, run, schema: T.StructType) -> DataFrame:
    """``run`` of (texts, id, th, x) for the lists x of ``wanted`` (id, th, x), each list at one row that has its text."""
    found = wanted.join(keyed, ["id", "th"]).groupBy("id", "th").agg(F.min(F.struct("f", "i")).alias("at"), F.first("x").alias("x"))
    place = rows.columns.index(text_col)

    def go(columns: list[pa.Array], at: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            return
        texts, took = columns[place].take(pa.array(hit)), table.take(pa.array(at[hit])).combine_chunks()
        id_, th, x = (took[c].combine_chunks() for c in ("id", "th", "x"))
        for lo, hi in slices(texts):
            yield run(texts.slice(lo, hi - lo), *(c.slice(lo, hi - lo) for c in (id_, th, x)))

    return rows.mapped(rows.lookup(found.select("at.f", "at.i", "id", "th", "x")), go, schema)


def _flat(x: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of lists of structs: the list of each struct, and the fields."""
    per = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    flat = x.flatten()
    return np.repeat(np.arange(len(x)), per), [pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]


def _stretch_words(texts: pa.Array, id_: pa.Array, th: pa.Array, x: pa.Array, least: int) -> pa.RecordBatch:
    """The hashes of the words of the stretches ``x`` (bucket, i0, i1) of each text."""
    h, at = word_hashes(texts)
    doc, (bucket, i0, i1) = _flat(x)
    blobs = [h[at[k] + s : at[k] + e + least].tobytes() for k, s, e in zip(doc, i0, i1)]
    return pa.RecordBatch.from_arrays([pa.array(bucket), id_.take(pa.array(doc)), th.take(pa.array(doc)), pa.array(i0), pa.array(i1), pa.array(blobs, pa.binary())], names=["bucket", "id", "th", "i0", "i1", "words"])


def _split(texts: pa.Array, id_: pa.Array, th: pa.Array, x: pa.Array, least: int, anchor: int) -> pa.RecordBatch:
    """The stretches by longer anchors of the windows i0 to i1 of each of the stretches ``x`` (i0, i1)."""
    h, at = word_hashes(texts)
    doc, (i0, i1) = _flat(x)
    n = i1.astype(np.int64) - i0 + least
    ends = np.concatenate([[0], np.cumsum(n)])
    words_ = h[np.repeat(at[doc] + i0, n) + np.arange(ends[-1]) - np.repeat(ends[:-1], n)]
    d, s, e, a, g = stretches(words_, ends, least, anchor)
    own, first = pa.array(doc[d]), i0[d]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(g.view(np.int64)), id_.take(own), th.take(own), pa.array((first + s).astype(np.int32)), pa.array((first + e).astype(np.int32))], names=["h", "g", "id", "th", "i0", "i1"])


def _factor_spans(rows: DataFrame, least: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("th", "ascending"), ("i0", "ascending")])
        ids, ths, i0, i1 = (table[c].to_numpy() for c in ("id", "th", "i0", "i1"))
        parts = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
        p, at, q, from_ = previous_factors(parts, (i1 - i0 + 1).tolist(), least)
        start, end = i0[p] + at, i0[p] + at + least
        start = np.where((ids[p] == ids[q]) & (ths[p] == ths[q]), np.maximum(start, i0[q] + from_ + least), start)
        ok = start < end
        doc = np.cumsum(np.append([0], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1]))) if len(ids) else np.zeros(0, np.int64)
        first = np.unique(doc, return_index=True)[1]
        d, s, e = _joined(doc[p[ok]].astype(np.int64), start[ok].astype(np.int64), end[ok].astype(np.int64))
        own = table.take(pa.array(first[d]))
        return pa.table([own["id"], own["th"], pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["id", "th", "s", "e"])

    return rows.groupBy("bucket").applyInArrow(run, T.StructType([rows.schema["id"], rows.schema["th"], T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def repeated_spans(rows: Rows, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, anchor: int = ANCHOR, crowd: int = CROWD, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(id, th, s, e): words s to e of the texts (by id and hash of the text) that are later copies, spans may overlap; and (f, i, id, th) of the rows."""
    if not 0 < anchor <= least:
        raise ValueError("anchor must be from 1 to least")
    ship(rows.spark)
    docs = rows.select(id=rows.col(id_col), text=rows.col(text_col)).where("id is not null and text is not null")
    docs = docs.select("f", "i", "id", F.xxhash64("text", F.length("text")).alias("th"), "text")
    keyed = docs.select("f", "i", "id", "th")
    spans, level = [], Stored(_stretch_rows(docs, least, anchor))
    while True:
        often = level.df.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("n > 1").select("h", (F.col("g0") != F.col("g1")).alias("mixed"))
        met = Stored(level.df.join(often, "h"))
        level.drop()
        first = Stored(met.df.groupBy("h", "g", "mixed").agg(F.min(F.struct("id", "th", "i0", "i1")).alias("r"), F.count("*").alias("n")))
        # a row that repeats an id and its text is the same document, not a copy
        own = first.df.where("n > 1").select("h", "g", "r")
        copies = met.df.join(own, ["h", "g"]).where("id != r.id or th != r.th or i0 != r.i0")
        same = (F.col("id") == F.col("r.id")) & (F.col("th") == F.col("r.th"))
        s = F.when(same, F.greatest("i0", F.col("r.i0") + least)).otherwise(F.col("i0"))
        out = Stored(copies.select("id", "th", s.alias("s"), (F.col("i1") + least).alias("e")).where("s < e"))
        spans.append(out.df)
        firsts = first.df.where("mixed").select("h", "r.*")
        kinds = firsts.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.col("i1") - F.col("i0") + 1 + least).alias("size"))
        few, size = kinds.where(f"kinds <= {crowd}"), kinds.groupBy((F.col("kinds") > crowd).alias("many")).agg(F.sum("size")).collect()
        size = dict(map(tuple, size))
        if size.get(False):
            buckets = max(1, -(-size[False] // bucket))
            dealt = firsts.join(few.select("h"), "h", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
            wanted = dealt.groupBy("id", "th").agg(F.collect_list(F.struct("bucket", "i0", "i1")).alias("x"))
            looked = _looked_up(rows, keyed, wanted, text_col, lambda *a: _stretch_words(*a, least), _kinds("bucket bigint", docs, "i0 int, i1 int, words binary"))
            spans.append(Stored(_factor_spans(looked, least)).df)
        if not size.get(True):
            met.drop()
            first.drop()
            return _union(spans), keyed
        anchor = min(least, 2 * anchor)
        many = firsts.join(kinds.where(f"kinds > {crowd}").select("h"), "h", "left_semi")
        wanted = many.groupBy("id", "th").agg(F.collect_list(F.struct("i0", "i1")).alias("x"))
        level = Stored(_looked_up(rows, keyed, wanted, text_col, lambda *a, n=anchor: _split(*a, least, n), _kinds("h bigint, g bigint", docs, "i0 int, i1 int")))
        met.drop()
        first.drop()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def cut(col: pa.Array, per: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[str | None, int]]:
    """Texts without words s to e (``per`` spans for each text in turn), and how many words went."""
    out, k = [], 0
    for i, n in enumerate(per):
        if not n:
            out.append((col[i].as_py(), 0))
            continue
        _, a, b = _joined(np.zeros(n, np.int64), s[k : k + n].astype(np.int64), e[k : k + n].astype(np.int64))
        k += n
        buf, off = utf8(col.slice(i, 1))
        start, _, _ = words(buf, off)
        edge = np.append(start, len(buf))
        raw, keep, last = buf.tobytes(), [], 0
        for x, y in zip(a, b):
            keep.append(raw[last : edge[x]])
            last = edge[y]
        text = b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")
        out.append((text.rstrip(" \t\n\r\f\v") if int(b[-1]) == len(start) else text, int((b - a).sum())))
    return out


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, anchor: int = ANCHOR, crowd: int = CROWD, bucket: int = BUCKET, removed: str = "words_removed") -> DataFrame:
    """``df`` with later copies of passages cut from its texts, and ``removed``, how many words went; all rows and columns stay.

    The white space after a cut passage goes with it, and at the end of a text that before it. A text that is
    all copies becomes empty. Ids may be of any type that can be ordered. Null ids and null texts take no part: such
    rows stay as they are, with 0. Texts of under ``least`` words can't change. Rows that repeat an id and its text are
    one document, and are cut alike; different texts under one id are different documents, in the order of their
    hashes. Empty table: no rows. A column that is named ``removed`` is replaced; no other name matters.
    """
    rows = Rows(df.drop(removed))
    spans, keyed = repeated_spans(rows, id_col, text_col, least, anchor, crowd, bucket)
    lists = spans.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    place = rows.columns.index(text_col)

    def run(columns: list[pa.Array], at: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        gone, col = np.zeros(len(at), np.int64), columns[place]
        hit = np.flatnonzero(at >= 0)
        if len(hit):
            x = table["x"].combine_chunks().take(pa.array(at[hit]))
            _, (s, e) = _flat(x)
            new = cut(col.take(pa.array(hit)), pc.list_value_length(x).to_numpy(zero_copy_only=False), s, e)
            gone[hit] = [n for _, n in new]
            mask = np.zeros(len(at), bool)
            mask[hit] = True
            col = pc.replace_with_mask(col, pa.array(mask), pa.array([t for t, _ in new], col.type))
        cols = [*columns, pa.array(gone)]
        cols[place] = col
        yield pa.RecordBatch.from_arrays(cols, names=[f"c{k}" for k in range(len(cols))])

    out = T.StructType([*rows.schema.fields, T.StructField(removed, T.LongType())])
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(out)])
    return restored(rows.mapped(rows.lookup(lists.join(keyed, ["id", "th"]).select("f", "i", "x")), run, plain), out)
