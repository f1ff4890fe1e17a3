"""Document quality from a linear-chain conditional random field that labels each line good or bad.

A line's features are shares of kinds of characters and words in it, their bins, and the same of the lines before
and after. Training takes the document's label for all its lines, and maximises the likelihood of the chains with
a penalty on large weights; it sees a bounded sample of labelled documents (``sample`` for each label, those with
the least hashes of their ids), whole. Everything else covers all documents. A document's quality is the mean of
its lines' forward-backward marginals, weighted by their lengths in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.rows import restored
from tabweave.llm.text import BYTE_HASH, slices, spans_hash, utf8, words
from tabweave.session import ship

SAMPLE, KEEP = 2000, 0.5
LINE_BREAK = np.zeros(256, bool)
LINE_BREAK[[10, 13]] = True


def _kind(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


KINDS = [
    _kind(lambda b: b >= 128 or chr(b).isalpha()),
    _kind(lambda b: 65 <= b <= 90),
    _kind(lambda b: 48 <= b <= 57),
    _kind(lambda b: 32 < b < 127 and not chr(b).isalnum()),
    _kind(lambda b: b < 128 and chr(b) in ".,;:?'\"-"),
    _kind(lambda b: b < 128 and chr(b) in "|#$%&*<>{}[]=_~^\\/@+"),
    _kind(lambda b: b == 33),
]
BINS = np.array([0.02, 0.1, 0.25, 0.5, 0.75])


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, bytes by line, offsets of each text's lines); lines without a visible character don't count."""
    buf, off = utf8(col)
    start, end, at = words(buf, off, LINE_BREAK)
    w0, w1, _ = words(buf, off)
    first, stop = np.searchsorted(w0, start), np.searchsorted(w0, end)
    seen = stop > first
    at = np.concatenate([[0], np.cumsum(seen)])[at]
    start, end, first, stop = start[seen], end[seen], first[seen], stop[seen]
    n = len(start)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0), at
    sums = []
    for kind in KINDS:
        c = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kind[buf], out=c[1:])
        sums.append(c[end] - c[start])
    letters, upper, digits, marks, plain, odd, shout = (s.astype(float) for s in sums)
    size, count = (end - start).astype(float), (stop - first).astype(float)
    line = np.repeat(np.arange(n), stop - first)
    inside = np.arange(int((stop - first).sum())) - np.repeat(np.cumsum(stop - first) - (stop - first), stop - first) + np.repeat(first, stop - first)
    h = spans_hash(BYTE_HASH[buf], w0[inside], w1[inside])
    key = np.sort((line.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    kinds = np.bincount((key[new] >> np.uint64(32)).astype(np.int64), minlength=n).astype(float)
    visible = np.maximum(1.0, letters + digits + marks)
    shares = np.stack([upper / np.maximum(1, letters), digits / visible, (marks - plain) / visible, odd / visible, shout / visible, plain / visible, 1 - kinds / count, np.minimum(1, letters / count / 25)], 1)
    logs = np.stack([np.log1p(size) / 8, np.log1p(count) / 6, np.minimum(count, 4) / 4], 1)
    bins = (shares[:, :, None] > BINS).reshape(n, -1).astype(float)
    own = np.concatenate([shares, logs, bins], 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    near = own[:, :11]
    before, after = np.zeros_like(near), np.zeros_like(near)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = near[:-1] * same, near[1:] * same
    edge = np.ones((n, 2))
    edge[1:, 0], edge[:-1, 1] = ~same[:, 0], ~same[:, 0]
    return np.concatenate([np.ones((n, 1)), own, before, after, edge], 1), size, at


FEATURES = 1 + 11 + 8 * len(BINS) + 22 + 2


@dataclass
class Model:
    weights: np.ndarray  # of a good line against a bad one
    change: np.ndarray  # scores of (label, next label)


def chains(score: np.ndarray, change: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: (P(good) by line, log Z by chain, expected label pairs by chain)."""
    n, size = len(at) - 1, np.diff(at)
    order = np.argsort(-size, kind="stable")
    sizes = size[order]
    begin, longest = at[:-1][order], int(sizes[0]) if n else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # chains with a line at that depth
    unary = np.stack([np.zeros(len(score)), score], 1)
    alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(longest):
        i = begin[: active[t]] + t
        alpha[i] = unary[i] if not t else unary[i] + np.logaddexp(alpha[i - 1, :1] + change[0], alpha[i - 1, 1:] + change[1])
    for t in range(longest - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        x = unary[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(change[:, 0] + x[:, :1], change[:, 1] + x[:, 1:])
    full = size > 0
    z = np.zeros(n)
    z[full] = np.logaddexp(*alpha[at[1:][full] - 1].T)
    each = np.repeat(z, size)
    p = np.exp(alpha[:, 1] + beta[:, 1] - each)
    chain = np.repeat(np.arange(n), size)
    i = np.flatnonzero(chain[1:] == chain[:-1])
    pairs = np.exp(alpha[i][:, :, None] + change + (unary[i + 1] + beta[i + 1])[:, None, :] - each[i][:, None, None])
    return p, z, np.stack([np.bincount(chain[i], pairs[:, a, b], n) for a in (0, 1) for b in (0, 1)], 1).reshape(n, 2, 2)


def fit(x: np.ndarray, at: np.ndarray, labels: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> Model:
    """Penalised maximum likelihood by Adam over chains whose lines all have their document's label."""
    n, size = len(labels), np.diff(at)
    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    y = np.repeat(labels.astype(float), size)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    told = np.zeros((n, 2, 2))
    told[np.arange(n), labels, labels] = np.maximum(0, size - 1)
    weight = balance / np.maximum(1, size)  # a long document counts as much as a short one
    for step in range(1, steps + 1):
        p, _, pairs = chains(x @ theta[:-4], theta[-4:].reshape(2, 2), at)
        g = np.concatenate([x.T @ ((p - y) * np.repeat(weight, size)), ((pairs - told) * weight[:, None, None]).sum(0).ravel()]) + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def score(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality, lines, bad lines) of each text; a text without lines has quality 0."""
    x, size, at = line_features(col)
    p = chains(x @ model.weights, model.change, at)[0] if len(x) else np.zeros(0)
    sums = [np.concatenate([[0.0], np.cumsum(a)]) for a in (p * size, size, p < 0.5)]
    good, all_, bad = (s[at[1:]] - s[at[:-1]] for s in sums)
    return np.clip(good / np.maximum(all_, 1), 0, 1), np.diff(at), bad.astype(np.int64)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model, from the texts of at most ``sample`` ids for each label; None unless both labels have a text.

    Labels other than 0 and 1, null ids and ids with two labels are left out, and so are texts without lines. Ids may
    be of any type that can be ordered; those of ``labels`` are cast to the type that ``df`` has.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType
    ids = labels.select(F.col(id_col).try_cast(kind).alias("id"), F.col(label_col).try_cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    chosen = ids.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(sample).union(ids.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(sample)).select("id", "y")
    rows = texts.join(F.broadcast(chosen), "id")  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                x, _, at = line_features(b.column(1).slice(lo, hi - lo))
                x = x.astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([x[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())], names=["id", "y", "x"])

    got = sorted((r for r in rows.select("id", "text", "y").mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])).collect() if r.x), key=lambda r: (r.id, bytes(r.x)))
    y = np.array([r.y for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    return fit(np.concatenate(parts).astype(float), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), y)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(id, quality, n_lines, n_bad_lines, good) for each row of ``df``; good from a quality of ``keep`` on.

    Null, empty and blank texts have quality 0 and are not good. Repeated rows and ids are judged each by itself;
    null ids are judged like any other. Without labelled texts of both kinds nothing can be learnt: quality is
    then null and every row good. Empty table: no rows. Other columns are not read, so they can't clash.
    """
    model = train(df, labels, id_col, text_col, label_col, sample)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                part = b.column(1).slice(lo, hi - lo)
                q, n, bad = score(shared.value, part) if shared.value else (None, np.diff(line_features(part)[2]), np.zeros(hi - lo, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.nulls(hi - lo, pa.float64()) if q is None else pa.array(q), pa.array(n), pa.array(bad), pa.array(np.ones(hi - lo, bool) if q is None else q >= keep)],
                    names=["id", "quality", "n_lines", "n_bad_lines", "good"])

    made = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("quality", T.DoubleType()), T.StructField("n_lines", T.LongType()), T.StructField("n_bad_lines", T.LongType()), T.StructField("good", T.BooleanType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, made).toDF(id_col, *made.names[1:])


def drop_low_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of ``df`` that :func:`classify` calls good, as they are.

    Null, empty and blank texts go; null and repeated ids, repeated rows, long texts and ties in quality make no
    difference to a row's own verdict. Without labelled texts of both kinds all rows stay. All columns stay, whatever
    their names. Empty table: no rows.
    """
    model = train(df, labels, id_col, text_col, label_col, sample)
    if model is None:
        return df
    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(place)):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(score(shared.value, part.column(place))[0] >= keep))

    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(df.schema)])
    return restored(df.toDF(*plain.names).mapInArrow(run, plain), df.schema)
