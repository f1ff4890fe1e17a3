"""Byte-level BPE encoding and decoding with a minimal acyclic transducer for the frequent pre-tokens.

Pre-tokens are counted over all documents. The most frequent ones, ``lexicon`` at most (a parameter: it bounds the
memory, never the result), are compiled into a minimal acyclic automaton: equal suffixes share states, and the edges' adds
number the words, which makes it a transducer to their ids. It is one file in the shared folder, which Spark hands
to the executors and their workers map into memory. Pre-tokens that it does not hold are merged by rank, exactly.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.text import slices
from tabweave.session import Stored, hadoop_path, shared_dir, ship

VOCABULARY, LEXICON, LONGEST = "/opt/tokenizers/byte_bpe_50k.tiktoken", 65_536, 64
IDS = 1 << 19  # token ids that one pass decodes
EXACT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same where no character is a number but no digit, or white space in one of the two modules alone.
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
_RARE = re.compile("[" + "".join(re.escape(c) for old, new in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")) for c in sorted({*re.findall(old, _ALL)} ^ {*regex.findall(new, _ALL)})) + "\U00010000-\U0010ffff]")
del _ALL


def pretokens(text: str) -> list[str]:
    return (EXACT if _RARE.search(text) else FAST).findall(text)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair with the least rank is merged, the leftmost of equals first, until none has one."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > LONGEST:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 60
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap, for pre-tokens of any length."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(both + parts[k])) is not None:
                heapq.heappush(heap, (r, i, both + parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + both)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + both))
    return [ranks[p] for p in parts if p is not None]


class Transducer:
    """A minimal acyclic automaton over bytes whose adds number the words in sorted order, with the ids of each."""

    ARRAYS = (("key", np.int64), ("to", np.int32), ("add", np.int32), ("final", np.int32), ("offset", np.int64), ("ids", np.int32))

    def __init__(self, **arrays: np.ndarray):
        for name, kind in self.ARRAYS:
            setattr(self, name, arrays[name].astype(kind, copy=False))

    @classmethod
    def build(cls, words: Iterable[bytes], ranks: dict[bytes, int]) -> Transducer:
        """Incrementally from sorted words: what the next word leaves behind is replaced by an equal known state."""
        words = sorted(set(words))
        states: list[tuple[bool, dict[int, int]]] = [(False, {})]
        known: dict[tuple, int] = {}
        path, last = [0], b""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                child, parent, c = path.pop(), path[-1], last[len(path) - 1]
                final, edges = states[child]
                form = (final, tuple(edges.items()))
                if (same := known.setdefault(form, child)) != child:
                    states[parent][1][c] = same

        for word in words:
            depth = 0
            while depth < min(len(word), len(last)) and word[depth] == last[depth]:
                depth += 1
            settle(depth)
            for c in word[depth:]:
                states.append((False, {}))
                states[path[-1]][1][c] = len(states) - 1
                path.append(len(states) - 1)
            states[path[-1]] = (True, states[path[-1]][1])
            last = word
        settle(0)
        number, order, todo = {0: 0}, [0], [0]
        while todo:
            for t in states[todo.pop()][1].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
                    todo.append(t)
        below: dict[int, int] = {}
        cls._below(0, states, below)
        key, to, add = [], [], []
        for s in order:
            final, edges = states[s]
            sum_ = int(final)
            for c, t in sorted(edges.items()):
                key.append(number[s] * 256 + c)
                to.append(number[t])
                add.append(sum_)
                sum_ += below[t]
        ids = [merge(w, ranks) for w in words]
        return cls(
            key=np.array(key, np.int64), to=np.array(to, np.int32), add=np.array(add, np.int32), final=np.array([int(states[s][0]) for s in order]),
            offset=np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1), ids=np.array([i for x in ids for i in x], np.int32))

    @staticmethod
    def _below(state: int, states: list, below: dict[int, int]) -> int:
        """Words from a state on."""
        todo = [state]
        while todo:
            s = todo[-1]
            open_ = [t for t in states[s][1].values() if t not in below]
            if open_:
                todo += open_
            else:
                below[s] = int(states[s][0]) + sum(below[t] for t in states[s][1].values())
                todo.pop()
        return below[state]

    def find(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words, -1 for those it does not hold; all words take a step at a time."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.key):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
        live, state, sum_ = np.flatnonzero(size > 0), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            key = state[live] * 256 + flat[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            live, at = live[hit], at[hit]
            state[live], sum_[live] = self.to[at], sum_[live] + self.add[at]
            depth += 1
            ended = size[live] == depth
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = sum_[done]
            live = live[~ended]
        return out

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, name)).view(np.uint8) for name, _ in self.ARRAYS]
        head = np.array([len(getattr(self, name)) for name, _ in self.ARRAYS], np.int64).tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """On the file as mapped into memory, which all processes of a machine share."""
        raw = np.memmap(path, np.uint8, "r")
        sizes = raw[: 8 * len(cls.ARRAYS)].view(np.int64)
        at, arrays = 8 * len(cls.ARRAYS), {}
        for (name, kind), n in zip(cls.ARRAYS, sizes.tolist()):
            size = n * np.dtype(kind).itemsize
            arrays[name] = raw[at : at + size].view(kind)
            at += size + -size % 8
        return cls(**arrays)


class Encoder:
    """Ids of texts, as packed 32-bit integers; pre-tokens are remembered until there are ``keep``."""

    def __init__(self, lexicon: Transducer, ranks: dict[bytes, int], keep: int = 500_000):
        self.lexicon, self.ranks, self.keep = lexicon, ranks, keep
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [pretokens(t) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        new = [w for w in set().union(*split) if w not in self.known]
        raw = [w.encode("utf-8") for w in new]
        offset, ids, ranks = self.lexicon.offset, self.lexicon.ids, self.ranks
        for w, b, n in zip(new, raw, self.lexicon.find(raw).tolist()):
            self.known[w] = ids[offset[n] : offset[n + 1]].tobytes() if n >= 0 else np.array(merge(b, ranks), np.int32).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


class Decoder:
    """Texts of token ids, many rows at a time: the bytes of all ids are gathered by one index."""

    def __init__(self, ranks: dict[bytes, int]):
        by = {i: b for b, i in ranks.items()}
        self.size = np.array([len(by.get(i, b"")) for i in range(max(by, default=-1) + 1)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(by.get(i, b"") for i in range(len(self.size))), np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise KeyError("an id is outside the vocabulary")
        size = self.size[ids]
        if len(size) and not size.all():
            raise KeyError("an id is outside the vocabulary")
        return size

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the rows that begin and end at ``offsets`` of ``ids``."""
        size = self.sizes(ids)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[ids] - ends[:-1], size)
        at += np.arange(len(at))
        raw = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets]), pa.py_buffer(self.flat[at])])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # some are no UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def frequent(df: DataFrame, text_col: str, size: int = LEXICON) -> list[str]:
    """The most frequent pre-tokens of all texts, sorted: as many counts, from the largest on, as have ``size`` words at most.

    Very long ones and those that occur once stay out. Only the words found and a summary of the counts reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])
            counts.clear()
            return got

        counts: Counter[str] = Counter()
        for b in batches:
            for lo, hi in slices(b.column(0)):
                for t in b.column(0).slice(lo, hi - lo).to_pylist():
                    if t:
                        counts.update(pretokens(t))
                if len(counts) > 400_000:
                    yield out()
        yield out()

    words = df.select(F.col(text_col).alias("t")).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    counted = Stored(words.where((F.octet_length("w") <= LONGEST) & (F.col("n") > 1)))
    cut = least_count(counted.df, size)
    found = sorted(r.w for r in counted.df.where(F.col("n") >= cut).select("w").collect())  # ``size`` at most
    counted.drop()
    return found


def least_count(words: DataFrame, size: int) -> int:
    """The least count ``n`` that at most ``size`` rows reach: by the counts' magnitudes first, then within one of them."""
    scale = F.floor(F.log2("n") * 16)
    above, within = 0, None
    for r in words.groupBy(scale.alias("s")).count().orderBy(F.desc("s")).collect():  # 16 for each doubling of the largest count
        if above + r["count"] > size:
            within = r["s"]
            break
        above += r["count"]
    if within is None:
        return 0
    cut = None
    for r in words.where(scale == within).groupBy("n").count().orderBy(F.desc("n")).collect():  # counts that differ by 4 % at most
        above += r["count"]
        cut = r["n"] + 1 if above > size else cut
        if above > size:
            break
    return cut


def publish(spark: SparkSession, lexicon: Transducer) -> str:
    """Writes the automaton to the shared folder and hands it to the executors; its name there."""
    name = f"tabweave-lexicon-{uuid.uuid4().hex}.bin"
    path, fs = hadoop_path(spark, f"{shared_dir(spark)}/{name}")
    out = fs.create(path)
    out.write(lexicon.to_bytes())
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, lexicon: int = LEXICON) -> DataFrame:
    """(id, n_tokens, ids) for each row of ``df``, the same ids as plain rank merging gives.

    A null text has null ids and a null count, an empty one no ids and 0. Repeated rows and ids are encoded each
    by itself; null ids stay null. Special tokens are ordinary text. Empty table: no rows. Long texts and
    pre-tokens are encoded whole. Other columns are not read, so they can't clash.
    """
    spark = df.sparkSession
    ship(spark)
    ranks = load_ranks(vocabulary)
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary, whatever the corpus
    name = publish(spark, Transducer.build([w.encode() for w in frequent(df, text_col, lexicon)], ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Transducer.mapped(os.path.join(SparkFiles.getRootDirectory(), name)), shared.value)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                col = b.column(1).slice(lo, hi - lo)
                got = encoder(col.to_pylist())
                n = np.fromiter(map(len, got), np.int64, len(got)) // 4
                flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(got))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                none = col.is_null()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pc.if_else(none, None, pa.array(n)), pc.if_else(none, None, lists)], names=["id", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, text): the texts of token ids beside the columns to ``keep``; bytes that are no UTF-8 become replacement characters.

    Null ids give a null text, no ids an empty one; an id outside the vocabulary, or null, is an error.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Decoder(load_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64)
            cum, lo = np.cumsum(size), 0
            while lo < len(size):  # slices of IDS ids, of one row at least
                hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + IDS, "right")))
                part = b.slice(lo, hi - lo)
                ids = part.column(1).flatten()
                if ids.null_count:
                    raise KeyError("an id is null")
                texts = decoder(ids.to_numpy(), np.concatenate([[0], np.cumsum(size[lo:hi])]))
                none = part.column(1).is_null()
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pc.if_else(none, None, texts) if part.column(1).null_count else texts], names=["id", *names, "text"])
                lo = hi

    names = [f"k{j}" for j in range(len(keep))]
    kind = "".join(f", {n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), *(F.col(c).alias(n) for n, c in zip(names, keep)))
    out = rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}{kind}, text string")
    return out.select(F.col("id").alias(id_col), *(F.col(n).alias(c) for n, c in zip(names, keep)), "text")
