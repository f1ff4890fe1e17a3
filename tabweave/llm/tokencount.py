"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

Pre-tokens are the runs of non-white-space characters, each with the word mark in front. The vocabulary file
has no unigram probabilities, and tokenizers are never trained here, so the piece of rank r gets the
log-probability of Zipf's law over the vocabulary's order, in whole millionths: sums are exact, and of the
segmentations with the best sum the one with the fewest tokens counts. A character without a piece costs a
fixed penalty and counts as its UTF-8 bytes (byte fallback).

The sorted distinct pre-tokens of a stretch of text are the trie: it is walked depth first, and what a prefix
determines (its best score, its count, the vocabulary paths that are still open) is computed once for all
pre-tokens below it. Only the counts at terminals are kept. Everything stays in the scan's own partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.text import slices
from tabweave.session import ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
PENALTY = 10_000_000  # millionths below the rarest piece
STRETCH = 6 << 20  # bytes of text whose new pre-tokens make one trie


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, int]]:
    """(piece, score) of the ordinary pieces of a SentencePiece file; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return [(p, -round(1e6 * (math.log(r + 1) + total))) for r, p in enumerate(pieces)]


UNIT = 1 << 32  # a segmentation is worth its score times this, less its tokens: one number to maximise


def vocabulary_trie(pieces: Iterable[tuple[str, int]]) -> dict:
    """Nested dictionaries by character; what a whole piece is worth is under the empty string."""
    root: dict = {}
    for piece, score in pieces:
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score * UNIT - 1
    return root


def count_sorted(pretokens: list[str], root: dict, unknown: int) -> dict[str, int]:
    """Tokens of each of the sorted, distinct pre-tokens. ``unknown``: score of a character without a piece."""
    single = {c: to[""] for c, to in root.items() if c and "" in to}
    best = [0]  # by depth: what the prefix is worth
    open_: list[list[tuple[dict, int]]] = [[(root, 0)]]  # by depth: vocabulary paths, with the worth of what stands before them
    last, out = "", {}
    for word in pretokens:
        depth, most = 0, min(len(word), len(last))
        while depth < most and word[depth] == last[depth]:
            depth += 1
        del best[depth + 1 :], open_[depth + 1 :]
        paths, top = open_[-1], best[-1]
        for c in word[depth:]:
            alone = single.get(c)
            top += unknown * UNIT - len(c.encode("utf-8", "surrogatepass")) if alone is None else alone
            alive = []
            for node, worth in paths:
                if (to := node.get(c)) is not None:
                    if (piece := to.get("")) is None:
                        alive.append((to, worth))
                    else:
                        if worth + piece > top:
                            top = worth + piece
                        if len(to) > 1:
                            alive.append((to, worth))
            alive.append((root, top))
            best.append(top)
            open_.append(alive)
            paths = alive
        out[word] = -top % UNIT
        last = word
    return out


class Counter:
    """Counts of pre-tokens, remembered until there are ``keep`` of them."""

    def __init__(self, pieces: list[tuple[str, int]], keep: int = 600_000):
        self.root, self.unknown, self.keep = vocabulary_trie(pieces), min(s for _, s in pieces) - PENALTY, keep
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int]]:
        split = [t.split() if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        new = sorted(MARK + w for w in set().union(*split) if w not in self.known)
        self.known.update((w[1:], n) for w, n in count_sorted(new, self.root, self.unknown).items())
        get = self.known.__getitem__
        return [(len(w), sum(map(get, w))) for w in split]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_pretokens, n_tokens), a row for each row of ``df``.

    Null: a null text has null counts; a null id stays null. Empty or blank text: 0 and 0. Repeated rows and
    ids: each row is counted by itself. Empty table: no rows. Other columns are not read, so they can't clash.
    Long texts are counted whole.
    """
    spark = df.sparkSession
    ship(spark)
    pieces = spark.sparkContext.broadcast(load_pieces(vocabulary))  # the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for b in batches:
            ids, col = b.column(0), b.column(1)
            for lo, hi in slices(col, STRETCH):
                texts = col.slice(lo, hi - lo).to_pylist()
                got = counter(texts)
                none = [t is None for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo)] + [pa.array([None if x else g[k] for x, g in zip(none, got)], pa.int64()) for k in (0, 1)],
                    names=["id", "n_pretokens", "n_tokens"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("id", id_col)
