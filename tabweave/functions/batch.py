"""Cells in Arrow batches: each distinct string of a batch is worked on once, and rows are rebuilt from the results.

The Column functions of :mod:`tabweave.functions.text` say the same for plain string columns; cells go through here,
since a plan that nests those functions in lambdas is long to make and evaluates them again for every use.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.functions import text as X

CELLS = "array<struct<name:string,kind:string,vals:array<struct<value:string,agreement_level:int>>>>"
_CONTROLS, _DASHES, _CID = re.compile(X.CONTROLS), re.compile(X.DASHES), re.compile(r"\(cid:(\d+)\)")
_ODD, _RUNS = re.compile("[^a-z0-9_]"), re.compile("_+")


def _char(m: re.Match) -> str:
    return chr(int(m[1])) if m[1].isascii() and 160 <= int(m[1]) <= 255 else ""


def normalize_str(s: str) -> str:
    if s.isascii() and "(cid:" not in s:
        return " ".join(_CONTROLS.sub("", s).split())
    s = _CONTROLS.sub("", unicodedata.normalize("NFC", s))
    return " ".join(_DASHES.sub("-", _CID.sub(_char, s) if "(cid:" in s else s).split())


def normalize_value(s: str) -> str:
    s = normalize_str(s).lower()
    return "" if s in X.NOTHING else s


def normalize_name(s: str) -> str:
    return _RUNS.sub("_", _ODD.sub("_", X.to_ascii(normalize_str(s)).lower())).strip("_")


def each(col: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """``f`` of each string, nulls stay; each distinct one is worked on once."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    d = col.dictionary_encode()
    return pa.array([f(x) for x in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def _coded(col: pa.Array) -> tuple[list[int], list[str | None]]:
    """A code for each string, and the strings by their codes; null is the last."""
    d = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).dictionary_encode()
    return pc.fill_null(d.indices, len(d.dictionary)).to_pylist(), [*d.dictionary.to_pylist(), None]


class Cells:
    """A column of cells taken apart into flat arrays."""

    def __init__(self, col: pa.Array):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        self.null = col.is_null()
        self.at = _offsets(col)
        flat = col.flatten()
        self.name, self.kind, vals = (pc.struct_field(flat, k) for k in range(3))
        self.val_at = _offsets(vals)
        one = vals.flatten()
        self.value, self.level = (pc.struct_field(one, k) for k in range(2))

    def built(self, name: pa.Array | None = None, value: pa.Array | None = None) -> pa.Array:
        one = pa.StructArray.from_arrays([self.value if value is None else value, self.level], ["value", "agreement_level"])
        vals = pa.ListArray.from_arrays(pa.array(self.val_at, pa.int32()), one)
        flat = pa.StructArray.from_arrays([self.name if name is None else name, self.kind, vals], ["name", "kind", "vals"])
        out = pa.ListArray.from_arrays(pa.array(self.at, pa.int32()), flat)
        return pc.if_else(self.null, pa.scalar(None, out.type), out) if self.null.true_count else out


def _offsets(col: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)


def mapped(cells: Column, f: Callable[[str], str]) -> Column:
    """Cells with ``f`` of each of their strings."""

    @F.arrow_udf(CELLS)
    def run(col: pa.Array) -> pa.Array:
        c = Cells(col)
        return c.built(value=each(c.value, f))

    return run(cells)


def compared(cells: Column) -> Column:
    """(cells, content, empty): normalised cells, a 128-bit hash of what rows are held equal by, and whether no cell has anything.

    The content is names with transliterated normalised values, whatever their order; null, missing and empty differ.
    """

    @F.arrow_udf(f"struct<cells:{CELLS},content:binary,empty:boolean>")
    def run(col: pa.Array) -> pa.Array:
        c = Cells(col)
        value = each(c.value, normalize_value)
        (name, names), (kind, kinds), (plain, plains) = map(_coded, (c.name, c.kind, each(value, X.transliterated)))
        items, at, val_at = list(zip(plain, c.level.to_pylist())), c.at.tolist(), c.val_at.tolist()
        known: dict[tuple, int] = {}  # cells by their codes, each written out once in a batch; rows likewise
        ids = [known.setdefault((n, k, *items[s:e]), len(known)) for n, k, s, e in zip(name, kind, val_at, val_at[1:])]
        texts = [repr((names[n], kinds[k], [(plains[v], level) for v, level in vals])) for n, k, *vals in known]
        digests: dict[tuple, bytes] = {}
        content = []
        for s, e in zip(at, at[1:]):
            row = tuple(ids[s:e])
            if row not in digests:
                digests[row] = hashlib.md5("\n".join(sorted(texts[i] for i in row)).encode("utf-8", "surrogatepass")).digest()
            content.append(digests[row])
        full = np.concatenate([[0], np.cumsum(pc.fill_null(pc.not_equal(value, ""), False).to_numpy(zero_copy_only=False))])
        ends = c.val_at[c.at]
        return pa.StructArray.from_arrays([c.built(value=value), pa.array(content, pa.binary()), pa.array(full[ends[1:]] == full[ends[:-1]])], ["cells", "content", "empty"])

    # Called deterministic, it would be run once more for each filter by one of its fields, below the projection that has it.
    return run.asNondeterministic()(cells)


def empty(cells: Column) -> Column:
    """Whether no cell has a string that isn't empty once normalised."""

    @F.arrow_udf("boolean")
    def run(col: pa.Array) -> pa.Array:
        c = Cells(col)
        full = np.concatenate([[0], np.cumsum(pc.fill_null(pc.not_equal(each(c.value, normalize_value), ""), False).to_numpy(zero_copy_only=False))])
        ends = c.val_at[c.at]
        return pa.array(full[ends[1:]] == full[ends[:-1]])

    return run(cells)


def _appended(left: str | None, right: str | None) -> str | None:
    if not left or not right:
        return right if not left else left
    return left + (" " if left.endswith(".") else ". ") + right


def _text(cell: dict) -> str | None:
    return cell["vals"][0]["value"] if cell["vals"] else None


def _joined(a: dict, b: dict) -> dict:
    kinds = a["kind"], b["kind"]
    if a["kind"] == "null" or (a["kind"] == "str" and _text(a) == ""):
        return {**b, "name": a["name"]}
    if kinds == ("str", "str"):
        return {**a, "vals": [{"value": _appended(_text(a), _text(b)), "agreement_level": None}]}
    return {**a, "vals": a["vals"] + b["vals"]} if kinds == ("list", "list") else a


def renamed_row(cells: list[dict], names: list[str | None]) -> list[dict]:
    """Cells under new names (null drops one); those that share a name are joined, the one that had it first, then in order."""
    found: dict[str, list[list[dict]]] = {}
    for cell, name in zip(cells, names):
        if name is not None:
            found.setdefault(name, [[], []])[cell["name"] != name].append({**cell, "name": name})
    out = []
    for own, others in found.values():
        now, *rest = own + others
        for b in rest:
            now = _joined(now, b)
        out.append(now)
    return out


def _renamed(col: pa.Array, c: Cells, new: list[str | None]) -> pa.Array:
    """Names are replaced at once where rows keep all cells apart, else row by row."""
    at, slow = c.at.tolist(), {}
    for i, (s, e) in enumerate(zip(at, at[1:])):
        own = new[s:e]
        if None in own or len(set(own)) < len(own):
            slow[i] = own
    out = c.built(name=pa.array(["" if n is None else n for n in new], pa.string()))
    if not slow:
        return out
    mask = np.zeros(len(out), bool)
    mask[list(slow)] = True
    made = pa.array([renamed_row(col[i].as_py(), own) for i, own in slow.items()], out.type)
    place = np.arange(len(out))
    place[list(slow)] = len(out) + np.arange(len(slow))
    return pa.concat_arrays([out, made]).take(pa.array(place))


def renamed_by(cells: Column, f: Callable[[str], str | None]) -> Column:
    """Cells under the names that ``f`` gives them."""

    @F.arrow_udf(CELLS)
    def run(col: pa.Array) -> pa.Array:
        c = Cells(col)
        new = each(c.name, f)
        return c.built() if new.equals(c.name) else _renamed(col, c, new.to_pylist())

    return run(cells)


def renamed(cells: Column, mapping: Column, remove: str) -> Column:
    """Cells under the names that a map of each row has for theirs; the name ``remove`` or null drops a cell."""

    @F.arrow_udf(CELLS)
    def run(col: pa.Array, maps: pa.Array) -> pa.Array:
        c = Cells(col)
        new, at = c.name.to_pylist(), c.at.tolist()
        for i, m in enumerate(maps.to_pylist()):
            if m:
                own = dict(m)
                for k in range(at[i], at[i + 1]):
                    to = own.get(new[k], new[k])
                    new[k] = None if to == remove else to
        return _renamed(col, c, new)

    return run(cells, mapping)
