"""What users write in flags and small files: schemas, hints, aliases, page ranges. All of it is for the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

TYPES = ("str", "int", "float", "bool", "scientific_name")


def tokens(text: str) -> list[str]:
    """Words between white space and commas; # begins a comment."""
    return [t for line in text.splitlines() for t in re.split(r"[\s,]+", line.split("#", 1)[0]) if t]


def plain_name(name: str) -> str:
    """:func:`tabweave.functions.text.normalize_name` for a driver's own string."""
    name = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]", "", unicodedata.normalize("NFC", name))
    name = re.sub(r"\(cid:(\d+)\)", lambda m: chr(int(m[1])) if 160 <= int(m[1]) <= 255 else "", name)
    name = re.sub(r"\s+", " ", re.sub("[‐-―−]", "-", name).strip())
    name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub("_+", "_", re.sub("[^a-z0-9_]", "_", name)).strip("_")


def parse_hints(text: str) -> list[str]:
    return [plain_name(t) for t in tokens(text)]


def parse_column_aliases(text: str) -> dict[str, str]:
    """alias:target, by normalised alias; the target <remove> drops the column."""
    out = {}
    for t in tokens(text):
        alias, colon, target = t.partition(":")
        if not colon or not alias or not target:
            raise ValueError(f"not alias:target: {t}")
        out[plain_name(alias)] = target
    return out


@dataclass(frozen=True)
class PaperAlias:
    canonical: str
    offset: int = 0


def parse_paper_aliases(text: str) -> dict[str, PaperAlias]:
    """alias:canonical or alias:canonical:offset."""
    out = {}
    for t in tokens(text):
        parts = t.split(":")
        if len(parts) not in (2, 3) or not parts[0] or not parts[1]:
            raise ValueError(f"not alias:canonical[:offset]: {t}")
        try:
            out[parts[0]] = PaperAlias(parts[1], int(parts[2]) if len(parts) == 3 else 0)
        except ValueError:
            raise ValueError(f"offset is no integer: {t}") from None
    return out


@dataclass(frozen=True)
class ColumnSchema:
    """Ordered (name, type) pairs."""

    columns: tuple[tuple[str, str], ...]

    @classmethod
    def parse(cls, text: str) -> ColumnSchema:
        out = []
        for t in tokens(text):
            name, colon, kind = t.partition(":")
            if not colon:
                raise ValueError(f"not name:type: {t}")
            if kind not in TYPES:
                raise ValueError(f"unknown type: {kind}")
            out.append((name, kind))
        return cls(tuple(out))

    def serialize(self) -> str:
        return "\n".join(f"{n}:{k}" for n, k in self.columns)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    @property
    def types(self) -> dict[str, str]:
        return dict(self.columns)


def parse_page_range(text: str) -> tuple[str, range | None]:
    """path:from:to as the path and its pages, from 1; any other text is a path."""
    m = re.fullmatch(r"(.+):(\d+):(\d+)", text)
    return (m[1], range(int(m[2]), int(m[3]) + 1)) if m else (text, None)
