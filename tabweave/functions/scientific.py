"""Scientific names in canonical form, through a pluggable parser that works on a batch of names at a time."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Parser = Callable[[list[str]], list[str]]
RANKS = {"subsp.", "ssp.", "var.", "f.", "subvar.", "cf.", "aff."}
WORD = re.compile(r"[a-zà-ÿ]+(?:-[a-zà-ÿ]+)*")


def canonical(name: str) -> str:
    """Genus, epithets and ranks, without authors and years; a name that isn't one stays as it is."""
    tokens = name.split()
    genus = re.match(r"[A-Za-zÀ-ÿ]+(?:-[A-Za-zÀ-ÿ]+)*$", tokens[0]) if tokens else None
    if not genus:
        return " ".join(tokens)
    all_upper = name.upper() == name and len(tokens) > 1
    out = [tokens[0].capitalize()]
    rest = iter(tokens[1:])
    for k, tok in enumerate(rest):
        low = tok.lower() if k == 0 and (all_upper or tok.isupper()) else tok
        if low in RANKS:
            nxt = next(rest, "")
            if WORD.fullmatch(nxt):
                out += [low, nxt]
        elif WORD.fullmatch(low) and (k == 0 or out[-1] != out[0]) and low not in ("ex", "et", "in", "de", "van", "von"):
            out.append(low)
        elif low.startswith(("(", "[")) or low[:1].isupper() or low[:1].isdigit():
            continue
    return " ".join(out)


def plain_parser(names: list[str]) -> list[str]:
    return [canonical(n) for n in names]


def gnparser(names: list[str]) -> list[str]:
    """The external program of that name, once for a batch: canonical, else normalised, else the name itself."""
    if not names:
        return []
    said = subprocess.run(["gnparser", "-f", "compact"], input="\n".join(n.replace("\n", " ") for n in names), capture_output=True, text=True, check=True).stdout
    out = []
    for n, line in zip(names, said.splitlines()):
        d = json.loads(line)
        out.append((d.get("canonical") or {}).get("simple") or d.get("normalized") or n)
    return out


def default_parser() -> Parser:
    return gnparser if shutil.which("gnparser") else plain_parser


def scientific_name(c: Column, parser: Parser | None = None) -> Column:
    """Each part between commas and slashes that is a name by itself, parsed and joined by ", ".

    Parts without a letter to begin with, such as years, belong to the author before them and go with it. Each
    distinct name of a batch is parsed once.
    """

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        parse = parser or default_parser()
        parts = {v: [p.strip() for p in re.split(r"[,/]", v) if re.match(r"\s*[^\W\d_]", p)] for v in values.dropna().unique()}
        names = sorted({p for ps in parts.values() for p in ps})
        done = dict(zip(names, parse(names)))
        return values.map(lambda v: ", ".join(done[p] for p in parts[v]) or v, na_action="ignore")

    return run(c)
