"""Text normalisation as Column functions; only Unicode normal forms go through Arrow, for values beyond ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEYOND_ASCII = r"[^\x00-\x7F]"
CONTROLS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f�]"
DASHES = "[‐‑‒–—―−]"
BLANKS = r"(?U)\s+"
ENDS = r"(?U)^\s+|\s+$"
NOTHING = ("no data", "none", "not identified")
NUMERIC_NAME = r"(?iU)^\s*[+-]?(?:(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?|inf(?:inity)?|nan)\s*$"
#: Letters that no decomposition reduces to ASCII.
LETTERS = str.maketrans({
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
    "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "‘": "'", "’": "'", "“": '"', "”": '"', "«": "<<", "»": ">>", "–": "-", "—": "--", "…": "...", "×": "x", "°": "deg", "µ": "u"})


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def to_ascii(text: str) -> str:
    """Compatibility decomposition without what is not ASCII then."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def transliterated(text: str) -> str:
    """Latin text in ASCII; other scripts stay as they are, without their marks."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(LETTERS)) if not unicodedata.combining(c))


Form = Callable[[Column], Column]


def by_arrow(form: Callable[[str], str]) -> Form:
    """A form of strings as a Column function; ASCII values pass by without being sent."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(form, na_action="ignore")

    return lambda c: F.coalesce(run(F.when(c.rlike(BEYOND_ASCII), c)), c)


def forms_map(values: Column, form: Callable[[str], str]) -> Column:
    """A map from those of an array of strings that are beyond ASCII to their forms, for use inside lambdas."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [form(x) for x in a])

    some = F.array_distinct(F.filter(values, lambda v: v.rlike(BEYOND_ASCII)))
    return F.map_from_arrays(some, run(some))


def by_map(forms: Column) -> Form:
    return lambda c: F.coalesce(F.try_element_at(forms, c), c)


def same(c: Column) -> Column:
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def _cids(c: Column) -> Column:
    """(cid:N) as the Latin-1 character of 160 to 255, else nothing."""

    def one(text: Column, n: Column) -> Column:
        code = n.try_cast("int")
        return F.replace(text, F.concat(F.lit("(cid:"), n, F.lit(")")), F.when(code.between(160, 255), F.char(code)).otherwise(F.lit("")))

    return F.when(c.contains("(cid:"), F.aggregate(F.regexp_extract_all(c, F.lit(r"\(cid:(\d+)\)"), F.lit(1)), c, one)).otherwise(c)


def normalize_str(c: Column, composed: Form | None = None) -> Column:
    """Composed, without control characters, with plain dashes and single spaces, stripped."""
    c = F.regexp_replace((composed or by_arrow(nfc))(c), CONTROLS, "")
    return F.regexp_replace(strip(F.regexp_replace(_cids(c), DASHES, "-")), BLANKS, " ")


def normalize_value(c: Column, composed: Form | None = None) -> Column:
    """:func:`normalize_str` in lower case; words that say there is nothing become empty."""
    low = F.lower(normalize_str(c, composed))
    return F.when(low.isin(*NOTHING), F.lit("")).otherwise(low)


def normalize_name(c: Column, composed: Form | None = None, ascii_: Form | None = None) -> Column:
    """A column name of a-z, 0-9 and single underscores."""
    c = F.lower((ascii_ or by_arrow(to_ascii))(normalize_str(c, composed)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")


normalize_citation = normalize_str


def transliterate(c: Column, form: Form | None = None) -> Column:
    return (form or by_arrow(transliterated))(c)


def comparable(c: Column, form: Form | None = None) -> Column:
    """Values as alignment compares them: stripped, single spaces, lower case, ASCII."""
    return transliterate(F.lower(F.regexp_replace(strip(c), BLANKS, " ")), form)


def is_semantic_name(c: Column) -> Column:
    """Whether a column name is not a number by Python's grammar."""
    return ~c.rlike(NUMERIC_NAME)


def normalize_punctuation(c: Column) -> Column:
    """Plain dashes and apostrophes, acute vowels joined, no guillemets and no full stop at the end."""
    c = F.regexp_replace(F.regexp_replace(c, DASHES, "-"), "[«»‹›]", "")
    c = F.regexp_replace(c, "[“”\"]", "'")
    for plain, acute in zip("aeiouAEIOU", "áéíóúÁÉÍÓÚ"):
        c = F.replace(c, F.lit(plain + "´"), F.lit(acute))
    c = F.regexp_replace(c, "[‘’´`ʹʻʼʽ′‵]", "'")
    return F.replace(F.regexp_replace(c, r"(?U)^([^\n]*\S{5,})\.$", "$1"), F.lit("…"), F.lit("..."))


def append_value(left: Column, right: Column) -> Column:
    """Two values of one column in one cell: a full stop between them, unless the left one ends with one."""
    joined = F.concat(left, F.when(left.endswith("."), F.lit(" ")).otherwise(F.lit(". ")), right)
    return F.when(left.isNull() | (left == ""), right).when(right.isNull() | (right == ""), left).otherwise(joined)


def conjunction_split(name: Column, language: str = "en") -> Column:
    """(left, right) of a name like a_and_b at its first conjunction inside, else null."""
    words = {"en": ("and", "or"), "es": ("y", "e", "o")}.get(language, ())
    tokens = F.split(name, "_")
    places = F.filter(F.sequence(F.lit(2), F.size(tokens) - 1), lambda i: F.lower(F.element_at(tokens, i)).isin(*words))
    at = F.try_element_at(F.when(F.size(tokens) > 2, places), F.lit(1))
    left, right = F.array_join(F.slice(tokens, F.lit(1), at - 1), "_"), F.array_join(F.slice(tokens, at + 1, F.size(tokens)), "_")
    return F.when(at.isNotNull(), F.struct(left.alias("left"), right.alias("right")))


def split_part(c: Column) -> Column:
    """Without blanks and dashes around it, and without one pair of brackets around all of it."""
    c = F.regexp_replace(c, "^[ -]+|[ -]+$", "")
    return F.when(c.startswith("(") & c.endswith(")"), strip(F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))))).otherwise(c)


def tokens(c: Column) -> Column:
    """Words between white space and commas; # begins a comment."""
    return F.filter(F.split(F.regexp_replace(c, "#[^\n]*", ""), r"(?U)[\s,]+"), lambda w: w != "")
