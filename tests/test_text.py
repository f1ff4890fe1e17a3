"""Scalar functions on small examples."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.functions import coerce, names, scientific
from tabweave.functions import text as X


def one(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    got = one(spark, X.normalize_str, ["  a  b\t\nc ", "é", "x(cid:233)y(cid:7)", "a—b", "\x01z�", "", None])
    assert got == ["a b c", "é", "xéy", "a-b", "z", "", None]
    assert one(spark, X.normalize_value, ["No Data", " NONE", "Not  Identified", "Some", None]) == ["", "", "", "some", None]
    assert one(spark, X.normalize_name, ["Nombre Común (es)", "__A--b__", "ß-Straße", "1.5", None]) == ["nombre_comun_es", "a_b", "strae", "1_5", None]


def test_punctuation(spark):
    got = one(spark, X.normalize_punctuation, ["“a”", "l´arbre", "caf´e", "casa´", "Some words.", "Sp.", "wait…", "«x»", "5′"])
    assert got == ["'a'", "l'arbre", "caf'e", "casá", "Some words", "Sp.", "wait...", "x", "5'"]


def test_numeric_names(spark):
    values = ["0", "1e5", "1_000", " 3 ", "nan", "-Infinity", "name", "1__0", "_1", "0x10", "3d", "", "1.", ".5", "٣"]

    def semantic(v):
        try:
            float(v)
            return False
        except ValueError:
            return True

    assert one(spark, X.is_semantic_name, values) == [semantic(v) for v in values]


def test_coerce(spark):
    assert one(spark, lambda c: coerce.coerce(c, "int"), ["3.7", " -2 ", "1e3", "x", "inf", "1_0", None]) == ["3", "-2", "1000", "x", "inf", "10", None]
    assert one(spark, lambda c: coerce.coerce(c, "float"), ["1e16", "3", "x", None]) == ["1e+16", "3.0", "x", None]
    assert one(spark, lambda c: coerce.coerce(c, "bool"), ["YES", "off", "maybe", None]) == ["True", "False", "maybe", None]
    assert one(spark, coerce.infer_type, ["TRUE", "12", "1.5", "x", None]) == ["bool", "int", "float", "str", "str"]


def test_conjunctions(spark):
    got = one(spark, lambda c: X.conjunction_split(c), ["usual_and_scientific_names", "and_x", "x_or", "plain"])
    assert [g and tuple(g) for g in got] == [("usual", "scientific_names"), None, None, None]


def test_scientific_names(spark):
    got = one(spark, scientific.scientific_name, ["Quercus robur L., 1753", "Prunus avium var. duracina (L.) L.", "Acer campestre / ACER RUBRUM", "", None])
    assert got == ["Quercus robur", "Prunus avium var. duracina", "Acer campestre, Acer rubrum", "", None]


def test_small_languages():
    assert names.tokens("a:str, b # c\nd") == ["a:str", "b", "d"]
    assert names.parse_column_aliases("Nom-Bre:name x:<remove>") == {"nom_bre": "name", "x": "<remove>"}
    assert names.parse_paper_aliases("a:b:3") == {"a": names.PaperAlias("b", 3)}
    s = names.ColumnSchema.parse("name:str n:int")
    assert s.names == ["name", "n"] and names.ColumnSchema.parse(s.serialize()) == s
    assert names.parse_page_range("x.pdf:2:4") == ("x.pdf", range(2, 5)) and names.parse_page_range("x.pdf") == ("x.pdf", None)
    for bad in ("a", "a:what"):
        try:
            names.ColumnSchema.parse(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=20))
def test_names_agree_with_the_drivers(spark, text):
    assert one(spark, X.normalize_name, [text]) == [names.plain_name(text)]
