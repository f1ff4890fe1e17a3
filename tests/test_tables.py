"""Table files from folder to folder: loading, merging, cleaning, alignment, shapes, statistics, sinks, streaming, command line."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tabweave import cli
from tabweave.functions import cells as C
from tabweave.operators import align, clean, dedupe, merge, shape, stats, validate, viewer
from tabweave.plans.merging import merge_directories
from tabweave.plans.settings import MergeSettings
from tabweave.session import spread
from tabweave.sources import documents, sinks, tables
from tabweave.streaming.ingest import ingest



def resultset(folder, files, uuid=None, reader=None):
    folder.mkdir(parents=True, exist_ok=True)
    for name, doc in files.items():
        (folder / f"{name}.tables.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    if uuid:
        (folder / "tables.metadata.json").write_text(json.dumps({"uuid": uuid, "reader": reader}))
    return str(folder)


def table(*rows, page=1):
    return {"rows": list(rows), "page": page}


def doc(*tables_, citation=None, **more):
    return {"tables": list(tables_), "citation": citation, **more}


def merged(spark, *paths, **settings):
    out = merge_directories(spark, MergeSettings(paths=list(paths), **settings))
    return {r.paper: json.loads(r.doc) for r in out.collect()}


def rows_of(d, t=0, f=0):
    return d["tables"][t]["table_fragments"][f]["rows"]


def test_merge_folders(spark, tmp_path):
    a = resultset(tmp_path / "a", {"p": doc(table({"Family": "Apidae", "Scientific Name": "Apis  mellifera"}, {"Family": "", "Scientific Name": None}, {"Family": "Vespidae", "Scientific Name": "Vespa"}), citation="A – B"), "only": doc(table({"x": "1"}))}, "ua", "pdfplumber")
    b = resultset(tmp_path / "b", {"p": doc(table({"scientific_name": "APIS MELLIFERA", "family": "apidae"}, {"scientific_name": "Bombus", "family": "Apidae"})), "none": doc()}, "ub", "camelot")
    got = merged(spark, a, b)
    assert sorted(got) == ["only", "p"]
    assert rows_of(got["p"]) == [
        {"scientific_name": "apis mellifera", "family": "apidae", "agreement_level_": 2, "sources_": ["ua", "ub"], "row_": 0},
        {"family": "vespidae", "scientific_name": "vespa", "agreement_level_": 1, "sources_": ["ua"], "row_": 1},
        {"scientific_name": "bombus", "family": "apidae", "agreement_level_": 1, "sources_": ["ub"], "row_": 1},
    ]
    assert got["p"]["citation"] == "A - B"
    three = merged(spark, a, b, a, agreement_method="distinct-readers")
    assert [r["agreement_level_"] for r in rows_of(three["p"])] == [2, 1, 1]


def test_offsets_aliases_and_list_cells(spark, tmp_path):
    a = resultset(tmp_path / "a", {"long-name": doc({"table_fragments": [table({"x": "1"}, page=10), table({"x": [{"value": "Z", "agreement_level": 2}]}, page=11)]})}, "ua")
    b = resultset(tmp_path / "b", {"short": doc({"table_fragments": [table({"x": 1}, page=13), table({"x": "q"}, page=14)]})}, "ub")
    got = merged(spark, a, b, paper_aliases="long-name:short:3")["short"]
    frags = got["tables"][0]["table_fragments"]
    assert [f["page"] for f in frags] == [10, 11] and frags[0]["rows"][0]["agreement_level_"] == 2
    assert [r["x"] for r in frags[1]["rows"]] == [[{"value": "z", "agreement_level": 2}], "q"]


def fold(sources):
    """Rows merged one source after the other, by ordinal and value."""
    out = []
    for s, rows in enumerate(sources):
        for k, v in enumerate(rows):
            same = [m for m in out if m["k"] == k and m["v"] == v]
            if same:
                same[0]["n"] += 1
                same[0]["s"].append(s)
            else:
                out.append({"k": k, "v": v, "n": 1, "s": [s]})
    return sorted(out, key=lambda m: (m["k"], m["s"][0]))


def test_merge_equals_a_fold(spark):
    rng = random.Random(5)
    cases = [[[rng.choice("abc") for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 5))] for _ in range(300)]
    flat = [(c, s, k, v) for c, case in enumerate(cases) for s, rows in enumerate(case) for k, v in enumerate(rows)]
    df = spark.createDataFrame(flat, "c int, source_ord int, row_ int, content string").withColumn("uuid", F.col("source_ord").cast("string")).withColumn("agreement_level_", F.lit(1))
    got = {}
    for r in merge.merge_rows(df, ["c"], cells=None).orderBy("c", "row_", "first_src").collect():
        got.setdefault(r.c, []).append({"k": r.row_, "v": r.content, "n": r.agreement_level_, "s": [int(x) for x in r.sources_]})
    assert got == {c: fold(case) for c, case in enumerate(cases) if any(case)}


def test_rows_are_compared_once(spark):
    rows = spark.createDataFrame([("p", s, 0, 0, 1, k, v, "X") for s, vs in enumerate([["Ábc", "", "b"], [" ABC ", None, "b"]]) for k, v in enumerate(vs)], "paper string, source_ord int, table_idx int, fragment_idx int, page int, pos int, a string, b string")
    rows = rows.select("*", C.from_columns("a", "b").alias("cells")).withColumn("agreement_level_", F.lit(1)).drop("a", "b")
    fragments = rows.select("paper", "source_ord", "table_idx", "fragment_idx", "page").distinct()
    files = fragments.select("paper", "source_ord", F.col("source_ord").cast("string").alias("uuid"), F.lit(0).alias("page_offset"))
    _, out = merge.merge_fragments(files, fragments, rows)
    got = sorted((r.row_, r.agreement_level_, tuple(v.value for v in r.cells[0].vals)) for r in out.collect())
    assert got == [(0, 2, ("ábc",)), (1, 1, ()), (1, 1, ("",)), (2, 2, ("b",))]
    assert out._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1


def test_cleaning_settings(spark, tmp_path):
    rows = [{"0": "Table 1. Species", "1": ""}, {"0": "Name", "1": "Count"}, {"0": "1. apis", "1": "10"}, {"0": "2. bombus", "1": None}, {"0": "", "1": "no data"}, {"0": "3. vespa", "1": "7.5"}]
    a = resultset(tmp_path / "a", {"p": doc(table(*rows))}, "ua")
    got = merged(spark, a, column_names_hints="name", hints_column_alignment="safe", remove_header_rows=True, strip_leading_row_numbers=True, schema="count:int name:str", order_schema_columns=True, coerce_schema_column_types=True)
    assert [(list(r)[:2], r["name"], r["count"]) for r in rows_of(got["p"])] == [(["count", "name"], "1. apis", "10"), (["count", "name"], "2. bombus", None), (["count", "name"], "3. vespa", "7")]
    got = merged(spark, a, column_aliases="0:name 1:<remove>", only_semantic_columns=True)
    assert all(list(r)[0] == "name" and "1" not in r for r in rows_of(got["p"]))
    assert merged(spark, a, schema="other:str", filter_schema_columns=True)["p"]["tables"] == []


def test_jaccard_across_sources(spark, tmp_path):
    names = [f"species {k}" for k in range(20)]
    a = resultset(tmp_path / "a", {"p": doc(table(*({"name": n, "area": str(k)} for k, n in enumerate(names))))}, "ua")
    b = resultset(tmp_path / "b", {"p": doc(table(*({"1": n.upper(), "0": str(k)} for k, n in enumerate(names))))}, "ub")
    got = rows_of(merged(spark, a, b, jaccard_column_alignment=True)["p"])
    assert len(got) == 20 and all(r["agreement_level_"] == 2 and set(r) >= {"name", "area"} for r in got)
    assert len(rows_of(merged(spark, a, b)["p"])) == 40


def test_greedy_equals_a_loop(spark):
    rng = random.Random(6)
    cases = [[(s, t, rng.choice([0.5, 0.6, 0.7])) for s in range(rng.randint(1, 4)) for t in range(rng.randint(1, 4))] for _ in range(150)]
    df = spark.createDataFrame([(c, s, t, f"s{s}", f"t{t}", x) for c, case in enumerate(cases) for s, t, x in case], "c int, source_ord int, target_ord int, source string, target string, score double")
    got = {}
    for r in align.greedy_match(df, ["c"]).collect():
        got.setdefault(r.c, set()).add((r.source, r.target, r.score))
    for c, case in enumerate(cases):
        want = set()
        for s, t, x in sorted(case, key=lambda m: (-m[2], m[0], m[1])):
            if all(w[0] != f"s{s}" and w[1] != f"t{t}" for w in want):
                want.add((f"s{s}", f"t{t}", x))
        assert got[c] == want


def test_compaction_bridges_an_empty_fragment(spark, tmp_path):
    a = resultset(tmp_path / "a", {"p": doc(table({"x": "1"}, page=1), table(page=1), table({"x": "2"}, page=2), table({"y": "3"}, page=3), {"table_fragments": []}, table({"y": "4"}, page=4))}, "ua")
    found = tables.read_resultsets(spark, [a])
    t, f, r = shape.compact_fragments(found.tables, found.fragments, found.rows, ["paper", "source_ord"])
    assert sorted((x.table_idx, x.fragment_idx, x.page) for x in f.collect()) == [(0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 0, 3), (3, 0, 4)]
    assert t.count() == 4 and r.count() == 4


def test_rename_joins_cells(spark):
    df = spark.createDataFrame([(1, "a", None, "b.", "")], "k int, a string, b string, c string, d string").select("k", C.from_columns("a", "b", "c", "d").alias("cells"))
    m = spark.createDataFrame([("a", "c"), ("b", "d")], "source string, target string")
    got = align.apply_mapping(df, m, []).select(C.names(F.col("cells")).alias("n"), C.first_text(C.get(F.col("cells"), "c")).alias("c")).first()
    assert got.n == ["c", "d"] and got.c == "b. a"


def test_splits_and_reversals(spark):
    assert clean.best_split("honey bee Apis mellifera", "honey_bee", "apis_mellifera", clean.ngram_embedder) == ("honey bee", "Apis mellifera")
    df = spark.createDataFrame([(0, "eeb yenoh"), (1, "tna der")], "pos int, v string").select(F.lit(1).alias("f"), "pos", C.from_columns("v").alias("cells"))
    words = spark.createDataFrame([("honey",), ("bee",), ("ant",)], "word string")
    assert sorted(r.t for r in clean.reverse_values(df, ["f"], words).select(C.first_text(F.col("cells")[0]).alias("t")).collect()) == ["honey bee", "red ant"]


def test_statistics(spark, tmp_path):
    d = doc(table({"x": "1", "y": "a", "row_": 0, "agreement_level_": 2}, {"x": "1", "y": "b", "row_": 0}, {"x": "2", "row_": 1}))
    a = resultset(tmp_path / "a", {"p": d, "q": doc()})
    found = tables.read_resultsets(spark, [a])
    per = stats.paper_stats(found.files, found.tables, found.fragments, found.rows)
    p, q = stats.sorted_stats(per, "desc").collect()
    assert (p.paper, p.tables, p.rows, p.unique_rows, p.columns, p.rows_with_agreement, p.rows_in_shared_groups, p.rows_with_shared_values) == ("p", 1, 3, 2, 2, 1, 2, 2)
    assert q.tables == 0 and q.agreement_percentage is None and [r.pdf for r in stats.empty_papers(per).collect()] == ["q.pdf"]
    total = stats.global_stats(per).first()
    assert (total.papers, total.rows) == (2, 3) and round(total.global_agreement_percentage, 2) == 33.33
    assert {r.name: r.type for r in stats.unique_columns(found.rows, ["paper", "table_idx"]).collect()} == {"x": "int", "y": "str"}
    assert "Papers: 2" in stats.format_stats(total.asDict(), [p.asDict(), q.asDict()], {"x": "int"})


def test_validation():
    assert validate.problems(json.dumps(doc(table({"x": "1", "y": None, "z": [{"value": "a", "agreement_level": 1}]})))) == []
    assert validate.problems("{")[0].startswith("malformed") and validate.problems(None)[0].startswith("malformed")
    for bad in ({"tables": []}, doc({"rows": []}), doc(table({"x": {}})), doc(table({"x": [{"value": 1}]})), doc(metadata={}), doc(table({"row_": "1"}))):
        assert validate.problems(json.dumps(bad)), bad
    assert validate.problems(json.dumps(doc(table({"x": 1})))) == [] and validate.problems(json.dumps(doc(table({"x": 1}))), strict=True)


def test_malformed_files(spark, tmp_path):
    a = resultset(tmp_path / "a", {"p": doc(table({"x": "1"})), "bad": "{"})
    with pytest.raises(Exception, match="malformed"):
        tables.read_resultsets(spark, [a]).rows.collect()
    assert tables.read_resultsets(spark, [a], strict=False).rows.count() == 1


def test_curated_outputs_stay(spark, tmp_path):
    a = resultset(tmp_path / "a", {"p": doc(table({"x": "1"})), "q": doc(table({"x": "2"}))}, "ua")
    out = tmp_path / "out"
    s = MergeSettings(paths=[a])
    merge_directories(spark, s, str(out))
    own = json.loads((out / "p.tables.json").read_text())
    own["metadata"] = {"filename": "p.pdf", "curations": [{"curator": "me"}]}
    (out / "p.tables.json").write_text(json.dumps(own))
    (out / "q.tables.json").write_text("broken")
    merge_directories(spark, s, str(out))
    assert json.loads((out / "p.tables.json").read_text()) == own and json.loads((out / "q.tables.json").read_text())["tables"]
    merge_directories(spark, s, str(out), force=True)
    assert "metadata" not in json.loads((out / "p.tables.json").read_text())
    meta, settings = tables.read_with_settings(str(out))
    assert meta["agreement_method"] == "simple-count" and meta["sources"][0]["uuid"] == "ua" and settings["paths"] == [a]


def test_names(spark):
    assert dedupe.settled_names(["a.pdf", "a.pdf", "a_1.pdf", "a.pdf", "b", "b"]) == ["a.pdf", "a_1.pdf", "a_1_1.pdf", "a_2.pdf", "b", "b_1"]
    rng = random.Random(7)
    names = [rng.choice(["a", "a_1", "a_1_1", "b", "c"]) + rng.choice([".pdf", ""]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "pos int, candidate string")
    assert [r.final_name for r in dedupe.resolve_names(df).orderBy("pos").collect()] == dedupe.settled_names(names)


def test_reading_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"page": k, "rows": [["Name", "N"], [f"a{k}\nb", "1"]]} for k in (1, 2, 3)]))
    (tmp_path / "bad.json").write_text("{")
    files = documents.read_files(spark, [f"{tmp_path}/d.json:2:3", f"{tmp_path}/bad.json"])
    got = documents.read_tables(files, documents.READERS["json"], ["name"]).collect()
    assert sorted((r.page, r.names[0], r.vals[0]) for r in got if not r.error) == [(2, "Name", "a2\nb"), (3, "Name", "a3\nb")]
    assert [r.path.rsplit("/")[-1] for r in got if r.error] == ["bad.json"]
    m = documents.TableMapping.parse(json.dumps({"tables": [{"title": "t", "header_mode": "all_pages", "first_page": 1, "last_page": 2, "column_mappings": [{"from_column_number": 1, "to_column_name": "How Many"}]}]}))
    mapped = documents.read_tables(files.where("path like '%/d.json'"), documents.READERS["json"], (), m).collect()
    assert sorted((r.page, tuple(r.names), tuple(r.vals)) for r in mapped) == [(1, ("how_many",), ("1",)), (2, ("how_many",), ("1",))]
    assert documents.page_batches([1, 2, 3], 2) == [[1, 2], [3]]


def test_shared_values_equal_a_loop(spark):
    rng = random.Random(8)
    value = lambda: rng.choice(["a", " a ", "b", "c", "", " ", None])
    rows = [(rng.choice(["t", "u", None]), k, rng.choice([0, 1, 2, None]), [(n, "list", [(value(), 1) for _ in range(rng.randint(0, 3))]) for n in rng.sample("xyz", rng.randint(0, 2))]) for k in range(60)]
    df = spark.createDataFrame(rows, f"t string, pos int, row_ int, cells {C.CELLS}")
    of = {k: {(n, v.strip()) for n, _, vals in cells for v, _ in vals if v and v.strip()} for _, k, _, cells in rows}
    want = {}
    for t, k, g, _ in rows:
        others = [j for u, j, h, _ in rows if (u, h) == (t, g) and j != k and g is not None]
        n, hit = want.get(t, (0, 0))
        want[t] = n + bool(others), hit + any(of[k] & of[j] for j in others)
    got = stats.shared_values(df, ["t"])
    assert {r.t: (r.rows_in_shared_groups, r.rows_with_shared_values) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()


def test_paper_stats_in_one_aggregate(spark):
    papers = spark.createDataFrame([("p",), ("none",)], "paper string")
    tables = spark.createDataFrame([("p", 0), ("p", 1), ("other", 0)], "paper string, table_idx int")
    rows = spark.createDataFrame([("p", 0, 0, 0, 2, "a", ""), ("p", 0, 1, 0, None, "a", "b"), ("p", 0, 2, None, 1, None, " "), ("p", 1, 0, 1, 1, "a", "c")], "paper string, table_idx int, pos int, row_ int, agreement_level_ int, x string, y string")
    rows = rows.select("*", C.from_columns("x", "y").alias("cells"))
    got = stats.paper_stats(papers, tables, tables.where("paper = 'p'"), rows)
    assert {r.paper: tuple(r)[1:] for r in got.collect()} == {"p": (2, 2, 4, 2, 2, 1, 2, 2, 25.0, 25.0, 100.0), "none": (0,) * 8 + (None,) * 3}
    assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()


def test_pairs_need_no_aggregate(spark):
    df = spark.createDataFrame([(c, 0, v, s) for c in "ab" for v, n in (("x", 5), ("y", 2), ("z", 1)) for s in range(n)], "c string, row_ int, content string, source_ord int")
    got = merge.merge_pairwise(df, ["c"])
    assert sorted(tuple(r)[2:] for r in got.where("c = 'a'").collect()) == [("x", 0, 2, 0), ("x", 1, 2, 2), ("x", 2, 1, 4), ("y", 0, 2, 0), ("z", 0, 1, 0)] and got.count() == 10
    assert "Aggregate" not in got._jdf.queryExecution().sparkPlan().toString()


def test_pieces_follow_the_input(spark, tmp_path):
    spark.range(0, 400_000, 1, 1).select("id", F.xxhash64("id").alias("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df, "id", size=1 << 18).rdd.getNumPartitions() >= 12
    assert spread(df.limit(5), "id", size=1 << 40).rdd.getNumPartitions() == 4


def test_documents_share_arrow_batches(spark):
    rows = [("d", 0, 1, k, ["a"], ["x" * 10], None) for k in range(20_000)]
    assert [b.num_rows for b in documents.packed(rows)] == [8192, 8192, 3616]
    assert [b.num_rows for b in documents.packed(rows[:5], characters=20)] == [2, 2, 1] and not list(documents.packed([]))
    pages = [json.dumps([{"page": k, "rows": [["Name", 7], ["a", None], [1, "b"]]}, {"page": k, "rows": []}]).encode() for k in (1, 2, 3.5, 2**31)]
    files = spark.createDataFrame([(f"d{k}", p and bytearray(p), None) for k, p in enumerate([*pages, None])], "path string, content binary, pages array<int>")
    got = documents.read_tables(files, documents.READERS["json"], ["name"]).collect()
    assert sorted((r.path, r.table_idx, r.page, r.pos, *r.names, *r.vals) for r in got if not r.error) == [(d, 0, p, k, "Name", "7", *v) for d, p in (("d0", 1), ("d1", 2)) for k, v in enumerate([("a", None), ("1", "b")])]
    assert sorted(r.path for r in got if r.error) == ["d2", "d3", "d4"]


def test_streaming_takes_each_file_once(spark, tmp_path):
    a = resultset(tmp_path / "a", {"p": doc(table({"x": "1"}))})
    seen = []
    go = lambda: ingest(spark, a, str(tmp_path / "c"), lambda r, n: seen.extend(x.paper for x in r.files.select("paper").collect())).awaitTermination()
    go()
    resultset(tmp_path / "a", {"q": doc(table({"x": "2"}))})
    go()
    assert seen == ["p", "q"]


def test_html_and_csv(spark, tmp_path):
    a = resultset(tmp_path / "a", {"p": doc(table({"x": "<b>", "row_": 0}, {"x": "<b>", "y": "2", "row_": 0}), citation="C & D")}, "ua", "camelot")
    found = tables.read_resultsets(spark, [a])
    html = viewer.build_html(found.fragments, found.rows, [("p", "C & D")], {"reader": "camelot", "sources": [{"uuid": "ua", "reader": "camelot", "path": a}]}, {"k": {"l": [1, 2]}})
    assert '<td rowspan="2">&lt;b&gt;</td>' in html and "C &amp; D" in html and "k.l" in html and "<b>" not in html.replace("<b>Contents</b>", "")
    (path,) = sinks.write_csv(found.rows, str(tmp_path / "csv"))
    assert open(path).read().splitlines() == ["x,y,$page", "<b>,,1", "<b>,2,1"]


def test_command_line(spark, tmp_path, capsys):
    a = resultset(tmp_path / "a", {"p": doc(table({"x": "1"}))}, "ua")
    out = str(tmp_path / "out")
    assert cli.main(["merge", a, a, "-o", out, "--pretty", "--export-settings", str(tmp_path / "s.json")]) == 0
    assert rows_of(json.loads(open(f"{out}/p.tables.json").read()))[0]["agreement_level_"] == 2
    assert cli.main(["merge", "--settings", str(tmp_path / "s.json"), "--only-semantic-columns"]) == 0
    assert '"x":"1"' in capsys.readouterr().out.replace(" ", "")
    assert cli.main(["merge", a, "--filter-schema-columns"]) == 2
    assert cli.main(["stats", out, "-C"]) == 0 and "x:int" in capsys.readouterr().out
    assert cli.main(["validate", f"{out}/p.tables.json"]) == 0 and cli.main(["validate", f"{out}/none.tables.json"]) == 1 and cli.main(["validate", "-a", f"{out}/none.tables.json"]) == 0
    assert cli.main(["csv", out, "-o", str(tmp_path / "csv")]) == 0 and cli.main(["html", out, "--out", str(tmp_path / "x.html")]) == 0
    (tmp_path / "d.json").write_text(json.dumps([{"page": 1, "rows": [["Name", "N"], ["a", "1"]]}]))
    assert cli.main(["extract", str(tmp_path / "d.json"), "-o", str(tmp_path / "ex"), "--reader", "json"]) == 0
    folder = capsys.readouterr().out.split()[-1]
    assert [r["0"] for r in rows_of(json.loads(open(f"{folder}/d.tables.json").read()))] == ["Name", "a"]
    n = tmp_path / "n"
    n.mkdir()
    for name, text in (("Ä File.PDF", "1"), ("a_file.pdf", "2"), ("copy of it.pdf", "2")):
        (n / name).write_text(text)
    assert cli.main(["names", str(n), "-y"]) == 0
    assert sorted((f.name, f.read_text()) for f in n.iterdir()) == [("a_file.pdf", "2"), ("a_file_1.pdf", "1")]
    assert cli.main(["what"]) == 2


def test_a_folder_named_again_counts_again(spark, tmp_path):
    rng = random.Random(8)
    sets = [[[rng.choice("abc") for _ in range(rng.randint(1, 4))] for _ in range(3)] for _ in range(2)]
    folders = [resultset(tmp_path / n, {f"p{k}": json.dumps(doc(table(*({"x": v} for v in rows))), indent=2) for k, rows in enumerate(s)}, f"u{n}") for n, s in zip("ab", sets)]
    for mentions in ([0, 0], [1, 0, 1, 1]):
        got = merged(spark, *(("file://" if k else "") + folders[k] for k in mentions))
        for p in range(3):
            want = fold([sets[k][p] for k in mentions])
            assert [(r["row_"], r["x"], r["agreement_level_"], r["sources_"]) for r in rows_of(got[f"p{p}"])] == [(m["k"], m["v"], m["n"], list(dict.fromkeys("u" + "ab"[mentions[s]] for s in m["s"]))) for m in want]
