"""Packing, quality, sharding and the pipeline: round trips, held-out accuracy, brute force, and odd rows."""

import itertools
import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import packing, quality, repeats, sharding
from tabweave.llm.minhash import drop_near_duplicates
from tests.llm.frames import docs, words

SF = "/root/testdata/sf0.01"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_packing_places_every_word_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, int(n))) for i, n in enumerate([*rng.integers(1, 60, 300), 64, 128, 1000, 63, 65])]
    rows += [(None, words(rng, 9)), (-1, None), (-2, ""), (-3, " \n "), (-4, "one")]
    got = packing.pack(docs(spark, rows + [rows[0]]), capacity=64, group=50).collect()
    fill, seen = {}, {}
    for r in got:
        fill.setdefault(r.bin_id, []).append(r)
        seen.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
    assert all(sum(r.n_words for r in b) <= 64 and sorted(r.position for r in b) == list(range(len(b))) for b in fill.values())
    counts = {i: len(t.split()) for i, t in rows if t and t.split()}
    for i, n in counts.items():
        whole = [(k, min(64, n - k)) for k in range(0, n, 64)]
        assert sorted(seen.pop(i)) == sorted(whole * (2 if i == 0 else 1))
    assert not seen
    total = sum(counts.values())
    assert total / (64 * len(fill)) > 0.9  # a third of the texts is longer than half a sequence
    assert packing.pack(docs(spark, [])).collect() == []


def test_packed_texts_rejoin(spark):
    rng = np.random.default_rng(9)
    rows = [(i, words(rng, int(n))) for i, n in enumerate([3, 10, 130, 64, 7])] + [(5, None), (6, "")]
    got = packing.packed_texts(docs(spark, rows), capacity=32, group=3).collect()
    for i, t in rows[:5]:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start_word)
        assert " ".join(r.text for r in mine) == t
    twice = packing.packed_texts(docs(spark, rows + [rows[2]]), capacity=32, group=3).collect()
    assert sum(r.n_words for r in twice if r.doc_id == 2) == 2 * 130
    odd = [(1, "a b"), (1, "c"), (None, "d"), (None, "e f"), (None, "d"), (None, None)]
    assert sorted(r.text for r in packing.packed_texts(docs(spark, odd)).collect()) == ["a b", "c", "d", "d", "e f"]
    assert packing.packed_texts(docs(spark, [])).collect() == []


def test_packing_parts():
    sizes, rng = [5, 4, 3, 3, 2, 2, 1], packing.random.Random(0)
    people = packing.evolve(sizes, 10, [], 30, 6, rng)
    assert len(people[0].bins) == 2 and sorted(itertools.chain(*people[0].bins)) == list(range(7))
    a, b = people[0], people[-1]
    child = packing.mutate(packing.crossover(a, b, sizes, 10, rng), sizes, 10, rng)
    assert sorted(itertools.chain(*child.bins)) == list(range(7)) and all(sum(sizes[i] for i in x) <= 10 for x in child.bins)
    assert packing.from_places(a.places(7), sizes, 10).fit == a.fit


def test_marginals_by_brute_force():
    rng = np.random.default_rng(10)
    at = np.array([0, 3, 3, 4, 8])
    score, change = rng.normal(size=8), rng.normal(size=(2, 2))
    p, z, pairs = quality.chains(score, change, at)
    for c in range(4):
        s, e = at[c], at[c + 1]
        total, good, pair = 0.0, np.zeros(e - s), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=e - s):
            w = np.exp(sum(score[s + k] * y for k, y in enumerate(labels)) + sum(change[x, y] for x, y in zip(labels, labels[1:])))
            total += w
            good += w * np.array(labels)
            for x, y in zip(labels, labels[1:]):
                pair[x, y] += w
        if e > s:
            assert np.allclose(p[s:e], good / total) and np.isclose(z[c], np.log(total)) and np.allclose(pairs[c], pair / total)


@needs
def test_quality_on_held_out_labels(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = {r.doc_id: r.good for r in quality.classify(d, even).collect()}
    told = [(r.quality, got[r.doc_id]) for r in odd.collect() if r.doc_id in got]
    rate = lambda y: np.mean([g == bool(y) for q, g in told if q == y])
    assert rate(1) >= 0.95 and rate(0) >= 0.9, (rate(1), rate(0))


def test_quality_on_odd_rows(spark):
    prose, junk = "This is a plain line of prose, as one writes it.\nAnd here is another one.", "$$$ @@@ 1234 ### !!!\n<<<>>> 99 || 88 ~~ \n%%% ^^^"
    rows = [(k, prose + f" Line {k}.") for k in range(20)] + [(100 + k, junk + f" {k}{k}") for k in range(20)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0), (900, 1, 0), (5, 7, 0)], "doc_id bigint, quality int, toxic int")
    odd = [(None, prose), (-1, None), (-2, ""), (-3, " \n\n"), (-4, (prose + "\n") * 5000), rows[0]]
    got = quality.classify(docs(spark, rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].good == (i < 100) for i, _ in rows) and by[None].good and by[-4].good and by[-4].n_lines == 10_000
    assert all(by[i].quality == 0 and not by[i].good for i in (-1, -2, -3))
    kept = quality.drop_low_quality(docs(spark, rows + odd), labels)
    assert kept.columns == docs(spark, []).columns and kept.count() == 20 + 3
    assert quality.classify(docs(spark, []), labels).collect() == []
    none = quality.classify(docs(spark, rows), labels.where("quality = 1")).collect()
    assert all(r.good and r.quality is None for r in none)


def test_sharding_is_a_permutation(spark):
    rows = [(k, f"t{k}") for k in range(1003)] + [(None, None), (5, "t5"), (-1, "")]
    df = docs(spark, rows).withColumn("shard_id", F.lit("old")).repartition(7)
    got = sharding.shuffle_into_shards(df, 10).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard_id, []).append(r.shard_pos)
    assert sorted(map(len, sizes.values())) == [100] * 4 + [101] * 6 and all(sorted(p) == list(range(len(p))) for p in sizes.values())
    assert sharding.shuffle_into_shards(docs(spark, []), 3).collect() == []
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(df, 0)


def test_sharding_with_odd_names_and_units(spark):
    df = spark.range(1000).selectExpr("id", "id AS `a.b`", "id AS __key", "id AS u", "id AS f", "id AS c0", "id AS key")
    got = sharding.shuffle_into_shards(df, 3, rows_per_unit=70)
    assert got.columns == [*df.columns, "shard_id", "shard_pos"]
    rows = got.collect()
    assert all(len({r[k] for k in range(7)}) == 1 for r in rows)
    assert sorted((r.shard_id, r.shard_pos) for r in rows) == [(s, p) for s, n in enumerate((334, 333, 333)) for p in range(n)]
    assert np.mean([r.id == 334 * r.shard_id + r.shard_pos for r in rows]) < 0.02


def test_communication_matrix():
    sizes, units = np.array([5, 0, 12, 3, 9]), np.array([7, 0, 12, 9, 1])
    rows = np.stack([sharding.matrix_row(sizes, p, units, 1) for p in range(5)])
    assert (rows.sum(1) == sizes).all() and (rows.sum(0) == units).all()
    got = np.array([sharding.matrix_row(np.array([3, 2, 1]), 1, np.array([2, 3, 1]), s) for s in range(6000)])
    # brute force: all orders of the six places
    want, seen = {}, {}
    for order in itertools.permutations([0, 0, 1, 1, 1, 2]):
        key = tuple(order[3:5].count(u) for u in range(3))
        want[key] = want.get(key, 0) + 1 / 720
    for g in got:
        seen[tuple(g.tolist())] = seen.get(tuple(g.tolist()), 0) + 1
    assert set(seen) == set(want) and sum((seen[k] - 6000 * p) ** 2 / (6000 * p) for k, p in want.items()) < 25  # chi square, 4 degrees


def test_large_draws():
    rng = np.random.default_rng(0)
    n = 40_000
    for good, bad, size in ((30, 50, 20), (500, 300, 600), (4, 1000, 300)):
        got = sharding.large_draws(rng, np.full(n, good), np.full(n, bad), np.full(n, size))
        k = np.arange(max(0, size - bad), min(good, size) + 1)
        p = np.array([math.comb(good, x) * math.comb(bad, size - x) / math.comb(good + bad, size) for x in k])
        seen = np.bincount(got - k[0], minlength=len(k))
        some = p * n >= 10
        assert seen.sum() == n and ((seen[some] - n * p[some]) ** 2 / (n * p[some])).sum() < some.sum() + 5 * np.sqrt(2 * some.sum())
    good, bad, size = 4 * 10**11, 6 * 10**11, 3 * 10**11
    got = sharding.large_draws(rng, np.full(4000, good), np.full(4000, bad), np.full(4000, size))
    var = size * 0.4 * 0.6 * (1 - size / (good + bad))
    assert abs(got.mean() - size * 0.4) < 5 * np.sqrt(var / 4000) and abs(got.var() / var - 1) < 0.15
    row = sharding.matrix_row(np.full(10**6, 10**5), 4321, sharding.sizes_of(10**11, 1000), 0)
    assert row.sum() == 10**5 and abs(row - 100).max() < 60


def test_packing_beats_best_fit_on_hard_sizes():
    rng = packing.random.Random(3)
    won = 0
    for case in range(4):
        sizes = [rng.randint(20, 100) for _ in range(120)]
        start = packing._fresh(sizes, 150, rng, 0.0)
        people = packing.evolve(sizes, 150, [start], 400, 8, packing.random.Random(case))
        assert len(people[0].bins) <= len(start.bins) and people[0].fit >= start.fit
        assert sorted(itertools.chain(*people[0].bins)) == list(range(120)) and all(sum(sizes[i] for i in b) <= 150 for b in people[0].bins)
        won += people[0].fit > start.fit
    assert won == 4
    sizes = [6, 6, 5, 5, 4, 4]  # brute force: two bins of 15; best fit needs three
    start = packing._fresh(sizes, 15, rng, 0.0)
    assert len(start.bins) == 3 and len(packing.evolve(sizes, 15, [start], 200, 6, rng)[0].bins) == 2


def test_packing_fills_rooms_across_groups(spark):
    rng = np.random.default_rng(12)
    rows = [(None, words(rng, int(n))) for n in rng.integers(20, 60, 600)]  # no id at all
    got = packing.pack(docs(spark, rows), capacity=100, group=40, generations=4).collect()
    fill = {}
    for r in got:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_words
    total = sum(len(t.split()) for _, t in rows)
    assert sum(fill.values()) == total and max(fill.values()) <= 100 and len(fill) <= -(-total // 100) * 1.05


@pytest.mark.parametrize("kind", ["string", "int"])
def test_any_ids_and_names(spark, kind):
    rng = np.random.default_rng(13)
    passage, one, two = words(rng, 70), words(rng, 150), words(rng, 90)
    prose, junk = "This is a plain line of prose, as one writes it.\nAnd here is another one.", "$$$ @@@ 1234 ### !!!\n<<<>>> 99 || 88 ~~ \n%%% ^^^"
    rows = [(1, one), (2, one), (3, one + " and more"), (4, passage), (5, two + " " + passage), (5, words(rng, 40)), (None, two), (None, prose), (7, ""), (8, None)]
    names = ["doc_id", "text", "a.b", "__key", "__id", "__th", "__spans", "__again", "__n", "f", "i", "c0", "removed", "words_removed"]
    df = spark.createDataFrame([(None if i is None else str(i), t, *([str(k)] * 12)) for k, (i, t) in enumerate(rows)], ", ".join(f"`{n}` string" for n in names))
    df = df.withColumn("doc_id", F.col("doc_id").cast(kind))
    tags = lambda out: sorted(int(r["__key"]) for r in out.collect())
    unlike = drop_near_duplicates(df)
    assert unlike.columns == names and tags(unlike) == [0, 3, 4, 5, 6, 7, 8, 9]
    cut = repeats.drop_repeats(df)
    assert cut.columns == [n for n in names if n != "words_removed"] + ["words_removed"]
    assert {int(r["__key"]): r.words_removed for r in cut.collect() if r.words_removed} == {1: 150, 2: 150, 4: 70}
    assert {r.doc_id for r in packing.pack(df).collect()} == {r.doc_id for r in df.collect() if r.text}
    labels = spark.createDataFrame([("1", 1), ("4", 1), ("9", 0)], "doc_id string, quality int")
    bad = spark.createDataFrame([("9", junk)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    good = quality.drop_low_quality(df.unionByName(bad, allowMissingColumns=True), labels)
    assert good.columns == names and 7 in tags(good)


@needs
def test_pipeline_stage_by_stage(spark, tmp_path):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as cp


    labels = spark.read.parquet(f"{SF}/labels.parquet")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (None, "A null id keeps its text, as any other does.", None, None, None), (10**6 + 1, "", "en", "s", 0)], source.schema)
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    source.unionByName(odd).write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(cp.STAGES):
        new = stage(spark, now, sf)
        new.write.parquet(f"{sf}/{k}")
        outs.append(spark.read.parquet(f"{sf}/{k}"))
        now = outs[-1]
    good, unlike, cut, packed = outs
    key = lambda df: sorted(map(str, df.collect()))
    d0 = spark.read.parquet(f"{sf}/documents.parquet")
    assert key(good) == key(quality.drop_low_quality(d0, labels)) and all(o.columns == d0.columns for o in outs[:3])
    assert key(unlike) == key(drop_near_duplicates(good))
    from tests.llm.test_pairs import brute

    want = brute([(r.doc_id, r.text) for r in unlike.collect() if r.doc_id is not None and r.text], repeats.LEAST)
    got = {r.doc_id: r.text.split() for r in cut.collect() if r.doc_id is not None and r.text}
    assert got == {i: w for i, (w, _) in want.items() if w}
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.doc_id in want and want[r.doc_id][1])
    pieces = {}
    for r in sorted(packed.collect(), key=lambda r: r.start_word):
        pieces.setdefault(r.doc_id, []).extend(r.text.split())
        assert len(r.text.split()) == r.n_words
    assert {i: w for i, w in pieces.items() if i is not None} == got
    assert key(cp.run(spark, sf).select("doc_id", "start_word", "text")) == key(packed.select("doc_id", "start_word", "text"))



@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pipeline_keeps_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as cp

    small, sf = "/root/testdata/sf0.001", str(tmp_path)
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    source = spark.read.parquet(f"{small}/documents.parquet")
    texts = ["A null id keeps its text, as any other does.", "Another document has no id either, and a text of its own.", "This is one text under an id that stands twice.", "And here is the other, which shares no line with the first."]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip([None, None, 10**6, 10**6], texts)], source.schema)
    source.unionByName(odd).write.parquet(f"{sf}/documents.parquet")
    got = [(r.doc_id, r.text) for r in cp.run(spark, sf).where(f"doc_id is null or doc_id = {10**6}").collect()]
    assert sorted(got, key=str) == sorted(zip([None, None, 10**6, 10**6], texts), key=str)
