"""Vector near-duplicates and nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tabweave.llm import ann, multiindex
from tests.llm.test_pairs import components


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, id int, vec string, n double")


def clustered(rng, n=1500, d=32, groups=40):
    centres = rng.normal(size=(groups, d))
    return (centres[rng.integers(0, groups, n)] + 0.5 * rng.normal(size=(n, d))).astype(np.float32)


ODD = [(None, [1.0] * 32), (-1, None), (-2, []), (-3, [float("nan")] * 32), (-4, [1.0, None] * 16), (-5, [1.0, 2.0]), (-6, [float("inf")] * 32)]


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng)
    x = np.concatenate([x, x[:200] + 0.02 * rng.normal(size=(200, 32)).astype(np.float32), x[:50], 3 * x[100:120]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r.vec_id, r.duplicate_of) for r in multiindex.near_duplicate_vectors(frame(spark, rows + ODD + [(-7, [0.0] * 32), rows[5]])).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= multiindex.THRESHOLD, 1))
    want = {(a, b) for a, b in components(zip(i.tolist(), j.tolist())).items() if a != b}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert multiindex.near_duplicate_vectors(frame(spark, [])).collect() == []
    assert multiindex.near_duplicate_vectors(frame(spark, [(4, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0])])).collect() == [(4, 2)]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 2000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest_neighbours(frame(spark, rows + ODD)).collect()
    d = ann.distances(x.astype(float), x.astype(float))
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, 1)[:, :10]
    found = {}
    for r in got:
        found.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.distance)
    assert len(found) == len(x) and all(sorted(f) == list(range(1, 11)) for f in found.values())
    recall = np.mean([len({n for n, _ in found[i].values()} & set(true[i].tolist())) / 10 for i in range(len(x))])
    assert recall >= 0.9
    for i in range(0, len(x), 97):
        assert all(abs(dist**2 - d[i, n]) < 1e-2 for n, dist in found[i].values())


def test_few_and_equal_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (3, [0.0, 1.0])]
    got = sorted((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in ann.nearest_neighbours(frame(spark, rows)).collect())
    assert [g[:3] for g in got if g[0] == 1] == [(1, 1, 2), (1, 2, 3)] and got[1][3] == 1.0
    assert {g[2] for g in got if g[0] == 3} == {1, 2}
    assert ann.nearest_neighbours(frame(spark, [])).collect() == []
    assert ann.nearest_neighbours(frame(spark, [(7, [1.0])])).collect() == []
    many = [(i, [1.0, 1.0]) for i in range(100)]
    got = ann.nearest_neighbours(frame(spark, many)).collect()
    assert len(got) == 1000 and all(r.distance == 0 for r in got)


def test_every_centroid_in_reach_is_found():
    rng = np.random.default_rng(5)
    groups = 4 * rng.normal(size=(25, 64))
    centres = (groups[np.arange(1200) % 25] + rng.normal(size=(1200, 64))).astype(np.float32)  # 48 in a group: more than a graph of 16 links leaves
    x = (groups[rng.integers(0, 25, 300)] + rng.normal(size=(300, 64))).astype(np.float32)
    found = ann.Centroids(centres)
    true = ((x[:, None].astype(float) - centres) ** 2).sum(2)
    for ratio in (1.001, 1.1, 1.3):
        i, c, d = found.within(x, ratio)
        want = set(zip(*(a.tolist() for a in np.nonzero(true <= true.min(1, keepdims=True) * (ratio - 1e-4) ** 2))))
        got = set(zip(i.tolist(), c.tolist()))
        assert len(want & got) >= 0.99 * len(want) and np.allclose(d**2, true[i, c], rtol=1e-3)
        assert (d <= (ratio + 1e-4) * np.sqrt(true.min(1))[i]).all() and len({*i.tolist()}) == len(x)


def test_an_id_repeated_more_than_k_times_takes_one_place(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    crowd = [(1000, (x[7] + 1e-3 * rng.normal(size=8)).tolist()) for _ in range(120)]  # one id, unlike vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1001, x[7].tolist())] * 30 + crowd
    found = {}
    for r in ann.nearest_neighbours(frame(spark, rows)).collect():
        found.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert len(found) == 302 and all(len(f) == len(set(f)) == 10 for f in found.values())
    d = ann.distances(x.astype(float), x.astype(float))
    np.fill_diagonal(d, np.inf)
    assert {1000, 1001} < set(found[7])
    others = [set(found[i]) - {1000, 1001} for i in range(300)]
    assert np.mean([len(o & set(np.argsort(d[i])[: len(o)].tolist())) / len(o) for i, o in enumerate(others)]) >= 0.9


def test_near_duplicates_in_few_of_many_dimensions(spark):
    rng = np.random.default_rng(7)
    n, d, rank = 6000, 384, 12
    base = rng.normal(size=(n, rank))
    x = (np.concatenate([base, base + 0.25 * rng.normal(size=(n, rank))]) @ rng.normal(size=(rank, d))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.duplicate_of for r in multiindex.near_duplicate_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= multiindex.THRESHOLD, 1))
    assert len(i) > 1000 and np.mean([got.get(a, a) == got.get(b, b) for a, b in zip(i.tolist(), j.tolist())]) >= multiindex.RECALL


def test_overfull_lists_and_cells_and_a_query_set(spark):
    rng = np.random.default_rng(8)
    x = clustered(rng, 1500, groups=3)
    x[300:600] = x[300] + 1e-3 * rng.normal(size=(300, 32)).astype(np.float32)  # a crowd
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = ann.distances(x.astype(float), x.astype(float))
    np.fill_diagonal(d, np.inf)
    found = {}
    for r in ann.nearest_neighbours(frame(spark, rows), queries=F.col("id") % 50 == 0, most=40).collect():
        found.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert sorted(found) == list(range(0, 1500, 50)) and all(len(f) == 10 for f in found.values())
    assert np.mean([len(set(f) & set(np.argsort(d[i])[:10].tolist())) / 10 for i, f in found.items()]) >= 0.9
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= multiindex.THRESHOLD, 1))
    want = {a: c for a, c in components(zip(i.tolist(), j.tolist())).items() if a != c}
    for most in (60, multiindex.MOST):
        got = {r.vec_id: r.duplicate_of for r in multiindex.near_duplicate_vectors(frame(spark, rows), most=most).collect()}
        assert np.mean([got.get(a) == c for a, c in want.items()]) >= 0.97 and all(a in want for a in range(301, 600))
    named = frame(spark, [(4, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0])]).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    assert multiindex.near_duplicate_vectors(named).collect() == [("v4", "v2")] and ann.nearest_neighbours(named).collect() == []
    assert len(ann.nearest_neighbours(named.withColumn("vec_id", F.substring("vec_id", 2, 1))).collect()) == 6
