"""Near-duplicate documents and repeated passages against brute force, and the cases that must not crash."""

import numpy as np
import pyarrow as pa

from tabweave.llm import minhash, repeats
from tabweave.llm.components import connected_components
from tests.llm.frames import docs, words


def components(pairs):
    """{node: least node it is connected to}."""
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {a: root(a) for a in list(up)}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 600, (400, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {a: c for a, c in components(p for p in pairs if p[0] != p[1]).items()}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        base = words(rng, 400, 10**6).split()
        a, b = " ".join(base), " ".join(base[: int(400 * share)] + words(rng, int(400 * (1 - share)), 10**6).split())
        sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in (a, b)]
        sig, full = minhash.signatures(pa.array([a, b]))
        assert full.all() and abs((sig[0] == sig[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12
    sig, full = minhash.signatures(pa.array(["one", "ONE!", "", "...", "two words"]))
    assert full.tolist() == [True, True, False, False, True] and (sig[0] == sig[1]).all() and (sig[0] != sig[4]).any()


def edited(rng, text, share):
    w = text.split()
    for k in rng.choice(len(w), int(len(w) * share), replace=False):
        w[k] = f"new{rng.integers(0, 10**6)}"
    return " ".join(w)


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    texts = [words(rng, int(n)) for n in rng.integers(20, 300, 300)]
    texts += [edited(rng, texts[k % 60], 0.03) for k in range(200)]  # near copies
    texts += texts[100:120] + [texts[130].upper() + "!!"] * 40  # exact ones, and a crowd
    rows = [(i, t) for i, t in enumerate(texts)]
    odd = [(None, texts[0]), (-1, None), (-2, ""), (-3, ""), (-4, "..."), (-5, "..."), (-6, "!!"), rows[7]]
    got = {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(docs(spark, rows + odd)).collect()}
    sets = [{tuple(t.lower().replace("!", "").split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    close = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) and likeness(a, b) >= 0.6]
    want = {a: c for a, c in components(close).items() if a != c}
    assert all(got.get(a) == c for a, c in want.items())
    loose = components((a, b) for a in range(len(texts)) for b in range(a) if sets[a] & sets[b] and likeness(a, b) >= 0.35)
    assert all(loose.get(a) == loose.get(c) for a, c in got.items() if a >= 0)
    assert got[-4] == -5 and -6 not in got and -2 not in got
    kept = sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs(spark, rows + odd)).collect()), key=str)
    again = [r for r in rows if r[0] not in got]
    assert kept == sorted(again + [(None, texts[0]), (-1, None), (-2, ""), (-3, ""), (-5, "..."), (-6, "!!")], key=str)
    assert minhash.near_duplicates(docs(spark, [])).collect() == [] and minhash.drop_near_duplicates(docs(spark, [])).collect() == []


def test_mixed_bucket_pairs():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 255, (2, 256), dtype=np.uint8)
    sigs = np.stack([a, b, a, b, a])
    edges = minhash.joined_pairs(np.arange(5), sigs, 0.5)
    assert components(edges) == {0: 0, 2: 0, 4: 0, 1: 1, 3: 1}


def test_a_large_mixed_bucket_costs_few_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base, groups, each = rng.integers(0, 255, 256, dtype=np.uint8), 400, 5
    rows = []
    for g in range(groups):
        own = np.where(rng.random(256) < 0.25, base, rng.integers(0, 255, 256)).astype(np.uint8)  # a quarter is boilerplate
        for _ in range(each):
            rows.append(np.where(rng.random(256) < 0.85, own, rng.integers(0, 255, 256)).astype(np.uint8))
    sigs = np.stack(rows)
    bands = minhash.band_hashes(sigs.astype(np.uint64))
    bands[:, 0] = 7  # all meet in one bucket
    df = spark.createDataFrame([(k, [int(x) for x in b.view(np.int64)], bytearray(s.tobytes())) for k, (b, s) in enumerate(zip(bands, sigs))], "n bigint, bands array<bigint>, sig binary")
    tried = []
    monkeypatch.setattr(minhash, "_within", lambda r, *a, f=minhash._within: (tried.append(r.groupBy("b").count().selectExpr("coalesce(sum(count * (count - 1) / 2), 0)").first()[0]), f(r, *a))[1])
    edges, kept = minhash._edges(df, 0.5, 64)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    tried.append(sum(t.df.count() for t in kept[1::3]))
    i, j = np.nonzero(np.triu((sigs[:, None, :] == sigs[None, :, :]).mean(2) >= 0.5 + 0.5 / 256, 1))
    want = components(zip(i.tolist(), j.tolist()))
    assert got == want and len(want) == groups * each
    assert sum(tried) < 100 * len(rows), tried  # all pairs would be 1000 a row


def crowd(spark, pairs, shared, rng):
    """Texts alike two by two, which meet in ``shared`` buckets of all and nowhere else."""
    sigs = rng.integers(0, 255, (2 * pairs, 256), dtype=np.uint8)
    sigs[1::2] = np.where(rng.random((pairs, 256)) < 0.65, sigs[::2], sigs[1::2])
    bands = rng.integers(1 << 32, 1 << 62, (2 * pairs, 64))
    bands[:, :shared] = np.arange(shared) + 7
    rows = [(k, [int(x) for x in b], bytearray(x.tobytes())) for k, (b, x) in enumerate(zip(bands, sigs))]
    return spark.createDataFrame(rows, "n bigint, bands array<bigint>, sig binary")


def test_links_of_large_mixed_buckets_are_all_found(spark):
    for shared, block in ((1, 10), (2, 70)):
        edges, kept = minhash._edges(crowd(spark, 100, shared, np.random.default_rng(12)), 0.5, block)
        got = {r.node: r.component for r in connected_components(edges).collect()}
        assert got == {k: k // 2 * 2 for k in range(200)}, (shared, block)


def test_joined_pairs_by_brute_force():
    rng = np.random.default_rng(13)
    sigs = rng.integers(0, 255, (300, 256), dtype=np.uint8)
    sigs[:2] = 3  # all bins alike
    for k in rng.integers(2, 300, 150):
        sigs[k] = np.where(rng.random(256) < 0.6, sigs[rng.integers(0, 300)], sigs[k])
    for groups in (rng.permutation(300), rng.integers(0, 40, 300), np.where(rng.random(300) < 0.8, 7, np.arange(300) + 10)):
        for split in (0, 1, 90, 299):
            i, j = np.nonzero(np.triu(minhash.similarity(sigs[:, None].reshape(300, 1, 256).repeat(300, 1).reshape(-1, 256), np.tile(sigs, (300, 1))).reshape(300, 300) >= 0.5, 1))
            use = (groups[i] != groups[j]) & ((i < split) & (j >= split) if split else True)
            want = components(zip(groups[i[use]].tolist(), groups[j[use]].tolist()))
            assert components(minhash.joined_pairs(groups, sigs, 0.5, split)) == want


def brute(rows, least):
    """Texts without the words whose window of ``least`` stands earlier, in the order of ids."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            if key in seen:
                j, at = seen[key]
                gone[max(k, at + least) if j == i else k : k + least] = True
            else:
                seen[key] = (i, k)
        out[i] = ([x for x, g in zip(w, gone) if not g], int(gone.sum()))
    return out


def test_repeats(spark):
    rng = np.random.default_rng(6)
    passages = [words(rng, n) for n in (12, 10, 15, 30, 11)]
    rows = []
    for i in range(150):
        parts = [words(rng, int(rng.integers(0, 40)))]
        for k in rng.integers(0, 5, int(rng.integers(0, 3))):
            parts += [passages[k], words(rng, int(rng.integers(0, 15)))]
        rows.append((i, " ".join(p for p in parts if p)))
    rows += [(150, "z " * 100), (151, " ".join(f"p{k % 4}" for k in range(90))), (152, passages[3]), (153, rows[4][1]), (154, passages[0] + " " + passages[0] + " " + passages[0])]
    want = brute(rows, 10)
    for options in ({}, {"crowd": 1}, {"bucket": 300}):
        got = repeats.drop_repeats(docs(spark, rows), least=10, anchor=4, **options).collect()
        assert {r.doc_id: (r.text.split(), r.words_removed) for r in got} == want


def test_repeats_keep_their_hands_off(spark):
    p = " ".join(f"k{k}" for k in range(60))
    rows = [(1, f"Start.\n{p}\nEnd of one."), (2, f"Other\t start  {p}\n\n  Finis two.\n"), (None, p), (3, None), (4, ""), (5, "short"), (1, f"Start.\n{p}\nEnd of one."), (9, p)]
    got = repeats.drop_repeats(docs(spark, rows)).collect()
    by = sorted(((r.doc_id, r.text, r.words_removed) for r in got), key=str)
    assert by == sorted([(1, rows[0][1], 0), (1, rows[0][1], 0), (2, "Other\t start  Finis two.\n", 60), (None, p, 0), (3, None, 0), (4, "", 0), (5, "short", 0), (9, "", 60)], key=str)
    assert set(got[0].asDict()) == {"doc_id", "text", "id", "n", "th", "words", "bucket", "g", "h", "sig", "words_removed"}
    assert repeats.drop_repeats(docs(spark, [])).collect() == []


def test_previous_factors_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(30):
        parts = [rng.integers(0, 3, int(n)).astype(np.uint32) for n in rng.integers(4, 25, 5)]
        owned = [max(1, len(p) - 3) for p in parts]
        p, at, q, there = repeats.previous_factors(parts, owned, 4)
        want, seen = set(), set()
        for k, x in enumerate(parts):
            for i in range(owned[k]):
                w = tuple(x[i : i + 4])
                if len(w) == 4:
                    if w in seen:
                        want.add((k, i))
                    seen.add(w)
        assert set(zip(p.tolist(), at.tolist())) == want
        assert all((b, j) < (a, i) and (parts[a][i : i + 4] == parts[b][j : j + 4]).all() for a, i, b, j in zip(p.tolist(), at.tolist(), q.tolist(), there.tolist()))
