"""Token counts, HTML extraction and BPE against plain versions of the same."""

import os
import random
from functools import lru_cache

import pytest

from tabweave.llm import bpe, html, tokencount
from tests.llm.frames import docs

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="needs the vocabularies")


def slow_count(word, scores, unknown):
    """The best segmentation of one pre-token by itself."""
    best = [(0, 0)]
    for j in range(1, len(word) + 1):
        c = word[j - 1]
        options = [(best[i][0] + scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in scores]
        if c not in scores:
            options.append((best[j - 1][0] + unknown, best[j - 1][1] - len(c.encode())))
        best.append(max(options))
    return -best[-1][1]


@needs
def test_token_counts(spark):
    pieces = tokencount.load_pieces()
    scores, unknown = dict(pieces), min(s for _, s in pieces) - tokencount.PENALTY
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*enumerate(texts), (0, texts[0]), (None, "a b"), (-1, None), (-2, ""), (-3, " \n\t "), (-4, "日本語 \U0001f600 naïve"), (-5, "supercalifragilistic" * 2000)]
    got = tokencount.count_tokens(docs(spark, rows)).collect()
    slow = lru_cache(None)(lambda w: slow_count(w, scores, unknown))
    want = [(i, None, None) if t is None else (i, len(t.split()), sum(slow("▁" + w) for w in t.split())) if len(t) < 30_000 else (i, 1, None) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and (w[2] is None or g[2] == w[2])
    assert tokencount.count_tokens(docs(spark, [])).collect() == []


@needs
def test_bpe_against_another_implementation(spark):
    import tiktoken

    ranks = bpe.load_ranks()
    other = tiktoken.Encoding("x", pat_str=bpe.EXACT.pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*enumerate(texts), (0, texts[0]), (None, "it's ok"), (-1, None), (-2, ""), (-3, " \n\n  x  "), (-4, "x²½Ⅳ\u0085\u001c日本 \U0001f600é"), (-5, "ab" * 40_000), (-6, "<|endoftext|>")]
    for lexicon in (0, 200, bpe.LEXICON):
        got = bpe.encode(docs(spark, rows), lexicon=lexicon)
        found = got.collect()
        assert len(found) == len(rows)
        by = {}
        for i, t in rows:
            by.setdefault(i, []).append(t)
        for r in found:
            t = by[r.doc_id][0]
            assert (r.ids is None and r.n_tokens is None) if t is None else (r.ids == other.encode(t, disallowed_special=()) and r.n_tokens == len(r.ids))
    back = {r.doc_id: r.text for r in bpe.decode(got).collect()}
    assert all(back[i] == t for i, t in rows)
    assert bpe.encode(docs(spark, [])).collect() == []


@needs
def test_transducer_numbers_words():
    ranks = bpe.load_ranks()
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(300)})
    t = bpe.Transducer.build(words, ranks)
    assert t.find(words).tolist() == list(range(len(words)))
    assert t.find([b"", b"zzz", b"abcabcabc"]).tolist() == [-1, -1, -1]
    tree = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(t.final) < len(tree)  # suffixes are shared
    for k, w in enumerate(words):
        assert t.ids[t.offset[k] : t.offset[k + 1]].tolist() == bpe.merge(w, ranks)


def test_least_count(spark):
    df = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([9, 7, 7, 7, 3, 3, 2])], "w string, n bigint")
    assert [bpe.least_count(df, s) for s in (0, 1, 2, 3, 4, 5, 6, 7, 9)] == [10, 8, 8, 8, 4, 4, 3, 0, 0]
    assert bpe.least_count(df.where("n < 0"), 5) == 0


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home and a long line of links, with commas, here</a></li></ul></nav>
<div class="content"><p>First paragraph, of some length, with commas, that should be kept as it is.<p>Second one, likewise long, and <b>bold</b>, so that it counts as prose.</div>
<div class="sidebar"><p>Buy this, buy that, buy everything, now, at once, today.</p></div>
<div><a href="x">link text that is quite long, with, commas</a></div></body></html>"""


def test_html(spark):
    title, text, n, score = html.extract(PAGE)
    assert title == "A & B" and n == 2 and score > 0
    assert text == "First paragraph, of some length, with commas, that should be kept as it is.\nSecond one, likewise long, and bold, so that it counts as prose."
    many = "<body><div class=content>" + "".join(f"<p>Paragraph {k}, with some words in it, and commas.</p>" for k in range(20_000)) + "</div>"
    rows = [(1, PAGE), (1, PAGE), (None, PAGE), (2, None), (3, ""), (4, "<p>short"), (5, "<<<>>> <a <b"), (6, many), (7, "<div>" * 5000 + "deep text, deep enough to count")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, html string, title string, id string")
    got = sorted(((r.page_id, r.text, r.n_paragraphs, r.title) for r in html.extract_pages(df).collect()), key=str)
    assert sorted(g[0] or 0 for g in got) == [0, 1, 1, 2, 3, 4, 5, 6, 7]
    by = {g[0]: g for g in got}
    assert by[1][1] == by[None][1] == text and by[2][1:] == (None, None, None) and by[3][1:] == ("", 0, "") and by[4][1] == "short" and by[6][2] == 20_000 and "deep text" in by[7][1]
    assert html.extract_pages(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_html_keeps_prose_of_the_test_pages(spark):
    got = html.extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert sum(bool(r.text) for r in got) >= 0.9 * len(got)
    assert not any("track(" in r.text or "<" in r.text and "</p>" in r.text for r in got)


def test_html_in_a_form():
    body = PAGE[PAGE.index("<nav>") : PAGE.index("</body>")]
    form = '<form id="aspnetForm" method="post"><label>A label of a control, long enough to score</label><input name=q><button>Go</button>'
    assert html.extract(PAGE.replace(body, form + body + "</form>"))[1:3] == html.extract(PAGE)[1:3]
    assert html.extract(PAGE.replace("<p>Second", "<form><p>Search</p><button>Go</button></form><p>Second"))[1] == html.extract(PAGE)[1]
    assert html.extract("<form><p>short</p><button>Go</button></form>")[1] == "short"


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.isdir("/opt/tokenizers"), reason="needs the test tables")
def test_bpe_query_decodes_every_document(spark):
    from tabweave.llm.queries import op9_bpe

    want = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = op9_bpe(spark, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == want and all(len(r.ids) == r.n_tokens for r in got)


@needs
def test_decoder():
    d = bpe.Decoder(bpe.load_ranks())
    ids, cut = bpe.merge("é".encode(), {bytes([k]): bpe.load_ranks()[bytes([k])] for k in range(256)}), bpe.np.array([0, 1, 1, 2])
    assert d(bpe.np.array(ids), cut).to_pylist() == ["\ufffd", "", "\ufffd"] and d(bpe.np.array(ids), bpe.np.array([0, 2])).to_pylist() == ["é"]
    for bad in (-1, len(d.size)):
        with pytest.raises(KeyError):
            d(bpe.np.array([bad]), bpe.np.array([0, 1]))
