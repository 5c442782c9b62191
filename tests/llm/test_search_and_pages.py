"""Whitening, ranked search and article extraction against brute force and known articles."""

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_samples import EMPTY, evidence, plain, sentence, texts
from pyspark.sql import Row

from linkstrata.llm.articles import article_text, blocks_of, content_paths, extract_articles
from linkstrata.llm.ranking import Shard, rank_snippets, term_weight, terms_of
from linkstrata.llm.whitening import _exact_sums, _square_deviations, whiten_vectors

VECTORS = "vec_id bigint, embedding array<float>, x string, copies string, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [c if c is None else float(c) for c in v], "a", "b", "c", "d") for i, v in rows], VECTORS).repartition(3)


def slow_whitening(rows, components=4, counted=False):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in usable)
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (size - len(v))) for i, v in usable]
    fit = [v for _, v in x] if counted else sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.cov(np.array(fit, dtype=float).T, bias=True).reshape(size, size)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for i, v in x:
        white = (np.array(v) - np.array(sums) / n) @ axes / np.sqrt(values)
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        out += [(i, k + 1, n, deviation, abs(w), values[k] / np.trace(cov)) for k, w in enumerate(white)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counted", [False, True])
def test_whitening(spark, counted):
    rng = random.Random(4)
    base = [[rng.gauss(0, s) for s in (3, 1.5, 1, 0.6, 0.3)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(40)] + [(7, base[7]), (None, base[3]), (None, base[3])]
    rows += [(200, None), (201, [1.0, None, 0, 0, 0]), (202, [float("nan")] * 5), (203, [float("inf"), 0, 0, 0, 0]), (204, [-0.0, -0.001, 0, 0, 0]), (205, [0.5, 0.25]), (206, [])]
    got = whiten_vectors(vectors(spark, rows), counted=counted)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    want = slow_whitening(rows, counted=counted)
    mine = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=repr)
    assert [r[:4] for r in mine] == [r[:4] for r in want] and len(mine) == 4 * 106
    by = {}
    for r in want:
        by.setdefault((r[0], r[1], r[3]), []).append(r)
    for r in mine:
        w = by[r[0], r[1], r[3]][0]
        assert r[4] == pytest.approx(w[4], abs=1e-9) and r[5] == pytest.approx(w[5], rel=1e-9)
    assert {r["identity_error"] for r in got if r["identity_error"] < 1e-9} and len({r["identity_error"] for r in got}) == 1
    same = {}
    for r in got:
        same.setdefault((r["component"], r["deviation"]), set()).add(r["whitened"])
    assert all(len(s) == 1 for s in same.values())  # a distinct vector is whitened once, whatever the row


def test_whitening_without_variance(spark):
    assert whiten_vectors(vectors(spark, [])).collect() == []
    assert whiten_vectors(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whiten_vectors(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = whiten_vectors(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [3.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"])) for r in sorted(flat)] == [(1, 1, 2, 512**2, 1.0), (2, 1, 2, 512**2, 1.0), (3, 1, 2, 512**2, 1.0)]


def test_whole_numbers_of_any_size():
    x = np.array([[2**60, -5], [2**60, 7], [2**61, 1]], dtype=np.int64)
    assert _exact_sums(x, np.array([3, 1, 1])) == [6 * 2**60, -7]
    assert _square_deviations(x, 3, [2**62, 3]) == [None, None, None]
    assert _square_deviations(np.array([[2**33]]), 1, [2**33 - 2**31]) == [2**62]


def slow_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_ranks(rows, items, k):
    held = [(i, Counter(slow_terms(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 50 + (50 * n * count) // total
            score = sum(term_weight(count, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(slow_terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(item, at + 1, None if none else i, -s) for at, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_terms():
    text = "Größe A-b_c ÄÖ1 x\u00a0y\u2014z\x00q{r}~\x7fs `t` [U]"
    assert [t.decode() for t in terms_of(text.encode())] == slow_terms(text)


@pytest.mark.parametrize("k, block_terms", [(50, 200_000), (3, 10)])
def test_ranks(spark, k, block_terms):
    rows = EMPTY + [(i, t) for i, t, _ in texts(n=120)] + [(500 + i, "the ing copy of one text") for i in range(60)] + [(None, "the ing copy of one text"), (10, "the ing copy of one text")]
    items = [(1, "The ING copy, of? one text"), (1, "the"), (2, rows[40][1][:300]), (3, None), (4, "..."), (None, "ING tion er"), (5, "absent words only xyz"), (6, "over er at"), (6, "over er at")]
    table = spark.createDataFrame(items, "item_id bigint, message string").selectExpr("*", "'x' AS item", "'y' AS rank", "'z' AS score")
    got = rank_snippets(evidence(spark, rows), table, k=k, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "evidence_id", "score"]
    assert plain(got) == slow_ranks([*rows, rows[-1]], items, k)


def test_ranks_of_text_ids_and_empty_tables(spark):
    rows = [(f"ev_{i:03d}", "one two three" if i % 3 else "two two") for i in range(90)]
    table = spark.createDataFrame(rows, "evidence_id string, snippet string")
    items = spark.createDataFrame([(1, "two three")], "item_id int, message string")
    assert plain(rank_snippets(table, items, k=70)) == slow_ranks(rows, [(1, "two three")], 70)
    assert rank_snippets(table.limit(0), items).collect() == [] and rank_snippets(table, items.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_shard_search_finds_all_of_the_best(seed):
    rng = np.random.default_rng(seed)
    documents, terms = 700, 25
    tf = rng.poisson(0.6, (documents, terms)) * (rng.random((documents, terms)) < rng.random(terms))
    tf[100:400] = tf[100]  # a large group of copies
    lengths = tf.sum(axis=1) + np.where(np.arange(documents) < 400, 3, rng.integers(0, 30, documents))
    weights = rng.integers(0, 5000, terms)
    document, term = np.nonzero(tf)
    shard = Shard(document, term, tf[document, term], lengths, weights, documents, int(lengths.sum()))
    measure = 50 + (50 * lengths * documents) // lengths.sum()
    impact = np.where(tf > 0, weights * ((10**9 * tf) // (1000 * tf + 20 * measure[:, None])), 0)
    for size in (1, 4, terms):
        asked = np.sort(rng.choice(terms, size, replace=False))
        scores = impact[:, asked].sum(axis=1)
        for k, least in ((10, 0), (50, 0), (10, int(np.sort(scores)[-5]))):
            bound = max(np.sort(scores)[-k], least, 1)
            assert sorted(shard.search(asked, k, least)) == sorted((int(s), i) for i, s in enumerate(scores) if s >= bound)


def prose(rng, n):
    return [sentence(rng, "en", rng.randint(1, 60)).capitalize() + rng.choice([".", ", and more.", " <b> & co. &nbsp; end?"]) for _ in range(n)]


def around(kind, title, paragraphs, rng):
    """A page of one of several kinds around an article."""
    title, body = html.escape(title), [html.escape(p) for p in paragraphs]
    noise = [html.escape(sentence(rng, "de", rng.randint(3, 12))) for _ in range(12)]
    links = "".join(f"<li><a href='/{i}'>{noise[i]}</a></li>" for i in range(5))
    if kind == "article":
        marked = "".join(f"<p><b>{p}<br>" if i % 3 == 0 else f"<p>{p}</p>" for i, p in enumerate(body))
        return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{links}</ul></nav><!-- ad -->"
                f"<div class=ad>{noise[5]}</div><article><h1>{title}</h1>{marked}</article><footer>&copy; {noise[6]}")
    if kind == "main":
        return (f"<body class='has-sidebar'><header><a href='/'>{noise[0]}</a></header><div id='cookie-notice'><p>{noise[1]}. {noise[2]}, ok.</p></div><main><h1>{title}</h1><div class=text>"
                + "".join(f"<p>{p}" for p in body) + f"</div><section class=comments><article><p>{noise[3]}. {noise[4]}!</p></article></section></main><aside><p>{noise[5]}.</p></aside>"
                f"<form><label>{noise[6]}</label><input value='x'></form></body>")
    if kind == "div":
        return (f"<html><body><div id=header><h2>{noise[0]}</h2></div><div class='left-menu'><ul>{links}</ul></div><div class=column><div class=story><h1>{title}</h1>"
                + "".join(f"<div>{p}</div>" for p in body) + f"</div></div><div class='sidebarBox'><p>{noise[1]}.</p></div><div role=contentinfo>{noise[2]}</div></body></html>")
    return (f"<body><table><tr><td class=navigation>{noise[0]}<td><article class='post'><header><h1>{title}</h1></header><section>" + "".join(f"<p>{p}</p>" for p in body)
            + f"</section><div class='share'>{noise[1]}</div><footer>{noise[2]}</footer></article><article class='teaser'><p>{noise[3]}.</p></article></table>")


@pytest.mark.parametrize("kind", ["article", "main", "div", "table"])
def test_articles_come_back(kind):
    rng = random.Random(kind)
    for _ in range(60):
        title, paragraphs = sentence(rng, "en", rng.randint(2, 9)), prose(rng, rng.randint(1, 12))
        if kind == "div":
            paragraphs.append(sentence(rng, "en", 40) + ".")  # text alone tells the content here
        want = "\n".join(" ".join(p.split()) for p in [title, *paragraphs])
        assert article_text(around(kind, title, paragraphs, rng)) == want


def test_broken_markup():
    assert article_text("") == "" and article_text("<nav>only <b>menu</b></nav><footer>f</footer>") == ""
    assert article_text("plain, text &amp; a < b &am") == "plain, text & a < b &am"
    assert article_text("<article>one<p>two<p>three</div></p></span>four<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table><br>five<img alt=no><hr>six<p cla") == (
        "one\ntwo\nthree\nfour\na\nb\nx\ny\nz\nfive\nsix")
    assert article_text("<ARTICLE><P>a\n\tb &#8212;&nbsp; c<br/>d</P><SCRIPT>x<p>y</SCRIPT ><!-- <p>no --><p title='a>b'>e<p class=\"broken>f") == "a b \u2014 c d\ne\nf"
    assert article_text("<article><p>a <span class=ad>buy <span>now</span></span>b <i hidden>c</i>d</p><div style='display: none'>e</div><h2 id='related'>g</h2><p>f</article>") == "a b d\ng\nf"
    assert article_text("<article><p>x<script>never closed") == "x" and article_text("<article><p>x<!-- never closed <p>y") == "x"
    assert article_text("<article>" + "<div>x" * 20_000 + "<p>deep") == "\n".join(["x"] * 20_000 + ["deep"])


def test_paths_are_chosen_by_ratio():
    page = "<body><div class=a><p>" + "Long text, with marks. " * 20 + "</p></div><div class=b><p>few</p></div><div class=c><p><a href=x>" + "linked words " * 30 + "</a></p></div>"
    blocks = blocks_of(page)
    assert content_paths(blocks) == {("body", "div.a", "p")} and len(blocks) == 3
    assert content_paths([]) == set()


def test_extract_articles(spark):
    rng = random.Random(9)
    pages = [(i, f"http://x/{i}", around(kind, "Some title", prose(rng, 300 if i == 3 else 4), rng)) for i, kind in enumerate(["article", "main", "div", "table"] * 2)]
    pages += [(None, None, pages[0][2]), (50, None, None), (51, "u", ""), (52, "u", "  "), pages[1]]
    rows = [Row(evidence_id=i, url=u, snippet=p, text="t", n_chars="n", title="x") for i, u, p in pages]
    got = extract_articles(spark.createDataFrame(rows, "evidence_id bigint, url string, snippet string, text string, n_chars string, title string"))
    assert got.columns == ["evidence_id", "url", "snippet", "n_chars"]
    want = [(i, u, article_text(p or ""), len(article_text(p or ""))) for i, u, p in pages]
    assert plain(got) == sorted(want, key=repr)
    assert extract_articles(spark.createDataFrame([], got.schema)).collect() == []
