"""Fill-in-the-middle forms, the Merkle manifest and the main text of pages, against plain versions."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import op11_fim, op12_merkle, op13_html
from formloom.llm._shared import new_folder
from formloom.llm.html_pages import MARK, made_pages
from tests.llm.test_operators import ODD

SPARE = "lang string, source string, n_chars long, n long, form string, path string, tree string, id long"
MARKED = ["a <P> b", "x<S>", "<M>", "<P", "<<P>", "a<S b>S>", " <", "< S > M>"]
TEXTS = [*ODD, *MARKED, " ", "\t\n", " a", "a ", "a b", " a  b c ", "é ü\x0bx", "\U0001f600 \U0001f600", *(" ".join(f"w{i}" for i in range(k)) + " " * (k % 3) for k in range(40))]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def sf(spark):
    path = new_folder(spark, "test-forms")
    langs = [None, "", "en", "en", "en", "de", "ü", "z"]
    made = [(i, t, langs[i % 8] if i % 3 else "en", None if i % 5 == 0 else "s:1", None if i % 4 == 0 else len(t or ""), 1, "spm", "p", "t", 7) for i, t in enumerate(TEXTS)]
    made += [(None, "no id", None, None, None, 1, "x", "p", "t", 7)] * 2 + [(3, "again", "en", "s", 9223372036854775807, 1, "x", "p", "t", 7), (3, "again", "en", "s", 9223372036854775807, 1, "x", "p", "t", 7)]
    spark.createDataFrame(made, "doc_id long, text string, " + SPARE).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def test_op11(spark, sf):
    token = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    got = sorted((tuple(r) for r in op11_fim.op11_fim(spark, sf).collect()), key=repr)
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = r.text or ""
        h = sha(f"42:{'' if r.doc_id is None else r.doc_id}")
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        units = token.findall(t)
        assert "".join(units) == t
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        plain = not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 50
        out = t if plain else f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
        form = "plain" if plain else "spm" if h4 % 100 < 80 else "psm"
        want.append((r.doc_id, len(units), form, None if plain else len(p), None if plain else len(m), sha(out), sha(t)))
    assert got == sorted(want, key=repr) and {r[2] for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("rate", [0, 100])
def test_forms_of_characters(spark, sf, rate):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null and doc_id != 3")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    made = op11_fim.fill_in_middle(docs, units="characters", rate=rate).withColumn("back", op11_fim.restored()).collect()
    assert {r.doc_id: r.back for r in made} == text and all(r.n == len(text[r.doc_id]) for r in made)
    for r in made:
        h = sha(f"42:{r.doc_id}")
        if r.form != "plain":
            assert r.prefix_chars == min(int(h[i : i + 8], 16) % (r.n + 1) for i in (0, 8))
    assert (rate == 0) == all(r.form == "plain" for r in made)
    with pytest.raises(ValueError):
        op11_fim.fill_in_middle(docs, units="words")


@pytest.mark.parametrize("held", [1, 2, 3, 1000])
def test_runs_in_parts(held):
    for t in (x or "" for x in TEXTS):
        whole, parts = op11_fim.Runs(t), op11_fim.Runs(t, held=held)
        assert np.array_equal(whole.starts, parts.starts) and np.array_equal(whole.upto, parts.upto) and np.array_equal(whole.ends, parts.ends)
        assert [whole.place(k) for k in range(whole.units + 1)] == [parts.place(k) for k in range(parts.units + 1)]


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, at):
    found = []
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        found.append((run[: at % 2], run[at % 2 + 1 :]))
        at //= 2
    return found


def leaf(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))


@pytest.mark.parametrize(("most_top", "least_bits"), [(None, None), (4, 1), (1, 0), (1 << 20, 0)])
def test_op12(spark, sf, monkeypatch, most_top, least_bits):
    if most_top:
        monkeypatch.setattr(op12_merkle.manifest, "__defaults__", (None, most_top, least_bits))
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        by_lang[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[x] = tree([leaf(r) for r in by_lang[x]])
    top = tree([trees[x][-1][0] for x in order])
    want = []
    for k, x in enumerate(order):
        for at, r in enumerate(by_lang[x]):
            own = way(trees[x], at) + way(top, k)
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf(r, int(bad))
            for left, right in own:
                node = sha("".join([*left, node, *right]))
            want.append((r.doc_id, leaf(r), trees[x][-1][0], top[-1][0], sha("".join(s for a, b in own for s in a + b)), node, node == top[-1][0]))
    got = [tuple(r) for r in op12_merkle.op12_merkle(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[-1] for r in got}) == 2


def test_a_manifest_of_one_row_and_of_many_languages(spark):
    one = op12_merkle.manifest(spark.createDataFrame([(1, "s", "en", 2, "ab")], "doc_id long, source string, lang string, n_chars long, text string")).collect()
    assert [(r.path, r.leaf, r.subroot, r.root) for r in one] == [([], sha("1:11:s2:en1:22:ab"),) + (sha("1:11:s2:en1:22:ab"),) * 2]
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("lang"), "id", F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    got = op12_merkle.manifest(many, most_top=2, least_bits=0).withColumn("back", op12_merkle.folded("folded_leaf", "path")).collect()
    nodes = [sha(f"{len(str(i))}:{i}1:s{len(str(i))}:{i}1:11:t") for i in sorted(range(300), key=str)]
    assert len(got) == 300 and {r.root for r in got} == {tree(nodes)[-1][0]} == {r.back for r in got}


# pages by hand, of none of the layouts that the field is fitted on
HAND = [
    (
        """<!doctype html><html><head><title>Storm hits the coast | Daily</title><script>x="<p>no</p>"</script></head><body>
<header class="site-header"><a href="/">Daily News</a><nav><ul><li><a href=a>World</a><li><a href=b>Sports</a></ul></nav></header>
<div class="cookie-banner"><p>We use cookies to give you the best experience. By continuing you agree.</p><button>Accept</button></div>
<main><article class="post"><h1>Storm hits the coast</h1><p>A storm hit the coast on Monday &amp; left
 thousands   without power.</p><aside class="ad">Buy umbrellas, now 20% off!</aside><p>Officials said repairs would take days.</p>
<h2>What comes next</h2><p>Rain.</p><ul><li>Stay inside<li>Keep water ready</ul>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>This was a terrible night for all of us, my roof is gone.</p></div><div class="comment"><p>We were lucky here. Nothing happened at all, thank you for asking.</p></div>
<form><textarea>say</textarea><button>Post comment</button></form></section></article></main>
<aside><h3>Most read</h3><ul><li><a href=1>Ten ways to cook rice</a><li><a href=2>Elections are near</a></ul></aside>
<footer><p>&copy; 2024 Daily. All rights reserved.</p></footer></body></html>""",
        "Storm hits the coast\nA storm hit the coast on Monday & left thousands without power.\nOfficials said repairs would take days.\nWhat comes next\nRain.\nStay inside\nKeep water ready",
    ),
    (
        """<html><body><div id="wrapper"><div id="header"><div class="logo">ACME blog</div></div><div id="menu"><a href="/">Start</a> <a href="/b">Blog</a></div>
<div id="content"><div class="entry"><h2 class="entry-title">How we moved</h2><div class="entry-content"><p>We moved the office last year. It was a long day, and nobody slept.<p>Short one.<p>Then we unpacked; it took <a href="/w">two weeks</a> and several pizzas.<blockquote>Never again.</blockquote></div></div>
<div class="sharedaddy share">Share this: <a href="#">Facebook</a> <a href="#">Twitter</a></div>
<div class="related-posts"><h3>You may also like</h3><p>How we stayed where we were for ten long years, by a colleague.</p></div>
<div id="respond"><h3>Leave a reply</h3><form><p>Your e-mail address will not be published.</p></form></div></div>
<div id="sidebar"><div class="widget"><h4>About</h4><p>We are a small company that makes anvils for coyotes. Founded long ago.</p></div></div>
<div id="footer">Powered by something. Theme by someone.</div></div></body></html>""",
        "How we moved\nWe moved the office last year. It was a long day, and nobody slept.\nShort one.\nThen we unpacked; it took two weeks and several pizzas.\nNever again.",
    ),
    (
        """<table><tr><td class="nav"><a href=1>One</a><br><a href=2>Two</a></td><td class="story"><h1>Old page</h1><p>Made in tables, as one did then. It has a few sentences. They are plain.<p>And more of them, without an end</td></tr></table><div class=copyright>Copyright 1999 Someone</div>""",
        "Old page\nMade in tables, as one did then. It has a few sentences. They are plain.\nAnd more of them, without an end",
    ),
    ("""<body><nav><a href=x>Only</a> <a href=y>links</a></nav><footer>&copy; no one</footer>""", ""),
    (
        """<!DOCTYPE html><html><body><div class="alert alert-info">Our offices are closed on Friday.</div><div role="banner"><p>City library</p></div><div role="navigation"><ul><li><a href=#>Books</a></li></ul></div><div role="main"><h1>Opening hours</h1><table><tr><th>Day</th><th>Hours</th></tr><tr><td>Monday</td><td>9-5</td></tr></table><p>On other days call 555&nbsp;1234 first.</p></div><div role="complementary"><p>New: our reading club meets each Tuesday evening. Join us, it is free of charge!</p></div><div role="contentinfo"><p>City of Somewhere, 1 Main Street</p></div></body></html>""",
        "Opening hours\nDay\nHours\nMonday\n9-5\nOn other days call 555 1234 first.",
    ),
]


def test_reading_of_markup():
    texts = lambda page: [b.text for b in op13_html.read(page)[0]]
    assert texts("a<b>b</b> c<p>d<p>e &lt;f&gt; &#233;&eacute;&nbsp; x</p>g<br>h") == ["ab c", "d", "e <f> éé x", "g h"]
    assert texts('<div title="a>b">x</div><div title=\'"\'>y</div><!-- <p>no</p> -->z<![CDATA[q]]>') == ["x", "y", "z"]
    assert texts("<head><title>t</title><p>one<li>two<li>three<table><tr><td>4<td>5<tr><td>6</table></ul>") == ["one", "two", "three", "4", "5", "6"]
    assert texts("<script>if (a<b) '</p>'</SCRIPT >a<style>p</style>b<textarea><p>no</textarea>c<select><option>no</select>d") == ["abc", "d"]
    assert texts("1 < 2 <3 </ x>") == ["1 < 2 <3"] and texts('a<p title="x>b<p>c') == ["a", "b", "c"] and texts("a<p") == ["a"]
    assert texts("") == texts("<!--") == texts("<script>x") == texts("<") [1:] == []
    assert op13_html.read("<title>a &amp; b</title>x")[1] == "a & b"
    block = op13_html.read("<div><a href=x>all</a></div>")[0][0]
    assert (block.text, block.linked, block.parent) == ("all", 3, "div")


@pytest.mark.parametrize("unit", ["<a ", "<p>", "<div>", "</span>", "<b><p></b>", "<ul><li>", "<a '\">", "<!--", "<td>x", "&amp;", "<span>x<li>y</li>"])
def test_reading_is_linear(unit):
    import time

    began = time.time()
    op13_html.Field().main_text(unit * 100_000)
    assert time.time() - began < 30


def test_gradient_of_the_field():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2, (3, 5, 4)).astype(float)
    edges, labels = draw.integers(0, 3, (3, 5)), draw.integers(0, 2, (3, 5))
    there = np.arange(5)[None] < np.array([[5], [3], [1]])
    w, m = draw.normal(size=4), draw.normal(size=(3, 2, 2))
    value, gw, gm = op13_html.likelihood(w, m, x, edges, labels, there)
    plain = 0.0
    for p, n in enumerate((5, 3, 1)):
        score = lambda ls: sum(x[p, t] @ w * ls[t] for t in range(n)) + sum(m[edges[p, t], ls[t - 1], ls[t]] for t in range(1, n))  # noqa: B023, E731
        every = [[k >> t & 1 for t in range(n)] for k in range(1 << n)]
        plain += score(labels[p]) - np.log(sum(np.exp(score(ls)) for ls in every))
    assert np.isclose(value, plain)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert np.isclose((op13_html.likelihood(w + e, m, x, edges, labels, there)[0] - value) / 1e-6, gw[i], atol=1e-4)
    for i in np.ndindex(3, 2, 2):
        e = np.zeros((3, 2, 2))
        e[i] = 1e-6
        assert np.isclose((op13_html.likelihood(w, m + e, x, edges, labels, there)[0] - value) / 1e-6, gm[i], atol=1e-4)


def test_viterbi_against_all_labellings():
    draw = np.random.default_rng(4)
    field = op13_html.Field(draw.normal(size=op13_html.FEATURES), draw.normal(size=(3, 2, 2)))
    for page in ["<div class=ad>a</div>", "<p>one<p>two, three.<div id=x><ul><li><a href=q>four</a><li>five</ul>six</div>", "<article><h1>x</h1><p>y.<p>z</article><footer>© w</footer>"]:
        blocks, title = op13_html.read(page)
        n, most = len(blocks), op13_html.most_text(blocks)
        own = [sum(field.weights[f] for f in op13_html.text_features(b, i, n, title, most)) + sum(field.weights[len(op13_html._TEXT) + k] for k in range(60) if b.ancestors >> k & 1) for i, b in enumerate(blocks)]
        score = lambda ls: sum(o * x for o, x in zip(own, ls, strict=True)) + sum(field.moves[op13_html.edge(blocks[t - 1], blocks[t])][ls[t - 1], ls[t]] for t in range(1, n))  # noqa: B023, E731
        assert field.labels(blocks, title) == max(([k >> t & 1 for t in range(n)] for k in range(1 << n)), key=score)


def test_main_text_of_pages_that_were_not_learnt():
    field, wrong, blocks, whole = op13_html.trained(), 0, 0, 0
    pages = made_pages(300, 5)
    for p in pages:
        want = [b.text.replace(MARK, "") for b in op13_html.read(p)[0] if MARK in b.text]
        found, title = op13_html.read(p.replace(MARK, ""))
        labels = [MARK in b.text for b in op13_html.read(p)[0]]
        off = sum(a != bool(b) for a, b in zip(labels, field.labels(found, title), strict=True))
        wrong, blocks, whole = wrong + off, blocks + len(labels), whole + (field.main_text(p.replace(MARK, "")).split("\n") == want or not off)
    assert wrong / blocks < 0.01 and whole / len(pages) > 0.88
    for page, want in HAND:
        assert field.main_text(page) == want


def test_op13(spark, sf):
    path = new_folder(spark, "test-pages")
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    odd = [(None, None, None), (-1, "u", ""), (-1, "u", "<p>"), (-2, None, "no markup at all"), (-3, "u", "x" * 300_000)]
    spark.createDataFrame([(r.page_id, r.url, r.html, "t", 5) for r in given] + [(*r, "t", 5) for r in odd], "page_id long, url string, html string, text string, n_chars long").repartition(3).write.parquet(f"{path}/pages.parquet")
    got = op13_html.op13_html(spark, path).collect()
    assert len(got) == len(given) + len(odd) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    for r in given:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inner))
        assert by[r.page_id].text == "\n".join(b for b in blocks if b) and by[r.page_id].url == r.url
    assert [r.text for r in got if r.page_id in (None, -1)] == [""] * 3
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert op13_html.extract(empty, op13_html.trained()).count() == 0
