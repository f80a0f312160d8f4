"""URL rules, page text and shards against brute force and held-out pages."""

import random
import zlib

import numpy as np
import pytest

from rivulet.llm import html_text, sharding, url_filter

from ..oracle import compare, connect
from .helpers import SF, awkward, documents, empty, prose


# --- URL rules

def glob(pattern, text):
    """Does the glob fit, by trying everything."""
    if not pattern:
        return not text
    if pattern[:2] == "**":
        return any(glob(pattern[2:], text[k:]) for k in range(len(text) + 1))
    if pattern[0] == "*":
        k = 0
        while True:
            if glob(pattern[1:], text[k:]):
                return True
            if k == len(text) or text[k] == "/":
                return False
            k += 1
    if pattern[0] == "?":
        return text[:1] not in ("", "/") and glob(pattern[1:], text[1:])
    return text[:1] == pattern[0] and glob(pattern[1:], text[1:])


def test_automaton_equals_backtracking():
    r = random.Random(6)
    patterns = ["".join(r.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(r.randint(0, 7))) for _ in range(120)]
    patterns = [p for p in patterns if "***" not in p] + ["a" * 150, "**" + "b" * 70 + "*"]
    texts = ["".join(r.choice("ab/.é") for _ in range(r.randint(0, 9))) for _ in range(150)] + ["", "a" * 150, "a" * 151, "/" + "b" * 70]
    fits = url_filter.Automaton([url_filter.Rule(p, "block") for p in patterns]).run(texts)
    for i, t in enumerate(texts):
        for k, p in enumerate(patterns):
            assert fits[i, k] == glob(p, t), (p, t)
    assert url_filter.Automaton([]).run(["x"]).shape == (1, 0)


def test_contract_rules(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/", "http://example.com/fr/", "http://x.net/es/q?a", "net", None, "http://evil.org/.example.com/en/",
            "http://notexample.com/en/", "http://net/fr/", "ftp://Ünet/fr/", "http://example.com?/en/", "http://example.com#/en/", "://com/", "http://a.org", "http://casino.org/x",
            "http://a.org/x/ads/1", "http://b.com/ads/1", "x" * 50_000 + "://a.org/" + "y" * 3000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(rows).orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3] == ("x.net", "/es/q", "net/es/", "block") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2] is None and got[7][2] == "com/" and got[8][2:] == ("net/fr/", "block") and got[9][2] is None
    assert got[10] == ("example.com", "", None, "allow") and got[11][:2] == ("example.com", "") and got[12] == ("com", "/", "com/", "allow")
    assert got[13][3] == "allow" and got[14][3] == got[15][3] == "block" and got[16][2:] == ("com/", "allow") and got[17][0] == "a.org"


def test_urls_equal_sql(spark):
    queries, sql = {"q": lambda s, d: url_filter.verdicts(s.read.parquet(f"{d}/pages.parquet"))}, {"q": url_filter.SQL}
    assert compare(spark, connect(SF), "q", SF, queries, sql) == ""


# --- page text

@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.train(html_text.sample(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


def test_blocks_of_broken_markup():
    page = ("<html><head><title>T &amp; t</title><style>p{}</style><script>var x='</p><b>';</script></head><body><!-- c --><nav><a href='/'>Ho\n me</a></nav>"
            "<article><p><b>One <i>t</i>wo.<br><p>Three &lt;b&gt; &#233;</p>loose<ul><li>x<li>y</ul></article><p title=\"a>b\">last &am")
    got = html_text.blocks(page)
    assert [b.text for b in got] == ["T & t", "Ho me", "One two.", "Three <b> é", "loose", "x", "y", "last &am"]
    assert got[2].path[-2][0] == "article" and got[3].path[-1][0] == "p" and got[-1].path[-1][0] == "p"
    assert [b.text for b in html_text.blocks("")] == [] and html_text.blocks("<" * 2000 + "a <b")[0].text.startswith("<")
    assert [b.text for b in html_text.blocks("<script>never closed")] == []
    assert len(html_text.blocks("<div>" * 20_000 + "x")) == 1


def test_gradients_equal_differences():
    r = np.random.RandomState(0)
    model = html_text.Labeller()
    x = r.randn(5, 3, html_text.WIDTH).astype(np.float32)
    live = np.arange(5)[:, None] < np.array([5, 3, 4])
    y = (r.rand(5, 3) > 0.5).astype(np.float32)
    _, grads = model.gradients(x, live, y)
    for name, g in grads.items():
        flat = np.argsort(-abs(g).ravel())[:3]
        for k in flat:
            w = model.w[name].ravel()
            old, step = w[k], 3e-3
            w[k] = old + step
            up = model.gradients(x, live, y)[0]
            w[k] = old - step
            down = model.gradients(x, live, y)[0]
            w[k] = old
            assert abs((up - down) / (2 * step) - g.ravel()[k]) < 2e-3 + 0.05 * abs(g.ravel()[k]), name


def test_held_out_layouts(labeller):
    words = sorted({w for k in range(30) for w in prose(k, 80, 700).split()})
    paths, bins = html_text.Bins(html_text.PATH_BINS), html_text.Bins(html_text.WORD_BINS)
    right = total = 0
    for page in html_text.made_pages(words, 150, seed=991):
        b, y = html_text.labelled(page, made=True)
        label = labeller.label([html_text.vectors(b, paths, bins)])[0]
        right += (label == y.astype(bool)).sum()
        total += len(y)
    assert right / total > 0.97


def test_ancestors_of_any_depth_count():
    wrap = "<div>" * 9 + "<div class=x>" + "<div>" * 9
    page = f"<article>{wrap}<p>one</p>{'</div>' * 19}<nav>{wrap}<p>two</p>{'</div>' * 19}</nav></article><footer>{wrap}<p>three"
    found, y = html_text.labelled(page, made=False)
    assert [b.text for b in found] == ["one", "two", "three"] and y.tolist() == [1, 0, 0]
    paths, bins = html_text.Bins(html_text.PATH_BINS), html_text.Bins(html_text.WORD_BINS)
    x = html_text.vectors(found, paths, bins)[:, :html_text.PATH_BINS]
    assert x[:, paths["footer"]].tolist() == [0, 0, 1] and x[:, paths["article"]].tolist() == [1, 1, 0]


def test_held_out_deep_layouts(labeller):
    words = sorted({w for k in range(30) for w in prose(k, 80, 700).split()})
    paths, bins = html_text.Bins(html_text.PATH_BINS), html_text.Bins(html_text.WORD_BINS)
    right = total = 0
    for page in html_text.made_pages(words, 150, seed=992, deep=1.0):
        b, y = html_text.labelled(page, made=True)
        label = labeller.label([html_text.vectors(b, paths, bins)])[0]
        right += (label == y.astype(bool)).sum()
        total += len(y)
    assert right / total > 0.97


def test_articles_of_the_test_pages(spark, labeller):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = 0
    got = html_text.extract(pages, labeller).collect()
    for r in got:
        found, y = html_text.labelled(r.html, made=False)
        whole += r.text == " ".join(b.text for b, k in zip(found, y) if k)
    assert whole >= 0.98 * len(got)


def test_pages_without_anything(spark, labeller):
    rows = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (None, "u", "<p></p>", "t"), (3, "u", "<p>" + "a b " * 50_000, "t")],
                                 "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(rows, labeller).collect()}
    assert got[1].text == got[2].text == got[None].text == ""
    assert set(html_text.extract(rows, labeller).columns) == set(rows.columns)
    assert html_text.main_texts(rows.limit(0)).collect() == []


# --- shards

@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 4097])
def test_permutation_and_inverse(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n, 5)
    assert sorted(places) == list(range(n))
    assert (sharding.permute(places, n, 5, inverse=True) == rows).all()
    for row in {0, n // 2, n - 1}:
        shard, slot = sharding.locate(row, n, 24, 5)
        assert sharding.row_at(shard, slot, n, 24, 5) == row
    if n > 900:
        assert abs(np.corrcoef(rows, places)[0, 1]) < 0.1 and (places != sharding.permute(rows, n, 6)).any()


def check_shards(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert (r.shard, r.slot) == sharding.locate(r.row, n, 24)
    assert sorted(r.row for r in rows) == list(range(n))
    sizes = [len(by.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard_table(docs).collect()
    check_shards(got, docs.count())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    again = sharding.shard_table(docs.repartition(7)).collect()  # the order of the input changes nothing
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_awkward_rows(spark):
    odd = awkward(spark)
    got = sharding.shard_table(odd).collect()
    check_shards(got, odd.count())
    assert all(r.size == 8 and r.text_crc32 == 0 for r in got if r.doc_id in (1, 2))
    assert sharding.shard_table(empty(spark)).collect() == []
    check_shards(sharding.shard_table(documents(spark, ["same"] * 500)).collect(), 500)


WRITTEN = """<!DOCTYPE html><html><head><title>Lakes</title></head><body>
<nav><ul><li><a href=/>Home</a></li><li><a href=/lakes>Lakes</a></li><li><a href=/about>About us</a></li></ul></nav>
<main><h1>The deep lake</h1>
<p>The lake lies between two ridges and was measured for the first time in the spring, when the ice had gone and the boats could leave.</p>
<pre>depth = 3\nwidth = 12</pre>
<table><tr><th>Depth</th><th>Width</th></tr><tr><td>3 m</td><td>12 m</td></tr></table>
<figure><img src=/l.png><figcaption>The lake in May</figcaption></figure>
<p>Nobody had been there for years, and the people of the village were glad that somebody came to see it again after all.</p>
<p>Short.</p></main>
<section class="comments"><h3>Comments</h3><div><b>ann</b><p>I have been there as well, it is lovely.</p></div></section>
<footer>&copy; Lakes <a href=/legal>Legal</a></footer></body></html>"""


def test_a_written_page_keeps_code_tables_and_short_paragraphs(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_text.train(html_text.sample(real))
    pages = spark.createDataFrame([(1, WRITTEN), (2, WRITTEN.replace("<main>", "<article data-u=/x/>").replace("</main>", "</article>"))], "page_id long, html string")
    for row in html_text.extract(pages, model).collect():
        for part in ("The deep lake", "measured for the first time", "depth = 3 width = 12", "Depth", "3 m", "The lake in May", "Short."):
            assert part in row.text, (row.page_id, part)
        for part in ("Home", "About us", "Comments", "lovely", "Legal"):
            assert part not in row.text, (row.page_id, part)


def test_a_page_of_very_many_blocks_takes_bounded_memory():
    import resource
    model = html_text.Labeller()
    page = "<main>" + "<p>some words of a paragraph that is not short at all</p>" * 40_000 + "</main>"
    found = html_text.blocks(page)
    rows = html_text.vectors(found, html_text.Bins(html_text.PATH_BINS), html_text.Bins(html_text.WORD_BINS))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(model.label([rows])[0]) == len(found) == 40_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
