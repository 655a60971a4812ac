"""Wrapper induction (operator 9): the matching against brute force, and what is and is not cut."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lakeshore.llm import wrappers as W


def shown(html):
    return [x.text for x in W.blocks(W.article(W.parse(html)))]


# ---------------------------------------------------------------- matching

def brute_equal(a, b):
    """Most equal text blocks of any matching of two nodes of one tag, by plain dynamic programming."""
    if a.tag == "#":
        return int(a.text == b.text)
    xs, ys = [k for k in a.kids if not k.out], [k for k in b.kids if not k.out]

    @lru_cache(None)
    def best(i, j):
        if i == len(xs) or j == len(ys):
            return 0
        out = max(best(i + 1, j), best(i, j + 1))
        if xs[i].tag == ys[j].tag:
            out = max(out, brute_equal(xs[i], ys[j]) + best(i + 1, j + 1))
        return out
    return best(0, 0)


def random_html(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return f"<p>{rng.choice('abcdef')}</p>" if rng.random() < 0.8 else rng.choice("abc")
    tag = rng.choice(["div", "section", "ul"])
    return f"<{tag}>" + "".join(random_html(rng, depth + 1) for _ in range(rng.randrange(4))) + f"</{tag}>"


def test_matching_has_the_most_equal_texts():
    rng = random.Random(6)
    for _ in range(400):
        a, b = (W.parse("<div>" + "".join(random_html(rng) for _ in range(rng.randrange(1, 6))) + "</div>") for _ in range(2))
        nodes, pairs = W.align(a, b)
        assert sum(x.text == y.text for x, y in pairs) == brute_equal(a, b)
        place = [{id(x): i for i, x in enumerate(W.blocks(t))} for t in (a, b)]
        at = [(place[0][id(x)], place[1][id(y)]) for x, y in pairs]
        assert at == sorted(at) and len({i for i, _ in at}) == len({j for _, j in at}) == len(at)


@pytest.mark.parametrize("bits", [1 << 24, 64, 1])
def test_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(W, "KEPT_BITS", bits)
    rng = random.Random(bits)
    for _ in range(200):
        xs, ys = ([rng.randrange(rng.choice([2, 6, 30])) for _ in range(rng.randrange(25))] for _ in range(2))
        found = W.common_subsequence(xs, ys)
        assert all(xs[i] == ys[j] for i, j in found) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
        assert len(found) == best[-1][-1]


def test_heaviest_chain():
    rng = random.Random(3)
    for _ in range(200):
        weights = {(rng.randrange(6), rng.randrange(6)): rng.randrange(1, 9) for _ in range(rng.randrange(12))}
        found = W._chain(weights, 6)

        @lru_cache(None)
        def best(i, j):
            return max([0] + [w + best(a + 1, b + 1) for (a, b), w in weights.items() if a >= i and b >= j])
        assert sum(weights[p] for p in found) == best(0, 0)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("entries", [4, 40, 600, 3000])
def test_one_rule_for_lists_of_any_length(spark, entries):
    """A constant line behind 0, 3 or 6 optional paragraphs, before a list whose length varies."""
    pages = []
    for i in range(8):
        extra = "".join(f"<p>Extra {i} {k}</p>" for k in range(i % 3 * 3))
        rest = "".join(f"<p>Entry {i} {k}</p>" for k in range(entries - i))
        pages.append((i, "https://l.example/", f"<article>{extra}<p>Read our terms</p>{rest}</article>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert not [r.page_id for r in W.extract(df).collect() if "Read our terms" in r.text]


def test_template_lines_that_one_reference_lacks(spark):
    """A line on 19 of 20 pages is template, also where a reference is the page without it."""
    for lacking in range(20):
        pages = [(i, f"https://r{lacking}.example/{i}", f"<article><p>One {i}</p>" + "<p>Terms</p>" * (i != lacking) + f"<p>Two {i}</p></article>")
                 for i in range(20)]
        df = spark.createDataFrame(pages, "page_id long, url string, html string") if not lacking else df.unionByName(
            spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {(r.url, r.text) for r in W.extract(df).collect()} == {
        (f"https://r{n}.example/{i}", f"One {i}\nTwo {i}") for n in range(20) for i in range(20)}


def test_deep_trees():
    deep = lambda text: "<div>" * 3000 + f"<p>Terms</p><p>{text}</p>" + "</div>" * 3000
    pairs = W.align(W.parse(deep("a")), W.parse(deep("b")))[1]
    assert [(x.text, y.text) for x, y in pairs] == [("Terms", "Terms"), ("a", "b")]
    forks = lambda text: "<div>" * 300 + f"<p>{text}</p>" + "<p>Terms</p></div>" * 300
    assert len(W.align(W.parse(forks("a")), W.parse(forks("b")))[1]) == 301


# ---------------------------------------------------------------- what is the article

def test_all_articles_and_their_title_are_kept():
    assert shown("<main><h1>Title</h1><article><p>One</p></article><p class=ad>Buy</p><article><h2>More</h2><p>Two</p></article></main>") == [
        "Title", "One", "More", "Two"]
    assert shown("<body><article><p>One</p></article><article><p>Two is longer</p></article></body>") == ["One", "Two is longer"]
    assert shown("<main><div><h1>Title</h1></div><article><p>One</p></article></main>") == ["Title", "One"]
    assert shown("<article><p>One</p><article class=comment><p>Me</p></article></article>") == ["One"]
    assert shown("<article class='post category-ads'><p>One</p></article><section id=comments><article class=comment><p>Me</p></article></section>") == ["One"]


def test_inline_words_and_sections_with_telling_names():
    assert shown("<article><p>A <span class='alert'>warning</span> stays, <span class=ad>buy</span> goes</p></article>") == ["A warning stays,", "goes"]
    assert shown("<article><p>An <span class='ad'>open one</p><p>loses nothing</p></article>") == ["An open one", "loses nothing"]
    assert shown("<article><p>x</p><section class='related-work'><h2>Related work</h2><p>Others did <a href=x>that</a>.</p></section></article>") == [
        "x", "Related work", "Others did that."]
    assert shown("<article><p>x</p><section class='related'><h2><a href=1>One</a></h2><p><a href=2>Two and more</a></p></section></article>") == ["x"]
    assert shown("<article><p>Text</p><section class='comments'><p>Me</p></section></article>") == ["Text"]
    assert shown("<article><p>x <span hidden>no</span></p></article>") == ["x"]


def test_headings_that_all_pages_share(spark):
    pages = [(i, "https://c.example/", f"<article><h1>Cake {i}</h1><h2>Ingredients</h2><ul><li>{i} eggs</li></ul><h2>Steps</h2><p>Mix {i}</p>"
              f"<h3>Follow us</h3><p>On all channels</p></article>") for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("live", F.lit("clash"))
    assert {r.page_id: r.text for r in W.extract(df).collect()} == {
        i: f"Cake {i}\nIngredients\n{i} eggs\nSteps\nMix {i}" for i in range(10)}


@pytest.mark.parametrize("html, want", [
    ("<p title=\"5\" tall\">first<p>second", ["first", "second"]), ("<p><a href='x' title=it's>link</a> text", ["link text"]),
    ("<p title=\"a > b\">x", ["x"]), ("<p title='open>x</p><p>y</p>", ["x", "y"]), ("<p data-x= \"a'b\" '>x", ["x"]), ("<p>a < b and c > d", ["a < b and c > d"])])
def test_odd_quotes_in_tags(html, want):
    assert shown(f"<article>{html}</article>") == want
