"""Main-text extraction: the given pages against their article, and pages whose markup misleads."""

import html as entities
import re

import pytest

from career_index.llm import html_extract as H
from career_index.sources.tables import table

SF = "/root/testdata/sf0.01"
BLOCK = re.compile(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|pre|table|tr|td|th|figure|figcaption|article|dl|dt|dd|hr)\b[^>]*>", re.I)


@pytest.fixture(scope="module")
def trees(spark):
    return H.fit(table(spark, SF, "pages"))


def article_text(page):
    """What stands between the tags of the article, by patterns alone."""
    inner = re.search(r"<article\b[^>]*>(.*)</article>", page, re.S | re.I)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S | re.I)
    parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", x, flags=re.I)))).strip() for x in BLOCK.split(inner))
    return "\n\n".join(x for x in parts if x)


def test_given_pages_equal_their_articles(spark, trees):
    rows = H.extract(table(spark, SF, "pages"), trees=trees).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    assert [r.page_id for r in rows if r.text != article_text(r.html)] == []
    assert all(r.n_chars == len(r.text) for r in rows)


def test_structure_alone_finds_the_text(spark, trees):
    """With the meaning of tags and attribute tokens hidden, on pages that the trees were not fitted on."""
    pages = [r.html for r in table(spark, "/root/testdata/sf0.1", "pages").orderBy("page_id").limit(900).collect()][250:]
    right = 0
    for page in pages:
        root = H.parse(page)
        nodes, x = H.features(root)
        right += "\n\n".join(H.blocks(root, H.decide(nodes, trees.score(H.hidden(x))))) == article_text(page)
    assert right >= 0.95 * len(pages)


def story(n):
    return "".join(f"<p>{'Some sentence of the story, with a few words more. ' * k}</p>" for k in range(2, 2 + n))


MENU = "<div class=menu><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></div>"
FOOT = "<footer>Copyright 2024 Someone</footer>"
TITLE = "<h1>Title of it</h1>"
PAGES = {
    "whole page in a span": f"<span>{MENU}<article>{TITLE}{story(5)}</article>{FOOT}</span>",
    "whole page in a font": f"<font>{MENU}<article>{TITLE}{story(5)}</article>{FOOT}</font>",
    "advert in an ins": f"{MENU}<article>{TITLE}{story(3)}<ins><div class=ad>Buy cheap things now</div></ins>{story(3)}</article>{FOOT}",
    "advert in a link": f"{MENU}<article>{TITLE}{story(3)}<a href=x><div class=sponsored>Buy cheap things now</div></a>{story(3)}</article>{FOOT}",
    "links beside the article": f"<a href=/>Home</a> <a href=/b>Blog</a><article>{TITLE}{story(5)}</article>{FOOT}",
    "a subject that sounds like boilerplate": f'{MENU}<div class="article social-policy-story">{TITLE}{story(5)}</div>{FOOT}',
    "headline in a header of the post": f'{MENU}<article><div class="post-header">{TITLE}</div>{story(5)}</article>{FOOT}',
    "no telling names": f"<div><a href=/>Home</a><a href=/b>Blog</a></div><div>{TITLE}{story(5)}</div><div>&copy; 2024 Someone</div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_markup_that_misleads(trees, name):
    own = [re.sub(r"\s+", " ", x).strip() for x in re.findall("<p>(.*?)</p>", PAGES[name])]
    assert H.main_texts([f"<html><body>{PAGES[name]}</body></html>"], trees) == ["\n\n".join(["Title of it", *own])]


def test_decoding_takes_the_best_choice_without_contradictions():
    """Against all choices on small trees."""
    import itertools
    import random

    import numpy as np
    rng = random.Random(4)
    for _ in range(80):
        root = H.Node("#root", frozenset(), None)
        nodes = []
        for _ in range(rng.randrange(1, 8)):
            nodes.append(H.Node("div", frozenset(), rng.choice([root, *nodes])))
        score = np.array([rng.choice([-2.5, -1.0, 0.75, 2.0]) for _ in nodes])
        place = {id(n): k for k, n in enumerate(nodes)}

        def total(choice):
            ok = all(not c or n.parent is root or choice[place[id(n.parent)]] for n, c in zip(nodes, choice, strict=True))
            return sum(score[np.array(choice)]) if ok else -np.inf

        kept = H.decide(nodes, score)
        got = [kept[id(n)] for n in nodes]
        assert total(got) == max(total(c) for c in itertools.product([False, True], repeat=len(nodes)))


def test_defined_edges(spark, trees):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = f"<body>{MENU}<article>{TITLE}{story(2)}{'<p>One more line of the long text, and then some.</p>' * 20_000}</article>{FOOT}</body>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", f"<article>{story(3)}</article>", "x"), (3, "u", long, "x"), (3, "u", long, "x"), (4, "u", deep, "x"),
            (5, "u", "<p>cut <b", "x"), (6, "u", "<script>var a = '<p>no</p>'", "x")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), trees=trees).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].text == by[2].text == by[6].text == "" and by[2].url is None
    assert by[None].text.count("\n\n") == 2
    assert by[3].text.count("\n\n") == 20_002 and by[3].text.startswith("Title of it\n\n")
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), trees=trees).count() == 0


def test_a_sample_with_one_label_falls_back_to_a_rule(spark):
    df = spark.createDataFrame([(1, "u", f"<div>{story(2)}</div>")], "page_id long, url string, html string")
    assert H.fit(df) is None
    assert H.extract(df).first().text.count("\n\n") == 1
    assert H.extract(df.limit(0)).count() == 0
