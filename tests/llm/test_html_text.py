import itertools
import math
import random
import re
import time

import pytest

from tierline.llm import html_text as ht
from tierline.llm.common import table

SCHEMA = "text string, html string, page_id long, url string, n_chars int"


def by_hand(page):
    """For pages whose only article is marked as such and whose paragraphs hold inline tags only."""
    inside = re.sub(r"(?s)^.*?<article>|</article>.*$|<footer>.*$", "", page)
    blocks = re.split(r"</?(?:p|h1|article)\b[^>]*>", inside)
    import html

    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split())))


def test_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r["page_id"]: by_hand(r["html"]) for r in pages.collect()}
    got = ht.extract(pages).collect()
    assert len(got) == len(want)
    bad = [r["page_id"] for r in got if r["text"] != want[r["page_id"]]]
    assert not bad, (bad[:3], len(bad))
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_marginals_equal_enumeration():
    rnd = random.Random(1)
    pair = ((math.log(0.9), math.log(0.1)), (math.log(0.3), math.log(0.7)))
    for _ in range(40):
        n = rnd.randint(1, 8)
        parent = [-1] + [rnd.randrange(i) for i in range(1, n)]
        evidence = [rnd.uniform(-3, 3) for _ in range(n)]
        free = [i == 0 or rnd.random() < 0.2 for i in range(n)]
        total, content = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e for e, s in zip(evidence, states) if s) + sum(pair[states[parent[i]]][states[i]] for i in range(1, n) if not free[i]))
            total += w
            for i, s in enumerate(states):
                content[i] += w * s
        assert ht.marginals(parent, evidence, free, pair) == pytest.approx([c / total for c in content])


OTHER = """<html><body><header><a href=/>Home</a></header><div id="cookie-notice"><p>We use cookies, a lot of them.</p></div>
<main><div class="post-content"><h1>A  title</h1><p>First &amp; <b>best</b>&nbsp;line.</p><ul><li>one<li>two</ul>
<div class="advert"><p>Buy now, please, it is cheap.</p></div><form><p>Your name</p><input></form><table><tr><td>a<td>b</table>
<section class="comments"><div><p>Great article, thanks a lot.</p><p>Me too, I liked it, really.</p><p>And me, I liked it, really.</p></div></section></div></main>
<aside><p>Related stories, many of them.</p></aside><div class=sidebar><p>Nothing, nothing, nothing here.</p></div><footer>&copy; us</footer><script>"<p>no</p>"</script>"""


def test_other_layout(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    model = ht.learn(pages)
    assert ht.main_text(OTHER, model).split("\n") == ["A title", "First & best line.", "one", "two", "a", "b"]
    plain = "<body><div>" + "<p>A long paragraph, with words, and more words in it, and so on.</p>" * 3 + "</div></body>"
    assert len(ht.main_text(plain, model).split("\n")) == 3
    for odd in (None, "", "<", "<p", "no tags", "<p><a href='x>y</p>", "</p></div>", "<script>x", "<article>" * 3000 + "x", "<p>" * 20000 + "x", "<" * 100000, "<a '" * 20000):
        ht.main_text(odd, model)


def test_rows(spark):
    df = spark.createDataFrame([("t", "<article><p>x\n y</article>", 1, "u", 0), ("t", None, 2, None, 0), ("t", "", None, "u", 0), ("t", "<article><p>x\n y</article>", 1, "u", 0)], SCHEMA)
    got = sorted(map(tuple, ht.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", "x y", 3), (2, None, "", 0), (None, "u", "", 0), (1, "u", "x y", 3)], key=repr)
    assert ht.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["content", "content no-sidebar", "post-content has-comments", "page-header-fixed", "wrap withSidebar", "main-menu-collapsed"])
def test_state_of_a_page_is_no_verdict(spark, name):
    model = ht.learn(table(spark, "/root/testdata/sf0.001", "pages"))
    lines = [f"Paragraph {i} tells a long story, with words, and more words in it, and so on." for i in range(4)]
    page = f"<body><div class='{name}'>" + "".join(f"<p>{x}</p>" for x in lines) + "<div class='sidebar'><p>Related, and so on.</p></div></div></body>"
    assert ht.main_text(page, model).split("\n") == lines


def test_end_tags_that_match_none():
    start = time.monotonic()
    ht.parse("<div>" * 30_000 + "x" + "</section>" * 30_000)
    assert time.monotonic() - start < 10
