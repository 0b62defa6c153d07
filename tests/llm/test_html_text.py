"""Main texts of web pages against a plain reading of the given pages, and odd markup."""

import html
import re
import time

import numpy as np
import pytest

from rankfold.llm import html_text

SF = "/root/testdata/sf0.001"
TREE = html_text.train(*html_text.labelled())
LONG = "word " * 30


def text(page):
    return html_text.main_texts([page], TREE)[0]


def plain(page):
    """The article of a given page: every one has an article element of paragraphs without links."""
    article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    pieces = [html.unescape(re.sub("<[a-z/][^>]*>", " ", piece)) for piece in re.split("</?p>|</h1>", article)]
    return "\n".join(" ".join(p.split()) for p in pieces if p.strip())


def test_given_pages(spark):
    from rankfold.llm.html_text import op11_html_text

    got = {r.page_id: r for r in op11_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        assert got[page.page_id].text == plain(page.html) and got[page.page_id].url == page.url
        assert got[page.page_id].n_chars == len(plain(page.html))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Short.</p><p>Other", "Short.\nOther"),
        ("<div class=ad>buy <article><p>One.<p>Two <a href=x>three</a>&nbsp;&lt;b&gt; &am &amp", "One.\nTwo three <b> &am &"),
        ("<nav><a href=/>Home</a></nav><main><h1>T</h1> a\n\t b<br>c <b>d</b>e</main><footer>f</footer>", "T\na b c de"),
        (f"<div class=sidebar>side</div><div id=content><p>x</p><div class='cookie-notice'>{LONG}</div><p>y</p></div>", "x\ny"),
        (f"<article><p>x</p></article><div id=comments><article class=comment>{LONG}</article></div>", "x"),
        (f"<ul><li><a href=/>Home</a><li><a>About</a></ul><p>{LONG}</p><p>tiny</p><p>{LONG}</p>", f"{LONG.strip()}\ntiny\n{LONG.strip()}"),
        ("<main>a<form><label>Name</label><p>Leave us your address here</p><button>Go</button></form>b</main>", "a\nb"),
        ("<article>a<script>if (a<b) '</article>'</script>b<style>p{}</style><!-- <p>x</p> --><p hidden>h</p>c", "ab\nc"),
        ("<form><main><p>text in a page that is one form</p></main></form>", "text in a page that is one form"),
        ("<article><p title='a>b' x=\"open>one</p>1 < 2 & 3 <3</article>", "one\n1 < 2 & 3 <3"),
        ("<article><header><h1>T</h1></header>b<aside>see</aside><footer>tags</footer></article>", "T\nb"),
        ("no markup", "no markup"),
        ("<title>t</title><p>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def test_tree_equals_a_walk_and_fits_its_table():
    rows, labels = html_text.labelled()
    assert (TREE.predict(rows) == labels).all()
    draw = np.random.RandomState(1)
    rows = np.concatenate([rows, draw.randint(0, 40, (300, len(html_text.NAMES))).astype(float)])

    def walk(row):
        at = 0
        while TREE.feature[at] >= 0:
            at = TREE.left[at] if row[TREE.feature[at]] <= TREE.threshold[at] else TREE.right[at]
        return TREE.label[at]

    assert TREE.predict(rows).tolist() == [walk(r) for r in rows]


def test_split_equals_every_split():
    draw = np.random.RandomState(2)
    for _ in range(20):
        rows, labels = draw.randint(0, 6, (30, 4)).astype(float), draw.randint(0, 2, 30)
        least = min(
            sum(part.sum() * (1 - part.mean()) for part in (labels[rows[:, j] <= cut], labels[rows[:, j] > cut]) if len(part))
            for j in range(4)
            for cut in np.unique(rows[:, j])[:-1]
        )
        assert html_text._best_split(rows, labels)[0] == pytest.approx(least)


def test_neighbours_stay_within_their_page():
    pages = [html_text.blocks(f"<p>{'w ' * n}</p><p><a>{'v ' * m}</a></p>") for n, m in ((3, 4), (5, 6))]
    assert html_text.features(pages)[:, :6].tolist() == [
        [3, 0, 0, 0, 4, 1], [4, 1, 3, 0, 0, 0], [5, 0, 0, 0, 6, 1], [6, 1, 5, 0, 0, 0],
    ]


def test_very_long_and_broken_pages_take_linear_time():
    start = time.time()
    for odd in ("<", "<a ", '<p x="', "<!--", "<div>", "</p>", "&", "<script>", "<p class ", "<textarea>", "<p>"):
        text(odd * 100_000)
    assert time.time() - start < 30
    body = "long words " * 200_000
    assert text(f"<nav>x</nav><article><p>{body}</p></article>") == body.strip()


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, N_CHARS int, words string"
    rows = [(1, None, None, "old", 1, "w"), (None, "u", "", "old", 1, "w"), (2, "u", "<article>x</article>", "old", 1, "w")] * 2
    got = html_text.extract_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "words", "text", "n_chars"]
    want = [(1, None, "w", "", 0), (None, "u", "w", "", 0), (2, "u", "w", "x", 1)] * 2
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert html_text.extract_text(spark.createDataFrame(rows, schema).where("false")).count() == 0
