"""Main text of pages: the decoding by brute force, held-out layouts, given pages and broken markup."""

import html
import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from tessaline.llm import html_text
from tessaline.llm.queries import QUERIES

PAGE = (
    "<html><body><nav><a href=/>Home</a></nav><div class='post'><h1>T &amp; U</h1><p>One  two\n three. Four five six.</p><div class='ad'>Buy now!</div>"
    "<p>More text here, and more of it.</p><div class='comments'><p>Nice article, thanks a lot.</p></div></div><aside>Side things</aside><footer>&copy; x</footer></body></html>"
)
TEXT = "T & U\nOne two three. Four five six.\nMore text here, and more of it."


@pytest.fixture(scope="module")
def model():
    return html_text.fitted()


def test_decoding_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        page = html_text.Page()
        for _ in range(rng.randint(1, 7)):
            page.add(rng.randrange(len(page.parent)), "div", {})
        n = len(page.parent)
        enters, leaves = ([rng.gauss(0, 2) for _ in range(n)] for _ in range(2))
        yes = lambda odds: -math.log1p(math.exp(-odds))
        best = None
        for states in itertools.product((0, 1, 2), repeat=n - 1):
            states, total = (0, *states), 0.0
            for at in range(1, n):
                above, own = states[page.parent[at]], states[at]
                if (above, own) not in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2)):
                    break
                total += {(0, 0): yes(-enters[at]), (0, 1): yes(enters[at]), (1, 1): yes(-leaves[at]), (1, 2): yes(leaves[at]), (2, 2): 0.0}[above, own]
            else:
                if best is None or total > best[0] + 1e-12:
                    best = (total, [s == 1 for s in states])
        assert html_text.decode(page, enters, leaves) == best[1]


def test_trees_learn_and_know_numbers_from_marks():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 3)), rng.integers(0, 2, (3000, 4))], axis=1).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    trees = html_text.Trees(x[:2000], y[:2000], 3)
    assert ((trees.log_odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97


def test_held_out_layouts(model):
    exact = kept = lost = extra = 0
    sources = html_text.layouts(200, seed=77)
    for source, got in zip(sources, model.texts(sources)):
        page = html_text.parse(source)
        want = html_text.text_of(page, html_text.marked(page))
        exact += got == want
        a, b = want.split("\n"), got.split("\n")
        kept, lost, extra = kept + len(set(a) & set(b)), lost + len(set(a) - set(b)), extra + len(set(b) - set(a))
    assert exact >= 150 and lost < 0.08 * kept and extra < 0.08 * kept


def test_text_and_broken_markup(model):
    assert model.texts([PAGE, "", "<html><body><nav><a>x</a></nav></body></html>"]) == [TEXT, "", ""]
    odd = "<article><p>a &amp; b &lt;c&gt; &#233; &nbsp; x &unknown; &copy</p>text<br>after<script>no</p></script><style>p{}</style><!-- no --><p>un<b>closed</article>tail"
    assert model.texts([odd]) == ["a & b <c> é x &unknown; ©\ntext after\nunclosed"]


@pytest.mark.parametrize("unit", ["<", '<a "', "<div>", "</div>", "<p>", "<ul><li>", "<!--", "<script>", "<a ", "&amp", "<li>", "<td><div>", "<p>x</p>", "a < b "])
def test_time_is_linear(model, unit):
    began = time.perf_counter()
    model.texts([unit * (300_000 // len(unit))])
    assert time.perf_counter() - began < 20


def test_given_pages(spark):
    """The given pages have one article element; its blocks are read by patterns here."""
    path = "/root/testdata/sf0.001"
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        blocks = re.split("</?(?:p|h1)>", re.search("(?s)<article>(.*?)</article>", rows[r["page_id"]]["html"])[1])
        plain = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
        assert r["text"] == "\n".join(b for b in plain if b) and r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (4, "v", PAGE), (4, "v", PAGE), (5, "w", PAGE.replace("One", "One " * 200_000)), (6, "w", "\x00<\ud83d"[:2] + "é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_text.extract(df).collect()))
    long = TEXT.replace("One", "One " * 199_999 + "One")
    assert got == sorted([(1, "u", "", 0), (2, "", "", 0), (0, "u", TEXT, len(TEXT)), (4, "v", TEXT, len(TEXT)), (4, "v", TEXT, len(TEXT)), (5, "w", long, len(long)), (6, "w", "", 0)])
    assert html_text.extract(df.limit(0)).collect() == []
