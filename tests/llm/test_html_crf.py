import html
import re

import pyarrow.parquet as pq
import pytest

from leafmill.llm import html_crf
from leafmill.llm.labelled_pages import labelled_pages
from leafmill.llm.page_blocks import blocks


@pytest.fixture(scope="module")
def field():
    return html_crf.trained_field()


def test_labelled_pages_have_a_label_for_each_block():
    assert all(len(blocks(p.html)) == len(p.labels) for p in labelled_pages(200, 50_000))


def test_held_out_accuracy(field):
    pages = labelled_pages(300, 10_000)
    found = [(field.decode(blocks(p.html)), p.labels) for p in pages]
    right = sum(a == b for x, y in found for a, b in zip(x, y, strict=True))
    assert right / sum(len(y) for _, y in found) > 0.995
    assert sum(x == y for x, y in found) / len(pages) > 0.95


def test_articles_of_the_test_pages(field, sf):
    for row in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"</?(?:p|h1)>", article))
        assert html_crf.main_text(field, row["html"]) == "\n".join(p for p in parts if p)


def test_viterbi_is_the_best_of_all_labellings(field):
    page = blocks(labelled_pages(1, 77)[0].html)[:10]

    def weight(labels):
        total = field.first * labels[0]
        for b, y in zip(page, labels, strict=True):
            total += y * field.features[html_crf.active(b.features)].sum()
        return total + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:], strict=False))

    every = [[n >> i & 1 for i in range(len(page))] for n in range(1 << len(page))]
    assert abs(weight([int(x) for x in field.decode(page)]) - max(map(weight, every))) < 1e-9


def test_what_surrounds_an_article_goes(field):
    page = """<html><body><!-- <p>no</p> --><div id=cookie-consent><p>We use cookies on this site. They are fine.</p></div>
    <header><h1><a href='/'>The Site</a></h1></header><nav><ul><li><a href=/a>One<li><a href=/b>Two</ul></nav>
    <div class="content"><article><h1>A title &amp; more</h1><p>First   paragraph with an <a href="x>y">inner link</a>,&nbsp;and a<br>break.
    <p>Second one &lt;b&gt; &#233;&#x1F600;. It has two sentences.<script>if (a < b) document.write("</p>")</script></p>
    <div class="ad-box">Buy now, it is cheap.</div><p>The last paragraph is here, at the end of all.</p></article>
    <section class="comments"><h3>Comments</h3><div class=comment><p>Nice one. I liked the article a lot.</p></div></section></div>
    <aside class=sidebar><h3>Related</h3><ul><li><a href=/c>Three more</a></ul></aside>
    <form action=/s><label>Search</label><input></form><footer>&copy; 2020 The Site</footer></body></html>"""
    assert html_crf.main_text(field, page).split("\n") == [
        "A title & more",
        "First paragraph with an inner link, and a break.",
        "Second one <b> é😀. It has two sentences.",
        "The last paragraph is here, at the end of all.",
    ]


def test_odd_pages(spark, field):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "just text, no markup at all", None), (3, "u", "<p>unclosed <b>tags <", "t")]
    rows += [(4, "u", "<div>" * 20_000 + "deep", "t"), (5, "u", "<article><p>" + "long words " * 200_000 + "</p></article>", "t"), (5, "u", None, "t")]
    rows += [(6, "u", "<script>never closed", "t"), (7, "u", "<!-- never closed <p>x</p>", "t"), (8, "u", "<a href='never closed>x</a>", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_crf.extract(frame, field).collect()
    assert sorted(map(repr, [r[0] for r in rows])) == sorted(repr(r.page_id) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[6] == by_id[7] == ""
    assert all(r.text is not None for r in got)
    assert by_id[5] in ("", ("long words " * 200_000).strip())
    assert html_crf.extract(frame.limit(0), field).count() == 0
