import re
import time

import pytest
from pyspark.sql import functions as F

from martlight.llm import html

CASES = {
    "<article><h1>Title</h1><p>One two<br>three &amp; &lt;four&gt; &eacute;&#39;</p></article>": "Title\n\nOne two three & <four> é'",
    "<nav><a href=/x>Home</a></nav><article><p>Body</p></article><footer>&copy; us</footer>": "Body",
    "<main><p>a</p><form><label>Mail</label><button>Send</button></form><p>b</p></main>": "a\n\nb",
    "<article><p>a</p><div class='share-links'>Share me</div><aside>more</aside><p>b</p></article>": "a\n\nb",
    "<article><p>a</p></article><section id=comments><p>First! A comment of quite a few words here, is it not?</p></section>": "a",
    "<article><p>text<script>var p = '<p>no</p>'</script> goes on</p><style>p{}</style></article>": "text goes on",
    "<article><p>a<p><b>b</b> c<!-- <p>no</p> --></article>": "a\n\nb c",
    "<article><header><h1>T</h1></header><p>x &nbsp; y\n\tz</p></article>": "T\n\nx y z",
    "<div class=cookie-notice>We use cookies on this site and you may accept all of them or leave now</div><main>x</main>": "x",
    "<head><title>No</title><meta charset=utf-8><p>Only text</p>": "Only text",
    "plain text, no markup &amp; more": "plain text, no markup & more",
    "<p>a<p>b <b>c</b>d</p>": "a\n\nb cd",
    "1 < 2 and <b>so": "1 < 2 and so",
    "": "", None: "", "<article></article>": "", "<!-- only -->": "", "<p": "<p",
}


@pytest.mark.parametrize("page,text", CASES.items())
def test_pages(page, text):
    assert html.extract(page) == text


def test_pages_without_an_article():
    body = " ".join(["word"] * 40)
    links = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(6))
    page = f"<div><ul>{links}</ul></div><h2>Head line</h2><p>{body}</p><p>short</p><p>{body}</p><div><a href=x>More of this</a></div>"
    assert html.extract(page) == f"Head line\n\n{body}\n\nshort\n\n{body}"


def test_tree_agrees_with_its_table():
    wrong = [row for row in html.TRAINING if html.tree().says(row[:-1]) != bool(row[-1])]
    assert not wrong
    says = html.tree().says
    for words in (1, 7, 300):
        for share in (0.0, 0.5, 1.0):
            alone, run = (words, share, 3, 0.0, 2, 0.0, 0, 1, 0), (words, share, 3, 1.0, 2, 1.0, 0, 1, 0)
            # Within an article only runs of links are not text; furniture is not text anywhere.
            assert says((*alone, 0)) and says((*run, 0)) == (share < 1)
            assert not says((*alone, 1)) and not says((*run, 1))


def test_long_and_broken_pages():
    assert html.extract("<article><p>" + "x " * 500_000) == " ".join(["x"] * 500_000)
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 7000) == "deep"
    assert html.extract("</p></div></article>text") == "text"


def plain_article(page):
    """The given pages' article, read plainly: they hold one, with paragraphs, headings and inline marks."""
    body = page.split("<article>")[1].split("</article>")[0]
    body = re.sub(r"<(script|style|nav|aside|footer|form)\b.*?</\1>|<!--.*?-->|<div class=\"ad\">.*?</div>", "", body, flags=re.S)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote)\b[^>]*>", body)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " * (m[0] == "<br>"), part)).split()) for part in parts)
    return "\n\n".join(filter(None, texts))


def test_given_pages_are_their_articles(spark):
    from tests.compare import TEST_DATA

    pages = spark.read.parquet(f"{TEST_DATA}/sf0.01/pages.parquet")
    for row in html.extract_text(pages).collect():
        assert row["text"] == plain_article(row["html"])


def test_frame(spark):
    rows = [(1, "u", "<article>é</article>", "t"), (1, "u", "<article>é</article>", "t"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract_pages(df).orderBy(F.col("page_id").asc_nulls_first()).collect()
    assert [tuple(r) for r in found] == [(None, None, "", 0), (1, "u", "é", 1), (1, "u", "é", 1)]
    assert html.extract_pages(df.limit(0)).count() == 0


LONG_TEXT = " ".join(["plain"] * 60)
NAMED = {
    "<div class='layout has-sidebar'><article><p>Body</p></article></div>": "Body",
    "<div id=content-with-sidebar><p>Intro</p><article><p>Body</p></article></div>": "Body",
    "<article class='post tag-ads'><p>Body</p></article>": "Body",
    "<main class=no-header><p>Body</p></main>": "Body",
    "<div class=sidebar-page><main><p>Body</p></main></div>": "Body",
    "<div class=widget><article class=promo><p>Body</p></article></div>": "Body",
    "<article><div class=post-header><h1>Title</h1></div><p>Body</p></article>": "Title\n\nBody",
    f"<article><div class=share-wrap><p>{LONG_TEXT}</p><a href=x>Share</a></div></article>": LONG_TEXT,
    "<article><p>Body</p></article><div class=related><article><a href=x>Teaser</a></article></div>": "Body",
    "<article><p>Body</p><article class=comment><p>First!</p></article></article>": "Body",
    "<article><p>a</p><span class=ad>buy</span><p>b</p></article>": "a\n\nb",
}


@pytest.mark.parametrize("page,text", NAMED.items())
def test_a_name_alone_does_not_drop_what_a_wrapper_holds(page, text):
    assert html.extract(page) == text


def test_long_plain_blocks_beside_articles_are_text():
    cards = "".join(f"<article><h3><a href=/{k}>Card {k}</a></h3></article>" for k in range(3))
    for words in (40, 100, 700):
        body = " ".join(["word"] * words)
        found = html.extract(f"<div><p>{body}</p><p>{body}</p></div>{cards}<div><p>Short line</p></div>").split("\n\n")
        assert found[:2] == [body, body] and "Short line" not in found
        for beside in (f"<div class=comments><p>{body}</p></div>", f"<p><a href=x>{body}</a></p>", f"<footer>{body}</footer>", " ".join(["word"] * 39)):
            assert html.extract(f"<article><p>Body</p></article>{beside}") == "Body"


SKIPPED = {
    "<article><p>a</p><svg width=3/><p>b</p></article>": "a\n\nb",
    "<article><p>a</p><svg><svg><text>no</text></svg><text>no</text></svg><p>b</p></article>": "a\n\nb",
    "<article><p>a</p><svg><g><p>b</p></article>": "a\n\nb",
    "<article><p>a</p><svg><foreignObject><p>no</p></foreignObject></svg><p>b</p></article>": "a\n\nb",
    "<article><template><template>no</template>no</template><p>a</p><object><object>no</object>no</object></article>": "a",
    "<article><p>So <math><mi>E</mi> = <mi>m</mi><annotation>no</annotation></math> holds</p></article>": "So E = m holds",
    "<article><p>a</p><script>if (a < b) '<p>no'</script x><p title='1 > 0'>b</p></article>": "a\n\nb",
    "<article><p 5\">a</p><p>b</p></article>": "a\n\nb",
    "<article><p>a</p><p data-class=ad>b</p></article>": "a\n\nb",
}


@pytest.mark.parametrize("page,text", SKIPPED.items())
def test_elements_without_text(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("name", ["comments", "advert", "user-comments", "ad", "reply", "cookie-notice"])
def test_comments_and_adverts_are_out_at_any_length(name):
    for words in (1, 39, 40, 60, 500):
        box = f"<div class='{name}'>{' '.join(['word'] * words)}</div>"
        assert html.extract(f"<article><p>Body</p>{box}<p>End</p></article>") == "Body\n\nEnd"


def test_links_within_articles():
    run = "<ul><li><a href=1>One here</a></li><li><a href=2>Two here</a></li></ul>"
    assert html.extract(f"<article><h1><a href=/>T</a></h1><p>Body of it</p>{run}<p>End of it</p></article>") == "T\n\nBody of it\n\nEnd of it"
    lone = "<article><p>Body</p><p><a href=x>The whole report</a></p><p>End</p></article>"
    assert html.extract(lone) == "Body\n\nThe whole report\n\nEnd"


def test_articles_of_linked_headings_do_not_hide_the_text():
    body = " ".join(["word"] * 30)
    assert body in html.extract(f"<article><h3><a href=x>Teaser</a></h3></article><div><p>{body}</p></div>")


@pytest.mark.parametrize("page", [
    "<a b " * 20_000, '<a b="' * 20_001, "<div>" * 20_000 + "</p>" * 20_000, "<div class=ad>x" * 20_000,
    "<article class=ad>x" * 20_000, "<svg><text>" * 20_000, "<!--" * 20_000, "<a =" + "= " * 50_000,
    '<p class="tag-' + "ad-" * 50_000 + '">x', "<script></script " * 20_000, "<p>x" * 20_000 + "</div>" * 20_000,
], ids=range(11))
def test_broken_pages_take_linear_time(page):
    begin = time.monotonic()
    html.extract(page)
    html.extract("<article>" + page)
    assert time.monotonic() - begin < 10
