import pytest

from quarryline.llm.html_extract import best_stretch, extract, html_extract, labelled_pages, learn_weights


@pytest.fixture(scope="module")
def weights():
    return learn_weights(labelled_pages())


def test_labelled_pages_come_back(weights):
    assert sum(extract(h, weights) == t for h, t in labelled_pages()) >= 0.95 * len(labelled_pages())


def test_test_pages_give_the_article(spark, sf):
    import html as H
    import re

    for r in html_extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<html><body><header class="top"><a href=/>Home page of things</a></header><nav><a>One</a> <a>Two</a></nav>
<div id="cookie-notice">We use cookies on this site to track you, accept?</div>
<article><header><h1>Title &amp; more</h1></header><p>First   paragraph of <b>bold</b> text&nbsp;here, with quite a few words in it.</p>
<aside>Buy now this thing, the best thing ever made for you today.</aside><div class="advert">An advert inside of the article with words.</div>
<ul><li>one item<li>two item</ul><form><label>Mail</label><input><button>Go</button></form><script>var x = "</p><p>no";</script>
<p>Last paragraph, cut by a<br>line break and &lt;escaped&gt; &copy; signs.</p>
<section class="comments"><p>Reader says something long and winding about the article and more.</p></section></article>
<div class="sidebar"><p>Related stuff with many words that should not be there at all, never.</p></div><footer>Copyright words 2024</footer></body></html>"""


def test_parts_around_and_inside_an_article(weights):
    assert extract(PAGE, weights).split("\n\n") == ["Title & more", "First paragraph of bold text here, with quite a few words in it.", "one item", "two item", "Last paragraph, cut by a line break and <escaped> © signs."]


def test_a_page_without_article(weights):
    page = "<body><ul class=menu><li><a>Home</a><li><a>About</a></ul><div><p>The first paragraph has many words in it for sure.</p><p>The second one has many words as well, no less.</p></div><div><a>x</a> <a>y</a></div></body>"
    assert extract(page, weights) == "The first paragraph has many words in it for sure.\n\nThe second one has many words as well, no less."


def test_odd_input(spark, weights):
    assert extract("plain  text only", weights) == "plain text only"
    assert extract("<p>cut off <a href='", weights) == "cut off"
    assert extract("<!-- only a comment", weights) == "" and extract("<script>x", weights) == ""
    assert extract("<article><p>no end of it", weights) == "no end of it"
    assert extract("<p>" + "long " * 200_000, weights) == ("long " * 200_000).strip()
    assert extract('<a title="x>' * 3000, weights) == ""
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, "", 5), (2, "v", "<p>hi there</p>", 5)]
    got = html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (2, "v", "hi there", 8)], key=repr)
    assert html_extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_comments_marked_up_as_articles(weights):
    page = "<main><article><p>The story has a number of words.</p></article><article class='comment'><p>A reader writes some words.</p></article><article><p>And the story goes on with more.</p></article></main><div>Not this, ever, at all.</div>"
    assert extract(page, weights) == "The story has a number of words.\n\nAnd the story goes on with more."


def test_markup_that_never_closes_takes_linear_time(weights):
    assert extract("<article>" + "<b><i>x " * 50_000 + "</u></p>" * 50_000, weights) == ("x " * 50_000).strip()


@pytest.mark.parametrize("scores", [[1, -2, 3, 4, -1, 5], [-1, -2], [], [2, -1, 2, -5, 3.5], [0, 0, 1]])
def test_stretch_equals_brute_force(scores):
    a, b = best_stretch(scores)
    assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


STORY = "<h1>A title of it</h1><p>The story has a good number of words in it.</p><p>And it goes on with more of them.</p>"
LINES = ["A title of it", "The story has a good number of words in it.", "And it goes on with more of them."]


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content-sidebar-wrap'><article>{STORY}</article></div></body>",
        f"<body><article class='post has-sidebar'>{STORY}</article></body>",
        f"<body><form action=/><ul class=menu><li><a href=/>Home</a></ul><article>{STORY}</article><input></form></body>",
        f"<body><form action=/><div>{STORY}</div></form></body>",
        f"<body><div class='content-sidebar-wrap'><div>{STORY}</div></div></body>",
        f"<body><div class='content-sidebar-wrap'><main>{STORY}</main><div class='sidebar'><article><p>Another story told in few words.</p></article></div></div></body>",
    ],
)
def test_what_holds_the_article_stays(weights, page):
    assert extract(page, weights).split("\n\n") == LINES


def test_ids_of_sections_in_an_article(weights):
    page = f"<body><article>{STORY}<section id='discussion'><h2 id='side-effects'>Side effects seen</h2><p>What was seen is told here in words.</p></section><div id='related'><a href=/1>Other story</a> <a href=/2>Next one</a></div></article></body>"
    assert extract(page, weights).split("\n\n") == [*LINES, "Side effects seen", "What was seen is told here in words."]
