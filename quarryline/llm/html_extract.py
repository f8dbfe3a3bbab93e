"""The main text of web pages: the maximum-scoring stretch of words and tags.

A page is read as a sequence of tags and runs of words.  Elements that a fixed
list of tags and of parts of class, id and role names (``CUT_TAGS``, ``MARKS``)
takes for scripts, menus, forms, adverts, reader comments and the like are cut
out first, but never the article or main element with the most words nor what
holds it.  Without such an element, one that holds most of the page's words stays
if it is a form or only a part of a name marks it.  In an article, headings stay, and
an id alone cuts only what is mostly links or holds a form.  Of what remains, words score positive and tags negative, and one linear scan
finds the contiguous stretch with the highest sum.

Weights are log-odds counted on labelled pages, whose main text is marked, by
where a token stands: in an article or main element, beside one, or on a page
without any.  A tag's is that of standing between the first and the last word of
the main text, for its kind (the edge of an article, a list, another block,
formatting), and never above a small negative number.  A word's also depends on
whether it is in a link.  Words beside an article come out negative, as they are
never main text on the labelled pages; in an article they come out positive.

The text is that of the stretch's blocks, in page order: character references
decoded, white space inside a block turned into one space, blocks trimmed and
joined by two line feeds.  A line break inside a block is white space.

Defined results: null and empty pages give an empty text; markup that ends in
the middle is read as far as it goes; a page without tags is all text; a null
id is an id like any other; repeated rows are read alike; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|title)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/][^<>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTENT = frozenset(("article", "main"))
LISTS = frozenset("ul ol li dl dt dd table tr td th tbody thead".split())
# Parts of class, id and role names, as whole words, that mark what is no main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side aside menu menubar nav navbar navigation breadcrumb breadcrumbs"
    " header masthead footer foot cookie cookies consent notice notices alert popup modal dialog overlay newsletter subscribe subscription signup login search share sharing social"
    " comment comments commentlist disqus reply replies respond discussion related recommended pagination pager toolbar widget complementary contentinfo hidden copyright gdpr".split()
)
CUT_TAGS = frozenset("nav aside footer form menu dialog button fieldset input label header".split())
WORD = re.compile(r"\S+")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def measure(page: str) -> tuple[dict[int, tuple[int, int, int, int]], int | None, int]:
    """Of each element, by where its tag begins: where it ends, words, words in links, forms; where the largest article begins; words of the page."""
    out: dict[int, tuple[int, int, int, int]] = {}
    stack: list[tuple[str, int, int, int, int]] = []
    opened: Counter[str] = Counter()
    words = linked = forms = at = most = 0
    chief = None

    def close(end: int) -> None:
        nonlocal chief, most
        n, first, w, k, f, fit = stack.pop()
        opened[n] -= 1
        out[first] = end, words - w, linked - k, forms - f
        if fit and words - w > most:
            chief, most = first, words - w

    for m in TOKEN.finditer(page):
        n = len(WORD.findall(page[at : m.start()]))
        words, linked, at = words + n, linked + n * (opened["a"] > 0), m.end()
        if m[1] or not m[3]:
            forms += (m[1] or "").lower() in ("textarea", "select")
            continue
        name = m[3].lower()
        if m[2]:
            if opened[name]:
                while stack[-1][0] != name:
                    close(m.start())
                close(m.start())
            continue
        if stack and stack[-1][0] == "p" and name in ENDS_PARAGRAPH or stack and name == stack[-1][0] == "li":
            close(m.start())
        if name not in VOID and not m[4].endswith("/"):
            fit = name in CONTENT and not any(opened[x] for x in ("aside", "nav", "footer")) and not any(_marks(m[4])[::3])
            stack.append((name, m.start(), words, linked, forms, fit))
            opened[name] += 1
        forms += name in ("form", "input")
    n = len(WORD.findall(page[at:]))
    words, linked = words + n, linked + n * (opened["a"] > 0)
    while stack:
        close(len(page))
    return out, chief, words


def parse(page: str) -> list[tuple]:
    """("text", run, in article, in link) and ("tag", name, in article) in page order, cut elements left out."""
    out: list[tuple] = []
    stack: list[tuple[str, bool]] = []  # open elements: name, whether it starts a cut
    opened: Counter[str] = Counter()  # how many of each name
    cut = content = link = at = 0
    sizes, chief, words = measure(page)
    for m in TOKEN.finditer(page):
        if m.start() > at and not cut:
            out.append(("text", page[at : m.start()], content > 0, link > 0))
        at = m.end()
        if m[1]:
            continue
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            if opened[name]:
                n = ""
                while n != name:
                    n, c = stack.pop()
                    opened[n] -= 1
                    cut -= c
                    content -= n in CONTENT and not cut and not c
                    link -= n == "a" and not cut and not c
            if not cut:
                out.append(("tag", name, content > 0))
            continue
        if name in ENDS_PARAGRAPH and stack:
            _close(stack, opened, out, "p", ENDS_PARAGRAPH - {"p"}, cut, content > 0)
        if name in ("li", "tr", "td", "th", "option", "dt", "dd"):
            _close(stack, opened, out, name, frozenset(("ul", "ol", "table", "dl", "menu", "nav", "article", "main", "aside", "div", "section")), cut, content > 0)
        starts = not cut and _is_cut(name, m[4], content > 0, m.start(), sizes, chief, words)
        if not cut and not starts:
            out.append(("tag", name, content > 0))
        if name not in VOID and not m[4].endswith("/"):
            stack.append((name, starts))
            opened[name] += 1
            content += name in CONTENT and not cut and not starts
            link += name == "a" and not cut and not starts
            cut += starts
    if at < len(page) and not cut:
        out.append(("text", page[at:], content > 0, link > 0))
    return out


def _close(stack: list, opened: Counter, out: list, name: str, stops: frozenset, cut: int, in_content: bool) -> None:
    """Ends an open element of that name, unless one of ``stops`` or a cut lies in between."""
    if not opened[name]:
        return
    for i in range(len(stack) - 1, -1, -1):
        n, c = stack[i]
        if n == name and not c:
            # Formatting left open inside it goes with it; links are kept apart.
            if not any(x == "a" or y for x, y in stack[i:]):
                opened.subtract(x for x, _ in stack[i:])
                del stack[i:]
                if not cut:
                    out.append(("tag", name, in_content))
            return
        if c or n in stops:
            return


def _marks(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether a whole class or role name is a mark, a part of one, an id or a part of it; whether the element is hidden."""
    whole = part = by_id = hidden = False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden":
            hidden |= key == "hidden" or value == "true"
        elif key == "id":
            by_id |= bool(MARKS & set(re.split(r"[^a-z]+", value)))
        else:
            whole |= bool(MARKS & set(value.split()))
            part |= bool(MARKS & set(re.split(r"[^a-z]+", value)))
    return whole, part, by_id, hidden


def _is_cut(name: str, attributes: str, in_content: bool, at: int, sizes: dict, chief: int | None, words: int) -> bool:
    if name in ("html", "body"):
        return False
    end, own, linked, forms = sizes.get(at, (at, 0, 0, 0))
    whole, part, by_id, hidden = _marks(attributes) if attributes else (False,) * 4
    if hidden and name != "main":
        return True
    if chief is not None and at <= chief < end:
        return False
    large = chief is None and 2 * own > words
    if name in CUT_TAGS and not (name in ("header", "label") and in_content):
        return name != "form" or not large
    if name == "main" or in_content and name in HEADINGS:
        return False
    if in_content and (whole or part) and not by_id:
        names = {w for key, a, b, c in ATTRIBUTE.findall(attributes) if key.lower() in ("class", "role") for w in re.split(r"[^a-z]+", (a or b or c).lower())}
        if names <= {"header", "entry", "article", "post", "title"}:
            return False
    if whole:
        return True
    if part:
        return not large
    return by_id and not large and (not in_content or forms > 0 or 2 * linked > own)


# Weights


def features(tokens: list[tuple]) -> Iterator[tuple[object, int]]:
    """(feature, how many) of each token: of a text, its words in their place."""
    has = any(t[0] == "tag" and t[1] in CONTENT for t in tokens)
    for t in tokens:
        place = "in" if t[2] else "beside" if has else "free"
        if t[0] == "text":
            yield ("word", place, t[3]), len(WORD.findall(t[1]))
        else:
            kind = "edge" if t[1] in CONTENT else "inline" if t[1] in INLINE else "list" if t[1] in LISTS else "block"
            yield ("tag", place, kind), 1


def learn_weights(labelled: list[tuple[str, str]], smoothing: float = 0.5) -> dict:
    """Log-odds from (html, main text) pairs; blocks of a main text are parted by two line feeds."""
    inside, outside = Counter(), Counter()
    for page, text in labelled:
        blocks = set(text.split("\n\n"))
        tokens = parse(page)
        marks = [t[0] == "text" and bool(b := " ".join(_html.unescape(t[1]).split())) and any(b in x for x in blocks) for t in tokens]
        hits = [i for i, x in enumerate(marks) if x]
        for i, (feature, n) in enumerate(features(tokens)):
            # Tags count as inside between the first and the last main word.
            within = marks[i] if feature[0] == "word" else bool(hits) and hits[0] < i < hits[-1]
            (inside if within else outside)[feature] += n
    weights: dict = {}
    for f in {*inside, *outside}:
        odds = log((inside[f] + smoothing) / (outside[f] + smoothing))
        if f[0] == "tag":
            # Outside an article a tag is taken for an edge until pages show otherwise.
            weights[f] = max(min(odds - log(10.0) * (f[1] != "in"), -0.1), -6.0)
        else:
            weights[f] = max(min(odds, 3.0), -3.0)
    return weights


def labelled_pages() -> list[tuple[str, str]]:
    """Pages of several layouts whose main text is known, made from a rule."""
    out = []
    for k in range(60):
        say = lambda n, s=k: " ".join(f"w{(s * 31 + i * 17 + n) % 997}" for i in range(n)) + "."
        blocks = [say(4 + k % 5), *[say(12 + (k * 7 + j * 13) % 60) for j in range(2 + k % 5)]]
        tag = lambda j, s=k: "li" if (s + j) % 7 == 0 else "h2" if (s + j) % 9 == 0 else "p"
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<{tag(j)}>{b}</{tag(j)}>" for j, b in enumerate(blocks[1:]))
        links = "".join(f'<li><a href="/{i}">{say(2, i)}</a></li>' for i in range(5))
        box = {0: ("<article>", "</article>"), 1: ("<main>", "</main>"), 2: ("<main><article>", "</article></main>"), 3: ("<div>", "</div>")}[k % 4]
        top = f"<nav><ul>{links}</ul></nav><div class='ad'>{say(9)}</div>" if k % 3 else f"<ul>{links}</ul>"
        beside = f"<div>{say(6, k + 1)}</div>" if k % 4 != 3 else ""
        bottom = f"<footer>{say(7)}</footer>" if k % 2 else f"<div>{''.join(f'<a href=/{i}>{say(2, i + 9)}</a>' for i in range(4))}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{blocks[0]}</title></head><body>{top}{beside}{box[0]}{body}{box[1]}{beside}{bottom}</body></html>", "\n\n".join(blocks)))
    return out


# Extraction


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the highest sum; empty if none is positive."""
    best, bounds, run, first = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0.0:
            run, first = 0.0, i
        run += s
        if run > best:
            best, bounds = run, (first, i + 1)
    return bounds


def extract(page: str | None, weights: dict) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tokens = parse(page)
    scores = [weights.get(f, 0.5 if f[0] == "word" else -0.5) * n for f, n in features(tokens)]
    first, last = best_stretch(scores)
    blocks, words = [], []
    for t in tokens[first:last]:
        if t[0] == "text":
            words.append(t[1])
        elif t[1] == "br":
            words.append(" ")
        elif t[1] not in INLINE and words:
            blocks.append(words)
            words = []
    if words:
        blocks.append(words)
    lines = (" ".join(_html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(x for x in lines if x)


def html_extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each page: id, url, text, n_chars."""
    weights = learn_weights(labelled_pages() if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_column, url_column, "text", "n_chars"])

    rows = pages.select(id_column, url_column, html_column)
    return rows.mapInArrow(run, rows.select(id_column, url_column).schema.add("text", "string").add("n_chars", "long"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
