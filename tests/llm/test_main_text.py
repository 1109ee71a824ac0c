"""Main text of pages: structure, references, boilerplate, odd markup."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from skylattice.llm import main_text
from skylattice.llm.main_text import extract, extracted
from skylattice.runtime import table

BODY = """<article><h1>A  title &amp; more</h1><p>First paragraph, with a <b>bold</b> word&nbsp;here; it is long enough to count.</p>
<p>Second<br>paragraph: caf&eacute; &#x263A; and &lt;tags&gt;, all of it kept in its place.</p><ul><li>one item, short</li><li>another item</li></ul></article>"""
WANT = "A title & more\nFirst paragraph, with a bold word here; it is long enough to count.\nSecond paragraph: café ☺ and <tags>, all of it kept in its place.\none item, short\nanother item"


def page(body):
    return f"""<!DOCTYPE html><html><head><title>Site</title><style>p {{ color: red }}</style><script>var x = "<p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies.</div>{body}
<aside class="sidebar"><p>Related, unrelated.</p></aside><form><label>Mail</label><input></form>
<div id="comments"><p>A reader says: this is, well, a long comment, with many, many marks. Really.</p></div><footer>Imprint</footer></body></html>"""


def test_boilerplate_goes():
    assert extract(page(BODY)) == WANT
    assert extract(page(f"<div class='wrap'><main>{BODY}</main></div>")) == WANT
    assert extract(page(f"<div class='content'><div>{BODY.replace('article', 'section')}</div></div>")) == WANT


def test_odd_markup():
    assert extract(None) == extract("") == extract("<html></html>") == ""
    assert extract("plain text & no tags") == "plain text & no tags"
    assert extract("<p>a < b and c > d, so it is.<p>Next one, unclosed.") == "a < b and c > d, so it is.\nNext one, unclosed."
    assert extract("<article><p>kept, it is.<!-- gone --> And this.</p></article>") == "kept, it is. And this."
    assert "x" * 50_000 in extract(f"<article><p>{'x' * 50_000}, end.</p></article>")


def test_inline_boilerplate_takes_its_own_text_only():
    body = """<article><p><a class="share">Send on</a> A long paragraph, which is the article, and stays whole.</p>
<p><span class="notice">Note</span> Another long paragraph, of the article as well, and all of it counts.</p>
<p>One more, with an <a class="ad">offer</a> in its middle, and it goes on and on.</p><p><span class="share">Send on</span></p></article>"""
    want = "A long paragraph, which is the article, and stays whole.\nAnother long paragraph, of the article as well, and all of it counts.\nOne more, with an in its middle, and it goes on and on."
    assert extract(page(body)) == want


def test_scores_select_and_names_only_weigh():
    loose = BODY.replace("article", "div")
    extra = "<div class='x1'><ul><li><a href='/a'>Some other page</a></li><li><a href='/b'>And one more</a></li></ul></div>{}<div class='x2'><a href='/c'>Buy a car now</a></div><div class='x3'>Ring us</div>"
    assert extract(page(extra.format(loose))) == WANT
    for wrapper in ("<div class='layout has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div class='search page'><div id='login'>{}</div></div>", "<form>{}</form>"):
        for body in (BODY, f"<main>{BODY}</main>", loose):
            assert extract(page(wrapper.format(body))) == WANT
            assert extract(f"<html><body>{wrapper.format(page(body))}</body></html>") == WANT
    parts = "".join(f"<div class='widget text'><p>Paragraph {i} of the text, with some words, and some more of them.</p></div>" for i in range(9))
    assert extract(page(parts)).count("Paragraph") == 9
    comments = "<div class='comment'><p>A reader says this, and that, and more.</p></div>" * 100
    assert extract(page(BODY + comments)) == WANT


def test_ratios_decide_where_no_name_does():
    """Nothing here has a telling tag or class: only text and marks per path tell links and captions from the text."""
    links = "<div>" + "".join(f"<span><a href='/{i}'>Another page {i}</a></span><br>" for i in range(30)) + "</div>"
    text = "".join(f"<p>Sentence {i}, which says something, goes on for a while, and ends.</p>" for i in range(6))
    want = "\n".join(f"Sentence {i}, which says something, goes on for a while, and ends." for i in range(6))
    assert extract(f"<body>{links}<div>{text}</div>{links}<div>Map</div></body>") == want


def test_two_articles():
    one, two = (f"<article><p>{w} article, with its own words, and quite some of them, as it is.</p></article>" for w in ("First", "Second"))
    assert extract(page(one + two)).count("article, with its own words") == 2


def test_reader_comments_are_no_article():
    """However long they are, where other text scores high as well."""
    one = "<p>A short article, which is all there is, in one paragraph.</p>"
    said = "".join(f"<p>Reader {i} says this, and that, and quite some more of it.</p>" for i in range(8))
    for mark in ("class='comments'", "id='discussion'", "class='comment-list replies'", "id=responses"):
        assert extract(f"<body><div>{one}</div><div {mark}>{said}</div></body>") == "A short article, which is all there is, in one paragraph."
    assert extract(f"<body><div class='comments'><div>{one}</div></div></body>") == "A short article, which is all there is, in one paragraph."


class Plain(HTMLParser):
    """Paths and texts of a page of closed div, p, span and a elements, by the standard parser."""

    def __init__(self, page):
        super().__init__()
        self.open, self.number, self.found = [], 0, []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.number += 1
        self.open.append((tag, "p" if tag == "p" else f"{tag}.{self.number}"))
        if tag in ("div", "p"):
            self.found.append([self.path(), "", ""])

    def handle_endtag(self, tag):
        self.open.pop()
        if tag in ("div", "p"):
            self.found.append([self.path(), "", ""])

    def handle_data(self, data):
        if not self.found:
            self.found.append([self.path(), "", ""])
        self.found[-1][1] += data
        if all(tag != "a" for tag, _ in self.open):
            self.found[-1][2] += data

    def path(self):
        return tuple(label for tag, label in self.open if tag in ("div", "p"))


def random_page(rnd, depth=0):
    made = ""
    for _ in range(rnd.randint(1, 4)):
        words = " ".join(rnd.choice(("word", "other,", "long-winded", "end.", "so!")) for _ in range(rnd.randint(1, 12)))
        made += rnd.choice((f"<p>{words}</p>", f"<p>{words} <a>link, {words}</a></p>", f"<div><span>{words}</span></div>", f"<div>{random_page(rnd, depth + 1)}</div>" if depth < 4 else words))
    return made


def test_ratios_by_brute_force():
    """Letters and marks per path, smoothed by loops, fused: over random pages."""
    rnd = random.Random(5)
    for _ in range(60):
        html = random_page(rnd)
        plain = [(path, " ".join(a.split()), " ".join(b.split())) for path, a, b in Plain(html).found if a.strip()]
        order = list(dict.fromkeys(path for path, _, _ in plain))
        series = []
        for value in (len, lambda t: sum(t.count(c) for c in main_text.MARKS)):
            per = [[value(b) for path, _, b in plain if path == q] for q in order]
            series.append([math.log1p(sum(v) / len(v)) for v in per])
        series[1] = [x + 0.1 for x in series[1]]
        bell = [math.exp(-0.5 * d * d) for d in range(-2, 3)]
        smooth = [[sum(w * x[min(max(i + d, 0), len(x) - 1)] for w, d in zip(bell, range(-2, 3))) / sum(bell) for i in range(len(x))] for x in series]
        letters = [any(b for path, _, b in plain if path == q) for q in order]
        want = [math.sqrt(a * b) if there else 0.0 for a, b, there in zip(*smooth, letters)]

        lines = main_text.lines_of(main_text.blocks(html)[0])
        assert [x.text for x in lines] == [a for _, a, _ in plain]
        paths = {q: i for i, q in enumerate(dict.fromkeys(id(x.path) for x in lines))}
        assert main_text.scores(lines, paths)[0] == pytest.approx(want, abs=1e-9)


def plain_counts(lines, high, marks):
    """listed_around() by sets of the elements around each line, looked at anew for each element."""
    def chain(m):
        return frozenset() if m is None else chain(m.around) | {m}

    rows = [(chain(x.mark), len(x.plain)) for x, h in zip(lines, high) if h]
    free = set()
    for part in ([{m} for m in marks], [{m for m in marks if m.word == w} for w in sorted({m.word for m in marks})]):
        mass = {i: sum(k for names, k in rows if names & (g - free)) for i, g in enumerate(part)}
        for i in sorted((i for i in mass if mass[i]), key=lambda i: -mass[i]):
            loose = sum(k for names, k in rows if names <= free)
            if mass[i] < main_text.HOLDS * (mass[i] + loose):
                break
            if not (loose and next(iter(part[i])).word in main_text.COMMENTS):
                free |= part[i]
    return {m: len(chain(m) - free) for m in [None, *marks]}


def test_cleared_elements_by_brute_force():
    rnd = random.Random(7)
    for _ in range(300):
        marks = []
        for i in range(rnd.randint(0, 7)):
            around = rnd.choice([None, *marks])
            marks.append(main_text.Mark(around, rnd.choice(("share", "promo", "sidebar")), around.depth + 1 if around else 1))
        lines = [main_text.Line(main_text.Path(), "", "x" * (3 ** i), rnd.choice([None, *marks])) for i in range(rnd.randint(1, 8))]
        high = [rnd.random() < 0.8 for _ in lines]
        assert main_text.listed_around(lines, high, marks) == plain_counts(lines, high, marks)


def test_deep_listed_pages_take_linear_time():
    n = 20_000
    for deep in ('<div class="ad">' * n + "some text, here.", '<span class="ad">' * n + "some text, here.", '<span class="ad">' * n + "<p>some text, here." * n, '<div class="ad">some text, here.' * n):
        began = time.perf_counter()
        assert extract(f"<body>{deep}")
        assert time.perf_counter() - began < 10


def test_deep_and_long_pages_take_linear_time():
    for deep in ("<div>" * 20_000 + "some text, here." + "</div>" * 20_000, "<div>word<p>" * 20_000, "<b>" * 20_000 + "some text, here." + "</i>" * 20_000):
        began = time.perf_counter()
        assert extract(f"<body>{deep}")
        assert time.perf_counter() - began < 20


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", page(BODY), 3), (1, "u", page(BODY), 3), (None, None, None, None)], "page_id long, url string, html string, text int")
    made = extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in made) == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT))]
    assert extracted(pages.limit(0)).count() == 0
    whole = table(spark, "/root/testdata/sf0.001", "pages")
    got = extracted(whole).collect()
    assert len(got) == whole.count() and sum(r["n_chars"] > 0 for r in got) > 0.9 * len(got)
