import time
from html.parser import HTMLParser

import pytest

from strandloom.llm import html_lineblock as H
from strandloom.llm.common import table

SECTIONS, LINES = set(H._SECTION.split("|")), set(H._LINE.split("|"))


class Reader(HTMLParser):
    """Lines by a real parser, one tag at a time."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [""], 0

    def _end(self, tag):
        if tag in SECTIONS:
            self.out += [None, ""]
        elif tag in LINES:
            self.out.append("")

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self._end(tag)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self._end(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.out[-1] += data

    def lines(self):
        found = []
        for x in self.out:
            if x is None:
                found += [""] * H.BLOCK
            elif x.strip():
                found.append(" ".join(x.split()))
        return found


def brute(page):
    """The rule read line by line."""
    reader = Reader()
    reader.feed(page)
    reader.close()
    found = reader.lines()
    size = [len(x.replace(" ", "")) for x in found] + [0] * H.BLOCK
    block = [sum(size[k : k + H.BLOCK]) for k in range(len(found))] + [0]
    out, inside = [], False
    for k, x in enumerate(found):
        if block[k] == 0:
            inside = False
        elif block[k] > H.SURGE and (block[k + 1] > 0 or size[k] > H.SURGE):
            inside = True
        if inside and x:
            out.append(x)
    return "\n".join(out)


def test_equals_brute_force(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    assert got == want and sum(map(bool, got.values())) > 0.9 * len(got)


def test_extracts_the_article():
    body = "<p>" + "A long paragraph of the story goes on. " * 5 + "</p><p>Short.</p>"
    page = f"<html><body><nav><ul><li><a href='/a>b'>Home</a></li><li>About</li></ul></nav><div>Ad</div><article><h1>Title &amp; more</h1>{body}</article><footer>&copy; me</footer><script>var x = '<p>{'no ' * 90}</p>'</script></body></html>"
    assert H.extract(page).split("\n") == ["Title & more", ("A long paragraph of the story goes on. " * 5).strip(), "Short."]


def shown(page):
    return [x for x in H.lines(page) if x]


@pytest.mark.parametrize("page,want", [
    ("<p title=it's>it</p><p>don't</p>", ["it", "don't"]), ('<a href="x>y" b=\'>\'>in</a> out', ["in out"]), ("<a b = 'x>' c>in", ["in"]), ('<a "b>in', ["in"]), ("1 < 2 <3 </ <> a", ["1 < 2 <3 a"]), ("a &lt;b&gt;&#10;&nbsp;c", ["a <b> c"]),
    ("a<script>if (x < y) '</p>'</script >b", ["a b"]), ("a<STYLE x='</style>'>p</sTyLe>b<scripts>c", ["a bc"]), ("a<svg/>b<svg><text>no</text></svg>c", ["a b c"]), ("a<!-- > -->b<!doctype x>c<?php d ?>e<!-->f", ["a b c e f"]),
    ("a<textarea>no", ["a"]), ("a<!-- no", ["a"]), ("a<p title='no", ["a"]), ("a<br/>b<BR>c", ["a", "b", "c"]), ("tail <", ["tail <"]), ("tail </", ["tail </"]),
])
def test_broken_markup(page, want):
    assert shown(page) == want


@pytest.mark.parametrize("piece", ["<a '", "<script ", '<a b="', "<!", "<?", "<!-- ", "</", "<", "< ", "<a =", "<a b", "<style>", "</script", "&", "&#", "<p>", "a<b/>", "=\"'", "<svg/><svg>"])
def test_time_is_in_proportion_to_the_page(piece):
    began = time.perf_counter()
    H.extract(piece * (1_000_000 // len(piece)))
    H.extract("<p>" + "words " * 40 + piece * (1_000_000 // len(piece)) + ">" * 9)
    assert time.perf_counter() - began < 20


def test_odd_rows(spark):
    long = "<p>" + "word " * 300_000
    rows = [(1, None), (2, ""), (None, long), (3, "<div " + "<" * 50_000), (4, "plain text only"), (4, "plain text only"), (5, "<!-- " + "open " * 90), (6, "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' AS text")
    got = sorted(((r.page_id, r.text) for r in H.main_text(pages).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (None, ("word " * 300_000).strip()), (3, H.extract(rows[3][1])), (4, ""), (4, ""), (5, ""), (6, "x" * 100)], key=str)
    assert H.main_text(pages.limit(0)).collect() == []
