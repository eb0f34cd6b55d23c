"""Main text of web pages by the distribution of line blocks.

Markup is stripped; inline tags vanish, tags of paragraphs end a line, and tags of
sections leave BLOCK blank lines. Each line starts a block of BLOCK lines, whose length
is the sum of their characters without white space. The text surges at a line whose
block is longer than SURGE and that is followed by text, and dives where the block is
empty; lines between surge and dive are kept (Chen, "General web page main text
extraction by line-block distribution", 2010).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import slices, table

BLOCK, SURGE = 3, 86

_SECTION = "address|article|aside|blockquote|body|center|details|dialog|div|dl|fieldset|figure|footer|form|frameset|head|header|hgroup|hr|html|iframe|main|menu|nav|noscript|ol|section|table|tbody|tfoot|thead|title|ul"
_LINE = "br|caption|dd|dt|figcaption|h1|h2|h3|h4|h5|h6|legend|li|option|p|pre|summary|td|th|tr"
_GAPS = dict.fromkeys(_SECTION.split("|"), "\n" * (BLOCK + 1)) | dict.fromkeys(_LINE.split("|"), "\v")
#: Elements whose content isn't text, with the end tag that closes them.
_UNSEEN = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "template", "svg", "textarea")}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: Attributes up to the tag's end. A quote opens a value only right after "=", elsewhere it is a character like any
#: other. Groups give nothing back, so that a place is read a few times at most.
_ATTRIBUTES = re.compile(r"""(?>[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+""")
_SPACE = re.compile(r"\s+")


def _parts(page: str) -> Iterator[str]:
    """Text between the markup, as a reader sees it, and what tags leave in its place.

    The page is read once from left to right. A tag, comment or unseen element that
    isn't closed runs to the end of the page, as it does in a browser.
    """
    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield _text(page[at:])
            return
        after = page[start + 1 : start + 2]
        tag = _NAME.match(page, start + 1)
        if not tag and after not in ("!", "?", "/") or after == "/" and not tag and start + 2 >= len(page):
            # Not markup, but a sign like any other.
            yield _text(page[at : start + 1])
            at = start + 1
            continue
        if at < start:
            yield _text(page[at:start])
        if not tag:
            close = "-->" if page.startswith("<!--", start) else ">"
            # "<!-->" and "<!--->" are whole comments.
            end = page.find(close, start + 2)
            yield " "
        else:
            close, end = ">", _ATTRIBUTES.match(page, tag.end()).end()
            end = end if end < len(page) else -1
        if end < 0:
            return
        at = end + len(close)
        if tag:
            name = tag[1].lower()
            yield _GAPS.get(name, "")
            if name in _UNSEEN and after != "/":
                yield " "
                if name == "svg" and page[end - 1] == "/":
                    continue
                closing = _UNSEEN[name].search(page, at)
                if not closing:
                    return
                at = closing.start()


def _text(part: str) -> str:
    """White space, that of entities too, is a space to a reader."""
    return _SPACE.sub(" ", html.unescape(part))


def lines(page: str) -> list[str]:
    """Text lines of a page without markup, white space collapsed; blank ones only where sections meet."""
    out: list[str] = []
    for part in "".join(_parts(page)).split("\n"):
        out += [" ".join(y) for x in part.split("\v") if (y := x.split())] or [""]
    return out


def kept(sizes: np.ndarray, block: int = BLOCK, surge: int = SURGE) -> np.ndarray:
    """Which lines, of the given lengths, lie between a surge and a dive."""
    n = len(sizes)
    sums = np.cumsum(np.concatenate([[0], sizes, np.zeros(block, np.int64)]))
    blocks = sums[block : block + n] - sums[:n]
    followed = np.append(blocks[1:], 0) > 0
    rises = np.flatnonzero((blocks > surge) & (followed | (sizes > surge)))
    falls = np.flatnonzero(blocks == 0)
    ends = np.append(falls, n)[np.searchsorted(falls, rises)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rises, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def extract(page: str, block: int = BLOCK, surge: int = SURGE) -> str:
    """Kept lines that aren't blank, one to a line; empty if no block is long enough."""
    found = lines(page)
    sizes = np.fromiter((len(x) - x.count(" ") for x in found), np.int64, len(found))
    return "\n".join(found[k] for k in np.flatnonzero(kept(sizes, block, surge) & (sizes > 0)))


def main_text(pages: DataFrame, block: int = BLOCK, surge: int = SURGE) -> DataFrame:
    """(page_id, text) of every row of ``pages``.

    A null page has a null text, and an empty one, or one without a long block, an empty
    text. Pages are read whole and once, however long and broken. Rows are read one by
    one: repeated rows and null ids stay as they are. A block exactly as long as
    ``surge`` doesn't surge. Other columns, whatever their names, are not read. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [None if page is None else extract(page, block, surge) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")


def op9_html_lineblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_lineblock": op9_html_lineblock}
ORACLE_SQL: dict[str, str] = {}
