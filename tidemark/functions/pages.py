"""Web pages as title, paragraphs and links, by the standard library's tokenizer.

Open elements are kept on a stack, so that an element that is never closed ends with the one around it. Text below a skipped element (scripts, styles, navigation and such) is left out,
however deep. A paragraph ends where a block element starts or ends; line breaks and white space become one space; named and numeric character references are resolved.

Cases: null gives nulls and no paragraphs; an end tag without a start is ignored; an unclosed script or comment takes the rest of the page, as in a browser; paragraphs without text are left out.
"""

from __future__ import annotations

import html
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import pieces

# Elements of HTML by what they mean for text.
SKIPPED = {"script", "style", "nav", "noscript", "template", "svg", "iframe", "object", "canvas"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
    "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", *SKIPPED,
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Page(HTMLParser):
    """`title`, `paragraphs` in order, `links` in order."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.paragraphs: list[str] = []
        self.links: list[str] = []
        self.parts: list[str] = []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.skipped = 0
        self.feed(text)
        self.close()
        self._end_paragraph()

    def _end_paragraph(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text and self.count["title"]:
            self.title = text if self.title is None else self.title
        elif text:
            self.paragraphs.append(text)

    def _pop(self) -> str:
        tag = self.open.pop()
        self.count[tag] -= 1
        self.skipped -= tag in SKIPPED
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self._end_paragraph()
            if self.open and (self.open[-1] in ENDS.get(tag, ()) or self.open[-1] == "p"):
                self._pop()
        if tag == "a" and not self.skipped:
            self.links += [value for name, value in attrs if name == "href" and value]
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] += 1
            self.skipped += tag in SKIPPED

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag] <= 0:
            return
        if tag in BLOCKS:
            self._end_paragraph()
        while self._pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


KIND = pa.struct([("title", pa.string()), ("paragraphs", pa.list_(pa.string())), ("links", pa.list_(pa.string()))])


def page(source: Column) -> Column:
    """Struct of title, paragraphs and links of a page; null for null. Python, in Arrow batches: a tokenizer has no native form."""

    @F.arrow_udf("struct<title:string,paragraphs:array<string>,links:array<string>>")
    def parsed(pages: pa.Array) -> pa.Array:
        done = [pa.array([], KIND)]
        for piece in pieces(pa.record_batch([pages], names=["page"]), 0):
            out = []
            for p in piece.column(0).to_pylist():
                found = None if p is None else Page(p)
                out.append(found and {"title": found.title, "paragraphs": found.paragraphs, "links": found.links})
            done.append(pa.array(out, KIND))
        return pa.concat_arrays(done)

    return parsed(source)


def folded(text: Column) -> Column:
    """Character references resolved, case folded, white space collapsed. Unlike lower case, folding makes a sharp s two letters."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else " ".join(html.unescape(t).casefold().split()) for t in texts.to_pylist()], pa.string())

    return of(text)
