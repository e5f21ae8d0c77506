"""HTML pages to Markdown with the standard parser, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_SKIP = {"script", "style", "nav", "header", "footer", "form", "noscript", "iframe", "svg"}
_BLOCK = {"p", "div", "section", "article", "table", "tr", "ul", "ol", "blockquote", "br", "hr"}
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_STRINGS = ArrayType(StringType())
PAGE = StructType([StructField("titulo", StringType()), StructField("markdown", StringType()), StructField("notas", _STRINGS), StructField("enlaces", _STRINGS), StructField("siguiente", StringType())])


class _Reader(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.out, self.notes, self.links, self.next = url, [], [], [], None
        self.title, self.hidden, self.stack, self.anchor = [], 0, [], None

    def _is_hidden(self, attrs: dict) -> bool:
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return "display:none" in style or "visibility:hidden" in style or "hidden" in attrs

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        hide = tag in _SKIP or self._is_hidden(a)
        if tag not in _VOID:
            self.stack.append((tag, hide, len(self.notes)))
            if hide:
                self.hidden += 1
                if tag not in _SKIP:
                    self.notes.append("")
        if tag == "a" and a.get("href"):
            self.anchor = [a["href"], ""]
        if self.hidden:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in ("s", "strike", "del"):
            self.out.append("~~")
        elif tag == "br":
            self.out.append("\n")
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag == "a" and self.anchor:
            href, text = self.anchor
            if not re.match(r"(?i)(javascript|mailto):|#", href):
                full = urljoin(self.url or "", href)
                self.links.append(full)
                if text.strip().lower() in ("siguiente", "next", "siguiente »") and self.next is None:
                    self.next = full
            self.anchor = None
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, hide, _ = self.stack.pop()
            if hide:
                self.hidden -= 1
            if t == tag:
                break
        if not self.hidden:
            if tag in ("s", "strike", "del"):
                self.out.append("~~")
            elif re.fullmatch(r"h[1-6]", tag) or tag in _BLOCK:
                self.out.append("\n\n")

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
            return
        if self.anchor:
            self.anchor[1] += data
        if self.hidden:
            if self.notes and not any(t in _SKIP for t, h, _ in self.stack if h):
                self.notes[-1] += data
            return
        self.out.append(re.sub(r"\s+", " ", data))


def is_index(block: str) -> bool:
    """A block of thirty lines or more that are nearly all short and often figures: a side index."""
    lines = [x.strip() for x in block.split("\n") if x.strip()]
    return len(lines) >= 30 and sum(len(x) <= 40 for x in lines) > 0.9 * len(lines) and sum(any(c.isdigit() for c in x) for x in lines) > 0.4 * len(lines)


def page(html: str | None, url: str | None) -> dict:
    """Title, Markdown, hidden notes, absolute links and the next page of an HTML text; empty parts for null."""
    r = _Reader(url or "")
    r.feed(html or "")
    r.close()
    text = unicodedata.normalize("NFC", "".join(r.out))
    text = re.sub(r"<note>(.*?)</note>", r"{{\1}}", text, flags=re.S)
    blocks = [re.sub(r"[ \t]+", " ", b).strip() for b in re.split(r"\n\s*\n", text)]
    md = "\n\n".join("\n".join(x.strip() for x in b.split("\n")) for b in blocks if b and not is_index(b))
    return {"titulo": "".join(r.title).strip(), "markdown": md.replace("~~~~", ""), "notas": [n.strip() for n in r.notes if n.strip()], "enlaces": r.links, "siguiente": r.next}


@F.pandas_udf(PAGE)
def _pages(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page(h, u) for h, u in zip(html, url)], columns=["titulo", "markdown", "notas", "enlaces", "siguiente"])


def to_markdown(html: Column, url: Column) -> Column:
    return _pages(html, url)
