"""News stories and idea cards out of HTML, in Arrow batches on the standard library's parser."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORY = "title string, published string, breadcrumbs string, body array<struct<type:string,content:string,src:string,alt:string>>, tags array<string>, related array<string>"


class _Story(HTMLParser):
    """Title, time, breadcrumbs, body (texts and images in order), tags and related symbols.

    A text element collects all its text, that of links and other inline elements too. One that
    holds another is told in the pieces around it; a link is a piece of its own where no text
    element is open, and in breadcrumbs, tags and symbols.
    """

    # Elements that hold text, and parts told by class names.
    TEXT = ("p", "h1", "h2", "h3", "li", "blockquote")
    EMPTY = ("meta", "link", "input", "hr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = {"title": None, "published": None, "crumbs": [], "body": [], "tags": [], "related": []}
        self.stack: list[tuple[str, str]] = []
        #: open pieces: place in the stack, element, kind, texts
        self.open: list[tuple[int, str, str, list[str]]] = []

    def _inside(self, *names: str) -> bool:
        return any(tag in names or any(n in cls for n in names) for tag, cls in self.stack)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "img":
            if self._inside("article"):
                self._flush()
                self.found["body"].append({"type": "image", "content": None, "src": a.get("src"), "alt": a.get("alt")})
            return
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in self.EMPTY:
            return
        if tag == "time":
            self.found["published"] = self.found["published"] or a.get("datetime")
        if tag in self.TEXT and self.open and self.open[-1][1] == "p":
            self._leave(self.open[-1][0])
        kind = "crumb" if self._inside("breadcrumb") else "related" if self._inside("symbols") else "tag" if self._inside("tags", "rowTags") else "title" if tag == "h1" else "text"
        if tag in self.TEXT or tag == "a" and (kind != "text" or not self.open):
            self._flush()
            self.open.append((len(self.stack), tag, "skip" if tag == "a" and kind == "text" and self._inside("nav") else kind, []))
        self.stack.append((tag, a.get("class", "")))

    def _flush(self):
        """Tell the text that the innermost open piece has collected."""
        if not self.open:
            return
        _, _, kind, texts = self.open[-1]
        words = " ".join("".join(texts).split())
        texts.clear()
        if not words:
            return
        if kind == "title":
            self.found["title"] = self.found["title"] or words
        elif kind in ("crumb", "tag", "related"):
            self.found[{"crumb": "crumbs", "tag": "tags", "related": "related"}[kind]].append(words)
        elif kind == "text" and self._inside("article"):
            self.found["body"].append({"type": "text", "content": words, "src": None, "alt": None})

    def _leave(self, place: int):
        """Close the elements from a place in the stack on."""
        while self.open and self.open[-1][0] >= place:
            self._flush()
            self.open.pop()
        del self.stack[place:]

    def handle_endtag(self, tag):
        place = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if place is not None:
            self._leave(place)

    def handle_data(self, data):
        if self.open and not self._inside("script", "style"):
            self.open[-1][3].append(data)


def _closed(html: str) -> str:
    """html whose ampersands are text wherever no reference that ends with a semicolon follows."""
    known = lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:]
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9a-zA-Z]+;)?", known, html)


def story(html: str | None, bare: bool = True) -> dict:
    """bare: references without their semicolon count where HTML lets them, as &amp at the end of a title that was cut."""
    parser = _Story()
    parser.feed((html or "") if bare else _closed(html or ""))
    parser.close()
    parser._leave(0)
    f = parser.found
    return {"title": f["title"], "published": f["published"], "breadcrumbs": " > ".join(f["crumbs"]) or None, "body": f["body"], "tags": f["tags"], "related": f["related"]}


def stories(pages: DataFrame, html: str = "html", bare: bool = True) -> DataFrame:
    """pages with a struct column story; bare as in story()."""

    @F.pandas_udf(STORY)
    def parse(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([story(h, bare) for h in column], columns=["title", "published", "breadcrumbs", "body", "tags", "related"])

    return pages.withColumn("story", parse(html))


CARD = "title string, paragraph string, preview_image string, author string, comments_count int, boosts_count int, published string, is_updated boolean, strategy string"


class _Card(HTMLParser):
    """An idea card: its parts are told by the beginning of their class names."""

    # Beginnings of class names.
    TEXTS = {"title-": "title", "paragraph-": "paragraph", "card-author-": "author", "ellipsisContainer": "comments", "publication-date-": "shown"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.open: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = a.get("class", "").split()
        part = next((p for n in names for start, p in self.TEXTS.items() if n.startswith(start)), None)
        if part and part not in self.found:
            self.found[part] = ""
            self.open.append((tag, part))
        if tag == "img" and "image" not in self.found:
            self.found["image"] = a.get("src", "")
        if tag == "time" and part == "shown":
            self.found["published"] = a.get("datetime", "")
        if any(n.startswith("boostButton-") for n in names):
            self.found["boosts"] = a.get("aria-label", "")
        if any(n.startswith("idea-strategy-icon-") for n in names):
            self.found["strategy"] = a.get("title", "")

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            self.open.pop()

    def handle_data(self, data):
        for _, part in self.open:
            self.found[part] += data


def card(html: str | None) -> dict:
    """The fields of a card; missing ones are null, missing counts 0."""
    parser = _Card()
    parser.feed(html or "")
    f = {k: " ".join(v.split()) for k, v in parser.found.items()}
    count = lambda text: int(m[0]) if (m := re.match(r"\d+", text)) else 0
    author = f.get("author")
    return {
        "title": f.get("title"),
        "paragraph": f.get("paragraph"),
        "preview_image": f.get("image"),
        "author": author.removeprefix("by").strip() if author else None,
        "comments_count": count(f.get("comments", "")),
        "boosts_count": count(f.get("boosts", "")),
        "published": f.get("published"),
        "is_updated": bool(f.get("shown")),
        "strategy": f.get("strategy"),
    }


def cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a struct column card."""

    @F.pandas_udf(CARD)
    def parse(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([card(h) for h in column], columns=[x.split()[0] for x in CARD.split(", ")])

    return pages.withColumn("card", parse(html))
