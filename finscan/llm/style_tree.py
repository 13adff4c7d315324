"""Main-text extraction with a site style tree.

Pages of one host are merged: a node of the tree is a path of elements (tag and class names) below
the body. For every node the tree counts the pages that have it (m), how often each presentation
style (sequence of child elements) and each content (text of a block below it) occurs. Entropy to
the base m gives the importance of a node:

    presentation  -sum p log_m p over its styles: 0 if all pages look alike there
    content       1 - sum (n_f / N) log_m n_f over its texts: 0 if all pages say the same there
    node          (1 - g^l) presentation + g^l content, l styles, g = 0.9; 1 if one page has it

A branch that ``least_pages`` different pages of its host have is judged by its importance: below
``threshold`` it is cut. Names are priors: a branch whose class or id is named like something else
than text by a word that articles use as well (notice, related, widget, ...) is cut unless both its
presentation and its content reach ``named_threshold``, that is unless its looks and its words vary
as an article's do; where fewer pages have it there is nothing to compare, and its name decides. Elements
that say themselves that they are no text (nav, footer, form, script, adverts, reader comments, ...)
go on every host and have no place in the tree: the words of menus and adverts may differ on every page, which no entropy can tell
from prose. Where a page marks its article or main part, only that part counts, and paragraphs and
headings inside it, and what encloses them there, are never cut for being common. Equal pages of a
host count once: copies say nothing about what is common to its pages.

Each page is parsed in time linear in its length, whatever its markup: elements nested deeper than
``DEPTH`` are taken as siblings at that depth, and a tag that never ends is text.

What the tree needs of a page (hashes of nodes, styles and texts) is written once; equal pages are
folded by (host, page), and counts are grouped by (host, node, style or text), so that a host with a
third of all pages is dealt over all tasks. A page then meets the judgements on its own nodes only,
joined by (host, page), however many its host has.

Defined results: a null or empty page, or one without text, has the text ''; a null or odd url
belongs to the host ''; repeated rows each get their text; other columns are dropped.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscan.llm.shared import settled, table

THRESHOLD = 0.2
NAMED_THRESHOLD = 0.5
LEAST_PAGES = 3
DECAY = 0.9
DEPTH = 256

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
SPACES = re.compile(r"\s*+")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul video".split())
CLOSES_P = BLOCK - frozenset("body head html caption legend option optgroup td th tr tbody thead tfoot title".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

NOISE_TAGS = frozenset("nav footer aside form script style noscript iframe template svg math object applet embed audio video canvas button select textarea input menu dialog head title map datalist frameset noframes noembed search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav"
    " footer masthead topbar cookie cookies consent gdpr modal popup overlay newsletter subscribe subscription signup login comment comments commentlist disqus toolbar pagination pager paywall".split()
)
WEAK_WORDS = frozenset("notice notices notification alert share sharing social related recommended recommendations reply replies respond discussion widget skip hidden".split())
HEADER_WORDS = frozenset("header siteheader pageheader".split())
MAIN_TAGS = frozenset(("article", "main"))
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
PROSE = PARAGRAPHS | frozenset("b strong i em u s a span small sub sup mark code q cite abbr time font tt kbd samp var ins del".split())
ROOTS = frozenset(("html", "body"))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _hash(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


LONG_REFERENCE = re.compile(r"&#(?:0*[0-9]{8,}|[xX]0*[0-9a-fA-F]{8,});?")


def _decoded(raw: str) -> str:
    """raw with its character references decoded; numbers beyond any character stand for the replacement character."""
    return htmllib.unescape(LONG_REFERENCE.sub("\ufffd", raw) if "&#" in raw else raw) if "&" in raw else raw


class _Node:
    """An element: path is the hash of the tags and classes from the root, zone the nearest element that may be cut by name."""

    __slots__ = ("tag", "path", "noise", "weak", "main", "children", "parent", "zone")

    def __init__(self, tag: str, path: int, noise: bool, weak: bool, main: bool, parent: _Node | None):
        self.tag, self.path, self.noise, self.weak, self.main, self.parent = tag, path, noise, weak, main, parent
        self.zone = self if parent is None or weak or noise and not parent.noise else parent.zone
        self.children: list[str] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _decoded(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw else {}


TELLING = re.compile(r"class|id|role|hidden", re.I)


def _kind(tag: str, raw: str, path: int, noise: bool, main: bool) -> tuple[int, bool, bool, bool]:
    """Path, noise, weak and main of an element, from its attributes and those of its parent."""
    attributes = _attributes(raw)
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = {w.lower() for w in WORDS.findall(named)} | set(named.lower().split())
    role = attributes.get("role", "").lower()
    noise = noise or tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
    weak = False
    if tag not in ROOTS:
        noise = noise or bool(words & NOISE_WORDS)
        noise = noise or not main and (tag == "header" or bool(words & HEADER_WORDS))
        weak = not noise and bool(words & WEAK_WORDS)
    main = main or not noise and (tag in MAIN_TAGS or role == "main")
    return _hash(f"{path}/{'.'.join([tag, *sorted(attributes.get('class', '').lower().split())])}"), noise, weak, main


_kind_once = lru_cache(maxsize=65536)(_kind)


def _opened(tag: str, raw: str, parent: _Node) -> _Node:
    raw = raw if raw and TELLING.search(raw) else ""
    kind = (_kind_once if len(raw) <= 512 else _kind)(tag, raw, parent.path, parent.noise, parent.main)
    return _Node(tag, *kind, parent)


class _Ends:
    """Where tags end, for pages with a tag whose quotes are not closed; no stretch of the page is scanned twice."""

    def __init__(self, html: str):
        self.html, self.failed = html, set()
        self.stops = [m.start() for m in re.finditer("[>=]", html)]
        self.closes = [at for at in self.stops if html[at] == ">"]
        self.marks = {q: [m.start() for m in re.finditer(q, html)] for q in "\"'"}

    def end(self, start: int) -> int:
        """Place of the > that ends the tag, -1 if there is none; if it is inside a quote that never ends, the first one."""
        at, seen = start, []
        while at not in self.failed:
            seen.append(at)
            i = bisect_left(self.stops, at)
            if i == len(self.stops):
                break
            at = self.stops[i]
            if self.html[at] == ">":
                return at
            at = SPACES.match(self.html, at + 1).end()
            marks = self.marks.get(self.html[at : at + 1])
            if marks is not None:
                j = bisect_right(marks, at)
                at = marks[j] + 1 if j < len(marks) else at + 1
        self.failed.update(seen)
        i = bisect_left(self.closes, start)
        return self.closes[i] if i < len(self.closes) else -1


RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Page:
    """The text of a page in pieces, each with the node around it."""

    def __init__(self, html: str):
        #: number of the block, raw text, innermost node; only for text outside scripts and the head
        self.pieces: list[tuple[int, str, _Node]] = []
        self.nodes: list[_Node] = []
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        root = _Node("", 0, False, False, False, None)
        stack, opened = [root], {}
        text: list[str] = []
        held, block = root, 0
        ends: _Ends | None = None

        def piece() -> None:
            if text:
                raw = "".join(text)
                if not raw.isspace():
                    self.pieces.append((block, raw, held))
                elif self.pieces and self.pieces[-1][0] == block:
                    n, before, node = self.pieces[-1]
                    self.pieces[-1] = (n, before + " ", node)
                text.clear()

        def add(raw: str) -> None:
            nonlocal held
            if raw:
                if not text or stack[-1].zone is not held.zone:
                    piece()
                    held = stack[-1]
                text.append(_decoded(raw))

        def flush() -> None:
            nonlocal block
            piece()
            block += 1

        def pop(to: int) -> None:
            for x in stack[to:]:
                opened[x.tag] -= 1
            del stack[to:]

        def close(tags: set[str], until: set[str], *, all_: bool) -> None:
            j = len(stack) - 1
            while j > 0 and stack[j].tag not in until:
                if stack[j].tag in tags:
                    pop(j)
                    if not all_:
                        return
                j -= 1

        at, n = 0, len(html)
        while at < n:
            start = html.find("<", at)
            if start < 0:
                add(html[at:])
                break
            add(html[at:start])
            found = TAG.match(html, start) if ends is None else None
            if found:
                closing, tag, raw = found[1], found[2].lower(), found[3]
                at = found.end()
            else:
                follows = html[start + 1 : start + 2]
                if follows and follows in "!?":
                    if html.startswith("<!--", start):
                        end = html.find("-->", start + 4)
                        at = n if end < 0 else end + 3
                    elif html.startswith("<![CDATA[", start):
                        end = html.find("]]>", start + 9)
                        add(html[start + 9 : n if end < 0 else end])
                        at = n if end < 0 else end + 3
                    else:
                        end = html.find(">", start)
                        if end < 0:
                            add(html[start:])
                            break
                        at = end + 1
                    continue
                name = NAME.match(html, start)
                if name is None:
                    add("<")
                    at = start + 1
                    continue
                ends = ends or _Ends(html)
                end = ends.end(name.end())
                if end < 0:
                    add(html[start:])
                    break
                closing, tag, raw = name[1], name[2].lower(), html[name.end() : min(end, name.end() + 2048)]
                at = end + 1
            if closing:
                i = next((j for j in range(len(stack) - 1, 0, -1) if stack[j].tag == tag), 0) if opened.get(tag) else 0
                if tag in BLOCK:
                    flush()
                elif i and any(x.tag in BLOCK for x in stack[i + 1 :]):
                    continue
                if i:
                    pop(i)
                continue
            if tag in BLOCK:
                flush()
            if tag == "br" or tag == "img":
                add(" ")
            if tag in CLOSES_P and opened.get("p"):
                close({"p"}, {"table", "td", "th", "caption", "button", "object"}, all_=False)
            if tag in SIBLINGS and any(opened.get(x) for x in SIBLINGS[tag]):
                close(SIBLINGS[tag], SCOPE[tag], all_=True)
            if len(stack) > DEPTH:
                pop(DEPTH)
            parent = stack[-1]
            parent.children.append(tag)
            if tag in VOID or tag in ROOTS and opened.get(tag):
                continue
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                end = html.find(">", end.end()) if end else -1
                at = n if end < 0 else end + 1
                continue
            node = _opened(tag, raw, parent)
            self.nodes.append(node)
            if not raw.rstrip().endswith("/") or tag in BLOCK:
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        piece()

    def _holders(self) -> set[_Node]:
        """The nodes that enclose a paragraph or heading with text."""
        out: set[_Node] = set()
        for _, _, node in self.pieces:
            if node.noise:
                continue
            inner, x = None, node
            while x.parent is not None:
                if x.tag in PARAGRAPHS:
                    inner = x
                    break
                x = x.parent
            while inner is not None and inner.parent is not None and inner.parent not in out:
                inner = inner.parent
                out.add(inner)
        return out

    def text(self, low: frozenset[int] | set[int] = frozenset(), varied: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks left after noise, branches of low importance, and named ones that are not varied are cut."""
        gone: set[_Node] = set()
        for x in self.nodes:
            if x.noise or x.parent in gone or x.weak and x.path not in varied:
                gone.add(x)
        has_main = any(x.main and x not in gone for _, _, x in self.pieces)
        if low:
            holders = self._holders() if has_main else set()
            for x in self.nodes:
                if x.parent in gone:
                    gone.add(x)
                elif x.path in low and not (x.tag in ROOTS or x.tag in MAIN_TAGS or has_main and (not x.main or x.tag in PROSE or x in holders)):
                    gone.add(x)
        out: list[str] = []
        last = -1
        for block, raw, node in self.pieces:
            if node in gone or has_main and not node.main:
                continue
            if block == last:
                out[-1] += " " + raw if out[-1][-1:].isspace() or raw[:1].isspace() else raw
            else:
                out.append(raw)
            last = block
        return "\n".join(" ".join(x.split()) for x in out)

    def tree(self) -> tuple[list[int], list[int], list[bool], list[bool], list[int], list[int]]:
        """Nodes, their styles, whether their names are weak and whether the page may cut them; node and text of each piece below each node.

        What is noise on every host has no place in the tree.
        """
        named: set[_Node] = set()
        for x in self.nodes:
            if x.weak or x.parent in named:
                named.add(x)
        has_main = any(x.main and not x.noise and x not in named for _, _, x in self.pieces)
        holders = self._holders() if has_main else set()
        nodes: dict[int, list] = {}
        for x in self.nodes:
            if x.noise or x.tag in ROOTS or x.tag in MAIN_TAGS:
                continue
            mine = nodes.setdefault(x.path, [" ".join(x.children), x.weak, False])
            mine[2] = mine[2] or not has_main or x.weak or x.main and x.tag not in PROSE and x not in holders
        owners, texts = [], []
        for _, raw, x in self.pieces:
            if x.noise:
                continue
            t = _hash(" ".join(raw.split()))
            while x.parent is not None:
                if x.path in nodes:
                    owners.append(x.path)
                    texts.append(t)
                x = x.parent
        return list(nodes), [_hash(v[0]) for v in nodes.values()], [v[1] for v in nodes.values()], [v[2] for v in nodes.values()], owners, texts


TREES = "host string, page binary, nodes array<long>, styles array<long>, weak array<boolean>, open array<boolean>, owners array<long>, texts array<long>"
ROWS = 256


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            found = [Page(h).tree() for h in part.column("html").to_pylist()]
            lists = [pa.array([f[j] for f in found], pa.list_(k)) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("page"), *lists], ["host", "page", "nodes", "styles", "weak", "open", "owners", "texts"])


def _hosted(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """pages with host, html (never null) and page, which tells different pages of a host apart."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.withColumns({"host": host, "html": html, "page": F.unhex(F.md5(html.cast("binary")))})


def site_trees(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each different page of a host: host, page, and what the tree counts of it."""
    rows = _hosted(pages.select(F.col(url_col), F.col(html_col)), url_col, html_col).select("host", "page", "html")
    return settled(rows.mapInArrow(_trees, TREES).dropDuplicates(["host", "page"]), "site-trees")


def node_importance(trees: DataFrame, *, decay: float = DECAY) -> DataFrame:
    """(host, node, weak, pages, styles, presentation, content, importance) of each node of the hosts' style trees."""
    n = F.col("n").cast("double")
    own = trees.select("host", F.inline(F.arrays_zip("nodes", "styles", "weak"))).groupBy("host", F.col("nodes").alias("node"), "styles").agg(F.count("*").alias("n"), F.max("weak").alias("weak"))
    own = own.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(n * F.log(n)).alias("style_sum"), F.max("weak").alias("weak"))
    said = trees.select("host", F.inline(F.arrays_zip("owners", "texts"))).groupBy("host", F.col("owners").alias("node"), "texts").agg(F.count("*").alias("n"))
    said = said.groupBy("host", "node").agg(F.sum("n").alias("said"), F.sum(n * F.log(n)).alias("said_sum"))
    nodes = own.join(said, ["host", "node"], "left")
    m, several, zero = F.log(F.col("pages").cast("double")), F.col("pages") > 1, F.lit(0.0)
    nodes = nodes.withColumn("presentation", F.when(several, F.greatest(zero, 1 - F.col("style_sum") / (F.col("pages") * m))).otherwise(1.0))
    nodes = nodes.withColumn("content", F.when(several, F.coalesce(F.greatest(zero, 1 - F.col("said_sum") / (F.col("said") * m)), zero)).otherwise(1.0))
    g = F.pow(F.lit(decay), F.col("styles"))
    nodes = nodes.withColumn("importance", F.when(several, (1 - g) * F.col("presentation") + g * F.col("content")).otherwise(1.0))
    return nodes.select("host", "node", "weak", "pages", "styles", "presentation", "content", "importance")


def extract(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = THRESHOLD,
    named_threshold: float = NAMED_THRESHOLD,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    trees = site_trees(pages, url_col=url_col, html_col=html_col)
    judged = node_importance(trees).where(F.col("pages") >= least_pages)
    low, varied = F.col("importance") < threshold, F.col("weak") & (F.least("presentation", "content") >= named_threshold)
    judged = settled(judged.where(low | varied).select("host", "node", low.alias("cut")), "judged-nodes")
    mine = trees.select("host", "page", F.inline(F.arrays_zip("nodes", "open"))).where("open").select("host", "page", F.col("nodes").alias("node")).join(judged, ["host", "node"])
    mine = mine.groupBy("host", "page").agg(F.collect_list(F.when(F.col("cut"), F.col("node"))).alias("low"), F.collect_list(F.when(~F.col("cut"), F.col("node"))).alias("varied"))
    mine = settled(mine, "judged-pages")
    rows = _hosted(pages.select(id_col, url_col, html_col), url_col, html_col).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), "host", "page", "html")
    rows = rows.join(mine, ["host", "page"], "left").select("id", "url", "html", "low", "varied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                texts = [Page(h).text(frozenset(x or ()), frozenset(y or ())) for h, x, y in zip(*(b.column(c).to_pylist() for c in ("html", "low", "varied")), strict=True)]
                out = [b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, [id_col, url_col, "text", "n_chars"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"`{id_col}` {types['id']}, `{url_col}` {types['url']}, text string, n_chars long")


def op6_style_tree(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
