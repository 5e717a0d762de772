"""Main-text extraction from web pages by consensus of each host's pages.

1. Every page's containers are scored: text in their blocks less link text, weighted down by depth, with hints from
   tags and class names; boilerplate subtrees count nothing.
2. Pages vote for the generalised tag-class path of their containers (digits become #); votes are summed per host and
   path in Spark, combined before the shuffle, and each host's best path wins.
3. Each page is extracted again at its host's winning path; a page without it falls back on its own best container.

Blocks of the container are kept whole and in order, except boilerplate subtrees (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts). Character references are decoded, white space in a block becomes one space.

A page is read in time that grows with its length, whatever its markup: where an open quote leaves a tag without end, this
and all later tags of the page end at the next ``>``. Of an article's own header only the headings are text.

Defined results: null or empty html gives an empty text; a null or odd url belongs to the host "" and is returned as it
is; null and repeated page_ids keep their rows; an empty table gives no rows; other columns are ignored; very long and deeply nested pages are read whole; equal votes
go to the longer, then the greater path, and equal scores to the first container of a page.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Element kinds of the language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("article body div main section td".split())
# What marks boilerplate and what hints at an article.
DROP_TAGS = set("aside button canvas dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
DROP_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog discussion disqus donate footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion reactions related recommended replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
GOOD_WORDS = set("article blog body content entry main post story text".split())
#: Share of the page's best score that a container needs to have a vote.
VOTE_SHARE = 0.5


HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Element:
    #: The nearest block above, and the number of this element's path.
    parent: int
    tag: str
    step: str
    path: int
    dropped: bool
    hint: float


@dataclass
class Parsed:
    elements: list[Element] = field(default_factory=list)
    #: (element, text, share of it that is link text)
    blocks: list[tuple[int, str, float]] = field(default_factory=list)
    #: (number of a path, further step) to the number of the longer path
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def path_of(self, e: int) -> str:
        """The steps from the outermost block to an element, written out."""
        steps = []
        while e > 0:
            steps.append(self.elements[e].step)
            e = self.elements[e].parent
        return "".join(f">{x}" for x in reversed(steps))

    def number_of(self, path: str) -> int | None:
        """The number of a path, if the page has it."""
        at: int | None = 0
        for step in path.split(">")[1:]:
            at = self.paths.get((at, step)) if at is not None else None
        return at


_kinds: dict[tuple[str, str], tuple[str, bool, float]] = {}


work.CACHES["tags"] = _kinds.clear


def _kind(tag: str, raw: str) -> tuple[str, bool, float]:
    """(step of the path, boilerplate, hint) of a tag with its attributes; kept, as sites repeat them."""
    if (found := _kinds.get((tag, raw))) is not None:
        return found
    attrs: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        attrs.setdefault(name.lower(), references.unescape(a or b or c))
    classes = attrs.get("class", "").split()
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join([*classes, attrs.get("id", "")])).lower()))
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    dropped = tag in DROP_TAGS or hidden or attrs.get("role", "").lower() in DROP_ROLES
    if tag not in HEADINGS and tag not in ("html", "body", "main", "article"):
        dropped = dropped or bool(words & DROP_WORDS)
    elif tag == "article":
        dropped = dropped or bool(words & {"ad", "ads", "advert", "comment", "comments", "promo", "related", "reply", "sponsored"})
    hint = {"article": 2.0, "main": 1.6, "section": 1.1, "body": 0.6}.get(tag, 1.0) * (1.5 if words & GOOD_WORDS else 1.0)
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower().replace(">", "")) for c in classes})])
    if len(_kinds) > 50_000:
        _kinds.clear()
    out = (step, dropped, hint)
    if len(raw) < 500:
        _kinds[(tag, raw)] = out
    return out


class _Tags:
    """Finds where tags end; a quote opens a value only after an equals sign."""

    def __init__(self, html: str):
        self.html, self.quotes = html, True

    def end(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at a place; -1 if there is none."""
        i = at
        while self.quotes and (m := STOP.search(self.html, i)):
            if m[0] == ">":
                return m.start()
            i, before = m.end(), m.start() - 1
            while before >= at and self.html[before].isspace():
                before -= 1
            if before >= at and self.html[before] == "=":
                i = self.html.find(m[0], i) + 1
                if not i:
                    break
        self.quotes = False
        return self.html.find(">", at)


def parse(html: str) -> Parsed:
    """Elements and text blocks of a page; missing end tags are supplied the usual way."""
    page = Parsed([Element(-1, "", "", 0, False, 0.0)])
    elements, parts, tags = page.elements, [], _Tags(html)
    stack, blocks = [0], [0]
    opened: Counter[str] = Counter()
    chars, linked = 0, 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal parts, linked, chars
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                page.blocks.append((blocks[-1], text, linked / max(1, chars)))
            parts = []
        linked = chars = 0

    def close(to: int) -> None:
        for e in reversed(stack[to:]):
            opened[elements[e].tag] -= 1
            if blocks[-1] == e:
                blocks.pop()
        del stack[to:]

    def above(kinds) -> int:
        """Place on the stack of the last open element of some kinds, 0 if there is none."""
        if not any(opened[k] for k in kinds):
            return 0
        return next(i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].tag in kinds)

    while at < end:
        m = START.search(html, at)
        upto = m.start() if m else end
        if upto > at and not elements[stack[-1]].dropped:
            parts.append(html[at:upto])
            chars += upto - at
            linked += upto - at if opened["a"] else 0
        if not m:
            break
        if not m[2]:
            at = html.find("-->", m.start() + 2) + 3 if m[3] else html.find(">", m.end()) + 1
            at = at if at > m.start() + 2 else end
            continue
        stop = tags.end(m.end())
        if stop < 0:
            break
        at, raw, tag = stop + 1, html[m.end() : stop], m[2].lower()
        if m[1]:
            if k := above({tag}):
                if tag in BLOCK or elements[stack[k]].dropped:
                    flush()
                close(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
            if tag != "html" and elements[blocks[-1]].tag == "p":
                close(above({"p"}))
            if tag in CLOSES and above(CLOSES[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    other = elements[stack[i]].tag
                    if other in CLOSES[tag]:
                        close(i)
                        if tag != "tr" or other == "tr":
                            break
                    elif other in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
        step, dropped, hint = _kind(tag, raw)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID or raw.endswith("/") and not block:
            continue
        top = elements[stack[-1]]
        inside = dropped or top.dropped
        if tag == "header":
            inside = True
        if tag in HEADINGS and top.dropped and top.tag == "header" and not dropped:
            # an article's own header holds its heading, which is text, and bylines and buttons, which are not
            inside = not (opened["article"] or opened["main"]) or any(elements[e].dropped and elements[e].tag != "header" for e in stack)
        if inside != top.dropped:
            flush()
        parent = blocks[-1]
        path = page.paths.setdefault((elements[parent].path, step), len(page.paths) + 1) if block else elements[parent].path
        elements.append(Element(parent, tag, step, path, inside, hint))
        stack.append(len(elements) - 1)
        opened[tag] += 1
        if block:
            blocks.append(len(elements) - 1)
    flush()
    return page


def scores(page: Parsed) -> dict[int, float]:
    """Score of each container: the text of its blocks without links, halved with each level of depth."""
    out: dict[int, float] = {}
    for owner, text, linked in page.blocks:
        weight, e = len(text) * (1 - linked), owner
        while e > 0 and weight >= 1:
            element = page.elements[e]
            if element.tag in CONTAINERS and not element.dropped:
                out[e] = out.get(e, 0.0) + weight * element.hint
            weight /= 2
            e = element.parent
    return out


def votes(html: str) -> list[tuple[str, float]]:
    """(path, share) of the page's containers that come near its best; a path counts once, by its best container."""
    page = parse(html)
    found = scores(page)
    best = max(found.values(), default=0.0)
    out: dict[int, tuple[float, int]] = {}
    for e, score in found.items():
        if score >= VOTE_SHARE * best:
            number = page.elements[e].path
            out[number] = max(out.get(number, (0.0, e)), (score / best, e))
    return sorted((page.path_of(e), share) for share, e in out.values())


def extract(html: str, path: str | None) -> tuple[str, str]:
    """(text, path used) of a page, at the given path or else at its own best container."""
    page = parse(html)
    number = page.number_of(path) if path else None
    roots = {i for i, e in enumerate(page.elements) if number and e.path == number and e.tag in CONTAINERS and not e.dropped}
    if not roots:
        found = scores(page)
        if not found:
            return "\n".join(t for _, t, _ in page.blocks), ""
        roots = {max(found, key=lambda e: (found[e], -e))}
    inside = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        inside[i] = i in roots or e.parent >= 0 and inside[e.parent]
    return "\n".join(t for e, t, _ in page.blocks if inside[e]), page.path_of(min(roots))


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _vote(batches):
    import pandas as pd

    for batch in batches:
        rows = [(host, path, share) for host, html in zip(batch["host"], batch["html"], strict=True) for path, share in votes(html)]
        yield pd.DataFrame(rows, columns=["host", "path", "share"])


def _extract(batches):
    for batch in batches:
        found = [extract(html, path) for html, path in zip(batch["html"], batch["path"], strict=True)]
        yield batch[["k", "m", "url"]].assign(text=[t for t, _ in found], n_chars=[len(t) for t, _ in found], path=[p for _, p in found])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning container path. Ties go to the longer, then the greater path."""
    html = F.coalesce("html", F.lit(""))
    ballots = pages.select(_host().alias("host"), html.alias("html")).mapInPandas(work.tidy(_vote, "tags"), "host string, path string, share double")
    tally = ballots.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"))
    return tally.groupBy("host").agg(F.max(F.struct("votes", F.length("path").alias("n"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, for every page (page_id, url, html)."""
    folder = work.work_folder(spark, "html")
    winners = work.written(host_paths(pages), f"{folder}/winners")
    key = F.col("page_id").cast("long")
    rows = pages.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().alias("m"), "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    # The winners have one row a host; Spark knows the written table's size, so it broadcasts a small one and sorts and
    # splits skewed hosts otherwise.
    out = rows.join(winners, "host", "left").select("k", "m", "url", "html", "path").mapInPandas(work.tidy(_extract, "tags"), "k long, m boolean, url string, text string, n_chars long, path string")
    return out.select(F.when(~F.col("m"), F.col("k")).alias("page_id"), "url", "text", "n_chars", "path")
