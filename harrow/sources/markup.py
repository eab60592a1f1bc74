"""What recorded pages say: visible text, links, signs of more results, rows of vendors' own markup.

A page is read once by the standard library's tokenizer into flat elements; Spark deals the pages."""

from __future__ import annotations

import html.parser
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pages

# Classes of text that only assistive technology reads.
UNSEEN = re.compile(r"\b(sr-only|sronly|visually-hidden|visuallyhidden|screen-reader-text|screenreader|a11y-hidden|field-label|hidden-label|assistive-text)\b", re.I)
# What offers more of a list: classes and ids, link texts, address parameters, and texts that lead to all postings.
PAGER = re.compile(r"\b(pagination|pager|paging|load-?more|show-?more)\b", re.I)
MORE = re.compile(r"^\s*(next|next\s+page|load\s+more|show\s+more|view\s+more|more\s+jobs?|see\s+more|›|»|>|>>)\s*$", re.I)
PAGE_PARAMETER = re.compile(r"[?&](?:page|pg|p|start|from|offset|skip|pageno|page_number|pageNumber|currentPage|resultsPage)=\d+", re.I)
VIEW_ALL = re.compile(r"^\s*(view|see|browse|search|explore)\s+(all\s+)?(our\s+|current\s+|new\s+|open\s+|available\s+)*(jobs?|openings?|positions?|opportunities|vacancies|careers)\b", re.I)
# Counts that a page states about its list.
TOTALS = (
    re.compile(r"\b\d[\d,]*\s*[-–]\s*\d[\d,]*\s+of\s+(\d[\d,]*)", re.I),
    re.compile(r"\b(\d[\d,]*)\s+(?:open\s+)?(?:jobs?|positions?|openings?|results?|vacancies)\b", re.I),
    re.compile(r"\bof\s+(\d[\d,]*)\s+(?:jobs?|positions?|openings?|results?)\b", re.I),
)
# Names of careers pages, marks of a search for postings, parts of addresses of job lists.
CAREERS = ("careers", "career", "jobs", "job-search", "work-with-us", "join-us", "join-our-team", "employment", "opportunities")
SEARCH_MARKS = ("search jobs", "search for jobs", "job search", "view all jobs", "current openings", "/job-search")
LIST_HINTS = ("/search", "/jobs", "/job-search", "/joblist", "/job-list", "/openings", "/opportunities", "/positions", "/vacancies", "/careers/search", "/all-jobs", "/jobsearch")
# A stated count above this is a claim, rows above this are no teaser, a page below this is no careers page.
LARGEST_TOTAL, TEASER, SHORT_PAGE = 100_000, 30, 2000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Element:
    """One element: its place in the tree, and the texts below it that a reader sees."""

    __slots__ = ("tag", "attributes", "up", "unseen", "parts")

    def __init__(self, tag: str, attributes: dict[str, str], up: Element | None):
        self.tag, self.attributes, self.up = tag, attributes, up
        self.unseen = bool(up and up.unseen) or bool(UNSEEN.search(attributes.get("class", "")))
        self.parts: list[str] = []

    def text(self) -> str:
        return " ".join(" ".join(self.parts).split())

    def within(self, tag: str, mark: str = "") -> Element | None:
        """The nearest element around this one with that tag (and that word among its classes)."""
        e = self.up
        while e and not (e.tag == tag and mark in e.attributes.get("class", "")):
            e = e.up
        return e


class _Reader(html.parser.HTMLParser):
    """Elements in page order. Texts are kept by the elements of `wanted`, the page's by `whole`."""

    def __init__(self, wanted: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.found, self.open, self.keeping = wanted, [], [], []
        self.whole, self.seen = [], []

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None)
        self.found.append(e)
        if tag not in VOID:
            self.open.append(e)
            if tag in self.wanted:
                self.keeping.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), -1)
        if at >= 0:
            gone = set(map(id, self.open[at:]))
            del self.open[at:]
            self.keeping = [e for e in self.keeping if id(e) not in gone]

    def handle_data(self, data):
        if any(e.tag in SILENT for e in self.open[-1:]):
            return
        self.whole.append(data)
        if not (self.open and self.open[-1].unseen):
            self.seen.append(data)
            for e in self.keeping:
                e.parts.append(data)


def read(page: str, *wanted: str) -> _Reader:
    out = _Reader(frozenset(wanted))
    out.feed(page)
    out.close()
    return out


def visible(page: str | None) -> str:
    """The page's text without code and without what only assistive technology reads."""
    return " ".join(" ".join(read(page).seen).split()) if page else ""


@F.pandas_udf(T.StringType())
def _visible(s: pd.Series) -> pd.Series:
    return s.map(visible)


def visible_text(html_: Column) -> Column:
    return _visible(html_)


def total_of(text: str) -> int | None:
    found = [int(m[1].replace(",", "")) for p in TOTALS for m in p.finditer(text)]
    return max((n for n in found if n <= LARGEST_TOTAL), default=None)


def more(page: str, rows: int) -> tuple[int | None, str | None]:
    """(count that the page states, sign that it holds only a part of its list). Signs from the strongest
    to the weakest; the last counts only where few rows were found."""
    if not page:
        return None, None
    doc = read(page, "a", "button")
    total = total_of(" ".join(" ".join(doc.whole).split()))
    if total is not None and total > max(rows, 0):
        return total, "stated total"
    for e in doc.found:
        if e.tag in ("a", "link") and "next" in e.attributes.get("rel", "").lower().split():
            return total, "next link"
    if any(PAGER.search(e.attributes.get(k, "")) for e in doc.found for k in ("class", "id")):
        return total, "pager"
    for e in doc.found:
        if e.tag in ("a", "button"):
            if MORE.match(e.text() or e.attributes.get("aria-label", "")):
                return total, "more button"
            if PAGE_PARAMETER.search(e.attributes.get("href", "")):
                return total, "page link"
    if rows <= TEASER and any(e.tag == "a" and "href" in e.attributes and VIEW_ALL.match(e.text()) for e in doc.found):
        return total, "link to all"
    return total, None


def careers_link(page: str, base: str) -> str | None:
    """The link that best names a careers page: by its whole text, a part of it, or its address."""
    best = (0, None)
    for e in read(page, "a").found:
        href = e.attributes.get("href", "")
        if e.tag != "a" or not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        text, score = " ".join(" ".join(e.parts).split()).lower(), 0
        for name in CAREERS:
            score = max(score, 100 if text == name else 70 if name in text else 0)
            score += 20 * (name in href.lower())
        if score > best[0]:
            best = (score, urljoin(base, href))
    return best[1]


def is_careers_page(page: str) -> bool:
    """A page of some length with links to postings, or with a search for them."""
    if len(page) < SHORT_PAGE:
        return False
    low = page.lower()
    return any(True for _ in pages.links(page, "https://page.invalid/")) or any(m in low for m in SEARCH_MARKS)


def list_links(page: str, base: str, most: int = 5) -> list[str]:
    """The first few distinct links whose address looks like a job list's."""
    out: dict[str, None] = {}
    for e in read(page).found:
        href = e.attributes.get("href", "")
        if e.tag == "a" and href and not href.startswith(("#", "javascript:")) and any(h in href.lower() for h in LIST_HINTS):
            out.setdefault(urljoin(base, href))
            if len(out) >= most:
                break
    return list(out)


def page_signs(table: DataFrame, rows: Column) -> DataFrame:
    """page_id, total, more, careers_link, careers_page, list_links of pages (page_id, url, html); rows: how
    many postings were found on each."""
    given = table.select("page_id", "url", "html", rows.cast("long").alias("rows"))
    schema = "page_id long, total long, more string, careers_link string, careers_page boolean, list_links array<string>"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]
    names = ["page_id", "total", "more", "careers_link", "careers_page", "list_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, u, p, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, u = p or "", u or ""
                out.append((i, *more(p, n or 0), careers_link(p, u), is_careers_page(p), list_links(p, u)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return given.mapInArrow(run, schema)


def balanced(text: str, start: int) -> str | None:
    """From the brace at start to the one that closes it; braces within strings count like others."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[start : m.end()]
    return None


def object_after(page: str | None, mark: str) -> str | None:
    """The JSON object after a mark in a page's code, as text; None where there is none or it does not parse."""
    found = re.search(mark, page or "", re.I)
    start = (page or "").find("{", found.end()) if found else -1
    text = balanced(page, start) if start >= 0 else None
    try:
        return text if text and isinstance(json.loads(text), dict) else None
    except ValueError:
        return None


# Marks before the objects that vendors' pages hold.
MARKS = {"paylocity": r"window\.pageData\s*=\s*", "phenom": r"phApp\.ddo\s*=\s*", "cornerstone": r"csod\.context\s*=\s*"}


def page_object(html_: Column, mark: str) -> Column:
    """The object after a mark, as JSON text for the vendors' mappings."""

    @F.pandas_udf(T.StringType())
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda p: object_after(p, mark))

    return find(html_)


LABEL = re.compile(r"^(job\s+)?locations?\s*[:\-]?\s*", re.I)


def radancy_cards(fragment: str, base: str) -> Iterator[tuple[str, str | None, str]]:
    """(title, location, address) of the links to postings with a heading; the place stands in the link."""
    doc = read(fragment, "h2", "h3", "a", *("span", "div", "p", "li", "dd"))
    heads: dict[int, str] = {}
    places: dict[tuple[int, str], str] = {}
    for e in doc.found:
        a = e.within("a")
        if a is None:
            continue
        if e.tag in ("h2", "h3"):
            heads.setdefault(id(a), e.text())
        for k in ("job-location", "job-info"):
            if k in e.attributes.get("class", "").lower():
                places.setdefault((id(a), k), e.text())
    for a in doc.found:
        href = a.attributes.get("href", "")
        if a.tag == "a" and "data-job-id" in a.attributes and "/job/" in href.lower() and heads.get(id(a)):
            place = places.get((id(a), "job-location"), places.get((id(a), "job-info")))
            yield heads[id(a)], LABEL.sub("", place) or None if place else None, urljoin(base, href) if href.startswith("/") else href


def radancy_fragment(body: str) -> str:
    """The markup of a results answer: the member `results` of a JSON object, or the body itself."""
    try:
        value = json.loads(body)
    except ValueError:
        return body
    return (value.get("results") or "") if isinstance(value, dict) else ""


def jobvite_rows(page: str, base: str) -> Iterator[tuple[str, str | None, str]]:
    """(title, location, address) of a board's table: name cells with a link below the tenant's path."""
    doc = read(page, "a", "td")
    slug = next((s for s in urlsplit(base).path.split("/") if s), "")
    where: dict[int, str] = {}
    for e in doc.found:
        if e.tag == "td" and "jv-job-list-location" in e.attributes.get("class", "").split() and (row := e.within("tr")):
            where.setdefault(id(row), e.text())
    for a in doc.found:
        href = a.attributes.get("href", "")
        if a.tag == "a" and f"/{slug}/job/" in href and a.within("td", "jv-job-list-name") and a.text():
            row = a.within("tr")
            yield a.text(), (where.get(id(row)) or None) if row else None, urljoin(base, href)


def endpoint_rows(body: str, base: str) -> Iterator[tuple[str, str | None, str]]:
    """(title, location, address) of the job-shaped objects in an answer of a remembered endpoint."""
    try:
        value = json.loads(body)
    except ValueError:
        return
    for title, link, node in pages.job_nodes(value):
        place = next((node[k] for k in ("location", "city", "joblocation", "primarylocation", "locationname", "full_location") if node.get(k)), None)
        if isinstance(place, dict):
            place = ", ".join(str(place[k]) for k in ("city", "state", "country") if place.get(k))
        elif isinstance(place, list):
            place = ", ".join(str(x) for x in place[:3])
        yield title, (str(place) if place else None), urljoin(base, link)


ROWS: dict[str, Callable[[str, str], Iterator[tuple[str, str | None, str]]]] = {
    "radancy": lambda body, base: radancy_cards(radancy_fragment(body), base),
    "jobvite": jobvite_rows,
    "endpoint": endpoint_rows,
}


def vendor_rows(table: DataFrame, vendor: str) -> DataFrame:
    """page_id, title, location, job_url of pages (page_id, url, html) in a vendor's own markup, or of
    answers of a remembered endpoint."""
    names = ["page_id", "title", "location", "job_url"]
    make = ROWS[vendor]
    return pages._rows(table.select("page_id", "url", "html"), "page_id long, title string, location string, job_url string", names, lambda p, u: make(p, u))


# What links to postings have in a vendor's pages, best first; an empty text is any hint of a posting.
FALLBACK = {"icims": ('class="iCIMS_Anchor', ""), "successfactors": ("/job/",), "avature": ("JobDetail",)}


def listed(table: DataFrame, vendor: str) -> DataFrame:
    """page_id, title, location, job_url of a vendor's result pages: their JSON-LD postings, and where a
    page has none, its links to postings."""

    def make(page: str, base: str) -> Iterator[tuple[str, str | None, str]]:
        found = [(n["title"], pages.address(n), n.get("url") or n.get("@id")) for n in pages.postings(page) if n.get("title") and (n.get("url") or n.get("@id"))]
        if found:
            yield from found
            return
        for mark in FALLBACK[vendor]:
            seen: dict[str, str] = {}
            for e in read(page, "a").found:
                href = e.attributes.get("href", "")
                if mark.startswith("class="):
                    fits = mark[7:] in e.attributes.get("class", "")
                else:
                    fits = mark in href if mark else any(h in urljoin(base, href).lower() for h in pages.LINK_HINTS)
                if e.tag == "a" and href and fits and len(e.text()) >= 3:
                    seen.setdefault(urljoin(base, href), e.text())
            if seen:
                yield from ((t, None, u) for u, t in seen.items())
                return

    return pages._rows(table.select("page_id", "url", "html"), "page_id long, title string, location string, job_url string", ["page_id", "title", "location", "job_url"], make)
