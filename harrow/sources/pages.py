"""Records from recorded pages: JSON-LD, hydration payloads, links, stated totals.

Parsing a page is a small Python helper per row; Spark deals the pages. Each table function maps a
column of pages (site, url, html) to rows, in Arrow batches, with no shuffle.
"""

from __future__ import annotations

import bisect
import html as h
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that mark a posting's address.
LINK_HINTS = ("/job", "/jobs/", "/careers/", "/position", "/opening", "/vacanc", "/requisition", "jobid=", "gh_jid=", "/opportunit")
# Keys that hold a title or an address, and what pages say that keep robots out.
TITLE_KEYS = ("title", "jobtitle", "job_title", "positiontitle", "postingtitle")
URL_KEYS = ("url", "joburl", "job_url", "applyurl", "absolute_url", "hostedurl", "externalpath", "canonicalpositionurl")
BLOCKED = ("access denied", "are you a robot", "captcha", "unusual traffic", "verify you are human", "request blocked", "just a moment", "checking your browser", "enable javascript and cookies", "attention required", "pardon our interruption", "forbidden")
_SCRIPT = re.compile(r"""<script[^>]*type\s*=\s*["']?application/ld\+json[^>]*>(.*?)</script>""", re.I | re.S)
_BLOB = re.compile(r"""(?:id\s*=\s*["']__NEXT_DATA__["'][^>]*>|(?:window\.|phApp\.)[A-Za-z_$][\w$.]*\s*=\s*)(?=\{)""")
_ANCHOR = re.compile(r"""<a\s[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>""", re.I)
_ANCHOR_END = re.compile(r"</a>", re.I)
_TAGS = re.compile(r"<[^>]+>")


def _nodes(value, deep: bool) -> Iterator[dict]:
    """Dicts of a JSON-LD value: through lists and @graph, or through everything."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += [x for x in reversed(v) if isinstance(x, (dict, list))]
        elif isinstance(v, dict):
            yield v
            todo += [x for x in v.values() if isinstance(x, (dict, list))][::-1] if deep else [v["@graph"]] if "@graph" in v else []


def postings(page: str, deep: bool = False) -> Iterator[dict]:
    """JobPosting nodes of a page's JSON-LD; scripts that do not parse are passed over."""
    for m in _SCRIPT.finditer(page):
        try:
            value = json.loads(m[1])
        except ValueError:
            continue
        for n in _nodes(value, deep):
            kind = n.get("@type")
            kinds = [] if deep else kind if isinstance(kind, list) else [kind]
            if (deep and kind == "JobPosting") or any(isinstance(k, str) and k.lower() == "jobposting" for k in kinds):
                yield n


def address(node: dict) -> str | None:
    """The first location that says something: locality, region, country."""
    places = node.get("jobLocation")
    for p in places if isinstance(places, list) else [places]:
        a = p.get("address") if isinstance(p, dict) else None
        if isinstance(a, str) and a.strip():
            return a.strip()
        if isinstance(a, dict):
            country = a.get("addressCountry")
            parts = [a.get("addressLocality"), a.get("addressRegion"), country.get("name") if isinstance(country, dict) else country]
            said = ", ".join(x.strip() for x in parts if isinstance(x, str) and x.strip())
            if said:
                return said
    return None


def payloads(page: str, most: int | None = None, least: int = 200) -> Iterator[object]:
    """JSON objects that scripts of a page hold for their framework, of those not marked as a framework's only
    such of `least` letters or more; all of them, or those among the first `most` candidates. What does not
    parse, or is nested deeper than the parser can follow, is passed over."""
    decoder = json.JSONDecoder()
    done = n = 0
    for m in _BLOB.finditer(page):
        if m.start() < done:  # within the payload before
            continue
        if n == most:
            break
        n += 1
        try:
            value, end = decoder.raw_decode(page, m.end())
        except (ValueError, RecursionError):
            continue
        done = end
        if "__NEXT_DATA__" in m[0] or end - m.end() >= least:
            yield value


def job_nodes(value: object, most: int | None = None) -> Iterator[tuple[str, str, dict]]:
    """(title, address, object with lower-case keys) of nested objects with both, each address once: in the
    whole value, or in its first `most` objects and lists. Time and memory follow the value's size."""
    seen: set[str] = set()
    todo, n = [value], 0
    while todo and n != most:
        v, n = todo.pop(), n + 1
        if isinstance(v, list):
            todo += [x for x in reversed(v) if isinstance(x, (dict, list))]
        elif isinstance(v, dict):
            low = {str(k).lower(): x for k, x in v.items()}
            title = next((low[k] for k in TITLE_KEYS if isinstance(low.get(k), str) and low[k].strip()), None)
            link = next((low[k] for k in URL_KEYS if isinstance(low.get(k), str) and low[k].strip()), None)
            if title and link and link not in seen:
                seen.add(link)
                yield title.strip(), link.strip(), low
            todo += [x for x in v.values() if isinstance(x, (dict, list))][::-1]


def job_shaped(value: object, most: int | None = None) -> Iterator[tuple[str, str]]:
    """(title, address) of job_nodes()."""
    for title, link, _ in job_nodes(value, most):
        yield title, link


def links(page: str, base: str, hints=LINK_HINTS) -> Iterator[tuple[str, str]]:
    """(text, absolute address) of anchors whose address looks like a posting's, each once."""
    seen: set[str] = set()
    ends = [m.start() for m in _ANCHOR_END.finditer(page)]
    at = 0
    for m in _ANCHOR.finditer(page):
        if m.start() < at:  # within the link before
            continue
        k = bisect.bisect_left(ends, m.end())
        if k == len(ends):
            break
        at = ends[k]
        text = " ".join(h.unescape(_TAGS.sub(" ", page[m.end() : at])).split())
        href = h.unescape(m[1]).strip()
        if len(text) < 3 or href.lower().startswith(("javascript:", "mailto:", "tel:")) or (href.startswith("#") and "/" not in href):
            continue
        whole = urljoin(base or "", href)
        if any(x in whole.lower() for x in hints) and whole not in seen:
            seen.add(whole)
            yield text, whole


def _rows(df: DataFrame, schema: str, names: list[str], make: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i.as_py(), *r) for i, u, p in zip(*b.columns[:3], strict=True) for r in make(p.as_py() or "", u.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.string()) for k in range(len(names))], names)

    return df.mapInArrow(run, schema)


def jsonld_jobs(pages: DataFrame, deep: bool = False) -> DataFrame:
    """page_id, title, location, date_posted, job_url, employment_type, description of JSON-LD postings."""
    text = lambda v: v if isinstance(v, str) else ", ".join(map(str, v)) if isinstance(v, list) else None
    names = ["page_id", "title", "location", "date_posted", "job_url", "employment_type", "description"]
    make = lambda p, u: ((text(n.get("title")), address(n), text(n.get("datePosted")), text(n.get("url")) or u, text(n.get("employmentType")), text(n.get("description"))) for n in postings(p, deep))
    return _rows(pages.select("page_id", "url", "html"), "page_id long, title string, location string, date_posted string, job_url string, employment_type string, description string", names, make)


def payload_jobs(pages: DataFrame) -> DataFrame:
    make = lambda p, u: ((t, urljoin(u, x)) for v in payloads(p) for t, x in job_shaped(v))
    return _rows(pages.select("page_id", "url", "html"), "page_id long, title string, job_url string", ["page_id", "title", "job_url"], make)


def job_links(pages: DataFrame, hints=LINK_HINTS) -> DataFrame:
    return _rows(pages.select("page_id", "url", "html"), "page_id long, title string, job_url string", ["page_id", "title", "job_url"], lambda p, u: links(p, u, hints))


def stated_total(text: Column) -> Column:
    """The largest believable count that a page states: "1,234 jobs", "of 99", "showing 1 - 20 of 99"."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)) for p in (r"([0-9][0-9,]*)\s+(?:open\s+)?(?:jobs|positions|openings|results)\b", r"\bof\s+([0-9][0-9,]*)\b", r"\btotal[:\s]+([0-9][0-9,]*)")]))
    return F.array_max(F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long")), lambda n: n <= 100_000))


def blocked(title: Column, body: Column) -> Column:
    """A page that keeps robots out, by its title and opening."""
    hay = F.lower(F.concat_ws(" ", title, F.substring(body, 1, 4000)))
    return F.coalesce(hay.rlike("|".join(BLOCKED)), F.lit(False))
