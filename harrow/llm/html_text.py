"""Main text of web pages: a recurrent labeller of blocks.

A page becomes its sequence of text blocks. Each block is a vector of its tag path (tags, classes and
ids, hashed), of its words (hashed) and of a few measures. A bidirectional LSTM in numpy reads the
whole sequence and says for each block whether it belongs to the main text. It is trained on the
driver when first needed, on pages that a seeded generator makes (TRAIN_PAGES of them), in seconds;
its weights go to the workers.

Defined results: null, empty and textless pages give empty text; comments, raw elements (RAW) and what
never ends in markup (an open tag, comment or raw element at the end) are no text. Tags end as the HTML
standard says, with two leniencies: a quoted value that nothing closes ends with its tag, and a raw
element written self-closed is empty. Character references are
decoded; white space in a block becomes one space; blocks join by an empty line; repeated rows are
read each; an empty table gives no rows. Other columns stay; `text` and `n_chars` replace columns of that name.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import core

PATH_DIM, LEAF_DIM, WORD_DIM, HIDDEN = 192, 64, 32, 24
TRAIN_PAGES, EPOCHS, SEED = 1800, 8, 5
#: Pages that one step of the network sees at once (of like length), and blocks with vectors at once: a group
#: of pages takes its longest page's blocks times its pages; a page of more blocks goes through in pieces.
TOGETHER, BLOCKS = 64, 8192
#: Letters of pages whose blocks are held at once, beside the last page's.
PAGES_CHARS = 2 << 20

#: Close mark, name, attributes, self-closing mark. A quote opens a value only right after an equals sign.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/(?!>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)(/?)>""")
_NAMES = re.compile(r"""(?:\s|^)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
#: Fixed values of the HTML standard: elements without content, with raw content, and those that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements of other languages; in them only code is raw, and the tags of BREAKS_OUT end them.
FOREIGN = ("svg", "math")
INTEGRATION = ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Closed at any depth, whatever stands open in them.
CONTAINERS = frozenset([*FOREIGN, "object", "template", "noscript", "select"])
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A paragraph ends where one of these opens.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option legend summary body html head button".split())
SELF_ENDING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}


class Block:
    __slots__ = ("text", "path", "leaf", "depth", "linked")

    def __init__(self, text: str, path: tuple, leaf: str, depth: int, linked: float):
        self.text, self.path, self.leaf, self.depth, self.linked = text, path, leaf, depth, linked


@functools.lru_cache(50_000)
def _slot(name: str, dim: int) -> int:
    return zlib.crc32(name.encode()) % dim


@functools.lru_cache(20_000)
def names(tag: str, attributes: str) -> tuple[int, ...]:
    """The places in a path's vector of an element's tag and its words of class, id and role."""
    out = [tag]
    for m in _NAMES.finditer(attributes):
        for w in _PART.findall((m[2] or m[3] or m[4] or "").lower()):
            out.append("." + w)
    return tuple(dict.fromkeys(_slot(n, PATH_DIM) for n in out))


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; the whole page is read, in linear time. A block's path is the
    set of places in its vector that some open element takes, however many are open."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = []  # tag, names, place of the block element that is innermost there
    taken: dict[int, int] = {}
    where: dict[str, list[int]] = {}
    endless: set[str] = set()
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                path = tuple(taken)
                if out and out[-1].path == path:  # neighbours share it
                    path = out[-1].path
                leaf = stack[stack[-1][2]][0] if stack and stack[-1][2] >= 0 else ""
                out.append(Block(text, path, leaf, len(stack), min(1.0, linked / max(1, len(raw)))))
        linked = 0

    def last(name: str) -> int:
        """The place of the innermost open element of that name."""
        at = where.get(name)
        return at[-1] if at else -1

    def close(name: str, stops: tuple = ()) -> None:
        nonlocal in_link
        k = last(name)
        if k < 0 or k < max(map(last, stops), default=-1):
            return
        while len(stack) > k:
            gone, slots, _ = stack.pop()
            where[gone].pop()
            for x in slots:
                taken[x] -= 1
                if not taken[x]:
                    del taken[x]
            in_link -= gone == "a"

    def foreign() -> str:
        """The element of another language that is open here, if one is."""
        k, name = max((last(x), x) for x in FOREIGN)
        return name if k > max(map(last, INTEGRATION)) else ""

    at = 0
    while True:
        m = _OPEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            if end < 0:
                break
            at = end + 3
            continue
        tag = _TAG.match(page, at)
        if not tag:
            if page[at + 1] in "!?" or (page[at + 1] == "/" and not page[at + 2 : at + 3].isalpha()):
                end = page.find(">", at)
                if end < 0:
                    break
                at = end + 1
                continue
            break  # a tag that never ends
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if name in BLOCK:
                flush()
                close(name)
            elif name in CONTAINERS:
                if 0 <= last(name) < stack[-1][2]:
                    flush()
                close(name)
            elif last(name) >= 0:
                close(name, ("body", "article", "div", "section", "td", "li"))
            continue
        inside = foreign() if where.get("svg") or where.get("math") else ""
        if inside and name in BREAKS_OUT:
            while inside:
                close(inside)
                inside = foreign()
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_P:
                close("p", ("article", "div", "section", "td", "li", "body", "button", "aside", "main", "form"))
            if name in SELF_ENDING:
                close(name, SELF_ENDING[name])
        if name in RAW and not tag[4] and (not inside or name in ("script", "style")):
            end = None if name in endless else re.compile("</" + re.escape(name) + r"(?=[\s/>])", re.I).search(page, at)
            if end:
                at = page.find(">", end.start())
                if at < 0:
                    break
                at += 1
                continue
            if not inside:
                break
            endless.add(name)
        if name not in VOID and not tag[4]:
            where.setdefault(name, []).append(len(stack))
            slots = names(name, tag[3])
            for x in slots:
                taken[x] = taken.get(x, 0) + 1
            stack.append((name, slots, len(stack) if name in BLOCK else stack[-1][2] if stack else -1))
            in_link += name == "a"
    flush()
    return out


# ---------------------------------------------------------------- vectors


INPUT = PATH_DIM + LEAF_DIM + WORD_DIM + 6


def vectors(found: list[Block]) -> np.ndarray:
    """One row a block."""
    n = len(found)
    x = np.zeros((n, INPUT), np.float32)
    rows = np.fromiter((i for i, b in enumerate(found) for _ in b.path), np.int64)
    x[rows, np.fromiter((p for b in found for p in b.path), np.int64, len(rows))] = 1
    x[np.arange(n), PATH_DIM + np.fromiter((_slot(b.leaf, LEAF_DIM) for b in found), np.int64, n)] = 1
    encoded = [b.text.encode() for b in found]
    at = np.cumsum([0, *map(len, encoded)])
    hashes, begin = core.word_hashes(np.frombuffer(b"".join(encoded), np.uint8), at, core.LOWER)
    of = np.repeat(np.arange(n), np.diff(begin))
    counts = np.bincount(of * WORD_DIM + (hashes & np.uint64(WORD_DIM - 1)).astype(np.int64), minlength=n * WORD_DIM)
    words = np.diff(begin)
    x[:, PATH_DIM + LEAF_DIM : PATH_DIM + LEAF_DIM + WORD_DIM] = counts.reshape(n, WORD_DIM) / np.maximum(1, words)[:, None]
    m = x[:, -6:]
    m[:, 0] = np.log1p(words) / 5
    m[:, 1] = [b.linked for b in found]
    m[:, 2] = [min(b.depth, 20) / 10 for b in found]
    m[:, 3] = [b.text[-1] in ".!?" for b in found]
    m[:, 4] = [("©" in b.text) for b in found]
    m[:, 5] = words == 1
    return x


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Two LSTMs, one from each end, and a logistic unit over both states."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": w(INPUT, 4 * HIDDEN), f"h{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"o": w(2 * HIDDEN, 1), "q": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """x: pages x steps x input. States of each step, and the last one (given back as `state`, it goes on
        there); padded steps carry the state on."""
        b, t, _ = x.shape
        z = (x.reshape(b * t, -1) @ self.p[f"x{d}"] + self.p[f"c{d}"]).reshape(b, t, -1)
        h, c = state or (np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32))
        out = np.zeros((b, t, HIDDEN), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[:, s] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(a[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[:, s, None]
            if keep is not None:
                keep.append((s, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[:, s] = h
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, None)[0] for d in "fb"], axis=2)
        return (both @ self.p["o"])[:, :, 0] + self.p["q"]

    def long_logits(self, found: list[Block]) -> np.ndarray:
        """The same for one page of any length: only the states of all its blocks are held."""
        both = np.zeros((len(found), 2 * HIDDEN), np.float32)
        starts = range(0, len(found), BLOCKS)
        for n, d in enumerate("fb"):
            state = None
            for s in starts if d == "f" else reversed(starts):
                x = vectors(found[s : s + BLOCKS])[None]
                out, state = self._run(x, np.ones(x.shape[:2], bool), d, None, state)
                both[s : s + BLOCKS, n * HIDDEN : (n + 1) * HIDDEN] = out[0]
        return (both @ self.p["o"])[:, 0] + self.p["q"]

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d])[0] for d in "fb"], axis=2)
        p = _sigmoid((both @ self.p["o"])[:, :, 0] + self.p["q"])
        e = (p - y) * mask / mask.sum()
        g = {"o": np.einsum("bth,bt->h", both, e)[:, None], "q": e.sum(keepdims=True).reshape(1)}
        top = e[:, :, None] * self.p["o"][:, 0]
        for n, d in enumerate("fb"):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh_next = np.zeros((len(x), HIDDEN), np.float32)
            dc_next = np.zeros_like(dh_next)
            gh = np.zeros_like(self.p[f"h{d}"])
            for s, h, c, i, f, o, gg, tc, m in reversed(kept[d]):
                dh = top[:, s, n * HIDDEN : (n + 1) * HIDDEN] + dh_next
                dc = dc_next + dh * o * (1 - tc * tc)
                a = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1) * m
                dz[:, s] = a
                gh += h.T @ a
                dh_next = np.where(m, a @ self.p[f"h{d}"].T, dh)
                dc_next = np.where(m, dc * f, dc_next)
            flat = dz.reshape(-1, 4 * HIDDEN)
            g |= {f"x{d}": x.reshape(len(flat), -1).T @ flat, f"h{d}": gh, f"c{d}": flat.sum(0)}
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, INPUT), np.float32), np.zeros((len(pages), t), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = True
    return x, mask


def label(net: Network, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which blocks are main text."""
    out: list = [np.zeros(0, bool)] * len(pages)
    some: list[int] = []

    def done() -> None:
        if some:
            for k, row in zip(some, net.logits(*padded([vectors(pages[k]) for k in some])), strict=True):
                out[k] = row[: len(pages[k])] > 0
            some.clear()

    for k in sorted(range(len(pages)), key=lambda i: len(pages[i])):
        n = len(pages[k])
        if n > BLOCKS:
            out[k] = net.long_logits(pages[k]) > 0
        elif n:
            if len(some) == TOGETHER or (len(some) + 1) * n > BLOCKS:
                done()
            some.append(k)
    done()
    return out


# ---------------------------------------------------------------- training pages

_MAIN = ["article", "post", "content", "entry-content", "story", "article-body", "post-text", "main-content", "blog-post", "news-text"]
_REST = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "topbar", "links"],
    "header": ["header", "masthead", "site-header", "logo", "page-top", "branding"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal"],
    "aside": ["sidebar", "widget", "related", "side", "popular", "teaser-list", "archive"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sponsor"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "newsletter", "subscribe", "share", "social"],
    "form": ["form", "search", "login", "signup", "contact-form"],
    "comments": ["comments", "comment-list", "comment", "discussion", "respond", "replies"],
}
MARKS = ("qqmain", "qqrest")


def training_page(rng: random.Random) -> str:
    """A page whose every block ends in a marker word that says what it is."""
    syll = rng.choice([["the", "an", "er", "tion", "nd", "sh", "ing"], ["le", "eau", "qui", "ment", "oi", "pa"], ["der", "ung", "ich", "sch", "keit"], ["ción", "os", "ado", "que", "ja"]])
    if rng.random() < 0.6:  # words of no language in particular
        syll = ["".join(rng.choice("aeiouy" if k % 2 else "bcdfghklmnprstvwz") for k in range(rng.randint(1, 4))) for _ in range(12)]
    plain = rng.random() < 0.5  # classes that say nothing, so that form and order must
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(a, b)))

    def tag(name: str, inner: str, cls: str = "") -> str:
        if plain:
            cls = rng.choice(["", "", f"c{rng.randint(1, 9)}", rng.choice("abwxyz"), f"css-{word()}", f"{word()} {word()}", "row", "col", "wrap", "inner", "box", "container"])
        how = f' class="{cls}"' if cls and rng.random() < 0.8 else f' id="{cls}"' if cls else ""
        return f"<{name}{how}>{inner}</{name}>"

    rest = lambda a=1, b=12: words(a, b) + " " + MARKS[1]
    main = lambda a=1, b=60: words(a, b) + rng.choice([".", "", "!"]) + " " + MARKS[0]

    def links(n: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{rest(1, 3)}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>" if rng.random() < 0.8 else "".join(f'<div><a href="#">{rest(1, 3)}</a></div>' for _ in range(n))

    def boiler(kind: str) -> str:
        cls = rng.choice(_REST[kind]) if rng.random() < 0.75 else ""
        body = {
            "nav": lambda: links(rng.randint(2, 9)),
            "header": lambda: rng.choice([f"<h1>{rest(1, 4)}</h1>", f"<p>{rest(2, 8)}</p>", f"<div>{rest(1, 4)}</div>" + links(3), rest(1, 5)]),
            "footer": lambda: rng.choice([f"&copy; {rest(2, 14)}", f"<p>© 2024 {rest(2, 8)}</p>" + links(3), rest(2, 20)]),
            "aside": lambda: f"<h3>{rest(1, 4)}</h3>" + rng.choice([links(4), f"<p>{rest(3, 25)}</p>"]),
            "ad": lambda: rng.choice([rest(2, 14), f"<p>{rest(3, 25)}</p>", f'<a href="x">{rest(2, 9)}</a>']),
            "notice": lambda: rng.choice([f"<p>{rest(4, 30)}</p><button>{rest(1, 2)}</button>", rest(3, 15)]),
            "form": lambda: f"<label>{rest(1, 3)}</label><input name=q><button>{rest(1, 2)}</button>",
            "comments": lambda: f"<h3>{rest(1, 3)}</h3>" + "".join(rng.choice([f'<div class="comment"><p>{rest(3, 40)}</p></div>', f"<p><b>{words(1, 2)}</b> {rest(3, 30)}</p>", f"<ul><li>{rest(3, 30)}</li></ul>"]) for _ in range(rng.randint(1, 5))),
        }[kind]()
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if plain and kind in ("aside", "ad", "comments"):
            return boiler(rng.choice(["nav", "footer", "form", "notice"]))  # not to be told from an article by form
        if plain and kind == "notice":
            return tag("div", f"<p>{rest(3, 14)}</p><button>{rest(1, 2)}</button>")
        if plain and kind == "footer" and own == "footer" and rng.random() < 0.5:
            return tag("div", rng.choice([f"&copy; {rest(2, 14)}", f"<p>© 2024 {rest(2, 8)}</p>"]))
        if rng.random() < 0.5 and own != "form":
            return tag("div", body, cls or rng.choice(_REST[kind]))
        return tag(own, body, cls or (rng.choice(_REST[kind]) if own in ("div", "section") else ""))

    paragraphs = []
    for k in range(rng.choice([0, 1, 2, 4, 8, 14])):
        inner = main(1, rng.choice([3, 20, 80]))
        roll = rng.random()
        if roll < 0.1:
            paragraphs.append(f"<h{rng.randint(2, 3)}>{main(1, 6)}</h2>")
        elif roll < 0.16:
            paragraphs.append("<ul>" + "".join(f"<li>{main(2, 12)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
        elif roll < 0.2:
            paragraphs.append(f"<blockquote>{inner}</blockquote>")
        elif roll < 0.3:
            paragraphs.append(f"<p><b>{inner}<br><p>{main()}</p>")
        elif roll < 0.34:
            paragraphs.append(f'<p><a href="/x">{words(1, 3)}</a> {inner}</p>')
        elif roll < 0.37:
            paragraphs.append(f"<table><tr><td>{main(1, 4)}</td><td>{main(1, 4)}</td></tr></table>")
        elif roll < 0.42:
            head = "".join(f"<th>{main(1, 2)}</th>" for _ in range(rng.randint(2, 4)))
            paragraphs.append(f"<table><caption>{main(1, 5)}</caption><tr>{head}</tr>" + "".join(rng.choice([f"<tr><td>{main(1, 3)}</td><td>{main(1, 2)}</td></tr>", f"<tr><th>{main(1, 2)}</th><td>{main(1, 9)}</td></tr>"]) for _ in range(rng.randint(1, 6))) + "</table>")
        elif roll < 0.46:
            paragraphs.append(rng.choice(["<pre>{}</pre>", "<pre><code>{}</code></pre>", "<div><pre>{}</pre></div>"]).format(main(1, 30)))
        elif roll < 0.5:
            paragraphs.append("<dl>" + "".join(f"<dt>{main(1, 2)}</dt><dd>{main(1, 20)}</dd>" for _ in range(rng.randint(1, 5))) + "</dl>")
        elif roll < 0.54:
            paragraphs.append("<ol>" + "".join(f"<li>{main(1, 18)}</li>" for _ in range(rng.randint(2, 7))) + "</ol>")
        elif roll < 0.57:
            paragraphs.append(f"<figure><img src=x><figcaption>{main(1, 9)}</figcaption></figure>")
        elif roll < (0.8 if plain else 0.6):
            paragraphs.append(tag("div", inner) if rng.random() < 0.8 else f"<section><h2>{main(1, 5)}</h2><div>{inner}</div></section>")
        else:
            paragraphs.append(f"<p>{inner}</p>")
        if rng.random() < 0.08 and k:
            paragraphs.append(boiler(rng.choice(["ad", "aside", "form", "notice"])))
    title = f"<h1>{main(2, 10)}</h1>" if rng.random() < 0.85 else ""
    if title and rng.random() < 0.1:
        title = f"<header>{title}</header>"
    story = title + "".join(paragraphs) + (boiler("comments") if rng.random() < 0.12 else "")
    shape = rng.random()
    if shape < (0.2 if plain else 0.45):
        story = tag("article", story, rng.choice(_MAIN) if rng.random() < 0.3 else "")
    elif shape < (0.3 if plain else 0.6):
        story = tag("main", story)
    elif shape < 0.92:
        story = tag("div", story, rng.choice(_MAIN))
        for _ in range(rng.choice([0, 0, 1, 2]) if plain else 0):
            story = tag("div", story)
    top = [boiler(k) for k in ("header", "nav", "ad", "notice", "form") if rng.random() < 0.5]
    end = [boiler(k) for k in ("aside", "comments", "ad", "notice", "footer", "nav") if rng.random() < 0.45]
    rng.shuffle(top)
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>" + "".join(top) + "<!-- x -->" + story + "".join(end) + "</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a training page without their markers, and their labels."""
    found, y = [], []
    for b in blocks(page):
        last = b.text.rsplit(" ", 1)
        y.append(last[-1] == MARKS[0])
        b.text = b.text.replace(" " + MARKS[0], "").replace(" " + MARKS[1], "") or "x"
        found.append(b)
    return found, np.array(y, np.float32)


@functools.lru_cache(1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    rng, net = random.Random(seed), Network(seed)
    data = [(vectors(b), y) for b, y in (labelled(training_page(rng)) for _ in range(pages)) if b]
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i : i + 32] for i in range(0, len(data), 32)]
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(groups)
        for g in groups:
            x, mask = padded([d[0] for d in g])
            y = np.zeros(mask.shape, np.float32)
            for i, d in enumerate(g):
                y[i, : len(d[1])] = d[1]
            step += 1
            rate = 0.01 / (1 + epoch / 3)
            for k, d in net.gradient(x, y, mask).items():
                d = np.clip(d, -1, 1)
                m1[k] += 0.1 * (d - m1[k])
                m2[k] += 0.01 * (d * d - m2[k])
                net.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out_accuracy(pages: int = 300, seed: int = 77) -> float:
    rng, hit, n = random.Random(seed), 0, 0
    found = [labelled(training_page(rng)) for _ in range(pages)]
    for (_, y), got in zip(found, label(trained(), [b for b, _ in found]), strict=True):
        hit, n = hit + int((got == (y > 0)).sum()), n + len(y)
    return hit / n


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages without html, with text (the main text) and n_chars (its code points)."""
    spark = pages.sparkSession
    core.small_batches(spark)
    cast = spark.sparkContext.broadcast(trained())
    pages = pages.drop(*({"text", "n_chars"} - {page}))
    fields = [f for f in pages.schema.fields if f.name != page] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(page)
            texts: list[str] = []
            held, n = [], 0
            for i in range(b.num_rows):
                h = b.column(at)[i].as_py() or ""
                held.append(blocks(h))
                n += len(h)
                if n > PAGES_CHARS or i == b.num_rows - 1:
                    texts += ["\n\n".join(x.text for x, k in zip(bs, keep, strict=True) if k) for bs, keep in zip(held, label(cast.value, held), strict=True)]
                    held, n = [], 0
            rest = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [f.name for f in fields])

    return pages.mapInArrow(run, T.StructType(fields))
