import html.parser
import random
import subprocess
import sys
from pathlib import Path

import numpy as np

from harrow.llm import html_text as H


def test_blocks():
    page = "<!doctype html><head><title>no</title><style>p{}</style></head><body><script>var t='</p>'</script><!-- <p>no</p> --><p>a &amp; b\n\n c&nbsp;d<br>e<b>f</b><p>g</b> <i>h</i></p>tail<img alt='x>y'>more<li>1<li>2</ul></body>"
    assert [b.text for b in H.blocks(page)] == ["a & b c d ef", "g h", "tailmore", "1", "2"]
    assert [b.text for b in H.blocks("x < 3 and 4 > 2 <p>y</p> <a href='never ends")] == ["x < 3 and 4 > 2", "y"]
    assert H.blocks("") == [] and [b.text for b in H.blocks("a<!-- never ends")] == ["a"]


def test_hard_pages_take_linear_time():
    for x in ("<" * 200_000, "<a '" * 50_000, "<p>" * 100_000, "<div><b>" * 30_000 + "x", "<!--" * 50_000, "&#" * 100_000, "<script>" * 30_000):
        H.blocks(x)


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_elements_that_are_not_raw():
    """Text after self-closed and unclosed elements, and in elements that the labeller is to judge."""
    assert texts("<p>a<svg class=x /><p>b<iframe src=y /><p>c<script/><p>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<svg><path d=x><p>b") == ["a", "b"]
    assert texts("<p>a<select><option>b<option>c</select>d") == ["a", "b", "c", "d"]
    assert texts("<svg><title/><style/><text>t</text></svg><p>b") == ["t", "b"]
    assert texts("<svg><style>no</style><style>x<text>t</svg><p>b") == ["xt", "b"]
    for name in ("svg", "math", "object", "template", "noscript", "select"):
        assert texts(f"<p>a <{name}><i>b</i></{name}> c</p><p>d") == ["a b c", "d"]
        assert texts(f"<p>a<{name}>b</p><p>d")[-1] == "d"
    for name in H.RAW:
        assert texts(f"<p>a<{name}><i>b</i></{name.upper()} >c</p><p>d<{name}>e<p>f") == ["ac", "d"]
    assert texts("<p>a<!--><p>b<!-- no --><p>c") == ["a", "b", "c"]


def test_stray_quotes():
    assert texts("<a href=\"x\"\">b</a><p>c<div title=don't>d</div><p>e<i a='f'>g</i> it's") == ["b", "c", "d", "eg it's"]
    assert texts("<p \">a<p '>b<p a=\"x>y\" b = '>'>c<p a=\"d>e") == ["a", "b", "c", "e"]
    assert texts("<p>a<iframe src=x/>no</iframe>b") == ["ab"]


def at(name):
    return H._slot(name, H.PATH_DIM)


def test_paths_of_any_depth():
    deep = "<div class=d>" * 230 + "<article>x</article>" + "</div>" * 29 + "<p>y</p>" + "</div>" * 201 + "<p>z"
    found = H.blocks(deep)
    assert [(b.text, b.depth, b.leaf) for b in found] == [("x", 231, "article"), ("y", 202, "p"), ("z", 1, "p")]
    assert set(found[0].path) == {at("div"), at(".d"), at("article")} and found[2].path == (at("p"),)
    # unclosed elements hide no outer one, end tags at any depth close their own, and nothing else is closed
    found = H.blocks("<b>" * 1000 + "<article>x</article>y" + "</b>" * 1000 + "<p>z")
    assert [(b.text, at("article") in b.path, at("b") in b.path) for b in found] == [("x", True, True), ("y", False, False), ("z", False, False)]
    found = H.blocks("<em>" + "<b>" * 20 + "q</em>r<p>s")
    assert [(b.text, at("em") in b.path, at("b") in b.path) for b in found] == [("qr", False, False), ("s", False, False)]


def test_more_hard_pages_take_linear_time():
    for x in ("<svg><style>" * 50_000, "<svg>" * 50_000 + "<p>" * 50_000, "<i a=\"'" * 50_000, "<span>" * 100_000 + "</a>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<iframe/>" * 100_000, "<a =\">\"" * 50_000):
        H.blocks(x)


def test_held_out_pages():
    assert H.held_out_accuracy() > 0.99


def test_gradient():
    rng = random.Random(1)
    b, y = H.labelled(H.training_page(rng))
    net = H.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = H.padded([H.vectors(b)])
    g = net.gradient(x, y[None, :], mask)

    def loss():
        z = net.logits(x, mask)
        return float((np.logaddexp(0, z) - y * z).sum() / mask.sum())

    for k in ("of"[0], "hf", "cb", "q"):
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        held = net.p[k][at]
        net.p[k][at] = held + 1e-2
        up = loss()
        net.p[k][at] = held - 1e-2
        down = loss()
        net.p[k][at] = held
        assert abs((up - down) / 2e-2 - g[k][at]) < 0.02 * abs(g[k][at]) + 1e-4, k


def test_query_rows(spark):
    pages = [
        (1, "u", "<nav><a href=/>Home</a><a href=/x>About us</a></nav><article><h1>Title here</h1><p>One &lt;b&gt;.</p><p>Two\n words.</p></article><footer>&copy; me</footer>"),
        (2, None, None),
        (3, "v", ""),
        (3, "v", "<script>x</script>"),
    ]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()), key=str)
    assert got == [(1, "Title here\n\nOne <b>.\n\nTwo words.", 32), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert H.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """On the given pages the labeller finds just what stands inside <article>."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    found = [H.blocks(p["html"]) for p in pages]
    for b, keep in zip(found, H.label(H.trained(), found), strict=True):
        assert keep.tolist() == [at("article") in x.path for x in b]


class Plain(html.parser.HTMLParser):
    """The letters of a page that are text, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.raw = [], None

    def handle_starttag(self, tag, attrs):
        self.raw = tag if tag in H.RAW else self.raw

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        self.raw = None if tag == self.raw else self.raw

    def handle_data(self, data):
        if self.raw is None:
            self.text.append(data)


def test_random_markup_keeps_all_letters():
    rng = random.Random(4)
    tags = "p div b i a span article li ul td table tr h1 section main svg math object noscript select option em form label".split()
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 60)):
            t = rng.choice(tags)
            attribute = rng.choice(["", "", " class=x", ' class="a b"', " title='it>s'", ' x="&quot;" y', ' a="b"c', " hidden", " href=/x?y=1&z=2"])
            parts.append(rng.choice([f"<{t}{attribute}>", f"</{t}>", f"<{t.upper()}{attribute}>", "word ", "x &amp; y ", "caf\u00e9 &eacute; ", "&#65;", "<br>", "<img src=x>", "<!-- c -->", "<script>var a='<p>no</p>';</script>", "<style>p{}</style>", "5 < 6 ", "\n"]))
        page = "".join(parts)
        plain = Plain()
        plain.feed(page)
        plain.close()
        want = "".join("".join(plain.text).split())
        assert "".join("".join(b.text for b in H.blocks(page)).split()) == want, page


def test_pages_of_another_make():
    """Blocks of pages that the training generator does not make, with classes that say nothing."""
    from .other_pages import pages

    made = pages(200, 2024)
    found = [H.blocks(p[0]) for p in made]
    hit = wrong = lost = 0
    for (_, main, _), bs, keep in zip(made, found, H.label(H.trained(), found), strict=True):
        got = {b.text for b, k in zip(bs, keep, strict=True) if k}
        hit, wrong, lost = hit + len(got & set(main)), wrong + len(got - set(main)), lost + len(set(main) - got)
    assert 2 * hit / (2 * hit + wrong + lost) >= 0.95


def test_articles_without_an_article_tag():
    recipe = '<div class="c1"><div class="x"><h1>Apple cake</h1><div>Mix the flour with the butter until it looks like crumbs.</div><ol><li>Heat the oven to a hundred and eighty degrees.</li><li>Bake for forty minutes, until it is brown.</li></ol></div></div>'
    wiki = "<h1>River Lune</h1><p>The river rises in the northern hills and flows for about two hundred kilometres to the sea.</p><table><tr><th>Length</th><td>213 km</td></tr><tr><th>Source</th><td>Hill Top</td></tr></table><pre>for r in rows: print(r)</pre><p>In the spring of that year the council decided to rebuild the bridge in stone.</p>"
    around = '<ul class="q"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>', "<div>© 2024 The Company</div>"
    for body in (recipe, wiki):
        page = H.blocks(f"<html><body>{around[0]}{body}{around[1]}</body></html>")
        keep = H.label(H.trained(), [page])[0]
        inner = {b.text for b in H.blocks(body)}
        assert [b.text for b, k in zip(page, keep, strict=True) if k != (b.text in inner)] == []


def test_pieces_of_a_long_page_are_as_one(monkeypatch):
    rng = random.Random(9)
    pages = [H.blocks(H.training_page(rng)) for _ in range(12)]
    net = H.trained()
    want = H.label(net, pages)
    monkeypatch.setattr(H, "BLOCKS", 5)
    got = H.label(net, pages)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))


def test_a_long_page_among_short_ones_takes_little_memory():
    code = """
import resource
from harrow.llm import html_text as h
page = "<table>" + "".join(f"<tr><td>{i} x" for i in range(120_000)) + "</table>"
found = [h.blocks(page)] + [h.blocks("<p>a b</p>" * 5) for _ in range(63)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
h.label(h.Network(), found)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) < 300
