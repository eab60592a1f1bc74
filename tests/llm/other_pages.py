"""Pages of other makes than the training generator's: fixed layouts with words of real texts and neutral classes.

Each gives (html, blocks of the main text, blocks of the rest)."""

import random

TEXTS = """Mix the flour with a pinch of salt and rub in the cold butter until it looks like crumbs.
The river rises in the northern hills and flows for about two hundred kilometres to the sea.
Call the function once for every record, and close the handle when the last one has been read.
In the spring of that year the council decided to rebuild the bridge in stone.
Readers who know the earlier edition will find that most chapters have been written again.
A moving average smooths the series, but it also delays every turn by half its window.
Heat the oven to a hundred and eighty degrees and grease a round tin.
She left the station at nine, walked along the canal and reached the old mill before noon.
The committee found no evidence that the two events were connected in any way.
Water boils at a lower temperature on a mountain because the pressure is lower there.""".split("\n")
SHORT = "Ingredients|Method|History|Usage|Geography|Return value|Early life|Notes on the text|Examples|Results".split("|")
LINKS = "Home|News|About us|Contact|Shop|Archive|Sign in|Help|Careers|Imprint|Weather|Sports".split("|")
NOTICES = ["We use cookies to improve this site.", "Join our list and get a weekly mail.", "Allow messages from this page?"]


def page(rng):
    cls = lambda: f' class="{rng.choice(["x", "c1", "r2", "_3kq", "sc-ab", "g", "u-1", "el"])}"' if rng.random() < 0.7 else ""
    used, main, rest = set(), [], []

    def keep(text, where):
        while text in used:
            text += f" {rng.randint(2, 999)}"
        used.add(text)
        where.append(text)
        return text

    text, short = lambda: keep(" ".join(rng.sample(TEXTS, rng.randint(1, 3))), main), lambda: keep(rng.choice(SHORT), main)

    def links():
        items = [keep(x, rest) for x in rng.sample(LINKS, rng.randint(3, 7))]
        return f"<div{cls()}><ul>" + "".join(f'<li{cls()}><a href="/{i}">{x}</a></li>' for i, x in enumerate(items)) + "</ul></div>"

    bodies = {
        "recipe": lambda: f"<div{cls()}>{text()}</div><h2>{short()}</h2><ul>" + "".join(f"<li>{keep(f'{rng.randint(1, 900)} g of {w}', main)}</li>" for w in rng.sample(["flour", "butter", "sugar", "salt", "milk"], 4)) + f"</ul><h2>{short()}</h2><ol>" + "".join(f"<li>{text()}</li>" for _ in range(4)) + "</ol>",
        "encyclopedia": lambda: f"<p>{text()}</p><table{cls()}>" + "".join(f"<tr><th>{keep(w, main)}</th><td>{keep(f'{rng.randint(10, 9999)} {u}', main)}</td></tr>" for w, u in (("Length", "km"), ("Area", "km2"), ("Source", "m"))) + "</table>" + "".join(f"<h2>{short()}</h2><p>{text()}</p>" for _ in range(3)),
        "reference": lambda: f"<p>{text()}</p><pre>{keep('for r in rows: print(r)', main)}</pre><dl>" + "".join(f"<dt>{keep(w, main)}</dt><dd>{text()}</dd>" for w in ("rows", "handle", "limit")) + f"</dl><p>{text()}</p>",
        "divs": lambda: "".join(f"<div{cls()}><div>{text()}</div></div>" for _ in range(5)),
        "essay": lambda: "".join(f"<p>{text()}</p>" for _ in range(5)) + f"<blockquote><p>{text()}</p></blockquote><p>{text()}</p>",
    }
    nav = links()
    title = keep(f"{rng.choice(SHORT)} of the {rng.choice(['river', 'bread', 'bridge', 'series'])}", main)
    body = bodies[rng.choice([*bodies])]()
    foot = keep(f"© {rng.randint(2001, 2024)} The Company", rest)
    notice = f"<div{cls()}><p>{keep(rng.choice(NOTICES), rest)}</p><button>{keep('OK', rest)}</button></div>" if rng.random() < 0.4 else ""
    story = f"<h1>{title}</h1>{body}"
    for _ in range(rng.randint(1, 3)):
        story = f"<div{cls()}>{story}</div>"
    return f"<html><body>{nav}{notice}{story}<div{cls()}>{foot}</div></body></html>", main, rest


def pages(n, seed):
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
