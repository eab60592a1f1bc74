"""Personal data: rule spans, and a semi-Markov conditional random field that adds to them.

The rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The field reads the
words around anything with digits, @, = or spelled-out addresses. Its segments are up to MOST_WORDS
words long; a segment's features describe it whole (shape, digits, checksums, ends, the word before),
and dynamic programming over segments chooses boundaries and kinds together. Some features forbid a kind: a
segment that fails the checksum or the bounds of a card is none, whatever the words around it say. Rule
spans stay; of the field's segments those are added that touch none of them. It knows one kind more: secret.

The field is trained when first needed, on sentences that a seeded generator makes (TRAIN_SENTENCES
of them), in a few seconds on the driver; its few hundred weights go to the workers.

Defined results: null and empty texts have no spans; repeated rows are searched each; a word over
LONG characters is judged whole, but joins no segment of several words; an empty table gives no
rows. Other columns stay; `spans` and `base` replace columns of that name.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["other", *KINDS]
MOST_WORDS, LONG = 6, 80
TRAIN_SENTENCES, EPOCHS, SEED = 500, 4, 11

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+): a match can only begin where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Words for the marks of an address, and what the field may begin at.
_AT, _DOT = "at|ät|arroba|chez", "dot|punkt|punto|point"
_TRIGGER = re.compile(rf"[0-9@=]|\b(?:{_DOT})\b", re.I)
_SAID_AT = re.compile(rf"(?:^|[ \[(])(?:{_AT})[\])]? ")
_SAID_DOT = re.compile(rf" [\[(]?(?:{_DOT})[\])]? ")
_SAID_WHOLE = re.compile(rf"[\w.-]+ [\[(]?(?:{_AT})[\])]? [\w-]+(?: [\[(]?(?:{_DOT})[\])]? [a-z]{{2,12}})+")
#: English, as in `at this point in time`, unless an address ends so.
_AT_THIS_POINT = re.compile(r"(?:^| )at [\w-]+ point (?!(?:com|net|org|info|edu|fr|ch|eu|lu)$)")
#: How a said address ends, and what is no host before that: `at the dot at noon` is none.
_SAID_END = re.compile(rf"(?:{_AT})[\])]? (?!(?:the|a|an|this|that|his|her|its|our|your|my|one|some|any) )[\w-]+(?: [\[(]?(?:{_DOT})[\])]? [\w-]+)* [\[(]?(?:{_DOT})[\])]? (?:com|net|org|edu|gov|info|biz|test|example|io|dev|app|eu|de|fr|es|uk|ch|nl|pl|ca|au|jp|cn|br|mx|se|dk|fi|lu|us|ru)$")
_PHONE_FORM = re.compile(r"[+(0]|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}$")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX = re.compile(r"(?:0x)?(?:[0-9a-f]+|[0-9A-F]+)")
_KEY = re.compile("pass|pwd|token|secret|key|api")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]+")
#: A signed web token names what it is, as an assignment does.
_SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}")
_WORD = re.compile(core.WORD)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the letters before it, as far as the match before, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the rules, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- the field

_HINTS = {"mail": "mail", "email": "mail", "tel": "tel", "phone": "tel", "call": "tel", "telefon": "tel", "mobil": "tel", "card": "card", "visa": "card", "password": "key", "token": "key", "key": "key", "secret": "key", "ip": "ip", "host": "ip", "version": "version", "seite": "page", "page": "page", "license,": "version", "isbn": "code", "serial": "code", "order": "code", "iban": "code", "invoice": "code", "id": "code", "ref": "code", "sku": "code", "sha": "hash", "md5": "hash", "sha256": "hash", "commit": "hash", "checksum": "hash"}


def trim(word: str) -> tuple[int, int]:
    """Where a word begins and ends without the punctuation of its sentence."""
    a, b = 0, len(word)
    while a < b and word[a] in "\"'«»<[{,;:!?":
        a += 1
    while b > a and word[b - 1] in "\"'«»>]},;:!?.":
        b -= 1
    return a, b


def describe(words: list[str], i: int, j: int) -> list[str]:
    """Features of the segment words[i:j] as a whole."""
    text = " ".join(words[i:j])
    a, b = trim(text)
    text = text[a:b]
    digits = _NOT_DIGIT.sub("", text)
    letters = sum(c.isalpha() for c in text)
    n, d = len(text), len(digits)
    low = text.lower()
    told = i - 2 if i > 1 and words[i - 1] in ("=", ":", "=>") else i - 1
    before = _HINTS.get(words[told].lower().strip(":.,"), "-") if i else "^"
    shape = "d" if d == n and n else "p" if letters == 0 else "l" if d == 0 else "m"
    out = [f"words{j - i}", f"shape{shape}", f"shape{shape}words{j - i}", f"before-{before}", f"before-{before}{shape}", f"digits{min(d, 20) if shape != 'l' else 'x'}", f"length{min(n // 4, 12)}"]
    if shape in "dp":
        out.append("phone-like" if 9 <= d <= 15 and re.fullmatch(r"\+?[0-9 ().-]+", text) and re.search(r"[ ().-]", text) else "not-phone")
        if 12 <= d <= 19 and re.fullmatch(r"[0-9]++(?:[ .-]?[0-9]++)*+", text):
            out.append("luhn" if luhn(digits) else "no-luhn")
            out.append(f"card-length{d}")
        if text.startswith("(") or "(" in text:
            out.append("bracket" if text.count("(") == text.count(")") else "half-bracket")
        parts = re.split(r"[.,:]", text)
        if len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) < 256 for p in parts):
            out.append("four-bytes")
        if text.startswith("+"):
            out.append("plus")
    if "@" in text:
        out.append("at-sign")
    if j - i > 2 and _SAID_AT.search(low) and _SAID_DOT.search(low) and not _AT_THIS_POINT.search(low):
        out.append("spelled-address")
        if _SAID_WHOLE.fullmatch(low):
            out.append("whole-address")
    if j - i == 1:
        if "=" in text:
            key, _, value = low.partition("=")
            out.append("assigned" if re.fullmatch(r"\w+", key) and _KEY.search(key) and len(value) >= 6 else "equals")
        if _SIGNED.fullmatch(text):
            out.append("assigned")
        if n >= 16 and d and letters and _TOKEN.fullmatch(text):
            classes = sum(map(bool, (re.search("[A-Z]", text), re.search("[a-z]", text), d)))
            out.append(f"random{classes}")
            if re.fullmatch(r"[A-Z0-9]{16,}", text):
                out.append("upper-key")
            if re.fullmatch(r"[0-9a-f]{16,}", text):
                out.append("hex-key")
        if re.match(r"https?:|www\.", low):
            out.append("link")
    out += [f"no-{k}" for k in forbidden(text, low, digits, before, out)]
    if i and words[i - 1][-1].isdigit() and text[:1] not in ("+", "(") and "no-phone" not in out:
        out.append("no-phone")  # the rest of a longer number
    if words[i] != words[i].lstrip("\"'«»<[{,;:!?") or (j - i > 1 and any(w[-1] in ",;:!?" for w in words[i : j - 1])):
        out.append("crosses-mark")
    return out


def forbidden(text: str, low: str, digits: str, before: str, out: list[str]) -> Iterator[str]:
    """Kinds that a segment cannot be, by what it is as a whole."""
    d = len(digits)
    if "@" not in text and not ("whole-address" in out and _SAID_END.search(low)):
        yield "email"
    if "four-bytes" not in out:
        yield "ip"
    if "luhn" not in out:
        yield "card"
    if "phone-like" not in out or not (before == "tel" or _PHONE_FORM.match(text)):
        yield "phone"
    if " " in text or len(text) < 6 or re.match(r"https?:|www\.", low) or not ("assigned" in out or before == "key") and (_HEX.fullmatch(text) or _UUID.fullmatch(text) or d == len(text)):
        yield "secret"


class Field:
    """Weights of (feature, label) and of (label, label)."""

    def __init__(self):
        self.at: dict[str, int] = {f"no-{k}": i for i, k in enumerate(KINDS)}
        self.w = np.zeros((64, len(LABELS)))
        for i in range(len(KINDS)):
            self.w[i, i + 1] = -np.inf
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def ending(self, words: list[str], j: int, grow: bool) -> list[tuple[int, list[int]]]:
        """The segments (start, features) that end at j."""
        here = []
        for i in range(j - 1, max(-1, j - 1 - MOST_WORDS), -1):
            if len(words[i]) > LONG and j - i > 1:
                break
            names = describe(words, i, j)
            if grow:
                for f in names:
                    self.at.setdefault(f, len(self.at))
            here.append((i, [self.at[f] for f in names if f in self.at]))
            if len(words[i]) > LONG:
                break
        return here

    def segments(self, words: list[str]) -> list[list[tuple[int, list[int]]]]:
        """For each end, the segments that end there; new features get weights."""
        out = [self.ending(words, j, True) for j in range(1, len(words) + 1)]
        while len(self.w) < len(self.at):
            self.w = np.vstack([self.w, np.zeros_like(self.w)])
        return out

    def scores(self, j: int, here: list[tuple[int, list[int]]]) -> list[tuple[int, list[int], np.ndarray]]:
        row = []
        for i, f in here:
            s = self.w[f].sum(0)
            if j - i > 1:
                s = s.copy()
                s[0] = -np.inf  # what is no entity goes word by word
            row.append((i, f, s))
        return row

    def learn(self, words: list[str], gold: list[tuple[int, int, int]], rate: float) -> None:
        """A step up the log likelihood of the gold segmentation (start, end, label)."""
        scored = [self.scores(j, here) for j, here in enumerate(self.segments(words), 1)]
        n, k = len(words), len(LABELS)
        alpha = np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0
        for j in range(1, n + 1):
            ways = [np.logaddexp.reduce(alpha[i][:, None] + self.t, axis=0) + s for i, _, s in scored[j - 1]]
            alpha[j] = np.logaddexp.reduce(ways, axis=0)
        beta = np.full((n + 1, k), -np.inf)
        beta[n] = 0
        for j in range(n, 0, -1):
            for i, _, s in scored[j - 1]:
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.t + (s + beta[j])[None, :], axis=1))
        z = np.logaddexp.reduce(alpha[n])
        w, t = [], np.zeros_like(self.t)
        for j in range(1, n + 1):
            for i, f, s in scored[j - 1]:
                p = np.exp(alpha[i][:, None] + self.t + (s + beta[j])[None, :] - z)
                t -= p
                w.append((f, -p.sum(0)))
        last = 0
        marked = {(i, j): y for i, j, y in gold}
        for j in range(1, n + 1):
            for i, f, _ in scored[j - 1]:
                y = marked.get((i, j), -1)
                if y >= 0:
                    step = np.zeros(k)
                    step[y] = 1
                    w.append((f, step))
        for _, _, y in sorted(gold):
            t[last, y] += 1
            last = y
        for f, g in w:
            np.add.at(self.w, f, rate * g)
        self.t += rate * t

    def decode(self, words: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (start, end, label). Of a word, three numbers a label are
        kept, and of its segments nothing, so that a run may be as long as its text."""
        n, k = len(words), len(LABELS)
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        size, before = np.zeros((n + 1, k), np.uint8), np.zeros((n + 1, k), np.uint8)
        for j in range(1, n + 1):
            for i, _, s in self.scores(j, self.ending(words, j, False)):
                ways = best[i][:, None] + self.t
                frm = ways.argmax(0)
                value = ways[frm, np.arange(k)] + s
                for y in np.flatnonzero(value > best[j]):
                    best[j, y], size[j, y], before[j, y] = value[y], j - i, frm[y]
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i = j - int(size[j, y])
            if y:
                out.append((i, j, y))
            j, y = i, int(before[j, y])
        return out[::-1]


def sentence(rng: random.Random) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Filler words with entities at known places, and look-alikes that are none."""
    name = lambda a=3, b=9: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(rng.randint(n // 2, 2 * n)))

    def card() -> str:
        body = rng.choice("3456") + num(rng.choice([13, 14, 14, 14]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def spaced(x: str) -> str:
        s = rng.choice(["", " ", "-"])
        return s.join(x[i : i + 4] for i in range(0, len(x), 4))

    made = {
        1: lambda: rng.choice([f"{name()}.{num(2)}@{name()}.example.com", f"{name()}@{name()}.org", f"{name()} at {name()} dot com", f"{name()} (at) {name()} (dot) org", f"{name()} [at] {name()} [dot] net"]),
        2: lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        3: lambda: spaced(card()),
        4: lambda: rng.choice([f"+1 ({num(3)}) 555-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+49 {num(3)} {num(7)}", f"0{num(2)} {num(3)} {num(2)} {num(2)}"]),
        5: lambda: rng.choice([f'{rng.choice(["token", "secret", "key"])} = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), f"password={''.join(rng.choice('0123456789abcdef') for _ in range(18))}", f"api_key={name(8, 12)}{num(6)}", f"eyJ{mixed(30)}.eyJ{mixed(40)}.{mixed(12)}", f"token={num(4)}{name(8, 10)}"]),
    }
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def no_card() -> str:
        body = rng.choice("123456789") + num(rng.choice([10, 11, 14, 14, 17]))
        return spaced(next(body + c for c in rng.sample("0123456789", 10) if not luhn(body + c)))

    alike = [  # what a careless reader would take for one
        no_card,
        lambda: f"ISBN 97{rng.choice('89')}-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
        lambda: f"serial {num(4)}-{num(4)}-{num(4)}",
        lambda: f"IBAN DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}",
        lambda: f"{rng.choice(['sha', 'md5', 'commit', 'checksum'])} {hexa(rng.choice([32, 40, 64]))}",
        lambda: "-".join(hexa(n) for n in (8, 4, 4, 4, 12)),
        lambda: f"order {num(rng.choice([9, 10, 12]))}",
        lambda: f"#{num(9)}",
        lambda: f"{name()} at the dot at {name()}",
        lambda: f"{name()} at {name()} dot {name()} the",
        lambda: f"20{num(2)}-0{rng.randint(1, 9)}-{num(2)} {num(2)}:{num(2)}:{num(2)}",
        lambda: f"{num(2)}.{num(6)}, {num(2)}.{num(6)}",
        lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}" if rng.random() < 0.3 else f"{num(1)},{num(3)},{num(3)},{num(3)}",
    ]
    plain = [lambda: num(rng.randint(1, 4)), lambda: f"{num(1)}.{num(1)}", lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.20{num(2)}", lambda: f"20{num(2)}-0{rng.randint(1, 9)}-{num(2)}", lambda: f"{num(2)},{num(3)}", lambda: f"${num(2)}.{num(2)}", lambda: "version 2.0", lambda: f"x={num(1)}", lambda: f"{num(rng.choice([5, 6, 8]))}", lambda: f"{num(2)}%", lambda: f"{num(2)}:{num(2)}", lambda: "CC BY-NC 4.0", lambda: "dot", lambda: f"{name()} at", lambda: f"{num(1)}-{num(1)}"]
    hints = {1: ["mail", "email:"], 2: ["host", "ip"], 3: ["card", "visa:"], 4: ["tel", "phone:", "call"], 5: ["key", "secret"]}
    words: list[str] = []
    gold = []
    for _ in range(rng.randint(3, 12)):
        roll = rng.random()
        if roll < 0.25:
            y = rng.randint(1, 5)
            if rng.random() < 0.3:
                gold.append((len(words), len(words) + 1, 0))
                words.append(rng.choice(hints[y]))
            new = (made[y]() + rng.choice(["", "", ",", "."])).split()
            while len(new) > 2 and new[1] == "=":  # what is assigned is the secret, not its name
                gold += [(len(words) + i, len(words) + i + 1, 0) for i in range(2)]
                words += new[:2]
                new = new[2:]
            gold.append((len(words), len(words) + len(new), y))
            words += new
        else:
            for w in (rng.choice(alike)().split() if roll < 0.35 else rng.choice(plain)().split() if roll < 0.5 else [name() + rng.choice(["", "", "", ",", "."])]):
                gold.append((len(words), len(words) + 1, 0))
                words.append(w)
    return words, gold


@functools.lru_cache(1)
def trained(sentences: int = TRAIN_SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    rng = random.Random(seed)
    data = [sentence(rng) for _ in range(sentences)]
    field = Field()
    for e in range(epochs):
        for words, gold in data:
            field.learn(words, gold, 0.15 / (1 + e))
    return field


def field_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the field adds: in runs of words near a trigger, between rule spans."""
    if not _TRIGGER.search(text):
        return []
    found = list(_WORD.finditer(text))
    starts = np.array([m.start() for m in found])
    hot = np.zeros(len(found), bool)
    for m in _TRIGGER.finditer(text):
        at = int(np.searchsorted(starts, m.start(), "right")) - 1
        hot[max(0, at - 4 if len(m[0]) > 1 else at - 1) : at + 3] = True
    for s, _, e in base:
        hot[max(0, int(np.searchsorted(starts, s, "right")) - 1) : int(np.searchsorted(starts, e, "left"))] = False
    out = []
    first, last = core.runs(hot)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if not hot[a]:
            continue
        words = [m[0] for m in found[a:b]]
        if not any(_TRIGGER.search(w) for w in words):
            continue
        for i, j, y in field.decode(words):
            x, _ = trim(words[i])
            _, z = trim(words[j - 1])
            s, e = found[a + i].start() + x, found[a + j - 1].start() + z
            if s < e:
                out.append((s, y - 1, e))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, text: str = "text", masked: str | None = None) -> DataFrame:
    """docs with base and spans: array<struct<kind, start, end>> in code points, end exclusive;
    masked: also that column, the text with every span replaced by its kind in brackets."""
    spark = docs.sparkSession
    core.small_batches(spark)
    cast = spark.sparkContext.broadcast(trained())
    docs = docs.drop("base", "spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [f for f in docs.schema.fields if f.name != masked] + [T.StructField(c, listed) for c in ("base", "spans")] + ([T.StructField(masked, T.StringType())] if masked else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = cast.value
        for b in batches:
            base, all_, hidden = [], [], []
            for t in b.column(b.schema.get_field_index(text)):
                t = t.as_py()
                x = base_spans(t or "")
                y = sorted(x + field_spans(t, x, field)) if t else x
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x])
                all_.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in y])
                if masked:
                    hidden.append(mask(t, y))
            keep = [b.column(i) for i, n in enumerate(b.schema.names) if n != masked]
            more = [pa.array(base, kind), pa.array(all_, kind)] + [pa.array(hidden, pa.string())] * bool(masked)
            yield pa.RecordBatch.from_arrays([*keep, *more], [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with its spans, merged where they overlap, replaced by the first one's kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the rule spans, their digest, and all spans spelled out."""
    out = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(F.encode(spelled("base"), "UTF-8"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def held_out_f1(n: int = 300, seed: int = 99) -> float:
    """F1 of whole segments with kinds on sentences that training did not see."""
    rng, field = random.Random(seed), trained()
    hit = made = real = 0
    for _ in range(n):
        words, gold = sentence(rng)
        want = {g for g in gold if g[2]}
        got = set(field.decode(words))
        hit, made, real = hit + len(want & got), made + len(got), real + len(want)
    return 2 * hit / max(1, made + real)
