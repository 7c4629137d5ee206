"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers; their matches always stay.  A semi-Markov CRF adds what they miss
(``name at host dot org``, ``(212) 555-0100``, an IPv6 address, a card written
with dots): features of a *whole span* score each candidate segment, and a
dynamic program over segments of bounded length chooses boundaries and types
jointly.  Segments outside any entity are single tokens of score 0.  Candidates have
a shape (see :func:`_segments`): runs of digits, blanks and the signs of numbers with
7 to 24 digits, runs of hexadecimal digits and colons with 2 to 8 colons, and a name,
an at sign or word, and a domain.  Only the stretches where a candidate fits are
decoded, which gives what decoding all of the text between the base spans gives.

The weights are fitted here, by gradient ascent on the CRF's likelihood over
generated sentences (see :func:`training_set`); nothing is read from the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a start within a digit run fails or succeeds as its beginning does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by kind, then start; each kind leftmost and without overlaps, in linear time."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


# -------------------------------------------------------- semi-Markov field

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
MAX_TOKENS = 40
MAX_DIGITS, MAX_COLONS = 24, 8
MIN_DIGITS, MIN_COLONS = 7, 2
#: Signs and blanks inside phone and card numbers, beside digits.
_SIGNS = "().-_/+\u2010\u2011\u2012\u2013\u2014"
_BLANKS = " \t\u00a0"
_NUMBER = re.compile(rf"[0-9(+][0-9{re.escape(_SIGNS + _BLANKS)}]*+")
_COLONS = re.compile(r":[0-9A-Fa-f]*+:[0-9A-Fa-f:]*+")
_HEX = frozenset("0123456789ABCDEFabcdef")
#: Spelled-out addresses are found by their ``at``; the name before it is looked up backwards.
_AT = re.compile(r"[\(\[\{]\s*+(?:at|AT)\s*+[\)\]\}]|\s(?:at|AT)(?=\s)|@")
_LABELS = r"[A-Za-z0-9-]++(?:(?:\s*+[\(\[\{]\s*+(?:dot|DOT)\s*+[\)\]\}]\s*+|\s++(?:dot|DOT)\s++|\s*+\.\s*+)[A-Za-z0-9-]++)++"
_SPELLED = re.compile(r"\s*+" + _LABELS)
_MAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:\s*+[\(\[\{]\s*+(?:at|AT)\s*+[\)\]\}]\s*+|\s++(?:at|AT)\s++|\s*+@\s*+)" + _LABELS)
_CUE = {
    "email": frozenset("email mail contact write courriel correo".split()),
    "ip": frozenset("ip address host server addr client".split()),
    "card": frozenset("card visa mastercard credit payment carte tarjeta karte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell ring telefon telefono".split()),
}
_TLD = frozenset("com org net edu gov io de fr es uk eu info co".split())


def segment_features(kind: str, span: str, before: str, after: str) -> list[str]:
    """Names of the features of a whole candidate span; ``before`` and ``after`` are its surroundings."""
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    low = span.lower()
    words = re.findall(r"[a-z]+", low)
    f = [f"{kind}|bias"]
    cues = re.findall(r"[a-z]+", before.lower())[-4:]
    if _CUE[kind].intersection(cues):
        f.append(f"{kind}|cue")
    if before[-1:].isalnum() or after[:1].isalnum():
        f.append(f"{kind}|inside a word")
    if re.match(r"[-./:]?[0-9]", after) or re.search(r"[0-9][-./:]?\Z", before):
        f.append(f"{kind}|more digits beside")
    if kind == "email":
        f += [f"email|at:{'bracket' if re.search(r'[(\[{] *at *[)\]}]', low) else 'word' if ' at ' in low else 'sign' if '@' in low else 'none'}"]
        f += [f"email|dot:{'spelled' if re.search(r' dot |[(\[{] *dot *[)\]}]', low) else 'sign' if '.' in low else 'none'}"]
        f.append("email|known end" if words and words[-1] in _TLD and low.endswith(words[-1]) else "email|other end")
        if re.match(r"\s*[(\[{]?\s*(?:dot|DOT)\b|\.[A-Za-z0-9]", after):
            f.append("email|goes on")
    elif kind == "phone":
        f.append(f"phone|digits:{'few' if digits < 9 else 'many' if digits > 15 else 'fit'}")
        f.append("phone|area code in brackets" if re.match(r"\(\d{2,4}\)", span) else "phone|no brackets")
        known = groups[-3:] == [3, 3, 4] and len(groups) <= 4
        f.append("phone|3-3-4" if known else f"phone|{'one group' if len(groups) == 1 else 'groups'}")
        if known and len(groups) == 4 and span[0] != "+":
            f.append("phone|leading 1" if groups[0] == 1 and span[0] == "1" else "phone|leading digits")
        elif not known and min(groups) < 2:
            f.append("phone|single digits")
        if len(groups) == 1 and digits == 10 and _CUE[kind].intersection(cues):
            f.append("phone|ten digits after a cue")
        if re.search(r"[0-9][ \t\xa0]+\Z", before) or re.match(r"[ \t\xa0]+[0-9]", after):
            f.append("phone|digits a space away")
        if re.search(r"[0-9(]\s*[-._\u2010-\u2014]\s*\Z", before) or re.match(r"\s*[-._\u2010-\u2014]\s*[0-9]", after):
            f.append("phone|goes on")
        f.append(f"phone|plus:{span.count('+')}:{span[0] == '+'}")
        if before.endswith("+") or re.search(r"\+[0-9]{1,3}[ .-]?\Z", before):
            f.append("phone|country code left out")
        if re.search(r"[/_]", span):
            f.append("phone|foreign signs")
    elif kind == "card":
        f.append("card|length fits" if 13 <= digits <= 19 else "card|length")
        f.append("card|luhn" if digits and luhn("".join(c for c in span if c.isdigit())) else "card|no luhn")
        f.append("card|fours" if groups[:3] == [4, 4, 4] else "card|one group" if len(groups) == 1 else "card|groups")
        if re.search(r"[0-9]{4} \Z", before) or re.match(r" [0-9]{4}", after):
            f.append(f"card|digits a space away:{'one group' if len(groups) == 1 else 'groups'}")
        if re.search(r"[()/+]", span):
            f.append("card|foreign signs")
    else:
        parts = re.split(r":", span)
        hexes = span.count(":") >= 2 and all(re.fullmatch(r"[0-9A-Fa-f]{0,4}", p) for p in parts)
        f.append("ip|hex groups" if hexes else "ip|no hex groups")
        f.append("ip|whole" if hexes and (len(parts) == 8 and "::" not in span or span.count("::") == 1 and any(parts)) else "ip|not whole")
        if len(parts) <= 3 and "::" not in span or not re.search(r"[0-9A-Fa-f]", span):
            f.append("ip|like a time")
    return f


def _segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, str, list[str]]]]]:
    """Tokens of ``text[lo:hi]`` and, by end token, the candidates ``(first token, kind, features)``.

    Candidates have at most ``MAX_TOKENS`` tokens and at least 4 characters.  Cards and phones are digits, ``_SIGNS`` and
    blanks, from a digit, ``(`` or ``+`` to a digit, with ``MIN_DIGITS`` to ``MAX_DIGITS`` digits; IP addresses are hexadecimal digits
    and colons without gaps, with ``MIN_COLONS`` to ``MAX_COLONS`` colons; addresses match ``_MAIL``.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    words = [text[s:e] for s, e in tokens]
    number = [w[0] in "0123456789" for w in words]
    part = [n or w in _SIGNS for n, w in zip(number, words, strict=True)]
    hexes = [w == ":" or _HEX.issuperset(w) for w in words]
    ats = [w in ("@", "at", "AT") for w in words]
    gap = [2, *(0 if a[1] == b[0] else 2 if text[a[1] : b[0]].strip(_BLANKS) else 1 for a, b in zip(tokens, tokens[1:], strict=False))]
    next_at, following = [len(tokens)] * len(tokens), len(tokens)
    for k in range(len(tokens) - 1, -1, -1):
        next_at[k] = following
        following = k if ats[k] else following
    found: list[list[tuple[int, str, list[str]]]] = [[] for _ in tokens]
    for i, (s, _) in enumerate(tokens):
        first = words[i][0]
        digital, colonic, mail = number[i] or first in "(+", hexes[i], next_at[i] < i + MAX_TOKENS and first.isalnum() and first.isascii()
        digits = colons = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            digits += len(words[j]) if number[j] else 0
            colons += words[j] == ":"
            digital = digital and part[j] and digits <= MAX_DIGITS and (j == i or gap[j] < 2)
            colonic = colonic and hexes[j] and colons <= MAX_COLONS and (j == i or not gap[j])
            if not (digital or colonic or mail):
                break
            e = tokens[j][1]
            if e - s < 4:
                continue
            kinds = ["phone", "card"] if digital and number[j] and digits >= MIN_DIGITS else []
            if colonic and colons >= MIN_COLONS:
                kinds.append("ip")
            if mail and next_at[i] < j and _MAIL.fullmatch(text, s, e):
                kinds.append("email")
            if kinds:
                span, left, right = text[s:e], text[max(0, s - 40) : s], text[e : e + 8]
                found[j] += [(i, kind, segment_features(kind, span, left, right)) for kind in kinds]
    return tokens, found


def decode(text: str, lo: int, hi: int, weights: dict[str, float]) -> list[Span]:
    """The best segmentation of ``text[lo:hi]``: its entities."""
    tokens, found = _segments(text, lo, hi)
    best, back = [0.0], [None]
    for j in range(len(tokens)):
        top, how = best[j], None
        for i, kind, f in found[j]:
            v = best[i] + sum(weights.get(x, 0.0) for x in f)
            if v > top:
                top, how = v, (i, kind)
        best.append(top)
        back.append(how)
    out, j = [], len(tokens)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
    return out[::-1]


def training_set(n: int = 600, seed: int = 4) -> list[tuple[str, list[Span]]]:
    """Generated sentences with and without personal data, and their entities."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(pick("0123456789") for _ in range(k))

    def card(sep: str) -> str:
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def entity() -> tuple[str | None, str]:
        k = rng.randrange(18)
        if k < 4:
            at, dot = pick([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", "."), ("@", " dot "), (" @ ", ".")])
            domain = dot.join(word() for _ in range(pick([1, 1, 1, 2, 3, 5])))
            return "email", f"{word()}{pick(['', '.' + word(), num(2)])}{at}{domain}{dot}{pick(sorted(_TLD))}"
        if k < 7:
            a, b, c = num(3), num(3), num(4)
            dash = pick(["-", "-", ".", " - ", "  -  ", "\u2013", "\u2011", " "])
            return "phone", pick([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 {a} {b} {c}", f"1 ({a}) {b}-{c}", f"{a}{dash}{b}{dash}{c}"])
        if k < 8:
            return "phone", f"{pick(sorted(_CUE['phone']))}{pick([': ', ' '])}{num(10)}"
        if k < 10:
            return "card", card(pick([".", "_", "  ", "\u2013", " - "]))
        if k < 11:
            return "ip", pick([":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)), f"2001:db8:{rng.randrange(1, 65536):x}::{rng.randrange(1, 65536):x}", f"fe80::{rng.randrange(1, 65536):x}"])
        return None, pick([
            f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"{num(4)}.{num(4)}.{num(4)}.{num(4)}",
            f"{num(2)}.{num(2)}.{num(4)}", f"{word()} at {word()}. {word()}", f"{num(16)}", f"{num(3)}, {num(3)}, {num(4)}", f"{num(5)} {num(5)}", f"{num(2)} {num(2)} {num(2)}", f"at {word()} dot", f"{num(4)} {num(4)} {num(4)} {num(4)} {num(4)}", f"{num(3)}-{num(4)}-{num(3)}-{num(3)}",
            num(10), f"{num(4)} {num(4)}", " ".join(num(rng.randint(1, 3)) for _ in range(rng.randint(4, 12))), f"{num(4)}-{num(4)} {num(4)}-{num(4)}", f"{num(1)}.{num(2)} {num(1)}.{num(2)} {num(2)}.{num(2)} {num(1)}.{num(3)}", f"978-3-{num(2)}-{num(6)}-{num(1)}",
            f"{rng.randint(1900, 2030)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", f"{num(2)}.{num(2)}.{num(4)} {num(2)}.{num(2)}.{num(4)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(1)}_{num(3)}_{num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{word()}@{word()}. {word().title()}", num(8), num(12), "-".join(num(4) for _ in range(3)), f"{num(2)}/{num(2)}/{num(4)}", f"1 {num(4)} {num(4)}",
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.15:  # a phone number that runs into a card: no base pattern finds either
                one, two = f"+1 ({num(3)}) {num(3)}-{num(4)}", card("")
                text += word() + " "
                spans += [("phone", len(text), len(text) + len(one)), ("card", len(text) + len(one) + 1, len(text) + len(one) + 1 + len(two))]
                text += f"{one} {two} "
            text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
            kind, s = entity()
            if kind == "phone" and s[0].isalpha():  # a number that only its cue tells
                text += s[: len(s) - 10]
                s = s[-10:]
            elif kind and rng.random() < 0.4:
                text += pick(sorted(_CUE[kind])) + pick([": ", " "])
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s
            if kind == "phone" and "-" in s and rng.random() < 0.15:  # a list of numbers
                s = f"{num(3)}-{num(3)}-{num(4)}"
                spans.append((kind, len(text) + 1, len(text) + 1 + len(s)))
                text += " " + s
            text += pick([" ", ". ", ", ", "\n"])
        out.append((text + word(), spans))
    return out


@functools.cache
def fitted(epochs: int = 12, rate: float = 0.4) -> dict[str, float]:
    """Weights that maximise the field's likelihood on :func:`training_set`, by stochastic gradient ascent."""
    weights: dict[str, float] = {}
    cases = []
    for text, spans in training_set():
        for lo, hi in regions(text, []):
            tokens, found = _segments(text, lo, hi)
            starts, ends = {t[0]: k for k, t in enumerate(tokens)}, {t[1]: k for k, t in enumerate(tokens)}
            gold = {(starts.get(s), ends.get(e), k) for k, s, e in spans if s >= lo and e <= hi}
            cases.append((len(tokens), found, gold))
    rng = random.Random(1)
    for epoch in range(epochs):
        rng.shuffle(cases)
        step = rate / (1 + 0.3 * epoch)
        for n, found, gold in cases:
            score = [[sum(weights.get(x, 0.0) for x in f) for _, _, f in at] for at in found]
            fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
            for j in range(n):
                fwd[j + 1] = fwd[j]
                for (i, _, _), v in zip(found[j], score[j], strict=True):
                    fwd[j + 1] = add(fwd[j + 1], fwd[i] + v)
            for j in range(n - 1, -1, -1):
                bwd[j] = add(bwd[j], bwd[j + 1])
                for (i, _, _), v in zip(found[j], score[j], strict=True):
                    bwd[i] = add(bwd[i], v + bwd[j + 1])
            for j in range(n):
                for (i, kind, f), v in zip(found[j], score[j], strict=True):
                    p = math.exp(min(0.0, fwd[i] + v + bwd[j + 1] - fwd[n]))
                    g = step * (((i, j, kind) in gold) - p)
                    if abs(g) > 1e-6:
                        for x in f:
                            weights[x] = weights.get(x, 0.0) * (1 - 1e-4) + g
    return weights


def _spelled(text: str) -> list[tuple[int, int]]:
    """Stretches around each ``at`` that has a name before and a domain after it."""
    out: list[tuple[int, int]] = []
    for m in _AT.finditer(text):
        after = _SPELLED.match(text, m.end())
        if not after:
            continue
        start = m.start()
        while start and text[start - 1].isspace():
            start -= 1
        name = start
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < name:
            out.append((start, after.end()))
    return out


def _numbers(text: str) -> list[tuple[int, int]]:
    """Runs of the characters of phone and card numbers with enough digits."""
    return [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= MIN_DIGITS and sum(map(m[0].count, "0123456789")) >= MIN_DIGITS]


def _colons(text: str) -> list[tuple[int, int]]:
    """Runs of hexadecimal digits and colons with enough colons, less words at their ends that go on with other letters."""
    out: list[tuple[int, int]] = []
    for m in _COLONS.finditer(text):
        lo, hi = m.span()
        while lo and text[lo - 1] in _HEX:
            lo -= 1
        if lo and _letter(text[lo - 1]):
            while _letter(text[lo]):
                lo += 1
        if hi < len(text) and _letter(text[hi]):
            while _letter(text[hi - 1]):
                hi -= 1
        out.append((lo, hi))
    return out


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(stretches):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def regions(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Stretches, apart from each other, that hold all candidates; without ``taken`` ones.

    What the base finds stays as it is: its spans are cut out, and the rest of a stretch is left on either side.
    """
    out: list[tuple[int, int]] = []
    stretches = _spelled(text) + _numbers(text) + _colons(text)
    busy: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if busy and s < busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], e)
        else:
            busy.append([s, e])
    k = 0
    for at, end in _united(stretches):
        while k < len(busy) and busy[k][1] <= at:
            k += 1
        j = k
        while j < len(busy) and busy[j][0] < end:
            out.append((at, busy[j][0]))
            at = busy[j][1]
            j += 1
        out.append((at, end))
    return [(s, e) for s, e in out if e - s >= 4]


def find_spans(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans (base ones and those that the field adds)."""
    text = text or ""
    base = base_spans(text)
    more: list[Span] = []
    for lo, hi in regions(text, base):
        more += decode(text, lo, hi, weights)
    return base, base + more


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row, over whole texts.

    The counts are of the base spans.  Null and empty texts have none; repeated rows
    stay; extra columns are ignored; an empty table gives an empty table.
    """
    weights = fitted()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for t in b.column(1):
                base, every = find_spans(t.as_py(), weights)
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redactor():  # noqa: ANN201
    """A column function: a text to the same text with its personal data replaced (null: null)."""
    weights = fitted()

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, find_spans(t, weights)[1]) for t in texts], dtype=object)

    return redact
