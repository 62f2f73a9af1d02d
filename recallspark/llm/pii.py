"""Personal data, also where it is disguised.

Base patterns find plain e-mail addresses, ip addresses, card and phone numbers. The method then runs transducers over the places
that look disguised: look-alike letters and digits and invisible characters become plain ones, spelled digits become digits,
and at / dot disguises become signs. Each output character keeps the source characters that it stands for, so that what the patterns find in
the normalised text maps back to a span of the source. A found span within a plain one of its kind is left out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_bytes

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The look-behind changes nothing, as a run of digits fits from its start or not at all; it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]
#: A range and what replaces it.
Part = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- transducers

#: Digits spelled in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Letters of other scripts that look like Latin ones (Cyrillic, then Greek), signs, then Latin small capitals and look-alikes.
_LOOKS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅοαιυνρτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSoaiuvptkABEZHIKMNOPTYX", strict=True)) | dict(zip("․。．﹒‐‑‒–—―−＠﹫٠", "....-------@@0", strict=True)) | dict(zip("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢıȷɑɡ", "abcdefghijklmnoprstuvwyzijag", strict=True))
#: Characters without width.
_UNSEEN = frozenset("­​‌‍‎‏⁠﻿")

_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_DOT_WORD = r"dot|punkt|point|punto"
_NUMBER = rf"(?:{_WORD}|[0-9]+)"
_BETWEEN = rf"(?:[\s,.-]{{1,3}}|\s{{1,3}}(?:{_DOT_WORD})\s{{1,3}})"
#: Numbers in a row; after a plus, brackets may stand between them.
_RUN = re.compile(rf"(?<!\w){_NUMBER}(?:{_BETWEEN}{_NUMBER})+(?!\w)", re.I)
_PLUS_RUN = re.compile(rf"(?:\+[\s(]{{0,2}}{_NUMBER}(?:(?:[\s,.()-]{{1,4}}|{_BETWEEN}){_NUMBER})+|(?<!\w){_NUMBER}(?:{_BETWEEN}{_NUMBER})+)(?!\w)", re.I)
_RUN_PART = re.compile(rf"(?P<between>(?:[\s,.()-]|(?:{_DOT_WORD})(?![A-Za-z]))+)|(?P<word>{_WORD})|[0-9]+|\+", re.I)
_DOT_ONLY = re.compile(rf"\s*(?:\.|(?:{_DOT_WORD}))\s*", re.I)
_AT = re.compile(r"[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]", re.I)
_DOT = re.compile(rf"[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]", re.I)
#: An address in words needs both at and dot: name at host dot org. A run of white space is tried from its start only.
_WORD_AT = re.compile(r"(?<!\s)\s+(?:at|arroba)\s+|@", re.I)
_NAME_BACK = re.compile(r"[A-Za-z0-9_%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]+")
_LINK = re.compile(rf"\.|\s+(?P<dot>{_DOT_WORD})\s+", re.I)
_LAST = re.compile(r"[A-Za-z]{2,12}(?![A-Za-z])")
_DOT_BACK = re.compile(rf"(?:\.|\s+(?:{_DOT_WORD[::-1]})\s+)", re.I)
_TRIGGER = re.compile(rf"[\[({{<]\s*(?:at|@|arroba|ät|{_DOT_WORD}|\.)\s*[\])}}>]|\s(?:{_DOT_WORD})\s", re.I)


class Tape:
    """A text with the source range [first, end) of each of its characters."""

    def __init__(self, text: str, first: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.first = list(range(len(text))) if first is None else first
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def replaced(self, found: list[tuple[int, int, str]]) -> Tape:
        """With [a, b) replaced by a string, each of whose characters stands for all of the source of [a, b)."""
        text, first, end, at = [], [], [], 0
        for a, b, new in found:
            text += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), first + self.first[at:], end + self.end[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.first[a], self.end[b - 1]


def plain_character(c: str) -> str | None:
    """What a strange character stands for: a plain one, nothing, or None for itself."""
    if c in _UNSEEN:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    d = unicodedata.decimal(c, None)
    if d is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() and n.isprintable() else None


def _characters(t: Tape) -> Tape:
    found = [(m.start(), m.end(), x) for m in _STRANGE_OR_SOFT.finditer(t.text) if (x := plain_character(m[0])) is not None]
    return t.replaced(found) if found else t


_STRANGE_OR_SOFT = re.compile("[­" + "".join(x for x in _LOOKS if x < "\u0300") + "]|[^\\x00-\u02ff]")


def _spaced(text: str, a: int, b: int) -> tuple[int, int]:
    """[a, b) with the white space around it."""
    while a > 0 and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    return a, b


def _name(back: str, i: int, end: int) -> tuple[int, list[Part]]:
    """Where the name that ends at i begins, not before end, and the dots and words for dots in it; back is the text backwards."""
    n, dots = len(back), []
    word = _NAME_BACK.match(back, n - i, n - end)
    while word:
        i = n - word.end()
        link = _DOT_BACK.match(back, n - i, n - end)
        word = link and _NAME_BACK.match(back, link.end(), n - end)
        if word:
            dots.append((n - link.end(), i, "."))
    return i, dots


def _host(text: str, i: int) -> tuple[int, list[Part]]:
    """Where the host that begins at i ends, i if there is none, and the dots in it: words and dots, and at last a word for a dot and letters."""
    dots, whole, end = [], 0, i
    while word := _HOST.match(text, i):
        link = _LINK.match(text, word.end())
        if not link:
            break
        dots.append((*link.span(), "."))
        i = link.end()
        if link["dot"] and (last := _LAST.match(text, i)):
            whole, end = len(dots), last.end()
    return end, dots[:whole]


def _phrases(text: str) -> list[Part]:
    """Signs for the at and the words for dots of addresses in words. From each at the name is read backwards and the host forwards, so no place is read more than a few times."""
    out: list[Part] = []
    end, back = 0, text[::-1]
    for m in _WORD_AT.finditer(text):
        a, b = _spaced(text, *m.span())
        if a < end:
            continue
        start, before = _name(back, a, end)
        stop, after = _host(text, b)
        if start < a and stop > b:
            end = stop
            out += [x for x in [*before[::-1], (a, b, "@"), *after] if text[x[0] : x[1]] not in ("@", ".")]
    return out


def _signs(t: Tape) -> Tape:
    for pattern, sign in ((_AT, "@"), (_DOT, ".")):
        found, end = [], 0
        for m in pattern.finditer(t.text):
            a, b = _spaced(t.text, *m.span())
            found.append((max(a, end), b, sign))
            end = b
        t = t.replaced(found) if found else t
    found = _phrases(t.text)
    return t.replaced(found) if found else t


def _edge(group: list[Part], last: bool) -> list[Part]:
    """What of the first or last group of an ip belongs to it: a number next to the dot, or all of its single digits."""
    near = group[0] if last else group[-1]
    return [near] if len(near[2]) > 1 else group


def _octet(group: list[Part]) -> str:
    """The number from 0 to 255 that a group spells, as its digits; nothing if it is none."""
    value = "".join(x[2] for x in group) if len(group) < 4 else ""
    return value if 0 < len(value) <= 3 and int(value) <= 255 and (len(group) == 1 or len(value) == len(group)) else ""


def _ips(groups: list[list[Part]], dots: list[Part]) -> list[Part]:
    """Replacements that make ip addresses of four groups of numbers with three dots between them, those with three dots of one form first.

    Single digits with dots as at the end of sentences (one. two. three. four.) are none.
    """
    if len(dots) < 3:
        return []
    out, used = [], set()
    forms = ["word" if "." not in d[2] else (d[2][0].isspace(), d[2][-1].isspace()) for d in dots]
    ends = [[_edge(g, last) if g else g for g in groups] for last in (False, True)]
    left, inner, right = ([_octet(g) for g in x] for x in (ends[0], groups, ends[1]))
    for alike in (True, False):
        for i in range(len(dots) - 2):
            values = left[i], inner[i + 1], inner[i + 2], right[i + 3]
            if not all(values) or alike != (forms[i] == forms[i + 1] == forms[i + 2]) or used & {i, i + 1, i + 2, i + 3}:
                continue
            if all(len(v) == 1 for v in values) and (False, True) in forms[i : i + 3]:
                continue
            used |= {i, i + 1, i + 2, i + 3}
            four = [ends[0][i], *groups[i + 1 : i + 3], ends[1][i + 3]]
            for g in four:
                out += g
                out += [(x[1], y[0], "") for x, y in zip(g, g[1:], strict=False)]
            for g, h in zip(four, four[1:], strict=False):
                out.append((g[-1][1], h[0][0], "."))
    return out


def _numbers(t: Tape) -> Tape:
    """Digits for spelled ones, in runs of ten digits or more, where all between them goes, or in four numbers with dots or words for them.

    A run may hold a plus before its first number, and then brackets. Words for dots end a run of digits without a plus.
    """
    found: list[Part] = []
    for m in (_PLUS_RUN if "+" in t.text else _RUN).finditer(t.text):
        groups, dots, gaps, runs, disguised, spelled = [[]], [], [], [[]], False, 0
        for x in _RUN_PART.finditer(m[0]):
            part = (m.start() + x.start(), m.start() + x.end(), x[0])
            if x["word"]:
                disguised, spelled = True, spelled or part[0]
                part = (*part[:2], _SPELLED[x[0].lower()])
            if x["between"]:
                gaps.append(part)
                if _DOT_ONLY.fullmatch(x[0]):
                    dots.append(part)
                    groups.append([])
                    if "." not in x[0]:
                        disguised = True
                        if m[0][0] != "+":
                            runs.append([])
            elif x[0] != "+":
                groups[-1].append(part)
                runs[-1].append(part)
        if not disguised:
            continue
        digits = "".join(x[2] for r in runs for x in r)
        phone = m[0][0] == "+" and len(digits) >= 10
        if phone and spelled and sum(len(x[2]) for r in runs for x in r if x[0] < spelled) >= 10:
            # The plain digits are a phone number without the words after them.
            phone, runs = False, [[x for x in r if x[0] >= spelled] for r in runs]
        card = len(runs) == 1 and 14 <= len(digits) <= 19 and luhn(digits)
        ips = [] if phone or card else _ips(groups, dots)
        if ips:
            found += ips
            continue
        for r in runs:
            if sum(len(x[2]) for x in r) >= 10 and (phone or any(not t.text[x[0]].isdigit() for x in r)):
                found += r + [(*g[:2], "") for g in gaps if (m.start() if phone else r[0][0]) <= g[0] < r[-1][0]]
    return t.replaced(sorted(found)) if found else t


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers that are in no base span of their kind."""
    strange = not text.isascii() and _STRANGE_OR_SOFT.search(text)
    signs, numbers = _TRIGGER.search(text), _RUN_TRIGGER.search(text.casefold())
    if not (strange or signs or numbers):
        return []
    t = Tape(text)
    if strange:
        t = _characters(t)
    if signs or strange:
        t = _signs(t)
    if numbers or strange:
        t = _numbers(t)
    if t.text == text:
        return []
    # Those of a kind are in order and don't overlap, so only the last that begins before a found one can hold it.
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    starts = {k: [a for a, _ in v] for k, v in taken.items()}
    out = []
    for kind, a, b in base_spans(t.text):
        a, b = t.source(a, b)
        k = bisect_right(starts[kind], a) - 1
        if k < 0 or taken[kind][k][1] < b:
            out.append((kind, a, b))
    return out


#: A spelled digit beside a number, or a word for a dot between two, in small letters: what makes a run worth reading.
_RUN_TRIGGER = re.compile(rf"(?<!\w)(?=[{''.join(sorted({x[0] for x in _SPELLED}))}0-9])(?:(?:{_WORD})(?:[\s,.()-]{{1,4}}|\s{{1,3}}(?:{_DOT_WORD})\s{{1,3}}){_NUMBER}|[0-9]+(?:[\s,.()-]{{1,4}}(?:{_WORD})|\s{{1,3}}(?:{_DOT_WORD})\s{{1,3}}{_NUMBER}))(?!\w)")


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind in the order of KINDS."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans array<struct<kind, start, end, added>> in code points, a row for every row; null text is empty, and malformed UTF-8 counts as U+FFFD."""

    def work(batches):
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                x = body.decode("utf-8", "replace")
                base = base_spans(x)
                spans = [(s, False) for s in base] + [(s, True) for s in added_spans(x, base)]
                spans.sort(key=lambda s: (s[0][1], KINDS.index(s[0][0]), s[0][2]))
                out.append([{"kind": k, "start": a, "end": b, "added": new} for (k, a, b), new in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:long,end:long,added:boolean>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans as text, how many the method added, and how many there are."""
    base = F.filter("spans", lambda s: ~s["added"])
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))


__all__ = ["added_spans", "base_spans", "digest", "joined", "scan"]
