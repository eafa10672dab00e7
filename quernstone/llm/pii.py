"""Personal data with offset-preserving deobfuscation.

Two layers look for e-mail addresses, IPv4 addresses, card and phone numbers. The base layer reads
the text as it stands. The second reads it through transducers, each of which rewrites the text and
keeps, for every character that it emits, the source span the character came from:

1. look-alikes: compatibility forms, digits of any script and Cyrillic or Greek letters drawn like
   Latin ones become ASCII; zero-width characters vanish;
2. spelled digits: runs of at least `MIN_SPELLED` digit words (also "double", "triple", and "plus"
   in front) become digits, as do shorter ones of which dots or dot marks join four or more;
3. disguised marks: "(at)", "[dot]" and the like become "@" and "."; a bare " dot " does so in the name and
   host around an "@" and between the numbers of an address, a bare " at " in the shape "name at host.ending"
   if one of its dots is disguised: "read it at example.com" is no address.

What is found there and rests on a rewritten character is mapped back to the source. Base spans always
stay; an added span that lies within a base span of its kind is left out.

Defined results: a null text is an empty one. Offsets count code points, ends are exclusive. Further
columns of the input are dropped by `find_pii` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_text, table

KINDS = ("email", "ip", "card", "phone")
MIN_SPELLED = 4
Span = tuple[int, int, int]  # start, end, place in KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a start within a run of digits matches only if the first does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Digit words, letters drawn alike, characters of no width.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһᴏАВЕКМНОРСТХІЈЅαοινκρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhoABEKMHOPCTXIJSaoivkpuABEZHIKMNOPTYX"))
NO_WIDTH = "­​‌‍⁠﻿"

_DIGITS = "".join(c for c in map(chr, range(128, 0x10000)) if unicodedata.digit(c, None) is not None)  # beyond these `_plain` decides: a long class would be slow
_ODD = re.compile(f"[{NO_WIDTH}{_DIGITS}Ͱ-֏ᴏ‐-―․⁰-₟①-⓿﹐-﹯！-～\U00010000-\U0010ffff]")
_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_UNIT = rf"(?:(?:double|triple)[\s-]+)?(?:{_WORD}|[0-9])"
_SPELLED = re.compile(rf"\b(?:plus[\s-]+)?{_UNIT}(?:[\s,-]+{_UNIT}){{{MIN_SPELLED - 1},}}\b", re.I)
_SPELLED_PART = re.compile(rf"plus|double|triple|{_WORD}|[0-9]", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*+(at|@|dot|\.)\s*+[\])}>]\s*+", re.I)
_UNITS = re.compile(rf"\b{_UNIT}(?:[\s,-]+{_UNIT})*+\b", re.I)
_JOIN = re.compile(r"\s++dot\s++|\.|\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+", re.I)
_NAME = re.compile(r"(?:[A-Za-z0-9_%+-]++(?:\s+dot\s+|\.)){0,5}[A-Za-z0-9_%+-]+\Z", re.I)
_ENDING = re.compile(r"[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+){0,4}(?:\s+dot\s+|\.)[A-Za-z]{2,12}\b", re.I)
_AT = re.compile(r"@|(?<=[A-Za-z0-9_%+-])\s+at\s+(?=[A-Za-z0-9])", re.I)
_BARE_DOT = re.compile(r"(?<!\s)\s++dot\s++", re.I)
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:(?:\s+dot\s+|\.)[0-9]++){3}", re.I)
_WORDS_SEEN = tuple(DIGIT_WORDS)[2:]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind, in time linear in the text."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end(), 0))
            free = host.end()
        else:
            free = max(free, at + 1)  # no local part reaches over an "@"
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


class Rewritten:
    """A text after transducers: pieces of (place in the new text, place in the source, copied or rewritten)."""

    def __init__(self, text: str):
        self.text, self.at, self.src, self.end, self.changed = text, [0], [0], [len(text)], [False]

    def source(self, i: int) -> tuple[int, int, bool]:
        """The source span of character i, and whether it was rewritten."""
        k = bisect_right(self.at, i) - 1
        if self.changed[k]:
            return self.src[k], self.end[k], True
        return self.src[k] + i - self.at[k], self.src[k] + i - self.at[k] + 1, False

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Apply (start, end, new text) edits in order; each new text stands for the whole source of what it replaces."""
        if not edits:
            return self
        out, pieces, new, done = [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal new
            if a >= b:
                return
            out.append(self.text[a:b])
            k = bisect_right(self.at, a) - 1
            while a < b:
                stop = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                if stop > a:
                    if self.changed[k]:
                        pieces.append((new, self.src[k], self.end[k], True))
                    else:
                        s = self.src[k] + a - self.at[k]
                        pieces.append((new, s, s + stop - a, False))
                    new += stop - a
                a, k = stop, k + 1

        for start, end, put in edits:
            copy(done, start)
            if put:
                pieces.append((new, self.source(start)[0], self.source(end - 1)[1], True))
                out.append(put)
                new += len(put)
            done = end
        copy(done, len(self.text))
        got = Rewritten("".join(out))
        got.at, got.src, got.end, got.changed = (list(x) for x in zip(*pieces)) if pieces else ([0], [0], [0], [False])
        return got

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        gap = any(self.end[k] != self.src[k + 1] for k in range(first, last))  # something vanished in between
        return self.source(start)[0], self.source(end - 1)[1], gap or any(self.changed[first : last + 1])


def _plain(ch: str) -> str:
    if ch in NO_WIDTH:
        return ""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    if "‐" <= ch <= "―":
        return "-"
    digit = unicodedata.digit(ch, None)
    if digit is not None:
        return str(digit)
    got = unicodedata.normalize("NFKC", ch)
    return got if got.isascii() else ch


def _look_alikes(r: Rewritten) -> Rewritten:
    return r.replace([(m.start(), m.end(), put) for m in _ODD.finditer(r.text) if (put := _plain(m[0])) != m[0]])


def _joined(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of digits that are joined by dots with at least three others, without those that reach into taken ones."""
    found: list[tuple[int, int]] = []
    chain: list[tuple[int, int]] = []
    for m in _UNITS.finditer(text):
        if chain and not _JOIN.fullmatch(text, chain[-1][1], m.start()):
            found += chain if len(chain) > 3 else []
            chain = []
        chain.append(m.span())
    found += chain if len(chain) > 3 else []
    if not taken:
        return found
    starts, ends = [a for a, _ in taken], [b for _, b in taken]  # in order, and apart from each other
    return [x for x in found if bisect_right(ends, x[0]) == bisect_left(starts, x[1])]


def _spelled(r: Rewritten) -> Rewritten:
    edits, runs = [], []
    for run in _SPELLED.finditer(r.text):
        if sum(p[0].lower() in DIGIT_WORDS for p in _SPELLED_PART.finditer(r.text, *run.span())) >= MIN_SPELLED:
            runs.append(run.span())
    for span in sorted(runs + _joined(r.text, runs)):
        parts = list(_SPELLED_PART.finditer(r.text, *span))
        if all(p[0].isdigit() for p in parts) and len(parts) == span[1] - span[0]:
            continue
        times, start = 1, None
        for k, p in enumerate(parts):
            word = p[0].lower()
            start = p.start() if start is None else start
            if word in TIMES:
                times = TIMES[word]
                continue
            put = "+" if word == "plus" else DIGIT_WORDS.get(word, word) * times
            edits.append((start, p.end(), put))
            if k + 1 < len(parts) and parts[k + 1].start() > p.end():
                edits.append((p.end(), parts[k + 1].start(), ""))
            times, start = 1, None
    return r.replace([e for e in edits if e[0] < e[1]])


def _marks(r: Rewritten) -> Rewritten:
    put = {"at": "@", "@": "@", "dot": ".", ".": "."}
    bracketed, done = [], 0
    for m in _BRACKETED.finditer(r.text):  # blanks before it are taken backwards, so that a run of blanks is read once
        start = m.start()
        while start > done and r.text[start - 1].isspace():
            start -= 1
        bracketed.append((start, m.end(), put[m[1].lower()]))
        done = m.end()
    r = r.replace(bracketed)
    bare = _BARE_DOT.search(r.text) is not None
    if not bare and not bracketed:
        return r
    edits = {}
    for at in _AT.finditer(r.text):  # a short stretch around each
        host = _ENDING.match(r.text, at.end(), min(len(r.text), at.end() + 300))
        name = _NAME.search(r.text, max(0, at.start() - 200), at.start())
        if not host or not name:
            continue
        dots = [m for part in (name, host) for m in _BARE_DOT.finditer(r.text, *part.span())]
        if at[0] != "@":
            if not dots and not any(r.text[i] == "." and r.source(i)[2] for part in (name, host) for i in range(*part.span())):
                continue
            edits[at.start()] = (at.start(), at.end(), "@")
        edits |= {m.start(): (m.start(), m.end(), ".") for m in dots}
    for m in _NUMBERS.finditer(r.text) if bare else ():
        edits |= {d.start(): (d.start(), d.end(), ".") for d in _BARE_DOT.finditer(r.text, *m.span())}
    return r.replace(sorted(edits.values()))


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only in the rewritten text."""
    low = text.lower()
    odd = not text.isascii() and _ODD.search(text) is not None
    spelled = sum(low.count(w) for w in _WORDS_SEEN) >= MIN_SPELLED - 1
    marks = _BRACKETED.search(text) is not None if any(b in text for b in "[({<") else False
    joined = any(w in low for w in DIGIT_WORDS) and (marks or "dot" in low or any(f".{w}" in low or f"{w}." in low for w in DIGIT_WORDS))
    if not (odd or spelled or joined or marks or "dot" in low):
        return []
    r = Rewritten(text)
    for able, step in ((odd, _look_alikes), (spelled or joined or odd, _spelled), (True, _marks)):
        if able:
            r = step(r)
    if r.text == text:
        return []
    known, found = {k: [s for s in base if s[2] == k] for k in range(len(KINDS))}, []
    for start, end, kind in base_spans(r.text):
        if kind == 0 and not re.search(r"\.[A-Za-z]{2,24}$", r.text[start:end]):
            continue
        a, b, changed = r.span(start, end)
        if changed and not any(s[0] <= a and b <= s[1] for s in known[kind]):
            found.append((a, b, kind))
    return found


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = added_spans(text, base)
    return base, sorted({*base, *more}, key=lambda s: (s[0], s[2], s[1])) if more else base


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of all spans by kind, digest of the base spans, all spans."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, spans, n_base = [], [], []
        for text in batch.column("text").to_pylist():
            base, every = all_spans(text)
            for k, into in enumerate(counts):
                into.append(sum(s[2] == k for s in every))
            digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
            n_base.append(len(base))
            spans.append(spell(every))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(n_base, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_base"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_text(docs.select("doc_id", "text"), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long", find)


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    if not text:
        return text
    out, done = [], 0
    for a, b, k in all_spans(text)[1]:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k]}>"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; all columns stay."""
    names = docs.columns

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array([redacted(t) for t in batch.column("text").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names)

    return map_text(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), mask)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
