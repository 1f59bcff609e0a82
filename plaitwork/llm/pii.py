"""Personal data in text, with offset-preserving deobfuscation.

Base: four kinds of span are found in the text as it stands.

Deobfuscation: a chain of small transducers rewrites the text and keeps, for every character of its output, the
start and end of the source characters it stands for: (1) look-alike letters and digits become ASCII, invisible
characters vanish; (2) runs of spelled digits become digits, and dots between the four numbers of an address stay;
(3) at and dot in disguise (bracketed, or between spaces around a dot in disguise) become @ and .  The same detectors read the output, and each span found there is mapped
back to source characters.  It is added unless a base span of its kind covers all of it.  A text in which none of the
transducers has anything to do is not rewritten.

Defined results: null counts as empty and has no span; offsets are code points, end exclusive; spans are ordered
by kind (email, ip, card, phone), then start; repeated rows give equal results; columns other than id and text are left
out.  All scans take time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 if len(p) > 3 else int(p) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits and "." in text else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


# Look-alikes of ASCII letters and digits, by script.
LOOK_ALIKES = {
    "Cyrillic": ("асеорхуіѕјһԁԛԝАВСЕНІЈКМОРЅТХУ", "aceopxyisjhdqwABCEHIJKMOPSTXY"),
    "Greek": ("οανρυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpuiABEZHIKMNOPTYX"),
    "signs": ("﹫＠．。․‚＋‐‑–−﹣－", "@@...,+------"),
}
# Characters without width.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_SINGLE = {a: b for have, want in LOOK_ALIKES.values() for a, b in zip(have, want, strict=True)}
_SINGLE |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}  # full-width forms
_SINGLE |= {chr(0x1D7CE + k): chr(ord("0") + k % 10) for k in range(50)}  # mathematical digits
_SINGLE |= {chr(first + k): chr(ord("0") + k) for first in (0x0660, 0x06F0, 0x0966) for k in range(10)}  # Arabic-Indic and Devanagari digits
_SINGLE |= dict.fromkeys(INVISIBLE, "")
_STRANGE = re.compile("[" + "".join(map(re.escape, _SINGLE)) + "]")
# Signs that part words, as no identifier holds them (look-alikes of such signs are words of their own).
_PARTING = "".join(map(re.escape, ",;:!?\"'()<>[]{}/\\|=*#~^`"))
_PARTING += "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c)[0] in "PS" and c not in _SINGLE) + "\U0001f000-\U0001faff"
_PARTING_ALIKE = "".join(c for c, new in _SINGLE.items() if new and new in ",;:!?\"'()<>[]{}/\\|=*#~^`")
_WORD = re.compile(rf"[^\s{_PARTING}{_PARTING_ALIKE}]+|[{_PARTING_ALIKE}]")

# English names of the digits.
DIGIT_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAME = "(?:" + "|".join(DIGIT_NAMES) + ")"
_JOIN = r"[ \-.,]{1,2}"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|\+){_JOIN}?)?(?:{_NAME}|[0-9]+)(?:{_JOIN}(?:{_NAME}|[0-9]+))+(?![^\W_])", re.I)
_SPELLED_HINT = re.compile(rf"(?<![^\W_])(?:{_NAME}[ \-.,]{{1,3}}(?:{_NAME}(?![^\W_])|[0-9])|[0-9][ \-.,]{{1,3}}{_NAME}(?![^\W_]))", re.I)
_PART = re.compile(rf"{_NAME}|[0-9]|plus|\+", re.I)

_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_LABEL = r"[A-Za-z0-9-]+"
_AT = rf"(?:[ ]{{0,2}}{_OPEN}[ ]?(?:at|@|arroba)[ ]?{_SHUT}[ ]{{0,2}}|[ ]@[ ]|[ ]at[ ])"
_DOT = rf"(?:[ ]{{0,2}}{_OPEN}[ ]?(?:dot|\.|punto|point|punkt)[ ]?{_SHUT}[ ]{{0,2}}|[ ]dot[ ])"
# A local part has at most 64 characters, so at most 31 dots.
_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9._%+-]+){{0,31}}(?P<at>{_AT}|@){_LABEL}(?:(?:{_DOT}|\.){_LABEL})+", re.I)
_MAIL_HINT = re.compile(rf"{_OPEN} ?(?:at|@|arroba|dot|\.|punto|point|punkt) ?{_SHUT}|[ @](?:dot|at) | @ ", re.I)
_AT_ONLY, _DOT_ONLY = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_NUMBER_DOTS = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{_DOT}|\.)[0-9]++){{3}}", re.I)
_NUMBER = rf"(?:{_NAME}|[0-9]++)(?:[ \-,]{{1,2}}(?:{_NAME}|[0-9]++)){{0,7}}"
_BETWEEN = rf"(?:{_DOT}|[ ]\.[ ]|\.)"
_SPELLED_IP = re.compile(rf"(?<![^\W_]){_NUMBER}(?:{_BETWEEN}{_NUMBER}){{3}}(?![^\W_])", re.I)
_BETWEEN_ONLY = re.compile(_BETWEEN, re.I)


# Top-level domains with which at and dot, as mere words, make an address.
WORD_DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es it eu us dev ai app online site shop xyz nl pl pt br jp cn au ca mx ru ch se dk fi ie nz".split())


class Tape:
    """A text with the source start and end of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, array("q", range(len(text))), array("q", range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in ascending order and apart; the new characters stand for the whole span they replace."""
        if not edits:
            return
        text, starts, ends, done = [], array("q"), array("q"), 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            starts += self.starts[done:a]
            starts.extend([self.starts[a]] * len(new))
            ends += self.ends[done:a]
            ends.extend([self.ends[b - 1]] * len(new))
            done = b
        self.text = "".join(text) + self.text[done:]
        self.starts, self.ends = starts + self.starts[done:], ends + self.ends[done:]

    def source(self, span: tuple[int, int]) -> tuple[int, int]:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    """Only in words or numbers that also hold ASCII, or are digits and signs: text in another script stays as it is."""
    out = []
    for m in _WORD.finditer(text):
        word = m[0]
        if _STRANGE.search(word):
            new = "".join(_SINGLE.get(c, c) for c in word)
            if new.isascii():
                out += [(m.start() + k, m.start() + k + 1, _SINGLE[c]) for k, c in enumerate(word) if c in _SINGLE]
    return out


def _disguises(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _MAIL.finditer(text):
        middle = m.span("at")
        plain = m["at"].strip() in ("at", "AT", "At", "aT")
        if plain and (not _DOT_ONLY.search(text, middle[1], m.end()) or re.split(r"[^A-Za-z]+", m[0].rstrip("-"))[-1].lower() not in WORD_DOMAINS):
            continue  # "look at example.com" and "met at the dot there" are prose
        for a, b in ((m.start(), middle[0]), (middle[1], m.end())):
            out += [(*d.span(), ".") for d in _DOT_ONLY.finditer(text, a, b)]
        if m["at"] != "@":
            out.append((*middle, "@"))
    for m in _NUMBER_DOTS.finditer(text):
        out += [(*d.span(), ".") for d in _DOT_ONLY.finditer(text, *m.span())]
    kept, last = [], 0
    for e in sorted(set(out)):
        if e[0] >= last:
            kept.append(e)
            last = e[1]
    return kept


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out, done = [], 0
    for m in _SPELLED_IP.finditer(text):
        edits = _spelled_ip(text, *m.span())
        if edits:
            out += _spelled_runs(text, done, m.start()) + edits
            done = m.end()
    return out + _spelled_runs(text, done, len(text))


def _spelled_ip(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Edits that make an address of four numbers with dots between; none if no digit is spelled or a number is too large."""
    dots = [d.span() for d in _BETWEEN_ONLY.finditer(text, start, end)]
    edits, numbers = [], []
    for a, b in zip([start] + [d[1] for d in dots], [d[0] for d in dots] + [end], strict=True):
        parts = [(a + p.start(), a + p.end(), DIGIT_NAMES.get(p[0].lower(), p[0])) for p in _PART.finditer(text[a:b])]
        numbers.append("".join(p[2] for p in parts))
        at = a
        for x, y, new in parts:
            edits += [(at, x, "")] * (at < x) + [(x, y, new)]
            at = y
        if b < end:
            edits.append((b, dots[len(numbers) - 1][1], "."))
    if not ips(".".join(numbers)) or all(new == text[x:y] for x, y, new in edits if new and new != "."):
        return []
    return edits


def _spelled_runs(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text, start, end):
        parts = [(m.start() + p.start(), m.start() + p.end(), p[0].lower()) for p in _PART.finditer(m[0])]
        if sum(p[2] in DIGIT_NAMES for p in parts) < 2 or len(parts) < 7:
            continue
        done = m.start()
        for a, b, name in parts:
            new = "+" if name in ("plus", "+") else DIGIT_NAMES.get(name, name)
            if done < a:
                out.append((done, a, ""))
            out.append((a, b, new))
            done = b
    return out


def covered(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """True if one of the spans, which are in order and apart, covers the span."""
    at = bisect_right(spans, (span[0], span[1]))
    return any(a <= span[0] and span[1] <= b for a, b in spans[max(0, at - 1) : at + 1])


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that show only after deobfuscation, in source offsets."""
    strange = not text.isascii() and _STRANGE.search(text) is not None
    mail, spelled = _MAIL_HINT.search(text) is not None, _SPELLED_HINT.search(text) is not None
    if not (strange or mail or spelled):
        return {}
    tape = Tape(text)
    if strange:
        tape.rewrite(_look_alikes(tape.text))
    tape.rewrite(_spelled(tape.text))
    if strange or mail:
        tape.rewrite(_disguises(tape.text))
    if tape.text == text:
        return {}
    out = {}
    for kind, spans in base_spans(tape.text).items():
        found = [tape.source(s) for s in spans]
        fresh = [s for s in found if not covered(s, base[kind])]
        if fresh:
            out[kind] = sorted(set(fresh))
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans.get(kind, ()))


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans, by kind."""
    base = base_spans(text)
    added = added_spans(text, base)
    return base, {k: sorted(base[k] + added.get(k, [])) for k in KINDS}


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, own in spans.items() for a, b in own):
        if a < done:
            done = max(done, b)
            continue
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def spans_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: counts and digest of base spans, and all spans as text; no shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = find(text)
                n = [len(base[k]) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, every.values())) - sum(n)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(batches, SCHEMA)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data in the text replaced; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t, find(t)[1]))

    return df.withColumn(text_col, clean(F.col(text_col)))
