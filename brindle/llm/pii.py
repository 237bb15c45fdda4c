"""Personal data in plain and in disguise, with spans in the source text.

Plain detection takes the leftmost non-overlapping matches of four patterns, a failing match being dropped. Then a transducer
rewrites the text where it may be disguised. It is four transducers in a row, each of which keeps the source span of every replacement:

* homoglyphs and full-width forms become the ASCII character they look like; zero-width characters vanish;
* spelled digits (English, German, French, Spanish) become digits, in a row of at least four anywhere and in shorter rows beside
  a digit, a spelled dot or a plus sign;
* ``(at)``, ``[at]``, ``{at}``, `` at `` and the same for *dot* (and *punkt*, *point*, *punto*, *arroba*) become ``@`` and ``.`` where an
  address can stand: a bare word counts only inside ``name at host dot domain``, where the dot may be a plain one; a bare *at*
  with plain dots alone needs a last part of two letters or more, so that ``rose at 3.5`` stays.

The same detectors run on the output; a find is mapped back through the transducers to the span of source characters, and kept if the transducer
changed something inside it and it does not lie inside a plain find of its kind. Plain finds always stay, so a find with a
disguised part stands beside the plain find of its other part; redact joins the two.

Only texts that hold a trigger (a character outside Latin-1, a row of digit words or one beside digits, a word for *at* before
a host, a word for *dot*) are rewritten.

Defined cases: null text counts as empty and has no spans; offsets are code points, end exclusive; repeated rows each give a
row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from bisect import bisect_right
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, spread

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Characters that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "ı": "i", "ɡ": "g", "ℓ": "l",
}
# Characters without width.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "plus": "+",
}
_DIGIT = "|".join(sorted(map(re.escape, DIGIT_WORDS), key=len, reverse=True))
_STOP = {"dot": ".", "punkt": ".", "point": ".", "punto": "."}
_ITEM = rf"(?:{_DIGIT}|{'|'.join(_STOP)}|[0-9])"
_RUN = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?:[ \-.,]{{1,2}}{_ITEM}(?!\w)){{3,}}")
_RUN_PART = re.compile(rf"(?i)({_ITEM})(?!\w)([ \-.,]{{1,2}}(?={_ITEM}(?!\w)))?")
#: Shorter rows, which count only beside digits: their separators stay except between two of their own items.
_SHORT = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?!\w)(?:[ \-,]{{1,2}}(?:{_DIGIT}|[0-9])(?!\w))*")
_SHORT_PART = re.compile(rf"(?i)({_DIGIT}|[0-9])(?!\w)([ \-,]{{1,2}}(?=(?:{_DIGIT}|[0-9])(?!\w)))?")
_SPELLED_DOT = rf"(?:[ ]{{1,2}}(?:{'|'.join(_STOP)})[ ]{{1,2}}|[ ]?[\(\[\{{<][ ]?(?:{'|'.join(_STOP)}|\.)[ ]?[\)\]\}}>][ ]?)"
_BESIDE = rf"(?:[ ().,-]{{1,3}}|{_SPELLED_DOT})"
_BEFORE, _AFTER = re.compile(rf"(?i)(?:[0-9]{_BESIDE}|\+[ (]{{0,2}})$"), re.compile(rf"(?i){_BESIDE}\+?[0-9]")
_PLUS_GAP = re.compile("[ (,-]{1,2}(?=[0-9])")
_GAP = re.compile(rf"(?i){_BESIDE}")
_AT, _DOT = "at|arroba|ät", "dot|punkt|point|punto"
_NAME, _PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-"), r"[A-Za-z0-9-]+"
_B_AT = rf"[\(\[\{{<]\s*(?:{_AT}|@)\s*[\)\]\}}>]\s*"
_B_DOT = rf"[\(\[\{{<]\s*(?:{_DOT}|\.)\s*[\)\]\}}>]\s*"
#: What can stand between the parts of an address: plain signs, bracketed signs or words, bare words in white space. White space is taken whole.
_SEPARATOR = re.compile(rf"(?i)(?P<at>@)|(?P<dot>\.)|(?<!\s)\s*+(?:(?P<b_at>{_B_AT})|(?P<b_dot>{_B_DOT}))|(?<!\s)\s++(?:(?P<w_at>{_AT})|(?P<w_dot>{_DOT}))\s+")
_ANY_DOT = rf"(?:\.|\s*+{_B_DOT}|\s++(?:{_DOT})\s+)"
_QUAD = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:{_ANY_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
_DOT_IN = re.compile(rf"(?i)\s*+{_B_DOT}|\s++(?:{_DOT})\s+")
_PART_START = re.compile(_PART)
_ODD = re.compile("[\u0131\u00ad\u0261\u0370-\U0010ffff]")
_DOT_WORD = re.compile(rf"(?i)(?<!\w)(?:{_DOT})(?!\w)|[\(\[\{{<]\s*(?:@|\.|(?:{_AT})\s*[\)\]\}}>])")
#: A word for *at* where an address can stand without a word for *dot*.
_AT_WORD = re.compile(r"(?i)(?<!\w)(?:arroba|ät)(?!\w)|(?<=[A-Za-z0-9_%+-]\s)\s*at\s+(?=(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2})")
#: Words that also stand in ordinary text; a run of digit words needs others too.
_TELLING = frozenset(DIGIT_WORDS) - {"un", "oh", "null", "plus"}
_ANY_DIGIT = frozenset(DIGIT_WORDS)
_SPACED = str.maketrans(string.punctuation, " " * len(string.punctuation))
_AT_DOT = ("dot", "punkt", "point", "punto", "(at", "[at", "{at", "<at", "( at", "[ at", "(@", "[@", "{@", "<@", "(.", "[.", "{.", "<.", "arroba", "ät")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


_DIGITS = re.compile("[0-9]")


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = _DIGITS.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if digits else [], "card": cards(text) if digits else [], "phone": phones(text) if digits else []}


def _short_runs(text: str) -> list[re.Match]:
    """Rows of digit words beside a digit, a spelled dot next to one, a plus sign, or another such row."""
    runs = list(_SHORT.finditer(text))
    near, telling = [], []
    for m in runs:
        before, after = _BEFORE.search(text, max(0, m.start() - 20), m.start()) is not None, _AFTER.match(text, m.end()) is not None
        words = re.findall(r"[^\W\d]+", m[0].lower())
        telling.append(not _TELLING.isdisjoint(words))
        near.append(before or after if telling[-1] else after and (before or words[0] == "plus"))  # "un" after a number is mostly an article
    joins = [telling[i] and telling[i + 1] and y.start() - x.end() <= 20 and _GAP.fullmatch(text, x.end(), y.start()) is not None for i, (x, y) in enumerate(pairwise(runs))]
    for i in range(1, len(runs)):
        near[i] = near[i] or near[i - 1] and joins[i - 1]
    for i in range(len(runs) - 2, -1, -1):
        near[i] = near[i] or near[i + 1] and joins[i]
    return [m for m, ok in zip(runs, near, strict=True) if ok]


class Edits:
    """One transducer's work: the rewritten text, and the source span of each of its replacements; all other characters are copied."""

    def __init__(self, text: str, spans: list[tuple[int, int, str]]):
        parts, at, size = [], 0, 0
        self.lo, self.hi, self.source_lo, self.source_hi = [], [], [], []
        for a, b, to in spans:
            parts += [text[at:a], to]
            size += a - at
            self.lo.append(size)
            size += len(to)
            self.hi.append(size)
            self.source_lo.append(a)
            self.source_hi.append(b)
            at = b
        self.text = "".join([*parts, text[at:]])

    def back(self, a: int, b: int) -> tuple[int, int, bool]:
        """The source span of a span of the output, and whether a replacement stands in it."""
        i, j = bisect_right(self.lo, a) - 1, bisect_right(self.lo, b - 1) - 1
        inside = i >= 0 and a < self.hi[i]
        start = self.source_lo[i] if inside else a + (self.source_hi[i] - self.hi[i] if i >= 0 else 0)
        end = self.source_hi[j] if j >= 0 and b - 1 < self.hi[j] else b + (self.source_hi[j] - self.hi[j] if j >= 0 else 0)
        return start, end, inside or j > i


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    """Characters that stand for ASCII ones, digits of other scripts, and characters without width."""
    to = {}
    for c in set(_ODD.findall(text)):
        d = "" if c in INVISIBLE else HOMOGLYPHS.get(c)
        if d is None and c.isdecimal():
            d = str(unicodedata.decimal(c))
        elif d is None and ord(c) > 0x2000:
            wide = unicodedata.normalize("NFKC", c)
            d = wide if len(wide) == 1 and wide.isascii() else None
        if d is not None:
            to[c] = d
    if not to:
        return []
    return [(m.start(), m.end(), to[m[0]]) for m in re.finditer("[" + re.escape("".join(to)) + "]", text)]


def _spelled_rows(text: str) -> list[tuple[int, int, str]]:
    spans = []
    for m in _RUN.finditer(text):
        for d in _RUN_PART.finditer(text, m.start(), m.end()):
            word = d[1].lower()
            spans.append((d.start(), min(d.end(), m.end()), DIGIT_WORDS.get(word) or _STOP.get(word, word)))
    return spans


def _spelled_beside_digits(text: str) -> list[tuple[int, int, str]]:
    spans = []
    for m in _short_runs(text):
        for d in _SHORT_PART.finditer(text, m.start(), m.end()):
            word, e = d[1].lower(), min(d.end(), m.end())
            if word == "plus" and (gap := _PLUS_GAP.match(text, e)):
                e = gap.end()
            spans.append((d.start(), e, DIGIT_WORDS.get(word, word)))
    return spans


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Disguised at and dot signs of addresses and of numbers with four parts.

    Separators are found in one pass. From each *at* the address goes left over names and dots and right over host parts and dots, as long as
    nothing else stands between two separators; each separator is met a fixed number of times, so the work is linear in the text.
    """
    if _DOT_WORD.search(text) is None and _AT_WORD.search(text) is None:
        return []
    spans, seps = [], [(m.start(), m.end(), m.lastgroup) for m in _SEPARATOR.finditer(text)]
    telling = {m.start() for m in _AT_WORD.finditer(text)}
    done, free = 0, 0  # where the last address ends, and the first separator behind it
    for k, (a, b, kind) in enumerate(seps):
        if not kind.endswith("at") or k < free:
            continue
        # Leftwards: the farthest name from which names and dots alone lead here.
        first, start, i, edge = None, a, k, a
        while True:
            while start > done and text[start - 1] in _NAME:
                start -= 1
            if start == edge:
                break
            if start == 0 or text[start - 1] != "." or start == done:
                first = start, i
            if i - 1 < free or seps[i - 1][1] != start or not seps[i - 1][2].endswith("dot"):
                break
            i -= 1
            start = edge = seps[i][0]
        # Rightwards: host parts and dots.
        part, j, end = _PART_START.match(text, b), k + 1, None
        while part is not None and j < len(seps) and seps[j][0] == part.end() and seps[j][2].endswith("dot"):
            part = _PART_START.match(text, seps[j][1])
            if part is not None:
                end, j = part.end(), j + 1
        if first is None or end is None:
            continue
        used = seps[first[1] : j]
        bare = kind == "w_at" and not any(x[2] in ("b_dot", "w_dot") for x in used)
        if bare and not any(p in telling for p in range(a, b)):
            continue
        spans += [(x, y, "@" if z.endswith("at") else ".") for x, y, z in used if z not in ("at", "dot")]
        done, free = end, j
    taken = [(x, y) for x, y, _ in spans]
    for m in _QUAD.finditer(text):
        dots = [(x.start(), x.end(), ".") for x in _DOT_IN.finditer(text, m.start(), m.end())]
        i = bisect_right(taken, (m.end(), 0))
        if dots and not (i and taken[i - 1][1] > m.start()):
            spans += dots
    return sorted(spans)


def normalise(text: str) -> list[Edits]:
    """The transducers' work, each on the output of the one before; empty: nothing to rewrite."""
    stages = []

    def step(spans: list[tuple[int, int, str]]) -> None:
        nonlocal text
        if spans:
            stages.append(Edits(text, spans))
            text = stages[-1].text

    if not text.isascii():
        step(_look_alikes(text))
    if not stages:  # cheap signs first: enough digit words, a word for at or dot
        low = text.lower()
        words = low.translate(_SPACED).split()
        spelled = not _ANY_DIGIT.isdisjoint(words) and (not _TELLING.isdisjoint(words) and _RUN.search(text) is not None or _DIGITS.search(text) is not None and bool(_short_runs(text)))
        if not spelled and not any(x in low for x in _AT_DOT) and _AT_WORD.search(text) is None:
            return []
    step(_spelled_rows(text))
    step(_spelled_beside_digits(text))
    step(_signs(text))
    return stages


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain finds, and the finds that only the rewritten text shows, as source spans; both by kind."""
    base = detect(text)
    extra: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    stages = normalise(text)
    if stages:
        for kind, spans in detect(stages[-1].text).items():
            plain = sorted(base[kind])
            for a, b in spans:
                s, e, new = a, b, False
                for stage in reversed(stages):
                    s, e, here = stage.back(s, e)
                    new |= here
                i = bisect_right(plain, (s, len(text) + 1)) - 1  # plain finds don't overlap: only the last that starts here or before can hold it
                if (new or e - s != b - a) and not (i >= 0 and e <= plain[i][1]):
                    extra[kind].append((s, e))
    return base, extra


def _said(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (all spans), base_sha256, spans: one row for each row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts, base_sha, said = {k: [] for k in KINDS}, [], []
            for x in batch["text"]:
                base, extra = find(x.as_py())
                spans = {k: base[k] + extra[k] for k in KINDS}
                for k in KINDS:
                    counts[k].append(len(spans[k]))
                base_sha.append(hashlib.sha256(_said(base).encode()).hexdigest())
                said.append(_said(spans))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, "base_sha256": pa.array(base_sha, pa.string()), "spans": pa.array(said, pa.string())})

    return spread(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with every find replaced by its kind in brackets; overlapping finds become one, named by the first."""
    base, extra = find(text)
    spans = sorted((a, b, k) for group in (base, extra) for k in KINDS for a, b in group[k])
    out, at = [], 0
    merged: list[tuple[int, int, str]] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
        else:
            merged.append((a, b, k))
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact_texts(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; n_chars follows the text, null texts stay null."""
    ship(docs.sparkSession)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            texts = [None if not x.is_valid else redact(x.as_py()) for x in batch["text"]]
            cols = {c: batch.column(i) for i, c in enumerate(names)}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return docs.mapInArrow(run, schema)


__all__ = ["detect", "find", "normalise", "pii_spans", "redact", "redact_texts"]
