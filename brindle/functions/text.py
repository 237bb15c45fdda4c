"""Text expressions. All are built-in functions but for the Unicode forms that Spark lacks."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons as L

BM25_TOKEN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]|\p{Nd}+"
CHUNK_TOKEN = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]|\S"
SENTENCE_END = r"(?<=[。！？；;.!?])"


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind (trim drops spaces alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def bm25_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(BM25_TOKEN), F.lit(0))


def chunk_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(CHUNK_TOKEN), F.lit(0))


def sentences(c: Column | str) -> Column:
    parts = F.transform(F.split(c, SENTENCE_END), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def token_windows(tokens: Column, size: int) -> Column:
    """Consecutive windows of ``size`` tokens, joined without separator."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(size))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), "")))


def normal_lines(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: strip(x)), lambda x: x != "")


def glued_words(before: Column, after: Column) -> Column:
    """Whether two words that stood apart in ``before`` stand together in ``after``."""
    words = F.regexp_extract_all(before, F.lit("[A-Za-z]+"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.exists(pairs, lambda p: p["b"].isNotNull() & F.contains(before, F.concat(p["a"], F.lit(" "), p["b"])) & F.contains(after, F.concat(p["a"], p["b"])))


def match_key(c: Column | str) -> Column:
    """Lower case without spaces and punctuation: for file names in queries."""
    return F.regexp_replace(strip(F.lower(c)), L.MATCH_DROP, "")


def meaning_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\p{P}\p{Z}\s]", ""))


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def count_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words], F.lit(0))


def found(c: Column, words: list[str], fold: bool = False) -> Column:
    """The words that c contains, in the order of the list."""
    text = F.lower(c) if fold else c
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, F.lower(w) if fold else w))


def first_alias(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """The canonical form of the first alias, in the order of the list, that c contains."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(a)), F.lit(b)) for a, b in pairs], F.lit(None).cast("string"))


def embedding_text(file: Column, path: Column, content: Column) -> Column:
    """What is embedded for a chunk: document, section and text on lines of their own."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    where = F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(stem)
    return F.concat(F.lit("[文档] "), stem, F.lit("\n[章节] "), where, F.lit("\n[正文] "), content)


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def _unescape_nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", html.unescape(s)))


@F.pandas_udf(T.StringType())
def uuid5(x: pd.Series) -> pd.Series:
    """A stable id for a key, in the DNS name space."""
    return x.map(lambda s: None if s is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, s)))


def normalize_markdown(c: Column) -> Column:
    """Line feeds, entities, NFC, no control characters, single spaces, at most one empty line, stripped; null gives ''."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(_unescape_nfc(t), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+", " ")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalize_query(c: Column) -> Column:
    return squeeze(nfkc(F.coalesce(c, F.lit(""))))


def line_type(line: Column, in_references: Column | None = None) -> Column:
    """table > reference > toc > list > paragraph; blank for nothing."""
    s = strip(line)
    reference = s.rlike(L.REFERENCE_HEAD) | (s.rlike(L.REFERENCE_LINE) & has_any(F.lower(s), L.REFERENCE_MARKS))
    toc = reduce(lambda a, b: a | b, [s.rlike(p) for p in L.CONTENTS_LINES])
    if in_references is not None:
        reference = in_references | reference
    return F.when(s == "", "blank").when(s.rlike(L.TABLE_LINE), "table").when(reference, "reference").when(toc, "toc").when(s.rlike(L.LIST_LINE), "list").otherwise("paragraph")


_TABLE, _HEAD, _REFERENCE, _LIST = (re.compile(p, re.ASCII) for p in (L.TABLE_LINE, L.REFERENCE_HEAD, L.REFERENCE_LINE, L.LIST_LINE))
_CONTENTS = [re.compile(p, re.ASCII) for p in L.CONTENTS_LINES]


def line_kind(s: str, in_references: bool = False) -> str:
    """line_type for a stripped line in a worker."""
    if not s:
        return "blank"
    if _TABLE.search(s):
        return "table"
    if in_references or _HEAD.search(s) or _REFERENCE.search(s) and any(m in s.lower() for m in L.REFERENCE_MARKS):
        return "reference"
    if any(p.search(s) for p in _CONTENTS):
        return "toc"
    return "list" if _LIST.search(s) else "paragraph"


def normal_text(s: str | None) -> str:
    """normalize_markdown for a text in a worker."""
    t = unicodedata.normalize("NFC", html.unescape(re.sub("\r\n?", "\n", s or "")))
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
    t = re.sub("[ \t\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", t)).strip()


def indexable(text: Column, kind: Column) -> Column:
    return ~kind.isin("toc", "reference", "blank", "heading") & (F.length(strip(text)) > 1)
