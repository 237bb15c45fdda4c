"""Markdown to typed blocks, and blocks to token-budgeted chunks.

A file is one row and the unit of both rules, so parsing and chunking are one pass over the rows without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import lexicons as L
from brindle.functions.text import embedding_text, indexable, line_kind, normal_text, normalize_markdown, strip

from .store import spread


@dataclass(frozen=True)
class ChunkParams:
    target: int = 280
    soft: int = 360
    hard: int = 448
    overlap: int = 50
    least: int = 40

    def __post_init__(self):
        if not 0 < self.target <= self.soft <= self.hard or self.overlap < 0 or self.least < 0:
            raise ValueError("0 < target <= soft <= hard, overlap and least not negative")


def lines(files: DataFrame) -> DataFrame:
    """source_file, line_no, line: the stripped lines of the normalised text; no shuffle."""
    text = normalize_markdown(F.col("text"))
    return files.select("source_file", text.alias("_t")).filter("_t <> ''").select("source_file", F.posexplode(F.split("_t", "\n")).alias("n", "line")).select("source_file", (F.col("n") + 1).alias("line_no"), strip("line").alias("line"))


_HEADING, _REFERENCES = re.compile(r"(#{1,6})\s+(.+?)\s*$"), re.compile(L.REFERENCE_HEAD, re.ASCII)
_NO_INDEX = ("toc", "reference", "blank", "heading")
BLOCK = "source_file string, start_line int, end_line int, block_type string, text string, section_path array<string>, heading_level int, is_indexable boolean"


def stem_of(file: str) -> str:
    return re.sub(r"\.[^.]*$", "", file) or file


def document_blocks(file: str, text: str | None) -> list[tuple]:
    """Rows of BLOCK for one file. A heading closes the open ones of its level and below; lines of one type in a row are one block."""
    open_, lines, path, heading = {}, [], [stem_of(file)], ""
    for number, line in enumerate((x.strip() for x in normal_text(text).split("\n")), 1):
        mark = _HEADING.match(line)
        if mark:
            level, heading = len(mark[1]), mark[2].strip()
            open_ = {k: v for k, v in open_.items() if k < level} | {level: heading}
            path = [x for x in (open_.get(1, stem_of(file)), *(open_[k] for k in sorted(open_) if k > 1)) if x]
            lines.append((number, "heading", heading, path, level))
        else:
            kind = line_kind(line, bool(_REFERENCES.match(heading)))
            lines.append((number, kind, line, path, None))
    out = []
    # A heading is a block of its own: its line number joins the key.
    for (kind, _), run in groupby(lines, key=lambda x: (x[1], x[0] if x[1] == "heading" else 0)):
        run = list(run)
        if kind != "blank":
            said = "\n".join(x[2] for x in run).strip()
            out.append((file, run[0][0], run[-1][0], kind, said, run[0][3], run[0][4], kind not in _NO_INDEX and len(said) > 1))
    return out


def blocks(files: DataFrame) -> DataFrame:
    """source_file, start_line, end_line, block_type, text, section_path, heading_level, is_indexable; null text gives no block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [r for file, text in zip(pdf["source_file"], pdf["text"], strict=True) if normal_text(text) for r in document_blocks(file, text)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK.split(", ")])
            yield frame.astype({"heading_level": "Int32"})

    return spread(files.select("source_file", "text")).mapInPandas(run, BLOCK)


_TOKEN, _END = re.compile("[A-Za-z0-9]+|[一-鿿]|\\S"), re.compile(r"(?<=[。！？；;.!?])")


def units_of(text: str, room: int) -> list[tuple[str, int]]:
    """Sentences with their token counts; one over ``room`` tokens comes in windows of that many, joined without spaces."""
    out = []
    for s in [x.strip() for x in _END.split(text) if x.strip()] or [text.strip()]:
        words = _TOKEN.findall(s)
        out += [(s, len(words))] if len(words) <= room else [(w, len(_TOKEN.findall(w))) for w in ("".join(words[i : i + room]) for i in range(0, len(words), room))]
    return [u for u in out if u[0]]


def pack_section(units: list[tuple[str, int]], prefix: int, p: ChunkParams) -> tuple[list[str], str]:
    """The closed chunks of one section, and the text that is still open.

    Token counts of lines add up, so a chunk's size is a running sum (prefix, open tokens) and only what is carried over is counted again. A unit joins up to the target,
    a short one up to the soft limit; otherwise the chunk closes and the unit starts the next behind the overlap, or bare where both are
    over the hard limit. What reaches the soft limit by its first unit closes at once.
    """
    closed, open_, size = [], [], prefix

    def carry() -> tuple[list[str], int]:
        text = "\n".join(open_)
        closed.append(text)
        words = _TOKEN.findall(text) if p.overlap else []
        if len(words) > p.overlap:
            text = "".join(words[-p.overlap :])
            words = _TOKEN.findall(text)  # words that now touch are one token
        return ([text], prefix + len(words)) if words else ([], prefix)

    for text, n in units:
        limit = p.soft if "\n" in text or len(text) < 200 else p.target
        joins = bool(open_) and size + n <= limit
        if open_ and not joins:
            open_, size = carry()
            if size + n > p.hard:
                open_, size = [], prefix
        open_, size = [*open_, text], size + n
        if not joins and size >= p.soft:
            open_, size = carry()
    return closed, "\n".join(open_)


def fold_document(stem: str, rows: list[tuple[tuple[str, ...], str]], p: ChunkParams) -> list[tuple[list[str], str]]:
    """rows: section and text of a document's indexable blocks, in order. Chunks as (section, content).

    Overlap never crosses a section. The document's last open text is dropped if it is only the overlap, and joins the chunk before it if
    it is under the least size and both fit.
    """
    out, last = [], ((), "")
    for section, run in groupby(rows, key=lambda r: r[0]):
        if last[1]:
            out.append(last)
        prefix = len(_TOKEN.findall(f"[文档] {stem}\n[章节] {' > '.join(section) if section else stem}\n[正文] "))
        closed, rest = pack_section([u for _, text in run for u in units_of(text, max(16, p.hard - prefix))], prefix, p)
        out += [(section, c) for c in closed]
        last = section, rest
    section, tail = last
    if tail:
        words, before = _TOKEN.findall(tail), _TOKEN.findall(out[-1][1]) if out else []
        only_overlap = bool(out) and p.overlap > 0 and tail == (out[-1][1] if len(before) <= p.overlap else "".join(before[-p.overlap :]))
        if not only_overlap:
            if out and out[-1][0] == section and len(words) < p.least and prefix + len(before) + len(words) <= p.hard:
                out[-1] = section, f"{out[-1][1]}\n{tail}"
            else:
                out.append((section, tail))
    return [(list(s), t) for s, t in out]


CHUNK = "source_file string, chunk_index int, section_path array<string>, content string"


def _chunk_rows(files: Iterator[tuple[str, list[tuple]]], p: ChunkParams) -> pd.DataFrame:
    out = [(file, i, section, text) for file, rows in files for i, (section, text) in enumerate(fold_document(stem_of(file), rows, p))]
    return pd.DataFrame(out, columns=["source_file", "chunk_index", "section_path", "content"])


def chunk_files(files: DataFrame, params: ChunkParams | None = None) -> DataFrame:
    """Files to chunks in one pass: what blocks and chunk_blocks give together, without a shuffle."""
    p = params or ChunkParams()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = ((file, [(tuple(b[5]), b[4]) for b in document_blocks(file, text) if b[7]]) for file, text in zip(pdf["source_file"], pdf["text"], strict=True))
            yield _chunk_rows(made, p)

    return enrich(spread(files.select("source_file", "text")).mapInPandas(run, CHUNK))


def chunk_blocks(df: DataFrame, params: ChunkParams | None = None) -> DataFrame:
    """Blocks of many files to chunks: chunk_id, source_file, chunk_index, section_path, section_path_text, content, embedding_text, token_count, char_count, hashes.

    For blocks that come from elsewhere: a file's blocks are gathered into one array, as a document is the unit of the rule.
    """
    p = params or ChunkParams()
    rows = df.filter("is_indexable").groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "section_path", "text"))), lambda x: F.struct(x["section_path"].alias("s"), x["text"].alias("t"))).alias("rows"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield _chunk_rows(((file, [(tuple(x["s"]), x["t"]) for x in items]) for file, items in zip(pdf["source_file"], pdf["rows"], strict=True)), p)

    return enrich(rows.mapInPandas(run, CHUNK))


def enrich(chunks: DataFrame) -> DataFrame:
    whole = embedding_text(F.col("source_file"), F.col("section_path"), F.col("content"))
    df = chunks.withColumn("embedding_text", whole)
    return df.select(
        F.concat("source_file", F.lit("::"), F.col("chunk_index").cast("string")).alias("chunk_id"), "source_file", "chunk_index", "section_path", F.array_join("section_path", " > ").alias("section_path_text"), "content", "embedding_text",
        F.size(F.regexp_extract_all("embedding_text", F.lit(r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]|\S"), F.lit(0))).alias("token_count"), F.length("content").alias("char_count"), F.sha2("content", 256).alias("content_hash"), F.sha2("embedding_text", 256).alias("embedding_text_hash"),
    )


def quality_report(chunks: DataFrame, hard: int = 448) -> DataFrame:
    """One row of counts over chunks."""
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.countDistinct("source_file").alias("source_files"), F.max("token_count").alias("max_tokens"), F.round(F.avg("token_count"), 4).alias("avg_tokens"),
        F.count_if(F.col("token_count") > hard).alias("over_limit"), F.count_if(F.size("section_path") == 0).alias("missing_path"), (F.count("*") - F.countDistinct(F.sha2(strip("content"), 256))).alias("duplicates"),
    )


def path_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.when(F.col("is_indexable"), (F.size("section_path") > 0).cast("double"))), F.lit(1.0)).alias("coverage"))


def file_stats(df: DataFrame, chunks: DataFrame) -> DataFrame:
    a = df.groupBy("source_file").agg(F.count("*").alias("input_blocks"), F.count_if("is_indexable").alias("indexable_blocks"))
    b = chunks.groupBy("source_file").agg(F.count("*").alias("output_chunks"), F.max("token_count").alias("max_tokens"), F.count_if(F.size("section_path") == 0).alias("missing_section_path_chunks"))
    return a.join(b, "source_file", "left").na.fill(0)
