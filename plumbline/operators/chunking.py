"""Chunkers: sections, packed paragraphs, packed lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.arrow import add_columns

HEADING = r"^(#{1,6})\s+(.*)$"
#: A line of number signs alone takes the next line that isn't blank as its heading.
BARE = r"(?m)^(#{1,6})[^\S\n]*\n\s*(\S.*)$"


def split_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, heading, body: markdown sections in order; empty bodies dropped, text before the first
    heading has an empty one, and a text without headings is one section as it stands. Each row by itself, without a
    shuffle: the places of headings cut its lines into slices."""
    lines = docs.select("doc_id", F.split(F.regexp_replace("text", BARE, "$1 $2"), "\n").alias("lines"))
    heads = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
    cut = lines.withColumn("heads", heads)
    begins, ends = F.concat(F.array(F.lit(-1)), "heads"), F.concat("heads", F.array(F.size("lines")))
    parts = F.zip_with(begins, ends, lambda b, e: F.struct(F.get("lines", b).alias("head"), F.array_join(F.slice("lines", b + 2, e - b - 1), "\n").alias("body")))
    sections = cut.select("doc_id", F.posexplode(parts).alias("no", "s"))
    return sections.select(
        "doc_id", F.col("no").cast("long").alias("section_no"), F.when(F.col("no") > 0, F.trim(F.regexp_extract("s.head", HEADING, 2))).otherwise(F.lit("")).alias("heading"), F.regexp_replace("s.body", r"^\s+|\s+$", "").alias("body"),
    ).filter(F.col("body") != "")


def pack_paragraphs(body: str, target: int, overlap: int) -> list[str]:
    """Whole paragraphs up to ``target`` pieces; a new chunk begins with the last paragraphs worth ``overlap``."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for text in filter(None, map(str.strip, re.split(r"\n\s*\n", body))):
        n = len(text.split())
        if held and sum(k for _, k in held) + n > target:
            out.append("\n\n".join(t for t, _ in held))
            tail, size = [], 0
            while held and size < overlap:
                tail.insert(0, held.pop())
                size += tail[0][1]
            held = tail
        held.append((text, n))
    return [*out, "\n\n".join(t for t, _ in held)] if held else out


def chunk_documents(sections: DataFrame, target: int = 180, overlap: int = 30) -> DataFrame:
    """chunk_id (document and running place), doc_id, section, position, text."""
    rows = sections.select("doc_id", "section_no", "heading", F.coalesce("body", F.lit("")).alias("body"))
    parts = {"parts": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}
    packed = add_columns(rows, parts, lambda: lambda part: [[pack_paragraphs(b, target, overlap) for b in part.column("body").to_pylist()]])
    listed = packed.select("doc_id", "section_no", F.col("heading").alias("section"), F.posexplode("parts").alias("_p", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "_p")) - 1
    return listed.withColumn("position", place).select(F.format_string("%s::%04d", F.col("doc_id").cast("string"), "position").alias("chunk_id"), "doc_id", "section", "position", "text")


def pack_lines(text: str, locator: str | None, target: int) -> list[tuple[str, str]]:
    """(locator, text) of groups of lines up to ``target`` pieces, each with the last piece of the one before."""
    pieces: list[tuple[int, str, int]] = []
    for number, line in enumerate((x for x in text.split("\n") if x.strip()), 1):
        words = line.split()
        if len(words) > target:
            pieces += [(number, " ".join(words[i : i + target]), len(words[i : i + target])) for i in range(0, len(words), target)]
        else:
            pieces.append((number, line, len(words)))
    groups: list[list[tuple[int, str, int]]] = []
    held: list[tuple[int, str, int]] = []
    fresh = False
    for piece in pieces:
        if held and fresh and sum(p[2] for p in held) + piece[2] > target:
            groups.append(held)
            held = held[-1:]
        held, fresh = [*held, piece], True
    if held and fresh:
        groups.append(held)
    locator = locator or ""
    name = lambda g: f"{locator} lines {g[0][0]}-{g[-1][0]}".strip() if len(groups) > 1 else locator
    return [(name(g), "\n".join(p[1] for p in g)) for g in groups]


def chunk_lines(segments: DataFrame, target: int = 170) -> DataFrame:
    """piece_no, locator and text of the pieces of segments (locator, text), beside all other columns."""
    others = [c for c in segments.columns if c not in ("locator", "text")]
    parts = {"parts": (T.ArrayType(T.StructType([T.StructField("locator", T.StringType()), T.StructField("text", T.StringType())])), pa.list_(pa.struct([("locator", pa.string()), ("text", pa.string())])))}

    def step(part: pa.RecordBatch) -> list:
        texts, locators = part.column("text").to_pylist(), part.column("locator").to_pylist()
        return [[[{"locator": a, "text": b} for a, b in pack_lines(t or "", loc, target)] for t, loc in zip(texts, locators, strict=True)]]

    packed = add_columns(segments, parts, lambda: step)
    return packed.select(*others, F.posexplode("parts").alias("piece_no", "p")).select(*others, "piece_no", "p.locator", "p.text")
