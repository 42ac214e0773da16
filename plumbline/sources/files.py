"""Reading a folder of files: decoding, parsing, segments. Parsers for office formats use the standard library."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.arrow import add_columns
from plumbline.functions.paths import SUFFIXES, WITHDRAWN, kind_of, walked
from plumbline.sources import office

# How much of a text and how many rows of a table are read, where a text says that it is withdrawn, and
# why a file has no text.
MOST_BYTES = 32 * 1024 * 1024
MOST_ROWS = 200_000
HEAD_CHARS = 2000
UNKNOWN, IMAGE, UNREADABLE, EMPTY, NO_TEXT = "unknown file type", "image (needs the vision model)", "unreadable (permission denied)", "empty file", "no extractable text"
#: There is no PDF parser here.
NO_PDF = "pdf: parser unavailable"
_WITHDRAWN = re.compile(WITHDRAWN)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size and content of a folder's files, without ignored folders. By Spark's own reader, which any
    store will do for, but which leaves out names that begin with a dot or an underscore and stops at what it may not
    read; ``folder.scan`` does neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "")
    return files.select(base.alias("path"), F.col("length").alias("size"), "content").filter(walked(F.col("path")))


def decode_bytes(raw: bytes) -> str:
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("utf-8-sig", "replace")


def kind_by(path: str, head: bytes) -> str | None:
    """As ``paths.kind_of``, for one file: by suffix, else by the first bytes."""
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    named = next((kind for kind, names in SUFFIXES.items() if suffix in names), None)
    return named or ("pdf" if head.startswith(b"%PDF-") else "image" if head.startswith((b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff")) else None)


def render_rows(rows: Iterable[list[str]], prefix: str) -> list[tuple[str, str]]:
    """(locator, text): the first row with a cell is the header, later ones name their cells; blank rows only count."""
    out: list[tuple[str, str]] = []
    header: list[str] | None = None
    for number, row in enumerate(rows, 1):
        if number > MOST_ROWS:
            break
        cells = [(c or "").strip() for c in row]
        if not any(cells):
            continue
        if header is None:
            header = [c or f"col{i}" for i, c in enumerate(cells, 1)]
            out.append((f"{prefix} row {number}", " | ".join([f"{prefix} header", *cells])))
            continue
        named = [f"{header[i]}: {c}" if i < len(header) else c for i, c in enumerate(cells) if c]
        out.append((f"{prefix} row {number}", " | ".join([prefix, *named])))
    return out


def _csv(text: str, stem: str) -> list[tuple[str, str]]:
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    return render_rows(csv.reader(io.StringIO(text), dialect), stem)


def _docx(raw: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    tables = 0
    for kind, found in office.blocks(raw):
        if kind == "table":
            tables += 1
            out += render_rows(found, f"table {tables}")
        else:
            out.append((kind, found))
    return out


def _xlsx(raw: bytes) -> list[tuple[str, str]]:
    return [segment for title, rows in office.sheets(raw) for segment in render_rows(rows, f"sheet {title}")]


def parse_one(path: str, kind: str | None, raw: bytes) -> tuple[list[tuple[str, str]], str | None, bool]:
    """(locator, text) segments, why there are none, and whether the text says it is withdrawn. Never raises."""
    name = path.rsplit("/", 1)[-1]
    refused = {None: UNKNOWN, "image": IMAGE, "pdf": NO_PDF}
    if kind in refused:
        return [], refused[kind], False
    try:
        if kind in ("text", "csv"):
            text = decode_bytes(raw[:MOST_BYTES])
            if not text.strip():
                return [], EMPTY, False
            if kind == "text":
                text = text.replace("\r\n", "\n")
                return [(name, text)], None, bool(_WITHDRAWN.search(text[:HEAD_CHARS]))
            segments = _csv(text, name.rsplit(".", 1)[0])
        else:
            segments = _docx(raw) if kind == "docx" else _xlsx(raw)
    except Exception as e:  # a damaged file is a reason, not an error
        return [], f"{kind}: {type(e).__name__}: {str(e)[:120]}", False
    return segments, None if segments else NO_TEXT, bool(segments) and kind == "docx" and bool(_WITHDRAWN.search(segments[0][1][:HEAD_CHARS]))


SEGMENTS = (T.ArrayType(T.StructType([T.StructField("locator", T.StringType()), T.StructField("text", T.StringType())])), pa.list_(pa.struct([("locator", pa.string()), ("text", pa.string())])))
#: Files that a task parses at a time.
AT_ONCE = 8


def parse_files(files: DataFrame) -> DataFrame:
    """path, kind, segments (array<struct<locator, text>>), skipped and withdrawn for path and content."""

    def step(part: pa.RecordBatch) -> list:
        rows = zip(*(part.column(c).to_pylist() for c in ("path", "kind", "content")), strict=True)
        out = [parse_one(p, k, c) if c is not None else ([], UNREADABLE, False) for p, k, c in rows]
        return [[[{"locator": a, "text": b} for a, b in s] for s, _, _ in out], [w for _, w, _ in out], [w for _, _, w in out]]

    named = files.select("path", kind_of(F.col("path"), F.col("content")).alias("kind"), "content")
    fields = {"segments": SEGMENTS, "skipped": (T.StringType(), pa.string()), "withdrawn": (T.BooleanType(), pa.bool_())}
    return add_columns(named, fields, lambda: step, AT_ONCE).drop("content")


def documents_of(parsed: DataFrame) -> DataFrame:
    """path, indexed, withdrawn and the whole text (segments joined by lines)."""
    return parsed.select("path", (F.size("segments") > 0).alias("indexed"), "withdrawn", F.array_join(F.transform("segments", lambda s: s["text"]), "\n").alias("text"))
