"""Functions of file paths: kind, revision, walk order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes by kind.
SUFFIXES = {
    "pdf": ["pdf"],
    "docx": ["docx", "docm"],
    "xlsx": ["xlsx", "xlsm"],
    "csv": ["csv"],
    "image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif"],
    "text": ["txt", "log", "md", "rst", "py", "json", "yaml", "yml", "ini", "cfg", "toml", "xml", "html", "htm", "tsv", "sql", "js", "ts", "sh", "conf"],
}
# Folders that a walk leaves out; words that withdraw a document, in names and in texts; how names give
# a revision.
IGNORED = ["__pycache__", ".git", ".svn", ".hg", "node_modules", ".ipynb_checkpoints"]
STATUS = r"[_\-. ]*(withdrawn|superseded|obsolete|deprecated|draft|archived?|old)"
STATUS_STRICT = r"(?:^|[_\-. ]+)(withdrawn|superseded|obsolete|deprecated|draft|archived?|old)(?=$|[_\-. ])"
REVISION = r"[_\-. ]+(?:rev(?:ision)?|r|v|version)[_\-. ]?([0-9]+[a-z]?[0-9]*|[a-z][0-9]*)$"
WITHDRAWN = r"(?i)\b(withdrawn|superseded|obsolete|do not use)\b"


def kind_of(path: Column, head: Column | None = None) -> Column:
    """By suffix, else by the first bytes (a binary column), else null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    if head is not None:
        start = F.hex(F.substring(head, 1, 8))
        out = F.when(F.startswith(start, F.lit("255044462D")), "pdf").when(F.startswith(start, F.lit("89504E470D0A1A0A")) | F.startswith(start, F.lit("FFD8FF")), "image")
    for kind, names in SUFFIXES.items():
        out = F.when(suffix.isin(names), F.lit(kind)).otherwise(out)
    return out


def looks_withdrawn(text: Column) -> Column:
    """Whether the first 2000 characters say so."""
    return F.substring(text, 1, 2000).rlike(WITHDRAWN)


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]+$", "")


def name_withdrawn(path: Column, strict: bool = False) -> Column:
    return _stem(path).rlike("(?i)" + (STATUS_STRICT if strict else STATUS))


def revision_key(token: Column) -> Column:
    """Letters' places summed, then the digit groups, of up to 38 digits: newer keys are larger arrays."""
    letters = F.split(F.regexp_replace(F.lower(token), "[^a-z]", ""), "")
    value = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda s, c: s + F.ascii(c) - 96)
    return F.concat(F.array(value.cast("decimal(38,0)")), F.transform(F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("decimal(38,0)")))


def family_and_revision(path: Column) -> tuple[Column, Column]:
    """The document family (folder and bare name; the suffix doesn't count) and the revision key."""
    bare = F.regexp_replace(_stem(path), f"(?i){STATUS}", "")
    token = F.regexp_extract(bare, f"(?i){REVISION}", 1)
    name = F.regexp_replace(F.lower(F.regexp_replace(bare, f"(?i){REVISION}", "")), r"^[_\-. ]+|[_\-. ]+$", "")
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.concat(folder, name), F.when(token == "", F.array(F.lit(0).cast("decimal(38,0)"))).otherwise(revision_key(token))


def walk_key(path: Column) -> Column:
    """Sorts a folder's files before its folders, each by name."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p)), "\u0001")


def walked(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda p: p.isin(IGNORED))
