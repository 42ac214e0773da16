"""Files of a corpus: revisions, supersession, identifiers, rendered rows, fingerprints, transcripts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.paths import family_and_revision, name_withdrawn, walk_key, walked
from plumbline.functions.text import identifiers

#: Identifiers in more files than this link nothing.
MOST_FILES = 12


def with_revisions(files: DataFrame, strict: bool = False) -> DataFrame:
    """Adds family, revision and withdrawn (by name, or already set)."""
    family, revision = family_and_revision(F.col("path"))
    before = F.col("withdrawn") if "withdrawn" in files.columns else F.lit(False)
    return files.withColumns({"family": family, "revision": revision, "withdrawn": before | name_withdrawn(F.col("path"), strict)})


def mark_superseded(files: DataFrame) -> DataFrame:
    """Adds superseded_by and superseded: the newest current member of the family replaces withdrawn and older
    ones; files that are not indexed neither replace nor are replaced."""
    current = files.filter(F.col("indexed") & ~F.col("withdrawn"))
    newest = current.withColumn("_n", F.row_number().over(Window.partitionBy("family").orderBy(F.col("revision").desc(), walk_key(F.col("path"))))).filter("_n = 1")
    newest = newest.select("family", F.col("path").alias("_newest"), F.col("revision").alias("_revision"))
    older = F.col("indexed") & (F.col("path") != F.col("_newest")) & (F.col("withdrawn") | (F.col("revision") < F.col("_revision")))
    out = files.join(newest, "family", "left").withColumn("superseded_by", F.when(older, F.col("_newest")))
    return out.withColumn("superseded", F.col("withdrawn") | F.col("superseded_by").isNotNull()).drop("_newest", "_revision")


def identifier_files(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """ident and its files (sorted), for identifiers in at most ``most`` files; a count comes first, so that no frequent
    identifier's files are gathered."""
    found = files.select("path", F.explode(identifiers(F.col("text"))).alias("ident")).distinct()
    rare = found.groupBy("ident").agg(F.count("*").alias("n_files")).filter(F.col("n_files") <= most)
    return found.join(rare, "ident").groupBy("ident").agg(F.array_sort(F.collect_list("path")).alias("files"), F.max("n_files").alias("n_files"))


def cell(value: Column, kind: str) -> Column:
    """A table cell as text: null empty, whole doubles without a fraction, times to the second."""
    if kind in ("double", "float"):
        text = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    elif kind.startswith("timestamp"):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    else:
        text = F.trim(value.cast("string"))
    return F.coalesce(text, F.lit(""))


def row_segments(rows: DataFrame, prefix: str) -> DataFrame:
    """segment: each row rendered as ``prefix | name: value | ...`` without its empty cells."""
    kinds = dict(rows.dtypes)
    parts = [F.when(cell(F.col(c), kinds[c]) != "", F.concat(F.lit(f"{c}: "), cell(F.col(c), kinds[c]))) for c in rows.columns]
    return rows.withColumn("segment", F.concat_ws(" | ", F.lit(prefix), *parts))


def folder_fingerprints(files: DataFrame) -> DataFrame:
    """folder and sha1 over ``path:size`` lines in walk order. By folder, so that no task reads all files; a folder's
    lines are sorted by Spark and hashed as they come, so that none has to hold them."""
    folder = F.regexp_extract("path", r"^([^/]*)/", 1)
    line = F.concat("path", F.lit(":"), F.coalesce(F.col("size"), F.lit(-1)).cast("string"), F.lit("\n"))
    kept = files.filter(walked(F.col("path"))).select(folder.alias("folder"), walk_key(F.col("path")).alias("k"), line.alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, digest, n = None, hashlib.sha1(), 0
        for pdf in batches:
            done = []
            for own, text in zip(pdf["folder"], pdf["line"], strict=True):
                if own != name:
                    if n:
                        done.append((name, digest.hexdigest(), n))
                    name, digest, n = own, hashlib.sha1(), 0
                digest.update(text.encode("utf-8", "replace"))
                n += 1
            yield pd.DataFrame(done, columns=["folder", "fingerprint", "n_files"])
        if n:
            yield pd.DataFrame([(name, digest.hexdigest(), n)], columns=["folder", "fingerprint", "n_files"])

    ordered = kept.repartition("folder").sortWithinPartitions("folder", "k", "line").select("folder", "line")
    return ordered.mapInPandas(run, "folder string, fingerprint string, n_files long")


def corpus_fingerprint(files: DataFrame, digits: int = 3) -> DataFrame:
    """One row, fingerprint and n_files, of all files (path, size), in two levels: files are dealt by the first digits of
    their paths' hash, SHA-1 over ``path:size`` lines in walk order is each share's digest, and SHA-1 over the shares'
    digests in order the whole's. A share holds one in 16^digits of the files, whatever folder they are in."""
    line = F.concat("path", F.lit(":"), F.coalesce(F.col("size"), F.lit(-1)).cast("string"), F.lit("\n"))
    kept = files.filter(walked(F.col("path"))).select(F.substring(F.md5(F.col("path").cast("binary")), 1, digits).alias("share"), F.struct(walk_key(F.col("path")).alias("k"), line.alias("line")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "")
    shares = kept.groupBy("share").agg(F.sha1(joined.cast("binary")).alias("digest"), F.count("*").alias("n"))
    # A short row a share: their number doesn't grow.
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("share", "digest"))), lambda x: x["digest"]), "")
    return shares.agg(F.sha1(whole.cast("binary")).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def reuse_transcripts(images: DataFrame, previous: DataFrame) -> DataFrame:
    """Images with their earlier non-empty transcript where there is one, else the new one."""
    old = previous.filter(F.trim("text") != "").select("path", F.col("text").alias("_old"))
    return images.join(old, "path", "left").withColumn("reused", F.col("_old").isNotNull()).withColumn("text", F.coalesce("_old", "text")).drop("_old")
