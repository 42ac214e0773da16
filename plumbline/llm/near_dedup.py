"""Near-duplicate detection by min-max hashing, confirmed on full sets, with connected components.

Sketch: a document's set of word shingles is hashed to 64 bits; under each permutation both the minimum and the
maximum are kept, so half the permutations fill a signature. Groups of ``ROWS`` minima (or maxima) are bands; the
number of bands is chosen so that a pair at the threshold misses all of them with probability under ``MISS``.

Equal sets fall together first (a 128-bit fingerprint), so exact copies are one node. Nodes have one order, by hash,
and the first of a bucket is its hub. Links are sought in three steps, each over what the one before left open:

1. every node against one hub, the first in order of all its buckets' hubs: at most one pair a node, so a group of m
   near copies gives at most m pairs;
2. in buckets whose members are then still in different components, members against their bucket's hub where their
   components differ;
3. in buckets that still hold two components, all pairs of different components, in blocks of at most ``BLOCK``
   members a side: each pair in the first bucket that it shares, none left out, and only links leave the task.

So all links between different texts that share a bucket count, and no step emits all pairs of a group. A bucket that
holds many rows is joined with its hub, one row, which adaptive execution splits where a task would grow large.

Defined cases: a null text, or one without words, has no set, size 0, and is linked with nothing; a very long text
is one set, whole, hashed in slices; a null id takes part, is never the smallest, and stands for its component only
where there is no other id; rows that repeat an id are members each for itself; texts of equal sets tie and the
smallest id is kept; an empty table gives no rows; other columns pass through ``deduplicate``, clashing names are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import add_columns, table
from plumbline.session import materialize

ROWS = 5
MISS = 1e-7
BLOCK = 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands (an even number: half of minima, half of maxima) that keep a miss at ``threshold`` under ``miss``."""
    return 2 * math.ceil(math.log(miss) / math.log(1 - threshold**rows) / 2)


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of a text, sorted. Words are split at ASCII white space, A-Z lower-cased."""

    def __init__(self, k: int, memory: int = 500_000):
        self.k, self.memory, self.known = k, memory, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > self.memory:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n, k = len(a), min(self.k, len(a))
        if not n:
            return a
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = _final(h * _MIX[0] + a[j : n - k + 1 + j] * _MIX[1 + j % 6])
        return np.unique(h)


def linked(x: np.ndarray, y: np.ndarray, threshold: Fraction) -> bool:
    """Whether intersection / union reaches the threshold, in whole numbers."""
    if min(len(x), len(y)) * threshold.denominator < threshold.numerator * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both * threshold.denominator >= threshold.numerator * (len(x) + len(y) - both)


def bands_of(hashes: np.ndarray, bands: int, rows: int, factors: np.ndarray) -> np.ndarray:
    """The bands' 64-bit keys; the band's number is mixed in. A permutation is a product with an odd factor, whose
    leading bits, which decide, depend on all bits of the (already mixed) hash."""
    low, high = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(factors), np.uint64)
    for i in range(0, len(hashes), 2048):
        v = factors[:, None] * hashes[None, i : i + 2048]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    signature = np.concatenate([low, high]).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = _final(key * _MIX[0] + signature[:, j] * _MIX[1 + j])
    return key.view(np.int64)


def _factors(bands: int, rows: int) -> np.ndarray:
    return _final(np.arange(1, bands * rows // 2 + 1, dtype=np.uint64) * _MIX[3]) | np.uint64(1)


#: Sets that a task remembers to tell copies it has had.
REMEMBERED = 200_000


def sketch(docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Adds _rid (a number for the row), _n (set size), _fp (fingerprint; null for none), _bands, and _first: whether
    a set is new to the task, so that copies of one text needn't meet in a shuffle."""
    bands = n_bands(float(threshold))

    def worker():
        shingle, factors = Shingler(k), _factors(bands, ROWS)
        seen: set[bytes] = set()

        def step(part: pa.RecordBatch) -> list:
            if len(seen) > REMEMBERED:
                seen.clear()
            n, fps, keys, new = [], [], [], []
            for text in part.column("text").to_pylist():
                s = shingle(text)
                fp = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                n.append(len(s))
                fps.append(fp)
                keys.append(bands_of(s, bands, ROWS, factors) if len(s) else None)
                new.append(fp is not None and fp not in seen)
                seen.add(fp)
            return [n, fps, keys, new]

        return step

    fields = {
        "_n": (T.LongType(), pa.int64()), "_fp": (T.BinaryType(), pa.binary()),
        "_bands": (T.ArrayType(T.LongType()), pa.list_(pa.int64())), "_first": (T.BooleanType(), pa.bool_()),
    }
    return add_columns(docs, fields, worker).withColumn("_rid", F.monotonically_increasing_id())


def components(links: DataFrame) -> DataFrame:
    """fp and label (the smallest fp that is reachable) for all ends of ``links`` (a, z): labels sink to the minimum
    of the neighbours' labels and then jump to their label's label, until nothing changes. Each round is written."""
    both = materialize(links.select("a", "z").unionAll(links.select(F.col("z").alias("a"), F.col("a").alias("z"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("z").alias("z")).select(F.col("a").alias("fp"), F.least("a", "z").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("z") == F.col("fp")).groupBy("a").agg(F.min("label").alias("seen"))
        sunk = labels.join(near, F.col("fp") == F.col("a")).select("fp", F.least("label", "seen").alias("low"), F.col("label").alias("old"))
        over = labels.select(F.col("fp").alias("of"), F.col("label").alias("next"))
        jumped = materialize(sunk.join(over, F.col("low") == F.col("of")).select("fp", F.least("low", "next").alias("label"), "old"), "labels")
        labels = jumped.select("fp", "label")
        if jumped.filter(F.col("label") != F.col("old")).isEmpty():
            return labels


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, z) whose full sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(k)
        for pdf in batches:
            sets: dict[bytes, np.ndarray] = {}
            keep = []
            for a, z, x, y in zip(pdf["a"], pdf["z"], pdf["x"], pdf["y"], strict=True):
                for key, text in ((a, x), (z, y)):
                    if key not in sets:
                        sets[key] = shingle(text)
                keep.append(linked(sets[a], sets[z], threshold))
            yield pdf.loc[keep, ["a", "z"]]

    x, y = texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), texts.select(F.col("fp").alias("z"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "z").select("a", "z", "x", "y").mapInPandas(run, "a binary, z binary")


def _links_within(group: list[tuple], k: Shingler, threshold: Fraction) -> list[tuple[bytes, bytes]]:
    """Links between different labels among one block's members (b, i, j, blk, fp, n, label, bands, text)."""
    b, across = group[0][0], group[0][1] != group[0][2]
    bands = np.stack([g[7] for g in group])
    place = int(np.argmax(bands[0] == b))
    side, n = np.array([g[3] for g in group]), np.array([g[5] for g in group])
    numbers: dict[bytes, int] = {}
    code = np.array([numbers.setdefault(g[6], len(numbers)) for g in group])
    if len(numbers) < 2:
        return []
    sets: dict[int, np.ndarray] = {}
    found = []
    for r in range(len(group) - 1):
        fits = (code[r + 1 :] != code[r]) & (np.minimum(n[r + 1 :], n[r]) * threshold.denominator >= threshold.numerator * np.maximum(n[r + 1 :], n[r]))
        if across:
            fits &= side[r + 1 :] != side[r]
        s = r + 1 + np.flatnonzero(fits)
        s = s[~(bands[s, :place] == bands[r, :place]).any(axis=1)]  # the first bucket that they share is this one
        for q in s:
            if code[q] == code[r]:
                continue
            for t in (r, q):
                if t not in sets:
                    sets[t] = k(group[t][8])
            if linked(sets[r], sets[q], threshold):
                found.append((group[r][4], group[q][4]))
                code[code == code[q]] = code[r]  # joined now: their other pairs don't matter
    return found


def _searched(members: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Links found in all blocks. Blocks are dealt out whole and read one after the other, at most 2 * BLOCK rows at
    a time, since most of them are far too small for a call each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, group = Shingler(k), []
        for pdf in batches:
            found = []
            for row in zip(*(pdf[c].to_list() for c in pdf.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    found += _links_within(group, shingle, threshold)
                    group = []
                group.append(row)
            yield pd.DataFrame(found, columns=["a", "z"])
        if group:
            yield pd.DataFrame(_links_within(group, shingle, threshold), columns=["a", "z"])

    return members.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j").mapInPandas(run, "a binary, z binary")


def _long_enough(a: str, z: str, threshold: Fraction) -> Column:
    """Sets of sizes a and z can reach the threshold at all."""
    return F.least(a, z) * threshold.denominator >= F.greatest(a, z) * threshold.numerator


def _with_hub(rows: DataFrame) -> DataFrame:
    """``rows`` (b, fp, n, ...) with hub and hub_n: the first node of each bucket by hash. The hubs are written first,
    one row a bucket, so that adaptive execution can split a large bucket's side of the join."""
    first = F.min(F.struct(F.xxhash64("fp").alias("draw"), "fp", "n")).alias("hub")
    hubs = materialize(rows.groupBy("b").agg(first, F.count("*").alias("c")).filter("c > 1").select("b", "c", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    return rows.join(hubs, "b")


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (b, fp, n, hub, hub_n, c) of buckets that hold two components, with their label."""
    labelled = materialize(members.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    mixed = materialize(labelled.groupBy("b").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("b"), "open")
    return labelled.join(mixed, "b", "left_semi")


def _labelled(docs: DataFrame, k: int, threshold: Fraction, block: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, written once, and fp, lead (smallest id) and label for each distinct set."""
    rows = materialize(sketch(docs, k, threshold), "sketch")
    some = rows.filter("_n > 0").select("doc_id", F.col("_n").alias("n"), F.col("_fp").alias("fp"), F.col("_bands").alias("bands"), "_first", "text")
    nodes = materialize(some.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    shared = materialize(_with_hub(nodes.select("fp", "n", F.explode("bands").alias("b"))), "shared")
    wanted = shared.select("fp").distinct()
    # One text a node: copies of a set share all its shingles, so any of their texts will do.
    texts = some.filter("_first").select("fp", "text").join(wanted, "fp", "left_semi")
    texts = materialize(texts.groupBy("fp").agg(F.first("text").alias("text")), "texts")

    to_hub = shared.filter((F.col("fp") != F.col("hub")) & _long_enough("n", "hub_n", threshold))
    one = to_hub.groupBy("fp").agg(F.min(F.struct(F.xxhash64("hub").alias("draw"), "hub")).alias("best")).select(F.col("fp").alias("a"), F.col("best.hub").alias("z"))
    links = materialize(_confirmed(one, texts, k, threshold), "links")
    labels = components(links)

    left = materialize(_still_open(shared, labels), "left")
    of_hub = left.filter("fp = hub").select("b", F.col("label").alias("hub_label"))
    apart = left.filter((F.col("fp") != F.col("hub")) & _long_enough("n", "hub_n", threshold)).join(of_hub, "b").filter("label != hub_label")
    more = materialize(_confirmed(apart.select(F.col("fp").alias("a"), F.col("hub").alias("z")).distinct().join(one, ["a", "z"], "left_anti"), texts, k, threshold), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        labels = components(links)
        left = materialize(_still_open(left.drop("label"), labels), "left")

    blocks = F.ceil(F.col("c") / block).cast("int")
    members = (
        left.join(nodes.select("fp", "bands"), "fp")
        .join(texts, "fp")
        .withColumn("blk", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("b", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "fp", "n", "label", "bands", "text")
    )
    rest = materialize(_searched(members, k, threshold), "links")
    if not rest.isEmpty():
        labels = components(links.unionAll(rest))
    return rows.drop("_bands", "_first"), nodes.select("fp", "lead").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def link_components(docs: DataFrame, *, k: int = 5, threshold: Fraction = Fraction(4, 5), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    rows, leads = _labelled(docs.select("doc_id", "text"), k, threshold, block)
    # One row a set, written before it meets the rows, so that a set with many copies can be split there.
    least = materialize(leads.join(leads.groupBy("label").agg(F.min("lead").alias("least")), "label").select(F.col("fp").alias("_fp"), "least"), "least")
    named = rows.select("doc_id", F.col("_n").alias("n_shingles"), "_fp").join(least, "_fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, *, k: int = 5, threshold: Fraction = Fraction(4, 5), block: int = BLOCK) -> DataFrame:
    """``docs`` with one row for each component, that of the smallest id (null last); rows without words all stay."""
    docs = docs.drop("_n", "_fp", "_bands", "_first", "_rid")
    rows, leads = _labelled(docs, k, threshold, block)
    # The choice is made on ids alone, first within each set, so that copies are combined before they are shuffled;
    # whole rows move once, to meet the chosen numbers.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))
    in_set = rows.filter("_n > 0").groupBy("_fp").agg(F.min(order).alias("best"))
    best = in_set.join(leads.select(F.col("fp").alias("_fp"), "label"), "_fp").groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.rid").alias("_rid"))
    return rows.filter("_n > 0").join(best, "_rid", "left_semi").select(*docs.columns).unionByName(rows.filter("_n = 0").select(*docs.columns))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_components(docs, k=3, threshold=Fraction(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")
