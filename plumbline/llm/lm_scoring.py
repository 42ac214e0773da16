"""Language-model scoring: word counts of all training texts as a base, and a causal self-attention model on subword
ids.

Counting: words of all training rows are counted in tasks and summed in a shuffle; the frequent ones (each at least
one in ``HEAD`` of all tokens, so at most ``HEAD`` of them) are broadcast, the others are joined by word, which no
word can skew since each has less than that share. Subword counts follow from the word counts. Pairs of neighbouring
ids are counted over all training texts as well; the attention model starts from the classes that follow a symbol, and
an id's share of its class comes from the pairs that are at least one in ``PAIRS`` of all, and from the id alone.
Ids are made once, written, and read by pairs, training and scoring; rare words are joined before that, so that what
they shuffle and the ids never lie on disk together.

Training: all training texts, whole, are dealt by the hash of their text into shards of about ``SHARD_WORDS`` words;
every shard starts from one model, fitted on ``WARM`` texts, and improves it on each of its texts, in the order of
their hashes. The shards' weights are averaged in two steps of grouping, in the shards' order. So every training text
is learnt from, no task or driver gathers all models, and neither shards nor sums depend on how tasks are laid out.

Defined cases: a null or empty text has the end token alone; a very long text is learnt from and scored whole, in
slices of ``GROUP_IDS`` ids; a null id counts as the empty string for the split; rows that repeat id and text get the
same scores, each its own row; with no training text, N and V are 0, the base is the add-0.1 estimate of the end token
alone and the model knows no id; an empty table gives no rows; other columns are ignored, clashing names too.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import attention
from plumbline.llm.common import add_columns, table
from plumbline.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: White space that Python, and so any other reader, knows, but for the space.
ODD_SPACE = re.compile(r"[^\S ]")
#: The end of a text among words: no word is empty.
END = b""
HEAD = 50_000
WARM = 300
#: Frequent ids that are a class, or an input symbol, of their own; classes and symbols that the others share.
OWN_CLASSES, SHARED_CLASSES = 96, 32
OWN_SYMBOLS, SHARED_SYMBOLS = 4096, 256
RATE = 0.01
#: Pairs of ids that are kept, at most, and what is taken from each count for pairs not seen.
PAIRS, DISCOUNT = 1_000_000, 0.75
#: Words of a shard, about.
SHARD_WORDS = 500_000
#: Words whose ids a worker remembers at a time, and types that a task counts before it hands them on.
REMEMBERED = 200_000
#: Characters of whole texts, about, whose new words a worker encodes together, and ids whose pairs it counts together.
ENCODED, COUNTED = 1_000_000, 1_000_000
#: Shards whose weights meet in the first step of averaging, and parts into which weights are cut.
TOGETHER, CHUNKS = 256, 16
#: Rows that a worker scores before it hands them on, and ids of whole texts that it learns from or scores at a time.
BATCH = 500
GROUP_IDS = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Words at ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(train: DataFrame) -> DataFrame:
    """word and c over the training texts, with the end tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(words_of(text))
            counts[END] += len(pdf)
            if len(counts) > REMEMBERED:
                yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})
                counts.clear()
        yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})

    return train.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0")


class Subwords:
    """Ids of words; made from the ranks, which are read on the driver. Builds the encoder where it is used."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.end, self.encoder, self.known = ranks, max(ranks.values()) + 1, None, {}
        self.before = {}  # words remembered before the last ones
        self.kind = np.dtype(np.uint16 if self.end < 2**16 else np.int32)  # of packed ids

    @classmethod
    def load(cls, path: str) -> Subwords:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def __getstate__(self):
        return self.__dict__ | {"encoder": None, "known": {}, "before": {}}

    def build(self) -> None:
        import tiktoken

        self.encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.begins = np.zeros(self.end, bool)  # ids that begin with a space
        self.begins[[i for token, i in self.ranks.items() if token[:1] == b" "]] = True

    def remember(self, words: Iterable[bytes]) -> None:
        """Works out the ids of those words that are new together, as one text: each space in it begins a piece, and of
        a word's ids the first alone begins with a space. Words with other white space in them are left to ``ids``."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.before = {}, self.known
        new = [w for w in words if w not in self.known]
        self.known.update((w, self.before[w]) for w in new if w in self.before)
        new = [w for w in new if w not in self.before]
        if self.encoder is None:
            self.build()
        text = b" ".join(new).decode("utf-8", "replace")
        if ODD_SPACE.search(text):
            new = [w for w in new if not ODD_SPACE.search(w.decode("utf-8", "replace"))]
            text = b" ".join(new).decode("utf-8", "replace")
        if new:
            ids = np.array(self.encoder.encode_ordinary(" " + text), self.kind)
            at = [*(np.flatnonzero(self.begins[ids]) * self.kind.itemsize).tolist(), ids.nbytes]
            packed = ids.tobytes()
            self.known.update((w, packed[i:j]) for w, i, j in zip(new, at[:-1], at[1:], strict=True))

    def ids(self, word: bytes) -> bytes:
        """Packed ids of a space and the word."""
        found = self.known.get(word)
        if found is None:
            if self.encoder is None:
                self.build()
            found = array(self.kind.char, self.encoder.encode_ordinary(" " + word.decode("utf-8", "replace"))).tobytes()
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def packed(self, words: list[bytes]) -> bytes:
        """Packed ids of the words and the end."""
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.ids(w) if x is None else x for w, x in zip(words, found, strict=True)]
        found.append(self.kind.type(self.end).tobytes())
        return b"".join(found)

    def unpacked(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, self.kind).astype(np.int32)

    def sequence(self, words: list[bytes]) -> np.ndarray:
        return self.unpacked(self.packed(words))


class Classes:
    """Symbols, classes and in-class shares of ids, from counts of ids and pairs over all training texts."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        n = len(counts)
        self.symbol = np.zeros(n + 1, np.int32)
        self.symbol[order] = np.where(np.arange(n) < OWN_SYMBOLS, np.arange(n), OWN_SYMBOLS + np.arange(n) % SHARED_SYMBOLS)
        self.begin = OWN_SYMBOLS + SHARED_SYMBOLS  # the symbol before the first id
        self.cls = np.zeros(n, np.int32)
        self.cls[order[:OWN_CLASSES]] = np.arange(min(n, OWN_CLASSES))
        rest = order[OWN_CLASSES:]
        mass = np.cumsum(counts[rest] + 0.1)
        self.cls[rest] = OWN_CLASSES + np.minimum((mass / mass[-1] * SHARED_CLASSES).astype(int), SHARED_CLASSES - 1) if len(rest) else 0
        total = np.bincount(self.cls, counts + 0.1, OWN_CLASSES + SHARED_CLASSES)
        self.share = ((counts + 0.1) / total[self.cls]).astype(np.float32)
        self.priors = np.maximum(total / total.sum(), 1e-9)
        cells = (self.begin + 1, len(self.priors))
        self.pairs, self.taken = np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.n, self.left = np.zeros(cells, np.float32), np.zeros(cells, np.float32)
        self.offsets = np.broadcast_to(np.log(self.priors / self.priors.sum()), cells).astype(np.float32)

    def key(self, sym: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return sym.astype(np.int64) * len(self.cls) + ids

    def learn_pairs(self, pairs: np.ndarray, counts: np.ndarray, cells: np.ndarray, n: np.ndarray, types: np.ndarray, held: np.ndarray) -> None:
        """Frequent pairs (sorted keys) with their counts; by cell (symbol, class) all counts, types, and what the
        frequent pairs hold after the discount. What is left of a cell goes to its ids by their own shares."""
        self.pairs, self.taken = pairs, np.maximum(counts - DISCOUNT, 0).astype(np.float32)
        kinds = np.zeros_like(self.n)
        spot = np.divmod(cells, self.n.shape[1])
        self.n[spot], kinds[spot], self.left[spot] = n, types, n - held
        total, kinds, prior = self.n.sum(1, keepdims=True), (kinds > 0).sum(1, keepdims=True), self.priors / self.priors.sum()
        mixed = (np.maximum(self.n - DISCOUNT, 0) + DISCOUNT * kinds * prior) / np.maximum(total, 1)
        self.offsets = np.log(np.where(total > 0, np.maximum(mixed, 1e-12), prior)).astype(np.float32)

    def inside(self, sym: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log share of each id in its class, after the symbol before it; worked out once for equal pairs."""
        key, back = np.unique(self.key(sym, ids), return_inverse=True)
        sym, ids = np.divmod(key, len(self.cls))
        own = self.share[ids]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            taken = np.where(self.pairs[at] == key, self.taken[at], 0)
            cell = (sym, self.cls[ids])
            n = self.n[cell]
            own = np.where(n > 0, (taken + self.left[cell] * own) / np.maximum(n, 1), own)
        return np.log(np.maximum(own, 1e-30))[back]

    def inputs(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols before each id, classes, ids, lengths; sequences laid end to end."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        ids = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
        sym = np.empty(len(ids), np.int32)
        sym[1:] = self.symbol[ids[:-1]]
        sym[np.cumsum(lengths) - lengths] = self.begin
        return sym, self.cls[ids], ids, lengths


def fit_classes(counts: DataFrame, subwords: Subwords) -> Classes:
    """Id counts from the word counts, or from texts' packed ids where those are made; at most one row an id and task
    is shuffled, one row an id comes back."""
    shared = counts.sparkSession.sparkContext.broadcast(subwords)
    size = subwords.end + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub, total = shared.value, np.zeros(size)
        for pdf in batches:
            if "ids" in pdf:
                for group in grouped(map(sub.unpacked, pdf["ids"])):
                    total += np.bincount(np.concatenate(group), minlength=size)
                continue
            parts = [sub.unpacked(sub.ids(w)) if w else np.array([sub.end], np.int32) for w in map(bytes, pdf["word"])]
            if parts:
                total += np.bincount(np.concatenate(parts), np.repeat(pdf["c"].to_numpy(float), [len(p) for p in parts]), size)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    rows = counts.mapInPandas(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[rows["id"]] = rows["n"]
    return Classes(out)


def grouped(sequences: Iterable, most: int | None = None) -> Iterator[list]:
    """All sequences, whole, in groups of some hundred thousand ids, or ``most``, so that many or long texts stay small
    in memory."""
    most = most or GROUP_IDS
    group, size = [], 0
    for s in sequences:
        group.append(s)
        size += len(s)
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, subwords: Subwords) -> DataFrame:
    """``docs`` with packed ids in place of the text, and ``fit``, the hash of the text by which training deals; as it
    is where it has ids."""
    if "ids" in docs.columns:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(subwords)

    def worker():
        sub = shared.value
        return lambda part: [[sub.packed(words_of(text)) for text in part.column("text").to_pylist()]]

    hashed = docs.withColumn("fit", F.xxhash64(F.coalesce("text", F.lit("")), F.lit("fit")))
    return add_columns(hashed, {"ids": (T.BinaryType(), pa.binary())}, worker, BATCH).drop("text")


def fit_pairs(train: DataFrame, subwords: Subwords, classes: Classes) -> None:
    """Counts pairs of a symbol and the id after it over all training texts (text, or ids). What comes back is
    bounded: the frequent pairs, and one row for each symbol and class."""
    train = encode(train, subwords)
    shared = train.sparkSession.sparkContext.broadcast((subwords, classes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub, known = shared.value
        for group in grouped((sub.unpacked(x) for pdf in batches for x in pdf["ids"]), COUNTED):
            sym, _, ids, _ = known.inputs(group)
            keys, n = np.unique(known.key(sym, ids), return_counts=True)
            yield pd.DataFrame({"k": keys, "c": known.cls[keys % len(known.cls)], "n": n})

    counts = materialize(train.select("ids").mapInPandas(run, "k long, c int, n long").groupBy("k", "c").agg(F.sum("n").alias("n")), "pairs")
    total = counts.agg(F.sum("n")).head()[0]
    if total is None:
        return
    frequent = F.col("n") * PAIRS >= total
    kept = counts.filter(frequent).select("k", "n").toPandas().sort_values("k")  # at most PAIRS rows
    cell = (F.floor(F.col("k") / len(classes.cls)) * len(classes.priors) + F.col("c")).cast("long")
    held = F.sum(F.when(frequent, F.greatest(F.col("n") - DISCOUNT, F.lit(0.0))).otherwise(0.0))
    cells = counts.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("types"), held.alias("held")).toPandas().sort_values("cell")
    classes.learn_pairs(kept["k"].to_numpy(), kept["n"].to_numpy(), cells["cell"].to_numpy(), cells["n"].to_numpy(), cells["types"].to_numpy(), cells["held"].to_numpy())


def fit_attention(train: DataFrame, n_words: int, subwords: Subwords, classes: Classes) -> dict[str, np.ndarray]:
    """The averaged model of ``train`` (text, or ids and fit); empty training data leave the fresh one."""
    spark = train.sparkSession
    model = attention.start(classes.begin + 1, len(classes.priors))
    shards = max(1, round(n_words / SHARD_WORDS))
    dealt = encode(train, subwords).select("ids", F.col("fit").alias("h")).withColumn("shard", F.pmod("h", F.lit(shards)))
    warm = dealt.orderBy("h", "ids").limit(WARM).select("ids").collect()
    if not warm:
        return model
    own = attention.Trainer(model, classes.offsets, rate=RATE)
    for group in grouped(subwords.unpacked(r["ids"]) for r in warm):
        sym, cls, _, lengths = classes.inputs(group)
        own.fit(sym, cls, lengths)
    shared = spark.sparkContext.broadcast((subwords, classes, own.p))

    def improve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub, known, begun = shared.value
        trainer, at, held, size = None, None, [], 0

        def learn() -> None:
            nonlocal held, size
            if held:
                s, c, _, n = known.inputs(held)
                trainer.fit(s, c, n)
            held, size = [], 0

        def done() -> pd.DataFrame:
            learn()
            parts = np.array_split(attention.flat(trainer.p).astype(np.float64) * trainer.seen, CHUNKS)
            return pd.DataFrame({"part": range(CHUNKS), "shard": at, "w": float(trainer.seen), "x": [q.tobytes() for q in parts]})

        for pdf in batches:
            for shard, ids in zip(pdf["shard"].to_list(), pdf["ids"], strict=True):
                if shard != at:
                    if trainer is not None:
                        yield done()
                    trainer, at = attention.Trainer(begun, known.offsets, rate=RATE / 2), shard
                held.append(sub.unpacked(ids))
                size += len(held[-1])
                if size > GROUP_IDS:
                    learn()
        if trainer is not None:
            yield done()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        for x in pdf.sort_values("shard")["x"]:
            total = total + np.frombuffer(x)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "shard": pdf["shard"].min(), "w": pdf["w"].sum(), "x": [total.tobytes()]})

    schema = "part long, shard long, w double, x binary"
    models = dealt.repartition(max(shards, spark.sparkContext.defaultParallelism) if shards > 1 else 1, "shard").sortWithinPartitions("shard", "h", "ids").select("shard", "ids").mapInPandas(improve, schema)
    models = materialize(models, "models")  # what was shuffled for training goes
    some = models.withColumn("g", F.floor(F.col("shard") / TOGETHER)).groupBy("part", "g").applyInPandas(add, schema)
    rows = sorted(some.groupBy("part").applyInPandas(add, schema).collect(), key=lambda r: r["part"])  # one model's size
    return attention.unflat(np.concatenate([np.frombuffer(r["x"]) / r["w"] for r in rows]), model)


def base_scores(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The training rows of ``docs`` (with held_out), the word counts over them, N and V."""
    train = docs.filter(~F.col("held_out")).select("text")
    counts = materialize(count_words(train), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    return train, counts, n, v


def text_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "replace")) - 2**63


def rare_words(docs: DataFrame, counts: DataFrame, head: Broadcast, n: int, below: float) -> DataFrame:
    """doc_id, h (hash of the text), and what words that aren't in ``head`` add to seen and base."""

    def worker():
        frequent = head.value

        def step(part: pa.RecordBatch) -> list:
            hashes, tails, times = [], [], []
            for text in part.column("text").to_pylist():
                tail = {w: k for w, k in Counter(words_of(text)).items() if w not in frequent}
                hashes.append(text_hash(text))
                tails.append(list(tail))
                times.append(list(tail.values()))
            return [hashes, tails, times]

        return step

    fields = {"h": (T.LongType(), pa.int64()), "tail": (T.ArrayType(T.BinaryType()), pa.list_(pa.binary())), "times": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}
    found = add_columns(docs, fields, worker, BATCH).select("doc_id", "h", F.explode(F.arrays_zip("tail", "times")).alias("t"))
    rare = found.select("doc_id", "h", F.col("t.tail").alias("word"), F.col("t.times").alias("k"))
    few = counts.filter(F.col("c") * HEAD < n).hint("shuffle_hash")  # a part of them is small; nothing has to be sorted
    return rare.join(few, "word", "left").groupBy("doc_id", "h").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("seen"),
        F.sum(F.col("k") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / F.lit(below))).alias("base"),
    )


def frequent_words(docs: DataFrame, head: Broadcast, subwords: Subwords | None, below: float) -> DataFrame:
    """doc_id, held_out, h, n_tokens, and what the words in ``head`` add to seen and base; with ``subwords`` also ids
    and fit."""
    packing = docs.sparkSession.sparkContext.broadcast(subwords)

    def worker():
        frequent, sub = head.value, packing.value
        logs = {w: np.log10((c + 0.1) / below) for w, c in frequent.items()}
        rare_end = np.log10(0.1 / below)

        def step(part: pa.RecordBatch) -> list:
            out = []
            for texts in grouped((text or "" for text in part.column("text").to_pylist()), ENCODED):
                split = [words_of(text) for text in texts]
                counters = [Counter(words) for words in split]
                if sub:
                    sub.remember(set().union(*counters))
                for text, words, counter in zip(texts, split, counters, strict=True):
                    base, seen = logs.get(END, rare_end), int(END in logs)
                    for w, k in counter.items():
                        one = logs.get(w)
                        if one is not None:
                            base += k * one
                            seen += k
                    out.append((text_hash(text), len(words) + 1, seen, float(base), sub.packed(words) if sub else None))
            return [list(c) for c in zip(*out, strict=True)][: len(fields)]

        return step

    fields = {"h": (T.LongType(), pa.int64()), "n_tokens": (T.LongType(), pa.int64()), "seen": (T.LongType(), pa.int64()), "base": (T.DoubleType(), pa.float64())}
    if subwords:
        fields["ids"] = (T.BinaryType(), pa.binary())
        docs = docs.withColumn("fit", F.xxhash64(F.coalesce("text", F.lit("")), F.lit("fit")))
    return add_columns(docs, fields, worker, BATCH).drop("text")


def score(docs: DataFrame, *, vocabulary: str = VOCABULARY, attended: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text).
    Not ``attended``: the word counts alone, score is 0."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out())
    train, counts, n, v = base_scores(docs)
    below = n + 0.1 * (v + 1)
    head = {bytes(r["word"]): r["c"] for r in counts.filter(F.col("c") * HEAD >= n).collect()}  # at most HEAD rows
    shared = spark.sparkContext.broadcast(head)
    rare = materialize(rare_words(docs.drop("held_out"), counts, shared, n, below), "rare")
    subwords = Subwords.load(vocabulary) if attended else None
    known = materialize(frequent_words(docs, shared, subwords, below), "known")
    scored = known.withColumn("score", F.lit(0.0))
    if attended:
        train = known.filter(~F.col("held_out")).select("ids", "fit")
        classes = fit_classes(train.select("ids"), subwords)
        fit_pairs(train, subwords, classes)
        model = spark.sparkContext.broadcast((subwords, classes, fit_attention(train, n, subwords, classes)))

        def worker():
            sub, fitted, weights = model.value

            def step(part: pa.RecordBatch) -> list:
                scores = []
                for group in grouped(map(sub.unpacked, part.column("ids").to_pylist())):
                    sym, cls, ids, lengths = fitted.inputs(group)
                    log = attention.score(weights, fitted.offsets, sym, cls, lengths) + fitted.inside(sym, ids)
                    scores += (np.add.reduceat(log.astype(np.float64), np.cumsum(lengths) - lengths) / np.log(10)).tolist()
                return [scores]

            return step

        scored = materialize(add_columns(known, {"score": (T.DoubleType(), pa.float64())}, worker, BATCH).drop("ids", "fit"), "scored")
    # Rows with the same id and text meet in one group; their sums are as many times one row's.
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = scored.select("doc_id", "h", F.lit(1).alias("rows"), "held_out", "n_tokens", "seen", "base", "score").unionByName(
        rare.select("doc_id", "h", F.lit(0).alias("rows"), empty("held_out", "boolean"), empty("n_tokens", "long"), "seen", "base", empty("score", "double"))
    )
    met = both.groupBy("doc_id", "h").agg(
        F.sum("rows").cast("int").alias("rows"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("seen").alias("seen"), F.sum("base").alias("base"), F.max("score").alias("score"),
    )
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "held_out", "n_tokens", F.expr("seen div rows").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def word_count_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7, which SQL can work out as well."""
    found = score(table(spark, sf_dir, "documents").select("doc_id", "text"), attended=False)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(c, ascii(ch)))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ch), lambda c, ch: {bits}, 4294967295), 4294967295)"


COUNT_SCORES_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN doc_id IS NULL THEN 0 ELSE {_crc32_sql("CAST(doc_id AS VARCHAR)")} END % 10 = 0 AS held_out,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ['']) AS w
  FROM documents),
tok AS (SELECT doc_id, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM tok WHERE NOT held_out GROUP BY word),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 5) AS base_score
FROM tok LEFT JOIN c USING (word) CROSS JOIN n GROUP BY doc_id, held_out
"""
