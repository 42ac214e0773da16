"""Personal data: rule spans, and candidates that boosted trees accept.

High-recall generators propose overlapping spans around digits and at signs, and tokens, of any length. Boosted trees
score each from its format (lengths, digits, groups, checksum, entropy) and context (neighbouring characters, cue
words). What they learn is not what the rules decide, since only spans outside of the rules are theirs: positives are
rule hits rewritten so that no rule accepts them any more (``drills``: written-out at signs, other separators, a lost
plus, numbers run together), and secrets behind a cue word, half of them once more with the cue taken away; negatives are all
other candidates, the overlapping ones of the drills included. A candidate that would pass a rule if it stood alone is
left unlabelled. Trees and thresholds come from all labelled candidates of all documents: their features are cut at fixed
places (``CUTS``), equal ones are counted in a shuffle, and each level of a tree is chosen from sums that tasks send.
Those of a third of the texts are held out, and each kind's threshold is the least at which the held-out candidates reach
``PRECISION``. Accepted candidates that don't touch a rule span are added, best score first.

Defined cases: a null or empty text has no spans; rules and candidates take time in proportion to a very long text,
runs without a break included; of overlapping candidates with equal scores the longer and then the first one wins;
rows are judged one by one, so repeated ids and rows don't matter; an empty table gives no rows; without any
candidate to learn from, only the rules count; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.boosting import BoostedTrees, each_task
from plumbline.llm.common import add_columns, table
from plumbline.session import materialize

#: The rules, in the order in which kinds are listed.
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*RULES, "secret"]
PRECISION = 0.99
#: Where features are cut: whole numbers, then wider; entropies in fifths of a bit.
CUTS, ENTROPY_CUTS = np.array([*range(21), 24, 28, 32, 36, 40, 48, 64, 96, 128, 256], float), np.arange(1, 32) / 5
ENTROPY = 6
#: Probabilities that may be a threshold.
LEAST = np.linspace(0.5, 0.98, 25)
#: Different candidates that a task counts before it hands them on.
COUNTED = 50_000

_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
#: Four parts from every part on, overlapping ones too.
_QUAD = re.compile(r"(?<![0-9])(?=([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]))")
_AT = re.compile(r"@|\s?[(\[]at[)\]]\s?")
_PART = re.compile(r"[^\s@<>\"(),;]+")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_CUES = [re.compile(x, re.I) for x in (r"(?:token|key|secret|passw\w*|bearer)\W{1,4}\Z", r"(?:card|visa|konto|account)\W{1,4}\Z", r"(?:tel|phone|fax|call|mobile)\W{1,4}\Z", r"(?:ip|host|addr\w*|server)\W{1,4}\Z", r"(?:mail|contact)\W{1,4}\Z")]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in s.split(".")]
        return all(len(p) < 4 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    """The email rule's matches: the run before each at sign, back to the last match. One pass."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            k = at
            while k > done and _LOCAL.fullmatch(text[k - 1]):
                k -= 1
            if k < at:
                yield k, m.end()
                done = m.end()
        done = max(done, at + 1)  # no local part reaches back over an at sign
        at = text.find("@", done)


def _ip_spans(text: str) -> Iterator[tuple[int, int]]:
    """The ip rule's matches: four parts at a time of each dotted run. One pass."""
    for m in _DOTTED.finditer(text):
        parts = [q.span() for q in re.finditer("[0-9]+", m[0])] if m[0].count(".") > 2 else []
        for k in range(0, len(parts) - 3, 4):
            yield m.start() + parts[k][0], m.start() + parts[k + 3][1]


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the rules' matches that pass, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _email_spans(text)]
    if _DIGIT.search(text) is not None:
        out += [(1, s, e) for s, e in _ip_spans(text) if _valid("ip", text[s:e])]
        for k, kind in ((2, "card"), (3, "phone")):
            out += [(k, m.start(), m.end()) for m in RULES[kind].finditer(text) if _valid(kind, m[0])]
    return out


class Edges:
    """Spans that don't overlap, to ask whether another one touches any."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans: list[tuple[int, int]] = []
        for s, e in sorted(spans):  # rule spans of different kinds may overlap
            if self.spans and s < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(e, self.spans[-1][1]))
            else:
                self.spans.append((s, e))

    def free(self, start: int, end: int) -> bool:
        k = bisect_right(self.spans, (start, math.inf))
        return (k == 0 or self.spans[k - 1][1] <= start) and (k == len(self.spans) or end <= self.spans[k][0])

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the whole parts, of any length, on both sides of an at sign; one pass over the parts."""
    parts, k = [m.span() for m in _PART.finditer(text)], 0
    for m in _AT.finditer(text):
        while k < len(parts) and parts[k][1] < m.start():
            k += 1
        if k < len(parts) and parts[k][0] < m.start():
            # The part behind the sign; the part before it where the sign, in brackets, stands inside one.
            behind = next((p for p in parts[k : k + 3] if p[0] <= m.end() < p[1]), None)
            if behind is not None and behind[1] - m.end() >= 3:
                yield parts[k][0], behind[1]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping spans that might be of a kind."""
    found = set()
    if "@" in text or "(at)" in text or "[at]" in text:
        found |= {(0, start, end) for start, end in _mails(text)}
    if _DIGIT.search(text) is not None:
        for m in _NUMBERS.finditer(text):
            found |= {(1, m.start() + q.start(1), m.start() + q.end(1)) for q in _QUAD.finditer(m[0])}
            # Sub-spans of whole digit groups, as many as fit a card or a phone number.
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer(r"[0-9]+", m[0])]
            for i, (start, _) in enumerate(groups):
                n = 0
                for a, end in groups[i : i + 19]:
                    n += end - a
                    if n > 19:
                        break
                    lead = start - 2 if text[max(0, start - 2) : start] == "+(" else start - 1 if text[max(0, start - 1) : start] == "+" else start
                    if n >= 13:
                        found.add((2, start, end))
                    if 8 <= n <= 15:
                        found.add((3, lead, end))
    found |= {(4, m.start(), m.end()) for m in _TOKEN.finditer(text)}
    return sorted(found)


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    d = _digits(s)
    counts = Counter(s)
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts.values())
    prev, follow = before[-1:], after[:1]
    kind_of = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5
    quad = s.split(".")
    return [
        kind, len(s), len(d), sum(c.isalpha() for c in s), sum(c.isupper() for c in s), len(counts), entropy,
        s.startswith("+"), "@" in s, s.count("."), s.count("-"), s.count(" "), len(re.findall(r"[0-9]+", s)),
        16 <= len(d) <= 19 and luhn(d), len(quad) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in quad),
        bool(re.search(r"@[\w-]+(\.[\w-]+)+\Z", s)), all(c in "0123456789abcdefABCDEF" for c in s),
        kind_of(prev), kind_of(follow), prev in ('"', "'"), prev in ".-" and bool(prev), follow in "-" and bool(follow),
        after[:1] == "." and after[1:2].isdigit(), before[-2:-1].isdigit(), *(bool(c.search(before)) for c in _CUES),
    ]


#: Characters of a rule hit's surroundings in a drill.
AROUND = 40


def _card_like(seed: int) -> str:
    """Sixteen digits that pass the checksum."""
    first = f"4{seed % 10**14:014d}"
    return first + next(c for c in "0123456789" if luhn(first + c))


def drills(text: str, ruled: list[tuple[int, int, int]]) -> Iterator[tuple[str, set[tuple[int, int, int]]]]:
    """Each rule hit in its surroundings, rewritten so that it isn't one any more, and the spans that it should give."""
    for kind, start, end in ruled:
        hit, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
        seed = zlib.crc32(hit.encode())
        at, pick = len(left), seed % 6
        if kind == 0:
            made = hit.replace("@", ("[at]", "(at)", " (at) ")[pick % 3])
            spans = {(0, at, at + len(made))}
        elif kind == 1:
            lead = f"{300 + seed % 600}."
            made, spans = lead + hit, {(1, at + len(lead), at + len(lead) + len(hit))}
        elif kind == 2 and pick < 2:
            d = _digits(hit)
            made = ".".join(d[i : i + 4] for i in range(0, len(d), 4))
            spans = {(2, at, at + len(made))}
        elif kind == 3 and pick < 2:
            made = hit[1:]
            spans = {(3, at, at + len(made))}
        else:  # a phone and a card number run together
            phone, card = (hit, _card_like(seed)) if kind == 3 else (f"+1 ({200 + seed % 800}) 555-{seed % 10000:04d}", hit)
            made = f"{phone} {card}"
            spans = {(3, at, at + len(phone)), (2, at + len(phone) + 1, at + len(made))}
        yield left + made + right, spans


def labelled(text: str) -> Iterator[tuple[str, tuple[int, int, int], bool]]:
    """(text, candidate, label) of what a text teaches."""
    ruled = rule_spans(text)
    edges = Edges([(s, e) for _, s, e in ruled])
    for x in candidates(text):
        kind, start, end = x
        if not edges.free(start, end):
            continue
        if kind == 4:
            secret = bool(_CUES[0].search(text[max(0, start - 24) : start]))
            yield text, x, secret
            if secret and zlib.crc32(text[start:end].encode()) % 2:
                left = text[max(0, start - AROUND - 24) : max(0, start - 24)] + " "
                yield left + text[start : end + AROUND], (4, len(left), len(left) + end - start), True
        elif not (RULES[KINDS[kind]].fullmatch(text, start, end) and _valid(KINDS[kind], text[start:end])):
            yield text, x, False
    for made, spans in drills(text, ruled):
        low, high = min(s for _, s, _ in spans), max(e for _, _, e in spans)
        for x in candidates(made):
            if x[1] < high and low < x[2]:
                yield made, x, x in spans


def empty_trees() -> BoostedTrees:
    """Trees over ``features``, not fitted yet."""
    n = len(features("x", (4, 0, 1)))
    return BoostedTrees(cuts=[ENTROPY_CUTS if j == ENTROPY else CUTS for j in range(n)])


class Selector:
    """Trees and a threshold for each kind, from a table of different labelled candidates (x: bins, y, held) and their
    numbers (n); ``held`` marks what only sets the thresholds."""

    def __init__(self, rows: DataFrame):
        self.model = None
        #: By kind: held-out precision and recall at the threshold.
        self.report: dict[str, tuple[float, float]] = {}
        n = {(r["held"], r["y"]): r["n"] for r in rows.groupBy("held", "y").agg(F.sum("n").alias("n")).collect()}
        no, yes = n.get((False, False), 0), n.get((False, True), 0)
        if yes and no:
            self.model = model = empty_trees().fit_table(rows.filter("NOT held"), yes / (yes + no))

            def reached(b: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
                """By label, kind, and how many of the thresholds are reached."""
                spot = (y * len(KINDS) + b[:, 0]) * (len(LEAST) + 1) + np.searchsorted(LEAST, model.predict_binned(b), side="right")
                return np.bincount(spot, n, 2 * len(KINDS) * (len(LEAST) + 1)).reshape(2, len(KINDS), -1)

            found = np.broadcast_to(each_task(rows.filter("held"), reached), (2, len(KINDS), len(LEAST) + 1))
            wrong, right = found[:, :, ::-1].cumsum(-1)[:, :, ::-1]  # that reach at least so many
            self.least = []
            for k, kind in enumerate(KINDS):
                steps = [i for i in range(1, len(LEAST) + 1) if right[k, i] + wrong[k, i] and right[k, i] >= PRECISION * (right[k, i] + wrong[k, i])]
                self.least.append(LEAST[steps[0] - 1] if steps else 2.0)
                hit, all_hit = (right[k, steps[0]], right[k, steps[0]] + wrong[k, steps[0]]) if steps else (0.0, 0.0)
                self.report[kind] = (float(hit / max(1, all_hit)), float(hit / max(1, right[k, 0])))

    def added(self, ruled: list[tuple[int, int, int]], rows: list[tuple[int, int, int]], p: np.ndarray) -> list[tuple[int, int, int]]:
        """Accepted candidates apart from rule spans and from each other; best first, then longest, then first."""
        out: list[tuple[int, int, int]] = []
        taken = Edges([(s, e) for _, s, e in ruled])
        for q, x in sorted(zip(p, rows, strict=True), key=lambda y: (-round(y[0], 9), y[1][1] - y[1][2], y[1])):
            if q >= self.least[x[0]] and taken.free(x[1], x[2]):
                out.append(x)
                taken.add(x[1], x[2])
        return out


def labelled_counts(docs: DataFrame) -> DataFrame:
    """x (bins of the features), y, held and n: the different labelled candidates of all documents, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, counts = empty_trees(), Counter()

        def done() -> pa.RecordBatch:
            x, y, held = zip(*counts, strict=True) if counts else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.bool_()), pa.array(held, pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["x", "y", "held", "n"])

        def learn(rows: list, marks: list) -> None:
            if rows:
                counts.update((x.tobytes(), *mark) for x, mark in zip(trees.binned(np.array(rows, float)), marks, strict=True))

        for batch in batches:
            rows, marks = [], []
            for text in batch.column("text").to_pylist():
                if text:
                    held = zlib.crc32(text.encode("utf-8", "replace")) % 3 == 0
                    for made, x, y in labelled(text):
                        rows.append(features(made, x))
                        marks.append((y, held))
                        if len(rows) >= 1000:
                            learn(rows, marks)
                            rows, marks = [], []
                    if len(counts) > COUNTED:
                        yield done()
                        counts.clear()
            learn(rows, marks)
        yield done()

    return docs.select("text").mapInArrow(run, "x binary, y boolean, held boolean, n long").groupBy("x", "y", "held").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Selector:
    """Learns from all documents' candidates."""
    return Selector(materialize(labelled_counts(docs), "candidates"))


SPANS = (
    T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
)


def _spans(texts: list[str], chosen: Selector) -> tuple[list, list]:
    """The rules' spans and all spans of each text."""
    ruled = [rule_spans(t) for t in texts]
    every = [list(r) for r in ruled]
    if chosen.model is not None:
        open_ = []
        for k, t in enumerate(texts):
            edges = Edges([(s, e) for _, s, e in ruled[k]])
            open_ += [(k, c) for c in candidates(t) if edges.free(c[1], c[2])]
        p = chosen.model.predict(np.array([features(texts[k], c) for k, c in open_], float)) if open_ else np.zeros(0)
        by: dict[int, list[int]] = {}
        for n, (k, _) in enumerate(open_):
            by.setdefault(k, []).append(n)
        for k, own in by.items():
            every[k] = sorted(ruled[k] + chosen.added(ruled[k], [open_[n][1] for n in own], p[own]))
    return ruled, every


def _structs(spans: list) -> list:
    return [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in spans]


def find(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """Adds rule_spans and spans: arrays of struct<kind, start, end>, by kind and start."""
    selector = selector or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(selector)  # a few trees

    def step(part: pa.RecordBatch) -> list:
        ruled, every = _spans([t or "" for t in part.column("text").to_pylist()], shared.value)
        return [_structs(ruled), _structs(every)]

    return add_columns(docs, {"rule_spans": SPANS, "spans": SPANS}, lambda: step)


def clean(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """``docs`` with the spans replaced in ``text``, found and replaced in one pass, so that a task has one worker."""
    selector = selector or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(selector)  # a few trees

    def step(part: pa.RecordBatch) -> list:
        texts = part.column("_text").to_pylist()
        _, every = _spans([t or "" for t in texts], shared.value)
        return [list(map(redacted, texts, _structs(every)))]

    return add_columns(docs.withColumnRenamed("text", "_text"), {"text": (T.StringType(), pa.string())}, lambda: step).select(*docs.columns)


def redacted(text: str | None, spans: list[dict]) -> str | None:
    parts, at = [], 0
    for s, e, kind in sorted((x["start"], x["end"], x["kind"]) for x in spans):
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]]) if parts else text


def redact(found: DataFrame) -> DataFrame:
    """Replaces the spans in ``text`` by their kind in angle brackets; spans that touch become the first one's kind."""
    step = lambda part: [list(map(redacted, part.column("_text").to_pylist(), part.column("spans").to_pylist()))]
    out = add_columns(found.withColumnRenamed("text", "_text"), {"text": (T.StringType(), pa.string())}, lambda: step)
    return out.select(*[c for c in found.columns if c not in ("rule_spans", "spans")])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("rule_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, RULES), F.sha2(written(F.col("rule_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op5, which SQL can find as well."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def _spans_sql(kind: str, fits: str) -> str:
    """Struct list of a kind's matches: what stands between them tells their places."""
    rule = RULES[kind].pattern
    return f"""
{kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{rule}') AS m, regexp_split_to_array(t, '{rule}') AS gap FROM d),
{kind}_s AS (SELECT doc_id, list_transform(range(len(m)), lambda i: {{'s': CAST(coalesce(list_sum(list_transform(gap[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT), 'm': m[i + 1]}}) AS x FROM {kind}_m),
{kind} AS (SELECT doc_id, list_transform(list_filter(x, lambda y: {fits}), lambda y: '{kind}:' || y.s || ':' || (y.s + length(y.m))) AS x FROM {kind}_s)"""


_ONLY = "regexp_replace(y.m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_ONLY})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substring({_ONLY}, length({_ONLY}) - i, 1) AS INTEGER) ELSE CAST(substring({_ONLY}, length({_ONLY}) - i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substring({_ONLY}, length({_ONLY}) - i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_QUAD_SQL = "len(list_filter(string_split(y.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || substring(ltrim(p, '0'), 1, 3) AS INTEGER) > 255)) = 0"
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{_spans_sql("email", "true")},{_spans_sql("ip", _QUAD_SQL)},
{_spans_sql("card", f"length({_ONLY}) BETWEEN 16 AND 19 AND {_LUHN}").strip()},{_spans_sql("phone", f"length({_ONLY}) BETWEEN 8 AND 15")}
SELECT doc_id, len(email.x) AS n_email, len(ip.x) AS n_ip, len(card.x) AS n_card, len(phone.x) AS n_phone,
  sha256(array_to_string(list_concat(email.x, ip.x, card.x, phone.x), ',')) AS base_sha256
FROM email JOIN ip USING (doc_id) JOIN card USING (doc_id) JOIN phone USING (doc_id)
"""
