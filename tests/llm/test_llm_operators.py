"""Small cases and brute force for the training-data operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, attention, boosting, licenses, lm_scoring, mixing, near_dedup, pieces, pii, quality_classifier, quality_rules, url_filter
from plumbline.llm.common import n_words, text_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "one two", None, "s", 7), (2, "one two", "xx", None, 7), (2, "one two", "xx", None, 7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Invented texts: prose, exact and near copies, junk, personal data."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) if rng.random() > 0.3 else rng.choice(["the", "of", "and", "to", "in"]) for _ in range(n))
    rows = [(k, prose(rng.randint(60, 200)), "en", f"s{k % 3}") for k in range(120)]
    for k in range(120, 180):
        words = rows[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k, " ".join(words), "en", f"s{k % 3}"))
    rows += [(200, "", "en", "s0"), (201, None, "en", None), (202, "just two", "en", "s0"), (203, "just two", "en", "s1"), (204, "### ||| " * 60, "en", "s1")]
    return [(i, t, la, s, len(t or "")) for i, t, la, s in rows]


def test_license_places_and_templates(spark):
    texts = [None, "", "CC-BY and cc by, All rights reserved", licenses.TEMPLATES["mit"][0].upper(), "the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (3, 0, 5, "cc-by,reserved")
    assert got[3]["labels"] == "mit" and got[3]["score"] == 1.0
    assert got[0]["n_words"] == 0 and got[1]["first_word"] is None and got[4]["labels"] == ""
    assert licenses.scan(docs.limit(0)).count() == 0


def test_mix_meets_each_budget_exactly(spark, corpus, odd):
    docs = spark.createDataFrame(corpus, DOCS)
    rows = mixing.mix(docs, n_words(text_of())).collect()
    by: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(taken == math.floor(target + 0.5) for target, taken in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    out = mixing.write_out(mixing.mix(docs, n_words(text_of())))
    assert out.select(F.sum(n_words(text_of()))).head()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix(odd, n_words(text_of())).count() == 5 and mixing.mix(odd.limit(0), n_words(text_of())).count() == 0


def brute_components(rows, k, threshold):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < k else set(zip(*(w[j:] for j in range(k)), strict=False)) if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "threshold", "block"), [(3, Fraction(85, 100), 256), (5, Fraction(4, 5), 3)])
def test_near_duplicates_equal_brute_force(spark, corpus, k, threshold, block):
    got = near_dedup.link_components(spark.createDataFrame(corpus, DOCS), k=k, threshold=threshold, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(corpus, k, threshold)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_and_repeated_rows(spark, odd):
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[3 * k : 3 * k + 60]), "en", "s", 0) for k in range(8)]
    got = near_dedup.link_components(spark.createDataFrame(rows, DOCS), k=3, threshold=Fraction(85, 100), block=2).collect()
    assert {r["component_id"] for r in got} == {0}
    assert near_dedup.link_components(odd).count() == 5 and near_dedup.link_components(odd.limit(0)).count() == 0
    kept = near_dedup.deduplicate(odd).collect()
    assert sorted((r["text"] or "") for r in kept) == ["", "", "one two"]


def test_quality_classifier_learns_from_the_allowed_rows_only(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = [(k, " ".join(word() + ("###" if k % 2 else "") for _ in range(40))) for k in range(400)] + [(500, ""), (501, None)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(400)] + [(500, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([got[k]["predicted"] == 1 - k % 2 for k in range(400)]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality_classifier.classify(spark.createDataFrame(docs[:3], "doc_id long, text string"), labels.limit(0)).count() == 3


def test_pii_rules_and_redaction(spark):
    text = "Write a.b@c.example.org, +1 (555) 010-9999; 10.0.0.1 and 999.1.1.1; 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, spans string")
    found = pii.find(docs)
    spans = {r["doc_id"]: [(s["kind"], text[s["start"] : s["end"]]) for s in r["rule_spans"]] for r in found.collect()}
    assert spans[1] == [("email", "a.b@c.example.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert spans[2] == spans[3] == []
    out = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert "@" not in out[1] and "<CARD>" in out[1] and out[2] is None
    assert pii.find(docs.limit(0)).count() == 0


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    model = boosting.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_ann_recall_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [1.0, None] * 8), (1100, [1.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(frame, F.col("vec_id") % 100 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200, 300, 400, 500}
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert len(own) == 10 and all(s == pytest.approx(d[v]) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 60
    assert ann.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_ann_ties_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 2.0]) for k in range(40)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_attention_gradients_are_right():
    p = {k: v.astype(np.float64) for k, v in attention.start(12, 5).items()}
    rng = np.random.default_rng(0)
    sym, cls = rng.integers(0, 12, (3, attention.WINDOW)), rng.integers(0, 5, (3, attention.WINDOW))
    scored, offsets = rng.random(sym.shape) > 0.3, rng.normal(size=(12, 5))
    _, d = attention.gradients(p, offsets, sym, cls, scored)
    symbols, rows = d["e"]
    d["e"] = np.zeros_like(p["e"])
    d["e"][symbols] = rows
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-5
        up = attention.gradients(q, offsets, sym, cls, scored)[0]
        q[k][at] -= 2e-5
        assert d[k][at] == pytest.approx((up - attention.gradients(q, offsets, sym, cls, scored)[0]) / 2e-5, abs=1e-5)


def test_windows_score_each_position_once():
    lengths = np.array([1, 16, 17, 100, 40])
    at, scored, _ = attention.windows(lengths)
    assert Counter(at[scored].tolist()) == Counter(range(int(lengths.sum())))


def test_lm_base_equals_counting(spark, corpus):
    rows = [(i, t) for i, t, *_ in corpus] + [(7, "again again"), (7, "again again")]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_quality_rules_base_and_verdict(spark, corpus):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines, dup, seen = (t or "").split("\n"), 0, set()
        for x in lines:
            if x.split():
                dup += x in seen
                seen.add(x)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(covered)

    rows = [*corpus, (300, "a b c d e f a b c d e\n\n \nx\nx", "en", "s", 0)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t)
    assert not got[204]["kept"] and all(got[k]["kept"] for k in range(120))
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def full_viterbi(vocab, chars):
    best, back = [0], [None]
    for end in range(1, len(chars) + 1):
        top, via = None, None
        for start in range(max(0, end - vocab.longest), end):
            found = vocab.entries.get(chars[start:end])
            if found and (top is None or best[start] + found[1] > top):
                top, via = best[start] + found[1], (start, [found[0]])
        one = [vocab.byte_ids[b] for b in chars[end - 1].encode()]
        if vocab.entries.get(chars[end - 1]) is None and (top is None or best[end - 1] + pieces.BYTE_SCORE * len(one) > top):
            top, via = best[end - 1] + pieces.BYTE_SCORE * len(one), (end - 1, one)
        best.append(top)
        back.append(via)
    out, at = [], len(chars)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


@pytest.mark.parametrize("text", ["the fox, jumps!", "  two  spaces ", "###### ab ######", "日本語🙂 x\n\ny", "a" * 300, " " * 70 + "z"])
def test_streaming_viterbi_equals_the_whole_one_and_goes_round(text):
    vocab = pieces.Pieces.load(pieces.MODEL)
    encoder, marked = pieces.StreamingEncoder(vocab), pieces.MARK + text.replace(" ", pieces.MARK)
    ids = encoder.encode(text)
    assert ids.tolist() == full_viterbi(vocab, marked) == encoder.viterbi(marked)
    assert pieces.decode_ids(ids, vocab) == text


def test_ids_come_from_commits_of_a_bounded_window(monkeypatch):
    """Random texts over few characters, with small blocks, lanes and streams: all ways give the whole Viterbi's ids."""
    vocab, rng = pieces.Pieces.load(pieces.MODEL), random.Random(2)
    texts = ["".join(rng.choice("ab cde\nth 🙂日in") for _ in range(rng.choice([1, 7, 60, 400]))) for _ in range(60)]
    texts += ["theinthein" * 60, "ab " * 200, " " * 90, "x" * 700 + " end"]
    want = [full_viterbi(vocab, pieces.MARK + t.replace(" ", pieces.MARK)) for t in texts]
    for block, stream, lanes, long in ((8192, 200_000, 512, 2048), (16, 500, 7, 40), (33, 90, 3, 0), (64, 10**6, 1, 300)):
        for name, value in (("BLOCK", block), ("STREAM", stream), ("LANES", lanes), ("LONG", long)):
            monkeypatch.setattr(pieces, name, value)
        encoder = pieces.StreamingEncoder(vocab)
        got = encoder.encode_all(texts)
        assert [np.frombuffer(x, np.int32).tolist() for x, _ in got] == want and all(ok for _, ok in got)
        # Every id and every text's end came from a commit; a character's bytes are one.
        bare = sum(len(t.encode("utf-8")) - len(t) for t in "".join(texts) if vocab.entries.get(t) is None)
        assert encoder.committed == sum(map(len, want)) - bare + len(texts)
        assert encoder.widest < 1024


def test_lanes_take_room_in_proportion_to_characters_and_parts_are_alike(monkeypatch):
    vocab, rng = pieces.Pieces.load(pieces.MODEL), random.Random(4)
    texts = [" ".join(rng.choice(["the", "in", "fox\n", "x" * 40]) for _ in range(2000)), "q" * 1500 + " the \u00df\U0001f642", "\u2581a \u2581"]
    encoder = pieces.StreamingEncoder(vocab)
    got = encoder.encode_all(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x, _ in got] == [full_viterbi(vocab, pieces.MARK + t.replace(" ", pieces.MARK)) for t in texts]
    assert all(ok for _, ok in got)
    # Not in proportion to the longest lane, which is 1500 long here, times the number of lanes.
    assert len(encoder.room[0]) <= vocab.longest * (sum(map(len, texts)) + 2 * len(texts))
    monkeypatch.setattr(pieces, "STREAM", 1000)
    parts = encoder._shares(np.arange(0, 1101, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 1100 and all(b == c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))
    assert max(b - a for a, b in parts) <= 2 * min(b - a for a, b in parts)


def test_a_false_match_of_a_hash_is_found_and_mended(monkeypatch):
    vocab = pieces.Pieces.load(pieces.MODEL)
    want = pieces.StreamingEncoder(vocab).encode("the quick fox").tolist()
    slot, found = vocab.table.find(np.array([0], np.uint64))
    ids = vocab.table.ids.copy()
    own = np.flatnonzero(np.isin(ids, want))
    monkeypatch.setattr(vocab.table, "ids", np.where(np.isin(np.arange(len(ids)), own), np.roll(ids[ids >= 0], 5)[0], ids))
    (got, ok), = pieces.StreamingEncoder(vocab).encode_all(["the quick fox"])
    assert ok and pieces.decode_ids(np.frombuffer(got, np.int32), vocab) == "the quick fox"


def test_tables_follow_the_vocabulary():
    many = pieces.Pieces([(k, f"p{k}", -1.0 - k) for k in range(300_000)], {})
    slot, found = many.table.find(pieces.grown(np.zeros(1, np.uint64), np.array([ord("p")], np.uint32)))
    assert found[0] and many.table.ids[slot[0]] == -1 and len(many.table.keys) > 4 * 300_000


def test_encode_and_decode_tables(spark, odd):
    back = pieces.decode(pieces.encode(odd)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    digest = pieces.encode_checked(odd).filter("text = 'one two'").head()
    assert digest["round_trip"] and digest["ids_sha256"] == hashlib.sha256(np.array(digest["ids"], "<i4").tobytes()).hexdigest()
    assert pieces.encode_checked(odd.limit(0)).count() == 0


def test_url_rules_and_odd_urls(spark):
    urls = [None, "nope", "x://", "HTTP://A.ORG/es/?q", "http://b.example.org/es/1", "http://example.org/en/12", "https://n.net/de/1#f"] + [f"http://h{k}.example.com/{'de' if k % 2 else 'fr'}/{k}" for k in range(200)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(6)] == [("", "", None), ("", "", None), ("", "", None), ("a.org", "/es/", "org/"), ("b.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1")]
    assert got[5]["verdict"] == "block" and got[3]["verdict"] == "allow" and {r["verdict"] for r in got.values()} == {"allow", "block"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_learn_from_every_labelled_url(spark, monkeypatch):
    """More labelled urls than a sample would take, in several tasks: the learner gets each of them, and all its cuts."""
    n = 21_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".com/"), F.when(F.col("id") % 3 == 0, "de").otherwise("fr"), F.lit("/x"), "id").alias("url"))
    monkeypatch.setattr(url_filter, "TASK_ROWS", 8000, raising=False)
    got, learner = [], url_filter.GBTClassifier

    def fitting(**how):
        trees = learner(**how)
        fit = trees.fit
        trees.fit = lambda rows: (got.append((rows.count(), how["maxBins"], rows.rdd.getNumPartitions())), fit(rows))[1]
        return trees

    monkeypatch.setattr(url_filter, "GBTClassifier", fitting)
    ruled = url_filter.with_rule(url_filter.with_parts(pages), url_filter.RULES).withColumn("_fold", url_filter.fold())
    url_filter.train(ruled, url_filter.statistics_of(ruled, n))
    rows, bins, tasks = got[0]
    assert rows == ruled.filter("_fold <> 0").count() and rows > 16_000 and tasks > 1
    assert bins**2 >= rows  # below that Spark's learner takes its splits from some of the rows


def test_attention_learns_from_every_training_text_whole(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WARM", 2)
    lengths, fit_ = [], attention.Trainer.fit
    monkeypatch.setattr(attention.Trainer, "fit", lambda self, s, c, n: lengths.append(n.tolist()) or fit_(self, s, c, n))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "green", "blue", "grey"]) for _ in range(n)) for n in [4100] * 5]
    docs = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    subwords = lm_scoring.Subwords.load(lm_scoring.VOCABULARY)
    classes = lm_scoring.fit_classes(lm_scoring.count_words(docs(texts)), subwords)
    fit = lambda rows, parts=1: attention.flat(lm_scoring.fit_attention(docs(rows).repartition(parts), 20_000, subwords, classes))
    whole = fit(texts)
    warm = lengths[0]  # the driver's own fit
    assert len(warm) == 2 and min(warm) > 4100
    assert np.array_equal(fit(texts, 4), whole)  # however the rows lie
    for k in range(len(texts)):
        changed = [t + " red red blue" if i == k else t for i, t in enumerate(texts)]
        assert not np.array_equal(fit(changed), whole), k


def test_shares_of_ids_and_classes_add_up_to_one(spark):
    texts = ["the red fox", "the red hen and the red fox", "a hen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    subwords = lm_scoring.Subwords.load(lm_scoring.VOCABULARY)
    classes = lm_scoring.fit_classes(lm_scoring.count_words(docs), subwords)
    lm_scoring.fit_pairs(docs, subwords, classes)
    ids = np.arange(len(classes.cls))
    seen = classes.symbol[subwords.sequence([b"the"])[0]]
    for symbol in (int(seen), classes.begin, 5000 % classes.begin):
        p = np.exp(classes.inside(np.full(len(ids), symbol), ids) + classes.offsets[symbol][classes.cls])
        assert p.sum() == pytest.approx(1, abs=2e-3)
    after_the = np.exp(classes.inside(np.full(len(ids), seen), ids) + classes.offsets[seen][classes.cls])
    assert ids[np.argmax(after_the)] == subwords.sequence([b"red"])[0]


def test_the_model_beats_word_counts_on_texts_that_it_has_not_seen(spark):
    held = lm_scoring.op7_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert held[0] > held[1]


def test_a_score_reads_the_ids_before_it_as_far_as_a_whole_window():
    rng = np.random.default_rng(3)
    p = attention.start(50, lm_scoring.OWN_CLASSES + lm_scoring.SHARED_CLASSES)
    sym, cls, offsets = rng.integers(0, 50, 100), rng.integers(0, 128, 100), np.full((50, 128), -np.log(128), np.float32)
    score = lambda s: attention.score(p, offsets, s, cls, np.array([100]))
    for at, first in ((31, 0), (32, 24), (55, 24), (56, 48)):  # windows of 32 that overlap by 8
        for k in (first - 1, first):
            other = sym.copy()
            other[k] = (sym[k] + 1) % 50
            if k >= 0:
                assert (score(other)[at] != score(sym)[at]) == (k == first), (at, k)
    assert p["w1"].shape == (attention.WIDTH, 32)


def test_pii_proposes_and_redacts_secrets_and_mails_of_any_length(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    long, plain = made(200, letters + "0123456789"), made(40, letters)
    local, domain = made(90, letters), made(70, letters) + ".org"
    mails = [f"{local}@{domain}", f"{local}[at]{domain}", f"{local} (at) {domain}", "a.b@c.example.org"]
    text = f"token: {long} and secret: {plain}; write {mails[0]} or {mails[1]} or {mails[2]} or {mails[3]}"
    found = {(k, text[s:e]) for k, s, e in pii.candidates(text)}
    assert {(4, long), (4, plain), *((0, m) for m in mails)} <= found
    rows = [(9000, text)]
    for k in range(1500):
        n = rng.choice([20, 40, 80, 120, 200, 260])
        of = rng.choice([letters, letters + "0123456789"])
        rows.append((k, f"{rng.choice(['token: ', 'secret: ', 'see ', 'in ', 'of '])}{made(n, of)} is here"))
    out = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert long not in out[9000] and plain not in out[9000]
    hidden = [i for i, t in rows[1:] if out[i] != t]
    assert {i for i, t in rows[1:] if t.startswith(("token", "secret"))} == set(hidden)


def test_pii_candidates_take_time_in_proportion_to_the_text():
    for unit in ("x", "@", "[at]", "a[at]", "a@b", "a (at) "):
        assert len(pii.candidates(unit * 20_000)) <= 60_000


def test_only_sql_is_registered_as_sql():
    from plumbline.llm import queries

    assert all(isinstance(sql, str) for sql in queries.ORACLES.values())


def test_license_scan_equals_a_search_of_every_place(spark):
    rng = random.Random(21)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    phrases, templates = list(licenses.PHRASES.values()), [t for t, _ in licenses.TEMPLATES.values()]
    texts = [None, "", "É cc by"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 12)):
            words = rng.choice([rng.choice(phrases), rng.choice(templates), "cc cc by by", "general public", "all of the rights", "İ 4 0 license"]).split()
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = rng.choice(["cc", "license", "odd"])
            parts.append(rng.choice([" ", "-", "\n"]).join(w.upper() if rng.random() < 0.3 else w for w in words))
        texts.append(rng.choice([" ", ". "]).join(parts))
    words = [re.findall(licenses.LICENSE_WORD, (t or "").translate(lower)) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    index = licenses.build_index(df, len(texts), licenses.TEMPLATES, licenses.PHRASES)

    def brute(ws):
        places = [(i, k) for k, p in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        labels = {k for _, k in places}
        for t in (t for t in index if not t["base"]):
            at = lambda s: ws[s] if 0 <= s < len(ws) else None
            for s in range(-60, len(ws)):
                if all(at(s + place + j) == w for key, place in t["keys"] for j, w in enumerate(key)) and sum(at(s + i) == w for w, i in t["rare"]) >= licenses.MIN_SHARE * len(t["rare"]):
                    labels.add(t["label"])
        return len(ws), len(places), min(places, default=[None])[0], max(places, default=[None])[0], ",".join(sorted({k for _, k in places})), ",".join(sorted(labels))

    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) == brute(words[r["doc_id"]]), r["doc_id"]
    assert len(got) == len(texts)


def test_cleaning_in_one_pass_equals_finding_and_redacting(spark):
    rows = [(k, f"no {k} token = \"{hashlib.md5(str(k).encode()).hexdigest()}\" or a{k}@b.org, +1 (555) 010-{k:04d} 4111111111111111") for k in range(60)] + [(None, None), (2**60 + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    selector = pii.fit(docs)
    two = {tuple(r) for r in pii.redact(pii.find(docs, selector)).collect()}
    one = {tuple(r) for r in pii.clean(docs, selector).collect()}
    assert one == two and (None, None) in one and (2**60 + 1, "") in one
    assert all("<EMAIL>" in t and "@" not in t for i, t in one if t)


def test_pii_learns_from_every_candidate_however_rows_are_laid_out(spark):
    made = lambda k, j: hashlib.md5(f"{k}:{j}".encode()).hexdigest()
    rows = [(k, " ".join(f"{'token: ' if (k + j) % 7 == 0 else 'see '}{made(k, j)}" for j in range(40))) for k in range(700)]
    taught = [(pii.features(t, x), y, zlib.crc32(text.encode()) % 3 == 0) for _, text in rows for t, x, y in pii.labelled(text)]
    own = [(x, y) for x, y, held in taught if not held]
    share = np.mean([y for _, y in own])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = pii.fit(docs).model
    assert len(taught) > 30_000 and abs(whole.start - np.log(share / (1 - share))) < 1e-12
    few = [(bytes(r["x"]), r["y"], r["n"]) for r in pii.labelled_counts(docs).filter("NOT held").collect()]
    assert sum(n for *_, n in few) == len(own)
    other = pii.empty_trees().fit_table(spark.createDataFrame(few, "x binary, y boolean, n long").repartition(5), share)
    array = pii.empty_trees().fit(np.array([x for x, _ in own], float), np.array([y for _, y in own]))
    for trees in (other, array):
        assert all(np.array_equal(a, b) and np.array_equal(p, q) for (s, p), (t, q) in zip(whole.forest, trees.forest, strict=True) for a, b in zip(s, t, strict=True))


def test_lm_works_out_equal_pairs_once_and_asks_for_new_words_only(monkeypatch):
    known = lm_scoring.Classes(np.arange(5000, 0, -1).astype(float))
    rng = np.random.default_rng(3)
    sym, ids = rng.integers(0, 40, 20_000).astype(np.int32), rng.integers(0, 50, 20_000).astype(np.int32)
    pairs, n = np.unique(known.key(sym, ids), return_counts=True)
    at, of = np.divmod(pairs, 5000)
    cells, back = np.unique(at * len(known.priors) + known.cls[of], return_inverse=True)
    known.learn_pairs(pairs[::2], n[::2], cells, np.bincount(back, n), np.bincount(back), np.bincount(back, np.where(np.arange(len(n)) % 2 == 0, n - lm_scoring.DISCOUNT, 0)))
    one = np.concatenate([known.inside(sym[k : k + 1], ids[k : k + 1]) for k in range(300)])
    seen, search = [], np.searchsorted
    monkeypatch.setattr(lm_scoring.np, "searchsorted", lambda a, v, **how: seen.append(len(v)) or search(a, v, **how))
    assert np.array_equal(known.inside(sym, ids)[:300], one) and seen == [len(pairs)]
    sub, asked = lm_scoring.Subwords.load(lm_scoring.VOCABULARY), []
    monkeypatch.setattr(sub, "ids", lambda w, ids=sub.ids: asked.append(w) or ids(w))
    words = lm_scoring.words_of("one two three")
    first = sub.sequence(words).tolist()
    assert sub.sequence(words).tolist() == first and asked == words and first[-1] == sub.end


def test_lm_makes_ids_once_and_shuffles_no_text(spark, monkeypatch):
    plans, write = {}, lm_scoring.materialize
    monkeypatch.setattr(lm_scoring, "materialize", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().toString()), write(df, name))[1])
    texts = ["the red fox", "the red hen and the red fox", "", None, "a hen " * 400, "the red fox"]
    rows = [(i // 2 if i == 5 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    got = lm_scoring.score(docs).collect()
    assert len(got) == 7 and len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert list(plans) == ["words", "rare", "known", "pairs", "models", "scored"]
    # Rare words' shuffle is over before ids are written; what reads ids reads no text.
    assert all("text#" not in plans[name] and "ids#" in plans[name] for name in ("pairs", "models", "scored"))
    # Ids are packed in as few bytes as the vocabulary allows, and come back whole.
    wide = lm_scoring.Subwords({bytes([i]): i for i in range(256)} | {b" the": 70_000})
    sub = lm_scoring.Subwords.load(lm_scoring.VOCABULARY)
    assert wide.sequence([b"the", b"a"]).tolist() == [70_000, 32, 97, 70_001]
    assert (sub.kind.itemsize, wide.kind.itemsize) == (2, 4) and len(sub.packed([b"the"])) == 4


def test_attention_works_in_cached_parts_with_the_same_result(monkeypatch):
    rng = np.random.default_rng(4)
    p = attention.start(60, 9)
    p["wc"], p["bc"] = rng.normal(size=p["wc"].shape).astype(np.float32), rng.normal(size=9).astype(np.float32)
    offsets, lengths = rng.normal(size=(60, 9)).astype(np.float32), np.array([1, 40, 3000, 77])
    sym, cls = rng.integers(0, 60, lengths.sum()).astype(np.int32), rng.integers(0, 9, lengths.sum()).astype(np.int32)
    at, scored, _ = attention.windows(lengths, 0)
    whole, d = attention.gradients(p, offsets, sym[at], cls[at], scored)
    scores = attention.score(p, offsets, sym, cls, lengths)
    shapes, product = [], np.matmul
    monkeypatch.setattr(attention.np, "matmul", lambda a, b, **how: shapes.append(len(a)) or product(a, b, **how))
    monkeypatch.setattr(attention, "TOGETHER", 5)
    monkeypatch.setattr(attention, "ROWS", 70)
    loss, parts = attention.gradients(p, offsets, sym[at], cls[at], scored)
    assert max(shapes) <= 70 and loss == pytest.approx(whole, abs=1e-5)
    assert np.array_equal(parts["e"][0], d["e"][0]) and np.allclose(parts["e"][1], d["e"][1], atol=1e-5)
    assert all(np.allclose(parts[k], d[k], atol=1e-5) for k in p if k != "e")
    assert np.allclose(attention.score(p, offsets, sym, cls, lengths), scores, atol=1e-4)
    # Logits out of range are clipped still, by rows and by columns of any length.
    p["wc"] *= 1000
    assert np.isfinite(attention.score(p, offsets, sym, cls, lengths)).all() and np.isfinite(attention.gradients(p, offsets, sym[at], cls[at], scored)[0])


def test_a_step_of_training_moves_weights_that_the_model_reads():
    rng = np.random.default_rng(4)
    trainer = attention.Trainer(attention.start(60, 9), np.zeros((60, 9), np.float32), rate=0.01)
    begun, sym = {k: v.copy() for k, v in trainer.p.items()}, rng.integers(0, 50, 500).astype(np.int32)
    losses = [trainer.fit(sym, (sym % 9).astype(np.int32), np.array([500])) for _ in range(60)]
    assert losses[-1] < losses[0] / 2 and all(np.shares_memory(trainer.p[k], trainer.w) for k in trainer.dense)
    assert all(not np.array_equal(begun[k], v) for k, v in trainer.p.items()) and np.array_equal(begun["e"][50:], trainer.p["e"][50:])


def test_lm_encodes_new_words_together_as_one_by_one(spark, monkeypatch):
    texts = ["caf\u00e9 au\u00a0lait  x\u3000 \x85 \x1c y\x1fz \u2028q", "", "x", "\x00 a", "don't stop's -- 3.14 ??!a1b2 \U0001f600", "l'\u00a0 a \u00a0"]
    sub, plain, calls = lm_scoring.Subwords.load(lm_scoring.VOCABULARY), lm_scoring.Subwords.load(lm_scoring.VOCABULARY), []
    monkeypatch.setattr(sub, "ids", lambda w, ids=sub.ids: calls.append(w) or ids(w))
    monkeypatch.setattr(lm_scoring, "REMEMBERED", 8)
    for _ in range(3):  # what is forgotten in between is worked out again
        for text in texts:
            words = lm_scoring.words_of(text)
            sub.remember(set(words))
            assert sub.packed(words) == b"".join([*map(plain.ids, words), plain.kind.type(plain.end).tobytes()])
    assert calls and all(lm_scoring.ODD_SPACE.search(w.decode()) for w in calls)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_ids, by_words = (lm_scoring.fit_classes(d, plain) for d in (lm_scoring.encode(docs, plain).select("ids"), lm_scoring.count_words(docs)))
    assert np.array_equal(by_ids.share, by_words.share) and np.array_equal(by_ids.symbol, by_words.symbol)
