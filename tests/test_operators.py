from __future__ import annotations

import hashlib
import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.paths import walk_key
from plumbline.operators import chunking, corpus, evaluation, grounding, retrieval, verification
from plumbline.sources import files

CHUNKS = [(1, "the red fox runs"), (2, "the blue fox sleeps sleeps"), (3, ""), (4, "a kettle boils")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, text string")


def test_bm25_matches_the_formula(spark, chunks):
    queries = spark.createDataFrame([(1, "Fox sleeps"), (2, "zebra"), (3, "")], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25(chunks, queries).collect()}
    docs = {i: t.split() for i, t in CHUNKS}
    avg = sum(map(len, docs.values())) / len(docs)
    want = {}
    for i, words in docs.items():
        s = 0.0
        for t in ("fox", "sleeps"):
            df, f = sum(t in w for w in docs.values()), words.count(t)
            s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if s > 0:
            want[(1, i)] = s
    assert got == pytest.approx(want)


def test_dense_top_k_leaves_out_orthogonal_and_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.1])], "chunk_id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, v array<double>")
    assert [r["chunk_id"] for r in retrieval.dense_top_k(v, q, 5).orderBy("rank").collect()] == [1, 4]


def test_fusion_needs_both_lists_to_pass_the_default_threshold(spark):
    lex = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    den = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, rank int")
    fused = retrieval.reciprocal_rank_fusion(lex, den)
    assert [r["chunk_id"] for r in fused.orderBy("fused_rank").collect()] == [11, 10, 12]
    assert [r["chunk_id"] for r in fused.filter("fused_score >= 0.02").collect()] == [11]


def test_rerank_select_falls_back_to_all(spark):
    rows = spark.createDataFrame([(1, 1, 0.01, 1, 0.1), (1, 2, 0.01, 2, 0.9), (2, 3, 0.03, 1, 0.0), (2, 4, 0.01, 2, 1.0)], "query_id long, chunk_id long, fused_score double, fused_rank int, rerank_score double")
    got = {(r["query_id"], r["final_rank"]): r["chunk_id"] for r in retrieval.rerank_select(rows).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 3}


def test_claim_status_covers_every_case(spark):
    chunks = spark.createDataFrame([("a", "The engine heats water to ninety degrees. It stops."), ("b", "Nothing here")], "chunk_id string, text string")
    claims = spark.createDataFrame([("1", "Engine heats water", ["b", "a"]), ("2", "Engine paints walls", ["a"]), ("3", "Engine", []), ("4", "Engine heats", ["x"])], "claim_id string, text string, cited array<string>")
    covered = verification.supporting_quote(verification.claim_coverage(claims, chunks))
    rows = {r["claim_id"]: r for r in verification.claim_status(covered).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"1": "supported", "2": "unsupported", "3": "uncited", "4": "unsupported"}
    assert rows["1"]["best_chunk_id"] == "a" and rows["1"]["quote"] == "The engine heats water to ninety degrees."


def test_answer_gate_withholds_above_a_fifth(spark):
    rows = [(1, k, f"c{k}", "supported") for k in range(4)] + [(1, 4, "c4", "unsupported")] + [(2, 0, "x", "supported"), (2, 1, "y", "uncited")]
    got = {r["query_id"]: r for r in verification.answer_gate(spark.createDataFrame(rows, "query_id long, claim_pos long, text string, status string")).collect()}
    assert not got[1]["abstained"] and got[1]["answer"] == "c0 c1 c2 c3"
    assert got[2]["abstained"] and got[2]["answer"] == ""


def test_questions_without_claims_abstain(spark):
    claims = spark.createDataFrame([(1, 0, "c", "supported")], "query_id long, claim_pos long, text string, status string")
    asked = spark.createDataFrame([(1,), (2,), (2,)], "query_id long")
    got = {r["query_id"]: r for r in verification.answer_gate(claims, queries=asked).collect()}
    assert got[1]["answer"] == "c" and not got[1]["abstained"]
    assert (got[2]["abstained"], got[2]["n_claims"], got[2]["unsupported_ratio"], got[2]["answer"]) == (True, 0, 1.0, "")


def test_conflicts_need_other_sources_values_and_shared_words(spark):
    texts = spark.createDataFrame([(1, 1, "guide", "Each player draws 60 cards before play."), (1, 2, "errata", "Each player draws 80 cards before play."), (1, 3, "guide", "Each player draws 70 cards before play."), (2, 4, "other", "Each player draws 90 cards before play.")], "query_id long, place long, source string, text string")
    mentions = verification.number_mentions(texts).withColumn("ord", F.col("place") * 1000 + F.col("pos"))
    got = {(r["value_a"], r["value_b"]) for r in verification.find_conflicts(mentions).collect()}
    assert got == {("60", "80"), ("80", "70")}


def conflicting(rows, least=2):
    """Brute force over all pairs of mentions, in order of their places."""
    found, rows = {}, sorted(rows, key=lambda r: r[1])
    for a in rows:
        for b in rows:
            shared = set(a[4]) & set(b[4])
            if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and a[3] != b[3] and len(shared) >= least:
                couple = (a[0], *sorted((f"{a[2]}:{a[3]}", f"{b[2]}:{b[3]}")))
                found.setdefault(couple, (a[0], a[2], a[3], b[2], b[3], " / ".join(sorted(shared))))
    return sorted(found.values())


def test_conflicts_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    rows = [(k % 3, k, f"s{rng.randint(0, 4)}", str(rng.randint(0, 5)), [*{rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))}]) for k in range(160)]
    rows += [(1, 500 + k, "copy", "9", ["a", "b", "b"]) for k in range(10)]
    frame = spark.createDataFrame(rows, "query_id long, ord long, source string, value string, ctx array<string>")
    for least in (1, 2, 3):
        got = verification.find_conflicts(frame, least).select("query_id", "source_a", "value_a", "source_b", "value_b", "claim_text").collect()
        assert sorted(map(tuple, got)) == conflicting(rows, least)


def test_a_word_of_every_context_brings_nothing_together(spark):
    """One word is in every context: what meets grows with the mentions, not with their square."""
    met = []
    for n in (200, 400):
        rows = [(1, k, f"s{k}", str(k), ["everywhere", f"own{k}", f"pair{k // 2}"]) for k in range(n)]
        frame = spark.createDataFrame(rows, "query_id long, ord long, source string, value string, ctx array<string>")
        met.append(verification.meeting_mentions(frame).count())
        assert verification.find_conflicts(frame).count() == n // 2
    assert met[1] == 2 * met[0]


def test_mentions_meet_without_the_driver(spark, tmp_path):
    """The table looks small enough to be broadcast; what its mentions are spread out to is not."""
    rows = [(k // 40, k, f"s{k % 5}", str(k % 9), [f"w{k % 3}", f"w{k % 4}", "all"]) for k in range(400)]
    spark.createDataFrame(rows, "query_id long, ord long, source string, value string, ctx array<string>").write.parquet(str(tmp_path / "m"))
    found = verification.find_conflicts(spark.read.parquet(str(tmp_path / "m")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_supersession_keeps_the_newest_current_member(spark):
    rows = [("a/x_r1.pdf", True), ("a/x_r2.docx", True), ("a/x_r3_WITHDRAWN.pdf", True), ("a/y.pdf", True), ("a/x_r9.pdf", False)]
    done = corpus.mark_superseded(corpus.with_revisions(spark.createDataFrame(rows, "path string, indexed boolean")))
    got = {r["path"]: r["superseded_by"] for r in done.collect()}
    assert got == {"a/x_r1.pdf": "a/x_r2.docx", "a/x_r2.docx": None, "a/x_r3_WITHDRAWN.pdf": "a/x_r2.docx", "a/y.pdf": None, "a/x_r9.pdf": None}


def test_files_that_are_not_indexed_are_not_superseded(spark):
    rows = [("a/x_r1.pdf", False), ("a/x_r2.pdf", True), ("a/x_r3.pdf", False)]
    done = corpus.mark_superseded(corpus.with_revisions(spark.createDataFrame(rows, "path string, indexed boolean")))
    assert {r["path"]: r["superseded_by"] for r in done.collect()} == {"a/x_r1.pdf": None, "a/x_r2.pdf": None, "a/x_r3.pdf": None}


def test_identifiers_in_too_many_files_are_left_out(spark):
    rows = [(f"f{k}", f"COMMON-1 OWN-{k:03d}") for k in range(13)]
    got = {r["ident"] for r in corpus.identifier_files(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert "COMMON1" not in got and "OWN003" in got


def test_paragraphs_overlap_by_whole_ones():
    body = "\n\n".join(" ".join([f"p{k}"] * 40) for k in range(6))
    got = chunking.pack_paragraphs(body, 100, 30)
    assert [c.split()[0] for c in got] == ["p0", "p1", "p2", "p3", "p4"]
    assert chunking.pack_paragraphs(" ".join(["w"] * 500), 100, 30) == [" ".join(["w"] * 500)]


def test_lines_are_packed_with_one_piece_of_overlap():
    got = chunking.pack_lines("a b\n\nc d\ne f\ng h", "log", 4)
    assert got == [("log lines 1-2", "a b\nc d"), ("log lines 2-3", "c d\ne f"), ("log lines 3-4", "e f\ng h")]
    assert [t for _, t in chunking.pack_lines(" ".join(map(str, range(10))), "l", 4)][0] == "0 1 2 3"
    assert chunking.pack_lines("\n \n", "x", 4) == []


def test_a_bare_heading_takes_the_next_line(spark):
    docs = spark.createDataFrame([(1, "#\n\nTitle\nbody\n##\nNext\nmore")], "doc_id long, text string")
    got = [(r["heading"], r["body"]) for r in chunking.split_sections(docs).orderBy("section_no").collect()]
    assert got == [("Title", "body"), ("Next", "more")]


def test_a_null_locator_is_left_out():
    assert chunking.pack_lines("a b\nc d\ne f", None, 4) == [("lines 1-2", "a b\nc d"), ("lines 2-3", "c d\ne f")]


def test_sections_keep_the_preamble_and_drop_empty_ones(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody\n## Empty\n\n# Two\nmore"), (2, "plain")], "doc_id long, text string")
    got = [(r["doc_id"], r["heading"], r["body"]) for r in chunking.split_sections(docs).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, "", "intro"), (1, "One", "body"), (1, "Two", "more"), (2, "", "plain")]


def test_nearest_rank_equals_sorting(spark):
    import random

    rng = random.Random(5)
    rows = [("a", rng.choice([1.0, 2.0, rng.random() * 100])) for _ in range(501)] + [("b", 4.0)]
    got = {(r["key"], r["share"]): r["value"] for r in evaluation.nearest_rank(spark.createDataFrame(rows, "key string, value double"), [0.5, 0.95], cells=16).collect()}
    values = sorted(v for k, v in rows if k == "a")
    assert got == {("a", 0.5): values[250], ("a", 0.95): values[475], ("b", 0.5): 4.0, ("b", 0.95): 4.0}


def test_report_defaults_for_nobody_answered(spark):
    rows = [("v", True, True, True, 0.0, 0.0, 1.0, 5)]
    r = evaluation.ablation_report(spark.createDataFrame(rows, "prompt_version string, correct boolean, abstained boolean, expects_abstain boolean, faithfulness double, grounded_ratio double, latency_ms double, tokens long")).head()
    assert (r["accuracy"], r["mean_faithfulness"], r["mean_grounded_ratio"], r["abstention_recall"]) == (1.0, 1.0, 0.0, 1.0)


def test_paths_resolve_exactly_then_loosely(spark):
    real = spark.createDataFrame([("d/A.txt",), ("d/b.txt",), ("e/b.txt",)], "path string")
    cited = spark.createDataFrame([(1, "/app/corpus/d/A.txt"), (2, "D/a.TXT"), (3, "`x/a.txt`"), (4, "b.txt"), (5, "d\\b.txt"), (6, "d%2Fb.txt"), (7, "100%/a+b")], "query_id long, raw string")
    assert {r["query_id"]: r["path"] for r in verification.resolve_paths(cited, real).collect()} == {1: "d/A.txt", 2: "d/A.txt", 3: "d/A.txt", 4: None, 5: "d/b.txt", 6: "d/b.txt", 7: None}


def test_a_folder_of_files_is_parsed_without_raising(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("Withdrawn notice\r\nline".encode())
    (tmp_path / "u.txt").write_bytes("weiß".encode("utf-16"))
    (tmp_path / "t.csv").write_text("name;size\nfan;3\npump;4\n")
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "bad.xlsx").write_bytes(b"nope")
    (tmp_path / "x.dat").write_bytes(b"\x00\x01")
    with zipfile.ZipFile(tmp_path / "sub" / "d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>")
    got = {r["path"]: r for r in files.parse_files(files.read_folder(spark, str(tmp_path))).collect()}
    assert got["a.txt"]["withdrawn"] and got["a.txt"]["segments"][0]["text"] == "Withdrawn notice\nline"
    assert got["u.txt"]["segments"][0]["text"] == "weiß"
    assert [s["text"] for s in got["t.csv"]["segments"]] == ["t header | name | size", "t | name: fan | size: 3", "t | name: pump | size: 4"]
    assert got["empty.md"]["skipped"] == "empty file" and got["x.dat"]["skipped"] == "unknown file type"
    assert got["bad.xlsx"]["skipped"].startswith("xlsx: BadZipFile")
    assert got["sub/d.docx"]["segments"][0]["text"] == "# Top\nBody"


def test_file_search_caps_files_and_demotes_superseded(spark):
    rows = [(k, "fan motor", "a.txt", False) for k in range(5)] + [(9, "fan motor motor", "old.txt", True)]
    found = retrieval.file_search(spark.createDataFrame(rows, "chunk_id long, text string, path string, superseded boolean"), spark.createDataFrame([(1, "motor fans")], "query_id long, text string"), X.file_tokens)
    assert [r["chunk_id"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 9]


def test_answers_are_grounded_in_exact_files(spark):
    from plumbline.operators import grounding

    files_ = spark.createDataFrame(
        [("spec_r2.txt", "Pump P-100X limit is 94 C in summer mode", False), ("spec_r1.txt", "Pump P-100X limit is 94 C in summer mode", True), ("log.txt", "ticket OPS-77 concerns pump P-100X", False), ("far.txt", "nothing", False)],
        "path string, text string, superseded boolean",
    )
    questions = spark.createDataFrame([(q, "what is the pump limit for the summer ticket") for q in range(1, 6)], "query_id long, text string")
    hits = questions.select("query_id").crossJoin(spark.createDataFrame([(1, "spec_r1.txt"), (2, "spec_r2.txt"), (3, "log.txt")], "rank int, path string")).join(files_.select("path", "text"), "path")
    replies = spark.createDataFrame([(1, "94 C", ["spec_r1.txt", "SPEC_R2.txt", "log.txt", "far.txt"]), (2, "12", ["log.txt"]), (3, "", []), (4, "94", []), (5, "94", ["spec_r1.txt"])], "query_id long, answer string, sources array<string>")
    idents = corpus.identifier_files(files_).select("ident", F.explode("files").alias("path"))
    got = {r["query_id"]: r for r in grounding.verify_and_cite(replies, questions, hits, files_, idents).collect()}
    assert got[1]["citations"] == ["spec_r2.txt", "log.txt"] and got[1]["answer"] == "94" and got[1]["confidence"] == pytest.approx(0.9)
    assert got[2]["reason"].startswith("answer not found") and got[3]["reason"] == "empty answer"
    assert got[4]["citations"] == ["spec_r1.txt"] and got[5]["confidence"] == pytest.approx(0.7)


def test_many_values_are_found_in_one_text():
    rng = random.Random(3)
    text = "".join(rng.choice("AB1") for _ in range(400)) + "A" * 50
    values = list({text[i : i + n] for i in range(0, 400, 9) for n in (3, 5, 40)} | {"ZZZ", "B1" * 30, "A" * 33, "A" * 51, "A" * 49 + "B"})
    want = [v for v in values if v in text]
    assert grounding.held_values(text, values) == want and len(want) not in (0, len(values))
    assert grounding.held_values(text, ["ZZ", text[7:90]]) == [text[7:90]] and grounding.held_values("", values) == []


def test_a_file_is_gone_over_once_for_all_questions(spark, monkeypatch):
    """The value is in whole files only: their texts must not be worked through for each question."""
    files_ = spark.createDataFrame([(f"f{k}.txt", " ".join(f"pump limit row {n} is {n * 7 + 1000 + k}-{k}X" for n in range(100)), k == 2) for k in range(3)], "path string, text string, superseded boolean")
    questions = spark.createDataFrame([(q, "what is the pump limit") for q in range(40)], "query_id long, text string")
    hits = questions.select("query_id").crossJoin(spark.createDataFrame([(k + 1, f"f{k}.txt", "pump limit") for k in range(3)], "rank int, path string, text string"))
    replies = spark.createDataFrame([(q, f"{(q * 7) + 1000 + q % 3}" if q % 5 else "77 77 77", ["f2.txt"]) for q in range(40)], "query_id long, answer string, sources array<string>")
    idents = spark.createDataFrame([], "ident string, path string")
    passed, form = spark.sparkContext.accumulator(0), lambda t: re.sub(r"[\s\-._]+", "", t or "").upper()

    def graded(t):
        passed.add(len(t or ""))
        return form(t)

    monkeypatch.setattr(grounding, "grader_form", lambda c: F.udf(graded)(c))
    monkeypatch.setattr(grounding, "holds", lambda a, b: F.udf(lambda t, v: form(v) != "" and form(v) in graded(t), "boolean")(a, b))
    got = {r["query_id"]: (r["citations"], r["reason"]) for r in grounding.verify_and_cite(replies, questions, hits, files_, idents).collect()}
    texts = {r["path"]: form(r["text"]) for r in files_.collect()}
    for q, (citations, reason) in got.items():
        value = form(f"{(q * 7) + 1000 + q % 3}" if q % 5 else "77 77 77")
        inside = [p for p in texts if value in texts[p]]
        assert citations == (["f2.txt"] if "f2.txt" in inside else inside[:1]) and (reason == grounding.GROUNDED) == bool(inside)
    assert sum(map(len, texts.values())) < passed.value < 4 * sum(map(len, texts.values()))


def test_links_are_those_that_the_question_does_not_hold(spark, monkeypatch):
    monkeypatch.setattr(grounding, "FIRST_LINKS", 2)
    idents = spark.createDataFrame([(f"ID{k}", p) for k in range(5) for p in ("a", "b")] + [("ID0", "c"), ("ID9", "c"), ("ID9", "d")], "ident string, path string")
    cited = spark.createDataFrame([(q, p) for q in range(4) for p in ("b", "c")], "query_id long, path string")
    value = spark.createDataFrame([(q, "a") for q in range(3)] + [(1, "d")], "query_id long, path string")
    asked = spark.createDataFrame([(0, "ABOUT"), (1, "ID0ID1"), (2, "ID0ID1ID2ID3ID4"), (3, "")], "query_id long, asked string")
    assert sorted(map(tuple, grounding.linked(cited, value, asked, idents).collect())) == [(0, "b"), (0, "c"), (1, "b"), (1, "c")]


def test_second_hop_finds_the_file_behind_an_identifier(spark):
    from plumbline.operators import grounding

    chunks = spark.createDataFrame([(1, "pump failure was filed as OPS-1847", "log.txt", False), (2, "OPS-1847 value 42", "table.csv", False), (3, "unrelated words", "x.txt", False)], "chunk_id long, text string, path string, superseded boolean")
    idents = corpus.identifier_files(chunks.select("path", "text"))
    got = grounding.expand_with_identifiers(chunks, spark.createDataFrame([(1, "pump failure"), (2, "zebra")], "query_id long, text string"), idents).orderBy("rank").collect()
    assert [(r["chunk_id"], r["hop"]) for r in got] == [(1, 1), (2, 2)]


def test_dense_blocks_hold_as_many_vectors_at_any_size(spark, monkeypatch):
    assert all(n / retrieval.salts_of(n) <= retrieval.BLOCK_VECTORS for n in (0, 1, 10**5, 10**6, 10**9))
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 10)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "chunk_id long, v array<double>")
    q = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    found = retrieval.dense_top_k(v, q, 5, block=4)
    assert re.search(r"pmod\(xxhash64\(chunk_id[^)]*\), cast\(40 as bigint\)\)", found._jdf.queryExecution().analyzed().toString())
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    want = {k: [n for n in np.lexsort((np.arange(400), -(unit @ unit[k]).round(9)))[:5] if unit[n] @ unit[k] > 0] for k in range(0, 400, 50)}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want
    streamed = retrieval.dense_top_k(v, q, 5)
    assert "Exchange hashpartitioning(s" not in streamed._jdf.queryExecution().toString()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in streamed.collect()) == sorted((q_, n + 1, c) for q_, own in want.items() for n, c in enumerate(own))


def test_fingerprints_hash_sorted_lines_without_gathering_them(spark):
    rows = [(f"h{k % 3}/d{k % 7}/é{k}.txt", k * 11 if k % 5 else None) for k in range(500)] + [("one/x.txt", 3)]
    found = corpus.folder_fingerprints(spark.createDataFrame(rows, "path string, size long"))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    keyed = spark.createDataFrame(rows, "path string, size long").select("path", "size", walk_key(F.col("path")).alias("k")).orderBy("k").collect()
    want: dict = {}
    for r in keyed:
        want.setdefault(r["path"].split("/")[0], []).append(f"{r['path']}:{-1 if r['size'] is None else r['size']}\n")
    got = {r["folder"]: (r["fingerprint"], r["n_files"]) for r in found.collect()}
    assert got == {k: (hashlib.sha1("".join(v).encode()).hexdigest(), len(v)) for k, v in want.items()}
    assert corpus.folder_fingerprints(spark.createDataFrame([], "path string, size long")).count() == 0


def test_an_index_is_kept_reused_and_mended(spark, tmp_path):
    import shutil

    from plumbline.operators import index

    root = str(tmp_path / "ix")
    with pytest.raises(index.IndexUnusable):
        index.load(spark, root)
    docs = spark.createDataFrame([(1, "a.txt", "the red fox"), (2, "b.txt", "a fox sleeps sleeps"), (3, "c.txt", "")], "chunk_id long, path string, text string")
    asked = spark.createDataFrame([(1, "fox sleeps"), (2, "zebra")], "query_id long, text string")
    want = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25(docs, asked).collect()}
    scores = lambda ix: {(r["query_id"], r["chunk_id"]): r["score"] for r in ix.bm25(asked).collect()}
    built = []
    make = lambda old: built.append(old) or docs
    first = index.load_or_build(spark, root, "f1", make)
    assert scores(first) == pytest.approx(want) and built == [None]
    assert index.load_or_build(spark, root, "f1", make).folder == first.folder and len(built) == 1  # same fingerprint
    shutil.rmtree(f"{first.folder}/postings")
    assert scores(index.load(spark, root)) == pytest.approx(want)  # missing postings are built again
    for part in (tmp_path / "ix").glob("v-*/terms/*.parquet"):
        part.write_bytes(b"garbage")
    assert scores(index.load(spark, root)) == pytest.approx(want)  # so are damaged ones
    spark.createDataFrame([(9, "z")], "chunk_id long, term string").select("term", "chunk_id", F.lit(1).cast("long").alias("tf"), F.lit(1).cast("long").alias("dl")).write.mode("overwrite").parquet(f"{first.folder}/postings")
    assert scores(index.load(spark, root)) == pytest.approx(want)  # and those out of step
    other = index.load_or_build(spark, root, "f2", make)
    assert other.folder != first.folder and built[1].fingerprint == "f1"  # the old index is there to take from
    assert tuple(other.summary().head()) == (3, 2, 3)
    assert [r["text"] for r in other.get([2]).collect()] == ["a fox sleeps sleeps"]
    newer = spark.createDataFrame([(2, "b.txt", "a zebra")], "chunk_id long, path string, text string")
    assert set(scores(index.ingest(spark, root, newer, key="path"))) == {(1, 1), (2, 2)}  # b.txt is replaced
    assert index.save(docs.limit(0), str(tmp_path / "none"), "x").search(asked).count() == 0


def test_trigram_vectors_of_short_and_null_texts(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "ABCD"), (2**60 + 1, "abcd")], "query_id long, text string")
    got = {r["query_id"]: r["v"] for r in retrieval.trigram_vectors(rows, "query_id").collect()}

    def want(grams):
        v = np.zeros(256)
        for g in grams:
            d = hashlib.blake2b(g.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "big") % 256] += 1 if d[4] % 2 == 0 else -1
        return v / np.sqrt((v**2).sum())

    for key, grams in ((1, ["ab"]), (2, [""]), (3, [""]), (4, ["abc", "bcd"]), (2**60 + 1, ["abc", "bcd"])):
        assert got[key] == pytest.approx(want(grams)), key


def test_the_first_object_of_a_reply():
    from plumbline.operators.answering import first_object

    assert first_object('<think>{"a": 0}</think> {"a": {"b": "}"}} {"c": 1}') == '{"a": {"b": "}"}}'
    assert first_object('{oops} then\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert first_object("none") is None and first_object(None) is None and first_object("{" * 3000) is None


def test_outcomes_name_each_reason_and_an_empty_corpus_raises(spark):
    from plumbline.operators import answering

    chunks = spark.createDataFrame([("a", "Pumps heat water slowly.")], "chunk_id string, text string")
    asked = spark.createDataFrame([(k,) for k in range(1, 7)], "query_id long")
    claim = lambda text, cited: f'{{"claims": [{{"text": "{text}", "cited_chunk_ids": {cited}}}], "abstained": false, "abstain_reason": null}}'
    raw = {1: claim("Pumps heat water", '["a"]'), 2: "no json", 3: '{"claims": [], "abstained": true, "abstain_reason": "not there"}', 4: claim("Engines paint walls", '["a"]'), 5: claim("Pumps heat water", '["a"]')}
    replies = spark.createDataFrame(list(raw.items()), "query_id long, raw string")
    told = answering.service_outcomes(asked, asked.filter("query_id <> 5"), replies, chunks)
    got = {r["query_id"]: r for r in told.collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {1: "answered", 2: "unparseable_generation", 3: "model_abstained", 4: "unsupported_ratio_exceeded", 5: "no_retrieval_results", 6: "unparseable_generation"}
    assert got[1]["answer"] == "Pumps heat water" and got[3]["warning"] == "not there" and got[4]["answer"] == ""
    assert {(r["counter"], r["label"]): r["n"] for r in answering.outcome_counts(told).collect()}[("queries", "abstained")] == 5
    free = answering.service_outcomes(asked, asked.limit(0), replies, chunks.limit(0), version="no-retrieval")
    assert {r["query_id"]: r["outcome"] for r in free.collect()}[4] == "answered"  # without context nothing is checked
    with pytest.raises(answering.EmptyCorpus):
        answering.service_outcomes(asked, asked, replies, chunks.limit(0))
    with pytest.raises(KeyError):
        answering.prompt_of("other")


def test_file_answers_are_all_or_nothing_and_written_whole(spark, tmp_path):
    from plumbline.operators import answering

    files_ = spark.createDataFrame([("a.txt", "pump limit is 94 C here", False)], "path string, text string, superseded boolean")
    asked = spark.createDataFrame([(k, "what is the pump limit") for k in range(1, 6)], "query_id long, text string")
    hits = spark.createDataFrame([(k, 1, "a.txt", "pump limit is 94 C here") for k in (1, 2, 3, 4)], "query_id long, rank int, path string, text string")
    ok = 'Well: {"reasoning": "r", "answerable": true, "answer": "94 C", "sources": ["A.txt"]}'
    replies = spark.createDataFrame([(1, ok), (2, "?"), (3, ok.replace("true", "false")), (4, ok.replace("94 C", "12")), (5, ok)], "query_id long, raw string")
    idents = spark.createDataFrame([], "ident string, path string")
    told = answering.file_outcomes(asked, hits, replies, files_, idents)
    got = {r["query_id"]: r for r in told.collect()}
    assert (got[1]["answer"], got[1]["citations"], got[1]["confidence"]) == ("94", ["a.txt"], 0.9)
    assert [got[k]["reason"] for k in (2, 3, 5)] == ["no usable reply", "not answerable", "nothing retrieved"]
    assert all((got[k]["answer"], got[k]["citations"], got[k]["confidence"]) == ("", [], 0.0) for k in (2, 3, 4, 5))
    odd = told.withColumn("query_id", F.concat(F.lit("q/"), F.col("query_id").cast("string")))
    answering.write_outputs(odd, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "name=q_1_output")).head()["citations"] == ["a.txt"]


def test_question_files_and_suites(spark, tmp_path):
    from plumbline.operators import answering

    good = tmp_path / "g.jsonl"
    good.write_text('{"id": "a", "query": "q1", "expected_answer": "pumps heat water"}\n\n{"id": "b", "query": "q2", "expects_abstain": true}\n')
    cases = evaluation.load_dataset(spark, str(good))
    assert [tuple(r) for r in cases.orderBy("id").collect()] == [("a", "q1", "pumps heat water", False), ("b", "q2", None, True)]
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "query": "q"}\n\nnope\n')
    with pytest.raises(ValueError, match=":3 "):
        evaluation.load_dataset(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no cases"):
        evaluation.load_dataset(spark, str(tmp_path / "none.jsonl"))
    one = '{"query": "q", "expected_answer": "x", "citations": ["f"]}'
    for text in (f"[{one}]", one + "\n" + one, f'{{"questions": [{one}]}}'):
        (tmp_path / "q.json").write_text(text)
        assert {tuple(map(str, r)) for r in evaluation.load_questions(spark, str(tmp_path / "q.json")).collect()} == {("q", "x", "['f']")}

    asked = cases.select(F.when(F.col("id") == "a", 1).otherwise(2).cast("long").alias("query_id"), F.col("query").alias("text"), "expected_answer", "expects_abstain")
    chunks = spark.createDataFrame([("c", "Pumps heat water slowly.")], "chunk_id string, text string")
    yes, no = '{"claims": [{"text": "Pumps heat water", "cited_chunk_ids": ["c"]}], "abstained": false}', '{"claims": [], "abstained": true}'
    replies = spark.createDataFrame([("cited", 1, yes, 5.0, 7), ("cited", 2, no, 5.0, 7), ("no-retrieval", 1, no, 1.0, 3), ("no-retrieval", 2, yes, 1.0, 3)], "prompt_version string, query_id long, raw string, latency_ms double, tokens long")
    report = evaluation.ablation_report(evaluation.run_suite(asked, ["cited", "no-retrieval"], asked, replies, chunks))
    assert {r["prompt_version"]: r["accuracy"] for r in report.collect()} == {"cited": 1.0, "no-retrieval": 0.0}
    text = evaluation.render_markdown(report)
    assert text.count("\n") == 4 and "| cited | 2 | 100.0% |" in text
    assert answering.prompt_of().version == "cited"
