"""Both engines, from documents and files to answers."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.engine import ContractEngine, Engine, Settings
from plumbline.functions import text as X
from plumbline.operators import answering, index

HANDBOOK = """# Pumps

The main pump runs at 94 degrees in summer mode. The spare pump stands in hall 3.

# Valves

Each valve opens after 30 seconds. Valves are checked every year.
"""
ERRATA = """# Valves

Each valve opens after 45 seconds of waiting. Older notes are wrong.
"""


def claims(*rows: tuple[str, list[str]], abstained: bool = False) -> str:
    return json.dumps({"claims": [{"text": t, "cited_chunk_ids": c} for t, c in rows], "abstained": abstained})


def test_documents_are_ingested_searched_and_answered(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "ix"))
    asked = spark.createDataFrame([(1, "When does each valve open?"), (2, "At which degrees does the main pump run?"), (3, "zzzz qqqq"), (4, "How often are valves checked?")], "query_id long, text string")
    with pytest.raises(answering.EmptyCorpus):
        engine.search(asked)
    docs = spark.createDataFrame([("handbook", HANDBOOK, "Handbook"), ("errata", ERRATA, "")], "document_id string, text string, title string")
    engine.ingest(docs)
    assert tuple(engine.info().select("documents", "chunks", "segments").head()) == (2, 3, 1)
    hits = engine.search(asked)
    best = {r["query_id"]: r for r in hits.filter("rank = 1").collect()}
    assert best[1]["document_id"] in ("handbook", "errata") and best[2]["label"] == "Handbook §Pumps" and 3 not in best
    told = {r["query_id"]: r for r in engine.prompts(asked).collect()}
    assert set(told) == {1, 2, 4} and f"[{best[2]['chunk_id']}] (Handbook §Pumps)" in told[2]["user"] and told[2]["user"].endswith("At which degrees does the main pump run?")
    assert {r["query_id"] for r in engine.prompts(asked, "no-retrieval").collect()} == {1, 2, 3, 4}
    pump = best[2]["chunk_id"]
    replies = spark.createDataFrame([(1, claims(("Each valve opens after 30 seconds", [best[1]["chunk_id"]]), ("The moon is green cheese", [pump]))), (2, "```json\n" + claims(("The main pump runs at 94 degrees", [pump])) + "\n```"), (3, claims(("x", []))), (4, claims(abstained=True))], "query_id long, raw string")
    got = {r["query_id"]: r for r in engine.answer(asked, replies).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {1: answering.UNSUPPORTED, 2: answering.ANSWERED, 3: answering.NO_RESULTS, 4: answering.DECLINED}
    assert got[1]["n_conflicts"] >= 1 and got[1]["answer"] == ""
    # The same document again replaces its chunks; an unknown prompt is an error at once.
    engine.ingest(docs.filter("document_id = 'errata'").withColumn("text", F.lit("# Valves\n\nNothing new.")))
    assert tuple(engine.info().select("documents", "chunks", "segments").head()) == (2, 3, 2)
    assert engine.index.get(["errata::0000"]).head()["text"] == "Nothing new."
    with pytest.raises(KeyError):
        Engine(spark, str(tmp_path / "ix"), Settings(prompt="none"))


def book(path) -> None:
    """A workbook of one sheet with inline texts."""
    rows = "".join(f'<row>{"".join(f"<c t=\"inlineStr\"><is><t>{c}</t></is></c>" for c in r)}</row>' for r in (("part", "limit"), ("P-100X", "94 C"), ("P-200X", "81 C")))
    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{sheet}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Limits" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{sheet}"><sheetData>{rows}</sheetData></worksheet>')


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    (top / "spec").mkdir()
    (top / "logs").mkdir()
    (top / "spec" / "pump_r1.txt").write_text("Pump P-100X limit in summer mode is 90 C.\n")
    (top / "spec" / "pump_r2.txt").write_text("Pump P-100X limit in summer mode is 94 C.\n")
    (top / "logs" / "2026.log").write_text("failure of the cooling loop was filed as OPS-1847X\nnothing else\n")
    (top / "logs" / "tickets.csv").write_text("ticket,hours\nOPS-1847X,17\nOPS-1848X,3\n")
    (top / "label.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (top / "blob.bin").write_bytes(b"\0\1\2")
    book(top / "limits.xlsx")
    return top


def value(answer: str, *sources: str, answerable: bool = True) -> str:
    return json.dumps({"reasoning": "r", "answerable": answerable, "answer": answer, "sources": list(sources)})


def test_a_folder_is_indexed_asked_and_answered(spark, tmp_path, folder):
    engine, out = ContractEngine(spark, str(tmp_path / "ix")), str(tmp_path / "out")
    questions = spark.createDataFrame(
        [("q1", "What is the limit of pump P-100X in summer mode?"), ("q2", "How many hours did the ticket of the cooling loop failure take?"), ("q3", "zzzz qqqq xxxx"), ("q4", "What is the limit of pump P-100X in summer mode?"), ("q5", "Which serial is on the board label?"), ("q/6", "How many hours did the ticket of the cooling loop failure take?")],
        "query_id string, text string",
    )
    with pytest.raises(answering.EmptyCorpus):
        engine.hits(questions)
    assert tuple(engine.index(str(folder)).head()) == (7, 5, 9)
    docs = {r["path"]: r for r in engine.kept.docs.collect()}
    assert docs["spec/pump_r1.txt"]["superseded_by"] == "spec/pump_r2.txt" and docs["label.png"]["reason"] == "image (needs the vision model)" and docs["blob.bin"]["reason"] == "unknown file type"

    seen = spark.createDataFrame([("label.png", "Board label: serial SN-77A1")], "path string, text string")
    assert tuple(engine.index(str(folder), seen).head()) == (7, 6, 10)
    before = engine.kept.seq
    assert tuple(engine.index(str(folder), seen).head()) == (7, 6, 10) and engine.kept.seq == before  # nothing is built again
    assert tuple(engine.index(str(folder)).head()) == (7, 6, 10)  # transcripts are taken from the older index

    hits = engine.hits(questions).collect()
    assert {r["path"] for r in hits if r["query_id"] == "q2"} >= {"logs/tickets.csv", "logs/2026.log"}
    prompts = {r["query_id"]: r["prompt"] for r in engine.prompts(questions).collect()}
    assert "q3" not in prompts and "[FILE spec/pump_r1.txt | superseded by spec/pump_r2.txt]" in prompts["q1"]

    replies = spark.createDataFrame(
        [("q1", value("94 C", "/app/corpus/spec/pump_r2.txt", "spec/pump_r1.txt")), ("q2", "<think>hm</think>" + value("17", "logs/2026.log")), ("q3", value("1", "blob.bin")), ("q4", value("12", "spec/pump_r2.txt")), ("q5", value("SN-77A1", "label.png")), ("q/6", value("17", answerable=False))],
        "query_id string, raw string",
    )
    got = {r["query_id"]: r for r in engine.answer(questions, replies, out).collect()}
    assert (got["q1"]["answer"], got["q1"]["citations"], got["q1"]["reason"]) == ("94", ["spec/pump_r2.txt"], "grounded")
    # The value stands in the list that the log's ticket leads to, whatever the reply cites.
    assert got["q2"]["answer"] == "17" and got["q2"]["citations"][0] == "logs/tickets.csv" and "logs/2026.log" in got["q2"]["citations"]
    assert got["q5"]["citations"] == ["label.png"]
    assert {k: got[k]["reason"] for k in ("q3", "q4", "q/6")} == {"q3": "nothing retrieved", "q4": "answer not found in any retrieved file", "q/6": "not answerable"}
    assert all((r["answer"], r["citations"], r["confidence"]) == ("", [], 0.0) for k, r in got.items() if k in ("q3", "q4", "q/6"))
    written = {r["name"]: r["answer"] for r in spark.read.json(out).select("name", "answer").collect()}
    assert {"q1_output", "q2_output", "q3_output", "q_6_output"} < set(written) and written["q1_output"] == "94"


def test_questions_that_share_terms_are_answered_from_one_version(spark, tmp_path, monkeypatch):
    """Many alike questions, with shared terms worked out once, and an index that is looked up once a batch."""
    monkeypatch.setattr(index, "SELDOM", 3)
    monkeypatch.setattr(index, "MOST_ENTRIES", 100)
    chunks = [(2 * k, f"steel ring slot{k} PN-{k}Z", f"parts{k % 2}.csv", False) for k in range(30)] + [(2 * k + 1, f"PN-{k}Z retail price {k + 100}.50", f"stock{k % 3}.txt", False) for k in range(30)]
    frame = spark.createDataFrame(chunks, "chunk_id long, text string, path string, superseded boolean")
    docs = frame.select("path", "superseded").distinct().withColumn("indexed", F.lit(True))
    index.save(frame, str(tmp_path / "ix"), "x", tokenize=X.file_tokens, with_path=True, docs=docs)
    loads, load = [], index.load
    monkeypatch.setattr(index, "load", lambda *a, **b: loads.append(a) or load(*a, **b))
    questions = spark.createDataFrame([(k, f"what is the retail price of steel ring in slot{k}") for k in range(12)], "query_id long, text string")
    replies = spark.createDataFrame([(k, value(f"{k + 100}.50", f"stock{k % 3}.txt", f"parts{k % 2}.csv")) for k in range(12)], "query_id long, raw string")
    searched, by_sets = [], index.EvidenceIndex._by_sets
    monkeypatch.setattr(index.EvidenceIndex, "_by_sets", lambda *a, **b: searched.append(1) or by_sets(*a, **b))
    got = ContractEngine(spark, str(tmp_path / "ix")).answer(questions, replies)
    assert {r["query_id"]: (r["answer"], r["citations"]) for r in got.collect()} == {k: (f"{k + 100}.50", [f"stock{k % 3}.txt", f"parts{k % 2}.csv"]) for k in range(12)}
    assert len(loads) == 1 and len(searched) == 2


def test_outputs_of_other_batches_and_ids_stay(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = lambda rows: spark.createDataFrame([(q, a, ["f"], 0.9) for q, a in rows], "query_id string, answer string, citations array<string>, confidence double")
    answering.write_outputs(frame([("q1", "one"), ("a/b", "slash"), ("a_b", "plain"), (None, "nameless")]), out)
    answering.write_outputs(frame([("q2", "two"), ("q1", "uno")]), out)
    got = {r["name"]: r["answer"] for r in spark.read.json(out).select("name", "answer").collect()}
    other = next(n for n in got if n.startswith("a_b-"))
    assert {k: v for k, v in got.items() if k != other} == {"q1_output": "uno", "q2_output": "two", "a_b_output": "plain", "query_output": "nameless"} and got[other] == "slash"
