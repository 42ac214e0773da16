"""The kept index: segments, versions, bounds, identifiers and streams, against plans over the whole texts."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import corpus, grounding, index, retrieval
from plumbline.plans import catalogue

CHUNKS = "chunk_id long, document_id string, path string, superseded boolean, text string"
WORDS = [f"w{k}" for k in range(60)] + ["common"] * 40


def made(seed: int, start: int, n: int, prefix: str = "d") -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for k in range(start, start + n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) + (f" PN-{k % 9}X{k % 5} " if k % 3 else "")
        out.append((k, f"{prefix}{k // 2}", f"{prefix}{k // 2}.txt", k % 7 == 0, text if k % 11 else None))
    return out


def rows(df) -> list[tuple]:
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(k, f"common W{k} w{k + 7} w{k} zebra") for k in range(12)] + [(50, "nothing here"), (51, None), (2**60 + 1, "w3")], "query_id long, text string")


@pytest.fixture
def small(monkeypatch):
    """Many blocks, folders and bounds from few rows."""
    for name, value in (("BLOCK_CHUNKS", 3), ("PART_CHUNKS", 10), ("FIRST_BLOCKS", 2)):
        monkeypatch.setattr(index, name, value)


def stamps(root: str, folders: list[str]) -> dict:
    return {str(p): p.stat().st_mtime_ns for f in folders for p in Path(f).rglob("*") if p.is_file()}


def test_ingests_add_segments_and_equal_a_full_build(spark, tmp_path, asked, small):
    first, second, third = made(1, 0, 60), made(2, 100, 30, "e"), made(3, 20, 16)  # the third replaces d10 to d17
    root = str(tmp_path / "ix")
    frame = lambda r: spark.createDataFrame(r, CHUNKS)
    one = index.ingest(spark, root, frame(first))
    before = stamps(root, [one.folder])
    two = index.ingest(spark, root, frame(second))
    three = index.ingest(spark, root, frame(third))
    assert [s.number for s in three.segments] == [1, 2, 3] and stamps(root, [one.folder]) == before
    gone = {r[1] for r in third}
    left = [r for r in first + second if r[1] not in gone] + third
    whole = index.save(frame(left), str(tmp_path / "whole"), "x")
    assert (three.n_chunks, three.n_tokens, three.avgdl) == (whole.n_chunks, whole.n_tokens, whole.avgdl)
    assert rows(three.terms) == rows(whole.terms) and rows(three.postings) == rows(whole.postings)
    assert rows(three.chunks.select("chunk_id", "text").na.fill("")) == rows(whole.chunks.select("chunk_id", "text").na.fill(""))
    plain = retrieval.bm25(frame(left), asked)
    assert rows(three.bm25(asked)) == rows(whole.bm25(asked)) == rows(plain)
    assert rows(three.vectors()) == rows(whole.vectors())
    joined = index.compact(three)
    assert len(joined.segments) == 1 and rows(joined.bm25(asked)) == rows(plain) and index.dead_share(three) > 0 == index.dead_share(joined)
    # Versions that were loaded before still answer, as they did.
    assert rows(two.bm25(asked)) == rows(retrieval.bm25(frame(first + second), asked))
    assert index.prune(spark, root, keep=1) == [joined.seq] and not Path(one.folder).exists()
    assert rows(index.load(spark, root).bm25(asked)) == rows(plain)


def test_a_pruned_search_is_the_whole_search(spark, tmp_path, asked, small):
    root = str(tmp_path / "ix")
    frame = lambda r: spark.createDataFrame(r, CHUNKS)
    index.ingest(spark, root, frame(made(4, 0, 150)))
    kept = index.ingest(spark, root, frame(made(5, 0, 40)))
    for k in (1, 3, 10):
        want = rows(retrieval.top_k(kept.bm25(asked), k))
        assert all(rows(kept.search(asked, k, prune=how)) == want for how in ("blocks", "terms", "none"))
    assert rows(kept.search(asked, 4, k1=1.4, b=0.3, prune="terms")) == rows(kept.search(asked, 4, k1=1.4, b=0.3, prune="blocks")) == rows(retrieval.top_k(kept.bm25(asked, k1=1.4, b=0.3), 4))


def test_bounds_close_most_blocks_where_a_rare_term_decides(spark, tmp_path, small, monkeypatch):
    """A term that every chunk holds and one that few hold: blocks without the rare one can't reach the best."""
    data = [(k, f"d{k}", f"d{k}", False, "common " * (1 + k % 3) + ("rare " * 3 if k % 50 == 0 else "other")) for k in range(300)]
    kept = index.save(spark.createDataFrame(data, CHUNKS), str(tmp_path / "ix"), "x")
    query = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    opened = []
    scores = index.EvidenceIndex._scores

    def counted(self, blocks, weighed, k1, b):
        opened.append(weighed.select("block").distinct().count() if "block" in weighed.columns else None)
        return scores(self, blocks, weighed, k1, b)

    monkeypatch.setattr(index.EvidenceIndex, "_scores", counted)
    assert {r["chunk_id"] % 50 for r in kept.search(query, 2, prune="blocks").collect()} == {0}
    assert opened[0] == 2 and sum(opened) < 20 < 300 // index.BLOCK_CHUNKS


def test_frequent_terms_alone_are_not_gathered(spark, tmp_path, small, monkeypatch):
    data = [(k, f"d{k}", f"d{k}", False, "common usual " * (1 + k % 3) + ("rare odd seldom" if k % 50 == 0 else f"other{k}")) for k in range(300)]
    kept = index.save(spark.createDataFrame(data, CHUNKS), str(tmp_path / "ix"), "x")
    query = spark.createDataFrame([(1, "common usual rare odd seldom"), (2, "common"), (3, "other7 rare common")], "query_id long, text string")
    gathered = []
    parts = index.EvidenceIndex._parts

    def counted(self, blocks, weighed, k1, b):
        gathered.append(rows(weighed.select("query_id", "term")))
        return parts(self, blocks, weighed, k1, b)

    want = rows(kept.search(query, 4, prune="none"))
    monkeypatch.setattr(index.EvidenceIndex, "_parts", counted)
    assert rows(kept.search(query, 4, prune="terms")) == want
    rough, needed, left_out = gathered
    assert (1, "common") not in rough + needed and {(1, "common"), (1, "usual")} <= set(left_out) and (2, "common") in needed


def test_questions_share_what_their_frequent_terms_bring(spark, tmp_path, small, monkeypatch):
    """Questions that differ in rare terms only: the frequent terms' postings are met once, not once a question."""
    monkeypatch.setattr(index, "SELDOM", 6)
    monkeypatch.setattr(index, "MOST_ENTRIES", 2000)
    data = [(k, f"d{k}", f"d{k}", False, f"common {'usual' if k % 3 else 'plain plain'} slot{k} pair{k // 2}") for k in range(300)]
    root = str(tmp_path / "ix")
    index.ingest(spark, root, spark.createDataFrame(data, CHUNKS))
    again = [(k, f"d{k}", f"d{k}", False, f"common usual slot{k} slot{k + 1} new") for k in range(0, 300, 50)]
    kept = index.ingest(spark, root, spark.createDataFrame(again, CHUNKS))
    texts = [(k, f"common {'usual' if k % 2 else 'plain'} slot{k * 7} pair{k}") for k in range(40)] + [(70, "slot3 pair4"), (71, "nothing"), (72, None), (73, "new common"), (74, "common usual")]
    query = spark.createDataFrame(texts, "query_id long, text string")
    want = {k: rows(retrieval.top_k(kept.bm25(query), k)) for k in (1, 4, 400)}
    met = []
    parts = index.EvidenceIndex._parts

    def counted(self, blocks, weighed, k1, b):
        met.append({r["term"] for r in weighed.select("term").distinct().collect()})
        return parts(self, blocks, weighed, k1, b)

    monkeypatch.setattr(index.EvidenceIndex, "_parts", counted)
    assert all(rows(kept.search(query, k)) == found for k, found in want.items())
    assert len(met) == 3 and not set().union(*met) & {"common", "usual", "plain"}


def test_blocks_are_scored_in_tasks_and_no_score_is_shuffled(spark, tmp_path, small, monkeypatch):
    """Long questions over many postings: what is shuffled are rows of postings, and the best of each block."""
    root = str(tmp_path / "ix")
    index.ingest(spark, root, spark.createDataFrame(made(6, 0, 150), CHUNKS))
    kept = index.ingest(spark, root, spark.createDataFrame(made(7, 200, 90, "e"), CHUNKS))
    query = spark.createDataFrame([(k, f"common W{k} w{k + 7} w{k} zebra") for k in range(12)] + [(50, "nothing here"), (51, None), (2**60 + 1, "w3")], "query_id long, text string")
    want = {k: rows(retrieval.top_k(kept.bm25(query), k)) for k in (1, 5, 400)}
    assert all(rows(kept.search(query, k, prune="tasks")) == found for k, found in want.items())
    monkeypatch.setattr(index, "MOST_ENTRIES", 10)
    monkeypatch.setattr(index, "SELDOM", 0)
    monkeypatch.setattr(index.EvidenceIndex, "_parts", lambda *a, **b: pytest.fail("scores of single terms"))
    assert rows(kept.search(query, 5)) == want[5]
    named = index.save(spark.createDataFrame([(f"é{r[0]}", *r[1:]) for r in made(6, 0, 60)], CHUNKS.replace("chunk_id long", "chunk_id string")), str(tmp_path / "named"), "x")
    texts = query.select(F.col("query_id").cast("string").alias("query_id"), "text")
    assert {type(r["chunk_id"]) for r in named.search(texts, 3).collect()} == {str}


@pytest.mark.parametrize("name", ["file_prompts", "service_context"])
def test_only_texts_of_hits_are_read(spark, monkeypatch, name):
    """No join of all texts: hits ask the index for theirs."""
    asked, texts_of = [], index.EvidenceIndex.texts_of
    monkeypatch.setattr(index.EvidenceIndex, "texts_of", lambda self, ids: asked.append(ids.count()) or texts_of(self, ids))
    got = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 40 and len(asked) == 1 and 40 <= asked[0] <= 400


def test_folders_of_other_terms_and_chunks_are_not_read(spark, tmp_path, small):
    data = [(k, f"d{k}", f"d{k}", False, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 3} tail{k}") for k in range(200)]
    kept = index.save(spark.createDataFrame(data, CHUNKS), str(tmp_path / "ix"), "x")
    query = spark.createDataFrame([(1, "ccc")], "query_id long, text string")
    want = rows(kept.search(query, 5))
    assert len(want) == 5
    parts = {r["part"] for r in spark.read.parquet(f"{kept.folder}/postings").filter("term = 'ccc'").select("part").distinct().collect()}
    folders = list(Path(kept.folder, "postings").glob("part=*"))
    assert len(folders) > 5 > len(parts)
    for folder in folders:
        if int(folder.name[5:]) not in parts:
            for p in folder.glob("*.parquet"):
                p.write_bytes(b"garbage")
    assert rows(kept.search(query, 5, prune="none")) == rows(kept.search(query, 5, prune="blocks")) == want
    held = spark.read.parquet(f"{kept.folder}/chunks").select("chunk_id", F.col("_metadata.file_name").alias("f")).filter("chunk_id = 7").head()["f"]
    others = [p for p in Path(kept.folder, "chunks").glob("*.parquet") if p.name != held]
    assert others
    for p in others:  # only ids are read of other files
        bare = spark.read.parquet(str(p)).select("chunk_id").toPandas()
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
        bare.to_parquet(p)
    
    assert [r["text"] for r in kept.get([7]).collect()] == ["hhh tail7"]


def test_other_terms_or_layouts_are_not_used(spark, tmp_path):
    root = str(tmp_path / "ix")
    index.save(spark.createDataFrame([(1, "d", "d", False, "cats")], CHUNKS), root, "x", tokenize=X.file_tokens)
    with pytest.raises(index.IndexUnusable, match="file_tokens"):
        index.load(spark, root)
    with pytest.raises(index.IndexUnusable):
        index.load(spark, root, tokenize=X.file_tokens, with_path=True)
    cats = spark.createDataFrame([(1, "cats")], "query_id long, text string")
    assert index.load_or_build(spark, root, "x", lambda _: spark.createDataFrame([(1, "d", "d", False, "cats")], CHUNKS)).search(cats).count() == 1
    with pytest.raises(index.IndexUnusable):
        index.ingest(spark, root, spark.createDataFrame([(2, "e", "e", False, "cats")], CHUNKS), tokenize=X.file_tokens)


def test_mending_makes_a_new_version_and_readers_keep_theirs(spark, tmp_path, asked):
    root = str(tmp_path / "ix")
    data = spark.createDataFrame(made(6, 0, 30), CHUNKS)
    index.save(data, root, "x")
    reader = index.ingest(spark, root, spark.createDataFrame(made(7, 4, 6), CHUNKS))
    want, before = rows(reader.bm25(asked)), stamps(root, [s.folder for s in reader.segments])
    for p in Path(reader.segments[0].folder, "terms").glob("*.parquet"):
        p.write_bytes(b"garbage")
    mended = index.load(spark, root)
    assert mended.seq == reader.seq + 1 and mended.fingerprint == reader.fingerprint and rows(mended.bm25(asked)) == want
    after = stamps(root, [s.folder for s in reader.segments])
    assert {p for p in before if before[p] != after[p]} == {p for p in before if "/terms/" in p and reader.segments[0].folder in p and p.endswith(".parquet") and "/." not in p}
    assert rows(index.load(spark, root, seq=reader.seq).chunks.select("chunk_id")) == rows(reader.chunks.select("chunk_id"))


def test_the_second_writer_starts_over(spark, tmp_path, asked, monkeypatch):
    root = str(tmp_path / "ix")
    frame = lambda r: spark.createDataFrame(r, CHUNKS)
    index.ingest(spark, root, frame(made(8, 0, 10)))
    commit, done = index._commit, []

    def late(*args):
        if not done:  # another writer commits first
            done.append(index)
            index.ingest(spark, root, frame(made(9, 100, 6, "other")))
        return commit(*args)

    monkeypatch.setattr(index, "_commit", late)
    kept = index.ingest(spark, root, frame(made(10, 200, 6, "late")))
    want = made(8, 0, 10) + made(9, 100, 6, "other") + made(10, 200, 6, "late")
    assert kept.seq == 3 and rows(kept.bm25(asked)) == rows(retrieval.bm25(frame(want), asked))
    monkeypatch.setattr(index, "_commit", lambda *_: None)
    with pytest.raises(index.IndexBusy):
        index.ingest(spark, root, frame(made(11, 300, 2, "never")))


def test_many_ingests_are_made_one_segment(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(index, "MOST_SEGMENTS", 2)
    root, every = str(tmp_path / "ix"), []
    for k in range(3):
        every += made(20 + k, 100 * k, 4, f"s{k}")
        kept = index.ingest(spark, root, spark.createDataFrame(made(20 + k, 100 * k, 4, f"s{k}"), CHUNKS))
    assert len(kept.segments) == 1 and rows(kept.bm25(asked)) == rows(retrieval.bm25(spark.createDataFrame(every, CHUNKS), asked))
    same = index.ingest(spark, root, spark.createDataFrame([], CHUNKS))
    assert same.seq == kept.seq


def test_a_stream_is_ingested_once(spark, tmp_path, asked):
    folder, root = tmp_path / "in", str(tmp_path / "ix")
    first, second = made(30, 0, 8), made(31, 4, 8)
    for name, data in (("a", first), ("b", second)):
        spark.createDataFrame(data, CHUNKS).coalesce(1).write.mode("append").json(str(folder / name))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))
    index.follow(stream, root, "feed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    kept = index.load(spark, root)
    assert kept.batches == {"feed": 1}
    orders = [[r for r in a if r[1] not in {x[1] for x in b}] + b for a, b in ((first, second), (second, first))]
    assert rows(kept.bm25(asked)) in [rows(retrieval.bm25(spark.createDataFrame(o, CHUNKS), asked)) for o in orders]
    again = index.ingest(spark, root, spark.createDataFrame(made(32, 50, 3), CHUNKS), batch=("feed", 1))  # sent twice
    assert again.seq == kept.seq
    assert index.ingest(spark, root, spark.createDataFrame(made(32, 50, 3), CHUNKS), batch=("feed", 2)).batches == {"feed": 2}


def test_the_second_hop_reads_no_text(spark, tmp_path, asked, monkeypatch):
    data = [(k, f"f{k % 9}", f"f{k % 9}.txt", k % 5 == 0, f"pump {WORDS[k % 60]} failed, see OPS-{k % 14:03d}A common") for k in range(60)]
    data += [(100 + k, f"t{k}", f"table{k}.csv", False, f"OPS-{k:03d}A value {k}") for k in range(14)]
    chunks = spark.createDataFrame(data, CHUNKS)
    kept = index.save(chunks, str(tmp_path / "ix"), "x", tokenize=X.file_tokens, with_path=True)
    want = grounding.expand_with_identifiers(chunks, asked, corpus.identifier_files(chunks.select("path", "text")))
    got = kept.expand(asked)
    columns = ["query_id", "rank", "chunk_id", "path", "hop"]
    assert rows(got.select(*columns)) == rows(want.select(*columns)) and got.filter("hop = 2").count()
    for p in Path(kept.folder, "chunks").rglob("*.parquet"):  # without its texts the table still does
        bare = spark.read.parquet(str(p)).drop("text").toPandas()
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
        bare.to_parquet(p)
    assert rows(kept.expand(asked).select(*columns)) == rows(want.select(*columns))
    files = rows(kept.identifier_files().select("ident", "path", "n_files"))
    assert files == rows(corpus.identifier_files(chunks.select("path", "text")).select("ident", F.explode("files").alias("path"), "n_files"))


def test_texts_of_files_come_in_order(spark, tmp_path):
    data = [(k, "d", f"f{k % 2}.txt", False, f"line {k}") for k in range(5)]
    kept = index.save(spark.createDataFrame(data, CHUNKS), str(tmp_path / "ix"), "x", tokenize=X.file_tokens, with_path=True)
    got = kept.file_texts(spark.createDataFrame([("f0.txt",), ("none",)], "path string")).collect()
    assert [(r["path"], r["text"]) for r in got] == [("f0.txt", "line 0\nline 2\nline 4")]
