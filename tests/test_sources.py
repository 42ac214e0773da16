"""Folders as a data source, and the insides of office files."""

from __future__ import annotations

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions.paths import kind_of, walk_key
from plumbline.operators import corpus
from plumbline.sources import files, folder, office

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(**targets: tuple[str, str]) -> str:
    return f'<Relationships xmlns="{P}">' + "".join(f'<Relationship Id="{k}" Type="{R}/{kind}" Target="{t}"/>' for k, (kind, t) in targets.items()) + "</Relationships>"


def workbook(sheets: list[tuple[str, str, str]], parts: dict[str, str], pr: str = "", **more: tuple[str, str]) -> bytes:
    """sheets: title, relationship id, part below xl."""
    listed = "".join(f'<sheet name="{t}" sheetId="{k}" r:id="{i}"/>' for k, (t, i, _) in enumerate(sheets, 1))
    return package({
        "_rels/.rels": rels(rId1=("officeDocument", "/xl/book.xml")),
        "xl/book.xml": f'<workbook xmlns="{S}" xmlns:r="{R}">{pr}<sheets>{listed}</sheets></workbook>',
        "xl/_rels/book.xml.rels": rels(**{i: ("chartsheet" if "chart" in p else "worksheet", p) for _, i, p in sheets}, **more),
        **parts,
    })


def sheet(*rows: str) -> str:
    return f'<worksheet xmlns="{S}"><sheetData>{"".join(rows)}</sheetData></worksheet>'


def texts(raw: bytes) -> list[str]:
    return [t for _, t in files._xlsx(raw)]


def test_sheets_are_found_by_their_relationships():
    """The first sheet was deleted, the others reordered, one is a chart."""
    raw = workbook(
        [("Late", "rId7", "worksheets/sheet2.xml"), ("Chart", "rId9", "chartsheets/sheet1.xml"), ("Early", "rId3", "/xl/worksheets/other.xml")],
        {"xl/worksheets/sheet2.xml": sheet("<row><c><v>2</v></c></row>"), "xl/worksheets/other.xml": sheet("<row><c><v>3</v></c></row>")},
    )
    assert texts(raw) == ["sheet Late header | 2", "sheet Early header | 3"]


def test_cells_are_told_as_they_are_shown():
    styles = f'<styleSheet xmlns="{S}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/><numFmt numFmtId="166" formatCode="[h]:mm"/><numFmt numFmtId="167" formatCode="[Red]0.0"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{k}"/>' for k in (0, 14, 164, 165, 166, 167, 21)) + "</cellXfs></styleSheet>"
    strings = f'<sst xmlns="{S}"><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>reading</t></rPh></si></sst>'
    cells = [
        ('t="s"', "0", "plain"), ('t="s"', "1", "rich text"), ('t="b"', "1", "True"), ('t="b"', "0", "False"), ("", "5.0", "5"), ("", "2.50", "2.5"), ("", "1E3", "1000"), ('s="1"', "45366", "2024-03-15 00:00:00"), ('s="2"', "45366.75", "2024-03-15 18:00:00"),
        ('s="3"', "12", "12"), ('s="4"', "1.5", "1 day, 12:00:00"), ('s="5"', "7", "7"), ('s="6"', "0.25", "06:00:00"), ('s="1"', "59", "1900-02-28 00:00:00"), ('s="1"', "61", "1900-03-01 00:00:00"), ('t="e"', "#DIV/0!", "#DIV/0!"), ('t="str"', "sum", "sum"), ('t="d"', "2024-03-15T10:20:30Z", "2024-03-15 10:20:30"), ("", "12345678901234567890", "12345678901234567890"),
    ]
    rows = "".join(f"<c {a}><v>{v}</v></c>" for a, v, _ in cells)
    raw = workbook([("D", "rId1", "s.xml")], {"xl/s.xml": sheet(f'<row r="3">{rows}</row>', '<row r="6"><c r="C6"><v>9</v></c></row>'), "xl/styles.xml": styles, "xl/strings.xml": strings}, rId8=("styles", "styles.xml"), rId9=("sharedStrings", "strings.xml"))
    found = files._xlsx(raw)
    assert found[0] == ("sheet D row 3", "sheet D header | " + " | ".join(t for _, _, t in cells))
    assert found[1] == ("sheet D row 6", "sheet D | True: 9")
    later = workbook([("D", "rId1", "s.xml")], {"xl/s.xml": sheet('<row><c s="1"><v>0</v></c><c s="1"><v>1.5</v></c></row>'), "xl/styles.xml": styles}, pr='<workbookPr date1904="1"/>', rId8=("styles", "styles.xml"))
    assert texts(later) == ["sheet D header | 1904-01-01 00:00:00 | 1904-01-02 12:00:00"]


@pytest.mark.parametrize(("code", "date"), [("d/m/yy", True), ("h:mm AM/PM", True), ('0 "days"', False), ("[Red]0.00", False), ("[$-409]mmm", True), ("General", False), ("0\\d", False), ('#,##0;[Red]"d"', False), ("[mm]:ss", True)])
def test_formats_are_dates_by_their_tokens(code, date):
    assert office.is_date_format(code) is date


def p(*runs: str, style: str = "") -> str:
    own = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{own}{''.join(r if r.startswith('<w:') else f'<w:r><w:t>{r}</w:t></w:r>' for r in runs)}</w:p>"


def document(*body: str, styles: str = "") -> bytes:
    return package({
        "_rels/.rels": rels(rId1=("officeDocument", "word/document.xml")),
        "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(rId1=("styles", "styles.xml")),
        "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>',
    })


def test_documents_keep_headings_tabs_and_tables():
    styles = '<w:style w:type="paragraph" w:styleId="a1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="Heading9x"><w:name w:val="Body"/></w:style>'
    cell = lambda text, props="", inner="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}{inner}</w:tc>"
    nested = f"<w:tbl><w:tr>{cell('inner')}</w:tr></w:tbl>"
    table = (
        f"<w:tbl><w:tr>{cell('name')}{cell('wide', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}{cell('end')}</w:tr>"
        f"<w:tr>{cell('pump', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('a', inner=nested)}{cell('b')}{cell('c')}</w:tr>"
        f"<w:tr>{cell('', '<w:vMerge/>')}{cell('d')}{cell('')}{cell('')}</w:tr></w:tbl>"
    )
    raw = document(
        p("Top", style="a1"), p("plain", style="Heading9x"), p("a", "<w:r><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:noBreakHyphen/></w:r>"), p("<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink>", "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del>"),
        table, p("after"), styles=styles,
    )
    got = files._docx(raw)
    assert got[0] == ("paragraphs", "# Top\nplain\na\tb\nc-\nlink")
    assert [t for _, t in got[1:4]] == ["table 1 header | name | wide | end", "table 1 | name: pump | wide: a | end: b | c", "table 1 | name: pump | wide: d"]
    assert got[4] == ("paragraphs", "after")
    assert files.parse_one("d.docx", "docx", document(p("Do not use: old"))) == ([("paragraphs", "Do not use: old")], None, True)


def test_reasons_of_files_without_text():
    told = lambda name, raw, kind: files.parse_one(name, kind, raw)[1]
    assert told("a.csv", b" \n", "csv") == told("a.txt", b"", "text") == "empty file"
    assert told("a.docx", document(), "docx") == "no extractable text" and told("b.xlsx", b"no zip", "xlsx").startswith("xlsx: BadZipFile")
    assert told("x", b"", None) == "unknown file type" and "vision" in told("x.png", b"", "image")
    assert files.parse_one("t.csv", "csv", b"a,,c\n1,2,3\n")[0] == [("t row 1", "t header | a |  | c"), ("t row 2", "t | a: 1 | col2: 2 | c: 3")]


@pytest.fixture
def tree(tmp_path):
    for name in ["b.txt", "a.txt", "sub/c.txt", "sub/_x/.x.txt", "__pycache__/x.pyc", ".git/config", "sub/deep/d.csv", "é.md", "noext"]:
        target = tmp_path / "top" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"text of {name}\n")
    return tmp_path / "top"


ORDER = ["a.txt", "b.txt", "noext", "é.md", "sub/c.txt", "sub/_x/.x.txt", "sub/deep/d.csv"]


def test_a_folder_is_walked_in_order_with_hidden_names(spark, tree, tmp_path):
    assert [f.path for f in folder.walk(str(tree))] == ORDER
    for options in ({}, {"partitionFiles": 2}, {"partitionBytes": 1}):
        got = folder.scan(spark, str(tree), **options).orderBy("position").collect()
        assert [r["path"] for r in got] == ORDER and [r["position"] for r in got] == list(range(7))
    assert folder.scan(spark, str(tree), partitionFiles=2).rdd.getNumPartitions() == 4
    rows = {r["path"]: r for r in got}
    assert rows["sub/_x/.x.txt"]["segments"][0]["text"] == "text of sub/_x/.x.txt\n" and rows["noext"]["skipped"] == "unknown file type"
    keyed = spark.createDataFrame([(x,) for x in ORDER], "path string").orderBy(walk_key(F.col("path"))).collect()
    assert [r["path"] for r in keyed] == ORDER
    (tmp_path / "empty").mkdir()
    for none in ("empty", "missing"):
        assert folder.scan(spark, str(tmp_path / none)).isEmpty() and folder.fingerprint(str(tmp_path / none)) == hashlib.sha1().hexdigest()
    want = hashlib.sha1("".join(f"{x}:{(tree / x).stat().st_size}\n" for x in ORDER).encode()).hexdigest()
    assert folder.fingerprint(str(tree)) == want
    (tree / "a.txt").write_text("longer than before, by far")
    assert folder.fingerprint(str(tree)) != want


def test_files_that_cannot_be_read_say_why(tree, monkeypatch):
    opened = folder._opened

    class Denying:
        def __init__(self, system):
            self.system = system

        def get_file_info(self, selector):
            if selector.base_dir.endswith("deep"):
                raise PermissionError("no")
            return self.system.get_file_info(selector)

        def open_input_stream(self, path, **how):
            if path.endswith("b.txt"):
                raise PermissionError(13, "Permission denied")
            if path.endswith("c.txt"):
                raise FileNotFoundError("it went")
            return self.system.open_input_stream(path, **how)

    monkeypatch.setattr(folder, "_opened", lambda root: (Denying(opened(root)[0]), opened(root)[1]))
    reader = folder.FolderReader(str(tree), 1000, 1000)
    rows = {r[1]: r for part in reader.partitions() for r in reader.read(part)}
    assert list(rows) == [x for x in ORDER if "deep" not in x]
    assert rows["b.txt"][4:6] == ([], "unreadable (permission denied)") and rows["sub/c.txt"][5] == "FileNotFoundError: it went" and rows["a.txt"][5] is None


def test_kinds_are_the_same_in_tasks_and_in_columns(spark):
    cases = [("a.PDF", b""), ("x/b.docm", b""), ("c", b"%PDF-1.7"), ("d.bin", b"\x89PNG\r\n\x1a\n"), ("e", b"\xff\xd8\xff\xe0"), (".hidden", b""), ("a.b/c", b"text"), ("f.tar.gz", b""), ("g.", b"")]
    frame = spark.createDataFrame([(k, n, bytearray(h)) for k, (n, h) in enumerate(cases)], "k int, path string, head binary")
    got = [r["kind"] for r in frame.select("k", kind_of(F.col("path"), F.col("head")).alias("kind")).orderBy("k").collect()]
    assert got == [files.kind_by(n, h) for n, h in cases]


def test_the_whole_fingerprint_has_two_levels(spark):
    rng = random.Random(1)
    rows = [(f"{rng.choice('ab')}/d{k % 7}/é{k}.txt", k * 11 if k % 5 else None) for k in range(400)] + [("hot/x.txt", 3), ("node_modules/y.js", 1)]
    rows += [(f"hot/{k}", k) for k in range(300)]
    frame = spark.createDataFrame(rows, "path string, size long")
    key = lambda path: [("0" if i == len(path.split("/")) - 1 else "1") + x for i, x in enumerate(path.split("/"))]
    for digits in (1, 3):
        shares: dict[str, list] = {}
        for path, size in rows:
            if "node_modules" not in path:
                shares.setdefault(hashlib.md5(path.encode()).hexdigest()[:digits], []).append((key(path), f"{path}:{-1 if size is None else size}\n"))
        whole = "".join(hashlib.sha1("".join(x for _, x in sorted(shares[s])).encode()).hexdigest() for s in sorted(shares))
        assert tuple(corpus.corpus_fingerprint(frame, digits).head()) == (hashlib.sha1(whole.encode()).hexdigest(), 701)
    assert tuple(corpus.corpus_fingerprint(frame.limit(0)).head()) == (hashlib.sha1().hexdigest(), 0)
