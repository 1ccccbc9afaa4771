"""Rendering, chunking, containers, loading, cache, settings, streaming."""

import json
import random
import subprocess
import sys
import types
from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill import schema as S
from glyphmill.errors import ConfigError, ExtractionError, MissingDependency, UnsafeInput
from glyphmill.observe import emit, observed
from glyphmill.operators import chunk as C
from glyphmill.operators import records as R
from glyphmill.operators import render as D
from glyphmill.options import Settings, load_settings, resolve
from glyphmill.sources import cache, containers, datasource, parsers, reader, sink, sniff
from glyphmill.streaming import stream

NORMALIZED = "source string, content_type string, text string, engine string, page int, sheet string, lang string, encoding_detected string, encoding_confidence double, warnings array<string>, " + f"blocks array<{S.BLOCK}>"


def doc(spark, blocks, text="flat"):
    return spark.createDataFrame([("a.docx", S.DOCX, text, "docx", 1, None, None, None, 0.9, ["w"], blocks)], NORMALIZED)


def h(level, text):
    return ("heading", level, text, None)


def p(text):
    return ("paragraph", None, text, None)


def t(*rows):
    return ("table", None, None, [list(r) for r in rows])


# --- rendering


def test_markdown(spark):
    blocks = [h(1, "One"), h(9, "Nine"), h(0, "Zero"), p("text"), p(""), t(), t(["a|b", "c\\d"], ["e\nf"]), p("end")]
    want = "# One\n\n###### Nine\n\n# Zero\n\ntext\n\n\n\n| a\\|b | c\\\\d |\n| --- | --- |\n| e<br>f |  |\n\nend"
    assert D.render(doc(spark, blocks)).first()["text"] == want
    assert D.render(doc(spark, [], "lone")).first()["text"] == "lone"
    assert D.render(doc(spark, [], "")).first()["text"] == ""
    assert D.render(doc(spark, blocks), "text").first()["text"] == "flat"
    with pytest.raises(ValueError):
        D.render(doc(spark, blocks), "html")


def test_json(spark):
    found = D.render(doc(spark, [h(8, "é"), p("x"), t(["a"], ["b", "c"])]), "json").first()["text"]
    payload = json.loads(found)
    assert list(payload) == ["schema_version", *S.METADATA_FIELDS, "blocks"] and payload["schema_version"] == "1.0" and payload["sheet"] is None
    assert payload["blocks"] == [{"type": "heading", "level": 6, "text": "é"}, {"type": "paragraph", "text": "x"}, {"type": "table", "rows": [["a"], ["b", "c"]]}]
    assert found == json.dumps(payload, ensure_ascii=False, indent=2) and '"blocks": []' in D.render(doc(spark, [], ""), "json").first()["text"]


# --- chunks


def naive_chunks(blocks, most, overlap):
    """The chunker's rules one by one."""
    units, section = [], ""
    for kind, _, text, rows in blocks:
        if kind == "heading":
            section = text or ""
        if kind == "table":
            units += [("\t".join(r), section, False) for r in rows if any(c.strip() for c in r)]
        elif text:
            units.append((text, section, kind == "heading"))
    out, start = [], 0
    while start < len(units):
        end, size = start, 0
        while end < len(units):
            cost = len(units[end][0].split())
            if end > start and (units[end][2] or units[end][1] != units[start][1] or size + cost > most):
                break
            size, end = size + cost, end + 1
        out.append(("\n".join(u[0] for u in units[start:end]), units[start][1]))
        if end == len(units):
            break
        if units[end][2] or units[end][1] != units[start][1]:
            start = end
            continue
        back, size = end, 0
        while back > start + 1 and size < overlap:
            back -= 1
            size += len(units[back][0].split())
        start = back
    return out


def test_chunks_equal_the_rules(spark):
    r = random.Random(5)
    for most, overlap in ((8, 3), (2, 1), (5, 0), (512, 64)):
        rows = []
        for k in range(60):
            blocks = []
            for _ in range(r.randint(0, 12)):
                text = " ".join("w" * r.randint(1, 3) for _ in range(r.choice((0, 1, 1, 2, 3, 5, 9))))
                blocks.append(r.choice((p(text), p(text), h(1, text), t([text, ""], ["", " "], ["x", text]))))
            rows.append((str(k), S.DOCX, "", "docx", None, None, None, None, 0.9, [], blocks))
        df = C.chunk(spark.createDataFrame(rows, NORMALIZED), most, overlap)
        found = {x["source"]: [(c["text"], c["metadata"]["section"]) for c in x["chunks"]] for x in df.collect()}
        assert found == {x[0]: naive_chunks(x[-1], most, overlap) for x in rows}


def test_the_overlap_may_repeat_a_unit_alone():
    assert C.ranges([1, 1, 5], ["", "", ""], [False] * 3, 2, 1) == [(0, 2), (1, 2), (2, 3)]


def test_records(spark):
    documents = D.render(C.chunk(doc(spark, [h(1, "A"), p("one"), h(1, "B"), p("two")]), 512, 64))
    rows = R.records(documents).orderBy("chunk_index").collect()
    assert [(r["text"], r["section"], r["chunk_index"], r["page"], r["warnings"]) for r in rows] == [("A\none", "A", 0, 1, ["w"]), ("B\ntwo", "B", 1, 1, ["w"])]
    whole = R.records(D.render(doc(spark, [p("x")]))).collect()
    assert [(r["text"], r["chunk_index"]) for r in whole] == [("x", None)]
    assert next(iter(R.as_dicts(documents)))[1]["section"] == "A"
    for wrap in (R.to_langchain, R.to_llamaindex):
        with pytest.raises(MissingDependency):
            wrap(documents)


@dataclass
class Wrapped:
    metadata: dict
    page_content: str = ""
    text: str = ""


def test_wrappers_with_stand_in_modules(spark, monkeypatch):
    documents = D.render(C.chunk(doc(spark, [h(1, "A"), p("one"), h(1, "B"), p("two")]), 512, 64))
    for wrap, name in ((R.to_langchain, "langchain_core.documents"), (R.to_llamaindex, "llama_index.core")):
        module = types.ModuleType(name)
        module.Document = Wrapped
        monkeypatch.setitem(sys.modules, name.split(".")[0], types.ModuleType(name.split(".")[0]))
        monkeypatch.setitem(sys.modules, name, module)
        made = sorted(wrap(documents), key=lambda d: d.metadata["chunk_index"])
        assert [d.page_content or d.text for d in made] == ["A\none", "B\ntwo"]
        assert made[1].metadata["section"] == "B" and made[0].metadata["warnings"] == ["w"] and made[0].metadata["engine"] == "docx"


# --- containers


DOCX = containers.docx(containers.paragraph(containers.run("Báo cáo"), style="Heading1"), containers.paragraph(containers.run("Nội dung chính.")), containers.paragraph(), containers.table([["Tên", "Tuổi"], ["An", "30"]]))
LEGACY = containers.docx(containers.paragraph(containers.run("µ¸¶·¹", ".VnTime")))
XLSX = containers.xlsx({"Nhân viên": [["Tên", "Điểm"], ["Bình", "<c><v>9</v></c>"], ["", ""]]})
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}first \b bold\b0\par\par third \u7879?\'e9\par}"


def test_parsers():
    found = parsers.docx("x", DOCX)
    assert [b["type"] for b in found.blocks] == ["heading", "paragraph", "table"] and found.blocks[0]["level"] == 1
    assert parsers.docx("x", LEGACY).fonts == [".VnTime"]
    book = parsers.xlsx("x", XLSX)
    assert book.sheet == "Nhân viên" and book.blocks[1]["rows"] == [["Tên", "Điểm"], ["Bình", "9"]]
    cells = parsers.xlsx("x", containers.xlsx({"A": [["<c><v>0.1</v></c>", '<c t="b"><v>1</v></c>', '<c s="1"><v>45000</v></c>', "<c><f>A1+1</f></c>", "<c><v>1.5</v></c>"]], "B": [["", ""]]}))
    assert cells.sheet is None and cells.blocks[1]["rows"] == [["0.1", "TRUE", "2023-03-15", "=A1+1", "1.5"]] and len(cells.warnings) == 1 and len(cells.blocks) == 2
    assert [b["text"] for b in parsers.rtf("x", RTF).blocks] == ["first bold", "third ệé"]
    for parse in (parsers.pdf, parsers.ocr, parsers.office):
        with pytest.raises(MissingDependency):
            parse("x", b"")
    with pytest.raises(UnsafeInput):
        parsers.check_zip_bomb(containers.pack({"a": "x" * 5000}), 4000)
    assert parsers.ocr_page(["a", "", "b"], [90, -1, 30]) == ("a b", 60.0)
    assert parsers.doctor()["docx"] and not parsers.doctor()["ocr"]


@pytest.mark.parametrize(("source", "want"), [
    (r"{\rtf1 a{\b b}c\par d}", "abc\nd"),
    (r"{\rtf1{\info{\author x}}{\*\unknown y{z}}{\header h}body{\footnote f} end}", "body end"),
    (r"{\rtf1\uc1 \u7879?x\uc0\u7879 y{\uc2\u233 ab}c\u233 d}", "ệxệyéc" + "éd"),
    (r"{\rtf1\uc1\u55357?\u56832?}", "\U0001f600"),
    (r"{\rtf1\ansicpg932 \'82\'a0\'82\'a2 a}", "あい a"),
    (r"{\rtf1\ansicpg99999 \'e9}", "é"),
    (r"{\rtf1 a\~b\_c\{d\}\\e\-f}", "a\xa0b-c{d}\\ef"),
    (r"{\rtf1 one\tab two\cell three\row\emdash\'zz}", "one\ttwo|three\n—zz"),
    ("{\\rtf1 a\nb\\\nc\\bin3 }{\\d}", "ab\ncd"),
    ("plain } text", "plain  text"),
    ("", ""),
])
def test_rtf_syntax(source, want):
    assert parsers.rtf_text(source) == want


def stand_in(monkeypatch, name, **values):
    module = types.ModuleType(name)
    for k, v in values.items():
        setattr(module, k, v)
    monkeypatch.setitem(sys.modules, name, module)
    return module


class Region:
    """A page's part, or a page, with what a PDF library tells of it."""

    width, height = 100.0, 100.0

    def __init__(self, lines, tables=(), fonts=(), top=0.0, bottom=100.0):
        self.lines, self.tables, self.top, self.bottom = lines, tables, top, bottom
        self.chars = [{"fontname": f} for f in fonts]

    def find_tables(self):
        return [types.SimpleNamespace(bbox=(0, a, 100, b), extract=lambda rows=rows: rows) for a, b, rows in self.tables]

    def crop(self, box):
        return Region(self.lines, top=box[1], bottom=box[3])

    def extract_text(self):
        return "\n".join(x for y, x in self.lines if self.top <= y < self.bottom) or None


class Closing:
    def __init__(self, **values):
        self.__dict__.update(values)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_pdf_with_a_stand_in_library(monkeypatch):
    first = Region([(5, "before"), (60, " between "), (95, "after")], [(70, 90, [["x"]]), (10, 40, [["a\n b", None], ["c", "d"]])], ["Arial", None, "VNI-Times"])
    pages = [first, Region([])]
    stand_in(monkeypatch, "pdfplumber", open=lambda f: Closing(pages=pages))
    found = parsers.pdf("x", b"%PDF-")
    assert found.blocks == [{"type": "paragraph", "text": "before"}, {"type": "table", "rows": [["a b", ""], ["c", "d"]]}, {"type": "paragraph", "text": "between"}, {"type": "table", "rows": [["x"]]}, {"type": "paragraph", "text": "after"}]
    assert found.fonts == ["Arial", "VNI-Times"] and found.page is None
    pages.pop()
    assert parsers.pdf("x", b"%PDF-").page == 1


def test_ocr_with_stand_in_libraries(monkeypatch):
    pages = [({"text": ["Việt", "", "Nam"], "conf": [90, -1, "70"]}), {"text": ["weak"], "conf": [20]}, {"text": [" "], "conf": [-1]}]
    images = [types.SimpleNamespace(convert=lambda mode, i=i: i) for i in range(3)]

    class NotFound(Exception):
        pass

    asked = {}

    def data(image, **options):
        asked.update(options)
        if isinstance(pages[image], Exception):
            raise pages[image]
        return pages[image]

    stand_in(monkeypatch, "pytesseract", image_to_data=data, Output=types.SimpleNamespace(DICT="dict"), TesseractNotFoundError=NotFound)
    stand_in(monkeypatch, "pdf2image", convert_from_bytes=lambda content, dpi: images, exceptions=types.SimpleNamespace(PDFInfoNotInstalledError=NotFound))
    found = parsers.ocr("x", b"%PDF-")
    assert [b["text"] for b in found.blocks] == ["Việt Nam", "weak"] and found.native_unicode and found.warnings[0].startswith("1 page(s)")
    assert asked["lang"] == "vie" and asked["timeout"] == 120
    for error, kind in ((NotFound(), MissingDependency), (RuntimeError("time"), ExtractionError)):
        pages[1] = error
        with pytest.raises(kind):
            parsers.ocr("x", b"%PDF-")


def test_old_office_files_with_stand_ins(monkeypatch):
    streams, outcome = [["WordDocument"]], [None]
    stand_in(monkeypatch, "olefile", OleFileIO=lambda f: Closing(listdir=lambda: streams))

    def soffice(command, **options):
        if isinstance(outcome[0], Exception):
            raise outcome[0]
        if outcome[0]:
            target = command[command.index("--convert-to") + 1]
            (Path(command[command.index("--outdir") + 1]) / f"in.{target}").write_bytes(outcome[0])
        assert any(c.startswith("-env:UserInstallation=file://") for c in command) and options["timeout"] == 120

    monkeypatch.setattr(parsers.subprocess, "run", soffice)
    outcome[0] = LEGACY
    found = parsers.office("x.doc", b"")
    assert found.engine == "libreoffice" and found.fonts == [".VnTime"]
    streams[0], outcome[0] = ["Workbook"], XLSX
    assert parsers.office("x.xls", b"").sheet == "Nhân viên"
    for bad in (None, subprocess.TimeoutExpired("x", 1), subprocess.CalledProcessError(1, "x", stderr=b"why")):
        outcome[0] = bad
        with pytest.raises(ExtractionError):
            parsers.office("x.xls", b"")
    outcome[0] = FileNotFoundError()
    with pytest.raises(MissingDependency):
        parsers.office("x.xls", b"")
    streams[0] = ["Other"]
    with pytest.raises(ExtractionError):
        parsers.office("x.ppt", b"")


def test_registry():
    registry = parsers.Registry(parsers.DEFAULT)
    registry.register(parsers.DEFAULT[0])
    assert len(registry.engines) == len(parsers.DEFAULT)
    names = lambda kind, ocr=None: [e.name for e in registry.chain(kind, ocr)]
    assert names(S.PDF) == ["pdf"] and names(S.PDF, True) == ["ocr"] and names(S.DOCX, True) == ["docx"] and names(S.PPTX) == []


def test_sniff(spark):
    zips = {"x": containers.pack({"ppt/presentation.xml": ""}), "y": containers.pack({"a": ""}), "z": b"PK\x03\x04 broken"}
    rows = [("d", DOCX), ("s", XLSX), ("r", b"\xef\xbb\xbf" + RTF), ("p", b"%PDF-1 /Font"), ("q", b"%PDF-1"), ("o", bytes.fromhex("D0CF11E0A1B11AE1")), ("t", b"text"), ("e", b""), ("n", None), *zips.items()]
    found = {r["path"]: (r["content_type"], r["is_scanned_pdf"], r["error_class"]) for r in sniff.sniff(spark.createDataFrame(rows, "path string, content binary")).collect()}
    bad = (None, None, "UnsupportedFormat")
    assert found == {"d": (S.DOCX, None, None), "s": (S.XLSX, None, None), "r": (S.RTF, None, None), "p": (S.PDF, False, None), "q": (S.PDF, None, None), "o": (S.OLE2, None, None), "t": bad, "e": bad, "n": bad, "x": (S.PPTX, None, None), "y": bad, "z": bad}


@pytest.fixture
def folder(tmp_path):
    for name, data in (("a.docx", DOCX), ("b[1].docx", LEGACY), ("c.xlsx", XLSX), ("d.rtf", RTF), ("e.txt", b"plain"), ("f.pdf", b"%PDF-1.4"), ("g.pptx", containers.pack({"ppt/presentation.xml": ""}))):
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_load_and_golden_output(spark, folder):
    s = Settings()
    row = reader.load(spark, folder / "a.docx", settings=s).first()
    assert row["text"] == "# Báo cáo\n\nNội dung chính.\n\n| Tên | Tuổi |\n| --- | --- |\n| An | 30 |"
    assert row["metadata"]["warnings"] == ["low encoding-detection confidence (0.50)"] and row["chunks"] == []
    row = reader.load(spark, folder / "b[1].docx", settings=s, chunk=(10, 2)).first()
    assert row["text"] == "àáảãạ" and row["metadata"]["encoding_detected"] == "tcvn3" and row["metadata"]["encoding_confidence"] == 0.95
    assert [c["text"] for c in row["chunks"]] == ["àáảãạ"]
    row = reader.load(spark, folder / "c.xlsx", settings=s).first()
    assert row["text"] == "# Nhân viên\n\n| Tên | Điểm |\n| --- | --- |\n| Bình | 9 |" and row["metadata"]["sheet"] == "Nhân viên"
    assert json.loads(reader.load(spark, folder / "d.rtf", output="json", settings=s).first()["text"])["engine"] == "rtf"


def test_batch_isolates_failures(spark, folder):
    names = ["d.rtf", "e.txt", "f.pdf", "g.pptx", "gone.docx", "a.docx", "a.docx"]
    out = reader.load_batch(spark, [folder / n for n in names], settings=Settings()).orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(7))
    assert [r["error_class"] for r in out] == [None, "UnsupportedFormat", "MissingDependency", "EngineUnavailable", "OSError", None, None]
    assert all(r["metadata"]["warnings"][0].startswith("failed to load: ") and r["text"] == "" for r in out[1:5])
    small = reader.load_batch(spark, [folder / "a.docx"], max_bytes=10, settings=Settings()).first()
    assert small["error_class"] == "UnsafeInput"
    with pytest.raises(Exception, match="UnsupportedFormat"):
        reader.load(spark, folder / "e.txt", settings=Settings()).collect()
    assert reader.load(spark, folder / "e.txt", settings=Settings(), strict=False).first()["error_class"] == "UnsupportedFormat"
    uris = reader.load_batch(spark, [f"file://{folder}/a.docx", f"file://{folder}/gone.docx"], settings=Settings()).orderBy("seq").collect()
    assert [r["error_class"] for r in uris] == [None, "OSError"] and uris[0]["text"].startswith("# Báo cáo")
    documents, seen = observed(reader.load_batch(spark, [folder / n for n in names], settings=Settings()))
    documents.collect()
    assert (seen.get["documents"], seen.get["failed"]) == (7, 4)


def test_metrics(spark, folder):
    names = ["d.rtf", "e.txt", "a.docx"]
    documents = reader.load_batch(spark, [folder / n for n in names], settings=Settings(), timed=True)
    seen = []
    assert emit(documents, seen.append) == 3
    by = {x["source"].rsplit("/", 1)[1]: x for x in seen}
    assert by["d.rtf"]["ok"] and by["d.rtf"]["engine"] == "rtf" and set(by["d.rtf"]["layer_seconds"]) == {"extract", "normalize"} and by["d.rtf"]["error"] is None
    assert all(v > 0 for v in by["a.docx"]["layer_seconds"].values())
    assert not by["e.txt"]["ok"] and by["e.txt"]["error"].startswith("UnsupportedFormat")

    def broken(record):
        raise ValueError("hook")

    assert emit(documents, broken) == 3
    seen.clear()
    with pytest.raises(Exception, match="UnsupportedFormat"):
        emit(reader.load(spark, folder / "e.txt", settings=Settings(), timed=True), seen.append)
    assert [x["ok"] for x in seen] == [False] and "UnsupportedFormat" in seen[0]["error"]


def test_bytes_at_hand_are_refused_by_a_column(spark, folder):
    files = reader.read_files(spark, [str(folder / "a.docx"), str(folder / "d.rtf"), str(folder / "e.txt")])
    for limit in (200, 1 << 20):
        a, b = (reader.extract(files, limit, at_hand=x).select("source", "text", "error_class", "error").orderBy("source").collect() for x in (True, False))
        assert a == b and len(a) == 3


def test_expand_lists_uris_by_hadoop(spark, folder):
    (folder / "sub").mkdir()
    (folder / "sub" / "x.docx").write_bytes(DOCX)
    root = f"file://{folder}"
    names = lambda *p: [x.rsplit("/", 1)[1] for x in reader.expand(p, spark)]
    assert names(root) == ["a.docx", "b[1].docx", "x.docx"] and names(f"{root}/*.xlsx", f"{root}/c.xlsx") == ["c.xlsx"] or names(f"{root}/*.xlsx") == ["c.xlsx"]
    assert names(f"{root}/gone.docx") == ["gone.docx"]
    with pytest.raises(ValueError):
        reader.expand([root])


def test_expand(folder):
    assert [x.rsplit("/", 1)[1] for x in reader.expand([folder])] == ["a.docx", "b[1].docx"]
    assert [x.rsplit("/", 1)[1] for x in reader.expand([folder / "b[1].docx", folder / "*.docx", folder / "none"])] == ["b[1].docx", "a.docx", "none"]


def test_cache_parses_once(spark, folder, tmp_path):
    files = reader.read_files(spark, [str(folder / "a.docx"), str(folder / "d.rtf")])
    results = cache.ResultTable(spark, str(tmp_path / "results"))
    assert results.load(files, Settings()).count() == 2
    nothing = parsers.Registry()  # a parse would fail now
    again = results.load(files, Settings(), registry=nothing)
    assert again.count() == 2 and again.where("error_class is not null").count() == 0
    assert results.load(files, Settings(output="text"), registry=nothing).where("error_class is not null").count() == 2
    assert results.load(files, Settings(output="text")).where("error_class is null").count() == 2  # failures are tried again
    empty = cache.ResultTable(spark, str(tmp_path / "other"))
    assert empty.load(files, Settings(), registry=nothing).where("error_class is not null").count() == 2


def test_data_source(spark, folder):
    datasource.register(spark)
    rows = spark.read.format("glyphmill_documents").load(str(folder)).collect()
    assert sorted((r["content_type"], r["error_class"]) for r in rows) == [(S.DOCX, None)] * 2
    (folder / "h.docx").write_bytes(containers.pack({"word/document.xml": "<broken"}))
    (folder / "i.docx").write_bytes(b"PK\x03\x04 broken")
    for where in (str(folder), f"file://{folder}"):
        rows = spark.read.format("glyphmill_documents").load(where).collect()
        assert sorted(r["error_class"] or "" for r in rows) == ["", "", "ExtractionError", "UnsupportedFormat"]
    rows = spark.read.format("glyphmill_documents").option("maxbytes", "10").load(str(folder)).collect()
    assert {r["error_class"] for r in rows} == {"UnsafeInput"}
    rows = spark.read.format("glyphmill_documents").load(str(folder / "f.pdf")).collect()
    assert [(r["content_type"], r["error_class"]) for r in rows] == [(S.PDF, "MissingDependency")]
    assert datasource.packed([("a", 5), ("b", 5), ("c", 20), ("d", 1), ("e", 1), ("f", 1)], 10, 2) == [["a", "b"], ["c"], ["d", "e"], ["f"]]


def test_names_and_command_line(spark, folder, tmp_path, capsys):
    used = set()
    assert [sink.free_name(p, "markdown", used) for p in ("x/a.docx", "y/a.rtf", "a-1.docx", "b", "a.b.docx")] == ["a.md", "a-1.md", "a-1-1.md", "b.md", "a.b.md"]
    assert sink.main([str(folder / "a.docx"), str(folder / "e.txt"), "--out", str(tmp_path / "out")]) == 1
    assert (tmp_path / "out" / "a.md").read_text("utf-8").startswith("# Báo cáo") and "e.txt" in capsys.readouterr().err
    assert sink.main(["doctor"]) == 0 and sink.main([str(folder / "a.docx"), "--normalize", "NFX"]) == 2


# --- settings, streaming


def test_settings(tmp_path):
    assert load_settings(tmp_path, {}) == Settings()
    (tmp_path / "glyphmill.toml").write_text('output = "text"\nmax_bytes = 5\n')
    found = load_settings(tmp_path, {"GLYPHMILL_MAX_BYTES": "7", "GLYPHMILL_OCR": "yes", "GLYPHMILL_OTHER": "x"})
    assert (found.output, found.max_bytes, found.ocr) == ("text", 7, True) and resolve(found, output="json").output == "json"
    for bad in ('colour = "red"', "max_bytes = true", "max_bytes = 0", 'output = "pdf"', 'output = "text"\n[tool.glyphmill]\noutput = "json"', "= x"):
        (tmp_path / "glyphmill.toml").write_text(bad)
        with pytest.raises(ConfigError):
            load_settings(tmp_path, {})
    (tmp_path / "glyphmill.toml").write_text("")
    for env in ({"GLYPHMILL_OCR": "maybe"}, {"GLYPHMILL_MAX_BYTES": "x"}):
        with pytest.raises(ConfigError):
            load_settings(tmp_path, env)


def test_stream_equals_batch_and_drops_repeats(spark, folder, tmp_path):
    (folder / "again.rtf").write_bytes(RTF)
    files = stream.once_by_content(stream.read_stream(spark, str(folder), "*.rtf"))
    query = stream.documents(files).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r["text"] for r in rows] == [reader.load(spark, folder / "d.rtf", settings=Settings()).first()["text"]]
