"""Arrow batches taken in slices, and the text rules on Python strings."""

import random
import re
import sys

import pyarrow as pa

from glyphmill import schema as S
from glyphmill.functions import charmaps, plain
from glyphmill.functions import text as T
from glyphmill.functions.slices import slices, values
from glyphmill.operators import normalize as N
from glyphmill.plans import catalogue
from glyphmill.sources import containers, reader
from glyphmill.sources.parsers import DEFAULT, Registry


def test_slices_are_bounded_and_whole():
    texts = pa.array(["x" * n for n in (10, 5_000, 0, 30, 70_000, 1, 1, 900)] * 40 + [None])
    numbers = pa.array(range(len(texts)))
    parts = list(slices((texts, numbers), 10_000))
    assert pa.concat_arrays([p[0] for p in parts]) == texts and pa.concat_arrays([p[1] for p in parts]) == numbers
    assert all(sum(c.nbytes for c in p) <= 10_000 or len(p[0]) == 1 for p in parts)
    assert not list(slices((texts[:0],)))


def test_normal_form_gives_its_batch_in_slices():
    """Every batch that the function gives is small, however large the one that it got."""
    function = T._form_udf("NFD").func
    given = list(function(iter([pa.array(["ế" * 1000] * 5000)])))
    assert sum(map(len, given)) == 5000 and len(given) > 5
    assert max(x.nbytes for x in given) < 4 << 20


def test_parsing_gives_its_batch_in_slices():
    content = containers.docx(*[containers.paragraph(containers.run(f"line {i} of a document")) for i in range(200)])
    names = ["source", "content_type", "is_scanned_pdf", "content", "error_class", "error"]
    batch = pa.RecordBatch.from_pydict({"source": [f"/{i}" for i in range(600)], "content_type": [S.DOCX] * 600, "is_scanned_pdf": pa.array([None] * 600, pa.bool_()), "content": [content] * 600, "error_class": pa.array([None] * 600, pa.string()), "error": pa.array([None] * 600, pa.string())})
    assert batch.schema.names == names
    given = list(reader._parse(Registry(DEFAULT), None)(iter([batch])))
    assert [x for b in given for x in b.column("source").to_pylist()] == batch.column("source").to_pylist()
    assert max(b.num_rows for b in given) < 600 and all(len(x) == 200 for b in given for x in b.column("blocks").to_pylist())


def by_patterns(text: str) -> str:
    text = plain._unseen().sub("", re.sub(r"\r\n?|[\x0b\x0c]", "\n", text))
    text = re.sub(r"^ +| +$", "", re.sub(r"[^\S\t\n]+", " ", text), flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def test_cleaning_equals_its_patterns():
    random.seed(5)
    signs = ["a", "ế", "é", " ", " ", "\n", "\n", "\t", "\r", "\r\n", "\x0b", "\x0c", "\x00", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff", "\ue000", "\ud800", "\U0001f600", "\xad"]
    for i in range(20_000):
        t = "".join(random.choices(signs[: 8 if i % 2 else None], k=random.randrange(14)))
        assert plain.clean(t) == by_patterns(t), repr(t)


def test_converting_equals_the_greedy_scan():
    random.seed(6)
    for name, pairs in charmaps.CHARMAPS.items():
        signs = [a for a, _ in pairs] + ["a", "z", " ", "đ", "\ud800", "\U0001f600", "\uffff"]
        for _ in range(300):
            t = "".join(random.choices(signs, k=random.randrange(30)))
            assert plain.convert(t, name) == charmaps.convert(t, name), (name, t)


def test_normalising_gives_its_batch_in_slices():
    """Blocks of a batch are made and given back part by part."""
    text = pa.array(["µ word  of\ttext " * 200] * 2000)
    blocks = pa.array([[{"type": "paragraph", "level": None, "text": "µ", "rows": None, "fonts": None, "runs": None}]] * 2000)
    given = list(N._pass(None, "NFC").func(iter([(blocks, text, pa.array([None] * 2000, pa.list_(pa.string())), pa.array([None] * 2000, pa.bool_()))])))
    assert sum(map(len, given)) == 2000 and max(map(len, given)) < 1000


def test_values_equal_to_pylist():
    run = pa.struct([("text", pa.string()), ("font", pa.string())])
    block = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("rows", pa.list_(pa.list_(pa.string()))), ("runs", pa.list_(run))]))
    one = {"type": "table", "level": 2, "rows": [["a", None], [], None], "runs": [{"text": "x", "font": None}, None]}
    column = pa.array([[one, None, one | {"rows": None, "runs": []}], None, [], [one | {"runs": None}], [one] * 3], block)
    for part in (column, column[1:], column[2:4], column[:0]):
        assert values(part) == part.to_pylist()


def test_rtf_gives_its_batch_in_slices():
    """No batch given is large, and paragraphs end at every kind of line end, wherever the cuts fall."""
    ends = ["\r\n", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    lines = [f"line {i} \xa0\x1f of a text" for i in range(40)]
    spelled = "".join(x + "".join(f"\\u{ord(c)}?" for c in ends[i % len(ends)]) for i, x in enumerate(lines))
    n, content = 3000, ("{\\rtf1\\ansi " + spelled + "\\par }").encode("latin-1")
    batch = pa.RecordBatch.from_pydict({"source": [f"/{i}" for i in range(n)], "content_type": [S.RTF] * n, "is_scanned_pdf": pa.array([None] * n, pa.bool_()), "content": [content] * n, "error_class": pa.array([None] * n, pa.string()), "error": pa.array([None] * n, pa.string())})
    given = list(reader._parse(Registry(DEFAULT), None)(iter([batch])))
    assert [x for b in given for x in b.column("source").to_pylist()] == batch.column("source").to_pylist()
    assert all([b["text"] for b in x] == lines for g in given for x in g.column("blocks").to_pylist())
    assert max(g.nbytes for g in given) < 1 << 20 < sum(g.nbytes for g in given) / 5


def test_normalising_mixed_shapes_by_slices():
    """Runs and blocks of two encodings: slices give what each document alone gives, without a call for each sign."""

    def block(text: str, fonts: list[str] | None = None, runs: list[dict] | None = None) -> dict:
        return {"type": "paragraph", "level": None, "text": text, "rows": None, "fonts": fonts, "runs": runs}

    old, new = "µ word  of\ta text \xa0 " * 300, "a  plain \u2003 word " * 300
    runs = [{"text": old, "font": ".VnTime"}, {"text": new, "font": "Arial"}]
    shapes = [[block(old, [".VnTime"]), block(new, ["Arial"])], [block(old + new, None, runs)], [block(old, ["VNI-Times"]), block(old, [".VnTime"])], [block(old, [".VnTime"])]]
    fonts = [[".VnTime", "Arial"]] * 2 + [["VNI-Times", ".VnTime"], [".VnTime"]]
    n, calls = 400, 0
    run = pa.struct([("text", pa.string()), ("font", pa.string())])
    kind = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("fonts", pa.list_(pa.string())), ("runs", pa.list_(run))]))
    columns = pa.array([shapes[i % 4] for i in range(n)], kind), pa.array([old + new] * n), pa.array([fonts[i % 4] for i in range(n)], pa.list_(pa.string())), pa.array([None] * n, pa.bool_())

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    alone = [N.normalized(shapes[i], old + new, fonts[i], None, None, "NFC") for i in range(4)]
    sys.setprofile(None)
    assert calls < 4 * 200
    given = list(N._pass(None, "NFC").func(iter([columns])))
    found = [x for g in given for x in g.to_pylist()]
    assert all({k: v for k, v in x.items() if k != "seconds"} == alone[i % 4] for i, x in enumerate(found)) and len(found) == n
    assert max(map(len, given)) < n / 4


def test_a_text_is_translated_and_changed_once(spark, monkeypatch):
    """One translation of the whole text for all shapes; a flat text that is its only block's is converted with it."""
    docs = spark.createDataFrame([(i, "a legal text  of\nwords " * 20) for i in range(4)], "doc_id long, text string")
    raw = catalogue._extraction(docs)
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1

    asked = []
    monkeypatch.setattr(N, "convert", lambda t, e: asked.append((t, e)) or plain.convert(t, e))
    for row in raw.orderBy("doc_id").collect():
        x = row.asDict(recursive=True)
        found = N.normalized(x["blocks"], x["text"], x["fonts"], None, None, "NFC")
        assert len(asked) == len(set(asked))
        lines = [plain.clean("".join(plain.convert(r["text"], "tcvn3" if r["font"] == ".VnTime" else None) for r in b["runs"]) if b["runs"] else plain.convert(b["text"], plain.font_encoding(b["fonts"][0]))) for b in x["blocks"]]
        assert found["text"] == plain.normal(plain.clean("\n".join(lines)), "NFC") and [b["text"] for b in found["blocks"]] == [plain.normal(t, "NFC") for t in lines]
        asked.clear()
