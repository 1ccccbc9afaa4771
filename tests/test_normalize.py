"""Conversion, detection and normalisation: the rules of each operator, case by case."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphmill import schema as S
from glyphmill.functions import charmaps, detect
from glyphmill.functions import plain as P
from glyphmill.functions import text as T
from glyphmill.operators import normalize as N

LOW = "low encoding-detection confidence (0.50)"


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def column(spark, values, expression):
    return [r["x"] for r in texts(spark, values).select("i", expression.alias("x")).orderBy("i").collect()]


def para(text, fonts=None, runs=None, kind="paragraph", level=None, rows=None):
    return (kind, level, text, rows, fonts, runs)


def raw(spark, blocks, fonts=None, text=None, native=None, warnings=()):
    flat = text if text is not None else "\n".join(b[2] or "" for b in blocks)
    return spark.createDataFrame([("a.docx", S.DOCX, flat, "docx", None, None, fonts, native, list(warnings), blocks)], S.RAW_EXTRACTION)


def run(spark, blocks, fonts=None, text=None, native=None, encoding=None, form="NFC"):
    return N.normalize(raw(spark, blocks, fonts, text, native), encoding, form).first()


# --- charmaps


@pytest.mark.parametrize("name", list(charmaps.CHARMAPS))
def test_every_entry_and_random_strings_equal_the_scan(spark, name):
    r = random.Random(name)
    sources = [a for a, _ in charmaps.CHARMAPS[name]]
    letters = sorted(set("".join(sources)) | set("abc uôñ đ"))
    values = sources + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", None]
    want = [None if v is None else charmaps.convert(v, name) for v in values]
    assert column(spark, values, charmaps.apply(F.col("t"), name)) == want
    assert want[: len(sources)] == [b for _, b in charmaps.CHARMAPS[name]]


def test_sizes_and_validation():
    assert {n: len(c) for n, c in charmaps.CHARMAPS.items()} == {"tcvn3": 12, "vni": 6, "viscii": 103, "vps": 112}
    assert "vps" not in charmaps.AUTO_DETECT
    assert charmaps.build([("a", "x"), ("ab", "y")])[0] == ("ab", "y")
    for bad in ([("", "x")], [("a", "")], [("a", "x"), ("a", "y")]):
        with pytest.raises(ValueError):
            charmaps.build(bad)


# --- cleanup, forms, tokens


def clean(text):
    """The cleanup rules in plain Python."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x0c", "\n").replace("\x0b", "\n")
    text = "".join(c for c in text if c in "\t\n" or unicodedata.category(c) not in ("Cc", "Cf"))
    lines = []
    for line in text.split("\n"):
        out, gap = [], False
        for c in line:
            if c.isspace() and c != "\t":
                gap = True
                continue
            out += [" "] * gap + [c]
            gap = False
        lines.append("".join(out + [" "] * gap).strip(" "))
    text = "\n".join(lines)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return unicodedata.normalize("NFC", text.strip("\n"))


def test_cleanup_equals_the_rules_on_random_strings(spark):
    r = random.Random(3)
    signs = ["\r\n", "\r", "\n", "\x0b", "\x0c", "\t", " ", "  ", "\xa0", " ", "　", "​", "﻿", "\x00", "\x85", "\x1c", " ", "࢐", "a", "é", "é", "ế", "中", "\U0001f600"]
    values = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["", None, "x" * 100_000]
    assert column(spark, values, T.clean_text(F.col("t"))) == [None if v is None else clean(v) for v in values]


def test_forms(spark):
    values = ["Tiếng Việt", unicodedata.normalize("NFD", "Tiếng Việt"), "ﬁ①", "", None]
    for form in T.FORMS:
        assert column(spark, values, T.normal_form(F.col("t"), form)) == [None if v is None else unicodedata.normalize(form, v) for v in values]
    with pytest.raises(ValueError):
        T.normal_form(F.col("t"), "NFX")


def test_normal_form_check(spark):
    values = ["Tiếng Việt", unicodedata.normalize("NFD", "Tiếng Việt"), "ﬁ", "", None]
    for form in T.FORMS:
        assert column(spark, values, T.is_normal_form(F.col("t"), form)) == [None if v is None else unicodedata.is_normalized(form, v) for v in values]


def test_rules_on_strings_equal_the_expressions(spark):
    r = random.Random(6)
    signs = ["\r\n", "\r", "\n", "\x0b", "\t", " ", "\xa0", "​", "\x00", "\x85", "\x1c", "\u2028", "࢐", "a", "ù", "½", "µ", "¸", "®", "é", "ế", "中", "\U0001f600", "\x02", "\xad", "²"]
    values = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(800)] + [""]
    assert column(spark, values, T.clean_chars(F.col("t"))) == [P.clean(v) for v in values]
    for name in charmaps.CHARMAPS:
        assert column(spark, values, charmaps.apply(F.col("t"), name)) == [P.convert(v, name) for v in values]
    legacy = {b: a for a, b in charmaps.CHARMAPS["viscii"]}
    values += ["".join(legacy.get(c, c) for c in "việt nam độc lập tự do hạnh phúc"), "Hi"]
    found = column(spark, values, detect.content_verdict(detect.gains(F.col("t"))))
    assert [tuple(v)[:3] for v in found] == [tuple(P.detect_content(v)) for v in values]
    names = [".VnTime", "VNI-Times", "Arial", "", None, "ABCDEF+.vnarial", "vni", "x.Vn"]
    fonts = [[r.choice(names) for _ in range(r.randint(0, 4))] for _ in range(200)]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fonts)], "i int, f array<string>").select("i", detect.detect_fonts(F.col("f")).alias("v")).orderBy("i").collect()
    assert [tuple(x["v"])[:3] for x in rows] == [tuple(P.detect_fonts(f)) for f in fonts]


def test_one_crossing_and_no_regex_in_the_plan(spark):
    plan = N.normalize(raw(spark, [para("x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 0 and plan.count("translate(") == 0 and plan.count("ArrowEvalPython") == 1


def test_tokens_and_score(spark):
    r = random.Random(4)
    values = ["".join(r.choice("ab \t\n\xa0 \x1c\x1f　") for _ in range(30)) for _ in range(300)] + [""]
    assert column(spark, values, T.estimate_tokens(F.col("t"))) == [len(v.split()) for v in values]
    assert sum(T.COUNTS.values()) == 797 and len(T.COUNTS) == 70
    score = column(spark, ["", "việt nam", "VIỆT NAM", "qqq ###", None], T.vietnamese_score(F.col("t")))
    assert score[0] == T.FLOOR and score[1] == score[2] > score[3] and score[4] is None


# --- verdicts


@pytest.mark.parametrize(("fonts", "want"), [
    ([".VnTime"], ("tcvn3", 0.95, "font-signal", ".VnTime")),
    (["ABCDEF+.vnarial", "Arial"], ("tcvn3", 0.95, "font-signal", "ABCDEF+.vnarial")),
    (["VNI-Times", ".VnTime"], ("vni", 0.6, "font-signal-mixed", "VNI-Times")),
    (["Arial"], (None, 0.9, "no-legacy-font", None)),
    (["", None], (None, 0.5, "assumed-unicode", None)),
    ([], (None, 0.5, "assumed-unicode", None)),
])
def test_font_verdict(spark, fonts, want):
    df = spark.createDataFrame([(fonts,)], "f array<string>")
    assert tuple(df.select(detect.detect_fonts(F.col("f")).alias("v")).first()["v"]) == want


def test_content_verdict(spark):
    legacy = {b: a for a, b in charmaps.CHARMAPS["viscii"]}
    values = ["".join(legacy.get(c, c) for c in "việt nam độc lập tự do hạnh phúc"), "Vi®t Nam", "", "a", "Hi", "ok then", "The quick brown fox jumps over the lazy dog"]
    found = column(spark, values, detect.content_verdict(detect.gains(F.col("t"))))
    assert found[0]["encoding"] == "viscii" and found[0]["method"] == "content-frequency" and found[0]["confidence"] <= 0.85
    assert all(v["encoding"] is None and v["confidence"] == 0.5 for v in found[1:])


# --- the normaliser


def test_blocks_of_two_kinds(spark):
    out = run(spark, [para("µ¸", [".VnTime"]), para("plain® 2026", ["Arial"])], [".VnTime", "Arial"])
    assert [b["text"] for b in out["blocks"]] == ["àá", "plain® 2026"] and out["text"] == "àá\nplain® 2026"
    assert (out["encoding_detected"], out["encoding_confidence"], out["warnings"], out["lang"]) == ("tcvn3", 0.95, [], None)


def test_table_cells(spark):
    out = run(spark, [para(None, [".VnTime"], kind="table", rows=[["µ¸", "¶·"]]), para("plain®", ["Arial"])], [".VnTime", "Arial"])
    assert out["text"] == "àá\tảã\nplain®" and out["blocks"][0]["rows"] == [["àá", "ảã"]]


def test_two_legacy_encodings(spark):
    out = run(spark, [para("µ¸", [".VnTime"]), para("aù", ["VNI-Times"])], [".VnTime", "VNI-Times"])
    assert [b["text"] for b in out["blocks"]] == ["àá", "á"]
    assert out["warnings"] == ["multiple legacy encodings across blocks; converted per block"]


def test_a_uniform_document_keeps_its_own_flat_text(spark):
    out = run(spark, [para("µ", [".VnTime"]), para("¸", [".VnTime"])], [".VnTime"], text="FLAT")
    assert out["text"] == "FLAT" and [b["text"] for b in out["blocks"]] == ["à", "á"]


def test_a_block_without_fonts_follows_the_document_but_one_with_none_does_not(spark):
    out = run(spark, [para("µ", [".VnTime"]), para("¸")], [".VnTime"])
    assert [b["text"] for b in out["blocks"]] == ["à", "á"]
    out = run(spark, [para("µ", [".VnTime"]), para("¸", [])], [".VnTime"])
    assert [b["text"] for b in out["blocks"]] == ["à", "¸"]


def test_an_override_beats_fonts_and_an_unknown_one_changes_nothing(spark):
    out = run(spark, [para("aù", ["Arial"]), para("aï", ["Times"])], ["Arial", "Times"], encoding="vni")
    assert [b["text"] for b in out["blocks"]] == ["á", "ạ"] and (out["encoding_detected"], out["encoding_confidence"]) == ("vni", 1.0)
    out = run(spark, [para("plain")], encoding="vietware")
    assert out["text"] == "plain" and (out["encoding_detected"], out["encoding_confidence"]) == ("vietware", 1.0) and len(out["warnings"]) == 1


def test_an_inherited_majority_has_the_documents_confidence(spark):
    out = run(spark, [para("aù", ["VNI-Times"]), para("µ"), para("¸")], [".VnTime", "VNI-Times"])
    assert (out["encoding_detected"], out["encoding_confidence"]) == ("tcvn3", 0.6)
    assert "low encoding-detection confidence (0.60)" in out["warnings"]


def test_a_blank_last_block_leaves_no_line_end(spark):
    assert run(spark, [para("µ", [".VnTime"]), para("x", ["Arial"]), para("   ", ["Arial"])], [".VnTime", "Arial"])["text"] == "à\nx"


def test_runs(spark):
    mixed = [("µ¸", ".VnTime"), (" plain® 2026", "Arial")]
    assert run(spark, [para("µ¸ plain® 2026", None, mixed)], [".VnTime", "Arial"])["blocks"][0]["text"] == "àá plain® 2026"
    out = run(spark, [para("µ ONE", None, [("µ", ".VnTime"), (" ONE", "Arial")], kind="heading", level=2)], [".VnTime", "Arial"])
    assert tuple(out["blocks"][0])[:3] == ("heading", 2, "à ONE")
    out = run(spark, [para("aù®", None, [("a", "VNI-Times"), ("ù", "VNI-Helve"), ("®", "Arial")])], ["VNI-Times", "VNI-Helve", "Arial"])
    assert out["text"] == "á®"  # the pair of letters spans two runs of one encoding
    out = run(spark, [para("µ", [".VnTime"], [("MISMATCH", "Arial")]), para("®", ["Arial"])], [".VnTime", "Arial"])
    assert [b["text"] for b in out["blocks"]] == ["à", "®"]


def test_the_majority_is_by_block_not_by_run(spark):
    tcvn = [("µ", ".VnTime"), ("x", "Arial"), ("¸", ".VnArial"), ("y", "Arial"), ("¶", ".VnTime")]
    blocks = [para("aù", ["VNI-Times"]), para("aï", ["VNI-Times"]), para("µx¸y¶", None, tcvn)]
    assert run(spark, blocks, ["VNI-Times", ".VnTime"])["encoding_detected"] == "vni"


def test_content_detection_only_on_request(spark):
    legacy = {b: a for a, b in charmaps.CHARMAPS["viscii"]}
    plain = "Việt Nam độc lập tự do hạnh phúc"
    old = "".join(legacy.get(c, c) for c in plain)
    out = run(spark, [para(old)], encoding="auto")
    assert out["encoding_detected"] == "viscii" and out["text"] == plain
    out = run(spark, [para("plain text")])
    assert (out["encoding_detected"], out["encoding_confidence"], out["warnings"]) == (None, 0.5, [LOW])


def test_native_unicode_and_forms(spark):
    out = run(spark, [para("Tiếng Việt")], [".VnTime"], native=True)
    assert (out["encoding_detected"], out["encoding_confidence"], out["warnings"], out["text"]) == (None, 1.0, [], "Tiếng Việt")
    letters = "".join(b for _, b in charmaps.CHARMAPS["viscii"])
    assert run(spark, [para(unicodedata.normalize("NFD", letters))])["text"] == letters
    assert run(spark, [para("ﬁ x")], form="NFKC")["text"] == "fi x"


def test_missing_fields_and_empty_tables(spark):
    out = run(spark, [para(None, kind="heading"), para("x", kind="strange"), para(None, kind="table")])
    assert [tuple(b) for b in out["blocks"]] == [("heading", 1, "", None), ("paragraph", None, "x", None), ("table", None, None, [])]
    assert N.normalize(spark.createDataFrame([], S.RAW_EXTRACTION)).count() == 0
    row = N.normalize(spark.createDataFrame([(None,) * 10], S.RAW_EXTRACTION)).first()
    assert row["text"] == "" and row["blocks"] == []
