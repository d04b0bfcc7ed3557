import unicodedata

import pytest
from pyspark.sql import functions as F

from seine.llm import glyphs
from seine.llm.visual import canonical_text, look_alike_classes, look_alike_pairs

CASES = [
    ("abc", "abc"), ("ａｂｃ１２３", "abc123"), ("café", "café"), ("café", "café"), ("n​o­t⁠e﻿", "note"), ("a b c　d e", "a b c d e"),
    ("Аррӏе", "Apple"), ("ΜΑΙΝ", "MAIN"), ("re‐read re‑read re－read", "re-read re-read re-read"), ("x²", "x²"), ("ﬁ", "ﬁ"), ("naive", "naive"), ("ệ", "ệ"), ("ệ", "ệ"), ("ё", "ë"), ("a\tb\r\nc", "a\tb\r\nc"),
    ("́x", "́x"), ("a​́", "á"), ("한", "한"), ("가각", "가각"), ("q̣́", "q̣́"), ("😀👍🏽", "😀👍🏽"), ("", ""), ("​", ""), ("x\x00y", "xy"), ("Ａ̊", "Å"), ("Å", "Å"), ("K", "K"), ("ｶﾞ", "ガ"),
]


@pytest.mark.parametrize("text, form", CASES)
def test_fold(text, form, spark):
    alike = glyphs.look_alikes(spark)
    assert glyphs.fold(text, alike) == unicodedata.normalize("NFC", form)
    assert glyphs.fold(glyphs.fold(text, alike), alike) == glyphs.fold(text, alike)


def test_look_alikes(spark):
    alike = glyphs.look_alikes(spark)
    # letters of Cyrillic, Greek, Armenian, Coptic, Cherokee and Lisu, mathematical letters, hyphens and the minus
    for char, to in {"а": "a", "Ѕ": "S", "ο": "o", "ρ": "p", "α": "a", "ι": "i", "օ": "o", "ⲟ": "o", "Ꭺ": "A", "ꓐ": "B", "\U0001d400": "A", "І": "I", "Ι": "I", "Ⅰ": "I", "ӏ": "l", "\u2010": "-", "\u2012": "-", "\u2212": "-"}.items():
        assert alike[char] == to, char
    # other letters, missing dots, raised letters and digits stay
    for char in "тпıȷßᵃ²０":
        assert char not in alike
    assert len(alike) > 500 and all(k not in alike for k in alike.values())


def new_mark(code):
    """Marks of later Unicode versions than the oldest JVM that Spark runs on are not joined to their base."""
    return unicodedata.category(chr(code))[0] == "M" and code in {0xC3C, 0x180F, 0x1715, 0x1ABF, 0x1AC0, *range(0x1AC1, 0x1AD0), 0x1DFA, 0xCF3, 0xECE}


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, canonical string, form string")


def test_plan_equals_the_direct_form(spark):
    alike = glyphs.look_alikes(spark)
    texts = [t for t, _ in CASES] + [None, "é" * 50_000, "a" * 100_000 + "ｂ", "ź̂̃" * 3_000, " ".join(f"a{chr(c)}b" for c in [*range(0x20, 0x870), *range(0x900, 0x3100), *range(0xF900, 0x10000)] if not new_mark(c))]
    got = {r["id"]: r["canonical"] for r in canonical_text(rows_of(spark, texts), "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else glyphs.fold(t, alike)), (i, t and t[:20])


def test_pairs(spark):
    texts = ["no te", "no te", "n​o te", "no te", "No te", "nо te", None, "", "​", "x²", "x2", "café", "cafe", "café"]
    pairs = {tuple(r) for r in look_alike_pairs(rows_of(spark, texts), "doc_id", "text").collect()}
    same = [0, 1, 2, 3, 5]
    expected = {(a, b) for a in same for b in same if a < b and texts[a] != texts[b]} | {(7, 8), (11, 13)}
    assert pairs == expected


def test_repeated_rows_and_ids(spark):
    df = rows_of(spark, ["ａ", "a"]).unionByName(rows_of(spark, ["ａ", "a"])).unionByName(spark.createDataFrame([(0, "é", "", "")], "doc_id bigint, text string, canonical string, form string"))
    assert [tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()] == [(0, 1)]
    assert canonical_text(df, "doc_id", "text").where(F.col("id") == 0).select("canonical").distinct().count() == 2


def test_empty(spark):
    assert canonical_text(rows_of(spark, []), "doc_id", "text").count() == 0
    assert look_alike_pairs(rows_of(spark, []), "doc_id", "text").count() == 0


def test_classes(spark):
    rows = {tuple(r) for r in look_alike_classes(rows_of(spark, ["a", "а", "a", "b", None, ""]), "doc_id", "text").collect()}
    assert rows == {(0, 0, 2, 3), (1, 0, 2, 3), (2, 0, 2, 3), (3, 3, 1, 1), (5, 5, 1, 1)}
