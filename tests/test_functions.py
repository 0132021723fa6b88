import pytest
from pyspark.sql import functions as F

from aksharflow.functions import detect, glyphs, repair
from helpers import many, one

KRUTI = "eSaus gSjku gksdj ns[kk osQ dk Fk esa Hk"


def test_detect_encoding(spark):
    texts = [KRUTI, "\u092f\u0939 \u090f\u0915 \u0938\u093e\u092b\u093c \u0939\u093f\u0902\u0926\u0940 \u0935\u093e\u0915\u094d\u092f \u0939\u0948", "", "\u092e\u0948\u0902\u0928\u0947 xyz \u0939\u0948\u0930\u093e\u0928 abc \u0939\u094b\u0915\u0930 pqr \u0926\u0947\u0916\u093e", "Aa ao AO A \xac \xa4 k g c j t d", None]
    found = [(r["has_issues"], r["font"]) for r in many(spark, texts, detect.detect_encoding)]
    assert found == [(True, "krutidev"), (False, "unknown"), (False, "unknown"), (False, "unknown"), (True, "chanakya"), (False, "unknown")]


@pytest.mark.parametrize(
    ("text", "font", "expected"),
    [
        ("osQ", "krutidev", "\u0915\u0947"),
        ("iQ", "krutidev", "\u092b"),
        ("oqQN", "krutidev", "\u0915\u0941\u091b"),
        ("osQ dk Fk", "auto", "\u0915\u0947 \u0915\u093e \u0925"),
        ("", "krutidev", ""),
        ("@#$^", "krutidev", "@#$^"),
        ("k", "chanakya", "\u0915"),
        ("fd", "krutidev", "\u0915\u093f"),
        ("fad", "krutidev", "\u0915\u093f\u0902"),
        ("osQ", "nothing", "osQ"),
    ],
)
def test_convert(spark, text, font, expected):
    assert one(spark, text, lambda c: glyphs.convert(c, font)) == expected
    if font != "auto":
        assert one(spark, text, lambda c: glyphs.convert(c, F.lit(font))) == expected


def test_convert_keeps_devanagari(spark):
    out = one(spark, "\u092e\u0948\u0902\u0928\u0947 xyz \u0939\u0948\u0930\u093e\u0928", lambda c: glyphs.convert(c, "krutidev"))
    assert out.startswith("\u092e\u0948\u0902\u0928\u0947 ") and out.endswith(" \u0939\u0948\u0930\u093e\u0928")


def test_convert_matches_a_greedy_scan(spark):
    texts = [KRUTI, "vkWvks,sbZ[k?k.k\u2018\u2019\u201dk fLFkfr vkSj", "m\u00a1QpkbZ p\u00d8 iz\u00d1fr", "A Aa ao k|c\u00ac xyz", "\u0915 vk \u0916"]

    def scan(text, font):
        table, out, i = glyphs.mapping(font), "", 0
        keys = sorted(table, key=len, reverse=True)
        while i < len(text):
            k = next((k for k in keys if text.startswith(k, i)), text[i])
            out, i = out + table.get(k, k), i + len(k)
        return out

    for font in ("krutidev", "chanakya"):
        expected = [scan(t, font) for t in texts]
        assert many(spark, texts, lambda c: glyphs._substitute(c, font)) == expected


PAIRS = [
    ("\u093e\u093e", "\u093e"), ("\u093f\u093f", "\u093f"), ("\u0940\u0940", "\u0940"), ("\u0905\u094c\u0930", "\u0914\u0930"), ("\u0905\u093e\u0930", "\u0906\u0930"), ("\u090f\u0915\u093c", "\u090f\u0915"),
    ("\u092a\u094d\u0930\u0938\u094d \u0924 \u0941\u0924", "\u092a\u094d\u0930\u0938\u094d\u0924\u0941\u0924"), ("\u0938\u094d \u0915 \u0942\u0932", "\u0938\u094d\u0915\u0942\u0932"), ("\u0915\u0915 \u0902", "\u0915\u093f\u0902"), ("\u0935\u0935\u0915", "\u0935\u093f\u0915"), ("\u0923\u0923\u092f", "\u0923\u093f\u092f"), ("\u0938\u0938\u092f", "\u0938\u093f\u092f"),
    ("\u0936\u094d\u0936\u094d\u093f\u092e", "\u0936\u094d\u091a\u093f\u092e"), ("\u0921\u0921\u093c\u0924", "\u0921\u093c\u093f\u0924"), ("\u091c\u0928\u094d\u094d\u092e\u092e", "\u091c\u0928\u094d\u092e"), ("\u0938\u094d\u094d\u0925\u0925\u093f\u0924", "\u0938\u094d\u0925\u093f\u0924"), ("\u0926\u0943\u0936\u094d\u094d\u092f\u094b\u094b\u0902", "\u0926\u0943\u0936\u094d\u092f\u094b\u0902"), ("\u0935\u0943\u0924\u094d\u094d\u0924\u093e\u093e\u0902\u093e\u0902\u0924", "\u0935\u0943\u0924\u094d\u0924\u093e\u0902\u0924"),
    ("\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948\u0939\u0948?", "\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948?"), ("\u092a\u094d\u0930\u0936\u094d\u0928 \u0939\u0948\u0939\u0948\u0964", "\u092a\u094d\u0930\u0936\u094d\u0928 \u0939\u0948\u0964"), ("\u0935\u0939 \u0935\u0939\u093e\u0901 \u0925\u093e\u0925\u093e", "\u0935\u0939 \u0935\u0939\u093e\u0901 \u0925\u093e"), ("\u0915\u094d\u092f\u093e\u0915\u094d\u092f\u093e", "\u0915\u094d\u092f\u093e\u0915\u094d\u092f\u093e"), ("", ""),
]


def test_post_process(spark):
    assert many(spark, [a for a, _ in PAIRS], lambda c: repair.post_process(c, True)) == [b for _, b in PAIRS]
    kept = ["\u0930\u0941\u0915\u0915\u0930", "\u092e\u0939\u093e\u0915\u0941\u0902\u092d", "\u091a\u094c\u0902\u0915\u0915\u0930"]
    assert many(spark, kept, lambda c: repair.post_process(c, False)) == kept
    assert many(spark, kept + ["\u0935\u0935\u0915"], lambda c: repair.post_process(c, F.lit(False))) == kept + ["\u0935\u0935\u0915"]
    assert one(spark, "\u0935\u0935\u0915", lambda c: repair.post_process(c, F.lit(True))) == "\u0935\u093f\u0915"
    assert one(spark, None, lambda c: repair.post_process(c, True)) is None


def test_correct_hindi_text(spark):
    out = one(spark, "osQ dk Fk", lambda c: repair.correct_hindi_text(c, "krutidev"))
    assert "\u0915\u0947" in out and "\u0915\u093e" in out


def test_glyph_tables(spark):
    kruti, chanakya = glyphs.mapping("krutidev"), glyphs.mapping("chanakya")
    assert (len(kruti), len(chanakya)) == (139, 63)
    assert glyphs.mapping("walkman_chanakya") == kruti == glyphs.mapping("other")
    assert kruti["iQ"] == "\u092b" and kruti["osQ"] == "\u0915\u0947" and chanakya["k"] == "\u0915" and kruti["\xb8"] == ","
    for value in [*kruti.values(), *chanakya.values()]:
        assert value and all("\u0900" <= c <= "\u097f" or ord(c) < 128 or c in "\u2026\u201c\u201d\u2018\u2019\u2014\u2013" for c in value)
    assert glyphs.glyph_table(spark).count() == 139 * 2 + 63


def test_artifacts(spark):
    r = one(spark, "\u092d\u093e\u0937\u093e \u0938\u0902\u0902\u0917\u092e\n\u0936\u092c\u094d\u094d\u0926\u094b\u094b\u0902 \u0915\u0940 \u093f \u0915\x01 \u0915\u094d\u200d\u093e \u0938\u094d \u0925", detect.count_artifacts)
    assert r["duplicate_marks"] == 3 and r["control_chars"] == 1 and r["halant_space"] == 1 and r["stray_zwj"] == 1
    assert r["total"] == sum(v for k, v in r.asDict().items() if k != "total")
    assert one(spark, "", detect.count_artifacts)["total"] == 0


def test_scrambled(spark):
    noisy, clean = "\u0936\u092c\u094d\u094d\u0926\u094b\u094b\u0902 \u0915\u0940 \u0938\u0942\u091a\u0940 \u0938\u0902\u0902\u0917\u092e " * 6, "\u092f\u0939 \u090f\u0915 \u0938\u093e\u092b \u0939\u093f\u0902\u0926\u0940 \u0935\u093e\u0915\u094d\u092f \u0939\u0948 \u091c\u094b \u0920\u0940\u0915 \u0932\u093f\u0916\u093e \u0917\u092f\u093e \u0939\u0948 " * 4
    assert many(spark, [noisy, clean, "", None], detect.detect_scrambled) == [True, False, False, False]


def test_garbage(spark):
    texts = ["\u092f\u0939 \u090f\u0915 \u0938\u093e\u092b \u0939\u093f\u0902\u0926\u0940 \u0935\u093e\u0915\u094d\u092f \u0939\u0948 \u091c\u094b \u0920\u0940\u0915 \u0932\u093f\u0916\u093e \u0917\u092f\u093e \u0939\u0948 \u0914\u0930 \u092a\u0922\u093c\u0928\u0947 \u092f\u094b\u0917\u094d\u092f \u0939\u0948\u0964", "\u091b\u094b\u091f\u093e", "", "....,,,,;;;;::::" * 10, "\x01\x02\x03\x04\x05" * 20, "1234567890" * 8]
    r = many(spark, texts, detect.garbage)
    assert [x["is_garbage"] for x in r] == [False, True, True, True, True, True]
    assert r[0]["reason"] == "Text quality acceptable" and r[0]["score"] > 0.9
    assert "short" in r[1]["reason"] and "punctuation" in r[3]["reason"] and "letters" in r[5]["reason"]


def test_latin_chunk(spark):
    english = "Read the passage given below and answer the questions that follow in your own words."
    assert many(spark, [english, "\u092f\u0939 \u090f\u0915 \u0938\u093e\u092b \u0939\u093f\u0902\u0926\u0940 \u0935\u093e\u0915\u094d\u092f \u0939\u0948", "", "eSaus gSjku gksdj ns[kk osQ dk Fk esa", None], detect.latin_chunk) == [True, False, False, False, False]


def test_summary_branches(spark):
    rows = [("a", "a", False, "unknown", True, True), ("a", "a", False, "unknown", False, False), ("a", "b", True, "krutidev", True, False), ("a", "b", True, "scrambled_devanagari", True, False), ("a", "b", False, "unknown", True, False), ("a", "a", True, "krutidev", True, False), ("a", "a", False, "unknown", True, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, fixed string, issues boolean, font string, conv boolean, latin boolean")
    out = df.select("i", detect.summarize_extraction(*(F.col(c) for c in ("raw", "fixed", "issues", "font", "conv", "latin"))).alias("s")).orderBy("i").collect()
    assert [r["s"]["view"]["tone"] for r in out] == ["secondary", "secondary", "success", "info", "info", "info", "secondary"]
    assert [r["s"]["view"]["display_mode"] for r in out] == ["raw_only"] + ["comparison"] * 6
    assert out[2]["s"]["legacy_conversion_applied"] and out[3]["s"]["scrambled_cleanup_applied"]


def test_fast_and_plain_substitution_agree(spark):
    keys = sorted({k for f in ("krutidev", "chanakya") for k in glyphs.mapping(f)})
    texts = ["".join(keys[(i * 7 + j * j) % len(keys)] for j in range(60)) for i in range(40)] + ["".join(keys), "a\U000f0000b vk", "line\nvk\r\nकvks", ""]
    for font in ("krutidev", "chanakya"):
        assert many(spark, texts, lambda c: glyphs._substitute(c, font)) == many(spark, texts, lambda c: glyphs._plain_substitute(c, font))
