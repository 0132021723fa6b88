import json

import pytest
from pyspark.sql import functions as F

from aksharflow import cli
from aksharflow.functions import models
from aksharflow.operators.lexicon import Lexicon
from aksharflow.operators.overrides import parse_overrides
from aksharflow.operators.ranges import config_table
from aksharflow.plans import batch, clean, extract, regression, splitting
from aksharflow.sources import pdf, text
from aksharflow.streaming import clean_stream

KRUTI = "eSaus gSjku gksdj ns[kk osQ dk Fk esa Hk"


def cleaned(spark, raw, **options):
    return clean.clean(spark.createDataFrame([(raw,)], "text string"), **options).first()


def test_clean_safe(spark):
    r = cleaned(spark, "\u092d\u093e\u0937\u093e \u0938\u0902\u0902\u0917\u092e\n\u0936\u092c\u094d\u094d\u0926\u094b\u094b\u0902 \u0915\u0940 \u0938\u0942\u091a\u0940", mode="safe")
    assert r["artifact_count_after"] < r["artifact_count_before"] and r["artifacts_removed"] > 0
    assert "\u092d\u093e\u0937\u093e \u0938\u0902\u0917\u092e" in r["cleaned_text"] and "\u0936\u092c\u094d\u0926\u094b\u0902" in r["cleaned_text"]
    assert r["stages_applied"] == ["post_process", "lexicon:safe"]


def test_clean_legacy(spark):
    r = cleaned(spark, KRUTI)
    assert r["detected_font_type"] == "krutidev" and r["has_encoding_issues"]
    assert r["stages_applied"] == ["convert:krutidev", "post_process"]
    assert any("\u0900" <= c <= "\u097f" for c in r["cleaned_text"]) and r["input_char_count"] == len(KRUTI)


def test_clean_unicode(spark):
    r = cleaned(spark, "\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948\u0939\u0948 \u0914\u0930 \u0935\u0939 \u0935\u0939\u093e\u0901 \u0925\u093e\u0925\u093e")
    assert r["cleaned_text"] == "\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948 \u0914\u0930 \u0935\u0939 \u0935\u0939\u093e\u0901 \u0925\u093e" and r["stages_applied"] == ["post_process"]
    prose = "\u0925\u094b\u0921\u093c\u0940 \u0926\u0947\u0930 \u0930\u0941\u0915\u0915\u0930 \u0935\u0939 \u091a\u094c\u0902\u0915\u0915\u0930 \u0909\u0920\u093e\u0964 \u091c\u0917\u0928 \u092e\u093e\u0938\u094d\u091f\u0930 \u0915\u0947 \u0918\u0930 \u092e\u0939\u093e\u0915\u0941\u0902\u092d \u0939\u094b \u0917\u092f\u093e\u0964 \u0915\u093f\u0938\u0940 \u0928\u0947 \u0939\u092e\u0932\u093e \u092c\u094b\u0932 \u0926\u093f\u092f\u093e\u0964 \u092e\u0941\u091d\u0947 \u092f\u0939 \u092c\u093e\u0924 \u0938\u092e\u091d \u0906 \u0917\u0908\u0964"
    assert cleaned(spark, prose, mode="safe")["cleaned_text"] == prose
    noisy = "\u091c\u0928\u094d\u094d\u092e\u092e \u0915\u0940 \u0915\u0925\u093e \u0926\u0943\u0936\u094d\u094d\u092f\u094b\u094b\u0902 \u092e\u0947\u0902 \u0938\u094d\u094d\u0925\u0925\u093f\u0924 \u092a\u094d\u0930\u0936\u094d\u094d\u0928\u094b\u094b\u0924\u094d\u0924\u0930 \u0939\u0948\u0939\u0948\u0964"
    out = cleaned(spark, noisy)["cleaned_text"]
    assert "\u091c\u0928\u094d\u092e" in out and "\u0938\u094d\u0925\u093f\u0924" in out and "\u0939\u0948\u0939\u0948" not in out and "\u0939\u0948\u0964" in out
    assert cleaned(spark, noisy, font="none")["cleaned_text"] == noisy
    with pytest.raises(ValueError):
        cleaned(spark, "x", mode="wild")


def test_clean_bootstrap_and_context(spark):
    df = spark.createDataFrame([("a", "\u0917\u0948\u0902\u0917\u091f\u0949\u0915 \u0917\u0948\u0902\u0917\u091f\u0949\u0915 \u0917\u0948\u0902\u0917\u0917\u091f\u0949\u0915"), ("b", "\u0917\u0948\u0902\u0917\u0917\u091f\u0949\u0915")], "book string, text string")
    got = {r["book"]: r["cleaned_text"] for r in clean.clean(df, mode="safe", lexicon=Lexicon.of(spark, {"x"}), bootstrap=True, by=["book"]).collect()}
    assert got == {"a": "\u0917\u0948\u0902\u0917\u091f\u0949\u0915 \u0917\u0948\u0902\u0917\u091f\u0949\u0915 \u0917\u0948\u0902\u0917\u091f\u0949\u0915", "b": "\u0917\u0948\u0902\u0917\u0917\u091f\u0949\u0915"}


def test_batch(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948\u0939\u0948", encoding="utf-8")
    (root / "sub" / "b.txt").write_text(KRUTI, encoding="utf-8")
    (root / "bad.txt").write_bytes(b"ok \xff\xfe")
    (root / "c.md").write_text("no")
    assert [p[0].rsplit("/", 1)[1] for p in text.discover_files(spark, str(root)).collect()] == ["a.txt", "bad.txt", "b.txt"]
    summary = batch.correct_corpus(spark, str(root), str(tmp_path / "out"), batch.BatchConfig())
    assert summary["files"] == summary["rows"] == 3 and summary["errors"] == 0
    assert summary["font_types"] == {"krutidev": 1, "unknown": 2}
    rows = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert {r["cleaned_text"] for r in rows} >= {"\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948", "ok \ufffd\ufffd"}
    assert batch.BatchConfig().to_dict()["correction_mode"] == "safe"


def test_summary_counts_errors(spark):
    df = spark.createDataFrame([("x", "krutidev", 3, None), ("y", None, None, "gone")], "input_path string, detected_font_type string, artifacts_removed int, error string")
    r = clean.summarise(df).first()
    assert (r["files"], r["errors"], r["artifacts_removed"], r["font_types"]) == (2, 1, 3, {"krutidev": 1})


PAGES = [("d", 1, KRUTI + " " + KRUTI), ("d", 2, "osQ osQ"), ("e", 1, "\u092f\u0939 \u090f\u0915 \u0938\u093e\u092b \u0939\u093f\u0902\u0926\u0940 \u0935\u093e\u0915\u094d\u092f \u0939\u0948"), ("e", 2, "\u091c\u0928\u094d\u094d\u092e\u092e \u0936\u092c\u094d\u0926")]


def pages(spark):
    return spark.createDataFrame(PAGES, "path string, page_num int, raw string")


def test_extract(spark):
    rules = parse_overrides(spark, json.dumps({"global": {"replacements": [["\u0915\u0947", "\u0915\u094b"]]}, "pages": {"1": {"replacements": [["\u092f\u0939", "\u0935\u0939"]]}}}))
    done = extract.extract_pages(pages(spark), overrides=rules)
    got = {(r["path"], r["page_num"]): r for r in done.collect()}
    assert got["d", 2]["text"] == "\u0915\u094b \u0915\u094b" and got["d", 2]["overrides_applied"] == 2 and got["d", 2]["detected_font_type"] == "krutidev"
    assert got["e", 1]["text"].startswith("\u0935\u0939") and got["e", 2]["text"] == "\u091c\u0928\u094d\u092e \u0936\u092c\u094d\u0926" and not got["e", 1]["has_encoding_issues"]
    docs = {r["path"]: r for r in extract.documents_of(done).collect()}
    assert docs["d"]["processed_pages"] == 2 and docs["d"]["full_text"].endswith("\n\n\u0915\u094b \u0915\u094b") and docs["e"]["overrides_applied"] == 1


def test_extract_second_stage(spark):
    raw = [("d", 1, KRUTI + " tUeee"), ("e", 1, "\u091c\u0928\u094d\u094d\u092e\u092e \u0939\u0948")]
    df = spark.createDataFrame(raw, "path string, page_num int, raw string")
    done = extract.extract_pages(df, second_stage="lexicon", bootstrap=True)
    got = {r["path"]: r for r in done.collect()}
    assert got["d"]["second_stage_applied"] and not got["e"]["second_stage_applied"] and got["e"]["page_correction_stats"] is None
    docs = {r["path"]: r for r in extract.documents_of(done).collect()}
    assert docs["d"]["correction_stats"]["tokens_seen"] > 0
    with pytest.raises(ValueError):
        extract.extract_pages(df, second_stage="other")


def test_compare(spark):
    english = "Read the passage given below and answer the questions in your own words."
    df = spark.createDataFrame([("p", 1, english), ("p", 2, KRUTI)], "path string, page_num int, raw string")
    got = {r["page_num"]: r for r in extract.compare(df).collect()}
    assert got[1]["comparison"]["view"]["display_mode"] == "raw_only" and got[1]["corrected"] == english and not got[1]["has_encoding_issues"]
    assert got[2]["comparison"]["legacy_conversion_applied"] and got[2]["corrected"] != KRUTI
    same = {r["page_num"]: r for r in extract.compare(df, convert_text=False).collect()}
    assert same[2]["comparison"]["raw_equals_corrected"]


def test_regression_report(spark):
    report = regression.page_report(pages(spark), lexicon=Lexicon.of(spark))
    rows = report.collect()
    assert len(rows) == 4 and all(r["corrected"]["quality_index"] >= r["baseline"]["quality_index"] for r in rows)
    whole = {r["path"]: r["pages"] for r in regression.rollup_report(report).collect()}
    assert whole == {"d": 2, "e": 2, None: 4}
    assert len(regression.format_report(report)) == 5
    assert regression.page_report(pages(spark), second_stage="none", page_limit=1).count() == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n\nnot json\n{"text": 5}\n{"other": 1}\n{"text": "b"}\n')
    assert sorted(r[0] for r in text.read_jsonl_field(spark, str(tmp_path / "x.jsonl")).collect()) == ["a", "b"]
    assert text.read_lines(spark, str(tmp_path / "x.jsonl")).count() == 6
    listed = text.list_outputs(spark, str(tmp_path)).collect()
    assert [r["name"] for r in listed] == ["x.jsonl"] and listed[0]["size_kb"] > 0
    df = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "path string, page_num int, text string")
    text.write_page_dump(df, str(tmp_path / "dump"), ["path"])
    assert "".join(p.read_text() for p in (tmp_path / "dump").glob("*.txt")) == "===== PAGE 1 =====\na\n\n===== PAGE 2 =====\nb\n"


def stand_in():
    """The opener as a closure, which workers get by value."""

    def fake(content):
        """Pages of a stand-in format: one a line; a line "!" can't be read."""
        if not content.startswith(b"P\n"):
            raise ValueError("no such file format")

        def page(line):
            def read():
                if line == "!":
                    raise ValueError("broken page")
                return line

            return read

        return [page(x) for x in content.decode().split("\n")[1:]], {"Title": "t"}

    return fake


def test_pdf_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(("P\n" + KRUTI + "\n!\nthree").encode())
    (tmp_path / "b.PDF").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("no")
    fake = stand_in()
    files = pdf.pdf_files(spark, str(tmp_path))
    got = sorted((r["path"][-5:], r["page_num"] or 0, r["raw"], bool(r["error"])) for r in pdf.read_pages(files, opener=fake).collect())
    assert got == [("a.pdf", 1, KRUTI, False), ("a.pdf", 2, "", False), ("a.pdf", 3, "three", False), ("b.PDF", 0, None, True)]
    assert [r["page_num"] for r in pdf.read_pages(files, (3, 9), fake).where("error is null").collect()] == [3]
    info = {r["filename"]: r for r in pdf.pdf_info(files.where("path like '%a.pdf'"), lambda c: (fake(c)[0][:1], {"Title": "t"})).collect()}
    assert info["a.pdf"]["total_pages"] == 1 and info["a.pdf"]["metadata"] == {"Title": "t"} and info["a.pdf"]["detected_font_type"] == "krutidev"
    one = lambda c: (fake(c)[0][:1], {})
    plan = splitting.plan_directory(spark, str(tmp_path), config_table(spark, '{"a": {"page_ranges": [{"start": 1, "end": 1}]}}'), one)
    assert {(r["base"], r["key"], r["out_name"]) for r in plan.collect()} == {("a", "a", "a_Lecture1.pdf"), ("b", None, None)}


def test_missing_libraries(spark):
    from importlib.util import find_spec

    if find_spec("pypdf") is None:
        with pytest.raises(pdf.PdfNotInstalled):
            pdf.require_pdf()
        assert cli.main(["info", "/nowhere.pdf"]) == 1
    with pytest.raises(models.ModelNotInstalled):
        models.require("no_such_library_here", "this")


def test_fill_mask(spark):
    run = models.fill_mask(lambda: lambda prompts: [p.replace("<mask>", "M") if "x" in p else " " for p in prompts])
    df = spark.createDataFrame([("t", "x", None), ("t", None, "y")], "token string, l string, r string")
    assert [r[0] for r in df.select(run("token", "l", "r")).collect()] == ["x M", "t"]
    assert df.select(models.verified(F.lit(b"abc"), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")).first()[0]


def test_stream_equals_batch(spark, tmp_path):
    root = tmp_path / "landing"
    root.mkdir()
    (root / "a.txt").write_text(KRUTI)
    (root / "b.txt").write_text("\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948\u0939\u0948", encoding="utf-8")
    query = clean_stream.start(clean_stream.clean_stream(clean_stream.read_landing(spark, str(root))), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "sum"))
    query.awaitTermination(120)
    streamed = {r["cleaned_text"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert streamed == {r["cleaned_text"] for r in clean.clean(text.read_text_files(spark, str(root))).collect()}
    assert spark.read.json(str(tmp_path / "sum")).first()["files"] == 2


def test_cli(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\u092f\u0939 \u0938\u0939\u0940 \u0939\u0948\u0939\u0948", encoding="utf-8")
    assert cli.main(["correct-corpus", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--correction-mode", "none", "--json"]) == 0
    assert cli.main(["correct-corpus", str(tmp_path / "none"), "-o", str(tmp_path / "out2")]) == 1
    args = cli.parser().parse_args(["regress", "x.pdf"])
    assert args.second_stage == "lexicon" and not args.bootstrap_lexicon


def test_empty_texts_do_not_fail_a_job(spark, tmp_path):
    """Read from a file, as a local table is evaluated otherwise; with empty, blank and null texts in every plan."""
    rows = [(1, ""), (2, "  \n"), (3, None), (4, KRUTI), (5, "क" * 60)]
    spark.createDataFrame(rows, "i int, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for mode in ("none", "safe"):
        got = {r["i"]: r for r in clean.clean(df, mode=mode).collect()}
        assert got[1]["stages_applied"] == [] and got[1]["cleaned_text"] == "" and got[1]["artifacts_removed"] == 0 and got[3]["cleaned_text"] is None and not got[1]["has_encoding_issues"]
        assert got[2]["stages_applied"][0] == "post_process" and got[4]["stages_applied"][0] == "convert:krutidev"
        assert clean.summarise(clean.clean(df, mode=mode)).first()["files"] == 5
    pages_ = df.select(F.lit("p").alias("path"), F.col("i").alias("page_num"), F.col("text").alias("raw"))
    for which in (pages_, pages_.where("page_num < 4")):
        assert extract.documents_of(extract.extract_pages(which, second_stage="lexicon", bootstrap=True)).count() == 1
        assert regression.page_report(which).count() == which.count() and extract.compare(which).count() == which.count()


def test_scrambled_text_has_issues(spark):
    r = cleaned(spark, "जन््मम शब््दोों की कथा " * 6)
    assert r["is_scrambled_devanagari"] and r["detected_font_type"] == "scrambled_devanagari" and r["has_encoding_issues"]


def test_artifacts_removed_may_be_negative(spark):
    """Conversion can bring artefacts that the glyphs did not show; the difference is reported as it is."""
    r = cleaned(spark, "dWWk", font="krutidev")
    assert r["artifact_count_before"] == 0 and r["artifacts_removed"] == -r["artifact_count_after"] < 0


def test_page_range_is_judged_from_the_start(spark, tmp_path):
    """A range of later pages is converted as the first ones are; pages ahead of it serve as the sample only."""
    rows = [("d", i, KRUTI) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "path string, page_num int, raw string")
    whole = {r["page_num"]: r["text"] for r in extract.extract_pages(df).collect()}
    part = extract.extract_pages(df, page_range=(10, 11)).collect()
    assert {r["page_num"]: r["text"] for r in part} == {i: whole[i] for i in (10, 11)} and {r["detected_font_type"] for r in part} == {"krutidev"}
    (tmp_path / "a.pdf").write_bytes(("P\n" + "\n".join([KRUTI] * 11)).encode())
    read = pdf.read_pages(pdf.pdf_files(spark, str(tmp_path)), (10, 11), stand_in(), with_sample=True)
    got = extract.extract_pages(read).collect()
    assert sorted(r["page_num"] for r in got) == [10, 11] and {r["detected_font_type"] for r in got} == {"krutidev"}


def test_regression_measures_with_the_given_words(spark):
    df = spark.createDataFrame([("d", 1, "गैंगटॉक"), ("e", 1, "पूर्वी पूर्वी")], "path string, page_num int, raw string")
    given = Lexicon.of(spark, {"गैंगटॉक"})
    plain = {r["path"]: r for r in regression.page_report(df, lexicon=given, bootstrap=False).collect()}
    assert plain["d"]["baseline"]["lexicon_hit_rate"] == 1.0 and plain["e"]["baseline"]["lexicon_hit_rate"] == 0.0
    boot = {r["path"]: r for r in regression.page_report(df, lexicon=given, bootstrap=True).collect()}
    assert boot["d"]["baseline"]["lexicon_hit_rate"] == boot["e"]["baseline"]["lexicon_hit_rate"] == 1.0
    assert (boot["e"]["contextual_lexicon_size"], boot["e"]["effective_lexicon_size"]) == (1, 2)
    failed = df.withColumn("error", F.lit(None).cast("string")).unionByName(spark.createDataFrame([("f", "gone")], "path string, error string"), allowMissingColumns=True)
    assert {r["path"]: r["error"] for r in regression.page_report(failed).collect()} == {"d": None, "e": None, "f": "gone"}


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "a.md").write_text("यह", encoding="utf-8")
    assert [r["text"] for r in text.read_text_files(spark, str(tmp_path / "a.md")).collect()] == ["यह"]
    paths = spark.createDataFrame([(str(tmp_path / "a.md"),), (str(tmp_path / "gone.txt"),)], "path string")
    got = clean.clean(text.read_paths(paths))
    assert sorted(bool(r["error"]) for r in got.collect()) == [False, True] and clean.summarise(got).first()["errors"] == 1


def test_cli_options():
    args = cli.parser().parse_args(["correct-corpus", "x", "--extensions", ".txt", ".md"])
    assert args.extensions == [".txt", ".md"] and args.output
    assert cli.parser().parse_args(["regress", "a.pdf", "b.pdf"]).path == ["a.pdf", "b.pdf"]
