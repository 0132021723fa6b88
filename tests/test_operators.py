import pytest
from pyspark.sql import functions as F

from aksharflow.functions.repair import normalize_token
from aksharflow.operators import candidates, frequency, lexicon, overrides, quality, ranges, symspell, tokens
from aksharflow.operators.lexicon import Lexicon
from helpers import many, one


def fix(spark, words, text, max_distance=2, min_token_length=4):
    lex = Lexicon.of(spark, set(words) if words is not None else None)
    df = spark.createDataFrame([(text,)], "text string")
    r = lexicon.correct(df, "text", lex, max_distance, min_token_length).first()
    return r["corrected"], r["stats"]


def test_normal_form(spark):
    assert many(spark, ["\u0935\u093e\u0915\u094d\u094d\u092f\u094b\u0902", "\u092e\u0947\u093e\u0930\u0924\u0940", "\u0915\u0915\u0915", "\u0938\u092b\u093c", ""], normalize_token) == ["\u0935\u093e\u0915\u092f\u094b\u0902", "\u092e\u093e\u0930\u0924\u0940", "\u0915", "\u0938\u092b", ""]


CASES = [
    ({"\u0935\u0930\u094d\u0924\u092e\u093e\u0928", "\u092a\u094d\u0930\u093e\u0930\u094d\u0925\u0928\u093e", "\u0938\u093f\u0930\u094d\u092b"}, "\u0935\u0924\u093c\u092e\u093e\u0928 \u092a\u094d\u0930\u093e\u0925\u093c\u0928\u093e", 2, 4, "\u0935\u0930\u094d\u0924\u092e\u093e\u0928 \u092a\u094d\u0930\u093e\u0930\u094d\u0925\u0928\u093e", 2),
    ({"\u0914\u0930", "\u0925\u093e"}, "\u0914\u0930 \u0925\u093e", 2, 4, "\u0914\u0930 \u0925\u093e", 0),
    ({"\u0915\u093f\u0938\u0940", "\u091c\u093e\u0928\u0935\u0930\u094b\u0902", "\u0928\u093f\u0936\u094d\u091a\u092f", "\u091c\u093e\u0924\u093e"}, "\u091c\u0915\u0938\u0940 \u093f\u093e\u0928\u0935\u0930\u094b\u0902 \u091c\u0928\u0936\u094d\u091a\u092f \u093f\u093e\u0924\u093e", 2, 4, "\u0915\u093f\u0938\u0940 \u091c\u093e\u0928\u0935\u0930\u094b\u0902 \u0928\u093f\u0936\u094d\u091a\u092f \u091c\u093e\u0924\u093e", 4),
    ({"\u0915\u094d\u092f\u093e", "\u0915\u0925\u093e"}, "\u091c\u0915\u092f\u093e", 2, 4, "\u091c\u0915\u092f\u093e", 0),
    ({"\u092e\u093e\u0930\u0924\u0940", "\u092e\u093e\u0930\u0924\u093e", "\u092e\u094b\u0924\u0940"}, "\u092e\u0947\u093e\u0930\u0924\u0940 \u092e\u0947\u093e\u0930\u0924\u093e \u092e\u0947\u094b\u0924\u0940", 2, 4, "\u092e\u093e\u0930\u0924\u0940 \u092e\u093e\u0930\u0924\u093e \u092e\u094b\u0924\u0940", 3),
    ({"\u092e\u093e\u0930\u094d\u0917", "\u092e\u0947\u0930\u093e"}, "\u092e\u0947\u093e\u0930\u094b", 2, 4, "\u092e\u0947\u093e\u0930\u094b", 0),
    ({"\u0935\u093e\u0915\u094d\u092f\u094b\u0902", "\u091c\u0928\u094d\u092e", "\u092f\u093e\u0924\u094d\u0930\u093e", "\u0915\u093f\u092f\u093e"}, "\u0935\u093e\u0915\u094d\u094d\u092f\u094b\u0902, \u091c\u0928\u094d\u094d\u092e\u092e \u092f\u092f\u093e\u0924\u094d\u0930\u093e \u0915\u093f\u092f\u092f\u093e\u0964", 2, 4, "\u0935\u093e\u0915\u094d\u092f\u094b\u0902, \u091c\u0928\u094d\u092e \u092f\u093e\u0924\u094d\u0930\u093e \u0915\u093f\u092f\u093e\u0964", 4),
    ({"\u0935\u093e\u0926\u093f\u092f\u094b\u0902", "\u0938\u094d\u0925\u0917\u093f\u0924", "\u0938\u094d\u0925\u0932"}, "\u0935\u093e\u0915\u094d\u094d\u092f\u094b\u0902", 2, 4, "\u0935\u093e\u0915\u094d\u094d\u092f\u094b\u0902", 0),
    ({"\u0936\u092c\u094d\u0926", "\u0936\u092c\u094d\u0926\u094b\u0902", "\u092f\u0939", "\u092f\u0939\u0940", "\u092f\u0925\u093e\u0930\u094d\u0925\u0924\u093e", "\u0906\u0928\u0902\u0926"}, "\u0936\u093f\u092c\u094d\u0926 \u0936\u093f\u092c\u094d\u0926\u094b\u0902 \u092f\u093f\u0939 \u092f\u093f\u0939\u0940 \u092f\u093f\u0925\u093e\u0930\u094d\u0925\u0924\u093e \u0906\u0928\u093f\u0902\u0926", 0, 1, "\u0936\u092c\u094d\u0926 \u0936\u092c\u094d\u0926\u094b\u0902 \u092f\u0939 \u092f\u0939\u0940 \u092f\u0925\u093e\u0930\u094d\u0925\u0924\u093e \u0906\u0928\u0902\u0926", 6),
    ({"\u0935\u094d\u092f\u0915\u094d\u0924", "\u092c\u0928\u093e", "\u092f\u0939", "\u0935\u094d\u092f\u0915\u094d\u0924\u093f", "\u092c\u093f\u0928\u093e"}, "\u0935\u094d\u092f\u0915\u094d\u0924\u093f \u092c\u093f\u0928\u093e", 0, 1, "\u0935\u094d\u092f\u0915\u094d\u0924\u093f \u092c\u093f\u0928\u093e", 0),
    (None, "\u0935\u094d\u092f\u0915\u094d\u0924\u093f \u0926\u0940\u0935\u0935\u093e\u0930 \u091a\u0941\u0928\u093e\u0935\u0935 \u0917\u094c\u0930\u0935\u0935", 0, 1, "\u0935\u094d\u092f\u0915\u094d\u0924\u093f \u0926\u0940\u0935\u093e\u0930 \u091a\u0941\u0928\u093e\u0935 \u0917\u094c\u0930\u0935", 3),
    ({"\u0935\u093f\u0936\u0947\u0937", "\u0936\u092c\u094d\u0926", "\u0936\u092c\u094d\u0926\u094b\u0902", "\u0938\u0902\u092a\u0942\u0930\u094d\u0923", "\u0928\u093e\u0917\u093e\u0930\u094d\u091c\u0941\u0928"}, "\u0935\u093f\u0936\u0936\u0947\u0937 \u0936\u0936\u092c\u094d\u094d\u0926\u0926 \u0936\u0936\u092c\u094d\u094d\u0926\u094b\u094b\u0902 \u0938\u0938\u0902\u092a\u0942\u0930\u094d\u0923 \u0928\u0928\u093e\u0917\u093e\u0930\u094d\u091c\u091c\u0941\u0928", 0, 1, "\u0935\u093f\u0936\u0947\u0937 \u0936\u092c\u094d\u0926 \u0936\u092c\u094d\u0926\u094b\u0902 \u0938\u0902\u092a\u0942\u0930\u094d\u0923 \u0928\u093e\u0917\u093e\u0930\u094d\u091c\u0941\u0928", 5),
]


@pytest.mark.parametrize("case", CASES)
def test_corrector(spark, case):
    words, text, distance, length, expected, corrected = case
    out, stats = fix(spark, words, text, distance, length)
    assert out == expected
    assert stats["corrected_tokens"] == corrected and stats["tokens_seen"] == len(text.split())


def test_statistics_list_twenty(spark):
    _, stats = fix(spark, {"\u091c\u0928\u094d\u092e"}, "\u091c\u0928\u094d\u094d\u092e\u092e " * 25)
    assert stats["corrected_tokens"] == 25 and len(stats["corrections"]) == 20
    assert stats["corrections"][0]["from"] == "\u091c\u0928\u094d\u094d\u092e\u092e" and stats["corrections"][0]["to"] == "\u091c\u0928\u094d\u092e"


def test_rows_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "\u091c\u0928\u094d\u094d\u092e\u092e"), (5, "\u091c\u0928\u094d\u094d\u092e\u092e")], "i int, text string")
    out = {r["i"]: (r["corrected"], r["stats"]["corrected_tokens"]) for r in lexicon.correct(df, "text", Lexicon.of(spark, {"\u091c\u0928\u094d\u092e"})).collect()}
    assert out == {1: (None, 0), 2: ("", 0), 3: ("abc", 0), 4: ("\u091c\u0928\u094d\u092e", 1), 5: ("\u091c\u0928\u094d\u092e", 1)}


def test_contextual_lexicon(spark):
    df = spark.createDataFrame([("a", "\u0917\u0948\u0902\u0917\u091f\u0949\u0915 \u090f\u0915 \u0938\u0941\u0902\u0926\u0930 \u0936\u0939\u0930 \u0939\u0948"), ("a", "\u0917\u0948\u0902\u0917\u091f\u0949\u0915 \u0915\u0940 \u0930\u093e\u0924 \u0938\u0941\u0902\u0926\u0930 \u0939\u0948"), ("b", "\u0917\u0948\u0902\u0917\u091f\u0949\u0915 \u092e\u0947\u0902"), ("a", "\u0926\u0926\u093c\u092c\u092c\u093e \u0926\u0926\u093c\u092c\u092c\u093e")], "book string, text string")
    base = Lexicon.of(spark, {"\u090f\u0915", "\u0938\u0941\u0902\u0926\u0930", "\u0936\u0939\u0930", "\u0930\u093e\u0924", "\u0939\u0948"})
    assert {tuple(r) for r in lexicon.contextual_lexicon(df, "text", base, ["book"]).collect()} == {("a", "\u0917\u0948\u0902\u0917\u091f\u0949\u0915")}
    assert {r[0] for r in lexicon.contextual_lexicon(df, "text", base).collect()} == {"\u0917\u0948\u0902\u0917\u091f\u0949\u0915"}
    noisy = spark.createDataFrame([("a", "\u0917\u0948\u0902\u0917\u0917\u091f\u0949\u0915"), ("b", "\u0917\u0948\u0902\u0917\u0917\u091f\u0949\u0915")], "book string, text string")
    use = base.within(lexicon.contextual_lexicon(df, "text", base, ["book"]), ["book"])
    got = {r["book"]: r["corrected"] for r in lexicon.correct(noisy, "text", use, 0).collect()}
    assert got == {"a": "\u0917\u0948\u0902\u0917\u091f\u0949\u0915", "b": "\u0917\u0948\u0902\u0917\u0917\u091f\u0949\u0915"}


def test_lexicon_file_and_union(spark, tmp_path):
    (tmp_path / "w.txt").write_text("\u0915\u0916\u0917, \u0918\u091a\u091b\nabc", encoding="utf-8")
    lex = Lexicon.of(spark, {"\u090f\u0915"}, str(tmp_path / "w.txt"))
    assert lex.size == 3
    assert lex.add(spark.createDataFrame([("\u090f\u0915",), ("\u0926\u094b",)], "word string")).size == 4
    assert len(lexicon.default_words()) == 610


def cands(spark, token):
    rows = candidates.generate(spark.createDataFrame([(token,)], "token string")).orderBy("ord").collect()
    return {r["text"]: (r["confidence"], r["reason"]) for r in rows}


def test_candidates(spark):
    c = cands(spark, "\u0930\u0941\u0915\u0915\u0930")
    assert c["\u0930\u0941\u0915\u0915\u0930"] == (0.5, "keep") and "\u0930\u0941\u0915\u093f\u0930" in c and c["\u0930\u0941\u0915\u0930"] == (0.55, "dup_consonant_collapse")
    assert cands(spark, "\u091c\u0928\u094d\u094d\u092e\u092e")["\u091c\u0928\u094d\u092e"] == (pytest.approx(0.765), "dup_halant+halant_dup_cons")


def best(spark, token, scoring=None):
    rows = candidates.generate(spark.createDataFrame([(token,)], "token string"))
    return candidates.select_best(candidates.score(rows, scoring)).first()["text"]


def test_scoring(spark):
    word = lambda w: candidates.Scoring(lexicon=Lexicon.of(spark, {w}))
    assert best(spark, "\u0930\u0941\u0915\u0915\u0930", word("\u0930\u0941\u0915\u0915\u0930")) == "\u0930\u0941\u0915\u0915\u0930"
    assert best(spark, "\u0930\u0941\u0915\u0915\u0930") == "\u0930\u0941\u0915\u0930"
    assert best(spark, "\u091c\u0928\u094d\u094d\u092e\u092e", word("\u091c\u0928\u094d\u092e")) == "\u091c\u0928\u094d\u092e"
    given = spark.createDataFrame([("t", "AB", 0.8, "r1", [0]), ("t", "CD", 0.8, "r2", [1])], "token string, text string, confidence double, reason string, ord array<int>")
    assert candidates.select_best(candidates.score(given)).first()["text"] == "AB"
    counts = spark.createDataFrame([("AB", 1), ("CD", 10000)], "term string, cnt bigint")
    assert candidates.select_best(candidates.score(given, candidates.Scoring(frequency=counts))).first()["text"] == "CD"
    assert candidates.select_best(candidates.score(given, candidates.Scoring(extra=lambda t: F.when(t == "CD", 1.0)))).first()["text"] == "CD"
    assert candidates.RULES[0].name == "keep"


def test_candidate_correction(spark):
    df = spark.createDataFrame([("\u0925\u094b\u0921\u093c\u0940 \u0926\u0947\u0930 \u0930\u0941\u0915\u0915\u0930 \u0935\u0939 \u091a\u094c\u0902\u0915\u0915\u0930 \u0909\u0920\u093e\u0964",), ("\u091c\u0928\u094d\u094d\u092e\u092e \u0914\u0930 \u0938\u094d\u094d\u0925\u0925\u093f\u0924",), ("",)], "text string")
    scoring = candidates.Scoring(lexicon=Lexicon.of(spark, {"\u0930\u0941\u0915\u0915\u0930", "\u091a\u094c\u0902\u0915\u0915\u0930", "\u091c\u0928\u094d\u092e", "\u0938\u094d\u0925\u093f\u0924"}))
    out = {r["text"]: r for r in candidates.correct(df, "text", scoring=scoring).collect()}
    kept = out["\u0925\u094b\u0921\u093c\u0940 \u0926\u0947\u0930 \u0930\u0941\u0915\u0915\u0930 \u0935\u0939 \u091a\u094c\u0902\u0915\u0915\u0930 \u0909\u0920\u093e\u0964"]
    assert kept["corrected"] == kept["text"] and kept["stats"]["corrected_tokens"] == 0
    fixed = out["\u091c\u0928\u094d\u094d\u092e\u092e \u0914\u0930 \u0938\u094d\u094d\u0925\u0925\u093f\u0924"]
    assert fixed["corrected"] == "\u091c\u0928\u094d\u092e \u0914\u0930 \u0938\u094d\u0925\u093f\u0924" and fixed["stats"]["corrected_tokens"] == 2
    assert fixed["stats"]["rule_counts"] == {"dup_halant+halant_dup_cons": 2}
    assert out[""]["corrected"] == ""


def test_osa(spark):
    pairs = [("ab", "ba", 1), ("", "abc", 3), ("abc", "", 3), ("kitten", "sitting", 3), ("ca", "abc", 3), ("abcdef", "abcdef", 0), ("\u0915", "\u0940", 1)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, d int")
    assert df.where(symspell.osa(F.col("a"), F.col("b")) != F.col("d")).count() == 0


def test_symspell(spark):
    speller = symspell.SymSpell.default(spark)
    assert speller.size() > 100
    term = "\u0932\u0947\u0915\u093f\u0928"
    asked = spark.createDataFrame([(term,), (term[1] + term[0] + term[2:],), ("\u0915\u0916\u0917\u0918\u0919\u091a\u091b\u091c",)], "token string")
    got = {r["token"]: (r["term"], r["distance"]) for r in speller.suggest(asked).collect()}
    assert got[term] == (term, 0) and got[term[1] + term[0] + term[2:]] == (term, 1) and "\u0915\u0916\u0917\u0918\u0919\u091a\u091b\u091c" not in got
    out = speller.correct(spark.createDataFrame([(f"{term[:-1]} \u0915 {term}",)], "text string"), "text").first()
    assert out["corrected"] == f"{term} \u0915 {term}" and out["stats"]["tokens_considered"] == 1
    more = symspell.add_words(speller.dictionary, spark.createDataFrame([(" \u0928\u092f\u093e\u0936\u092c\u094d\u0926 ",), (" ",), (term,)], "word string"), 5)
    found = {r["term"]: r["cnt"] for r in more.where(F.col("term").isin("\u0928\u092f\u093e\u0936\u092c\u094d\u0926", term)).collect()}
    assert found == {"\u0928\u092f\u093e\u0936\u092c\u094d\u0926": 5, term: 1005}


def test_quality(spark):
    words = {"\u0935\u0930\u094d\u0924\u092e\u093e\u0928", "\u092a\u094d\u0930\u093e\u0930\u094d\u0925\u0928\u093e", "\u0914\u0930", "\u0938\u093f\u0930\u094d\u092b"}
    r = one(spark, "\u0935\u0930\u094d\u0924\u092e\u093e\u0928 \u092a\u094d\u0930\u093e\u0930\u094d\u0925\u0928\u093e \u0914\u0930 \u0938\u093f\u092a\u093c\u094d\u093e\u093c\u092b A B", lambda c: quality.measure_quality(c, words))
    assert r["token_count"] >= 3 and r["lexicon_hit_rate"] > 0 and r["artifact_counts"]["spurious_nukta"] >= 1 and r["artifact_counts"]["latin_residue"] == 2
    noisy, clean = many(spark, ["\u0935\u0924\u093c\u092e\u093e\u0928 \u092a\u094d\u0930\u093e\u0925\u093c\u0928\u093e \u0938\u093f\u092a\u093c\u094d\u093e\u093c\u092b A A", "\u0935\u0930\u094d\u0924\u092e\u093e\u0928 \u092a\u094d\u0930\u093e\u0930\u094d\u0925\u0928\u093e \u0938\u093f\u0930\u094d\u092b \u0914\u0930 \u0930\u094b\u0936\u0928\u0940"], lambda c: quality.measure_quality(c, words | {"\u0930\u094b\u0936\u0928\u0940"}))
    assert clean["quality_index"] > noisy["quality_index"]
    assert one(spark, "", lambda c: quality.measure_quality(c, words))["token_count"] == 0


def test_frequencies(spark, tmp_path):
    df = spark.createDataFrame([("\u0915\u0916\u0917 \u0915\u0916\u0917 \u0918\u091a abc",), ("\u0915\u0916\u0917 \u0918\u091a \u091b",)], "text string")
    freq = frequency.token_frequencies(df, "text", 2)
    assert {tuple(r) for r in freq.collect()} == {("\u0915\u0916\u0917", 3), ("\u0918\u091a", 2)}
    frequency.write_dictionary(freq, str(tmp_path / "d"))
    assert [tuple(r) for r in symspell.read_dictionary(spark, str(tmp_path / "d")).collect()] == [("\u0915\u0916\u0917", 3), ("\u0918\u091a", 2)]
    assert {r[0] for r in frequency.spaced_tokens(df, "text").collect()} == {"\u0915 \u0916 \u0917", "\u0918 \u091a", "\u091b"}
    grams = {(r["n"], r["gram"]): r["cnt"] for r in frequency.char_ngrams(df, "text", 2).collect()}
    assert grams[1, "\u0915"] == 3 and grams[2, "\u0915\u0916"] == 3 and grams[2, "\u0918\u091a"] == 2 and (2, "\u0917\u0918") not in grams
    model = frequency.train_char_lm(frequency.char_ngrams(df, "text"))
    asked = spark.createDataFrame([("\u0915\u0916\u0917",), ("\u0917\u0916\u0915",)], "token string")
    score = {r["token"]: r["log_prob"] for r in frequency.score_tokens(asked, model).collect()}
    assert score["\u0915\u0916\u0917"] > score["\u0917\u0916\u0915"]


def test_overrides(spark):
    rules = overrides.parse_overrides(spark, '{"global": {"replacements": [["a", "b"], ["b", "c"]]}, "pages": {"2": {"replacements": [["c", "dd"]]}}}')
    pages = spark.createDataFrame([(1, "aab"), (2, "aXb"), (3, None)], "page_num int, text string")
    got = {r["page_num"]: (r["text"], r["overrides_applied"]) for r in overrides.apply_overrides(pages, rules).collect()}
    assert got == {1: ("ccc", 5), 2: ("ddXdd", 5), 3: (None, 0)}
    with pytest.raises(ValueError):
        overrides.parse_overrides(spark, "[]")


def test_ranges(spark):
    parse = ranges.parse_ranges_string
    assert parse("1-10:Lecture1,11-20:Lecture2") == [(1, 10, "Lecture1"), (11, 20, "Lecture2")]
    assert parse("1-5,6-10") == [(1, 5, None), (6, 10, None)]
    assert parse("1-3:Intro,4-10,11-15:Final") == [(1, 3, "Intro"), (4, 10, None), (11, 15, "Final")]
    assert len(parse("1-10%3AMath%2C11-20%3AScience")) == 2
    for bad, words in (("invalid", "Invalid"), ("0-5", "positive"), ("10-5", ">= start")):
        with pytest.raises(ValueError, match=words):
            parse(bad)
    texts = ["1-3:Intro,4-10,11-15:Final", "1-10%3AMath%2C11-20%3AScience", "\u0967-\u0969", "x"]
    got = [[tuple(r) for r in x] for x in many(spark, texts, ranges.parse_ranges)]
    assert got == [[(1, 3, "Intro"), (4, 10, None), (11, 15, "Final")], [(1, 10, "Math"), (11, 20, "Science")], [(1, 3, None)], []]
    assert ranges.parse_single_range("2-4") == (2, 4) and ranges.parse_single_range("3") == (3, 3) and ranges.parse_single_range("x", False) is None


def test_slices_and_samples(spark):
    pages = spark.createDataFrame([("d", i, "x" * 600) for i in range(1, 6)] + [("e", 1, "abc")], "doc string, page_num int, raw string")
    cut = lambda a, b: sorted((r["doc"], r["page_num"]) for r in ranges.slice_pages(pages, a, b, ["doc"]).collect())
    assert cut(2, 3) == [("d", 2), ("d", 3), ("e", 1)]
    assert cut(9, 12) == [("d", 5), ("e", 1)]
    got = {r["doc"]: len(r["sample"]) for r in ranges.sample_text(pages, ["doc"]).collect()}
    assert got == {"d": 1200, "e": 3}


def test_configuration(spark):
    good = {"test": {"page_ranges": [{"start": 1, "end": 5, "name": "Part1"}, {"start": 6, "end": 10}]}}
    assert ranges.validate_config(good)
    bad = ["x", {"t": {"prefix": "x"}}, {"t": {"page_ranges": [{"start": 0, "end": 5}]}}, {"t": {"page_ranges": [{"start": 10, "end": 5}]}}]
    for b, words in zip(bad, ("dictionary", "page_ranges", "> 0", ">= 'start'")):
        with pytest.raises(ValueError, match=words):
            ranges.validate_config(b)
    with pytest.raises(ValueError):
        ranges.config_table(spark, "not json")
    text = '{"^ab.*$": {"page_ranges": [{"start": 1, "end": 2}]}, "abc": {"page_ranges": [{"start": 1, "end": 3, "name": "N"}, {"start": 2, "end": 9}], "prefix": "P", "unit_name": "U"}, "default": {"page_ranges": []}}'
    files = spark.createDataFrame([("abc", 5), ("abd", 5), ("zzz", 5)], "base string, total_pages int")
    resolved = ranges.resolve_config(files, ranges.config_table(spark, text))
    assert {r["base"]: r["key"] for r in resolved.collect()} == {"abc": "abc", "abd": "^ab.*$", "zzz": "default"}
    plan = {(r["base"], r["part"]): (r["out_name"], r["valid"]) for r in ranges.plan_splits(resolved).collect()}
    assert plan == {("abc", 1): ("P_U_N.pdf", True), ("abc", 2): ("P_U_Lecture2.pdf", False), ("abd", 1): ("abd_Lecture1.pdf", True)}


def test_fixes_in_place_and_by_digest_agree(spark):
    from aksharflow.operators import tokens

    a, b, c = "कमल", "नदी", "घर"
    rows = [(1, "x", f"{a} {b}, {a}!"), (2, "y", f"{a} {b}"), (3, "x", None), (4, None, a), (5, "x", ""), (6, "x", f"{a} {b}, {a}!"), (7, "x", "plain")]
    df = spark.createDataFrame(rows, "i int, k string, text string")
    fixes = spark.createDataFrame([("x", a, c, "exact"), ("x", b, None, None), ("y", b, a, "fuzzy"), (None, a, b, "exact")], "k string, token string, to string, reason string")
    plain = lambda df: sorted((r["i"], r["corrected"], r["stats"].asDict(recursive=True)) for r in df.collect())
    got = plain(tokens.apply_fixes(df, "text", fixes.where("k is not null"), ["k"], most=1))
    assert got == plain(tokens.apply_fixes(df, "text", fixes.where("k is not null"), ["k"], most=1, most_carried=2))
    assert got[0][1] == f"{c} {b}, {c}!" and got[0][2] == {"tokens_seen": 3, "tokens_considered": 3, "corrected_tokens": 2, "corrections": [{"from": a, "to": c, "reason": "exact"}], "rule_counts": {"exact": 2}} and got[1][1] == f"{a} {a}"
    assert "Exchange" not in tokens.apply_fixes(df, "text", fixes, ["k"])._jdf.queryExecution().executedPlan().toString()
