"""Registered queries over whole tables, and their SQL.

The tables hold no Devanagari; converting their text as if it were a legacy font makes plenty of it, with every kind of
artefact, so that each operator downstream has real work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, glyphs, repair
from ..functions import patterns as P
from ..operators import candidates, frequency, lexicon, overrides, ranges, symspell, tokens
from ..operators.quality import measure_quality
from . import clean, extract, regression
from . import oracles as O  # noqa: E741, N812


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table; one of fewer files than cores, whose few row groups would leave cores idle, is spread over them."""
    df = _read(spark, sf_dir, table).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "documents", "doc_id", "text", "lang")


def _deva(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", glyphs.convert(F.col("text"), "krutidev").alias("text"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, n): the distinct words of documents, converted, and how often each occurs.

    No glyph holds a blank or a line break, nor does a token: words between them give the tokens that their texts give.
    """
    words = _docs(spark, sf_dir).select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.select(glyphs.convert(F.col("w"), "krutidev").alias("text"), "n")


def _deva_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", glyphs.convert(F.col("text"), "krutidev").alias("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("path"), (F.col("turn") + 1).cast("int").alias("page_num"), F.col("text").alias("raw"))


def detect_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("lang", detect.detect_encoding(F.col("text"))["font"].alias("font")).groupBy("lang", "font").agg(F.count("*").alias("docs"))


def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", detect.detect_encoding(F.col("text")).alias("e")).select("doc_id", "e.*")


def latin_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", detect.latin_chunk(F.col("text")).alias("latin"))


def garbage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = detect.garbage(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", g.alias("g")).select("doc_id", "g.is_garbage", F.round("g.score", 6).alias("score"))


def convert_krutidev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deva(spark, sf_dir)


def convert_chanakya(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", glyphs.convert(F.col("text"), "chanakya").alias("text"))


def convert_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", glyphs.convert(F.col("text"), "auto").alias("text"))


def post_process_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deva(spark, sf_dir).select("doc_id", repair.post_process(F.col("text"), True).alias("text"))


def post_process_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deva(spark, sf_dir).select("doc_id", repair.post_process(F.col("text"), False).alias("text"))


def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deva(spark, sf_dir).select("doc_id", detect.count_artifacts(F.col("text")).alias("a")).select("doc_id", "a.*")


def scrambled_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deva(spark, sf_dir).select("doc_id", detect.detect_scrambled(F.col("text")).alias("scrambled"))


def frequency_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.token_frequencies(_words(spark, sf_dir), "text", times="n")


def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.char_ngrams(_words(spark, sf_dir), "text", 3, "n")


def char_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = frequency.train_char_lm(frequency.char_ngrams(_words(spark, sf_dir), "text", 3, "n"))
    return frequency.score_tokens(_tokens(spark, sf_dir), model).select("token", F.round("log_prob", 6).alias("log_prob"))


def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon.Lexicon.of(spark).general().withColumnRenamed("word", "token")
    return frequency.counted_tokens(_words(spark, sf_dir), "text", "n").join(words, "token", "left_semi")


def lexicon_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon.Lexicon.of(spark).general().withColumnRenamed("word", "token")
    return frequency.counted_tokens(_words(spark, sf_dir), "text", "n").join(words, "token", "left_anti")


def contextual_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.contextual_lexicon(_deva_talk(spark, sf_dir), "text", lexicon.Lexicon.of(spark), ["conv_id"])


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.distinct_tokens(_words(spark, sf_dir), "text")


def normalized_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.resolve_exact(_tokens(spark, sf_dir), lexicon.Lexicon.of(spark)).select("token", "norm", "exact")


def safe_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.resolve(_tokens(spark, sf_dir), lexicon.Lexicon.of(spark), 0)


def aggressive_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.resolve(_tokens(spark, sf_dir), lexicon.Lexicon.of(spark), 2)


def safe_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.correct(_deva(spark, sf_dir), "text", lexicon.Lexicon.of(spark), 0)
    return out.select("doc_id", "corrected", "stats.tokens_seen", "stats.tokens_considered", "stats.corrected_tokens")


def candidates_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = tokens.distinct_tokens(_deva_talk(spark, sf_dir), "text")
    scoring = candidates.Scoring(lexicon.Lexicon.of(spark), symspell.read_dictionary(spark))
    best = candidates.select_best(candidates.score(candidates.generate(talk), scoring))
    return best.select("token", "text", F.round("confidence", 6).alias("confidence"), "reason", F.round("score", 6).alias("score"))


def symspell_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symspell.SymSpell.default(spark).suggest(tokens.distinct_tokens(_deva_talk(spark, sf_dir), "text"))


_QUALITY = ("token_count", "visible_char_count", "latin_char_count", "other_char_count", "artifact_total", "is_garbage", "lexicon_hit_rate", "devanagari_ratio", "quality_index")


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _deva(spark, sf_dir).select("doc_id", measure_quality(F.col("text")).alias("m"))
    return m.select("doc_id", *(f"m.{c}" for c in _QUALITY))


def quality_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _docs(spark, sf_dir).select("doc_id", measure_quality(F.col("text")).alias("m"))
    joined = m.join(_read(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.sum("m.latin_char_count").alias("latin_chars"), F.count_if("m.is_garbage").alias("garbage"))


def clean_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = clean.clean(_docs(spark, sf_dir), font="auto", mode="none")
    return r.select("doc_id", "detected_font_type", "has_encoding_issues", "artifact_count_before", "artifact_count_after", "artifacts_removed", F.array_join("stages_applied", ",").alias("stages"), "cleaned_text")


def clean_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = clean.clean(_docs(spark, sf_dir), font="auto", mode="safe", bootstrap=True, by=["doc_id"])
    return r.select("doc_id", "detected_font_type", "artifacts_removed", "correction_stats.tokens_seen", "correction_stats.corrected_tokens", "cleaned_text")


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean.summarise(clean.clean(_docs(spark, sf_dir), font="auto", mode="none"))
    return s.select("files", "errors", "artifacts_removed", F.explode("font_types").alias("font", "n"))


def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.rollup_report(regression.page_report(_pages(spark, sf_dir)))


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract.documents_of(extract.extract_pages(_pages(spark, sf_dir)))
    return done.select("path", "processed_pages", "has_encoding_issues", "detected_font_type", "artifact_count", "full_text")


def compare_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace("html", "<[^>]*>", " ")).alias("raw"))
    c = extract.compare(p)
    return c.groupBy("comparison.view.display_mode", "comparison.view.tone", "detected_font_type").agg(F.count("*").alias("pages"), F.count_if("comparison.conversion_applied").alias("converted"))


_RULES = '{"global": {"replacements": [["the", "THE"], ["on", "0n"]]}, "pages": {"1": {"replacements": [["a", "@"]]}, "2": {"replacements": [["THE", "then"]]}}}'


def overrides_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).withColumnRenamed("raw", "text")
    return overrides.apply_overrides(p, overrides.parse_overrides(spark, _RULES)).select("path", "page_num", "text", "overrides_applied")


def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.slice_pages(_pages(spark, sf_dir), 2, 4, ["path"]).select("path", "page_num")


def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.sample_text(_pages(spark, sf_dir), ["path"])


def range_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("-"), (F.col("doc_id") % 9 + 4).cast("string"), F.lit(":"), F.col("lang"), F.lit("%2C20-30"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(ranges.parse_ranges(made)).alias("i", "r")).select("doc_id", "i", "r.*")


_CONFIG = '{"src1": {"page_ranges": [{"start": 1, "end": 2, "name": "A"}], "prefix": "P"}, "^src1\\\\d$": {"page_ranges": [{"start": 1, "end": 3}, {"start": 4, "end": 9}]}, "default": {"page_ranges": [{"start": 2, "end": 5}], "unit_name": "U"}}'


def config_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _read(spark, sf_dir, "documents").select(F.col("source").alias("base")).distinct().withColumn("total_pages", F.lit(5))
    return ranges.plan_splits(ranges.resolve_config(sources, ranges.config_table(spark, _CONFIG))).drop("total_pages")


QUERIES = {
    f.__name__: f
    for f in (
        detect_by_lang, detect_encoding, latin_chunk, garbage_gate, convert_krutidev, convert_chanakya, convert_auto, post_process_legacy, post_process_unicode, artifact_counts, scrambled_flag,
        frequency_lexicon, char_ngrams, char_lm_scores, lexicon_hits, lexicon_misses, contextual_lexicon, normalized_lookup, safe_fixes, aggressive_fixes, safe_correction, candidates_best, symspell_suggest,
        quality_metrics, quality_by_label, clean_none, clean_safe, batch_summary, regression_report, extract_documents, compare_pages, overrides_apply, page_slice, page_samples, range_strings, config_splits,
    )
}


def _oracles() -> dict[str, str]:
    has, font = O.encoding("text")
    kd, ch = O.conversion("text", "krutidev"), O.conversion("text", "chanakya")
    deva = f"with d as materialized (select doc_id, {kd} as t from documents)"
    talk = f"d as materialized (select conv_id, turn, {kd} as t from conversations)"
    tokens_ = f"tok as materialized (select unnest({O.token_list('t')}) as token from d)"
    words = O.words_table(lexicon.default_words())
    art = O.artifacts("t")
    art_total = " + ".join(art.values())
    share = O.count("t", f"[{P.DEVA}]")
    english = ", ".join(O.q(w) for w in detect.ENGLISH)
    bare = "regexp_replace(text, '\\s', '', 'g')"
    marks = " or ".join(f"contains(token, {O.q(m + m)})" for m in O.members(P.DOUBLED))
    auto = f"(case {font} when 'chanakya' then {ch} else {kd} end)"
    legacy, plain = O.chain(True), O.chain(False)
    found = "case when font = 'unknown' then text else (case font when 'chanakya' then " + ch + " else " + kd + " end) end"
    cleaned = f"""with e as (select doc_id, text, {font} as font, {has} as issues from documents),
c as materialized (select doc_id, text, font, issues, {found} as t from e),
u as (select * from c where font = 'unknown'), l as (select * from c where font <> 'unknown'),
{O.staged("u", plain, "doc_id, text, font, issues", "us")},
{O.staged("l", legacy, "doc_id, text, font, issues", "ls")},
a as (select * from us union all select * from ls),
r as materialized (select doc_id, font, issues, t, {" + ".join(O.artifacts("text").values())} as before, {art_total} as after from a)"""
    grams = "n as (select unnest([1, 2, 3]) as n), g as (select n, unnest(list_transform(range(1, length(token) - n + 2), lambda i: array_to_string(string_split(token, '')[i:i + n - 1], ''))) as gram from tok, n where length(token) >= n), k as (select n::int as n, gram, count(*) as cnt from g group by all)"
    punctuation = detect.PUNCTUATION.replace(chr(92) + "u2000-" + chr(92) + "u206f", chr(0x2000) + "-" + chr(0x206F))
    latin = f"""coalesce({O.count('text', '[A-Za-z]')} >= greatest(24, 4 * {O.count('text', f'[{P.TOKEN}]')})
 and len(list_filter(regexp_extract_all(text, '[A-Za-z]{{2,}}'), lambda w: lower(w) in ({english}))) >= 3, false)"""
    return {
        "char_lm_scores": f"""{deva}, {tokens_}, {grams}, m as (select n, gram, ln(cnt / sum(cnt) over (partition by n, substr(gram, 1, n - 1))) as logp from k),
v as (select distinct token from tok), w as (select token, unnest(range(1, length(token) + 1)) as i from v),
a as (select token, i, n, substr(token, i - n + 1, n) as gram from w, n where i >= n),
b as (select token, i, max_by(logp + ln(0.4) * (least(i, 3) - a.n), a.n) as lp from a join m on a.n = m.n and a.gram = m.gram group by token, i)
select token, round(sum(coalesce(lp, -12.0)) / count(*), 6)::double as log_prob from w left join b using (token, i) group by token""",
        "quality_metrics": f"""{deva}, b as (select doc_id, t, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) as n, regexp_replace(t, '\\s', '', 'g') as bare, regexp_extract_all(t, '[{P.TOKEN}]{{3,}}') as tok from d),
s as (select doc_id, n, len(tok) as tokens, len(list_filter(tok, lambda w: w in ({", ".join(O.q(w) for w in sorted(lexicon.default_words()))}))) as hits, length(bare) as visible,
 {O.count('t', f'[{P.DEVA}]')} as deva, {O.count('t', '[A-Za-z]')} as latin, {O.noise('t')} as noise,
 {O.count('bare', punctuation)} as p, {O.count('bare', '[A-Za-z' + chr(0x900) + '-' + chr(0xd7f) + ']')} as l, {O.count('bare', '[0-9]')} as g from b),
r as (select *, p / nullif(visible, 0)::double as ps, l / nullif(visible, 0)::double as ls, (visible - p - l - g) / nullif(visible, 0)::double as gs from s),
x as (select *, (n < 50 or ps > 0.5 or ls < 0.4 or gs > 0.3) as bad, round(deva / greatest(visible, 1)::double, 4) as share, round(hits / greatest(tokens, 1)::double, 4) as rate,
 case when n < 50 then 0.0 when ps > 0.5 then 1.0 - ps when ls < 0.4 then ls when gs > 0.3 then 1.0 - gs else 0.7::double * ls + 0.2::double * (1.0 - gs) + 0.1::double * (1.0 - ps) end::double as score from r)
select doc_id, tokens::int as token_count, visible::int as visible_char_count, latin::int as latin_char_count, (visible - deva - latin)::int as other_char_count, noise::int as artifact_total, bad as is_garbage,
 rate as lexicon_hit_rate, share as devanagari_ratio, round(greatest(0.0, least(1.0, score * 0.45::double + share * 0.2::double + rate * 0.25::double + (1.0 - least(noise / greatest(tokens, 1)::double, 1.0)) * 0.1::double))::double, 4) as quality_index from x""",
        "extract_documents": f"""with b as (select conv_id, turn, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations where turn < 3),
j as (select conv_id, string_agg(text, '' order by turn) as text from b where before < 1000 group by conv_id), e as (select conv_id, {font} as font, {has} as issues from j),
c as materialized (select conv_id, turn, font, issues, {found} as t from conversations left join e using (conv_id)),
u as (select * from c where font = 'unknown'), l as (select * from c where font <> 'unknown'),
{O.staged("u", plain, "conv_id, turn, font, issues", "us")},
{O.staged("l", legacy, "conv_id, turn, font, issues", "ls")},
a as (select * from us union all select * from ls)
select conv_id as path, count(*) as processed_pages, bool_or(issues) as has_encoding_issues, max(font) as detected_font_type, sum({art_total})::bigint as artifact_count, string_agg(t, chr(10) || chr(10) order by turn) as full_text from a group by conv_id""",
        "compare_pages": f"""with h as (select page_id, trim(regexp_replace(html, '<[^>]*>', ' ', 'g')) as text from pages),
e as (select page_id, text, {font} as font, {has} as has, {latin} as english from h),
c as materialized (select page_id, text, font, has, (english and font = 'unknown') as latin, {found} as t from e),
u as (select * from c where font = 'unknown'), l as (select * from c where font <> 'unknown'),
{O.staged("u", plain, "page_id, text, font, has, latin", "us")},
{O.staged("l", legacy, "page_id, text, font, has, latin", "ls")},
a as (select font, latin, has and not latin as issues, not latin and t <> text as applied from (select * from us union all select * from ls))
select case when latin then 'raw_only' else 'comparison' end as display_mode,
 case when latin then 'secondary' when issues and applied and font <> 'unknown' then 'success' when applied or issues then 'info' else 'secondary' end as tone,
 font as detected_font_type, count(*) as pages, count_if(applied)::bigint as converted from a group by all""",
        "detect_by_lang": f"select lang, {font} as font, count(*) as docs from documents group by all",
        "detect_encoding": f"select doc_id, {has} as has_issues, {font} as font from documents",
        "latin_chunk": f"""select doc_id, coalesce({O.count('text', '[A-Za-z]')} >= greatest(24, 4 * {O.count('text', f'[{P.TOKEN}]')})
 and len(list_filter(regexp_extract_all(text, '[A-Za-z]{{2,}}'), lambda w: lower(w) in ({english}))) >= 3, false) as latin from documents""",
        "garbage_gate": f"""with b as (select doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as n, {bare} as t from documents),
s as (select doc_id, n, length(t)::double as total, {O.count('t', detect.PUNCTUATION.replace(chr(92) + 'u2000-' + chr(92) + 'u206f', chr(0x2000) + '-' + chr(0x206f)))} as p, {O.count('t', '[A-Za-z' + chr(0x900) + '-' + chr(0xd7f) + ']')} as l, {O.count('t', '[0-9]')} as g from b),
r as (select doc_id, n, p / total as p, l / total as l, (total - p - l - g) / total as g from s)
select doc_id, (n < 50 or p > 0.5 or l < 0.4 or g > 0.3) as is_garbage,
round(case when n < 50 then 0.0 when p > 0.5 then 1.0 - p when l < 0.4 then l when g > 0.3 then 1.0 - g else 0.7::double * l + 0.2::double * (1.0 - g) + 0.1::double * (1.0 - p) end::double, 6) as score from r""",
        "convert_krutidev": f"select doc_id, {kd} as text from documents",
        "convert_chanakya": f"select doc_id, {ch} as text from documents",
        "convert_auto": f"select doc_id, {auto} as text from documents",
        "post_process_legacy": f"{deva},\n{O.staged('d', legacy, 'doc_id')}\nselect doc_id, t as text from s",
        "post_process_unicode": f"{deva},\n{O.staged('d', plain, 'doc_id')}\nselect doc_id, t as text from s",
        "artifact_counts": f"{deva} select doc_id, {', '.join(f'{e} as {n}' for n, e in art.items())}, {art_total} as total from d",
        "scrambled_flag": f"{deva} select doc_id, coalesce({share} >= 50 and {share} / length(t)::double >= 0.3 and ({art_total}) / {share}::double > 0.01, false) as scrambled from d",
        "frequency_lexicon": f"{deva}, {tokens_} select token as term, count(*) as cnt from tok where length(token) >= 2 group by token having count(*) >= 5",
        "char_ngrams": f"{deva}, {tokens_}, n as (select unnest([1, 2, 3]) as n), g as (select n, unnest(list_transform(range(1, length(token) - n + 2), lambda i: array_to_string(string_split(token, '')[i:i + n - 1], ''))) as gram from tok, n where length(token) >= n) select n::int as n, gram, count(*) as cnt from g group by all",
        "lexicon_hits": f"{deva}, {tokens_} select token, count(*) as n from tok where token in (select word from {words}) group by token",
        "lexicon_misses": f"{deva}, {tokens_} select token, count(*) as n from tok where token not in (select word from {words}) group by token",
        "contextual_lexicon": f"with {talk}, tok as (select conv_id, unnest({O.token_list('t')}) as token from d) select conv_id, token as word from tok where length(token) >= 4 and not regexp_matches(token, {O.q(P.SPURIOUS_NUKTA)}) and not ({marks}) and token not in (select word from {words}) group by all having count(*) >= 2",
        "quality_by_label": f"""with b as (select doc_id, text, {bare} as t from documents),
s as (select doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as n, {O.count('t', '[A-Za-z]')} as latin, length(t)::double as total, {O.count('t', detect.PUNCTUATION.replace(chr(92) + 'u2000-' + chr(92) + 'u206f', chr(0x2000) + '-' + chr(0x206f)))} as p, {O.count('t', '[A-Za-z' + chr(0x900) + '-' + chr(0xd7f) + ']')} as l, {O.count('t', '[0-9]')} as g from b)
select quality, toxic, count(*) as docs, sum(latin)::bigint as latin_chars, count_if(n < 50 or p / total > 0.5 or l / total < 0.4 or (total - p - l - g) / total > 0.3)::bigint as garbage from s join labels using (doc_id) group by all""",
        "clean_none": f"{cleaned} select doc_id, font as detected_font_type, issues as has_encoding_issues, before as artifact_count_before, after as artifact_count_after, before - after as artifacts_removed, case when font = 'unknown' then 'post_process' else 'convert:' || font || ',post_process' end as stages, t as cleaned_text from r",
        "batch_summary": f"{cleaned}, f as (select font, count(*) as n, sum(before - after) as removed from r group by font) select (select sum(n) from f)::bigint as files, 0::bigint as errors, (select sum(removed) from f)::bigint as artifacts_removed, font, n from f",
        "overrides_apply": """with g as (select conv_id as path, (turn + 1)::int as page_num, text as t0, replace(text, 'the', 'THE') as t1 from conversations),
h as (select *, replace(t1, 'on', '0n') as t2 from g),
p as (select *, case page_num when 1 then replace(t2, 'a', '@') when 2 then replace(t2, 'THE', 'then') else t2 end as t3 from h)
select path, page_num, t3 as text, ((length(t0) - length(replace(t0, 'the', ''))) // 3 + (length(t1) - length(replace(t1, 'on', ''))) // 2
 + case page_num when 1 then length(t2) - length(replace(t2, 'a', '')) when 2 then (length(t2) - length(replace(t2, 'THE', ''))) // 3 else 0 end)::int as overrides_applied from p""",
        "page_slice": "with n as (select conv_id, max(turn) + 1 as total from conversations group by conv_id), r as (select conv_id, greatest(0, least(1, total - 1)) as first, total from n) select conv_id as path, (turn + 1)::int as page_num from conversations join r using (conv_id) where turn + 1 > first and turn + 1 <= greatest(first + 1, least(4, total))",
        "page_samples": "with b as (select conv_id, turn, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations where turn < 3) select conv_id as path, string_agg(text, '' order by turn) as sample from b where before < 1000 group by conv_id",
        "range_strings": "select doc_id, 0 as i, (doc_id % 9 + 1)::int as start, (doc_id % 9 + 4)::int as \"end\", lang as name from documents union all select doc_id, 1, 20, 30, null from documents",
        "config_splits": """with s as (select distinct source as base from documents), k as (select base, case when base = 'src1' then 'src1' when regexp_full_match(base, 'src1\\d') then '^src1\\d$' else 'default' end as key from s)
select base, key, 1 as part, case key when 'default' then 2 else 1 end as start, case key when 'src1' then 2 when 'default' then 5 else 3 end as "end", case key when 'src1' then 'P_src1_A.pdf' when 'default' then 'U_Lecture1.pdf' else base || '_Lecture1.pdf' end as out_name, true as valid from k
union all select base, key, 2, 4, 9, base || '_Lecture2.pdf', false from k where key not in ('src1', 'default')""",
    }


ORACLE_SQL = _oracles()
