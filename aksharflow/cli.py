"""Command line: extract, split, info, regress, correct-corpus. Exit code 1 on errors or when there is nothing to do."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__


def _session() -> SparkSession:
    return SparkSession.builder.appName("aksharflow").getOrCreate()


def _extraction(p: argparse.ArgumentParser, nargs: str | None = None) -> None:
    p.add_argument("path", nargs=nargs)
    p.add_argument("--font-type", default="auto", choices=["auto", "krutidev", "chanakya", "none"])
    p.add_argument("--lexicon-file")
    p.add_argument("--bootstrap-lexicon", action="store_true")
    p.add_argument("--overrides-file")
    p.add_argument("--json", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="aksharflow", description=__doc__)
    top.add_argument("--version", action="version", version=f"aksharflow {__version__}")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract")
    _extraction(p)
    p.add_argument("--page-range")
    p.add_argument("--no-post-process", action="store_true")
    p.add_argument("--second-stage", default="none", choices=["none", "lexicon"])
    p = sub.add_parser("split")
    p.add_argument("path")
    p.add_argument("--ranges", required=True)
    p.add_argument("--output-dir", default="output")
    p.add_argument("--prefix")
    sub.add_parser("info").add_argument("path")
    p = sub.add_parser("regress")
    _extraction(p, "+")
    p.add_argument("--second-stage", default="lexicon", choices=["none", "lexicon"])
    p.add_argument("--page-limit", type=int)
    p = sub.add_parser("correct-corpus")
    p.add_argument("path")
    p.add_argument("-o", "--output", default="aksharflow_corpus.jsonl")
    p.add_argument("--correction-mode", default="safe", choices=["none", "safe", "aggressive"])
    p.add_argument("--font-type", default="auto", choices=["auto", "krutidev", "chanakya", "none", "scrambled_devanagari"])
    p.add_argument("--extensions", nargs="+", default=[".txt"])
    p.add_argument("--workers", type=int, help="accepted; the cluster decides")
    p.add_argument("--use-symspell", action="store_true")
    p.add_argument("--symspell-dict")
    p.add_argument("--symspell-max-distance", type=int, default=2)
    p.add_argument("--json", action="store_true")
    return top


def _show(row: dict, as_json: bool) -> None:
    print(json.dumps(row, ensure_ascii=False, default=str) if as_json else "\n".join(f"{k}: {v}" for k, v in row.items()))


def _run(a: argparse.Namespace) -> int:
    spark = _session()
    if a.command == "correct-corpus":
        from .plans.batch import BatchConfig, correct_corpus

        config = BatchConfig(a.font_type, a.correction_mode, tuple(x for e in a.extensions for x in e.split(",")), a.use_symspell, a.symspell_dict, a.symspell_max_distance)
        summary = correct_corpus(spark, a.path, a.output, config)
        _show(summary, a.json)
        return 0 if summary["files"] else 1
    from .operators.lexicon import Lexicon
    from .operators.overrides import read_overrides
    from .operators.ranges import parse_ranges_string, parse_single_range
    from .sources.pdf import pdf_info, read_pages, require_pdf, write_splits

    require_pdf()
    files = spark.read.format("binaryFile").load(a.path)
    if a.command == "info":
        rows = [r.asDict(recursive=True) for r in pdf_info(files).collect()]
        for r in rows:
            _show(r, True)
        return 0 if rows and not any(r["error"] for r in rows) else 1
    if a.command == "split":
        ranges = parse_ranges_string(a.ranges)
        from .operators.ranges import RANGES, plan_splits

        table = spark.createDataFrame([(ranges, a.prefix, None)], f"page_ranges {RANGES}, prefix string, unit_name string")
        info = pdf_info(files).select("path", F.regexp_replace("filename", r"\.[^.]*$", "").alias("base"), "total_pages")
        made = write_splits(files, plan_splits(info.crossJoin(table)), a.output_dir).collect()
        for r in made:
            print(r["out_path"])
        return 0 if made else 1
    from .plans import extract, regression

    lexicon = Lexicon.of(spark, path=a.lexicon_file) if a.lexicon_file else None
    rules = read_overrides(spark, a.overrides_file) if a.overrides_file else None
    if a.command == "regress":
        pages = read_pages(files)
        report = regression.page_report(pages, font=a.font_type, second_stage=a.second_stage, lexicon=lexicon, bootstrap=a.bootstrap_lexicon, overrides=rules, page_limit=a.page_limit)
        lines = report.toJSON().collect() if a.json else regression.format_report(report)
        print("\n".join(lines))
        return 0 if len(lines) > (0 if a.json else 1) else 1
    pages = read_pages(files, parse_single_range(a.page_range) if a.page_range else None, with_sample=True)
    failed = pages.where("error is not null").select("path", "error").collect()
    done = extract.extract_pages(pages.where("error is null"), font=a.font_type, post=not a.no_post_process, overrides=rules, second_stage=a.second_stage, lexicon=lexicon, bootstrap=a.bootstrap_lexicon)
    docs = 0
    for r in extract.documents_of(done).toLocalIterator():
        docs += 1
        _show(r.asDict(recursive=True), True) if a.json else print(r["full_text"])
    for r in failed:
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    return 0 if docs and not failed else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args)
    except Exception as e:  # noqa: BLE001 - a command line reports and returns 1
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
