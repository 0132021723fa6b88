"""PDF pages as rows, PDF information, and PDF parts as files; these need the library pypdf."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import detect_encoding

PAGES = "path string, total_pages int, page_num int, raw string, error string, wanted boolean, sampled boolean"
#: Characters from which on no further page is read to judge the encoding.
SAMPLE_CHARS = 1000
INFO = "path string, filename string, total_pages int, size_kb double, metadata map<string,string>, sample string, error string"


class PdfNotInstalled(ImportError):
    """pypdf is not there."""


def require_pdf() -> None:
    if find_spec("pypdf") is None:
        raise PdfNotInstalled("reading and writing PDF needs pypdf")


def pypdf_opener(content: bytes):
    """(page texts as functions, metadata): the default way to open a PDF."""
    require_pdf()
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    return [page.extract_text for page in reader.pages], {str(k).lstrip("/"): str(v) for k, v in (reader.metadata or {}).items()}


Opener = Callable[[bytes], tuple[list[Callable[[], str]], dict[str, str]]]


def pdf_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """binaryFile rows of files whose suffix is pdf in any case."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF,Pdf}").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).where(F.lower("path").endswith(".pdf"))


def read_pages(files: DataFrame, page_range: tuple[int, int] | None = None, opener: Opener = pypdf_opener, with_sample: bool = False) -> DataFrame:
    """(path, total_pages, page_num, raw, error): a row a page; only pages of the (clamped) range are extracted.

    ``with_sample`` adds the pages before it from which the encoding is judged, and the columns wanted and sampled. A page that fails is empty. A file that can't be opened is one row with its error.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    texts, _ = opener(bytes(content))
                    total = len(texts)
                    first, stop = 0, total
                    if page_range:
                        first = max(0, min(page_range[0] - 1, total - 1))
                        stop = max(first + 1, min(page_range[1], total))
                    known = 0
                    for i in range(min(stop, total)):
                        if i < first and (known >= SAMPLE_CHARS or not with_sample):
                            continue
                        try:
                            raw = texts[i]() or ""
                        except Exception:  # noqa: BLE001 - one broken page leaves the others readable
                            raw = ""
                        out.append((path, total, i + 1, raw, None, i >= first, known < SAMPLE_CHARS and i < first + 3))
                        known += len(raw)
                except Exception as e:  # noqa: BLE001 - errors are rows
                    out.append((path, None, None, None, str(e), True, False))
            yield pd.DataFrame(out, columns=["path", "total_pages", "page_num", "raw", "error", "wanted", "sampled"]).astype({"total_pages": "Int32", "page_num": "Int32"})

    found = files.select("path", "content").mapInPandas(pages, PAGES)
    return found if with_sample else found.where("wanted").drop("wanted", "sampled")


def pdf_info(files: DataFrame, opener: Opener = pypdf_opener) -> DataFrame:
    """(path, filename, total_pages, size_kb, metadata, error, has_encoding_issues, detected_font_type)."""

    def info(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name, size = os.path.basename(path), round(len(content) / 1024, 2)
                try:
                    texts, metadata = opener(bytes(content))
                    sample = ""
                    for t in texts[:2]:
                        sample += t() or ""
                        if len(sample) >= 500:
                            break
                    out.append((path, name, len(texts), size, metadata, sample, None))
                except Exception as e:  # noqa: BLE001 - errors are rows
                    out.append((path, name, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "filename", "total_pages", "size_kb", "metadata", "sample", "error"]).astype({"total_pages": "Int32"})

    rows = files.select("path", "content").mapInPandas(info, INFO).withColumn("_e", detect_encoding(F.col("sample")))
    return rows.select("path", "filename", "total_pages", "size_kb", "metadata", "error", F.col("_e.has_issues").alias("has_encoding_issues"), F.nullif(F.col("_e.font"), F.lit("unknown")).alias("detected_font_type"))


def write_splits(files: DataFrame, plan: DataFrame, out_dir: str) -> DataFrame:
    """(path, out_path): writes each valid part of the plan, pages and metadata copied; ``out_dir`` must be a folder that all executors share."""
    require_pdf()
    parts = plan.where("valid").groupBy("path").agg(F.collect_list(F.struct("start", "end", "out_name")).alias("parts"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader, PdfWriter

        os.makedirs(out_dir, exist_ok=True)
        for pdf in batches:
            out = []
            for path, content, todo in zip(pdf["path"], pdf["content"], pdf["parts"]):
                reader = PdfReader(io.BytesIO(bytes(content)))
                for part in todo:
                    writer = PdfWriter()
                    for i in range(part["start"] - 1, part["end"]):
                        writer.add_page(reader.pages[i])
                    if reader.metadata:
                        writer.add_metadata(dict(reader.metadata))
                    to = os.path.join(out_dir, part["out_name"])
                    with open(to, "wb") as f:
                        writer.write(f)
                    out.append((path, to))
            yield pd.DataFrame(out, columns=["path", "out_path"])

    return files.select("path", "content").join(parts, "path").mapInPandas(write, "path string, out_path string")
