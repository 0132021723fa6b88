"""Text sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".txt",)


def _listing(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path) of the files below ``root`` with one of the suffixes, or of ``root`` itself where it is a file of any suffix. Contents are not read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return spark.createDataFrame([(root,)], "path string")
    glob = "*{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*{extensions[0]}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")


def read_paths(paths: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(path, text, error) for each row of ``paths``: the whole file, undecodable bytes as U+FFFD, or why it can't be read with a null text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                text, error = None, None
                try:
                    if re.match("[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
                        system, at = pa.fs.FileSystem.from_uri(path)
                        with system.open_input_stream(at) as f:
                            content = f.read()
                    else:
                        with open(unquote(re.sub("^file:/*", "/", path)) if path.startswith("file:") else path, "rb") as f:
                            content = f.read()
                    text = content.decode(encoding, "replace")
                except OSError as e:
                    error = f"read_error: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "text", "error"])

    return paths.select("path").mapInArrow(read, "path string, text string, error string")


def read_text_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, text, error) of whole files below ``root``, or of the file ``root``; suffixes are case-sensitive."""
    return read_paths(_listing(spark, root, extensions))


def discover_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path), sorted."""
    return _listing(spark, root, extensions).orderBy("path")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): lines of plain or gzip files."""
    return spark.read.text(path).select(F.col("value").alias("text"))


def read_jsonl_field(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """(text): a string field of JSON lines; blank and malformed lines, and values that are no strings, are left out."""
    value = F.try_variant_get(F.try_parse_json("value"), f"$.{field}", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), f"$.{field}", "variant"))
    return spark.read.text(path).where(kind == "STRING").select(value.alias("text"))


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines, non-ASCII as it is; returns the number of rows, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def list_outputs(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(name, path, size_kb, modified), by name, from file metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.round(F.col("length") / 1024, 2).alias("size_kb"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified")).orderBy("name")


def write_page_dump(pages: DataFrame, path: str, by: list[str], text: str = "text", page: str = "page_num") -> None:
    """One text a document: each page under a line with its number."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.concat(F.format_string("===== PAGE %d =====\n", F.col(page)), F.coalesce(text, F.lit(""))).alias("t"))))
    pages.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("value")).select("value").write.text(path)
