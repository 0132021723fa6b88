"""Bulk cleaning of text files."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.symspell import SymSpell
from ..sources.text import EXTENSIONS, read_text_files, write_jsonl
from .clean import clean, summarise


@dataclass
class BatchConfig:
    font_type: str = "auto"
    correction_mode: str = "safe"
    extensions: tuple[str, ...] = EXTENSIONS
    use_symspell: bool = False
    symspell_dict: str | None = None
    symspell_max_distance: int = 2

    def to_dict(self) -> dict:
        return asdict(self)


def run_batch(spark: SparkSession, root: str, config: BatchConfig | None = None) -> DataFrame:
    """A row a file with its cleaning result; the lexicon's context is each file's own text."""
    config = config or BatchConfig()
    files = read_text_files(spark, root, config.extensions).withColumnRenamed("path", "input_path")
    speller = SymSpell.default(spark, config.symspell_dict) if config.use_symspell else None
    if speller is not None:
        speller.max_distance = config.symspell_max_distance
    return clean(files, "text", config.font_type, config.correction_mode, symspell=speller).drop("text")


def correct_corpus(spark: SparkSession, root: str, output: str, config: BatchConfig | None = None) -> dict:
    """Writes the results as JSON lines and summarises what was written."""
    results = run_batch(spark, root, config)
    rows = write_jsonl(results, output)
    written = spark.read.schema(results.schema).json(output)
    return summarise(written).first().asDict(recursive=True) | {"rows": rows}
