"""Cleaning of text files as they land: the batch expressions over a stream, and a corpus summary kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.clean import clean, summarise

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_landing(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of files that appear in ``root``."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(root)
    return stream.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def clean_stream(texts: DataFrame, font: str = "auto") -> DataFrame:
    """Conversion and repair need no state: mode "none" of the batch plan, on a stream."""
    return clean(texts, "text", font, "none")


def start(cleaned: DataFrame, output: str, checkpoint: str, summary: str | None = None) -> StreamingQuery:
    """Appends results as JSON; with ``summary``, each batch's own summary too. A batch that is repeated replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").json(f"{output}/batch={epoch}")
        if summary:
            summarise(batch).write.mode("overwrite").json(f"{summary}/batch={epoch}")
        batch.unpersist()

    return cleaned.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
