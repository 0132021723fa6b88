"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_member, membership, text_of

PREFIX_CHARS = 64


def _survivors(docs: DataFrame) -> DataFrame:
    """One row (row, n, maybe_member) a document; only where maybe_member holds need the full text be hashed.

    Two scans compute first lengths alone, then prefix hashes alone of the documents whose length recurs. What they
    leave is a bitmap of bounded size, so that no text is shuffled to find the third level's documents.
    """
    base = docs.select(F.struct("*").alias("row"), docs["text"].cast("string").alias("t")).withColumn("n", F.octet_length("t").cast("long"))
    lengths = base.where("n is not null").groupBy("n").count().where("count > 1")
    by_length = membership(lengths, "n")
    prefix = F.xxhash64("n", F.substring("t", 1, PREFIX_CHARS))
    level2 = maybe_member(base.where("n is not null").select("n", "t"), "n", by_length).where("maybe_member").select(prefix.alias("p"))
    by_prefix = membership(level2.groupBy("p").count().where("count > 1"), "p")
    return maybe_member(base.withColumn("p", F.when(F.col("n").isNotNull(), prefix)), "p", by_prefix).select("row", "t", "n", "maybe_member")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of, copies): each document whose text another document has too, with the one that is kept.

    The smallest doc_id of a group is kept (null only where the group has no other) and is not listed. ``copies``
    counts the group's rows; rows that repeat one doc_id count there and are listed once. Null texts equal nothing;
    empty texts equal each other. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    found = _survivors(docs).where("maybe_member").select(F.col("row.doc_id").alias("doc_id"), "n", F.unhex(F.sha2("t", 256)).alias("h"))
    ids = found.groupBy("n", "h", "doc_id").agg(F.count("*").alias("rows"))
    groups = ids.groupBy("n", "h").agg(F.min("doc_id").alias("duplicate_of"), F.sum("rows").alias("copies")).where("copies > 1")
    return ids.join(groups, ["n", "h"]).where(~F.col("doc_id").eqNullSafe(F.col("duplicate_of"))).select("doc_id", "duplicate_of", "copies")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: that of the smallest doc_id. Null texts all stay. Columns are unchanged.

    Documents without a twin by length and prefix pass straight through; the rest meet in an aggregation that
    combines before the shuffle, so that a text with millions of copies is not gathered in one task.
    """
    marked = _survivors(docs)
    order = F.struct(F.col("row.doc_id").isNull().alias("a"), F.col("row.doc_id").alias("b"), F.xxhash64("row").alias("c"))
    kept = marked.where("maybe_member").groupBy("n", F.sha2("t", 256).alias("h")).agg(F.min_by("row", order).alias("row"))
    return marked.where("not maybe_member").select("row.*").unionByName(kept.select("row.*"))


ORACLE_SQL = """
with g as (select text, min(doc_id) as duplicate_of, count(*) as copies from documents where text is not null group by text having count(*) > 1)
select distinct d.doc_id, g.duplicate_of, g.copies from documents d join g on d.text = g.text where d.doc_id is distinct from g.duplicate_of
"""
