"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the membership bitmap: 2**27 bits are 16 MB, whatever the number of keys.
BITMAP_BITS = 1 << 27
_BUCKET_BITS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a new local one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        at = sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="aksharflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Links:
    """Links between ids, gathered by one task to a row an id, so that a group's links don't leave it pair by pair.

    ``add`` and ``end`` give (id, first, links, nearest) arrays now and then: how many links an id has, the nearest of
    them, and the smallest id to which they lead. Sums and minima over all rows of an id, and (id, first) as edges, say
    what the links themselves would.
    """

    def __init__(self, most: int = 1 << 21) -> None:
        self.most, self.size, self.parts = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        self.parts.append((a, b, far))
        self.size += len(a)
        return self.end() if self.size >= self.most else []

    def end(self) -> list[tuple[np.ndarray, ...]]:
        if not self.size:
            return []
        a, b, far = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = back[: len(a)], back[len(a) :]
        nearest = np.full(len(ids), np.inf)
        np.minimum.at(nearest, back, np.concatenate([far, far]))
        root = np.arange(len(ids))
        while True:
            low, least = root.copy(), np.minimum(root[i], root[j])
            np.minimum.at(low, root[i], least)
            np.minimum.at(low, root[j], least)
            while not np.array_equal(low, low[low]):
                low = low[low]
            if np.array_equal(low, root):
                return [(ids, ids[root], np.bincount(back), nearest)]
            root = low


def components(edges: DataFrame) -> DataFrame:
    """(id, first) for each id of the edges (a, b) but the first ones: the smallest id of its connected component.

    Alternates large-star and small-star steps, which halve the longest path, each written to the shared folder, until
    the edges stay the same.
    """
    edges = stage_table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", "m").where("v <> m").distinct()
        low = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        low = stage_table(low, "large-star")
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).where("v <> m")
        edges = stage_table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("first")).groupBy("id").agg(F.min("first").alias("first"))
        before = now


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Maximal runs without white space; 0 for null. This is the unit in which documents are budgeted and packed."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")), F.lit(0))


def membership(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the bigint column ``key`` as (bucket, bits): never more than 4,096 rows of 4 KB.

    A set bit means that the key may be present; a clear one that it is absent.
    """
    slot = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / _BUCKET_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % _BUCKET_BITS).alias("bits"))
    )


def maybe_member(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows of ``df`` that may be in ``bitmap``, with the boolean column ``maybe_member`` added.

    The bitmap's size is bounded by BITMAP_BITS, so that it is broadcast at any corpus size.
    """
    slot = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    at = slot % _BUCKET_BITS
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(pmod({key}, {BITMAP_BITS}) % {_BUCKET_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, (at % 8).cast("int")) == 1
    joined = df.join(F.broadcast(bitmap), F.floor(slot / _BUCKET_BITS) == F.col("bucket"), "left")
    return joined.withColumn("maybe_member", F.coalesce(bit, F.lit(False))).drop("bucket", "bits")
