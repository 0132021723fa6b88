"""Chat formatting: conversations as prefix trees, shared turns once."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: A public byte-level vocabulary for tiktoken; the end of a turn is the id after its last one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Conversations that a row lists as ending with it.
MOST_ENDS = 1000
_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
    return _encodings[path]


def encode_turn(path: str, role: str | None, text: str | None) -> list[int]:
    """Role, line break, text, end of turn. A null is an empty string."""
    encoding, end = _encoding(path)
    return [*encoding.encode_ordinary(f"{role or ''}\n{text or ''}"), end]


def _packed(path: str) -> str:
    """The type of a token in transit: two bytes where the vocabulary fits."""
    return "<u2" if _encoding(path)[1] < 1 << 16 else "<u4"


def _tokenizer(path: str):
    def tokens(role: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([np.array(encode_turn(path, r, t), _packed(path)).tobytes() for r, t in zip(role.to_pylist(), text.to_pylist())], pa.binary())

    return F.arrow_udf(tokens, "binary")


def _counter(path: str):
    def count(role: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([len(encode_turn(path, r, t)) for r, t in zip(role.to_pylist(), text.to_pylist())], pa.int64())

    return F.arrow_udf(count, "bigint")


def _unpacker(path: str):
    def unpack(packed: pa.Array) -> pa.Array:
        kind = np.dtype(_packed(path))
        sizes = pa.compute.binary_length(packed).to_numpy(zero_copy_only=False) // kind.itemsize
        flat = np.frombuffer(b"".join(packed.to_pylist()), kind).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))

    return F.arrow_udf(unpack, "array<int>")


def _digest(role: Column, text: Column) -> Column:
    """16 bytes that tell (role, text) from any other pair: each is preceded by its length, a null by a sign."""
    part = lambda c: F.concat(F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.unhex(F.md5(F.concat(part(role), part(text)).cast("binary")))


def walks(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, depth, last, node, parent, tree, role, turn, n): each conversation's way through its tree, without texts.

    A node's id is a digest of its parent's and of its turn, ``turn`` that of role and text, ``n`` its tokens.
    """
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), role.alias("role"), _digest(role, text).alias("t"), _counter(vocabulary)(role, text).alias("n")).alias("turn")
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("turns"))

    def extend(path, t):  # noqa: ANN001, ANN202
        last = F.coalesce(F.get(path, F.size(path) - 1), F.lit(b""))
        return F.concat(path, F.array(F.unhex(F.md5(F.concat(last, t["t"])))))

    talks = talks.withColumn("path", F.aggregate("turns", F.array().cast("array<binary>"), extend))
    walked = talks.select("conv_id", "path", F.size("turns").alias("size"), F.posexplode("turns").alias("depth", "t"))
    return walked.select(
        "conv_id", "depth", (F.col("depth") == F.col("size") - 1).alias("last"), F.element_at("path", F.col("depth") + 1).alias("node"),
        F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1)).alias("parent"), F.get("path", F.lit(0)).alias("tree"), "t.role", F.col("t.t").alias("turn"), "t.n",
    )


def _along(walk: DataFrame, start: Column, step, *columns: str) -> DataFrame:
    """(node, state): what ``step`` makes of a state and ``columns`` from each conversation's beginning to each node, which is the same by any conversation."""
    rows = walk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node", *columns))).alias("w"))

    def extend(acc, x):  # noqa: ANN001, ANN202
        before = F.coalesce(F.get(acc, F.size(acc) - 1)["s"], start)
        return F.concat(acc, F.array(F.struct(x["node"].alias("node"), step(before, x).alias("s"))))

    first = F.struct(F.lit(b"").alias("node"), start.alias("s"))
    states = F.aggregate("w", F.slice(F.array(first), 1, 0), extend)
    return rows.select(F.explode(states).alias("x")).groupBy("x.node").agg(F.first("x.s").alias("state"))


def _layout(nodes: DataFrame) -> DataFrame:
    """(node, start): a running sum of tokens over (tree, key, depth), from each tree's beginning. Sorted by ranges, so that one large tree is laid out by many tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=["tree", "node", "n", "part", "local"])

    ordered = nodes.repartitionByRange("tree", "key", "depth").sortWithinPartitions("tree", "key", "depth")
    ordered = ordered.select("tree", "node", "n", F.spark_partition_id().alias("part"))
    laid = stage_table(ordered.mapInArrow(sums, "tree binary, node binary, n bigint, part int, local bigint"), "layout")
    before, offsets = 0, []
    for r in laid.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], before))
        before += r["n"]
    spark = nodes.sparkSession
    whole = laid.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset bigint")), "part").select("tree", "node", (F.col("local") + F.col("offset")).alias("at"))
    first = whole.groupBy("tree").agg(F.min("at").alias("first"))
    return whole.join(first, "tree").select("node", (F.col("at") - F.col("first")).alias("start"))


def prefix_trees(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each distinct turn in its context, which is all that the conversations' tokens are stored in.

    (tree, node, parent, part, depth, role, conversations, ends, start, position, token_ids, position_ids, attends):
    tokens of a tree are laid out depth-first, so that a node's are those from ``start`` on in its tree's sequence.
    ``position_ids`` count from the conversation's start, over the ancestors; ``attends`` are the intervals (start,
    end) of the ancestors' tokens in the sequence, outermost first and joined where they touch, to which the node's
    tokens attend besides themselves and those before them in the node. ``conversations`` have this prefix; those in
    ``ends`` end with it. A node where more than MOST_ENDS end has further rows, with a part from 1 on, that hold only
    the rest of ``ends``.

    Turns go by number, null numbers first, then by role and digest; repeated rows count once, rows that share a number
    follow each other. Null roles and texts are kept apart from empty ones but have the same tokens. Turns without a
    conv_id are left out. An empty table gives no rows. Other columns are not read. Texts are tokenised whole, at any
    length. A conversation's turns meet in one row, as digests.

    Only digests are shuffled and sorted to find the trees and to lay them out; of the texts, each distinct turn's
    tokens are shuffled once. ``vocabulary`` is a file that every worker must have at that path.
    """
    walk = stage_table(walks(turns, vocabulary), "walks")
    nodes = walk.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "tree", "depth", "role", "turn", "n")), F.count("*").alias("conversations"), F.count_if("last").alias("ending"))
    nodes = stage_table(nodes, "nodes")
    # only where a parent has several children does their order have to be told
    forks = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children")).where("children > 1").select("parent")
    forked = walk.join(forks.withColumn("fork", F.lit(True)), "parent", "left").withColumn("piece", F.when(F.col("fork"), F.substring("node", 1, 8)).otherwise(F.lit(b"")))
    keys = _along(forked, F.lit(b""), lambda s, x: F.concat(s, x["piece"]), "piece")
    starts = _layout(nodes.select("tree", "node", "depth", "n").join(keys.withColumnRenamed("state", "key"), "node"))
    starts = stage_table(starts, "starts")
    empty = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("own"))

    def attend(state, x):  # noqa: ANN001, ANN202
        spans, own = state["spans"], state["own"]
        last = F.get(spans, F.size(spans) - 1)
        touching = last["end"] == own["start"]
        grown = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), own["end"].alias("end"))))
        spans = F.when(own.isNull(), spans).when(touching, grown).otherwise(F.concat(spans, F.array(own)))
        return F.struct(spans.alias("spans"), F.when(own.isNull(), F.lit(0).cast("bigint")).otherwise(state["position"] + own["end"] - own["start"]).alias("position"), F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end")).alias("own"))

    seen = _along(walk.select("conv_id", "depth", "node", "n").join(starts, "node"), empty, attend, "n", "start")
    seen = seen.select("node", F.col("state.spans").alias("attends"), "state.position", F.col("state.own.start").alias("start"))
    ends = walk.where("last").select("conv_id", "node").join(nodes.where(F.col("ending") > MOST_ENDS).select("node", "ending"), "node", "left")
    part = F.coalesce(F.pmod(F.xxhash64("conv_id"), F.ceil(F.col("ending") / MOST_ENDS)).cast("int"), F.lit(0))
    ends = ends.groupBy("node", part.alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ends"))
    own = nodes.join(seen, "node").join(ends.where("part = 0").drop("part"), "node", "left")
    own = own.withColumn("ends", F.coalesce("ends", F.array().cast(own.schema["ends"].dataType)))
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    contents = turns.where("conv_id is not null").select(_digest(role, text).alias("turn"), _tokenizer(vocabulary)(role, text).alias("packed")).groupBy("turn").agg(F.first("packed").alias("packed"))
    rows = own.join(contents, "turn")
    full = rows.select(
        "tree", "node", "parent", F.lit(0).alias("part"), "depth", "role", "conversations", "ends", "start", "position", _unpacker(vocabulary)("packed").alias("token_ids"),
        F.sequence("position", F.col("position") + F.col("n") - 1).alias("position_ids"), "attends",
    )
    more = ends.where("part > 0").join(nodes.select("node", "tree", "parent", "depth", "role"), "node")
    full = full.unionByName(more, allowMissingColumns=True)
    return full.select(*(F.lower(F.hex(c)).alias(c) for c in ("tree", "node", "parent")), *full.columns[3:])
