"""Near duplicates among embeddings through a robust-pruned graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Links, components, stage_table

THRESHOLD = 0.95
#: Vectors a cluster, whatever their number: clusters grow in number, so that the work a vector stays the same.
CLUSTER = 1000
#: Each vector is stored in its OVERLAP nearest clusters, and looked for in its PROBES nearest at first.
OVERLAP, PROBES = 2, 3
#: Centres are kept in groups of about the root of their number, of which a vector looks into so many.
GROUPS = 8
#: Centres that the driver and each worker hold; beyond CLUSTER times as many vectors clusters grow instead.
MOST_CENTRES = 1 << 16
NEAR, FAR, ALPHA, BEAM, ENTRY = 16, 4, 1.2, 16, 4
#: Vectors on which recall is measured against all others, and what it has to reach.
AUDITED, LEAST_RECALL = 1024, 0.9
LINKS = "id bigint, first bigint, links bigint, nearest double"


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """(rows x width) of an array of float lists, zeros after a shorter list's end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width), np.float32)
    offs = np.asarray(column.offsets)
    size = np.diff(offs)
    flat = np.asarray(column.values)[offs[0] : offs[-1]]
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)] = flat
    return out


def _hash(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def vectors(table: DataFrame) -> DataFrame:
    """(id, v) of each row with an id: the unit vector, null where it is null, empty, zero or not finite."""
    v = F.col("embedding").cast("array<float>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.transform("v", lambda x: (x / F.col("norm")).cast("float")))
    return table.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v")).withColumn("norm", norm).select("id", unit.alias("v"))


class Centres:
    """Unit centres in two levels: groups by k-means on the centres themselves, each a run of rows."""

    def __init__(self, c: np.ndarray) -> None:
        k = max(1, round(math.sqrt(len(c))))
        top = c[np.linspace(0, len(c) - 1, k).astype(int)]
        for _ in range(3):
            at = (c @ top.T).argmax(axis=1)
            total = np.zeros_like(top)
            np.add.at(total, at, c)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            top = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), top)
        at = (c @ top.T).argmax(axis=1)
        order = np.argsort(at, kind="stable")
        self.centres, self.top = c[order], top
        self.bounds = np.searchsorted(at[order], np.arange(k + 1))

    def nearest(self, x: np.ndarray, most: int, threshold: float = 2.0) -> list[np.ndarray]:
        """For each vector its ``most`` nearest centres, best first, and after them any others within ``threshold``."""
        out = []
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            far = part @ self.top.T
            rank = np.argsort(np.argsort(-far, axis=1, kind="stable"), axis=1, kind="stable")
            sims = np.full((len(part), len(self.centres)), -2, np.float32)
            for g in range(len(self.top)):
                a, b = self.bounds[g], self.bounds[g + 1]
                rows = np.flatnonzero((rank[:, g] < GROUPS) | (far[:, g] >= threshold))
                if b > a and len(rows):
                    sims[rows, a:b] = part[rows] @ self.centres[a:b].T
            m = min(most, sims.shape[1])
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
            dense = (sims >= threshold).any(axis=1)
            for i in range(len(part)):
                own = top[i]
                out.append(np.concatenate([own, np.setdiff1d(np.flatnonzero(sims[i] >= threshold), own)]) if dense[i] else own)
        return out


def centres(groups: DataFrame, n: int, width: int, cluster: int = CLUSTER) -> Centres:
    """One centre for ``cluster`` vectors: a hash sample, so that they are as dense as the vectors are, moved by two rounds of k-means over all of them."""
    k = min(MOST_CENTRES, max(1, math.ceil(n / cluster)))
    rows = groups.orderBy(F.xxhash64("id"), "id", "v").limit(k).select("v").toArrow()
    found = Centres(_matrix(rows.column(0), width))
    for _ in range(2):

        def sums(batches: Iterator[pa.RecordBatch], now: Centres = found) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.centres.shape), np.zeros(len(now.centres), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), width)
                if len(x):
                    at = np.array([a[0] for a in now.nearest(x, 1)])
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(count))
            have = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have].tolist(), pa.list_(pa.float64()))], names=["c", "s"])

        total = np.zeros(found.centres.shape)
        for r in groups.select("v").mapInArrow(sums, "c bigint, s array<double>").toLocalIterator():
            total[r["c"]] += r["s"]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        found = Centres(np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), found.centres).astype(np.float32))
    return found


def prune(near: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int, alpha: float = ALPHA) -> np.ndarray:
    """(rows x most), -1 where there are fewer: of each row's candidates, in falling order of ``sims``, those that no kept one is ``alpha`` times closer to."""
    rows, width = near.shape
    kept = np.full((rows, most), -1, np.int64)
    distance = np.sqrt(np.maximum(2 - 2 * sims, 0))
    among = x[near]
    among = np.sqrt(np.maximum(2 - 2 * (among @ among.transpose(0, 2, 1)), 0))
    alive, every = np.ones((rows, width), bool), np.arange(rows)
    for i in range(most):
        pick = alive.argmax(axis=1)
        have = alive[every, pick]
        if not have.any():
            break
        kept[have, i] = near[every, pick][have]
        alive &= alpha * among[every, pick] > distance
        alive[every, pick] = False
    return kept


def build(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to), as positions and sorted, of one shard's graph: pruned nearest neighbours and some far ones, both ways."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.argsort(_hash(ids), kind="stable")
    edges = []
    for lo in range(0, n, 256):
        at = np.arange(lo, min(n, lo + 256))
        sims = x[at] @ x.T
        m = min(n - 1, 2 * NEAR)
        sims[np.arange(len(at)), at] = -2
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        own = np.take_along_axis(sims, near, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        kept = prune(np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1), x, NEAR)
        far = some[(at[:, None] * 7 + np.arange(1, FAR + 1) * max(1, n // (FAR + 1))) % n]
        to = np.concatenate([kept, far], axis=1)
        a, b = np.repeat(at, to.shape[1]), to.reshape(-1)
        ok = (b >= 0) & (a != b)
        edges += [a[ok] * n + b[ok], b[ok] * n + a[ok]]
    edge = np.unique(np.concatenate(edges))
    return edge // n, edge % n


def search(x: np.ndarray, queries: np.ndarray, start: np.ndarray, degree: np.ndarray, flat: np.ndarray, entry: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, found) in parts: for each query the vectors of ``x`` within the threshold that range-expanding greedy search meets.

    Beam search from the entry points finds the neighbourhood; from then on every vector within the threshold is
    expanded, whatever the beam, until none is left. ``start``, ``degree`` and ``flat`` are the adjacency lists.
    """
    n = len(x)
    mark = np.zeros((256, n), np.int32)
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        rows = len(q)
        seen = np.zeros((rows, n), bool)
        open_r, open_v = np.repeat(np.arange(rows), len(entry)), np.tile(entry, rows)
        seen[open_r, open_v] = True
        sims = np.einsum("ij,ij->i", q[open_r], x[open_v])
        beam_v, beam_s = open_v.reshape(rows, -1), sims.reshape(rows, -1)
        done = np.zeros(beam_v.shape, bool)
        hit = sims >= threshold
        found = [(open_r[hit], open_v[hit])]
        pending = found[-1:]
        while True:
            score = np.where(done, -9, beam_s)
            best = score.argmax(axis=1)
            r = np.flatnonzero(score[np.arange(rows), best] > -9)
            v = beam_v[r, best[r]]
            done[r, best[r]] = True
            r, v = (np.concatenate([a, *b]) for a, b in zip((r, v), zip(*pending))) if pending else (r, v)
            pending = []
            if not len(r):
                break
            for part in range(0, len(r), 20_000):
                pr, pv = r[part : part + 20_000], v[part : part + 20_000]
                d = degree[pv]
                nr = np.repeat(pr, d)
                nv = flat[np.repeat(start[pv] - (np.cumsum(d) - d), d) + np.arange(d.sum())]
                fresh = np.flatnonzero(~seen[nr, nv])
                if not len(fresh):
                    continue
                nr, nv = nr[fresh], nv[fresh]
                mark[nr, nv] = np.arange(len(nr))  # of a vector that is met twice, one stays
                once = np.flatnonzero(mark[nr, nv] == np.arange(len(nr)))
                once = once[np.argsort(nr[once], kind="stable")]
                nr, nv = nr[once], nv[once]
                seen[nr, nv] = True
                s = np.einsum("ij,ij->i", q[nr], x[nv])
                hit = s >= threshold
                if hit.any():
                    found.append((nr[hit], nv[hit]))
                    pending.append(found[-1])
                # the best BEAM of each query stay
                keep = np.flatnonzero(s > beam_s.min(axis=1)[nr]) if beam_s.shape[1] == BEAM else np.arange(len(s))
                nr, nv, s = nr[keep], nv[keep], s[keep]
                if not len(nr):
                    continue
                first = np.searchsorted(nr, np.arange(rows))
                slot = np.arange(len(nr)) - first[nr]
                width = int(slot.max()) + 1
                add_v, add_s = np.zeros((rows, width), np.int64), np.full((rows, width), -8.0, np.float32)
                add_v[nr, slot], add_s[nr, slot] = nv, s
                all_v, all_s = np.concatenate([beam_v, add_v], axis=1), np.concatenate([beam_s, add_s], axis=1)
                all_d = np.concatenate([done, add_s < -7], axis=1)
                m = min(BEAM, all_s.shape[1])
                top = np.argpartition(-all_s, m - 1, axis=1)[:, :m]
                beam_v, beam_s, done = (np.take_along_axis(a, top, 1) for a in (all_v, all_s, all_d))
        fr, fv = (np.concatenate(f) for f in zip(*found))
        yield fr + lo, fv


def _placer(at: Broadcast, width: int, most: int, threshold: float):
    def place(v: pa.Array) -> pa.Array:
        return pa.array([a.astype(np.int32) for a in at.value.nearest(_matrix(v, width), most, threshold)], pa.list_(pa.int32()))

    return place


def _edges(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = np.asarray(table.column("id").combine_chunks())
        a, b = build(ids, _matrix(table.column("v"), width))
        cuts = np.searchsorted(a, np.arange(len(ids) + 1)).astype(np.int32)
        return pa.table({"id": ids, "to": pa.ListArray.from_arrays(cuts, pa.array(ids[b], pa.int64()))})

    return run


def _finder(width: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Rows of a shard: vectors stored in it, with their lists, and those that only look into it.

        A link is counted by one of the shards where it can be found: the first, of those where one of the two is
        stored and the other looks.
        """
        table = table.sort_by("id")
        ids, x = np.asarray(table.column("id").combine_chunks()), _matrix(table.column("v"), width)
        size = np.asarray(table.column("v").combine_chunks().value_lengths())
        shard = table.column("shard")[0].as_py()
        stored = np.flatnonzero(np.asarray(table.column("stored").combine_chunks()))
        looks = table.column("looks").combine_chunks()
        cuts, places = np.asarray(looks.offsets), np.asarray(looks.values)
        links, out = Links(), []
        if len(stored) and len(ids) > 1:
            lists = table.column("to").combine_chunks().take(pa.array(stored))
            degree = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            own, to = np.repeat(np.arange(len(stored)), degree), np.asarray(lists.flatten())
            at = np.minimum(np.searchsorted(ids[stored], to), len(stored) - 1)
            here = ids[stored][at] == to  # of the united lists, what this shard stores
            own, flat = own[here], at[here]
            degree = np.bincount(own, minlength=len(stored))
            y = x[stored]
            medoid = int((y @ y.mean(axis=0)).argmax())
            entry = np.unique(np.concatenate([[medoid], np.argsort(_hash(ids[stored]), kind="stable")[: ENTRY - 1]]))
            for q, f in search(y, x, np.cumsum(degree) - degree, degree, flat, entry, threshold - 1e-4):
                f = stored[f]
                ok = (q != f) & (size[q] == size[f])
                q, f = q[ok], f[ok]
                both = np.unique(np.minimum(q, f) * len(ids) + np.maximum(q, f))
                q, f = both // len(ids), both % len(ids)
                cosine = np.concatenate([np.einsum("ij,ij->i", x[q[i : i + 50_000]].astype(np.float64), x[f[i : i + 50_000]].astype(np.float64)) for i in range(0, len(q), 50_000)] or [np.zeros(0)])
                near = np.flatnonzero(cosine >= threshold)
                q, f, cosine = q[near], f[near], cosine[near]
                first = _first_place(places, cuts, q, f)
                here = first == shard
                out.append(np.stack([q[here], f[here]]))
                found = cosine[here]
                out[-1] = (out[-1], found)
        rows = []
        if out:
            q, f = np.concatenate([o[0] for o in out], axis=1)
            cosine = np.concatenate([o[1] for o in out])
            _, once = np.unique(q * len(ids) + f, return_index=True)  # two that look for each other find one link
            for lo in range(0, len(once), 1 << 21):
                part = once[lo : lo + (1 << 21)]
                rows += links.add(ids[q[part]], ids[f[part]], 1 - cosine[part])
        rows += links.end()
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("id", "first", "links", "nearest"), columns)))

    return run


def _first_place(places: np.ndarray, cuts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest shard where one of a and b is stored (the first OVERLAP of its places) and the other looks (any of them); -1 where there is none."""
    big = np.iinfo(np.int64).max
    out = np.full(len(a), big)
    for one, two in ((a, b), (b, a)):
        most = int((cuts[two + 1] - cuts[two]).max()) if len(two) else 0
        for i in range(OVERLAP):
            s = np.where(cuts[one] + i < cuts[one + 1], places[np.minimum(cuts[one] + i, len(places) - 1)], -1)
            hit = np.zeros(len(a), bool)
            for j in range(most):
                t = np.where(cuts[two] + j < cuts[two + 1], places[np.minimum(cuts[two] + j, len(places) - 1)], -2)
                hit |= s == t
            out = np.where(hit, np.minimum(out, s), out)
    return np.where(out == big, -1, out)


def _audited(groups: DataFrame, width: int, threshold: float) -> dict[int, int]:
    """By brute force over all vectors, how many are within the threshold of each of AUDITED ones that a hash chooses."""
    rows = groups.orderBy(F.xxhash64("id"), "id", "v").limit(AUDITED).select("id", "v").toArrow()
    ids, q = np.asarray(rows.column(0).combine_chunks()), _matrix(rows.column(1), width)
    size = np.asarray(rows.column(1).combine_chunks().value_lengths())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            other, x = np.asarray(batch.column(0)), _matrix(batch.column(1), width)
            length = np.asarray(batch.column(1).value_lengths())
            i, j = np.nonzero(x @ q.T >= threshold - 1e-4)
            cosine = np.einsum("ij,ij->i", x[i].astype(np.float64), q[j].astype(np.float64))
            ok = (cosine >= threshold) & (other[i] != ids[j]) & (length[i] == size[j])
            total += np.bincount(j[ok], minlength=len(ids))
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[have]), pa.array(total[have])], names=["id", "n"])

    return {r["id"]: r["n"] for r in groups.select("id", "v").mapInArrow(near, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def _key(v: Column) -> list[Column]:
    return [F.xxhash64(v).alias("h"), F.xxhash64(F.lit(7), v).alias("g")]


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, cluster: int = CLUSTER) -> DataFrame:
    """(vec_id, class_id, copies, links, cosine, recall): a row for each vec_id, also of vectors without near duplicates.

    Vectors whose cosine reaches ``threshold`` are linked, and the connected ones are a class; ``class_id`` is its
    smallest vec_id. ``copies`` counts the rows with an equal unit vector, itself included, ``links`` the other vectors
    to which it is linked, and ``cosine`` is the greatest of another row (null where none is linked or equal).

    Vectors are stored in their OVERLAP nearest clusters, whose size doesn't depend on their number. Each shard's graph
    is pruned robustly, adjacency lists of a vector are united over its shards, and each vector is searched for from the
    medoids of its ``probes`` nearest clusters and of any whose centre is within the threshold. Cosines are verified in
    double precision. ``recall``, the same in all rows, is measured on AUDITED vectors against all others; while it is
    below LEAST_RECALL, the search is repeated with twice the probes, up to all clusters.

    Equal vectors are searched as one. Only vectors of one length are compared. Rows without an id are left out; null,
    empty, zero and infinite vectors are classes of their own; repeated rows are copies; an id with several vectors has
    the smallest class of them. An empty table gives no rows. Columns other than vec_id and embedding are not read.
    """
    unit = vectors(table)
    groups = unit.where("v is not null").groupBy(*_key(F.col("v"))).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    groups = stage_table(groups, "distinct")
    sizes = groups.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = sizes["n"], sizes["width"] or 1
    at = groups.sparkSession.sparkContext.broadcast(centres(groups, n, width, cluster) if n else Centres(np.zeros((1, width), np.float32)))
    truth = _audited(groups, width, threshold) if n else {}
    lists = None
    while True:
        looks = F.arrow_udf(_placer(at, width, max(probes, OVERLAP), threshold), "array<int>")
        placed = groups.select("id", "v", looks("v").alias("looks"))
        if lists is None:  # the clusters that store a vector don't change with the probes
            stored = placed.select("id", "v", F.explode(F.slice("looks", 1, OVERLAP)).alias("shard"))
            edges = stored.groupBy("shard").applyInArrow(_edges(width), "id bigint, to array<bigint>")
            lists = stage_table(edges.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")), "graph")
        spread = placed.join(lists, "id", "left").select("id", "v", "looks", "to", F.posexplode("looks").alias("place", "shard"))
        rows = spread.select("id", "v", "looks", F.when(F.col("place") < OVERLAP, F.col("to")).alias("to"), (F.col("place") < OVERLAP).alias("stored"), "shard")
        found = stage_table(rows.groupBy("shard").applyInArrow(_finder(width, threshold), LINKS), "links")
        got = {r["id"]: r["n"] for r in found.where(F.col("id").isin(sorted(truth))).groupBy("id").agg(F.sum("links").alias("n")).collect()} if truth else {}
        recall = round(sum(got.values()) / sum(truth.values()), 4) if truth else 1.0
        if recall >= LEAST_RECALL or probes >= len(at.value.centres):
            break
        probes *= 2
    classes = components(found.select(F.col("first").alias("a"), F.col("id").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"), F.min("nearest").alias("nearest"))
    linked = counts.join(classes.withColumnRenamed("first", "class_id"), "id", "left")
    nodes = groups.drop("v").join(linked, "id", "left").select(
        "h", "g", "copies", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), F.when(F.col("copies") > 1, 1.0).otherwise(F.round(1 - F.col("nearest"), 5)).alias("cosine")
    )
    same = unit.where("v is not null").select(F.col("id").alias("vec_id"), *_key(F.col("v"))).join(nodes, ["h", "g"]).select("vec_id", "class_id", "copies", "links", "cosine")
    bare = unit.where("v is null").selectExpr("id as vec_id", "id as class_id", "1l as copies", "0l as links", "cast(null as double) as cosine")
    out = same.unionByName(bare).groupBy("vec_id").agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.max("links").alias("links"), F.max("cosine").alias("cosine"))
    return out.withColumn("recall", F.lit(recall))


