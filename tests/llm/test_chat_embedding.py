import numpy as np
from pyspark.sql import functions as F

from aksharflow.llm import chat, embedding

TALKS = {
    1: [("system", "be brief"), ("user", "hi"), ("assistant", "hello")],
    2: [("system", "be brief"), ("user", "hi"), ("assistant", "hey")],
    3: [("system", "be brief"), ("user", "bye")],
    4: [("user", "hi"), ("assistant", "hello")],
    5: [("system", "be brief"), ("user", "hi"), ("assistant", "hello")],
    6: [("system", "be brief")],
    7: [("user", "x" * 20_000)],
}


def turns(spark, talks=TALKS, extra=()):
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows + list(extra), "conv_id bigint, turn bigint, role string, text string")


def unrolled(rows):
    """Each conversation's tokens, positions and visible tokens, read back from the trees."""
    by = {r["node"]: r for r in rows}
    out = {}
    for r in rows:
        chain, at = [r], r
        while at["parent"]:
            at = by[at["parent"]]
            chain.insert(0, at)
        for c in r["ends"]:
            out[c] = ([t for n in chain for t in n["token_ids"]], [p for n in chain for p in n["position_ids"]], r, chain)
    return out


def test_round_trip(spark):
    rows = chat.prefix_trees(turns(spark)).collect()
    got = unrolled(rows)
    for c, talk in TALKS.items():
        tokens, positions, last, chain = got[c]
        assert tokens == [x for r, t in talk for x in chat.encode_turn(chat.VOCABULARY, r, t)]
        assert positions == list(range(len(tokens)))
        spans = [tuple(a) for a in last["attends"]]
        assert [i for a, b in spans for i in range(a, b)] == [i for n in chain[:-1] for i in range(n["start"], n["start"] + len(n["token_ids"]))]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    prefixes = {tuple(t[: i + 1]) for t in TALKS.values() for i in range(len(t))}
    assert len(rows) == len(prefixes)


def test_layout_is_depth_first(spark):
    rows = chat.prefix_trees(turns(spark)).collect()
    for tree in {r["tree"] for r in rows}:
        own = sorted((r for r in rows if r["tree"] == tree), key=lambda r: r["start"])
        at = 0
        stack = []
        for r in own:
            assert r["start"] == at
            at += len(r["token_ids"])
            stack = stack[: r["depth"]]
            assert (stack[-1]["node"] if stack else None) == r["parent"]
            stack.append(r)


def test_chat_edges(spark):
    extra = [(8, 0, None, None), (8, 1, "user", None), (8, 1, "user", ""), (9, 0, "user", ""), (9, 0, "user", ""), (None, 0, "user", "lost"), (10, None, "user", "first"), (10, 0, "user", "second")]
    df = turns(spark, {}, extra).withColumn("path", F.lit("p")).withColumn("depth", F.lit(1))
    rows = chat.prefix_trees(df).collect()
    got = unrolled(rows)
    enc = lambda *t: [x for r, s in t for x in chat.encode_turn(chat.VOCABULARY, r, s)]
    assert got[8][0] == enc((None, None), ("user", None), ("user", "")) and got[9][0] == enc(("user", "")) and got[10][0] == enc(("user", "first"), ("user", "second"))
    assert set(got) == {8, 9, 10}
    assert chat.prefix_trees(df.limit(0)).count() == 0


def vectors(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for i in range(0, n, 5):
        x[i + 1] = x[i] + rng.normal(size=16) * 0.04
    x[300:360] = x[300] + rng.normal(size=(60, 16)) * 0.03
    x[100] = x[200]
    return x.astype(np.float32)


def test_nodes_are_told_apart(spark):
    """Roles and texts whose concatenations would be equal, and nulls beside signs that could stand for them."""
    talks = {1: [("a", "b\x01c")], 2: [("a\x01b", "c")], 3: [("r", None)], 4: [("r", "\x00")], 5: [("r", "")], 6: [("r", "-")], 7: [("a1:", "b")], 8: [("a", "1:b")], 9: [(None, "b")], 10: [("", "b")]}
    rows = chat.prefix_trees(turns(spark, talks)).collect()
    assert len({r["node"] for r in rows}) == len(rows) == 10


def test_deep_and_wide_trees_by_brute_force(spark):
    """One shared beginning, forks at any depth, a conversation of 400 turns: layout and intervals as a recursive walk gives them."""
    rng = np.random.default_rng(1)
    talks = {i: [("s", "same")] + [("u", f"t{d}-{rng.integers(2)}") for d in range(int(rng.integers(0, 9)))] for i in range(60)}
    talks[100] = [("s", "same")] + [("u", f"long {d}") for d in range(400)]
    rows = chat.prefix_trees(turns(spark, talks)).collect()
    got = unrolled(rows)
    assert set(got) == set(talks) and len({r["tree"] for r in rows}) == 1
    own = sorted(rows, key=lambda r: r["start"])
    assert all(a["start"] + len(a["token_ids"]) == b["start"] for a, b in zip(own, own[1:])) and own[0]["start"] == 0
    for c, talk in talks.items():
        tokens, positions, last, chain = got[c]
        assert tokens == [x for r, t in talk for x in chat.encode_turn(chat.VOCABULARY, r, t)] and positions == list(range(len(tokens)))
        assert [i for a in last["attends"] for i in range(a["start"], a["end"])] == [i for n in chain[:-1] for i in range(n["start"], n["start"] + len(n["token_ids"]))]


def test_many_conversations_end_alike(spark, monkeypatch):
    """A node's ends go on in further rows, none longer than about the bound, and none is lost."""
    monkeypatch.setattr(chat, "MOST_ENDS", 10)
    talks = {i: [("u", "hi")] for i in range(200)} | {500: [("u", "hi"), ("a", "x")]}
    rows = chat.prefix_trees(turns(spark, talks)).collect()
    assert sorted(c for r in rows for c in r["ends"]) == sorted(talks)
    assert len({r["node"] for r in rows}) == 2 and max(len(r["ends"]) for r in rows) < 30 and sum(r["token_ids"] is not None for r in rows) == 2


def brute(ids, x, threshold=embedding.THRESHOLD):
    """id -> (class, copies, links, cosine) of distinct ids with vectors of one length."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = u.astype(np.float32).astype(float)
    sims = u @ u.T
    out, done = {}, set()
    near = [[j for j in np.flatnonzero(sims[i] >= threshold).tolist() if j != i] for i in range(len(x))]
    for i in range(len(x)):
        if i in done:
            continue
        group, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in group and not group.add(j)]
        done |= group
        for j in group:
            same = [k for k in near[j] if np.array_equal(u[k], u[j])]
            others = {u[k].tobytes() for k in near[j]} - {u[j].tobytes()}
            out[ids[j]] = (min(ids[k] for k in group), 1 + len(same), len(others), 1.0 if same else max((round(sims[j, k], 5) for k in near[j]), default=None))
    return out


def table(spark, x, ids=None):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids or range(len(x)), x)], "vec_id bigint, embedding array<float>")


def result(df):
    return {r["vec_id"]: (r["class_id"], r["copies"], r["links"], r["cosine"]) for r in df.collect()}


def test_embeddings_against_brute_force(spark, tmp_path):
    """Small clusters, so that there are many; the registered query with one; groups within the threshold keep all links."""
    from aksharflow.llm.queries import QUERIES

    x = vectors()
    expected = brute(list(range(len(x))), x)
    out = embedding.near_duplicates(table(spark, x), cluster=60)
    got, recall = result(out), out.first()["recall"]
    links = sum(e[2] for e in expected.values())
    assert set(got) == set(expected) and recall >= 0.9 and abs(sum(g[2] for g in got.values()) - recall * links) < 0.01 * links
    assert all(g[2] <= expected[i][2] and g[1] == expected[i][1] for i, g in got.items())
    assert np.mean([got[i][0] == expected[i][0] for i in got]) > 0.97
    table(spark, x).write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = QUERIES["op7_embedding_dedup"](spark, str(tmp_path))
    assert result(whole) == expected and whole.first()["recall"] == 1.0


def test_search_is_repeated_until_recall_is_reached(spark):
    """Unclustered vectors in many small clusters: few probes miss links, and more are taken."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24))
    x[1::2] = x[::2] + rng.normal(size=(450, 24)) * 0.29
    out = embedding.near_duplicates(table(spark, x.astype(np.float32)), cluster=10, probes=1)
    expected = brute(list(range(900)), x.astype(np.float32))
    assert out.first()["recall"] >= embedding.LEAST_RECALL
    assert sum(r[2] for r in result(out).values()) >= 0.88 * sum(e[2] for e in expected.values())


def test_prune_keeps_the_nearest():
    x = np.array([[1, 0], [0.999, 0.04], [0.998, 0.06], [-1, 0.1]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x[1:] @ x[0]
    kept = embedding.prune(np.array([[1, 2, 3]]), sims[None], x, 3)[0]
    assert kept[0] == 1 and 2 not in kept


def test_two_level_centres_match_brute_force():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(40, 8)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    at = embedding.Centres(c)
    assert sorted(map(tuple, at.centres.tolist())) == sorted(map(tuple, c.tolist()))
    x = c + rng.normal(size=c.shape).astype(np.float32) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert all(a[0] == (at.centres @ v).argmax() and len(a) == 3 for a, v in zip(at.nearest(x, 3), x))
    assert all(len(a) == 40 for a in at.nearest(x, 1, -1.5))


def test_embedding_edges(spark):
    v = [1.0] + [0.0] * 7
    w = [0.0] * 7 + [2.0]
    rows = [(1, v), (2, v), (2, v), (3, [2 * a for a in v]), (None, v), (4, None), (5, []), (6, [0.0] * 8), (7, [float("nan")] + [0.0] * 7), (8, w), (9, [0.01] * 7 + [2.0]), (10, [1.0]), (11, [1.0, 0.0]), (12, [3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("v", F.lit("v"))
    got = result(embedding.near_duplicates(df))
    lone = (1, 0, None)
    assert {i: g[:3] for i, g in got.items() if i in (8, 9)} == {8: (8, 1, 1), 9: (8, 1, 1)} and got[8][3] == got[9][3] > 0.99
    assert {i: g for i, g in got.items() if i not in (8, 9)} == {1: (1, 4, 0, 1.0), 2: (1, 4, 0, 1.0), 3: (1, 4, 0, 1.0), **{i: (i, *lone) for i in (4, 5, 6, 7, 11)}, 10: (10, 2, 0, 1.0), 12: (10, 2, 0, 1.0)}
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    assert result(embedding.near_duplicates(df.where("vec_id = 8"))) == {8: (8, *lone)}
