import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aksharflow.llm import exact_dedup, simhash, textvec
from aksharflow.llm.common import Links, components, maybe_member, membership

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return sorted((r["doc_id"], r["duplicate_of"], r["copies"]) for r in df.collect())


def test_bitmap_has_no_false_negatives(spark):
    keys = [0, 1, -1, 5, 32767, 32768, (1 << 27) - 1, 1 << 27, (1 << 27) + 9, -(1 << 40)]
    bitmap = membership(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k")
    others = [2, 6, 40000, 123456789]
    got = {r["k"]: r["maybe_member"] for r in maybe_member(spark.createDataFrame([(k,) for k in keys + others], "k bigint"), "k", bitmap).collect()}
    assert all(got[k] for k in keys) and not any(got[k] for k in others)


def test_exact_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 4))) for _ in range(80)] + ["x" * 200 + "a", "x" * 200 + "b", "x" * 200 + "a", "é" * 9, "é" * 9]
    rows = list(enumerate(texts))
    groups = {t: [i for i, u in rows if u == t] for t in set(texts)}
    expected = sorted((i, g[0], len(g)) for g in groups.values() if len(g) > 1 for i in g[1:])
    assert pairs(exact_dedup.exact_duplicates(docs(spark, rows))) == expected
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(g[0] for g in groups.values())


def test_exact_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, ""), (5, "z" * 100_000), (6, "z" * 100_000), (7, "solo"), (7, "solo"), (None, "solo")]
    assert pairs(exact_dedup.exact_duplicates(docs(spark, rows)).where("doc_id is not null")) == [(4, 3, 3), (6, 5, 2)]
    assert exact_dedup.exact_duplicates(docs(spark, rows)).where("doc_id is null").count() == 2
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], (r["text"] or "-")[:4]) for r in kept) == [(1, "-"), (2, "-"), (3, "-"), (5, "zzzz"), (7, "solo")]
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0 and exact_dedup.drop_exact_duplicates(docs(spark, [])).count() == 0


def test_clashing_columns_stay(spark):
    rows = [(1, "abc", 7, "q", True, 1), (2, "abc", 8, "r", False, 2), (3, "some other words here", 9, "s", None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int, row string, maybe_member boolean, k int")
    for f in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        out = f(df)
        assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == sorted(r for r in rows if r[0] != 2)


def slow_fingerprint(text):
    """The definition, one bit at a time."""
    counts = {}
    word = ""
    for c in text.lower() + " ":
        if c.isalnum() or ord(c) > 127:
            word += c
        elif word:
            counts[textvec.hash_word(word) >> 20] = counts.get(textvec.hash_word(word) >> 20, 0) + 1
            word = ""
    mix = lambda x: int(textvec.splitmix(np.array([x], np.uint64))[0])
    sums = [0] * 128
    for w, n in counts.items():
        bits = mix(w) | mix(w ^ int(simhash._SALT)) << 64
        for i in range(128):
            sums[i] += round(16 * n**0.5) * (1 if bits >> i & 1 else -1)
    return sum(1 << i for i in range(128) if sums[i] > 0)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(rng.integers(1, 5)):
            text = list(base)
            for _ in range(rng.integers(0, 10)):
                text[rng.integers(len(text))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(text)))
    return rows


def test_fingerprints_match_the_definition():
    texts = [t for _, t in corpus()[:12]] + ["", "one", "One, ONE; one!", "été Été là", "a b a"]
    halves, count = simhash.fingerprints(pa.array([t.lower() for t in texts]))
    for t, h, n in zip(texts, halves, count):
        assert int(h[0]) | int(h[1]) << 64 == slow_fingerprint(t)
        assert n == len([w for w in __import__("re").split(r"[^\w]+", t) if w])


def slow_classes(prints):
    """By brute force over (id, fingerprint) with one row an id: id -> (class, copies, links, distance)."""
    at = dict(prints)
    near = {i: [j for j in at if j != i and (at[i] ^ at[j]).bit_count() <= simhash.MAX_DISTANCE] for i in at}
    out, done = {}, set()
    for i in sorted(at):
        if i in done:
            continue
        group, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in group and not group.add(j)]
        done |= group
        for j in group:
            others = {at[k] for k in near[j]} - {at[j]}
            out[j] = (i, 1 + sum(at[k] == at[j] for k in near[j]), len(others), min(((at[j] ^ at[k]).bit_count() for k in near[j]), default=None))
    return out


def classes(df):
    return {r["doc_id"]: (r["class_id"], r["copies"], r["links"], r["distance"]) for r in df.collect()}


def test_simhash_against_brute_force(spark):
    rows = corpus()
    rows += [(1000 + i, rows[i * 3][1].upper()) for i in range(8)]
    expected = slow_classes([(i, slow_fingerprint(t)) for i, t in rows])
    found = simhash.near_duplicates(docs(spark, rows))
    assert found.count() == len(rows) and classes(found) == expected
    assert sum(c[2] for c in expected.values()) > 40 and {c[1] for c in expected.values()} == {1, 2}
    kept = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c[0] for c in expected.values()})


def test_simhash_query_against_brute_force(spark, tmp_path):
    """The registered query over its whole table."""
    from aksharflow.llm.queries import QUERIES

    rows = corpus()
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert classes(QUERIES["op1_simhash"](spark, str(tmp_path))) == slow_classes([(i, slow_fingerprint(t)) for i, t in rows])


def test_simhash_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "alpha beta gamma"), (5, "Gamma, beta; ALPHA!"), (None, "alpha beta gamma"), (4, "alpha beta gamma"), (6, "alpha beta gamma " * 30_000)]
    lone = (1, 0, None)
    assert classes(simhash.near_duplicates(docs(spark, rows))) == {1: (1, *lone), 2: (2, *lone), 3: (3, *lone), 4: (4, 4, 0, 0), 5: (4, 4, 0, 0), 6: (4, 4, 0, 0)}
    kept = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2, 3, 4, 4]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(1, 5), (3, 5), (2, 3), (7, 8)]
    got = {r["id"]: r["first"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 10 for i in range(11, 31)} | {5: 1, 3: 1, 2: 1, 8: 7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_are_summed_up():
    """Gathered in small parts or at once, the counts, nearest links and connections are those of the links themselves."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 40, (2, 60))
    a, b, far = a[a != b], b[a != b], rng.integers(0, 9, (a != b).sum()).astype(float)
    for most in (1, 7, 1000):
        links = Links(most)
        rows = [r for i in range(len(a)) for r in links.add(a[i : i + 1], b[i : i + 1], far[i : i + 1])] + links.end()
        count, near, edges = {}, {}, []
        for r in rows:
            for i, first, n, d in zip(*(v.tolist() for v in r)):
                count[i], near[i] = count.get(i, 0) + n, min(near.get(i, 99), d)
                edges.append((first, i))
        both = [*zip(a.tolist(), b.tolist(), far.tolist()), *zip(b.tolist(), a.tolist(), far.tolist())]
        assert count == {i: sum(x == i for x, _, _ in both) for i in {x for x, _, _ in both}}
        assert near == {i: min(d for x, _, d in both if x == i) for i in count}
        reach = lambda pairs: {i: min(_reached(pairs, i)) for i in count}
        assert reach(edges) == reach([(x, y) for x, y, _ in both])


def _reached(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for x, y in pairs:
            for p, q in ((x, y), (y, x)):
                if p == at and q not in seen:
                    seen.add(q)
                    todo.append(q)
    return seen


def test_hot_groups_are_whole(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same few words in all").alias("text"))
    assert exact_dedup.exact_duplicates(df).count() == 399
    assert {r["copies"] for r in simhash.near_duplicates(df).collect()} == {400}
    assert simhash.drop_near_duplicates(df).first()["doc_id"] == 0


def test_simhash_finds_edited_copies(spark):
    """Copies with one word in 27 replaced: a word-3-gram Jaccard of about 0.8; of 40 unrelated texts none is paired."""
    rng = np.random.default_rng(12)
    vocabulary, weight = [f"w{i}" for i in range(3000)], 1 / np.arange(10, 3010)
    rows = []
    for g in range(40):
        base = rng.choice(vocabulary, 216, p=weight / weight.sum())
        copy = base.copy()
        copy[rng.choice(216, 8, replace=False)] = [f"new{g}x{i}" for i in range(8)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    found = {(r["class_id"], r["doc_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect() if r["class_id"] != r["doc_id"]}
    wanted = {(2 * g, 2 * g + 1) for g in range(40)}
    assert not found - wanted and len(found) >= 0.95 * len(wanted)


def test_simhash_positions_guarantee_the_distance():
    """Each pair at any distance up to the greatest comes exactly once, also with its differences spread evenly or heaped."""
    rng = np.random.default_rng(13)
    for spread in range(60):
        base = rng.integers(0, 1 << 63, 2, dtype=np.int64).view(np.uint64)
        bits = np.arange(0, 128, 7)[: simhash.MAX_DISTANCE] + spread % 3 if spread < 3 else rng.choice(128, rng.integers(1, simhash.MAX_DISTANCE + 1), replace=False)
        other = base.copy()
        for bit in bits.tolist():
            other[bit // 64] ^= np.uint64(1 << bit % 64)
        both = np.stack([base, other])
        rows = []
        for i, (hi, lo) in enumerate(both.tolist()):
            for quarter in range(4):
                at = [((hi, lo)[quarter // 2] >> 32 * (quarter % 2) + 4 * k) & 15 for k in range(8)]
                rows += [((quarter * len(simhash._PAIRS) + c) << 8 | at[a] << 4 | at[b], i, hi, lo) for c, (a, b) in enumerate(simhash._PAIRS)]
        rows.sort()
        key, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        hi, lo = (np.array([r[k] for r in rows], np.uint64) for k in (2, 3))
        found = [p for part in simhash._matches(key, ids, hi, lo) for p in zip(*(v.tolist() for v in part))]
        assert [(*sorted(p[:2]), p[2]) for p in found] == [(0, 1, len(bits))]


def postings(prints):
    """(key, row, hi, lo) sorted by key, for an (n x 2) array of halves."""
    rows = []
    for quarter in range(4):
        at = [prints[:, quarter // 2] >> np.uint64(32 * (quarter % 2) + 4 * i) & np.uint64(15) for i in range(8)]
        rows += [((quarter * len(simhash._PAIRS) + c) << 8 | (at[i] << np.uint64(4) | at[j]).astype(int)) for c, (i, j) in enumerate(simhash._PAIRS)]
    key, row = np.concatenate(rows), np.tile(np.arange(len(prints)), len(rows))
    order = np.argsort(key, kind="stable")
    return key[order], row[order], *prints[row[order]].T.copy()


def biased(n, seed):
    """Fingerprints as those of one language: a bit is 1 with a probability of its own, 0.18 off one half on average."""
    rng = np.random.default_rng(seed)
    share = np.clip(0.5 + 0.22 * rng.standard_normal(128), 0.07, 0.93)
    return np.packbits(rng.random((n, 128)) < share, axis=1, bitorder="little").view(np.uint64)


def test_simhash_pairs_of_many_against_brute_force():
    """Pairs at all distances up to three beyond the greatest, among fingerprints that share many bits: each near one comes once."""
    prints, rng = biased(6000, 21), np.random.default_rng(22)
    for i in range(0, 400, 2):
        prints[i + 1] = prints[i]
        for bit in rng.choice(128, 1 + i // 2 % (simhash.MAX_DISTANCE + 3), replace=False).tolist():
            prints[i + 1, bit // 64] ^= np.uint64(1 << bit % 64)
    expected = set()
    for i in range(len(prints)):
        distance = np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(axis=1)
        expected |= {(i, i + 1 + j, int(distance[j])) for j in np.flatnonzero(distance <= simhash.MAX_DISTANCE).tolist()}
    found = [(*sorted(p[:2]), p[2]) for part in simhash._matches(*postings(prints)) for p in zip(*(v.tolist() for v in part))]
    assert len(found) == len(expected) and set(found) == expected and len(expected) >= 170


def test_simhash_compares_few_pairs(monkeypatch):
    """Among 6000 fingerprints without near ones, each is compared with fewer than 60; samples of 16 bits would take 156."""
    counted, compared = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(len(x)) or counted(x))
    assert not [p for part in simhash._matches(*postings(biased(6000, 21))) for p in part[0]]
    assert sum(compared) < 60 * 6000


def test_simhash_lists_of_several_tasks_hold_each_pair_once(monkeypatch):
    """One long list and many short ones, cut anywhere between lists."""
    prints = biased(300, 23)
    prints[:120, 0] &= ~np.uint64(0xFF)
    for i in range(120):
        prints[i, 1] = prints[0, 1] ^ np.uint64(1 << i % 60)
        prints[i, 0] = prints[0, 0] ^ np.uint64(1 << (8 + i % 50))
    found = []
    for held in (1, 500, 1 << 17):
        monkeypatch.setattr(simhash, "HELD", held)
        key, row, hi, lo = postings(prints)
        batches = [pa.RecordBatch.from_arrays([pa.array(v[a : a + 97]) for v in (key, row, hi.view(np.int64), lo.view(np.int64))], names=["key", "id", "hi", "lo"]) for a in range(0, len(key), 97)]
        total = {}
        for b in simhash._tally(iter(batches)):
            for r in b.to_pylist():
                total[r["id"]] = total.get(r["id"], 0) + r["links"]
        found.append(total)
    near = [(np.bitwise_count(prints ^ p).sum(axis=1) <= simhash.MAX_DISTANCE).sum() - 1 for p in prints]
    assert found[0] == found[1] == found[2] == {i: n for i, n in enumerate(near) if n} and found[0][0] >= 100
