import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aksharflow.llm import langid, lm, quality, textvec, toxicity

TEXTS = ["", "one two", "Ärger – übel!", "a", "...", "x" * 3000 + " y", "tab\tand\nline", "été"]


def test_words_and_hashes():
    for at, end, data, offs in textvec.chunks(pa.array(TEXTS), 40):
        row, first, stop = textvec.words(data, offs)
        h = textvec.word_hashes(data, first, stop)
        for i in range(at, end):
            spans = [bytes(data[a:b]).decode() for r, a, b in zip(row, first, stop) if r == i - at]
            assert spans == __import__("re").findall(r"(?:[^\W_]|[^\x00-\x7f])+", TEXTS[i])
        assert [int(x) for x in h] == [textvec.hash_word(bytes(data[a:b]).decode()) for a, b in zip(first, stop)]
    sliced = pa.array(TEXTS).slice(1, 3)
    assert textvec.raw(sliced)[0].tobytes().decode() == "".join(TEXTS[1:4])


def toxic_rows(seed=0):
    rng = np.random.default_rng(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["blorgy", "snarkle", "grumbous"]
    rows, labels = [], []
    for i in range(240):
        words = list(rng.choice(plain, 40))
        if i % 3 == 0:
            for _ in range(3):
                words[rng.integers(40)] = str(rng.choice(bad)) + str(rng.choice(["", "ish", "er"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels[:160], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    assert len(out) == 240
    right = [out[i]["toxic"] == bool(t) for i, _, t in labels[160:]]
    assert np.mean(right) > 0.95
    r = next(out[i] for i, _, t in labels[160:] if t and out[i]["toxic"])
    assert len(r["neighbours"]) == len(r["cosines"]) and r["cosines"] == sorted(r["cosines"], reverse=True) and r["words"] > 0
    kept = toxicity.drop_toxic(docs, known)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, x in out.items() if not x["toxic"]) and kept.columns == docs.columns


def slow_terms(text, vocabulary):
    """term -> times by a walk over the words; -1 with its own key for each word outside."""
    words, stems = vocabulary.hashes[: vocabulary.words].tolist(), vocabulary.hashes[vocabulary.words :].tolist()
    out = {}
    for w in __import__("re").findall(r"(?:[^\W_]|[^\x00-\x7f])+", text.lower()):
        h = textvec.hash_word(w)
        keys = [words.index(h) if h in words else ("out", w)]
        data = w.encode()
        for k in toxicity.STEMS:
            if len(data) > k:
                part = np.frombuffer(data[:k], np.uint8)
                h = int(textvec.word_hashes(part, np.array([0]), np.array([k]))[0])
                keys += [vocabulary.words + stems.index(h)] if h in stems else []
        for key in keys:
            out[key] = out.get(key, 0) + 1
    return out


def slow_unit(text, vocabulary, idf):
    v = {}
    for key, n in slow_terms(text, vocabulary).items():
        outside = isinstance(key, tuple)
        v[key] = (1 + math.log(n)) * idf[-1 if outside else key] * (toxicity.LEAST if outside else vocabulary.weight[key])
    if v:
        v["ground"] = toxicity.BACKGROUND
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items() if not isinstance(k, tuple)}


def test_toxicity_query_against_brute_force(spark, tmp_path):
    """The registered query: document frequencies, all cosines, ties, votes and scores by plain loops."""
    from aksharflow.llm.queries import QUERIES

    rows, labels = toxic_rows(3)
    rows, labels = rows[:90] + [(500, rows[0][1]), (501, ""), (502, "qqq zzz"), (503, "word1 word2")], labels[:60]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    index = toxicity.fit(docs, known)
    v = index.vocabulary
    found = [slow_terms(t, v) for _, t in rows]
    idf = np.array([math.log((1 + len(rows)) / (1 + sum(k in f for f in found))) + 1 for k in range(len(v.hashes))] + [math.log(1 + len(rows)) + 1])
    assert np.allclose(index.idf, idf)
    texts = dict(rows)
    examples = [slow_unit(texts[i], v, idf) for i in index.ids.tolist()]
    out = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        q = slow_unit(text, v, idf)
        cos = np.array([round(sum(x * e.get(k, 0.0) for k, x in q.items()), 5) for e in examples])
        order = sorted((j for j in range(len(cos)) if cos[j] > 0), key=lambda j: (-cos[j], j))[: toxicity.NEIGHBOURS]
        assert np.allclose(out[i]["cosines"], cos[order], atol=2e-5) and len(out[i]["cosines"]) == len(order)
        if order:
            w = 1 / (1 - cos[order] + 0.05)
            assert out[i]["votes"] == pytest.approx(float((w * index.toxic[order]).sum() / w.sum()), abs=0.03)
        assert out[i]["score"] == pytest.approx(float(index.score(np.array([np.nan if out[i]["votes"] is None else out[i]["votes"]]))[0]), abs=1e-4)
    assert out[501]["votes"] is None and out[0]["cosines"] == out[500]["cosines"] and max(out[0]["cosines"]) == pytest.approx(1, abs=2e-5)


def test_block_max_search_is_exact(monkeypatch):
    """Posting lists and dense columns, over several blocks, with ties; best first, equal cosines by place."""
    rng = np.random.default_rng(7)
    n, width = 500, 60
    share = np.where(np.arange(width) < 8, 0.4, 0.03)
    have = rng.random((n, width)) < share
    have[7] = have[3]
    row, term = np.nonzero(have)
    vocabulary = toxicity.Vocabulary(np.arange(width, dtype=np.uint64), width, rng.random(width) + 0.1, np.ones(width, bool))
    terms = toxicity.Terms(row, term, np.ones(len(row), np.int64))
    index = toxicity.Index(vocabulary, rng.random(width + 1) + 1, np.arange(n), np.zeros(n), terms)
    assert 0 < (index.column >= 0).sum() < width and index.blocks == 8
    row, term = np.nonzero(rng.random((60, width)) < share * 1.5)
    asked = toxicity.Terms(row, term, rng.integers(1, 4, len(row)))
    full = lambda t, rows: (lambda u: np.concatenate([np.bincount(u[0] * width + u[1], u[2], rows * width).reshape(rows, width), u[3][:, None]], axis=1))(index.unit(t, rows))
    sims = np.round(full(asked, 60) @ full(terms, n).T, 5)
    best, cosine = index.search(asked, 60, 9)
    for q in range(60):
        order = np.lexsort((np.arange(n), -sims[q]))[:9]
        assert np.allclose(cosine[q], sims[q][order], atol=2e-5)
        assert best[q].tolist() == order.tolist() or np.allclose(sims[q][best[q]], sims[q][order], atol=2e-5)
        assert all(x < y for x, y, c, d in zip(best[q], best[q][1:], cosine[q], cosine[q][1:]) if c == d)
    skip = best[:, 0]
    again, _ = index.search(asked, 60, 9, skip=skip)
    assert not (again == skip[:, None]).any()


def test_toxicity_edges(spark):
    rows, labels = toxic_rows(1)
    odd = [(None, "blorgy blorgy"), (1000, None), (1001, ""), (0, rows[0][1]), (1002, "blorgyish " * 60_000), (1003, "word1")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumn("score", F.lit("s")).withColumn("t", F.lit(1)).withColumn("rejected", F.lit(True))
    known = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    assert out[1002]["toxic"] and not out[1000]["toxic"] and out[1000]["score"] == out[1001]["score"] and out[1001]["neighbours"] == [] and out[1001]["votes"] is None
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
    none = known.limit(0)
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0} and toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def test_copies_of_an_example_count_once():
    a = " ".join(f"k{i}" for i in range(60))
    others = [f"quite other words stand here p{i} q{i} r{i}" for i in range(40)]
    assert toxicity.first_of_copies([a, a + " more", a, *others]).tolist() == [True, False, False] + [True] * 40


def test_discriminant_matches_the_densities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    m = quality.discriminant(x, y, 0.5, 0.0, 0.0)
    z = (x - x.mean(0)) / x.std(0)
    log = []
    for c in (0, 1):
        g = z[y == c]
        cov = np.cov(g.T)
        d = z - g.mean(0)
        log.append(-0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    assert np.allclose(m.log_odds(x), log[1] - log[0], atol=1e-8)


def test_quality(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefg"), rng.integers(2, 8)))
    rows = [(i, " ".join(word() + ("***" if i % 4 == 0 and rng.random() < 0.7 else "") for _ in range(50))) for i in range(200)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(140)]
    odd = [(None, "a b"), (900, None), (901, ""), (0, rows[0][1]), (902, "good words " * 50_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumn("keep", F.lit("k")).withColumn("good", F.lit(1))
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality(docs, known).collect()}
    assert np.mean([out[i]["keep"] == (i % 4 != 0) for i in range(140, 200)]) > 0.95
    assert out[900]["log_odds"] == out[901]["log_odds"] and all(math.isfinite(r["log_odds"]) for r in out.values())
    for few in (known.limit(0), known.where("quality = 1")):
        assert quality.quality(docs, few).count() == 205
    assert quality.quality(docs.limit(0), known).count() == 0


def test_presence_matches_the_definition():
    data = pa.array(["abcab", "", "é", "zz"])
    for lo, hi, x in langid.presences(data):
        assert (lo, hi) == (0, 4) and x.sum(axis=1).tolist() == [3 + 3 + 3, 0, 2 + 1, 1 + 1]
        assert x[0, ord("a")] == 1 and x[3].sum() == 2


def test_ridge_through_landmarks_is_kernel_ridge():
    """With every row a landmark the folded weights are those of ridge regression on the kernel itself."""
    rng = np.random.default_rng(3)
    x = (rng.random((30, langid.WIDTH)) < 0.002).astype(np.float32)
    x[:, 0] = 1
    labels = [["aa", "bb", "cc"][i % 3] for i in range(30)]
    m = langid.train(lambda: iter([x[:7], x[7:]]), labels, np.ones(30, bool), 0.1)
    u = x / np.sqrt(x.sum(axis=1, keepdims=True)).astype(float)
    y = np.where(np.array(labels)[:, None] == np.array(["aa", "bb", "cc"]), 1.0, -1.0)
    k = u @ u.T
    alpha = np.linalg.solve(k / 10 + 0.1 * np.eye(30), y / 10)
    assert np.allclose(m.scores(x), k @ alpha, atol=1e-3)


def test_every_language_gets_a_classifier(spark):
    """More languages than the rows and landmarks allow for: each keeps a row, equal scores go to the first name."""
    names = [f"l{i:03d}" for i in range(230)]
    rows = [(i * 4 + k, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * (5 + k), n) for i, n in enumerate(names) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, most_rows=300, most_landmarks=250)
    assert model.languages == names
    out = langid.identify(docs).collect()
    assert np.mean([r["agrees"] for r in out]) > 0.95
    same = spark.createDataFrame([(i, "same words", n) for i, n in enumerate(["bb", "aa", "bb", "aa"])], "doc_id bigint, text string, lang string")
    assert {(r["language"], r["margin"]) for r in langid.identify(same).collect()} == {("aa", 0.0)}


def slow_presence(text):
    """Distinct n-grams of 1 to 3 bytes, through the feature each is hashed to."""
    data, out = text.lower().encode(), set()
    for i in range(len(data)):
        out.add(data[i])
        if i + 1 < len(data):
            out.add(256 + ((data[i] << 8 | data[i + 1]) * 0x9E3779B1 % (1 << 32) >> 19))
        if i + 2 < len(data):
            out.add(256 + langid.PAIRS + ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x85EBCA6B % (1 << 32) >> 18))
    return out


def test_language_query_against_brute_force(spark, tmp_path):
    """The registered query: scores are those of the fitted weights over presences taken one n-gram at a time."""
    from aksharflow.llm.queries import QUERIES

    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list(["abcde ", "defgh ", "éèçaz "][i % 3]), int(rng.integers(1, 80)))), ["aa", "bb", "cc"][i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs)
    out = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, str(tmp_path)).collect()}
    for i, text, _ in rows:
        have = sorted(slow_presence(text))
        scores = model.weights[have].sum(axis=0) / math.sqrt(len(have))
        assert np.allclose(out[i]["scores"], scores, atol=2e-4) and out[i]["language"] == model.languages[int(np.argmax(out[i]["scores"]))]


def test_language(spark):
    rng = np.random.default_rng(2)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "éèçaz"}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, "".join(rng.choice(list(alphabets[lang] + "  "), 60)), lang if i < 150 else None))
    odd = [(900, None, "aa"), (901, "", "bb"), (None, "abcde", "aa"), (0, rows[0][1], "aa"), (902, "abc dea " * 60_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("scores", F.lit(1)).withColumn("t", F.lit(2))
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert np.mean([out[i]["language"] == ["aa", "bb", "cc"][i % 3] for i in range(150, 240)]) > 0.95
    assert out[900]["language"] == out[901]["language"] == "und" and out[901]["margin"] == 0 and out[902]["language"] == "aa" and out[200]["agrees"] is None
    assert {r["language"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def slow_decisions(model, data):
    """The definition: (bit, odds by the code, entries of the tables, slot of the local predictor) of each decision of each byte."""
    out = []
    for i in range(len(data)):
        past = lambda k: data[i - k] if i >= k else 0
        hashes = []
        for order in (*lm.ORDERS, lm.LOCAL):
            h = np.array([order], np.uint32)
            for k in range(1, order + 1):
                h = (h ^ np.uint32(past(k))) * lm._MIX[0]
                h ^= h >> np.uint32(15)
            hashes.append(int((h * lm._MIX[1])[0]) & 0xFFFFFFFE)
        pair = past(1) << 8 | data[i]
        places = range(model.code.start[pair], model.code.start[pair] + model.code.size[pair])
        step = lambda p: int(model.code.step[p])
        out.append([(step(p) & 1, float(model.code.odds[p]), [(h ^ step(p)) & ((1 << model.bits) - 1) for h in hashes[:-1]], (hashes[-1] ^ step(p)) >> 1 & ((1 << lm.SLOT_BITS) - 1)) for p in places])
    return out


def slow_tally(model, texts):
    tally = [{} for _ in lm.ORDERS]
    for text in texts:
        for _, _, slots, _ in (d for byte in slow_decisions(model, text.encode()) for d in byte):
            for t, slot in zip(tally, slots):
                t[slot] = t.get(slot, 0) + 1
    return tally


def slow_bits(model, text, others):
    """Bits of a text, decision by decision: tallies of the texts ``others``, and of it so far."""
    tally, own, w, total = slow_tally(model, others), {}, lm.START.astype(float).copy(), 0.0
    data = text.encode()
    made = slow_decisions(model, data)
    odds_of = lambda n0, n1: math.log((n1 + lm.PRIOR) / (n0 + lm.PRIOR))
    for lo, hi in lm._steps(len(data)):
        sums, times = np.zeros_like(w), np.zeros(len(w))
        for bit, odds, slots, local in (d for byte in made[lo:hi] for d in byte):
            n = [(t.get(s & ~1, 0), t.get(s | 1, 0)) for t, s in zip(tally, slots)]
            x = np.array([odds, *(odds_of(*c) for c in n), odds_of(own.get((local, 0), 0), own.get((local, 1), 0))])
            gate = int(sum(sum(n[-1]) >= e for e in lm.GATE_EDGES))
            p = 1 / (1 + math.exp(-float(np.clip(w[gate] @ x, -14, 14))))
            total -= math.log2(p if bit else 1 - p)
            sums[gate] += (bit - p) * x
            times[gate] += 1
            own[local, bit] = own.get((local, bit), 0) + 1
        if hi <= len(data):
            w += lm.RATE * sums / (np.maximum(times, 1) + lm.WARM)[:, None]
    return total


def halves_of(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    return {r["doc_id"]: r["half"] for r in df.select("doc_id", lm._half(df)).collect()}


def test_lm_matches_the_definition(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["the", "of", "and", "blé", "zebra"], int(n))) for n in (3, 40, 400, 5, 30, 20)] + ["", "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model, half = lm.fit(docs), halves_of(spark, range(len(texts)))
    which = np.array([half[i] for i in range(len(texts))])
    assert set(which) == {0, 1}
    size, bits = model.score(pa.array(texts), which)
    for t, n, b, h in zip(texts, size, bits, which):
        assert n == len(t.encode()) and b == pytest.approx(slow_bits(model, t, [u for u, g in zip(texts, which) if g != h]), rel=1e-3, abs=1e-3)
    alone = model.score(pa.array(texts[2:3]), which[2:3])
    assert alone[1][0] == pytest.approx(bits[2], rel=1e-5)


def test_lm_query_matches_the_definition(spark, tmp_path):
    """The registered query over its whole table, copies among the texts."""
    from aksharflow.llm.queries import QUERIES

    rng = np.random.default_rng(16)
    texts = [" ".join(rng.choice(["stone", "house", "été", "x"], int(n))) for n in rng.integers(0, 60, 12)]
    texts += texts[:2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model, half = lm.fit(docs), halves_of(spark, range(len(texts)))
    for r in QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect():
        others = [t for i, t in enumerate(texts) if half[i] != half[r["doc_id"]]]
        assert r["bits"] == pytest.approx(slow_bits(model, texts[r["doc_id"]], others), rel=1e-3, abs=2e-3)


def test_lm_probabilities_sum_to_one(spark):
    """As a code must: after any beginning, all 256 next bytes share its probability."""
    texts = ["the house of stone and the other house", "of the stone", "another thing", "the stone of the house"]
    model = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for begin in (b"", b"the st", b"zq", b"the house of stone and the other house"):
        for half in (0, 1):
            base = model.score(pa.array([begin], pa.binary()), np.array([half]))[1][0]
            more = model.score(pa.array([begin + bytes([b]) for b in range(256)], pa.binary()), np.full(256, half))[1]
            assert sum(2.0 ** (base - m) for m in more) == pytest.approx(1.0, abs=1e-3)


def test_lm_ways_to_count_agree(spark, monkeypatch):
    """Packed keys or an order of the decisions."""
    rng = np.random.default_rng(17)
    texts = [" ".join(rng.choice(["stone", "house", "été", "x"], int(n))) for n in rng.integers(0, 60, 12)]
    model = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    half = np.arange(12) % 2
    _, bits = model.score(pa.array(texts), half)
    monkeypatch.setattr(lm, "SLOT_BITS", 60)
    assert model.score(pa.array(texts), half)[1] == pytest.approx(bits, rel=1e-6)


def test_lm_code_is_a_prefix_code():
    pairs = np.zeros((256, 256), np.int64)
    pairs[97, 98] = 1000
    pairs[97, 99] = 10
    code = lm.make_code(pairs)
    size = code.size[97 << 8 : 98 << 8].astype(float)
    assert sum(2.0**-size) == pytest.approx(1.0) and size[98] == 1 and size[99] <= size[1]


def test_lm_prefers_the_usual(spark):
    rng = np.random.default_rng(8)
    usual = [" ".join(rng.choice(["the", "house", "of", "stone", "and"], 80)) for _ in range(200)]
    noise = "".join(rng.choice(list("qxzjkvw"), 400))
    rows = list(enumerate(usual)) + [(900, noise), (901, None), (902, ""), (None, usual[0]), (0, usual[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("bits", F.lit("b"))
    out = lm.perplexity(docs).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 205 and by[900]["bits_per_byte"] > 2 * by[1]["bits_per_byte"]
    assert by[901]["bits_per_byte"] is None and by[902]["bits"] == 0 and len({r["bits"] for r in out if r["doc_id"] in (0, None)}) == 1
    assert lm.perplexity(docs.limit(0)).count() == 0


def test_lm_tables_grow_at_every_size():
    assert [lm.table_bits(n) for n in (0, 1 << 20, 1 << 29, 1 << 31, 30 << 30, 1 << 40, 1 << 43)] == [16, 16, 22, 24, 28, 33, 36]


def test_lm_wide_hashes():
    """Tables of more than 32 bits need hashes that reach beyond 32."""
    assert lm._hash_type(32) is np.uint32 and lm._hash_type(33) is np.uint64
    _, wide = lm.contexts(np.frombuffer(b"abcab", np.uint8), np.array([0, 5]), np.uint64)
    code = lm.make_code(np.zeros((256, 256), np.int64), np.uint64)
    assert all(h.dtype == np.uint64 and not (h & np.uint64(1)).any() and (h >> np.uint64(33)).any() for h in wide)
    assert code.step.dtype == np.uint64 and (lm._slots(wide[0], np.ones(5, int), code.step[:5], 40) >> np.uint64(33)).any()


def test_lm_large_tables_match_the_definition(spark, monkeypatch):
    """Beyond 22 bits the sorted counts are those of a plain tally."""
    monkeypatch.setattr(lm, "BYTES_PER_ENTRY_BITS", -9)
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["the", "of", "and", "blé", "zebra"], 60)) for _ in range(40)]
    bits = lm.table_bits(sum(len(t.encode()) for t in texts))
    assert bits > lm.DENSE_BITS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = lm.fit(docs)
    assert model.bits == bits and all(len(t) == 1 << bits for t in model.tables)
    half = halves_of(spark, range(len(texts)))
    for h in (0, 1):
        tally = slow_tally(model, [t for i, t in enumerate(texts) if half[i] == h])
        for t, table in zip(tally, model.tables[h :: lm.HALVES]):
            assert all(table[slot] == n for slot, n in t.items()) and table.sum() == sum(t.values())
    which = np.array([half[i] for i in range(3)])
    size, got = model.score(pa.array(texts[:3]), which)
    assert got == pytest.approx([slow_bits(model, texts[i], [t for j, t in enumerate(texts) if half[j] != half[i]]) for i in range(3)], rel=1e-3)


def test_lm_sorted_counts_are_dense_counts(monkeypatch):
    rng = np.random.default_rng(10)
    parts = [rng.integers(0, 1 << 16, 3000).astype(np.uint32) for _ in range(9)]
    monkeypatch.setattr(lm, "RUN", 4000)
    monkeypatch.setattr(lm, "HELD", 5000)
    dense = lm.Counter(16)
    monkeypatch.setattr(lm, "DENSE_BITS", 8)
    few, out = lm.Counter(16), np.zeros(1 << 16, np.int64)
    for p in parts:
        dense.add(p)
        few.add(p)
        if few.full():
            at, n = few.take()
            out[at] += n
    at, n = few.take()
    out[at] += n
    at, n = dense.take()
    assert (out[at] == n).all() and out.sum() == n.sum()


def test_lm_predictions_by_steps(spark):
    """A chunk's decisions are laid out step by step, so that none is gathered again; each has the odds and the gate that it has in the order of documents."""
    rng = np.random.default_rng(18)
    texts = [" ".join(rng.choice(["stone", "house", "été", "x"], int(n))) for n in (2, 90, 7, 30, 90, 1)]
    model = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    length = np.array([len(t.encode()) for t in texts])
    offs = np.append(0, np.cumsum(length))
    within = np.arange(len(data)) - np.repeat(offs[:-1], length)
    step = np.searchsorted([hi for _, hi in lm._steps(int(length.max()))], within, side="right")
    order = np.argsort(step, kind="stable")
    assert len(set(step)) > 5 and (order != np.arange(len(data))).any()
    size, byte, odds, gate = model.predictions(data, offs, 0, order)
    plain_size, plain_byte, plain_odds, plain_gate = model.predictions(data, offs, 0, np.arange(len(data)))
    assert (size == plain_size[order]).all() and (byte == np.repeat(np.arange(len(data)), size)).all()
    begin = np.cumsum(plain_size) - plain_size
    place = np.concatenate([np.arange(begin[i], begin[i] + plain_size[i]) for i in order])
    assert (plain_byte[place] == order[byte]).all() and (odds == plain_odds[:, place]).all() and (gate == plain_gate[place]).all() and len(set(gate)) > 1
