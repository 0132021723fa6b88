import corpus_pipeline
import numpy as np
import pytest
from aksharflow.llm import exact_dedup, mixing, packing, simhash, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(160):
        text = list(rng.choice(words, 60))
        if i % 5 == 0:
            for k in range(4):
                text[k * 7] = "blorgy"
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(1, 9)]
    rows += [(300 + i, rows[i][1].replace(" ", " extra ", 1), "en", "s1", 0) for i in range(11, 14)]
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (None, "alone here", "en", "s1", 0), (402, "x " * 40_000, "en", "s2", 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    run = lambda name, d: stages[name](spark, d, folder)
    clean = run("toxicity", docs)
    assert clean.columns == columns and set(ids(docs)) - set(ids(clean)) == {i for i in range(0, 160, 5)} | {205}
    unique = run("exact_dedup", clean)
    assert unique.columns == columns and set(ids(clean)) - set(ids(unique)) == {200 + i for i in range(1, 9)} - {205}
    single = run("simhash_dedup", unique)
    assert single.columns == columns and set(ids(unique)) - set(ids(single)) == {311, 312, 313}
    mixed = run("mixing", single)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixing_rates(single).collect()}
    assert mixed.columns == columns and ids(mixed) == sorted(-1 if i is None else i for i, n in copies.items() for _ in range(n))
    packed = run("packing", mixed)
    tokens = mixed.select(F.sum(F.size(F.filter(F.split("text", " "), lambda t: t != "")))).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == tokens
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, packed.collect()), key=str)
    _ = (exact_dedup, packing, simhash, toxicity)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if set(out.columns) == set(docs.columns):
            docs = out
