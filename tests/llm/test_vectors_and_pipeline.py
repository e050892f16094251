"""Vector near-duplicates and the whole pipeline against brute force."""

import importlib.util

import numpy as np
import pytest

from tidewell.llm import embedding
from tidewell.llm.queries import ORACLE_SQL, QUERIES


def brute(ids, x, t):
    size = np.linalg.norm(x, axis=1)
    links = x @ x.T / np.outer(size, size) >= t
    np.fill_diagonal(links, False)
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(links, label[None, :], 2**62).min(axis=1))
        if (low == label).all():
            return links.sum(axis=1), label
        label = low


@pytest.mark.parametrize("rows", [40, 10_000])
def test_vectors(spark, rows):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 20))
    x = np.concatenate([c + rng.normal(size=(12, 20)) * s for c, s in zip(centres, np.linspace(0.02, 0.4, 40), strict=True)] + [np.repeat(centres[:1], 30, axis=0)]).astype(np.float32)
    ids = rng.permutation(len(x)).astype(np.int64)
    n, label = brute(ids, x.astype(float), 0.95)
    good = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    bad = [(10_001, None), (10_002, [0.0] * 20), (10_003, [float("nan")] * 20), (10_004, [1.0] * 3), (10_005, [None] + [1.0] * 19), (10_006, [float("inf")] + [1.0] * 19), (None, [1.0] * 20)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding.dedup_vectors(df, tile_rows=rows).collect()}
    assert len(got) == len(good) + len(bad)
    for i, k, c in zip(ids, n, label, strict=True):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (k, c, c == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad)


def test_vectors_of_another_length_isolate_only_themselves(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0] * 4), (8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.dedup_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (2, 4, True), 5: (2, 4, False), 6: (2, 4, False), 7: (0, 7, True), 8: (0, 8, True)}


def test_vectors_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (2, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.01, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS h1", "3 AS _id", "4 AS m")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.dedup_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)]


def test_tiles_cover_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24)) + 3.0
    x = np.concatenate([c + rng.normal(size=(40, 24)) * 0.05 for c in centres])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = u.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(u.T))
    p, add = embedding._centred(x, axes[:, ::-1], mean)
    assert np.allclose(p @ p.T + add[:, None] + add[None, :], u @ u.T)
    lead = p[:, :6]
    tree = embedding.Cuts(lead[::3], 16)
    leaf = tree.leaf_of(lead)
    assert tree.leaves == 16 and set(leaf) <= set(range(16)) and np.bincount(leaf).max() < 4 * len(x) / 16
    low, high = (np.array([f(lead[leaf == q], axis=0) for q in range(16)]) for f in (np.min, np.max))
    partners = embedding.near_boxes(low, high, np.sqrt(2 - 2 * 0.999))
    assert all((leaf[j] in partners[leaf[i]]) for i, j in zip(*np.nonzero(u @ u.T >= 0.999), strict=True))
    assert sum(map(len, partners)) < 16 * 16 / 2
    same = embedding.Cuts(np.ones((50, 3)), 8)
    assert same.leaves == 1 and (same.leaf_of(np.ones((4, 3))) == 0).all() and (embedding.Cuts(np.zeros((0, 2)), 4).leaf_of(np.ones((2, 2))) == 0).all()


def test_vectors_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id, r.kept) for r in embedding.dedup_vectors(df).collect()} == {(1, 1, True)}
    assert embedding.dedup_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_every_row(spark, name):
    data = "/root/testdata/sf0.001"
    table = "embeddings" if name.startswith("op3") else "documents"
    assert QUERIES[name](spark, data).count() == spark.read.parquet(f"{data}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    made = con.sql(ORACLE_SQL[name])
    assert sorted(made.columns) == cols
    at = [made.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in made.fetchall()), key=repr)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from test_text_operators import AWKWARD, GERMAN, exact_brute, frame, near_brute, near_texts, words

    from tidewell.llm import bpe, mixing
    from tidewell.llm.queries import vocabulary

    texts = [*AWKWARD, *near_texts(), *(words(GERMAN, 30, i) for i in range(60))]
    frame(spark, texts, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    same = exact_brute([texts[i] for i in left])
    left = [left[r[0]] for r in same if r[3]]
    near = near_brute([texts[i] for i in left], 5)
    left = [left[r[0]] for r in near if r[3]]
    ranks, pattern = vocabulary()
    codec = bpe.ByteBPE(bpe.parse_ranks(ranks), pattern)
    rows = out.orderBy("mix_file", "mix_row").collect()
    assert {r.doc_id: r.token_ids for r in rows} == {i: codec.encode(texts[i]) for i in left}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mixed = mixing.mix(docs.join(spark.createDataFrame([(i,) for i in left], "doc_id long"), "doc_id"))
    assert [r.doc_id for r in rows] == [r.doc_id for r in mixed.orderBy("mix_slot", "mix_row").collect()]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").schema.names == docs.schema.names, name
        assert stage(spark, empty, "").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame([(1, "a b", "en", "s", 3)], docs.schema), "").first()
    assert last.mix_file is None and last.n_tokens == 2


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from test_text_operators import GERMAN, words

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, words(GERMAN, 40, 1), "de", "a", 1), (1, words(GERMAN, 40, 2), "de", None, None), (None, words(GERMAN, 40, 3), None, "a", 1), (2, None, None, None, None), (3, "", "de", "a", 0), (4, words(GERMAN, 40, 1), "de", "b", 1), (4, words(GERMAN, 40, 1), "de", "b", 1)]
    extra = {c: F.lit(i) for i, c in enumerate(("_w", "_at", "_hit", "c0", "lang_pred", "score", "alike", "keep_id", "n", "rep", "node", "_sha", "q", "slots", "at", "mix_slot_"))}
    docs = spark.createDataFrame(rows, schema).withColumns(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        kept[name] = sorted((r.doc_id or 0, r.text or "", r.lang or "") for r in out.collect())
        assert all(r.lang_pred == 4 and r.n == 8 for r in out.collect())
    everything = sorted((r[0] or 0, r[1] or "", r[2] or "") for r in rows)
    named = sorted((i, t, x or "de") for i, t, x in everything if t)
    assert kept["language_id"] == named and kept["mixing"] == everything
    first = [(0, rows[2][1], ""), (1, rows[0][1], "de"), (1, rows[1][1], "de"), (2, "", "")]
    assert kept["exact_dedup"] == sorted(first)
    assert kept["minhash_dedup"] == sorted([*first, (3, "", "de")])
