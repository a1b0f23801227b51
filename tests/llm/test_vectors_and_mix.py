"""Embedding near-duplicates, mixing and the pipeline."""

import os

import duckdb
import numpy as np
import pytest

from larkspur.llm import embedding_dedup, mixing
from larkspur.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 500)] + 0.11 * rng.normal(size=(500, 16))
    rows = [(i, v.tolist(), i % 2, 0) for i, v in enumerate(x)]
    rows += [(600, rows[0][1], 0, 0), (601, rows[0][1], None, 0), (602, None, 0, 0), (603, [0.0] * 16, 0, 0), (604, [float("nan")] * 16, 0, 0), (605, [1.0] * 8, 0, 0), (606, [None] * 16, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, shard int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.linked(df, shard=64).collect()}
    sound = [(i, np.array(v), y) for i, v, y, _ in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 16]
    n_links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sound)):
        for b in range(a):
            (i, v, y), (j, w, z) = sound[a], sound[b]
            if y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                n_links[i] += 1
                n_links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert set(got) == set(n_links)
    assert sum(got[i][0] for i in got) >= 0.99 * sum(n_links.values()) > 0
    assert all(got[i][0] <= n_links[i] for i in got)
    assert {i: c for i, (_, c) in got.items()} == {i: find(i) for i in root}
    assert embedding_dedup.linked(df.where("false")).count() == 0


def test_one_id_under_two_labels(spark):
    """Rows of one vec_id with different labels or vectors are different nodes."""
    e = np.eye(4)
    rows = [(1, e[0], "a"), (1, e[1], "b"), (2, e[0] + 0.1 * e[2], "a"), (3, e[1] + 0.1 * e[3], "b"), (1, e[3], "a"), (1, e[0], "a")]
    got = embedding_dedup.linked(spark.createDataFrame([(i, v.tolist(), y) for i, v, y in rows], "vec_id long, embedding array<double>, label string"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_graph_recall():
    rng = np.random.default_rng(6)
    x = embedding_dedup._unit(rng.normal(size=(80, 24))[rng.integers(0, 80, 1500)] + 0.15 * rng.normal(size=(1500, 24)))
    graph = embedding_dedup.Graph(x)
    q, node = graph.within(x, 0.9)
    found = set(zip(q.tolist(), graph.order[node].tolist()))
    wanted = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.9))}
    assert len(found & wanted) >= 0.98 * len(wanted) and len(found - wanted) <= 0.001 * len(wanted) + 5


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", "b", "b", "b", None][i % 6], 7, 8) for i in range(600)]
    rows += [(1, rows[1][1], rows[1][2], 7, 8), (None, "x y", "c", 7, 8), (700, None, "d", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, twin int")
    plan = mixing.plan(df).toPandas()
    sizes = plan.groupby(plan["source"].fillna("~"))["size"].sum()
    goal = plan.groupby(plan["source"].fillna("~"))["target"].first()
    assert goal.sum() == pytest.approx(1.5 * sizes.sum()) and (goal <= 2 * sizes + 1e-9).all()
    taken = (plan["copies"] * plan["size"]).groupby(plan["source"].fillna("~")).sum()
    assert (abs(taken - goal) <= 80).all() and plan["copies"].max() <= 2
    mixed = mixing.mixed(df)
    assert mixed.dtypes == df.dtypes and mixed.count() == plan["copies"].sum()
    assert {r["size"] for r in mixed.select("size").distinct().collect()} == {7}
    assert mixing.plan(df.where("false")).count() == mixing.mixed(df.where("false")).count() == 0


@needs_tables
def test_stages_of_an_empty_table_and_extra_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"{i} words of a text that is told here {i * i}", "en", "s", 1, "x", "y") for i in range(30)] + [(40, None, None, None, None, None, None), (41, "", "en", "s", 0, "x", "y")], "doc_id long, text string, lang string, source string, n_chars long, version string, g string")
    for some in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, some, DIR)
            assert out.dtypes == docs.dtypes
            assert out.count() <= 2 * some.count()
        assert corpus_pipeline.encode(spark, some, DIR).count() == some.count()


def test_mixing_meets_its_targets(spark):
    """Few very long texts beside many short ones, in sources of all kinds: within 1 % or half the largest document."""
    rng = np.random.default_rng(12)
    rows, i = [], 0
    for source in range(20):
        longest = int(rng.choice([50, 400, 2000, 6000]))
        for size in [*rng.integers(0, 60, int(rng.integers(5, 200))), *rng.integers(longest // 2, longest + 1, int(rng.integers(0, 4)))]:
            rows.append((i, "w " * int(size), f"s{source:02}" if source else None))
            i += 1
    rows += [(i, "v " * 70_000, "s05"), (i + 1, "", "s06"), (i + 2, "one", "s99")]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in plan.groupby(plan["source"].fillna("~")):
        missed = abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0])
        assert missed <= max(0.01 * g["target"].iloc[0], g["size"].max() / 2 + 1) and g["copies"].between(0, 2).all()


@needs_tables
def test_mixing_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    for name, sql in [("op9_mixing_systematic", oracle_sql()["op9_mixing_systematic"])]:
        got, want = queries()[name](spark, DIR).toPandas(), con.sql(sql).df()
        key = sorted(want.columns)
        assert sorted(got.columns) == key
        a, b = got[key].sort_values(key).to_numpy(float), want[key].sort_values(key).to_numpy(float)
        assert np.allclose(a, b, rtol=1e-12)


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    from .test_text_operators import brute_removed

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, count, seen = docs.dtypes, docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).toPandas(), docs.schema)
        assert docs.dtypes == columns, name
        seen.append(docs.toPandas())
    assert count > len(seen[0]) > 0.8 * count and len(seen[0]) > len(seen[1])
    assert not seen[1]["text"].duplicated().any()
    want = dict(zip(seen[1]["doc_id"], brute_removed(seen[1]["text"], corpus_pipeline.PASSAGE)))
    cut = dict(zip(seen[2]["doc_id"], seen[2]["text"]))
    for i, (size, gone, _, _) in want.items():
        assert size - gone - 8 <= len(cut[i].encode()) <= size - gone
    words = seen[2]["text"].str.split().str.len()
    assert seen[3]["text"].str.split().str.len().sum() == pytest.approx(1.5 * words.sum(), rel=0.1)
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() == len(seen[3]) and set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


@needs_tables
def test_every_query_runs(spark):
    rows = {name: query(spark, DIR) for name, query in queries().items() if name in ("op1_html_host_suffix_array", "op2_embedding_hnsw", "op7_sentence_spans")}
    tables = {"op1_html_host_suffix_array": "pages", "op2_embedding_hnsw": "embeddings", "op7_sentence_spans": "documents"}
    for name, df in rows.items():
        assert df.count() == spark.read.parquet(f"{DIR}/{tables[name]}.parquet").count()
