"""Distances, exact and approximate search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import vectors
from loomwork.operators import hnsw, knn


def one(spark, f, a, b):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(f("a", "b")).first()[0]


@pytest.mark.parametrize(
    ("f", "a", "b", "expected"),
    [
        (vectors.euclidean, [0.0, 0.0], [3.0, 4.0], 5.0), (vectors.squared_euclidean, [0.0, 0.0], [3.0, 4.0], 25.0),
        (vectors.cosine, [1.0, 0.0], [0.0, 1.0], 1.0), (vectors.cosine, [1.0, 2.0], [1.0, 2.0], 0.0), (vectors.cosine, [0.0, 0.0], [1.0, 2.0], 1.0),
        (vectors.negated_dot, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], -32.0),
    ],
)
def test_distances(spark, f, a, b, expected):
    assert one(spark, f, a, b) == pytest.approx(expected, abs=1e-12)


def test_dimensions_must_agree(spark):
    with pytest.raises(Exception, match="dimension"):
        one(spark, vectors.euclidean, [1.0], [1.0, 2.0])


@pytest.mark.parametrize(("n", "dims", "metric", "gate"), [(500, 16, "euclidean", 0.9), (500, 32, "euclidean", 0.9), (300, 128, "cosine", 0.85), (50, 8, "euclidean", 1.0)])
def test_recall_gates(spark, n, dims, metric, gate):
    rng = np.random.default_rng(42)
    frame = lambda m: spark.createDataFrame([(i, rng.random(dims).tolist()) for i in range(m)], "vec_id long, embedding array<double>")
    data, queries = frame(n), frame(10)
    index = hnsw.build(data, 2, hnsw.Config(), metric, seed=7)
    k = 5 if n == 50 else 10
    truth = knn.knn_batch(data, queries, k, metric)
    assert knn.recall(index.search(queries, k), truth).first()["recall"] >= gate
    assert index.crowded().isEmpty() and index.one_way().isEmpty()


def test_small_graph():
    graph = hnsw.Graph(hnsw.Config(), "euclidean", 5)
    assert graph.search(np.array([25.0]), 3) == []
    for i in range(10):
        graph.insert(i, np.array([10.0 * i]))
    found = graph.search(np.array([25.0]), 4)
    assert found[0][0] in (2, 3) and len(found) == 4 and [d for _, d in found] == sorted(d for _, d in found)
    assert graph.search(np.array([25.0]), 0) == [] and len(graph.search(np.array([25.0]), 99)) == 10


def test_knn_leaves_out_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.id for r in knn.knn(df, [1.0, 0.1], 5, "euclidean").select("id").collect()] == [1, 3]
    assert df.select(F.max(vectors.dimensions("embedding"))).first()[0] == 2


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = spark.createDataFrame([(i, rng.random(8).tolist()) for i in range(60)], "vec_id long, embedding array<double>").cache()
    index = hnsw.build(data, 2, hnsw.Config.small(), "euclidean", seed=3)
    whole = [sorted(map(tuple, df.collect())) for df in (knn.knn_batch(data, data, 4), index.search(data, 4))]
    monkeypatch.setattr(knn, "QUERY_NUMBERS", 200)
    monkeypatch.setattr(hnsw, "QUERY_NUMBERS", 200)
    assert whole == [sorted(map(tuple, df.collect())) for df in (knn.knn_batch(data, data, 4), index.search(data, 4))]


def test_same_seed_same_graph(spark):
    rng = np.random.default_rng(42)
    data = spark.createDataFrame([(i, rng.random(8).tolist()) for i in range(100)], "vec_id long, embedding array<double>").cache()
    query = spark.createDataFrame([(0, [0.5] * 8)], "vec_id long, embedding array<double>")
    a, b = (hnsw.build(data, 1, hnsw.Config(), "euclidean", seed=555) for _ in range(2))
    assert sorted(map(str, a.nodes.collect())) == sorted(map(str, b.nodes.collect()))
    assert a.search(query, 5).collect() == b.search(query, 5).collect()
    stats = a.stats().first()
    assert stats.num_nodes == 100 and stats.entry_points == 1 and a.get(stats.entry_point).first().level == stats.max_layer


def test_wider_beams_find_no_less():
    rng = np.random.default_rng(42)
    data, graph = rng.random((300, 16)), hnsw.Graph(hnsw.Config(), "euclidean", 777)
    for i, v in enumerate(data):
        graph.insert(i, v)
    found = {ef: 0 for ef in (10, 100)}
    for q in np.random.default_rng(99).random((10, 16)):
        truth = set(np.argsort(((data - q) ** 2).sum(1))[:10].tolist())
        for ef in found:
            found[ef] += len(truth & {i for i, _ in graph.search(q, 10, ef)})
    assert found[100] >= found[10]


def test_a_beam_as_wide_as_the_graph_meets_copies_without_links():
    graph = hnsw.Graph(hnsw.Config(), "euclidean", 5)
    for i in range(120):
        graph.insert(i, np.ones(8))
    assert [i for i, _ in graph.search(np.ones(8), 100, 120)] == list(range(100))


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_copies_tie_by_id(spark, metric):
    rng = np.random.default_rng(4)
    rows = np.tile(rng.standard_normal((40, 33)), (9, 1)).tolist()
    data = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").coalesce(1)
    found = knn.knn_batch(data, data.where("vec_id < 7"), 9, metric).orderBy("query_id", "rank").collect()
    one_by_one = [(q, r.id) for q in range(7) for r in knn.knn(data, rows[q], 9, metric).collect()]
    assert [(r.query_id, r.id) for r in found] == one_by_one


def test_graphs_are_built_and_searched_in_blocks(monkeypatch):
    calls = []
    monkeypatch.setattr(hnsw, "distances", lambda a, b, metric, f=hnsw.distances: calls.append(1) or f(a, b, metric))
    rng = np.random.default_rng(5)
    data, graph = rng.random((1200, 8)), hnsw.Graph(hnsw.Config(), "euclidean", 5)
    graph.extend(list(range(1200)), data)
    assert len(calls) < 200  # one by one it took some 100 calls a row
    monkeypatch.setattr(hnsw, "paired", lambda a, b, metric, f=hnsw.paired: calls.append(1) or f(a, b, metric))
    calls.clear()
    d, found = graph.search_all(data[:64], 10)
    assert len(calls) < 200 and (found[:, 0] == np.arange(64)).all()
    assert [i for i, _ in graph.search(data[9], 10)] == found[9].tolist()


def test_blocks_link_as_single_rows_do(monkeypatch):
    data = np.random.default_rng(6).random((180, 8))
    blocks, single = (hnsw.Graph(hnsw.Config(), "euclidean", 7) for _ in range(2))
    blocks.extend(list(range(180)), data)
    monkeypatch.setattr(hnsw, "SCANNED", 0)  # by beams, which are wider than this graph
    for i, v in enumerate(data):
        single.insert(i, v)
    assert list(blocks.rows()) == list(single.rows())
