"""Exact nearest neighbours, and recall against them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisFailure
from ..functions import vectors
from ..plans import planner
from ..plans.statements import Nearest
from ..sources.shared import ship

#: Queries that a task compares with its rows at once.
BLOCK = 256
#: Numbers in the vectors of a block of queries, 8 bytes each; more queries go in several blocks.
QUERY_NUMBERS = 1 << 23
#: Pairs of vectors whose distances are computed pair by pair at once.
PAIRS = 1 << 16


def knn(df: DataFrame, query, k: int, metric: str = vectors.DEFAULT_METRIC, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(id, dist) of the k rows nearest to query, ties by id, null vectors left out: one top-k operator over a scan of two columns."""
    return df.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), vectors.distance(metric)(vector, query).alias("dist")).orderBy("dist", "id").limit(k)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The matrix of distances between the rows of a and of b, in double precision."""
    dot = a @ b.T
    if metric == "dot":
        return -dot
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    if metric == "euclidean":
        return np.sqrt(np.maximum(na[:, None] + nb[None, :] - 2 * dot, 0))
    norms = np.sqrt(na)[:, None] * np.sqrt(nb)[None, :]
    return np.where(norms == 0, 1.0, 1 - dot / np.where(norms == 0, 1, norms))


def paired(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of a from the row of b beside it; unlike a product of matrices the same wherever the rows stand, so copies tie."""
    if metric == "euclidean":
        diff = a - b
        return np.sqrt(np.einsum("kd,kd->k", diff, diff))
    dot = np.einsum("kd,kd->k", a, b)
    if metric == "dot":
        return -dot
    norms = np.sqrt(np.einsum("kd,kd->k", a, a)) * np.sqrt(np.einsum("kd,kd->k", b, b))
    return np.where(norms == 0, 1.0, 1 - dot / np.where(norms == 0, 1, norms))


def nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k rows of x nearest to each row of q, nearest first, ties by id; one row for each query.

    A product of matrices leaves what is within its rounding of the k-th; those pairs are then computed one by one.
    """
    k = min(k, len(x))
    best_d, best_i = np.zeros((len(q), k)), np.zeros((len(q), k), np.int64)
    if not k:
        return best_d, best_i
    nx = (x * x).sum(axis=1)
    for at in range(0, len(q), BLOCK):
        block = q[at : at + BLOCK]
        d, nq = block @ x.T, (block * block).sum(axis=1)[:, None]  # what grows with the distance, and its rounding
        if metric == "cosine":
            norms = np.sqrt(nq) * np.sqrt(nx)
            d, off = np.where(norms == 0, 1.0, 1 - d / np.where(norms == 0, 1, norms)), 1e-12
        elif metric == "euclidean":
            d, off = nq + nx - 2 * d, 1e-12 * (nq + nx.max())
        else:
            d, off = -d, 1e-12 * (nq + nx.max())
        row, col = np.nonzero(~(d > np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2 * off))  # NaN stays, and comes last
        exact = np.concatenate([paired(block.take(row[i : i + PAIRS], axis=0), x.take(col[i : i + PAIRS], axis=0), metric) for i in range(0, len(row), PAIRS)])
        order = np.lexsort((ids[col], exact, row))
        first = np.searchsorted(row, np.arange(len(block)))[:, None] + np.arange(k)
        best_d[at : at + BLOCK], best_i[at : at + BLOCK] = exact[order][first], ids[col[order]][first]
    return best_d, best_i


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = vectors.DEFAULT_METRIC, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(query_id, id, dist, rank) of the k rows nearest to each query, block by block of a bounded size.

    Each task keeps the k nearest of its own rows for every query, so what is
    shuffled are k rows a task and query; ranks are then given per query.
    """
    vectors.distance(metric)
    asked = queries.select(F.col(id_).cast("long").alias(id_), vectors.vector(vector).alias(vector))
    size = asked.agg(F.sum(F.size(vector)).alias("n")).first()["n"] or 0
    if size > QUERY_NUMBERS:
        blocks = 2 * -(-size // QUERY_NUMBERS)  # by a hash, so none gets twice its share
        part = F.pmod(F.xxhash64(id_), F.lit(blocks))
        return reduce(DataFrame.unionByName, (knn_batch(df, asked.where(part == b), k, metric, vector, id_) for b in range(blocks)))
    rows = asked.select(F.col(id_).alias("q"), F.col(vector).alias("v")).collect()
    if not rows:
        return df.sparkSession.createDataFrame([], "query_id long, id long, dist double, rank int")
    shared = df.sparkSession.sparkContext.broadcast((np.array([r.q for r in rows], np.int64), np.array([r.v for r in rows], np.float64)))

    def tops(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        best_d = np.full((len(q), 0), np.inf)
        best_i = np.zeros((len(q), 0), np.int64)
        for pdf in batches:
            if pdf.empty:
                continue
            ids, x = pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].tolist()).astype(np.float64)
            if x.shape[1] != q.shape[1]:
                raise ValueError("vector dimension mismatch")
            new_d, new_i = nearest(q, ids, x, k, metric)
            d, i = np.concatenate([best_d, new_d], axis=1), np.concatenate([best_i, new_i], axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        n = best_d.shape[1]
        yield pd.DataFrame({"query_id": np.repeat(names, n), "id": best_i.ravel(), "dist": best_d.ravel()})

    ship(df.sparkSession)
    rows_ = df.select(F.col(id_).cast("long").alias("id"), vectors.vector(vector).alias("v")).where("v is not null")
    found = rows_.mapInPandas(tops, "query_id long, id long, dist double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall, the mean over queries of the share of true neighbours found. Both have query_id and id."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    each = hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return each.agg(F.avg("share").alias("recall"))


def nearest_statement(df: DataFrame, statement: Nearest, tie_break: list[str] | None = None) -> DataFrame:
    """SELECT ... ORDER BY vector <metric> [query] LIMIT k, exactly; ties by the order of insertion or tie_break."""
    kind = planner.field_of(df, statement.vector).simpleString()
    if kind not in ("array<double>", "array<float>"):
        raise AnalysisFailure(f"column {statement.vector} is no vector")
    names = planner.visible(df) if statement.columns is None else list(statement.columns)
    for name in names:
        planner.field_of(df, name)
    ties = [planner.SEQ] if planner.SEQ in df.columns else tie_break or []
    out = df.where(planner.condition(df, statement.where)) if statement.where is not None else df
    d = vectors.distance(statement.metric)(planner.quoted(statement.vector), statement.query)
    return out.orderBy(d.asc_nulls_last(), *[planner.quoted(t) for t in ties]).limit(statement.limit).select(*[planner.quoted(n) for n in names])
