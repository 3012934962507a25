"""Approximate nearest neighbours: a small-world graph in each shard, searched in all of them.

Rows are dealt over shards by a hash of their id. A shard's graph is built in
one task and kept as rows (shard, id, level, vector, neighbours by layer), so
that statistics and checks are DataFrame queries. A search visits every shard
and merges the shards' nearest rows; a beam as wide as a shard meets all of its
rows, so there the shard is compared in full.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisFailure
from ..functions import vectors
from ..sources.shared import new_folder, ship
from .knn import QUERY_NUMBERS, distances, nearest, paired

#: Points of a graph up to which comparing a new one with all of them costs less than a beam.
SCANNED = 1 << 17
#: Distances, or marks of points seen, that are held at once.
AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Config:
    """m: links a node makes per layer; twice that many may stay on the lowest layer."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    @property
    def m_max(self) -> int:
        return 2 * self.m

    @property
    def ml(self) -> float:
        return 1 / math.log(self.m)

    @classmethod
    def small(cls) -> Config:
        return cls(8, 100, 20)


@dataclass
class Graph:
    """One shard's graph. Nodes are known by their position; ids are those of the rows."""

    config: Config = field(default_factory=Config)
    metric: str = vectors.DEFAULT_METRIC
    seed: int = 0

    def __post_init__(self):
        self.ids: list[int] = []
        self.at: dict[int, int] = {}
        self.data = np.zeros((0, 0))
        self.links: list[list[dict[int, float]]] = []  # by node and layer: others, with their distances
        self.layers: list[list[int]] = []  # nodes by layer, in order
        self._packed: list[np.ndarray] | None = None
        self.entry: int | None = None
        self._rng = np.random.default_rng(self.seed)

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def max_layer(self) -> int:
        return len(self.links[self.entry]) - 1 if self.entry is not None else 0

    def _distances(self, query: np.ndarray, nodes: list[int]) -> list[float]:
        return distances(query[None, :], self.data[nodes], self.metric)[0].tolist()

    def draw_level(self) -> int:
        return int(-math.log(1 - self._rng.random()) * self.config.ml)

    def search_layer(self, query: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """Up to ef nodes near query, nearest first: always open the nearest one not yet opened."""
        seen = set(starts)
        reached = list(zip(self._distances(query, starts), starts))
        heapq.heapify(reached)
        best = heapq.nsmallest(ef, reached)
        best = [(-d, -n) for d, n in best]
        heapq.heapify(best)  # the farthest first
        while reached:
            d, node = heapq.heappop(reached)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [n for n in self.links[node][layer] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for dist, n in zip(self._distances(query, fresh), fresh):
                if len(best) < ef:
                    heapq.heappush(best, (-dist, -n))
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, -n))
                else:
                    continue
                heapq.heappush(reached, (dist, n))
        return sorted((-d, -n) for d, n in best)

    def _descend(self, query: np.ndarray, down_to: int) -> list[int]:
        """The entry point of layer down_to, after greedy steps on the layers above."""
        starts = [self.entry]
        for layer in range(self.max_layer, down_to, -1):
            starts = [self.search_layer(query, starts, 1, layer)[0][1]]
        return starts

    def _add(self, ids: list[int], x: np.ndarray) -> None:
        """Nodes without links, with their levels drawn."""
        if not np.isfinite(x).all():
            raise AnalysisFailure("a vector has a component that is no finite number")
        n = len(self.ids)
        if n == 0:
            self.data = np.zeros((16, x.shape[1]))
        elif self.data.shape[1] != x.shape[1]:
            raise AnalysisFailure("vector dimension mismatch")
        for at, id_ in enumerate(ids, n):
            if id_ in self.at:
                raise AnalysisFailure(f"id {id_} is in the index already")
            self.at[id_] = at
            self.links.append([{} for _ in range(self.draw_level() + 1)])
        while n + len(ids) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[n : n + len(ids)] = x
        self.ids += ids
        self._packed = None

    def insert(self, id_: int, vector) -> None:
        self.extend([id_], np.asarray(vector, np.float64)[None, :])

    def extend(self, ids: list[int], x: np.ndarray) -> None:
        """Insert rows one after the other; a graph that isn't too large is compared with a block of them at once, a larger one is searched for each."""
        at = 0
        while at < len(ids):
            done = len(self.ids)
            size = max(1, min(256, AT_ONCE // (done + 1))) if done < SCANNED else 1
            new, block = ids[at : at + size], x[at : at + size]
            at += size
            self._add(new, block)
            near = self._scan(done) if done < SCANNED else None
            for n in range(done, len(self.ids)):
                self._connect(n, near and near[n - done])

    def _scan(self, done: int) -> list[list[tuple[float, int]]]:
        """For each node from done on, the m nearest of those before it on the lowest layer."""
        n = len(self.ids)
        d = distances(self.data[done:n], self.data[:n], self.metric)
        d[np.arange(n)[None, :] >= np.arange(done, n)[:, None]] = np.inf
        most = min(self.config.m, n)
        found = np.argpartition(d, most - 1, axis=1)[:, :most]
        d = np.take_along_axis(d, found, 1)
        return [sorted((x, o) for x, o in zip(*row) if x < math.inf) for row in zip(d.tolist(), found.tolist())]

    def _connect(self, n: int, near0: list[tuple[float, int]] | None) -> None:
        """Link a node to the nearest of those before it; near0: these on the lowest layer, if a scan has found them."""
        level, top, query, m = len(self.links[n]) - 1, self.max_layer, self.data[n], self.config.m
        if self.entry is not None:
            starts = None if near0 is not None else self._descend(query, min(level, top))
            for layer in range(min(level, top), -1, -1):
                if starts is not None:
                    near = self.search_layer(query, starts, self.config.ef_construction, layer)
                    starts = [node for _, node in near]
                elif layer:
                    near = sorted(zip(self._distances(query, self.layers[layer]), self.layers[layer]))
                else:
                    near = near0
                self._link(n, layer, near[:m])
        for layer in range(1, level + 1):
            while layer >= len(self.layers):
                self.layers.append([])
            self.layers[layer].append(n)
        if self.entry is None or level > top:
            self.entry = n

    def _link(self, n: int, layer: int, near: list[tuple[float, int]]) -> None:
        """Links at both ends. A node keeps its nearest; what goes, goes at both ends."""
        most = self.config.m_max if layer == 0 else self.config.m
        for d, other in near:
            theirs = self.links[other][layer]
            self.links[n][layer][other] = theirs[n] = d
            if len(theirs) > most:
                _, far = max(zip(theirs.values(), theirs))
                del theirs[far], self.links[far][layer][other]

    def search(self, query, k: int, ef: int | None = None) -> list[tuple[int, float]]:
        """(id, distance) of about the k nearest, nearest first, ties by id."""
        d, i = self.search_all(np.asarray(query, np.float64)[None, :], k, ef)
        return [(id_, x) for id_, x in zip(i[0].tolist(), d[0].tolist()) if x < math.inf]

    def search_all(self, q: np.ndarray, k: int, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of about the k nearest of each row of q, nearest first, ties by id; infinity where fewer are found."""
        n = len(self.ids)
        if self.entry is None or k <= 0:
            return np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        if q.shape[1] != self.data.shape[1]:
            raise AnalysisFailure("vector dimension mismatch")
        ids, ef = np.array(self.ids, np.int64), max(ef or self.config.ef_search, k)
        if ef >= n:
            return nearest(q, ids, self.data[:n], k, self.metric)
        if self._packed is None:
            self._packed = self._pack()
        found = []
        step = max(16, min(64, AT_ONCE // n))  # few, so that what they touch stays in the cache
        for at in range(0, len(q), step):
            part = q[at : at + step]
            nodes = np.full((len(part), 1), self.entry)
            for layer in range(self.max_layer, 0, -1):
                nodes, _ = self._beams(part, nodes, 1, layer)
            nodes, d = self._beams(part, nodes, ef, 0)
            names = ids[nodes]
            order = np.lexsort((names, d), axis=1)[:, :k]
            found.append((np.take_along_axis(d, order, 1), np.take_along_axis(names, order, 1)))
        if not found:
            return np.zeros((0, k)), np.zeros((0, k), np.int64)
        return tuple(map(np.concatenate, zip(*found)))

    def _pack(self) -> list[np.ndarray]:
        """Neighbours by layer, a row for each node, filled up with -1; of higher layers, all other nodes' rows are empty."""
        out = []
        for layer in range(self.max_layer + 1):
            links = np.full((len(self.ids), max(1, max(len(node[layer]) for node in self.links if len(node) > layer))), -1, np.int32)
            for n, node in enumerate(self.links):
                if len(node) > layer:
                    links[n, : len(node[layer])] = sorted(node[layer])
            out.append(links)
        return out

    def _beams(self, q: np.ndarray, starts: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) by search_layer for all queries at once, from one start each, in no order; infinitely far where there are fewer than ef."""
        links, width = self._packed[layer], self._packed[layer].shape[1]
        seen = np.zeros((len(q), len(self.ids)), bool)
        out_nodes, out_d = np.zeros((len(q), ef), np.int64), np.full((len(q), ef), np.inf)
        nodes, d = np.full((len(q), ef + width), -1), np.full((len(q), ef + width), np.inf)  # a beam, and room for what it meets; ~node once opened
        nodes[:, :1], d[:, 0] = starts, paired(q, self.data[starts[:, 0]], self.metric)
        at = each = np.arange(len(q))  # the queries that aren't done
        seen[at, starts[:, 0]] = True
        while len(at):
            pick = np.where(nodes[:, :ef] >= 0, d[:, :ef], np.inf).argmin(axis=1)
            node = nodes[each, pick]
            done = node < 0
            if done.any():
                out_nodes[at[done]], out_d[at[done]] = np.where(nodes[done, :ef] < 0, ~nodes[done, :ef], 0), d[done, :ef]
                at, nodes, d, pick, node = (a[~done] for a in (at, nodes, d, pick, node))
                each = np.arange(len(at))
                if not len(at):
                    break
            nodes[each, pick] = ~node
            others = links.take(node, axis=0)
            row, col = np.nonzero((others >= 0) & ~seen[at[:, None], others])
            fresh = others[row, col]
            seen[at[row], fresh] = True
            nodes[:, ef:], d[:, ef:] = others, np.inf
            d[row, ef + col] = paired(q.take(at[row], axis=0), self.data.take(fresh, axis=0), self.metric)
            best = np.argpartition(d, ef - 1, axis=1)[:, :ef]
            nodes[:, :ef], d[:, :ef] = np.take_along_axis(nodes, best, 1), np.take_along_axis(d, best, 1)
            nodes[:, :ef][d[:, :ef] == np.inf] = -1
        return out_nodes, out_d

    def rows(self) -> Iterator[tuple[int, int, list[float], list[list[int]], bool]]:
        """(id, level, vector, neighbour ids by layer, whether it is the entry point) of every node."""
        for n, id_ in enumerate(self.ids):
            yield id_, len(self.links[n]) - 1, self.data[n].tolist(), [sorted(self.ids[o] for o in layer) for layer in self.links[n]], n == self.entry

    @classmethod
    def restored(cls, pdf: pd.DataFrame, config: Config, metric: str) -> Graph:
        """For searches: its links have no distances and so can't be added to."""
        self = cls(config, metric)
        self.ids = pdf["id"].tolist()
        self.at = {i: n for n, i in enumerate(self.ids)}
        self.data = np.stack(pdf["vector"].tolist()).astype(np.float64)
        self.links = [[dict.fromkeys((self.at[o] for o in layer.tolist()), math.nan) for layer in row] for row in pdf["neighbours"]]
        self.entry = int(np.argmax(pdf["entry"].to_numpy()))
        return self


NODES = "shard int, id long, level int, vector array<double>, neighbours array<array<long>>, entry boolean"


@dataclass
class Index:
    """A sharded index: its nodes as a DataFrame, with the metric that it was built for."""

    nodes: DataFrame
    config: Config
    metric: str
    dims: int
    shards: int

    def search(self, queries: DataFrame, k: int, ef: int | None = None, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
        """(query_id, id, dist, rank) for all rows of queries, in blocks of a bounded size that meet every shard; nothing passes the driver."""
        rows = queries.select(F.col(id_).cast("long").alias("q"), vectors.vector(vector).alias("v"))
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.size("v").eqNullSafe(F.lit(self.dims)), 1)).alias("bad")).first()
        if found["bad"]:
            raise AnalysisFailure("vector dimension mismatch")
        blocks = max(1, -(-2 * found["n"] * max(1, self.dims) // QUERY_NUMBERS))  # by a hash, so none gets twice its share
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = rows.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("shard", every(self.shards))
        nodes = self.nodes.withColumn("block", every(blocks))
        config, metric = self.config, self.metric

        def search(block: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            graph = Graph.restored(pdf, config, metric) if len(pdf) and len(block) else None
            d, i = graph.search_all(np.stack(block["v"].tolist()).astype(np.float64), k, ef) if graph else (np.zeros((0, 0)), np.zeros((0, 0), np.int64))
            near = pd.DataFrame({"query_id": np.repeat(block["q"].to_numpy(np.int64)[: len(d)], d.shape[1]), "id": i.ravel(), "dist": d.ravel()})
            return near[near["dist"] < np.inf]

        out = asked.groupBy("shard", "block").cogroup(nodes.groupBy("shard", "block")).applyInPandas(search, "query_id long, id long, dist double")
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k)

    def stats(self) -> DataFrame:
        """One row: num_nodes, max_layer, avg_neighbors_layer0 (0 if empty), entry_point, entry_points.

        entry_point is the entry of the shard whose graph is highest, the smallest id of several, NULL if there are no nodes.
        """
        top = F.when(F.col("entry"), F.struct((-F.col("level")).alias("down"), "id"))
        return self.nodes.agg(
            F.count(F.lit(1)).alias("num_nodes"),
            F.coalesce(F.max("level"), F.lit(0)).alias("max_layer"),
            F.coalesce(F.avg(F.size(F.get("neighbours", F.lit(0)))), F.lit(0.0)).alias("avg_neighbors_layer0"),
            F.min(top)["id"].alias("entry_point"),
            F.coalesce(F.sum(F.col("entry").cast("long")), F.lit(0)).alias("entry_points"),
        )

    def get(self, id_: int) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def edges(self) -> DataFrame:
        """(shard, layer, src, dst)."""
        layers = self.nodes.select("shard", F.col("id").alias("src"), F.posexplode("neighbours").alias("layer", "others"))
        return layers.select("shard", "layer", "src", F.explode("others").alias("dst"))

    def crowded(self) -> DataFrame:
        """(layer, src, degree) of nodes with more links than the layer allows; there should be none."""
        most = F.when(F.col("layer") == 0, self.config.m_max).otherwise(self.config.m)
        return self.edges().groupBy("layer", "src").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > most)

    def one_way(self) -> DataFrame:
        """(layer, src, dst) of links without their reverse; there should be none."""
        e = self.edges().select("layer", "src", "dst")
        back = e.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"))
        return e.join(back, ["layer", "src", "dst"], "left_anti")


def build(df: DataFrame, shards: int = 1, config: Config | None = None, metric: str = vectors.DEFAULT_METRIC, seed: int = 0, vector: str = "embedding", id_: str = "vec_id") -> Index:
    """An index over df, written to the shared folder. Choose shards so that each holds some thousand rows; ids have to be unique."""
    vectors.distance(metric)
    config = config or Config()
    ship(df.sparkSession)
    rows = df.select(F.col(id_).cast("long").alias("id"), vectors.vector(vector).alias("vector"))
    found = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"), F.count(F.when(F.col("vector").isNull() | F.col("id").isNull(), 1)).alias("nulls")).first()
    if found["nulls"]:
        raise AnalysisFailure("an id or a vector is NULL")
    if found["a"] != found["b"]:
        raise AnalysisFailure("vector dimension mismatch")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["shard"].iloc[0])
        graph = Graph(config, metric, seed + number)
        pdf = pdf.sort_values("id")
        graph.extend(pdf["id"].tolist(), np.stack(pdf["vector"].tolist()).astype(np.float64))
        out = pd.DataFrame(graph.rows(), columns=["id", "level", "vector", "neighbours", "entry"])
        out.insert(0, "shard", number)
        return out

    path = new_folder(df.sparkSession, "graph")  # built once, whatever is asked of it
    rows.repartitionById(shards, "shard").groupBy("shard").applyInPandas(shard, NODES).write.parquet(path)  # a task for each shard
    return Index(df.sparkSession.read.schema(NODES).parquet(path), config, metric, found["a"] or 0, shards)
