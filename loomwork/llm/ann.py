"""Embedding near-duplicates: HNSW graphs per shard, every shard queried, recall audited.

Equal vectors are one point. Points are dealt by a hash over shards of bounded
size; each shard builds a hierarchical navigable small-world graph, inserting
points in blocks that grow with the graph. Every block of queries visits every
shard. A beam that comes back full of links is widened, and beyond MAX_BEAM the
query is compared with the shard in full, so no number of links is too many. In
each task an audit compares sampled points, moved until their cosine with
themselves is about the limit, with the whole shard: the beam is doubled until
the audit's recall passes, and if no beam passes the shard is scanned. Links are
verified in double precision. A shard answers with the number of links and the
local components they lead to, never with all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, ship, table
from .components import components

LIMIT = 0.9
#: Points of a shard and of a block of queries, about.
SHARD = 16_384
#: Shards at least, so that a small table also runs in parallel.
LEAST_SHARDS = 4
M, BUILD_BEAM, BEAM, MAX_BEAM = 12, 48, 24, 384
AUDIT, RECALL = 96, 0.99


class Hnsw:
    """A graph over unit vectors (float32); layer 0 has all points, higher ones a share 1/M of those below."""

    def __init__(self, x: np.ndarray, m: int = M, build_beam: int = BUILD_BEAM, seed: int = 0):
        self.x, self.m = np.ascontiguousarray(x, np.float32), m
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(np.int64), 6) if n else np.zeros(0, np.int64)
        self.layers: list[np.ndarray] = []
        self.inside: list[np.ndarray] = []
        for layer in range(int(self.level.max(initial=0)) + 1):
            inside = np.nonzero(self.level >= layer)[0]
            self.inside.append(inside)
            self.layers.append(np.full((n if layer == 0 else len(inside), 2 * m), -1, np.int32))
        # higher layers first: they route the insertions below
        for layer in range(len(self.layers) - 1, -1, -1):
            self._build(layer, build_beam)

    @classmethod
    def restored(cls, x: np.ndarray, inside: list[np.ndarray], layers: list[np.ndarray]) -> Hnsw:
        self = cls.__new__(cls)
        self.x, self.m, self.inside, self.layers = np.ascontiguousarray(x, np.float32), layers[0].shape[1] // 2, inside, layers
        return self

    def _select(self, points: np.ndarray, own: np.ndarray, cands: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to most of each row's candidates: first those nearer to the row than to one chosen before, then the nearest others."""
        out = np.full((len(own), most), -1, np.int32)
        for at in range(0, len(own), 512):
            c, s = cands[at : at + 512], sims[at : at + 512]
            order = np.argsort(-s, axis=1, kind="stable")
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            v = points[np.maximum(c, 0)]
            between = v @ v.transpose(0, 2, 1)
            good = c >= 0
            kept = np.zeros_like(good)
            number = np.zeros(len(c), np.int64)
            for j in range(c.shape[1]):
                blocked = (kept & (between[:, j, :] > s[:, j : j + 1])).any(axis=1)
                kept[:, j] = good[:, j] & ~blocked & (number < most)
                number += kept[:, j]
            rank = np.where(kept, 0, np.where(good, 1, 2))
            first = np.argsort(rank, axis=1, kind="stable")[:, :most]
            chosen = np.take_along_axis(c, first, 1)
            out[at : at + 512, : chosen.shape[1]] = chosen
        return out

    def _build(self, layer: int, beam: int) -> None:
        inside, links = self.inside[layer], self.layers[layer]
        points = self.x[inside]
        n, cap = len(inside), links.shape[1]
        done = 0
        while done < n:
            size = min(n - done, 64 if not done else min(256, done))
            new = np.arange(done, done + size)
            q = points[new]
            among = q @ q.T
            among[np.arange(size)[:, None] <= np.arange(size)[None, :]] = -np.inf  # a point sees those before it
            k = min(beam, size)
            near = np.argpartition(-among, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(among, near, 1)
            c = np.where(s > -np.inf, new[near], -1)
            if done:
                start = self._start(layer, q, done)
                ids, sims = _beam(points[:done], links[:done], q, start, min(beam, done))
                c, s = np.concatenate([c, ids], 1), np.concatenate([s, np.where(ids >= 0, sims, -np.inf)], 1)
            chosen = self._select(points, new, c, s, self.m)
            links[new, : self.m] = chosen
            src, dst = np.repeat(new, self.m), chosen.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            self._back(points, links, dst, src, cap)
            done += size

    def _back(self, points: np.ndarray, links: np.ndarray, old: np.ndarray, new: np.ndarray, cap: int) -> None:
        """Links from old to new; nodes with too many choose again."""
        order = np.argsort(old, kind="stable")
        old, new = old[order], new[order]
        nodes, first, number = np.unique(old, return_index=True, return_counts=True)
        most = int(min(number.max(initial=0), 2 * cap))
        extra = np.full((len(nodes), most), -1, np.int32)
        place = np.arange(len(old)) - np.repeat(first, number)
        fits = place < most
        extra[np.repeat(np.arange(len(nodes)), number)[fits], place[fits]] = new[fits]
        both = np.concatenate([links[nodes], extra], axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        full = (both >= 0).sum(axis=1) > cap
        links[nodes[~full]] = both[~full][:, :cap]
        if full.any():
            c = both[full]
            own = nodes[full]
            s = np.concatenate([np.where(c[k : k + 512] >= 0, np.einsum("bcd,bd->bc", points[np.maximum(c[k : k + 512], 0)], points[own[k : k + 512]]), -np.inf) for k in range(0, len(own), 512)])
            links[own] = self._select(points, own, c, s, cap)

    def _start(self, layer: int, q: np.ndarray, done: int | None = None) -> np.ndarray:
        """Entry points of the layer for each query, found through the layers above; as positions in the layer."""
        above = [k for k in range(layer + 1, len(self.layers)) if len(self.inside[k])]
        if not above:
            return np.zeros((len(q), 1), np.int64)
        start = None
        for k in reversed(above):
            points = self.x[self.inside[k]]
            if start is None:
                start = np.zeros((len(q), 1), np.int64)
            ids, sims = _beam(points, self.layers[k], q, start, min(8, len(points)))
            ids = np.where(ids >= 0, ids, ids[:, :1])
            names = self.inside[k][ids]
            start = np.searchsorted(self.inside[k - 1], names)
        if done is not None:
            start = np.where(start < done, start, start.min(axis=1, keepdims=True))
            start = np.where(start < done, start, 0)
        return start

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of up to beam points near each query; -1 where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        ids, sims = [], []
        step = max(16, min(512, (1 << 23) // max(1, len(self.x))))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, s = _beam(self.x, self.layers[0], part, self._start(0, part), min(beam, len(self.x)))
            ids.append(i)
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once; each step opens the width best points of every beam."""
    n, rows = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    start = np.sort(start, axis=1)[:, : max(1, beam)]
    fresh = np.concatenate([np.ones((len(q), 1), bool), start[:, 1:] != start[:, :-1]], axis=1)
    ids = np.full((len(q), beam), -1, np.int64)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    shut = np.ones((len(q), beam), bool)
    k = start.shape[1]
    ids[:, :k] = np.where(fresh, start, -1)
    sims[:, :k] = np.where(fresh, np.einsum("qkd,qd->qk", x[start], q), -np.inf)
    shut[:, :k] = ~fresh
    seen[rows[:, None], start] = True
    active = rows
    while len(active):
        a_ids, a_sims, a_shut = ids[active], sims[active], shut[active]
        s = np.where(a_shut, -np.inf, a_sims)
        w = min(width, beam)
        pick = np.argpartition(-s, w - 1, axis=1)[:, :w]
        open_ = np.take_along_axis(s, pick, 1) > -np.inf
        np.put_along_axis(a_shut, pick, True, 1)
        near = links[np.take_along_axis(a_ids, pick, 1)]
        near = np.where(open_[:, :, None], near, -1).reshape(len(active), -1).astype(np.int64)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        safe = np.maximum(near, 0)
        new &= ~seen[active[:, None], safe]
        r, c = np.nonzero(new)
        seen[active[r], near[r, c]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("kd,kd->k", x[near[r, c]], q[active[r]])
        all_sims = np.concatenate([a_sims, got], 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        all_ids = np.concatenate([a_ids, near], 1)
        all_shut = np.concatenate([a_shut, ~new], 1)
        ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        shut[active] = np.take_along_axis(all_shut, best, 1)
        active = active[(~shut[active] & (sims[active] > -np.inf)).any(axis=1)]
    ids[sims == -np.inf] = -1
    return ids, sims


def unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else very large or small components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _audited_beam(graph: Hnsw, x: np.ndarray, limit: float, seed: int) -> int | None:
    """The least beam, doubled from BEAM, whose search finds the audit's links; None if none does."""
    rng = np.random.default_rng(seed)
    own = rng.permutation(len(x))[:AUDIT]
    noise = rng.standard_normal((len(own), x.shape[1]))
    if x.shape[1] < 2:
        return None
    noise -= (noise * x[own]).sum(axis=1, keepdims=True) * x[own]
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    near = min(1.0, limit + 0.25 * (1 - limit))
    q = near * x[own] + math.sqrt(max(0.0, 1 - near * near)) * noise
    truth = q @ x.T >= limit
    beam = BEAM
    while beam <= MAX_BEAM:
        ids, sims = graph.search(q, beam)
        hit = (ids >= 0) & (sims >= limit - 1e-4)
        full = hit.all(axis=1)  # such queries are widened one by one later
        found = np.zeros_like(truth)
        r, c = np.nonzero(hit)
        found[r, ids[r, c]] = True
        wanted = truth & ~full[:, None]
        if (found & wanted).sum() >= RECALL * wanted.sum():
            return beam
        beam *= 2
    return None


def _links(graph: Hnsw, x: np.ndarray, q: np.ndarray, limit: float, seed: int):
    """Batches (rows of q, points of x) of all found pairs with cosine >= limit, in double precision."""
    beam = _audited_beam(graph, x, limit, seed)
    todo = np.arange(len(q))
    while beam is not None and len(todo):
        again = []
        for at in range(0, len(todo), 2048):
            rows = todo[at : at + 2048]
            ids, sims = graph.search(q[rows], beam)
            hit = (ids >= 0) & (sims >= limit - 1e-4)
            full = hit.all(axis=1) & (ids.shape[1] < len(x))
            again.append(rows[full])
            r, c = np.nonzero(hit & ~full[:, None])
            i, j = rows[r], ids[r, c]
            for k in range(0, len(i), 1 << 17):
                right = np.einsum("kd,kd->k", q[i[k : k + (1 << 17)]], x[j[k : k + (1 << 17)]]) >= limit
                yield i[k : k + (1 << 17)][right], j[k : k + (1 << 17)][right]
        todo = np.concatenate(again)
        beam *= 4
        if beam > MAX_BEAM:
            break
    for at in range(0, len(todo), 128):  # the exact way: all of the shard
        rows = todo[at : at + 128]
        r, c = np.nonzero(q[rows] @ x.T >= limit)
        yield rows[r], c


def _roots(n: int, pairs) -> np.ndarray:
    """Number of the first point of each point's component, the pairs coming in batches."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root = above
    return root


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, shard: int = SHARD, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing and is its own component. Vectors of different lengths
    never link. Equal vectors, also under one vec_id, link with each other as
    all others do. Other columns, labels too, are ignored; an empty table gives
    no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(valid, F.transform("embedding", lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0
    points = cut(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")).withColumn("point", F.xxhash64("embedding")))
    n = points.count()
    shards = max(least_shards, math.ceil(n / shard))
    home = points.withColumn("shard", F.pmod("point", F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point", kind="stable", ignore_index=True)
        x = unit(pdf["embedding"].tolist())
        seed = int(pdf["shard"].iloc[0])
        graph = Hnsw(x, seed=seed)
        root = _roots(len(x), _links(graph, x, x, limit, seed))
        return pd.DataFrame({
            "dim": [x.shape[1]], "shard": [seed], "x": [x.tobytes()], "point": [pdf["point"].to_numpy(np.int64).tobytes()],
            "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "root": [root.astype(np.int64).tobytes()],
            "inside": [[i.astype(np.int64).tobytes() for i in graph.inside]], "layers": [[k.tobytes() for k in graph.layers]],
        })

    ship(vectors.sparkSession)
    index = home.select("dim", "shard", "embedding", "point", "copies").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, x binary, point binary, copies binary, root binary, inside array<binary>, layers array<binary>")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = points.select("dim", "embedding", "point", F.pmod(F.shiftrightunsigned("point", 32), F.lit(shards)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"point": np.array([], np.int64), "n": np.array([], np.int64), "roots": pd.Series([], dtype=object)})
        own = left.iloc[0]
        x = np.frombuffer(own["x"], np.float64).reshape(-1, int(own["dim"]))
        ids, copies, root = (np.frombuffer(own[k], np.int64) for k in ("point", "copies", "root"))
        graph = Hnsw.restored(x, [np.frombuffer(i, np.int64) for i in own["inside"]], [np.frombuffer(k, np.int32).reshape(-1, 2 * M) for k in own["layers"]])
        q, names = unit(right["embedding"].tolist()), right["point"].to_numpy(np.int64)
        number = np.zeros(len(q), np.int64)
        reached: list[np.ndarray] = []
        for i, j in _links(graph, x, q, limit, int(own["shard"])):
            other = names[i] != ids[j]
            i, j = i[other], j[other]
            number += np.bincount(i, copies[j], minlength=len(q)).astype(np.int64)
            reached.append(np.unique(i * len(x) + root[j]))
        codes = np.unique(np.concatenate(reached)) if reached else np.array([], np.int64)
        row, to = codes // len(x), ids[codes % len(x)]
        first = np.searchsorted(row, np.arange(len(q) + 1))
        some = np.nonzero(number)[0]
        return pd.DataFrame({"point": names[some], "n": number[some], "roots": pd.Series([to[first[k] : first[k + 1]].tolist() for k in some], dtype=object)})

    answers = cut(asked.groupBy("dim", "shard", "part").cogroup(index.groupBy("dim", "shard", "part")).applyInPandas(lambda q, i: ask(i, q), "point long, n long, roots array<long>"))
    number = answers.groupBy("point").agg(F.sum("n").alias("n"))
    names = points.select("point", "rep")
    edges = answers.select(F.col("point").alias("a"), F.explode("roots").alias("b")).where("a <> b")
    edges = edges.join(names.select(F.col("point").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("point").alias("b"), F.col("rep").alias("rb")), "b")
    joined = components(edges, "ra", "rb")
    classes = points.join(number, "point", "left").join(joined, F.col("rep") == joined.id, "left")
    classes = classes.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(classes, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: What op4_hnsw gives, by plain SQL.
OP4_SQL = """
WITH RECURSIVE usable AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0 AND isfinite(x))) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT l.vec_id, (SELECT count(*) FROM links WHERE a = l.vec_id) AS n_links, l.component_id, l.vec_id = l.component_id AS kept FROM least l
"""


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
