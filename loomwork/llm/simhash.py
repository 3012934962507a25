"""SimHash near-duplicates: exact pairs of fingerprints by vantage-point trees.

A vantage point is a fixed 64-bit word. The 64 bits are cut into one block more
than the radius. Two fingerprints that link differ in radius bits at most, so
they agree on a whole block, and on it have the same distance to any vantage
point: there the triangle bound has no width. For each block a fingerprint's
distances to some vantage points, within the block, are its shard; it visits one
shard a block, however many shards there are, and meets all that it links to.
A shard of too many points is cut into parts, and every two of its parts meet.
In a shard the tree goes on with distances over all bits, rings whose bounds are
quantiles, and bounds widened by the radius: a branch is searched by the points
that the triangle inequality lets link into it, all of a node at once, down to
leaves that are compared in full.

Equal fingerprints are one point (so copies are never expanded into pairs) and
a shard returns a star around each of its local components, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, cut, light, ship, table, text_of
from .bpe import columns
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Points that a shard should have, and those beyond which it is cut into parts.
SHARD, MOST = 4_096, 32_768
#: Pairs that a leaf compares at once.
LEAF = 1 << 20


def vantage(level: int) -> int:
    return xxhash.xxh64_intdigest(f"vantage {level}", 7)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes).tolist()
    hashes = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # whole texts, in parts of bounded size
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row of docs; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            known: dict[str, int] = {}
            fps = []
            for text in texts:
                if text not in known:
                    known[text] = fingerprint(text, shingle)
                fps.append(known[text])
            fp = np.array(fps, np.uint64).view(np.int64) if fps else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(light(run), "doc_id long, fp long")


def _rings(distances: np.ndarray, weights: np.ndarray, parts: int = 4) -> list[tuple[int, int]]:
    """Bounds, both included, of up to parts rings of about equal weight that cover all distances."""
    order = np.argsort(distances)
    d, share = distances[order], np.cumsum(weights[order]) / weights.sum()
    tops = sorted({int(d[min(int(np.searchsorted(share, (k + 1) / parts)), len(d) - 1)]) for k in range(parts - 1)})
    edges = [-1, *[t for t in tops if t < 64], 64]
    return [(lo + 1, hi) for lo, hi in zip(edges, edges[1:]) if lo + 1 <= hi]


class _Union:
    """Smallest reachable label of each of n points."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the pairs (i, j); their number is bounded by the caller."""
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            names, inverse = np.unique(np.concatenate([low, high]), return_inverse=True)
            parent = np.arange(len(names))
            l, h = inverse[: len(low)], inverse[len(low) :]
            while True:
                pl, ph = parent[l], parent[h]
                least = np.minimum(pl, ph)
                before = parent.copy()
                np.minimum.at(parent, l, least)
                np.minimum.at(parent, h, least)
                np.minimum.at(parent, pl, least)
                np.minimum.at(parent, ph, least)
                parent = parent[parent]
                if (parent == before).all():
                    break
            at = np.searchsorted(names, label)
            at[at == len(names)] = 0
            hit = names[at] == label
            label[hit] = names[parent[at[hit]]]


def _search(base: np.ndarray, queries: np.ndarray, fp: np.ndarray, level: int, radius: int, union: _Union, linked: np.ndarray) -> None:
    """Link the points base with the queries, both given as positions in fp, by a tree over base."""
    todo = [(base, queries, level)]
    while todo:
        base, queries, level = todo.pop()
        if not len(base) or not len(queries):
            continue
        if len(base) <= 256 or len(base) * len(queries) <= LEAF or level > 60:
            step = max(1, LEAF // len(base))
            for at in range(0, len(queries), step):
                q = queries[at : at + step]
                near = np.bitwise_count(fp[q][:, None] ^ fp[base][None, :]) <= radius
                i, j = np.nonzero(near)
                i, j = q[i], base[j]
                other = i != j
                i, j = i[other], j[other]
                linked[i] = linked[j] = True
                union.add(i, j)
            continue
        v = np.uint64(vantage(level))
        db, dq = np.bitwise_count(fp[base] ^ v).astype(np.int64), np.bitwise_count(fp[queries] ^ v).astype(np.int64)
        for low, high in _rings(db, np.ones(len(db))):
            todo.append((base[(db >= low) & (db <= high)], queries[(dq >= low - radius) & (dq <= high + radius)], level + 1))


def blocks(radius: int) -> list[int]:
    """Masks of radius + 1 blocks of bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def _signed(word: int) -> Column:
    return F.lit(word - (1 << 64) if word >> 63 else word)


def shards(points: DataFrame, n: int, radius: int, shard: int, most: int) -> DataFrame:
    """(fp, shard, i, j, part) per visit of the n points (fp): part is the point's own in its shard, i <= j are those that meet."""
    levels = max(0, math.ceil(math.log(max(1, n / shard), 4)))  # a level has some four rings of weight
    masks = blocks(radius) if levels else [(1 << 64) - 1]  # few points are one shard

    def key(k: int, mask: int) -> Column:
        rings = [F.bit_count(F.col("fp").bitwiseXOR(_signed(vantage(level))).bitwiseAND(_signed(mask))) for level in range(levels)]
        return F.concat_ws(".", F.lit(k), *rings)

    dealt = points.select("fp", F.explode(F.array(*[key(k, mask) for k, mask in enumerate(masks)])).alias("shard"))
    large = dealt.groupBy("shard").count().where(F.col("count") > most).select("shard", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    large = cut(large, n * len(masks) // most)  # there are no more
    dealt = bounded(dealt, large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return dealt.select("fp", "shard", "part", other).select("fp", "shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")


def stars(points: DataFrame, radius: int = RADIUS, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of different fingerprints, whose components are those of all pairs of points (fp) that link."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        union, linked = _Union(fp), np.zeros(len(fp), bool)
        base, queries = (np.flatnonzero(pdf["part"] == pdf[c]) for c in "ij")
        _search(base, queries, fp, 0, radius, union, linked)
        signed, root = fp[linked].view(np.int64), union.label[linked].view(np.int64)
        star = signed != root
        return pd.DataFrame({"a": signed[star], "b": root[star]})

    dealt = shards(points.select("fp"), points.count(), radius, shard, most)
    return dealt.groupBy("shard", "i", "j").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows and ties share a component. A row whose doc_id is null gets a
    component of its own fingerprint's class (null if no other row is in it).
    Other columns are ignored; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), prints.count())
    n = points.count()

    found = stars(points, radius, shard, most)
    # component ids are doc_ids: a point stands by the smallest doc_id of its class
    ids = points.select(F.col("fp").alias("a"), F.col("rep").alias("ra"))
    edges = found.join(ids, "a").join(ids.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
    joined = components(edges.select("ra", "rb"), "ra", "rb", n)
    classes = points.join(joined, points.rep == joined.id, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows with a null doc_id stay.

    Repeated rows of a kept doc_id all stay: they are one document.
    """
    found = near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
