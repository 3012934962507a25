"""Toxicity by a linear classifier whose training penalises changes under identity swaps.

A text's score is the logistic function of a sum over its distinct words: each
word adds the weight of itself and those of its beginnings. For every training
text that mentions an identity group the same text with the group swapped is
built too, and the squared change of the sum is part of the loss, so that a
neutral mention of a group can't carry weight of its own.

The classifier is fitted on a bounded sample of labelled rows (MAX_TRAIN, taken
by a hash of the doc_id); every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import light, ship, table, text_of
from .bpe import columns

#: Labelled rows that a classifier is fitted on, about.
MAX_TRAIN = 40_000
#: Features that it keeps, those that tell the classes apart best.
MAX_FEATURES = 8_192
MIN_ROWS, MIN_Z = 5, 4.5
COUNTERFACTUAL, RIDGE = 2.0, 1e-4
BEGINNINGS = (3, 4, 5, 6)
#: Terms that may stand for one another in a neutral mention.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("transgender", "cisgender"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino"),
    ("immigrant", "citizen"), ("immigrants", "citizens"), ("disabled", "abled"), ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"),
    ("african", "european", "american", "arab"), ("mexican", "chinese", "german", "french"),
)
SWAP = {term: group[(k + 1) % len(group)] for group in IDENTITIES for k, term in enumerate(group)}

_WORDS = re.compile(r"\w+").findall
KINDS = "doc_id long, held_out boolean, score double, predicted int"


def words(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings with a mark."""
    return [word, *["^" + word[:k] for k in BEGINNINGS if len(word) >= k]]


def swapped(text_words: set[str]) -> set[str] | None:
    """The words with every identity term swapped within its group; None if there is none."""
    return {SWAP.get(w, w) for w in text_words} if not SWAP.keys().isdisjoint(text_words) else None


def fit(rows: list[list[int]], labels: np.ndarray, n: int, twins: list[tuple[list[int], list[int]]], rounds: int = 400) -> np.ndarray:
    """Weights of n features and the bias; twins: the feature lists of a text and of its swapped form."""

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    row, col = flat(rows)
    a_row, a_col = flat([a for a, _ in twins])
    b_row, b_col = flat([b for _, b in twins])
    t_row, t_col = np.concatenate([a_row, b_row]), np.concatenate([a_col, b_col]).astype(np.int64)
    sign = np.concatenate([np.ones(len(a_col)), -np.ones(len(b_col))])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col], minlength=len(rows)) + w[n]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(col, off[row], minlength=n), off.sum()) / len(rows)
        if len(twins):
            change = np.bincount(t_row.astype(np.int64), w[t_col] * sign, minlength=len(twins))
            g[:n] += 2 * COUNTERFACTUAL * np.bincount(t_col, change[t_row.astype(np.int64)] * sign, minlength=n) / len(twins)
        g[:n] += RIDGE * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * min(1, 2 - 2 * k / rounds)
    return w


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias. labels: doc_id, toxic; at most about max_train of its rows are used.

    With labels of one kind only, or none, the score is that of the bias, which
    is below 0.5 without labels: nothing is toxic without evidence.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, max_train / max(1, n))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        total = [0, 0]

        def told() -> pa.RecordBatch:
            names = [*(counts[0].keys() | counts[1].keys()), ""]
            neg, pos = ([c[x] for x in names[:-1]] + [t] for c, t in zip(counts, total))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(neg, pa.int64()), pa.array(pos, pa.int64())], ["feature", "neg", "pos"])

        for batch in batches:
            for toxic, text in zip(*columns(batch, "toxic", "text")):
                side = int(toxic > 0)
                total[side] += 1
                counts[side].update({f for w in words(text) for f in features(w)})
                if len(counts[0]) + len(counts[1]) > 300_000:  # bounded memory: pass on what there is
                    yield told()
                    counts, total = [Counter(), Counter()], [0, 0]
        yield told()

    seen = rows.mapInArrow(light(tally), "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ends = seen.where("feature = ''").first() or {"neg": 0, "pos": 0}
    n0, n1 = ends["neg"], ends["pos"]
    if not n0 or not n1:
        return {}, math.log((n1 + 1) / (n0 + 2))
    n, share = F.col("pos") + F.col("neg"), n1 / (n0 + n1)

    def part(count: str, expected: float):
        return F.when(F.col(count) > 0, F.col(count) * F.log(F.col(count) / (n * expected))).otherwise(0.0)

    z = F.sqrt(F.greatest(2 * (part("pos", share) + part("neg", 1 - share)), F.lit(0.0)))  # the root of the likelihood ratio statistic
    chosen = seen.where(f"feature <> '' and neg + pos >= {MIN_ROWS}").withColumn("z", F.round(z, 9)).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    at = {r["feature"]: k for k, r in enumerate(chosen.collect())}  # at most MAX_FEATURES rows
    shared = spark.sparkContext.broadcast(at)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value

        def ids(text_words: set[str]) -> list[int]:
            return sorted(index[f] for w in text_words for f in features(w) if f in index)

        for batch in batches:
            toxic, texts = columns(batch, "toxic", "text")
            here = [words(t) for t in texts]
            other = [swapped(w) for w in here]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([ids(w) for w in here], pa.list_(pa.int32())), pa.array([None if w is None else ids(w) for w in other], pa.list_(pa.int32()))], ["toxic", "ids", "twin"])

    got = rows.mapInArrow(light(project), "toxic int, ids array<int>, twin array<int>").toArrow()  # about max_train rows
    ids, toxic, twin = got["ids"].to_pylist(), got["toxic"].to_pylist(), got["twin"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], toxic[k]))  # the same sums whatever the rows' order
    twins = sorted((ids[k], twin[k]) for k in order if twin[k] is not None)
    w = fit([ids[k] for k in order], np.array([toxic[k] > 0 for k in order], float), len(at), twins)
    return {f: float(w[k]) for f, k in at.items()}, float(w[-1])


def score_documents(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """Per row of docs: doc_id, held_out, score in 0..1, predicted (score >= 0.5).

    Null and empty texts have the bias' score. held_out: crc32 of the doc_id as
    text (null: empty) is a multiple of 5. Texts of any length are scored whole;
    repeated rows get equal scores; other columns are ignored; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    class Values(dict):
        def __init__(self, weights: dict[str, float]):
            self.weights = weights

        def __missing__(self, word: str) -> float:
            get = self.weights.get
            out = sum(get(f, 0.0) for f in features(word))
            if len(self) < 300_000:
                self[word] = out
            return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        value = Values(weights)
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            z = np.array([math.fsum(map(value.__getitem__, words(t))) for t in texts], float) + bias
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(light(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """A classifier from the labels of rows that aren't held out."""
    return train(docs, labels.where(~held_out(F.col("doc_id"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, *trained(docs, table(spark, sf_dir, "labels")))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below limit; null doc_ids are judged by their text as well."""
    weights, bias = trained(docs, labels)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    kind = docs.schema
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        memo: dict[str, float] = {}

        def value(word: str) -> float:
            out = memo.get(word)
            if out is None:
                out = sum(weights.get(f, 0.0) for f in features(word))
                if len(memo) < 300_000:
                    memo[word] = out
            return out

        edge = math.log(limit / (1 - limit))
        for batch in batches:
            keep = [math.fsum(map(value, words(t or ""))) + bias < edge for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(light(run), kind)
