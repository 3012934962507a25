"""Stupid-backoff scores from n-gram counts over the whole corpus, a document's own counts left out.

Rows are dealt by a hash of their content over batches of bounded size. A batch sends each of its
distinct n-grams once, with its count there, to the hash partition that owns
the n-gram; the partition adds the counts up and sends the sums back, in the
order of the n-grams' hashes; the batch joins them to its documents' n-grams
and sums per document. So a frequent n-gram is pre-aggregated to one number a
batch, no partition or batch grows with the input (their number does), and only
counts are shuffled, besides the batches' texts. All of these are packed: texts
compressed by the rows that a task deals to a batch, sorted hashes as their
differences and counts as byte planes, the planes that aren't random compressed.
"""

from __future__ import annotations

import math
import pickle
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import light, ship, table, text_of

#: Characters of a batch, as the mean; bounds what a task holds.
BATCH_CHARS = 8_000_000
BACKOFF = 0.4
#: Words of the longest n-gram of op8_lm.
ORDER = 3
SEED = 11
#: Low bytes of the differences of a batch's sorted hashes that are as good as random.
RANDOM_BYTES = 5
_START = np.uint64(xxhash.xxh64_intdigest(b"start of text", 1))
_TOTAL = np.uint64(xxhash.xxh64_intdigest(b"total of tokens", 1))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = before * _A ^ (word + _B)
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ h >> np.uint64(32)


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the hashes of the words before, document numbers, documents' lengths."""
    parts = []
    for text in texts:
        words = tokens(text)
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words)))
    sizes = np.array([len(p) for p in parts], np.int64)
    words = np.concatenate(parts) if parts else np.array([], np.uint64)
    before = np.empty_like(words)
    if len(words):
        before[1:] = words[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts[sizes > 0]] = _START
    return words, before, np.repeat(np.arange(len(parts)), sizes), sizes


def _longer(words: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of 3 words to order: where n-grams end, and their hashes; the start of a text counts as its first word."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, less = [], pairs
    for j in range(3, order + 1):
        where = np.flatnonzero(place >= j - 2)
        grams = _bigrams(less[where - 1], words[where])
        out.append((where, grams))
        less = np.zeros_like(words)
        less[where] = grams
    return out


def _keys(words: np.ndarray, pairs: np.ndarray, longer: list[tuple[np.ndarray, np.ndarray]], documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of a batch and their counts there."""
    keys, counts = np.unique(np.concatenate([words, pairs, *(grams for _, grams in longer)]), return_counts=True)
    keys = np.concatenate([keys, np.array([_START, _TOTAL])])
    counts = np.concatenate([counts, [documents, len(words)]])
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order].astype(np.int64)


def packed(numbers: np.ndarray, random: int = 0) -> bytes:
    """Unsigned numbers by byte planes, the lowest first; all but the random lowest ones are compressed."""
    numbers = numbers.astype("<u8")
    width = max(random, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.view(np.uint8).reshape(-1, 8).T
    squeeze = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return struct.pack("<IB", len(numbers), width) + planes[:random].tobytes() + squeeze.compress(planes[random:width].tobytes()) + squeeze.flush()


def unpacked(data: bytes, random: int = 0) -> np.ndarray:
    """The numbers that packed was given."""
    n, width = struct.unpack_from("<IB", data)
    out, at = np.zeros((n, 8), np.uint8), 5 + n * random
    out[:, :random] = np.frombuffer(data, np.uint8, n * random, 5).reshape(random, n).T
    out[:, random:width] = np.frombuffer(zlib.decompress(data[at:]), np.uint8).reshape(width - random, n).T
    return out.view("<u8").reshape(n)


def _packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)), RANDOM_BYTES)


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, RANDOM_BYTES), dtype=np.uint64)


def _deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, doc_id, text) as one compressed row (batch, size, rows) for each batch that they go to."""
    squeeze = pa.Codec("zstd", 3)
    for rows in batches:
        to, order = rows.column(0).to_numpy(), np.argsort(rows.column(0).to_numpy(), kind="stable")
        rows, (numbers, starts) = rows.take(pa.array(order)), np.unique(to[order], return_index=True)
        ids, texts = rows.column(1), rows.column(2)
        data = [pickle.dumps((ids[s:e].to_pylist(), texts[s:e].to_pylist()), 5) for s, e in zip(starts, [*starts[1:], len(order)])]
        told = [pa.array(numbers, pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([squeeze.compress(x, asbytes=True) for x in data], pa.binary())]
        yield pa.RecordBatch.from_arrays(told, ["batch", "size", "rows"])


def _dealt(pdf: pd.DataFrame) -> tuple[list[int | None], list[str]]:
    """The doc_ids and texts of a batch."""
    ids, texts = [], []
    for size, data in zip(pdf["size"], pdf["rows"]):
        some_ids, some_texts = pickle.loads(pa.decompress(data, size, "zstd", asbytes=True))
        ids += some_ids
        texts += some_texts
    return ids, texts


def score_documents(docs: DataFrame, batch_chars: int = BATCH_CHARS, order: int = 2) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, log_score (sum of natural logarithms), mean_log_score.

    The score of a word is count(before, word) / count(before) over all other
    rows, or 0.4 * count(word) / all tokens where they don't hold the pair;
    words that no other row has count as seen once. With an order beyond 2, n-grams
    of up to so many words come first, each step to a shorter one costs 0.4, and
    the start of the text stands for one word before the first. Null and empty texts have no
    tokens, score 0 and a null mean. Copies of a text are other rows. Repeated
    and null doc_ids are scored row by row; other columns are ignored; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)  # before the first function that workers run
    size = docs.agg(F.sum(F.length(text_of())).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    batches = max(1, math.ceil((size["n"] or 0) / batch_chars), math.ceil(size["rows"] / 100_000))
    bits = max(2, math.ceil(math.log2(batches)))
    shift = np.uint64(64 - bits)
    doc_id = F.col("doc_id").cast("long")
    batch = F.pmod(F.xxhash64(doc_id, text_of()), F.lit(batches))  # of the row alone, so that a stage that runs again deals alike
    rows = docs.select(batch.alias("batch"), doc_id.alias("doc_id"), text_of().alias("text")).mapInArrow(light(_deal), "batch long, size long, rows binary")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        _, texts = _dealt(pdf)
        words, before, _, sizes = _read(texts)
        pairs = _bigrams(before, words)
        keys, counts = _keys(words, pairs, _longer(words, pairs, sizes, order), len(texts))
        parts, starts = np.unique(keys >> shift, return_index=True)
        ends = [*starts[1:], len(keys)]
        batch = int(pdf["batch"].iloc[0])
        return pd.DataFrame({
            "part": parts.astype(np.int64), "batch": batch,
            "keys": [_packed_keys(keys[s:e]) for s, e in zip(starts, ends)],
            "counts": [packed(counts[s:e]) for s, e in zip(starts, ends)],
        })

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpacked_keys(k) for k in pdf["keys"]]
        counts = np.concatenate([unpacked(c) for c in pdf["counts"]])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, counts).astype(np.int64)[at]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"part": pdf["part"], "batch": pdf["batch"], "sums": [packed(s) for s in np.split(sums, ends[:-1])]})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _dealt(left)
        words, before, doc, sizes = _read(texts)
        pairs = _bigrams(before, words)
        longer = _longer(words, pairs, sizes, order)
        sums = np.concatenate([unpacked(s) for s in right.sort_values("part")["sums"]] or [np.array([], np.uint64)]).astype(np.int64)

        # all n-grams in the order of their hashes: of equal ones those of a document stand together
        hashes = np.concatenate([words, pairs, *(grams for _, grams in longer), np.array([_START, _TOTAL])])
        of = np.concatenate([doc, doc, *(doc[where] for where, _ in longer), [-1, -1]]).astype(np.int32)
        by = np.argsort(hashes, kind="stable")
        hashes, of = hashes[by], of[by]
        new = np.append(True, hashes[1:] != hashes[:-1])
        if len(sums) != new.sum():
            raise ValueError("a batch changed between two readings of the input")
        run = np.cumsum(np.append(True, new[1:] | (of[1:] != of[:-1]))) - 1
        others = np.empty(len(by), np.int64)  # counts of the n-grams in all rows but the one that they stand in
        others[by] = sums[np.cumsum(new) - 1] - np.bincount(run)[run]
        del hashes, of, by, new, run

        single, pair, at = others[: len(words)], others[len(words) : 2 * len(words)], 2 * len(words)
        total = int(others[-1]) + 1  # less one, as the row of _TOTAL has been taken for a document's
        context = np.append(0, single[:-1])[: len(words)].astype(np.float64)
        context[before == _START] = others[-2]
        rest = np.maximum(1, total - sizes[doc]).astype(np.float64)
        value = np.where(pair > 0, pair / np.maximum(context, 1), BACKOFF * np.maximum(single, 1) / rest)
        less = pair
        for where, grams in longer:
            more, at = others[at : at + len(grams)], at + len(grams)
            value[where] = np.where(more > 0, more / np.maximum(less[where - 1], 1), BACKOFF * value[where])
            less = np.zeros_like(pair)
            less[where] = more
        log = np.bincount(doc, np.log(value), minlength=len(texts)) if len(words) else np.zeros(len(texts))
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": sizes, "log_score": log, "mean_log_score": np.where(sizes > 0, log / np.maximum(sizes, 1), np.nan)})

    asked = rows.groupBy("batch").applyInPandas(ask, "part long, batch long, keys binary, counts binary")
    told = asked.groupBy("part").applyInPandas(count, "part long, batch long, sums binary")
    out = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(score, "doc_id long, n_tokens long, log_score double, mean_log_score double")
    return out.withColumn("mean_log_score", F.nanvl("mean_log_score", F.lit(None).cast("double")))


#: What op8_lm gives, by plain SQL.
OP8_SQL = r"""
WITH words AS (SELECT doc_id, list_prepend(' ', list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS ws FROM documents),
one AS (SELECT doc_id, len(ws) - 1 AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words),
met AS (SELECT *, lag(w) OVER d AS p, lag(w, 2) OVER d AS q FROM one WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
here AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c1, count(*) OVER (PARTITION BY doc_id, p, w) AS c2, count(*) OVER (PARTITION BY doc_id, q, p, w) AS c3,
  count(*) OVER (PARTITION BY w) AS t1, count(*) OVER (PARTITION BY p, w) AS t2, count(*) OVER (PARTITION BY q, p, w) AS t3 FROM met),
others AS (SELECT doc_id, n, i, t1 - c1 AS o1, CASE WHEN i >= 1 THEN t2 - c2 END AS o2, CASE WHEN i >= 2 THEN t3 - c3 END AS o3,
  lag(t1 - c1) OVER d AS before1, CASE WHEN i >= 2 THEN lag(t2 - c2) OVER d END AS before2 FROM here WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
scored AS (SELECT doc_id, n, i, ln(CASE WHEN i = 0 THEN 1.0 WHEN o3 > 0 THEN o3 / greatest(before2, 1) ELSE CASE WHEN i >= 2 THEN 0.4 ELSE 1.0 END *
  CASE WHEN o2 > 0 THEN o2 / greatest(before1, 1) ELSE 0.4 * greatest(o1, 1) / greatest(1, (SELECT sum(len(ws) - 1) FROM words) - n) END END) AS value FROM others)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, round(sum(value), 6) + 0 AS log_score, CASE WHEN n > 0 THEN round(sum(value) / n, 6) END AS mean_log_score FROM scored GROUP BY doc_id, n
"""


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), order=ORDER)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("log_score", "mean_log_score")})
