"""Packing of documents into token sequences, balanced by attention cost.

A piece of n tokens costs n * linear + n * n * quadratic. Documents stream
through each task in windows of a fixed number of tokens. In a window of K full
sequences the pieces are taken by descending cost, and each goes to the
sequence of lowest cost that still has room; if none has, the piece is cut to
fill the emptiest one. So each window's sequences are filled to the last token,
and what is left (less than one sequence) opens the next window. At a task's
end the rest is laid into sequences whose lengths are powers of two, which need
no padding. No rows move between tasks and memory is bounded by the window and
the longest document.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import light, ship, table, text_of
from .bpe import Encoder, columns, tables, tokenizer_path

CAPACITY = 4096
#: Full sequences of a window; bounds a task's memory at 4 bytes a token.
WINDOW = 256
#: Bytes of a generation of remembered words, about; a worker keeps two.
MEMO = 96 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

Piece = tuple[int, int, int]  # document's number in the window's list, start, length


def cost(n: int) -> float:
    return n * LINEAR + n * n * QUADRATIC


def fill(lengths: list[Piece], capacity: int, k: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Deal pieces over k sequences of the given capacity until all are full; also what is left over.

    The pieces hold at least k * capacity tokens.
    """
    whole, rest = [], []
    for doc, start, n in lengths:
        while n >= capacity and len(whole) < k:
            whole.append([(doc, start, capacity)])
            start, n = start + capacity, n - capacity
        if n:
            rest.append((doc, start, n))
    rest.sort(key=lambda p: (-p[2], p[0], p[1]))
    out: list[list[Piece]] = [[] for _ in range(k - len(whole))]
    room = [capacity] * len(out)
    heap = [(0.0, i) for i in range(len(out))]
    left: list[Piece] = []
    for doc, start, n in rest:
        while n and heap:
            tried = []
            while heap and room[heap[0][1]] < n:
                tried.append(heapq.heappop(heap))
            if heap:
                have, i = heapq.heappop(heap)
                take = n
            else:  # none has room for all of it: fill the emptiest
                have, i = max(tried, key=lambda x: (room[x[1]], -x[0], -x[1]))
                tried.remove((have, i))
                take = room[i]
            for x in tried:
                heapq.heappush(heap, x)
            out[i].append((doc, start, take))
            room[i] -= take
            if room[i]:
                heapq.heappush(heap, (have + cost(take), i))
            start, n = start + take, n - take
        if n:
            left.append((doc, start, n))
    return whole + out, left


def split_rest(lengths: list[Piece], capacity: int) -> list[list[Piece]]:
    """Sequences of descending powers of two that hold all pieces without padding."""
    total, out = sum(p[2] for p in lengths), []
    todo = list(reversed(lengths))
    while total:
        size = min(capacity, 1 << (total.bit_length() - 1))
        total -= size
        sequence: list[Piece] = []
        while size:
            doc, start, n = todo.pop()
            take = min(n, size)
            sequence.append((doc, start, take))
            if n > take:
                todo.append((doc, start + take, n - take))
            size -= take
        out.append(sequence)
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone. A text longer than a
    sequence is cut into several pieces. Repeated rows, also of one doc_id, are
    packed one by one; a null doc_id stays null. Ties in cost keep the order of
    input. An empty table gives no rows; other columns are ignored. Sequence ids
    hold the task's number, so no two tasks share one and a task that runs again
    on the same rows gives the same result.
    """
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types, classes = [pa.int64()] * 7, tables()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, None, MEMO, classes)
        end = end_id.to_bytes(4, "little")
        held: list[tuple[int, bytes]] = []  # the window's documents
        todo: list[Piece] = []
        tokens, number = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in names]
            for sequence in sequences:
                offset = 0
                for doc, start, n in sequence:
                    doc_id, data = held[doc]
                    crc = zlib.crc32(memoryview(data)[4 * start : 4 * (start + n)])
                    for column, value in zip(out, (doc_id, start, n, crc, len(data) // 4, number, offset)):
                        column.append(value)
                    offset += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        for batch in batches:
            for doc_id, text in zip(*columns(batch, "doc_id", "text")):
                data = encoder.encode(text) + end
                held.append((doc_id, data))
                todo.append((len(held) - 1, 0, len(data) // 4))
                tokens += len(data) // 4
                if tokens >= window * capacity:
                    done, todo = fill(todo, capacity, tokens // capacity)
                    yield rows(done)
                    tokens = sum(p[2] for p in todo)
                    used = sorted({p[0] for p in todo})
                    renamed = {old: new for new, old in enumerate(used)}
                    held = [held[k] for k in used]
                    todo = [(renamed[d], s, n) for d, s, n in todo]
        if tokens:
            done, todo = fill(todo, capacity, tokens // capacity)
            yield rows(done + split_rest(todo, capacity))

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(light(run), kind)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
