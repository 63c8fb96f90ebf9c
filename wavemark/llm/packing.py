"""Packing of documents into training sequences by minimum bin slack.

A document's ids (with an end id) are cut into full windows and one remainder. Within a block of
documents the remainders are counted by length, and sequences are planned from these counts: the
longest remaining length opens a sequence, and a subset-sum dynamic program over a bitset of
reachable sums picks the multiset of remaining lengths that fills it closest to capacity. Walking
back through the bitsets gives how many pieces of each length it takes, and the pattern is used as
often as the counts allow.

A block is a bounded run of documents inside one Spark partition: no shuffle, no state between
tasks, and at most about one part-filled sequence for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import byte_encoder, text_slices


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, copies), whose sum comes closest to ``room`` from
    below; ``counts`` bounds the copies. Longer lengths are tried first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        steps.append((length, reach))
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            reach |= (reach << (k * length)) & mask
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        copies = 0
        while not before >> target & 1:
            target -= length
            copies += 1
        if copies:
            chosen.append((length, copies))
    return chosen


def plan(lengths: np.ndarray, capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Patterns, as lists of (length, copies), and how many sequences follow each. Together they
    take every piece once. A pattern is repeated until a length that it needs runs out, so there
    are at most ``capacity`` kinds of length to run out of between two changes of the counts."""
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    for seed in sorted(counts, reverse=True):
        while counts[seed]:
            counts[seed] -= 1
            pattern = dict(fill(counts, capacity - seed)) if seed < capacity else {}
            counts[seed] += 1
            pattern[seed] = pattern.get(seed, 0) + 1
            times = min(counts[n] // c for n, c in pattern.items())
            for n, c in pattern.items():
                counts[n] -= c * times
            yield sorted(pattern.items(), reverse=True), times


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence, from 0, and the offset in it of each piece."""
    by_length = np.argsort(lengths, kind="stable")
    kinds, first = np.unique(lengths[by_length], return_index=True)
    used = dict(zip(kinds.tolist(), first.tolist(), strict=True))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    done = 0
    for pattern, times in plan(lengths, capacity):
        start = 0
        for length, copies in pattern:
            taken = by_length[used[length] : used[length] + copies * times]
            used[length] += copies * times
            sequence[taken] = done + np.arange(copies * times) // copies
            offset[taken] = start + np.arange(copies * times) % copies * length
            start += copies * length
        done += times
    return sequence, offset


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``sizes`` ids: each piece's document, start in it, and length."""
    pieces = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    return doc, start, np.minimum(capacity, sizes[doc] - start)


def pack_documents(
    df: DataFrame, tokenizer: str, *, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 2_000_000
) -> DataFrame:
    """One row per piece: ``doc_id`` (of the input's type), ``start`` (ids of its document before
    it), ``length``, ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the
    sequence, gapless from 0) and ``ids`` (its ids, little-endian unsigned 32-bit, as binary).

    Null and empty texts hold the end id alone. Repeated rows and null ids are packed like any
    other row; an empty table gives no rows. Columns other than the two named are not read, so
    their names cannot clash. A sequence never spans blocks, so ``sequence_id`` is unique but not
    gapless: the partition's number in the high bits, a running number in the low 33.
    """
    kind = df.schema[id_col].dataType
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("ids", T.BinaryType())])

    def block(ids: pa.Array, values: np.ndarray, sizes: np.ndarray, base: int) -> tuple[list[pa.RecordBatch], int]:
        doc, start, length = cut(sizes, capacity)
        sequence, offset = place(length, capacity)
        ends = np.cumsum(length)
        columns = [start, length, sizes[doc], base + sequence, offset]
        out, step = [], max(1, 1_000_000 // capacity)
        for a in range(0, len(doc), step):
            b = min(a + step, len(doc))
            low = ends[a] - length[a]
            part = np.ascontiguousarray(values[low : ends[b - 1]], dtype="<u4")
            bounds = np.concatenate([[0], ends[a:b] - low]).astype(np.int32) * 4
            packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(part)])
            arrays = [ids.take(pa.array(doc[a:b])), *(pa.array(c[a:b]) for c in columns), packed]
            out.append(pa.RecordBatch.from_arrays(arrays, ["doc_id", *longs, "ids"]))
        return out, int(sequence.max()) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = byte_encoder(tokenizer)
        base, held, kept, counted, total = TaskContext.get().partitionId() << 33, [], [], [], 0
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                values, sizes = encoder.encode(texts, end=True)
                held.append(values)
                counted.append(sizes)
                kept.append(batch.column(0).slice(a, b - a))
                total += len(values)
                if total >= block_ids:
                    out, n = block(pa.concat_arrays(kept), np.concatenate(held), np.concatenate(counted), base)
                    yield from out
                    base, held, kept, counted, total = base + n, [], [], [], 0
        if total:
            yield from block(pa.concat_arrays(kept), np.concatenate(held), np.concatenate(counted), base)[0]

    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(pack, schema)
