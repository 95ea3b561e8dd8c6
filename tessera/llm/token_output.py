"""Token ids in binary training files: best-fit-decreasing packing with a segment tree over free capacities.

Each task packs its pieces in groups of bounded size, without a shuffle: longest first, each into the sequence with the
least free room that holds it, which a segment tree over capacities finds. A document longer than a sequence is split
losslessly. Files are Parquet with a row per sequence: its padded ids (little-endian unsigned 16- or 32-bit, by the
vocabulary), cumulative segment lengths, and the positions, which restart at each segment.

Defined results: a null or empty text is the end id alone; rows without doc_id are left out; rows that repeat a doc_id
are packed each; an empty table writes no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import fresh_path, record, slices, texts
from .tokens import encode

SIZE = 1024
#: Pieces packed together at most.
GROUP = 8192
_SEQUENCE = pa.schema([("shard", pa.int64()), ("sequence", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])
SEQUENCE = "shard long, sequence long, width int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>, doc_tokens array<long>"
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("shard", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())])


class Capacities:
    """A segment tree over 0..size that counts open sequences by free room and finds the least room that suffices."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, room: int) -> int | None:
        at = room + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences as lists of the pieces' numbers: best fit, longest first, ties in order."""
    tree, out = Capacities(size), []
    open_at: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room is None:
            out.append([i])
            at, room = len(out) - 1, size
        else:
            tree.add(room, -1)
            at = open_at[room].pop()
            out[at].append(i)
        if room - lengths[i]:
            open_at.setdefault(room - lengths[i], []).append(at)
            tree.add(room - lengths[i], 1)
    return out


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE, group: int = GROUP, pad: int = 0, wide: bool = False) -> DataFrame:
    """One row per packed sequence."""
    kind = "<u4" if wide else "<u2"

    def packed(waiting: list[tuple], shard: int) -> pa.RecordBatch:
        rows = []
        for number, members in enumerate(best_fit([len(w[3]) for w in waiting], size)):
            parts = [waiting[i] for i in members]
            n = [len(p[3]) for p in parts]
            ids, positions = np.full(size, pad, kind), np.zeros(size, kind)
            used = sum(n)
            ids[:used] = np.concatenate([p[3] for p in parts])
            positions[:used] = np.concatenate([np.arange(k) for k in n])
            positions[used:] = np.arange(size - used)
            rows.append((shard, number, np.dtype(kind).itemsize, ids.tobytes(), [0, *np.cumsum(n).tolist()], positions.tobytes(), [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
        return record(_SEQUENCE, **dict(zip(_SEQUENCE.names, map(list, zip(*rows, strict=True)), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = TaskContext.get().partitionId() << 24, []
        for batch in slices(batches, "text"):
            for doc, x in zip(batch.column("doc_id").to_pylist(), encode(tokenizer, batch.column("text").to_pylist()), strict=True):
                if not wide and len(x) and int(x.max()) > 0xFFFF:
                    raise ValueError("ids do not fit 16 bits: pass wide=True")
                waiting += [(doc, at, len(x), x[at : at + size]) for at in range(0, len(x), size)]
                while len(waiting) >= group:
                    yield packed(waiting[:group], shard)
                    shard, waiting = shard + 1, waiting[group:]
        if waiting:
            yield packed(waiting, shard)

    return texts(docs).mapInArrow(run, SEQUENCE)


def write(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> str:
    """Writes the packed sequences as Parquet; returns the folder."""
    path = path or fresh_path(docs.sparkSession, "sequences")
    sequences(docs, tokenizer, **options).write.option("compression", "zstd").parquet(path)
    return path


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """What the written files hold, a row per piece, its checksum taken from the stored ids and its positions checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                kind = f"<u{s['width']}"
                ids, positions = np.frombuffer(s["ids"], kind), np.frombuffer(s["positions"], kind)
                for k, (doc, start, total) in enumerate(zip(s["doc_ids"], s["starts"], s["doc_tokens"], strict=True)):
                    a, b = s["cu_seqlens"][k : k + 2]
                    if not np.array_equal(positions[a:b], np.arange(b - a)):
                        raise ValueError("positions do not restart at a segment")
                    rows.append((doc, start, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), total, s["shard"], s["sequence"], a))
            if rows:
                yield record(_PIECE, **dict(zip(_PIECE.names, map(list, zip(*rows, strict=True)), strict=True)))

    return spark.read.schema(SEQUENCE).parquet(path).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard long, sequence long, offset long")
