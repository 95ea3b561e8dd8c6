"""Packing documents into sequences by cutting-stock column generation.

A document longer than a sequence fills whole sequences and leaves one rest. The histogram of piece lengths (at most as
many bins as a sequence has tokens) is a cutting-stock problem: a linear program over patterns (multisets of lengths that
fit a sequence), solved by a revised simplex whose columns are priced by a knapsack dynamic program, until the best
bound met shows it within GAP of its best value, or for ROUNDS rounds (then the gap reached is logged). Its pattern counts are rounded
down, patterns are repeated while the rest can fill them, and what is left is packed longest first.
Pieces are ranked within their length; each rank belongs to one slot of the plan, so the assignment is arithmetic on a
plan of bounded size, whatever the corpus. Only the histogram reaches the driver.

Defined results: a null or empty text is the end id alone; rows without doc_id are left out; rows that repeat a doc_id
are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, slices, stored, texts
from .tokens import encode

SIZE = 1024
#: Pieces that are ranked together, about.
BLOCK = 2_000
#: The linear program ends when a bound shows it within this share of its best value.
GAP = 2e-4
#: Rounds of pricing at most; each enters up to 24 columns.
ROUNDS = 60
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, ids: bool = True) -> DataFrame:
    """Every document's ids in pieces of at most `size`, with each piece's checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc, x in zip(batch.column("doc_id").to_pylist(), encode(tokenizer, batch.column("text").to_pylist()), strict=True):
                raw = x.astype("<u4")
                rows += [(doc, at, len(raw[at : at + size]), zlib.crc32(raw[at : at + size].tobytes()), len(raw), raw[at : at + size].astype(np.int32) if ids else None) for at in range(0, len(raw), size)]
            yield record(_PIECE, **dict(zip(_PIECE.names, map(list, zip(*rows, strict=True)), strict=True)))

    return texts(docs).mapInArrow(cut, _PIECES)


def knapsack(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value within each capacity (any number of each length), and the item that was taken last (-1: none)."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        best[c], last[c] = best[c - 1], -2
        if k := fits[c]:
            got = value[:k] + best[c - lengths[:k]]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], last[c] = got[i], i
    return best, last


def _pattern(last: np.ndarray, lengths: np.ndarray, c: int, column: np.ndarray) -> np.ndarray:
    while c > 0 and last[c] != -1:
        if last[c] == -2:
            c -= 1
        else:
            column[last[c]] += 1
            c -= lengths[last[c]]
    return column


def greedy(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Whole-number patterns that use up all demand: the longest piece left, then the longest that fits, each pattern
    repeated until one of its lengths has run out."""
    rest, used, top = demand.copy(), [], len(lengths)
    while True:
        while top and not rest[top - 1]:
            top -= 1
        if not top:
            return used
        column, room, i = np.zeros(len(lengths), np.int64), size, top
        while i:
            i = min(i, int(np.searchsorted(lengths, room, side="right")))
            while i and not rest[i - 1]:
                i -= 1
            if i:
                n = int(min(room // lengths[i - 1], rest[i - 1]))
                column[i - 1] += n
                room -= n * int(lengths[i - 1])
                i -= 1
        n = int((rest[column > 0] // column[column > 0]).min())
        used.append((column, n))
        rest -= n * column


def start(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis of patterns, one per length, and its inverse. Patterns take the longest length left, then the longest
    that fit, each as often (in fractions too) as until a length runs out, which it then stands for. So in the order in
    which lengths run out the basis is triangular, and its solution is not negative. (No matrix product here or in solve()
    calls a threaded library: the driver's process must not depend on one.)"""
    rest, basis, turn = demand.astype(float), np.diag(size // lengths), []
    left = list(range(len(lengths)))
    while left:
        column, room = np.zeros(len(lengths), np.int64), size
        for i in reversed(left):
            if lengths[i] <= room:
                column[i] = room // lengths[i]
                room -= int(column[i] * lengths[i])
        held = np.flatnonzero(column)
        ratio = rest[held] / column[held]
        rest[held] -= ratio.min() * column[held]
        gone = held[ratio <= ratio.min() * (1 + 1e-12)]
        rest[gone] = 0
        basis[:, gone[0]] = column
        turn += gone.tolist()
        left = [i for i in left if rest[i] > 0]
    inverse = np.zeros(basis.shape)
    for k, i in enumerate(turn):  # column i holds only lengths of turn[k:], so eliminating in this order fills in nothing before
        inverse[i, i] += 1.0
        inverse[i] /= basis[i, i]
        later = np.flatnonzero(basis[:, i])
        for j in later[later != i]:
            inverse[j] -= basis[j, i] * inverse[i]
    return basis, inverse


def solve(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = GAP, rounds: int = ROUNDS, columns: int = 24) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each. `lengths` ascend. Each round prices by one knapsack and
    enters several of the columns that it offers."""
    m = len(lengths)
    whole, inverse = start(lengths, demand, size)
    times = lambda column: np.einsum("ij,j->i", inverse, column)
    basis, demand = list(whole.T.astype(float)), demand.astype(float)
    x = np.maximum(times(demand), 0)
    bound = float((lengths * demand).sum() / size)  # no plan needs less than its pieces' length
    for _ in range(rounds):
        price = np.maximum(inverse.sum(0), 0)
        best, last = knapsack(price, lengths, size)
        bound = max(bound, float((price * demand).sum() / best[size]))  # prices that no pattern exceeds; the best bound met counts
        if best[size] <= 1 + 1e-9 or bound > (1 - gap) * x.sum():
            break
        offers = price + best[size - lengths]  # the best pattern that holds each length
        entered = 0
        for i in np.argsort(-offers, kind="stable")[: columns * 3]:
            if offers[i] <= 1 + 1e-9 or entered == columns:
                break
            column = _pattern(last, lengths, int(size - lengths[i]), np.zeros(m))
            column[i] += 1
            step = times(column)
            if step.sum() <= 1 + 1e-9:  # an earlier column of this round has priced it out
                continue
            up = np.flatnonzero(step > 1e-9)
            ratio = x[up] / step[up]
            row = up[int(ratio.argmin())]
            theta = x[row] / step[row]
            x -= theta * step
            x[row] = theta
            np.maximum(x, 0, out=x)
            inverse[row] /= step[row]
            step[row] = 0
            touched = np.flatnonzero(step)
            inverse[touched] -= np.outer(step[touched], inverse[row])
            basis[row] = column
            entered += 1
        if not entered:
            break
    else:
        logging.getLogger(__name__).warning("column generation ended within %.2g of its bound after %d rounds", 1 - bound / x.sum(), rounds)
    return [(basis[i].astype(np.int64), float(x[i])) for i in range(m) if x[i] > 1e-9]


def rounded(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """The linear program's patterns in whole numbers: rounded down, then by falling fraction as long as pieces last; the
    rest greedily."""
    found, rest, used = solve(lengths, demand, size), demand.copy(), []
    for wish, patterns in ((lambda x: int(x + 1e-6), found), (lambda x: 1, sorted(found, key=lambda f: -(f[1] % 1)))):
        for column, x in patterns:
            if n := int(min([wish(x), *(rest[column > 0] // column[column > 0])])):
                used.append((column, n))
                rest -= n * column
    return used + greedy(lengths, rest, size)


def plan(lengths: np.ndarray, demand: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Slots: rows of length, first rank, rank after the last, pieces of this length in a sequence, first sequence,
    offset in it. Together they hold each rank of each length once, and every sequence's pieces fit."""
    order = np.argsort(lengths)
    lengths, rest = np.asarray(lengths, np.int64)[order], np.asarray(demand, np.int64)[order].copy()
    used = rounded(lengths, rest, size) if len(lengths) else []
    slots, taken, sequence = [], np.zeros(len(lengths), np.int64), 0
    for column, n in used:
        offset = 0
        for i in np.flatnonzero(column)[::-1]:
            a = int(column[i])
            slots.append((lengths[i], taken[i], taken[i] + n * a, a, sequence, offset))
            taken[i] += n * a
            offset += a * int(lengths[i])
        sequence += n
    return np.array(slots, np.int64).reshape(-1, 6)


def assign(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces (a stored table) with sequence_id and offset."""
    counted = cut.groupBy("length").count().collect()  # at most `size` rows
    slots = plan(np.array([r["length"] for r in counted]), np.array([r["count"] for r in counted]), size)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    blocks = max(1, sum(r["count"] for r in counted) // BLOCK)
    keyed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keyed.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("rank", within.cast("long")).join(ahead, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("block", "ahead")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = 1 + int(slots[:, 2].max(initial=0))
        keys = slots[:, 0] * reach + slots[:, 1]
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            s = slots[np.searchsorted(keys, length * reach + rank, side="right") - 1]
            at = rank - s[:, 1]
            out = {"sequence_id": pa.array(s[:, 4] + at // s[:, 3]), "offset": pa.array(s[:, 5] + at % s[:, 3] * length)}
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(out.values()), names + list(out))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids unless ids=False."""
    cut = pieces(docs, tokenizer, size, ids)
    out = assign(stored(cut if ids else cut.drop("ids"), "pieces"), size)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else []))
