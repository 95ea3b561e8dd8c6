"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct word shingles. Equal sets are one set from the start. Shingles have one global order,
rare ones first (by a sketch of all shingle counts, of fixed size, then by hash). Two sets that are similar enough share a
shingle among the first few of both; an index list holds, for each such shingle, the sets with their size and the
shingle's position in them.

Index lists are skipped by blocks: a list is cut by size class and ordered by position, and its end, from where on no set
of the block can reach the needed overlap, is skipped, as are classes too small or large. A list that may be long, by the
sketch, is dealt out in slices that stand for themselves first. Answers come from related sets: in each block
the set with the commonest rarest shingle (the least edited one) leads, and only it is compared with the others. Its
answers, kept as the shingles by which a set differs from its leader, then give those of the others incrementally: sets
that they already connect need no comparison, and of the rest, two sets of one leader are compared by their differences
alone. Sets without a common leader are compared in full.

Every pair that is similar enough is connected by the links found; components are those of all links. Only where links are
to be counted, pairs that are connected already are answered too.

Defined results: null texts and texts without words have empty sets, which link with nothing; a text with fewer words than
a shingle has one, all of it; rows without id are left out; rows that repeat an id and text count once per row; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, slices, stored, string_bytes
from .components import components
from .hashing import grams, mix, ragged, word_hashes, words

SHINGLE, PERCENT = 5, 75
#: Bits of a sketch cell's number; the sketch has 2^CELLS counts. RANGES parts of it are merged apart.
CELLS, RANGES, SALTS = 20, 16, 16
#: Sets whose postings one reducer holds, about.
SETS_PER_PART = 3000
#: Postings of a list from which on it is dealt out in slices of about as many.
SLICE_POSTINGS = 50_000
#: Parts of a class whose members look their answer up.
SPREAD = 16
_LOW = np.uint64((1 << (64 - CELLS)) - 1)
_POSTING = np.dtype([("key", "<u8"), ("sid", "<i8"), ("lead", "<u4"), ("size", "<i4"), ("pos", "<i4")])


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the distinct lower-cased shingles, ordered by text and hash."""
    starts, stops, count = words(data, ends)
    h = word_hashes(data, starts, stops, lower=True)
    size = np.diff(count)
    owner = np.repeat(np.arange(len(size)), size)
    whole = grams(h, n)
    inside = np.flatnonzero(owner[: len(whole)] == owner[n - 1 :]) if len(whole) else np.zeros(0, np.int64)
    text, value = [owner[inside]], [whole[inside]]
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            text.append(short)
            value.append(mix(grams(h, k)[count[short]] + np.uint64(k)))
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])] if len(text) else np.zeros(0, bool)
    return text[new], value[new]


def _digest(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Stored: doc_id, uid, sid (the set's digest) and size of each document; and the sketch of shingle counts, in parts."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("sid", pa.int64()), ("size", pa.int32()), ("part", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELLS, np.uint32)
        salt = 0
        for batch in slices(batches, "text"):
            text, value = shingle_sets(*string_bytes(batch.column("text")), n)
            counts += np.bincount(value >> np.uint64(64 - CELLS), minlength=1 << CELLS).astype(np.uint32)
            size = np.bincount(text, minlength=batch.num_rows)
            sid = [_digest(v) if len(v) else None for v in np.split(value, np.cumsum(size)[:-1])]
            salt = (batch.column("uid")[0].as_py() or 0) % SALTS
            blank = pa.nulls(batch.num_rows)
            yield record(schema, doc_id=batch.column("doc_id"), uid=batch.column("uid"), sid=sid, size=size.astype(np.int32), part=blank, salt=blank, counts=blank)
        if counts.any():
            parts = [zlib.compress(p.astype("<u8").tobytes(), 1) for p in np.split(counts, RANGES)]
            blank = pa.nulls(RANGES)
            yield record(schema, doc_id=blank, uid=blank, sid=blank, size=blank, part=list(range(RANGES)), salt=[salt] * RANGES, counts=parts)

    both = stored(docs.mapInArrow(run, "doc_id long, uid long, sid long, size int, part int, salt int, counts binary"), "sets")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(blob), "<u8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], ["part", "counts"])

    parts = both.where("part is not null").repartition("part", "salt").select("part", "counts").mapInArrow(merge, "part int, counts binary")
    return both.where("part is null").select("doc_id", "uid", "sid", "size"), parts.repartition("part").mapInArrow(merge, "part int, counts binary")


def _cell_ranks(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The place of each sketch cell when they are ordered by count, and the slices of the lists of each place; fixed size."""
    counts = np.zeros(1 << CELLS, np.uint64)
    width = (1 << CELLS) // RANGES
    for r in parts.collect():  # RANGES rows
        counts[r["part"] * width : (r["part"] + 1) * width] += np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    order = np.argsort(counts, kind="stable")
    ranks = np.empty(1 << CELLS, np.uint64)
    ranks[order] = np.arange(1 << CELLS, dtype=np.uint64)
    return ranks, np.maximum(1, -(-counts[order].astype(np.int64) // SLICE_POSTINGS)).astype(np.uint32)


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -((a + b) * percent // -(100 + percent))


def _candidates(table: np.ndarray, percent: int, sliced: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From postings: pairs of a leader and a set; and the postings of blocks with more than two sets, and of slices."""
    table = np.unique(table[np.lexsort((table["pos"], table["sid"], table["key"]))])
    new = lambda *t: np.any([x[1:] != x[:-1] for x in t], 0)
    starts = lambda *t: np.flatnonzero(np.r_[True, new(*t)]) if len(t[0]) else np.zeros(0, np.int64)
    many = np.diff(np.r_[starts(table["key"]), len(table)])
    part = np.zeros(len(table), bool) if sliced is None else sliced[(table["key"] >> np.uint64(64 - CELLS)).astype(np.int64)] > 1
    stay = (np.repeat(many, many) > 1) | part
    table, part = table[stay], part[stay]
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), table
    size, pos = table["size"].astype(np.int64), table["pos"].astype(np.int64)
    # blocks by size class: linked sizes lie in one class or in neighbouring ones
    step = -np.log(percent / 100) if percent < 100 else 1e-9
    level = np.floor(np.log(size) / step + 1e-9).astype(np.int64)
    # positions too far down for any set: at most the smallest linked size can match
    own = size - pos >= needed(size, -(size * percent // -100), percent)
    by_lead = np.lexsort((table["sid"], ~table["lead"]))
    turn = np.empty(len(table), np.int64)
    turn[by_lead] = np.arange(len(table))
    share = percent / (100 + percent)
    pairs, kept = [], part & own
    for shift in (0, 1):  # classes (0, 1), (2, 3), ... and (1, 2), (3, 4), ...: each two neighbours stand together once
        block = (level + shift) >> 1
        order = np.lexsort((pos, block, table["key"]))  # each block of a list, by position
        first = starts(table["key"][order], block[order])
        n = np.diff(np.r_[first, len(order)])
        lead = by_lead[np.minimum.reduceat(turn[order], first)]
        # from this position on no set of the block reaches the overlap with its leader: the end of the list is not read
        limit = np.floor((1 - share) * np.maximum.reduceat(size[order], first) - share * size[lead] + 1e-6).astype(np.int64)
        deep = int(pos.max()) + 2
        number = np.arange(len(first))
        spot = np.repeat(number, n) * deep + pos[order]
        read = np.searchsorted(spot, number * deep + np.clip(limit, -1, deep - 1), side="right") - first
        a, b = np.repeat(lead, read), order[ragged(first, read)]
        room = np.minimum(size[a] - pos[a], size[b] - pos[b])
        fits = (room >= needed(size[a], size[b], percent)) & (a != b)
        pairs.append(np.unique(np.stack([table["sid"][a[fits]], table["sid"][b[fits]]], 1), axis=0))
        kept[order] |= (np.repeat(n, n) > 2) & own[order]
    pairs = np.unique(np.concatenate(pairs), axis=0)
    return pairs[:, 0], pairs[:, 1], table[kept]


def _postings(docs: DataFrame, ranks: tuple[np.ndarray, np.ndarray], parts: int, n: int, percent: int) -> DataFrame:
    """Stored candidates: rows of a leader (a) and a set (b); and rows of key, sid (a), size, pos where more are together."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sliced = shared.value
        for batch in slices(batches, "text"):
            text, value = shingle_sets(*string_bytes(batch.column("text")), n)
            size = np.bincount(text, minlength=batch.num_rows)
            sid = np.array([_digest(v) for v in np.split(value, np.cumsum(size)[:-1])], np.int64)
            key = place[value >> np.uint64(64 - CELLS)] << np.uint64(64 - CELLS) | value & _LOW
            key = key[np.lexsort((key, text))]
            begin = np.cumsum(size) - size
            pos = np.arange(len(text)) - begin[text]
            front = np.flatnonzero(pos < size[text] - -(size[text] * percent // -100) + 1)
            who = text[front]
            out = np.zeros(len(front), _POSTING)
            out["key"], out["sid"], out["lead"], out["size"], out["pos"] = key[front], sid[who], (key >> np.uint64(32))[begin[who]], size[who], pos[front]
            slice_ = mix(out["sid"].view(np.uint64)) % sliced[(out["key"] >> np.uint64(64 - CELLS)).astype(np.int64)]
            part = ((mix(out["key"]) + slice_) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else []
            if len(edges):
                blobs = [np.unique(x).tobytes() for x in np.split(out[order], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[order][edges], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def meet(group: pa.Table) -> pa.Table:
        table = np.concatenate([np.frombuffer(b.as_buffer(), _POSTING) for b in group.column("blob")])
        a, b, more = _candidates(table, percent, shared.value[1])
        none = lambda k, t: pa.nulls(k, t)
        return pa.Table.from_batches([
            record(schema, key=none(len(a), pa.int64()), a=a, b=b, size=none(len(a), pa.int32()), pos=none(len(a), pa.int32())),
            record(schema, key=more["key"].view(np.int64), a=more["sid"], b=none(len(more), pa.int64()), size=more["size"], pos=more["pos"]),
        ], schema=schema)

    rows = docs.select("uid", "text").mapInArrow(emit, "part int, blob binary")
    return stored(rows.groupBy("part").applyInArrow(meet, "key long, a long, b long, size int, pos int"), "candidates")


def _compared(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, linked, sizes, and the shingles of a without b (lost) and of b without a (added), of sets given by their texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("na", pa.int32()), ("nb", pa.int32()), ("lost", pa.list_(pa.int64())), ("added", pa.list_(pa.int64()))])
    with_b = pairs.join(bodies.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    rows = with_b.join(bodies.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b"):
            names, where = np.unique(batch.column("a").to_numpy(), return_index=True)
            left = {}
            bodies_a = batch.column("text_a").take(pa.array(where))
            text, value = shingle_sets(*string_bytes(bodies_a), n)
            for name, part in zip(names.tolist(), np.split(value, np.searchsorted(text, np.arange(1, len(names)))), strict=True):
                left[name] = part
            text, value = shingle_sets(*string_bytes(batch.column("text_b")), n)
            out = []
            for a, b, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), np.split(value, np.searchsorted(text, np.arange(1, batch.num_rows))), strict=True):
                x = left[a]
                lost, added = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                both = len(x) - len(lost)
                linked = 100 * both >= percent * (len(y) + len(lost))
                # differences are kept where they can serve: of sets a little below the threshold too
                near = 2 * both >= len(y) + len(lost)
                out.append((a, b, linked, len(x), len(y), lost.view(np.int64) if near else None, added.view(np.int64) if near else None))
            if out:
                yield record(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    return rows.mapInArrow(run, "a long, b long, linked boolean, na int, nb int, lost array<long>, added array<long>")


def _derived(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """x, y and linked (null: no common leader) of pairs of sets, from how both differ from a common leader."""
    known = answers.where("lost is not null").select(F.col("a").alias("lead"), F.col("b").alias("sid"), F.col("nb").alias("n"), "na", "lost", "added")
    side = lambda s: known.select("lead", F.col("sid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "na", "lost", "added")))
    rows = pairs.select("x", "y").join(side("x"), "x").join(side("y"), ["lead", "y"])
    overlap = F.col("na_x") - F.size(F.array_union("lost_x", "lost_y")) + F.size(F.array_intersect("added_x", "added_y"))
    linked = 100 * overlap >= percent * (F.col("n_x") + F.col("n_y") - overlap)
    return rows.select("x", "y", linked.alias("linked")).groupBy("x", "y").agg(F.max("linked").alias("linked"))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """One row per document: uid (a hash of key and text), its key as doc_id, class (of linked sets; null without words),
    n_shingles and component_id (the smallest key reachable by links); with links also n_links of its set: all links to
    other sets, copies not counted. That answers every candidate pair, also of sets that are connected already."""
    docs = docs.where(F.col(key).isNotNull())
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), body).alias("uid"), body.alias("text"))
    described, sketch = _sets(docs, n)
    one = described.where("sid is not null").groupBy("sid").agg(F.min("uid").alias("uid"), F.first("size").alias("size"))
    parts = max(64, described.count() // SETS_PER_PART)
    found = _postings(docs, _cell_ranks(sketch), parts, n, percent)
    first = stored(found.where("key is null").select("a", "b").distinct(), "leader-pairs")
    lists = found.where("key is not null").select("key", F.col("a").alias("sid"), "size", "pos")
    used = first.select(F.col("a").alias("sid")).unionByName(first.select(F.col("b").alias("sid"))).unionByName(lists.select("sid")).distinct()
    chosen = one.join(used, "sid").select("uid", "sid")
    bodies = stored(docs.select("uid", "text").join(chosen, "uid").dropDuplicates(["sid"]).select("sid", "text"), "bodies")
    answers = stored(_compared(first, bodies, n, percent), "answers")
    direct = answers.where("linked").select("a", "b")
    label = components(direct)
    # sets of one block that the leaders' answers do not connect yet
    named = lists.join(label.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    if links:  # each set for itself, so that all pairs of a list are open
        named = named.withColumn("component", F.col("sid"))
    main = named.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    main = stored(main, "main-components")
    named = stored(named.join(main, "key"), "open-lists")
    x = (named if links else named.where("component <> main")).select("key", *(F.col(c).alias(c + "_x") for c in ("sid", "size", "pos", "component")))
    y = named.select("key", *(F.col(c).alias(c + "_y") for c in ("sid", "size", "pos", "component")))
    room = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))
    reach = (100 + percent) * room >= percent * (F.col("size_x") + F.col("size_y"))
    open_pairs = x.join(y, "key").where((F.col("component_x") != F.col("component_y")) & reach).select(F.least("sid_x", "sid_y").alias("x"), F.greatest("sid_x", "sid_y").alias("y")).distinct()
    told = answers.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    open_pairs = stored(open_pairs.join(told, ["x", "y"], "left_anti"), "open-pairs")
    derived = stored(_derived(open_pairs, answers, percent), "derived")
    full = _compared(open_pairs.join(derived, ["x", "y"], "left_anti").select(F.col("x").alias("a"), F.col("y").alias("b")), bodies, n, percent)
    later = stored(derived.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(full.where("linked").select("a", "b")), "later-links")
    if not later.isEmpty():
        label = components(direct.unionByName(later))
    # each class of linked sets, then each document by its set; a set that links with nothing stands for itself
    own = described.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    own = own.join(label.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    if links:
        every = direct.unionByName(later).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        degree = every.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
        own = own.join(degree, "sid", "left")
    own = stored(own.withColumn("spread", F.pmod(F.xxhash64("sid"), F.lit(SPREAD))), "classes")
    count = ["n_links"] if links else []
    # a set that stands for itself needs no look-up; a large class is looked up in parts
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = least.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    classes = own.join(least, ["component", "spread"], "left").select("sid", F.col("component").alias("class"), F.coalesce("component_id", "doc_id").alias("component_id"), *count)
    classes = stored(classes, "class-ids")
    count = [F.coalesce(c, F.lit(0)).alias(c) for c in count]
    return described.join(classes, "sid", "left").select("uid", "doc_id", "class", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *count)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without those of a linked class that are not its smallest key (then smallest uid), and
    without repeats of a row's key and text. Rows without words, or without key, stay."""
    found = join(docs, text, key, n, percent).where("class is not null").select("class", "doc_id", "uid")
    kept = stored(found.groupBy("class").agg(F.min(F.struct("doc_id", "uid")).alias("kept")).select(F.col("kept.uid").alias("uid")), "kept")
    gone = found.select("uid").distinct().join(kept, "uid", "left_anti").withColumnRenamed("uid", "__uid")
    named = docs.withColumn("__uid", F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))))
    return named.join(gone, "__uid", "left_anti").transform(_unrepeated)


def _unrepeated(named: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("__uid").orderBy("__uid"))
    with_id, without = named.where("__uid is not null"), named.where("__uid is null")
    return with_id.withColumn("__nth", nth).where("__nth = 1").drop("__nth").unionByName(without).drop("__uid")
