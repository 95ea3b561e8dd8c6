"""Substring dedup by level-wise doubling.

A word is removed if a window of `window` consecutive words covers it whose word sequence also starts anywhere else, in
the same document or another. Levels are window lengths, each twice the one before. At a level, only windows whose two
halves repeat are candidates (at the first level, which knows no halves yet, all are); those that repeat themselves are
extended to twice the length, until no candidates survive. The first level decides what is removed; the last one a
document reaches is the length of its longest repeat, within a factor of two.

Within a level, of each candidate window the half-length window inside it with the smallest hash stands for it (its
anchor), so equal windows have equal anchors at equal places. Anchors that are found once have no repeated window. The
whole stretch of the windows that an anchor stands for is looked up at once; where it is found once but its anchor is not,
so are its single windows. Hashes of longer windows are made from the hashes of their halves.

From the second level on, what goes on are the segments that candidates cover, as word hashes; equal segments are one
from there, with the mark that all its windows repeat, so a group of copies goes on as a single one.

Copies within a task are counted before the shuffle, so a passage in every document costs each task one row for each of
its contexts; counting is by window functions over hash keys, which spill. A window repeats if 128 bits of its hashes do.

Windows never reach over documents. They are judged on the input, not on what is left.

Defined results: null and empty texts have no words; a text shorter than a window keeps all; rows that repeat another's
id and text are copies of each other; a row without id is a document too; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, slices, stored, string_bytes
from .hashing import grams, mix, pair, ragged, word_hashes, words

WINDOW = 35
#: Anchors (or windows) of a task that are held together to count copies before the shuffle.
HELD = 400_000
_FOUND = pa.schema([("key", pa.int64()), ("ext", pa.int64()), ("times", pa.int8()), ("uid", pa.int64()), ("uid2", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
_ROWS = "key long, ext long, times byte, uid long, uid2 long, at int, n int"
_SEGMENT = pa.schema([("uid", pa.int64()), ("uid2", pa.int64()), ("body", pa.binary()), ("weight", pa.int32())])
_SEGMENTS = "uid long, uid2 long, body binary, weight int"
_ID = ["uid", "uid2"]
#: Parts of the rows that share a segment; a group of copies all share theirs.
SPREAD = 32


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each `width` neighbouring values stands, the leftmost of equal ones."""
    place, span = np.arange(len(values)), 1
    while span < width:
        by = min(span, width - span)
        take = values[by:] < values[:-by]
        place = np.where(take, place[by:], place[:-by])
        values = np.where(take, values[by:], values[:-by])
        span += by
    return place


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts (or segments), and where each begins among them."""
    if "text" in batch.schema.names:
        data, ends = string_bytes(batch.column("text"))
        starts, stops, count = words(data, ends)
        return word_hashes(data, starts, stops), count
    data, ends = string_bytes(batch.column("body"))
    return np.frombuffer(data.tobytes(), np.uint64), ends // 8


def second(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same words."""
    return mix(h ^ np.uint64(0xA0761D6478BD642F))


def anchors(h: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For each run of windows of one text that share an anchor: the anchor's hash, the stretch's hash, the text's number,
    the first window's first word in its text, and how many windows there are."""
    half = (window + 1) // 2
    whole, part = grams(h, window), grams(h, half)
    if not len(whole):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    owner = np.repeat(np.arange(len(count) - 1), np.diff(count))
    inside = np.flatnonzero(owner[: len(whole)] == owner[window - 1 :])
    place, text = smallest(part, window - half + 1)[inside], owner[inside]
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])] if len(inside) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    n = np.diff(np.r_[run, len(inside)])
    first = inside[run]
    stretch = pair(whole[first], whole[first + n - 1]) + n.astype(np.uint64)
    return part[place[run]], stretch, text[run], first - count[text[run]], n


def _counted(key: np.ndarray, ext: np.ndarray, uid: np.ndarray, uid2: np.ndarray, at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Rows with times: 1 if (key, ext) is alone here; else 2 for one of its rows, and 0 (under a key of its own) for the rest."""
    order = np.lexsort((ext, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (ext[order][1:] != ext[order][:-1])] if len(key) else np.zeros(0, bool)
    times = np.zeros(len(key), np.int8)
    if len(key):
        times[order[new]] = np.minimum(np.add.reduceat(weight[order], np.flatnonzero(new)), 2)
    key = np.where(times == 0, mix(uid.view(np.uint64) + at.astype(np.uint64)), key)
    return record(_FOUND, key=key.view(np.int64), ext=ext.view(np.int64), times=times, uid=uid, uid2=uid2, at=at.astype(np.int32), n=n.astype(np.int32))


def _held(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Record batches of the parts (as of _counted), HELD rows or a little more together."""
    held: list[tuple[np.ndarray, ...]] = []
    for got in parts:
        held.append(got)
        if sum(len(p[0]) for p in held) >= HELD:
            yield _counted(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield _counted(*map(np.concatenate, zip(*held, strict=True)))


def _column(batch: pa.RecordBatch, name: str, of: np.ndarray) -> np.ndarray:
    return batch.column(name).to_numpy()[of]


def _stretches(rows: DataFrame, window: int, body: str) -> DataFrame:
    """Rows whose anchor repeats: uid, uid2, at, n, `alone` (its stretch is found once), `shown` (one row of each stretch of
    an anchor that has alone ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in slices(batches, body):
                key, ext, text, at, n = anchors(*hashed(batch), window)
                yield key, ext, _column(batch, "uid", text), _column(batch, "uid2", text), at, n, _column(batch, "weight", text)

        yield from _held(parts())

    found = rows.select(*_ID, "weight", body).mapInArrow(run, _ROWS)
    by_stretch = Window.partitionBy("key", "ext")
    by_key = Window.partitionBy("key")
    # the window over keys comes first: its partitions serve the stretches too
    counted = found.withColumn("of_key", F.sum("times").over(by_key))
    counted = counted.withColumns({"of_ext": F.sum("times").over(by_stretch), "nth": F.row_number().over(by_stretch.orderBy(F.desc("times")))})
    counted = counted.withColumn("alone", (F.col("of_ext") == 1) & (F.col("times") > 0)).withColumn("mixed", F.max("alone").over(by_key))
    repeated = counted.where("of_key > 1 or times = 0")
    return repeated.select(*_ID, "at", "n", "alone", (F.col("mixed") & (F.col("nth") == 1) & (F.col("times") > 0)).alias("shown"))


def _singles(rows: DataFrame, shown: DataFrame, window: int, body: str) -> DataFrame:
    """uid, uid2, at, n of the windows of alone stretches that repeat."""
    wanted = shown.groupBy(*_ID).agg(F.collect_list(F.struct("at", "n", "alone")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in slices(batches, body):
                h, count = hashed(batch)
                whole, other = grams(h, window), grams(second(h), window)
                runs = batch.column("runs")
                flat = runs.flatten()
                at, n, alone = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                text = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
                spot = ragged(at, n)
                text, alone = np.repeat(text, n), np.repeat(alone, n)
                # n tells here whether the window is of an alone stretch; a row of times 2 stands for both kinds
                yield whole[count[text] + spot], other[count[text] + spot], _column(batch, "uid", text), _column(batch, "uid2", text), spot, alone, _column(batch, "weight", text)

        yield from _held(parts())

    found = rows.select(*_ID, "weight", body).join(wanted, _ID).mapInArrow(run, _ROWS)
    again = F.sum("times").over(Window.partitionBy("key", "ext"))
    return found.withColumn("again", again).where("n = 1 and (again > 1 or times = 0)").select(*_ID, "at", F.lit(1).alias("n"))


def level(rows: DataFrame, window: int, body: str) -> DataFrame:
    """Stored: the runs (uid, uid2, at: first word, n: windows) of repeated windows. rows have uid, uid2, weight (1; 2 if all
    their windows repeat) and a body: text, or the hashes of a segment's words."""
    found = stored(_stretches(rows, window, body), "stretches")
    whole = found.where(~F.col("alone")).select(*_ID, "at", "n")
    return stored(whole.unionByName(_singles(rows, found.where("shown or alone").select(*_ID, "at", "n", "alone"), window, body)), "runs")


def _spans(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*_ID).agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _marked(size: int, spans: list, reach: int) -> np.ndarray:
    """Marks `reach` places from the first window of each run to the last one on."""
    mark = np.zeros(size + 1, np.int32)
    at = np.array([x["at"] for x in spans])
    np.add.at(mark, at, 1)
    np.add.at(mark, at + np.array([x["n"] for x in spans]) + reach - 1, -1)
    return np.cumsum(mark[:-1]) > 0


def segments(h: np.ndarray, spans: list, window: int) -> list[bytes]:
    """What the candidates of twice the length cover, as word hashes. A window is a candidate if both its halves repeat."""
    if len(h) < 2 * window:
        return []
    half = _marked(len(h), spans, 1)
    both = np.r_[False, half[:-window] & half[window:], False]
    begin, end = np.flatnonzero(both[1:] & ~both[:-1]), np.flatnonzero(both[:-1] & ~both[1:])
    return [h[a : b + 2 * window - 1].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _shorter(rows: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The segments of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            h, count = hashed(batch)
            ids = zip(*(batch.column(c).to_pylist() for c in ("uid", "uid2", "weight", "spans")), strict=True)
            out = [(uid, uid2, part, weight) for k, (uid, uid2, weight, spans) in enumerate(ids) for part in segments(h[count[k] : count[k + 1]], spans, window)]
            if out:
                yield record(_SEGMENT, **dict(zip(_SEGMENT.names, map(list, zip(*out, strict=True)), strict=True)))

    return rows.select(*_ID, "weight", "body").join(_spans(runs), _ID).mapInArrow(run, _SEGMENTS)


def longest(found: DataFrame, window: int) -> DataFrame:
    """uid, uid2 and longest, the greatest level (twice the window, four times, ...) at which a window of the row repeats, of
    rows that have any. found has uid, uid2, body (a segment) and weight, the candidates of the second level."""
    reached: list[DataFrame] = []
    links = None
    every = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread")
    while True:
        found = stored(found.withColumns({"seg": F.xxhash64("body"), "seg2": F.xxhash64(F.lit(2), "body")}), "segments")
        if found.isEmpty():  # no candidate survives
            break
        down = found.select(*_ID, "seg", "seg2").distinct()
        if links is not None:  # which rows have the segment that this one is part of
            parts = down.select(F.col("uid").alias("seg"), F.col("uid2").alias("seg2"), F.col("seg").alias("new"), F.col("seg2").alias("new2"), every)
            down = links.join(parts, ["seg", "seg2", "spread"])
            down = down.select(*_ID, F.col("new").alias("seg"), F.col("new2").alias("seg2")).distinct()
        links = stored(down.withColumn("spread", F.pmod(F.xxhash64(*_ID), F.lit(SPREAD)).cast("int")), "segment-links")
        window *= 2
        rows = found.groupBy("seg", "seg2").agg(F.first("body").alias("body"), F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"))
        rows = stored(rows.withColumnsRenamed({"seg": "uid", "seg2": "uid2"}), "distinct-segments")
        runs = level(rows, window, "body")
        if runs.isEmpty():
            break
        alive = runs.select(F.col("uid").alias("seg"), F.col("uid2").alias("seg2")).distinct().select("*", every)
        reached.append(stored(links.join(alive, ["seg", "seg2", "spread"], "left_semi").select(*_ID).distinct().withColumn("longest", F.lit(window).cast("long")), "reached"))
        found = _shorter(rows, runs, window)
    out = found.select(*_ID, F.lit(0).cast("long").alias("longest"))
    for more in reached:
        out = out.unionByName(more)
    return out.groupBy(*_ID).agg(F.max("longest").alias("longest"))


def dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", levels: bool = True) -> DataFrame:
    """docs with the text's kept words joined by one space (as it was where nothing goes), and the columns n_words,
    n_removed, kept_sha256 (of the joined words) and longest (the level of the longest repeat: `window` words, twice, four
    times as many, ...; 0 without any). An equally named column of docs gives way. levels=False ends after the first level,
    which gives all but `longest`."""
    extra = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}
    docs = docs.drop(*extra, "longest")
    body = F.coalesce(F.col(text), F.lit(""))
    ids = {"uid": F.xxhash64(F.col(key), body), "uid2": F.xxhash64(F.lit(2), body, F.col(key))}
    runs = level(docs.select(*(v.alias(k) for k, v in ids.items()), body.alias("text"), F.lit(1).alias("weight")), window, "text")
    # names that no column of docs has
    taken = {c.lower() for c in docs.columns}
    uid, uid2, spans, parts = (next(n for n in (name + "_" * k for k in range(1, len(taken) + 2)) if n not in taken) for name in ("uid", "uid2", "spans", "segments"))
    whole = docs.withColumns({uid: ids["uid"], uid2: ids["uid2"]})
    whole = whole.join(_spans(runs).withColumnsRenamed({"uid": uid, "uid2": uid2, "spans": spans}), [uid, uid2], "left")
    schema = whole.drop(spans).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            kept, total, gone, sha, further = [], [], [], [], []
            told = batch.column(spans).to_pylist()
            for body, found in zip(batch.column(text).to_pylist(), told, strict=True):
                raw = (body or "").encode().split()
                total.append(len(raw))
                if found:
                    stay = np.flatnonzero(~_marked(len(raw), found, window))
                    joined = b" ".join([raw[i] for i in stay.tolist()])
                    gone.append(len(raw) - len(stay))
                    kept.append(joined.decode())
                else:
                    joined = b" ".join(raw)
                    gone.append(0)
                    kept.append(body)
                sha.append(hashlib.sha256(joined).hexdigest())
            if levels:
                h, count = hashed(pa.RecordBatch.from_arrays([batch.column(text).fill_null("")], ["text"]))
                further = [segments(h[count[k] : count[k + 1]], found, window) if found else [] for k, found in enumerate(told)]
            columns = [pa.array(kept, pa.string()) if n == text else batch.column(n) for n in names]
            columns += [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), *([pa.array(further, pa.list_(pa.binary()))] if levels else [])]
            yield pa.RecordBatch.from_arrays(columns, [*names, *extra, *([parts] if levels else [])])

    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{n} {t}" for n, t in extra.items()), *([f"{parts} array<binary>"] if levels else [])])
    done = whole.mapInArrow(run, told)
    if not levels:
        return done.drop(uid, uid2)
    done = stored(done, "deduplicated")
    found = done.select(F.col(uid).alias("uid"), F.col(uid2).alias("uid2"), F.explode(parts).alias("body"), F.lit(1).alias("weight"))
    most = longest(found, window).withColumnsRenamed({"uid": uid, "uid2": uid2})
    first = F.when(F.col("n_removed") > 0, F.lit(window)).otherwise(0).cast("long")
    return done.drop(parts).join(most, [uid, uid2], "left").drop(uid, uid2).withColumn("longest", F.greatest(first, F.coalesce("longest", F.lit(0).cast("long"))))
