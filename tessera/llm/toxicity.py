"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

A document's words are tokens; a chain is a line of text. Each token is clean or toxic. Its
features are hashes of the word, of its first four, five and six bytes, of its last three, and of the words beside it;
the chain adds a weight for each pair of neighbouring states. Labels mark documents, so tokens are labelled first: in a
toxic document those are toxic that have a feature which training documents show in toxic ones alone or nearly so; in
others none is. The field is then fitted by stochastic gradient on forward-backward expectations. A document's score is
its largest toxic marginal, calibrated by logistic regression on the training documents.

Training reads at most `train_docs` labelled documents of at most `train_bytes` bytes together (half of each label, by a
hash of the id; a text that does not fit into what is left is passed over); scoring reads every token of every document.
Long chains are computed in blocks, whose transfer matrices carry the messages across exactly.

Defined results: null and empty texts get the score of a document without tokens; without labelled rows of both kinds
every score is 0; null labels are left out, of repeated ones the largest counts; of labelled rows that repeat an id the
smallest text is learnt from; rows without doc_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, slices, stored, string_bytes, texts
from .hashing import _BASE, _BASE_INVERSE, _BYTE, _FOLD, _power, mix

#: Labelled documents that training reads at most, and their bytes.
TRAIN_DOCS, TRAIN_BYTES = 2400, 24 << 20
#: Tokens of a block, and the bits of a feature number.
BLOCK, BITS = 256, 22
WEIGHTS = 1 << BITS
SCORED = "doc_id long, score double, n_spans int, starts array<int>, stops array<int>"
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_spans", pa.int32()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Field:
    """Weights of the features for the toxic state, of the transitions, and the calibration."""

    weights: np.ndarray
    change: np.ndarray  # [before, after]
    slope: float
    shift: float
    empty: bool = False


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of letters) in bytes, and where each text's words begin among them."""
    solid = _LETTER[data]
    mark = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) if len(data) > 2 else np.zeros(0, np.int64)
    for k in range(3):  # dashes, quotation marks and the like are no letters
        solid[mark + k] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.r_[False, solid[:-1]] if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.r_[solid[1:], False] if len(solid) else solid
    return starts, np.flatnonzero(solid & (~after | edge[1:])) + 1, np.searchsorted(starts, ends)


def features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature numbers of every token, a row for each kind of feature. first: tokens that begin a chain."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * _power(_BASE, len(data)), out=total[1:])
    back = _power(_BASE_INVERSE, max(1, len(data)))

    def piece(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return mix((total[b] - total[a]) * back[np.minimum(a, len(back) - 1)] + np.uint64(kind))

    word = piece(starts, stops, 0)
    out = [word, *(piece(starts, np.minimum(stops, starts + k), k) for k in (4, 5, 6)), piece(np.maximum(starts, stops - 3), stops, 9)]
    start, stop = mix(np.array([11, 12], np.uint64))
    left = np.r_[start, word[:-1]] if len(word) else word
    right = np.r_[word[1:], stop] if len(word) else word
    left = np.where(first, start, left)
    right = np.where(np.r_[first[1:], True] if len(first) else first, stop, right)
    out += [mix(left + np.uint64(21)), mix(right + np.uint64(22))]
    return (np.stack(out) >> np.uint64(64 - BITS)).astype(np.int32)


def chains(data: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Marks the tokens that begin a chain: the first of a text, and of a line."""
    first = np.zeros(len(starts), bool)
    first[count[:-1][count[:-1] < count[1:]]] = True
    first[np.searchsorted(starts, np.flatnonzero(data == 0x0A))[:, None].ravel().clip(max=len(starts) - 1)] = True if len(starts) else False
    return first


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.reshape(len(x), -1).sum(1).reshape((-1,) + (1,) * (x.ndim - 1))


def marginals(emit: np.ndarray, first: np.ndarray, change: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The toxic state's probability of each token by forward-backward, all blocks a step at a time; and the expected
    numbers of the state pairs. first marks the chains."""
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2)) if pairs else None
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.flatnonzero((np.arange(n) - begin) % BLOCK == 0)
    nth = (at - begin[at]) // BLOCK  # of its chain
    size = np.diff(np.r_[at, n])
    last = at + size - 1
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")  # blocks with a token at each step
    grow = np.exp(change)
    odds = np.exp(np.clip(emit, -30, 30))
    weight = np.stack([np.ones(n), odds], 1)
    # what a block makes of a message before its first token, as a matrix, of blocks in chains that have several
    several = np.r_[nth[1:] > 0, False] | (nth > 0)
    whole = np.tile(np.eye(2), (len(at), 1, 1))
    if several.any():
        of = order[several[order]]
        left = np.searchsorted(-size[of], -np.arange(1, size[of[0]] + 1), side="right")
        m = np.eye(2) * weight[at[of]][:, None, :]
        for t in range(1, size[of[0]]):
            k = left[t]
            m[:k] = _scaled((m[:k] @ grow) * weight[at[of[:k]] + t][:, None, :])
        whole[of] = m
    enter, leave = np.ones((len(at), 2)), np.ones((len(at), 2))
    for step in range(1, int(nth.max()) + 1):
        b = np.flatnonzero(nth == step)
        enter[b] = _scaled(np.einsum("ij,ijk->ik", enter[b - 1], whole[b - 1]) @ grow)
    for step in range(int(nth.max()), 0, -1):
        b = np.flatnonzero(nth == step)
        leave[b - 1] = _scaled(np.einsum("ijk,ik->ij", whole[b], leave[b]) @ grow.T)
    f, b = np.empty((n, 2)), np.empty((n, 2))
    here = _scaled(enter[order] * weight[at[order]])
    f[at[order]] = here
    for t in range(1, size.max()):
        k = alive[t]
        here = _scaled((here[:k] @ grow) * weight[at[order[:k]] + t])
        f[at[order[:k]] + t] = here
    b[last] = leave
    counts = np.zeros((2, 2))
    for t in range(int(size.max()) - 2, -1, -1):
        k = alive[t + 1]
        spot = at[order[:k]] + t
        ahead = b[spot + 1] * weight[spot + 1]
        b[spot] = _scaled(ahead @ grow.T)
        if pairs:
            counts += _scaled(f[spot][:, :, None] * grow * ahead[:, None, :]).sum(0)
    if pairs and several.any():
        spot = at[nth > 0] - 1
        counts += _scaled(f[spot][:, :, None] * grow * (b[spot + 1] * weight[spot + 1])[:, None, :]).sum(0)
    p = f * b
    return p[:, 1] / p.sum(1), counts if pairs else None


def _encoded(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return string_bytes(pa.array(rows, pa.large_string()))


def _described(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and chain marks of all tokens, and each text's number of tokens."""
    starts, stops, count = tokens(data, ends)
    first = chains(data, starts, count)
    return features(data, starts, stops, first), first, np.diff(count)


def _befores(rows: list[str], of: np.ndarray) -> np.ndarray:
    """How many different words stand before each word or beginning where it first stands in a text: copies of a text, or a
    text that repeats itself, add nothing."""
    pairs: list[list[np.ndarray]] = [[] for _ in range(4)]
    for at in range(0, len(of), 64):
        x, _, n = _described(*_encoded([rows[d] for d in of[at : at + 64]]))
        doc = np.repeat(np.arange(len(n)), n)
        for kind, met in enumerate(pairs):
            key = x[kind].astype(np.int64) << 32
            first_in = np.unique(key | doc, return_index=True)[1]
            met.append(np.unique(key[first_in] | x[5, first_in].astype(np.int64)))
            if len(met) > 1 and len(met[-1]) * 2 > len(met[-2]):  # merged like a binary counter's digits
                met[-2:] = [np.unique(np.concatenate(met[-2:]))]
    seen = np.zeros(WEIGHTS, np.float32)
    for met in pairs:
        if met:
            np.add.at(seen, np.unique(np.concatenate(met)) >> 32, 1)
        met.clear()
    return seen


def fit(rows: list[str], toxic: np.ndarray, epochs: int = 4, rate: float = 0.5, decay: float = 1e-4, odds: float = 3.0, least: int = 2, share: float = 0.02) -> Field:
    """Fits the field to whole texts and their labels. A telling feature first stands after at least `least` different
    words in toxic texts, and at least that share of their number. Only the texts are held; the features of a part of them
    are made anew whenever they are read, so that the driver's memory does not follow the number of tokens."""
    none = Field(np.zeros(1, np.float32), np.zeros((2, 2)), 0.0, 0.0, True)
    if not len(rows) or toxic.all() or not toxic.any():
        return none
    # every eighth text of each label is kept back to calibrate on
    back = np.zeros(len(rows), bool)
    for label in (False, True):
        back[np.flatnonzero(toxic == label)[4::8]] = True
    learnt = [~toxic & ~back, toxic & ~back]
    seen = [_befores(rows, np.flatnonzero(own)) for own in learnt]
    often = np.flatnonzero(seen[1] >= max(least, share * learnt[1].sum()))
    telling = np.log((seen[1][often] + 0.5) / learnt[1].sum()) - np.log((seen[0][often] + 0.5) / learnt[0].sum())
    marks = np.zeros(WEIGHTS, bool)
    marks[often[telling >= odds]] = True
    del seen
    weights, sums, bias = np.zeros(WEIGHTS + 1, np.float32), np.full(WEIGHTS, 1e-2, np.float32), np.float64(-3.0)
    change, change_sums = np.zeros((2, 2)), np.full((2, 2), 1.0)
    order = np.random.default_rng(8).permutation(np.flatnonzero(~back))
    for _ in range(epochs):
        for part in np.array_split(order, max(1, len(order) // 100)):
            part = np.sort(part)
            xs, fs, n = _described(*_encoded([rows[d] for d in part]))
            if not len(fs):
                continue
            ys = (np.repeat(toxic[part], n) & marks[xs[:4]].any(0)).astype(float)
            p, expected = marginals(weights[xs].sum(0) + bias, fs, change, True)
            off = ys - p
            used, at = np.unique(xs, return_inverse=True)
            step = np.bincount(at.ravel(), np.broadcast_to(off, xs.shape).ravel()) - decay * weights[used] * len(part)
            sums[used] += step * step
            weights[used] += rate * step / np.sqrt(sums[used])
            bias += 0.1 * np.sign(off.sum()) * min(1.0, abs(off.sum()) / max(1.0, ys.sum()))
            inner = np.flatnonzero(~fs)
            real = np.zeros((2, 2))
            np.add.at(real, (ys[inner - 1].astype(int), ys[inner].astype(int)), 1)
            turn = real - expected
            change_sums += turn * turn
            change += 0.2 * turn / np.sqrt(change_sums)
    weights[-1] = bias
    field = Field(weights, change, 1.0, 0.0)
    held = back if (toxic & back).any() and (~toxic & back).any() else np.ones(len(rows), bool)
    top = []
    for part in np.array_split(np.flatnonzero(held), max(1, held.sum() // 64)):
        x, first, n = _described(*_encoded([rows[d] for d in part]))
        top.append(peaks(marginals(weights[x].sum(0) + weights[-1], first, change)[0], np.r_[0, np.cumsum(n)]))
    top, toxic = _logit(np.concatenate(top)), toxic[held]
    # logistic regression of the label on the largest marginal's log-odds, over the texts kept back
    slope, shift, t = 1.0, 0.0, toxic.astype(float)
    weigh = np.where(toxic, 0.5 / t.mean(), 0.5 / (1 - t).mean())
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(slope * top + shift, -30, 30)))
        g = weigh * (q - t)
        h = weigh * q * (1 - q) + 1e-6
        aa, ab, bb, ga, gb = (h * top * top).sum() + 2, (h * top).sum(), h.sum() + 2, (g * top).sum() + 2 * (slope - 1), g.sum() + 2 * shift
        move = np.array([bb * ga - ab * gb, aa * gb - ab * ga]) / (aa * bb - ab * ab)
        slope, shift = slope - np.clip(move[0], -0.5, 0.5), shift - np.clip(move[1], -0.5, 0.5)
    field.slope, field.shift = float(max(slope, 1e-3)), float(shift)
    return field


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def peaks(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each text's largest marginal (none: 0)."""
    out = np.zeros(len(count) - 1)
    some = np.flatnonzero(np.diff(count) > 0)
    if len(some):
        out[some] = np.maximum.reduceat(p, count[some])
    return out


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Field:
    """Fits on labelled documents, never on those with crc32(doc_id as text) mod 3 = 1."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out()).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    some = [known.where(F.col("toxic") == label).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(train_docs // 2) for label in (0, 1)]
    chosen = some[0].unionByName(some[1])  # train_docs rows at most
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen.collect(), chosen.schema)
    found = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "turn").agg(F.min("text").alias("text"))
    found = stored(found, "training-texts")
    picked, room = [], {0: train_bytes // 2, 1: train_bytes // 2}
    for r in sorted(found.select("doc_id", "toxic", "turn", F.octet_length("text").alias("size")).collect(), key=lambda r: (r["turn"], r["doc_id"])):
        if r["size"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"]
            picked.append((r["doc_id"],))
    if not picked:
        return fit([], np.zeros(0, bool))
    rows = found.join(F.broadcast(spark.createDataFrame(picked, "doc_id long")), "doc_id", "left_semi").select("doc_id", "toxic", "text").collect()  # train_bytes at most
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def _score(field: Field, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each text's score; all tokens' marginals, starts, stops, and the texts' first tokens among them."""
    starts, stops, count = tokens(data, ends)
    if field.empty:
        return np.zeros(len(ends) - 1), np.zeros(len(starts)), starts, stops, count
    first = chains(data, starts, count)
    x = features(data, starts, stops, first)
    p, _ = marginals(field.weights[x].sum(0) + field.weights[-1], first, field.change)
    score = 1 / (1 + np.exp(-np.clip(field.slope * _logit(peaks(p, count)) + field.shift, -30, 30)))
    return score, p, starts, stops, count


def tag(docs: DataFrame, field: Field, at: float = 0.5) -> DataFrame:
    """Every document's score and the byte offsets of its toxic spans (neighbouring tokens with marginals of `at` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, "text"):
            data, ends = string_bytes(batch.column("text"))
            rows = batch.num_rows
            score, p, starts, stops, count = _score(field, data, ends)
            hot = np.flatnonzero(p >= at)
            owner = np.searchsorted(count, hot, side="right") - 1
            # a span goes on while the next hot token follows in the same text
            new = np.r_[True, (np.diff(hot) > 1) | (np.diff(owner) > 0)] if len(hot) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            last = np.r_[begin[1:], len(hot)] - 1 if len(begin) else begin
            who = owner[begin]
            many = np.bincount(who, minlength=rows)
            cuts = np.r_[0, np.cumsum(many)].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array((side - ends[who]).astype(np.int32))) for side in (starts[hot[begin]], stops[hot[last]])]
            yield record(_SCORED, doc_id=batch.column("doc_id"), score=score, n_spans=many.astype(np.int32), starts=lists[0], stops=lists[1])

    return texts(docs).mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, field: Field, at: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text (null: empty) scores below `at`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            body = batch.column("text").fill_null("")
            yield batch.filter(pa.array(_score(shared.value, *string_bytes(body))[0] < at))

    return docs.mapInArrow(run, docs.schema)


def scores(docs: DataFrame, labels: DataFrame, at: float = 0.7, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The contract's rows."""
    out = tag(docs, train(docs, labels, train_docs))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "n_spans", "starts", "stops")
