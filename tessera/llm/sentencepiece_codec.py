"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no piece of the vocabulary can reach across: into chunks before a run of spaces, around a line feed
and between letters and other characters, and those into parts between characters that no piece has side by side. Each
part is merged by itself: a row of symbols, linked to their neighbours, with an agenda of adjacent pairs that make a
piece, a heap ordered by score and then by place. The best pair is merged, its neighbours get new agenda entries, and
entries whose symbols have changed are passed over, until the agenda is empty: n log n steps for n characters. Symbols
that are no piece become byte pieces.

Every chunk that the worker has not met is checked against the sentencepiece library, some in one text, and so is one
whole text of each slice, its decoding included; a difference fails the task. Texts are decoded from their ids by a table
of the pieces' bytes.

Defined results: a null or empty text has the begin and end ids only and decodes to the empty text; equal texts have
equal ids; rows without doc_id are left out.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record, slices, texts

SPACE = "▁"
#: Chunks that a worker remembers (speed only); beyond, it starts anew, and takes what it meets again from as many before.
REMEMBERED = 400_000
#: Texts whose chunks are looked up at once, new chunks that the library is given in one text, ids decoded in one numpy step.
TOGETHER, CHECKED, STEP = 256, 16, 1 << 18
ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_LETTER = re.compile(r"[^\W\d_]")
_codecs: dict[str, Codec] = {}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _runs(pieces: list[str]) -> re.Pattern[str]:
    """A chunk: letters with the spaces before them, other characters likewise, spaces, or a line feed. Letters that a piece
    has beside other characters count among those."""
    odd: set[str] = set()

    def letters(p: str) -> list[str]:
        return [c for c in p if c not in odd and _LETTER.match(c)]

    while more := {c for p in pieces if 0 < len(found := letters(p)) < len(p.lstrip(" ")) for c in found}:
        odd |= more
    e = "".join(sorted(odd))
    return re.compile(rf" *[^\W\d_{e}]+| *(?:[^\w \n]+|[\d_{e}]+)++| +|\n")


class Codec:
    """One vocabulary, with the ids of the chunks met so far. Chunks and parts are held with plain spaces, which keeps most
    of them at a byte a character."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids) or len(self.bytes) < 256:
            raise ValueError("this vocabulary has pieces that reach over a space or line feed, or lacks byte pieces")
        self.begin, self.end = sp.bos_id(), sp.eos_id()

        # symbols: pieces by their ids, then characters of pieces that are none themselves, any other character, and none
        self.n_pieces = n
        letters = sorted({c for p in ids for c in p})
        single = [c for c in letters if c not in ids]
        self.symbols = {c: ids[c] for c in letters if c in ids} | {c: n + k for k, c in enumerate(single)}
        self.other, self.gone = n + len(single), n + len(single) + 1
        self.base = self.gone + 1
        # two symbols that make a piece: the agenda's order (pieces by falling score), and the piece
        scores = {p: sp.get_score(i) for p, i in ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        number = self.symbols | ids
        splits = [(number[p[:k]] * self.base + number[p[k:]], p) for p in ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.rank = {pair: place[scores[p]] for pair, p in splits}
        self.made = {pair: ids[p] for pair, p in splits}

        # which characters pieces have side by side
        plain = [p.replace(SPACE, " ") for p in ids]
        dense = {c: k for k, c in enumerate(sorted({c for p in plain if len(p) > 1 for c in p}), 1)}
        self.dense = np.zeros(0x110000, np.int32)
        self.dense[[ord(c) for c in dense]] = list(dense.values())
        self.near = np.zeros((len(dense) + 1, len(dense) + 1), bool)
        for p in plain:
            for k in range(len(p) - 1):
                self.near[dense[p[k]], dense[p[k + 1]]] = True
        self.cut = _runs(plain).findall

        # what each id decodes to
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        out = [byte_of.get(i, b"" if i in (self.begin, self.end) else p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)]
        self.letters = np.frombuffer(b"".join(out), np.uint8)
        self.width = np.array([len(x) for x in out], np.int64)
        self.start = np.cumsum(self.width) - self.width

        self.line = self.encoded("\n")
        self.known: dict[str, bytes] = {"\n": self.line}
        self.aged: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        return " " + text.replace(SPACE, " ") if text else ""

    def parted(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The parts of all chunks (none of them a line feed) that no piece reaches across, and how many each chunk has."""
        whole = "\n".join(chunks)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        dense = self.dense[points]
        starts = np.concatenate([[0], np.flatnonzero(~self.near[dense[:-1], dense[1:]]) + 1])
        ends = np.append(starts[1:], len(whole))
        part = points[starts] != 10  # no piece holds a line feed, so each stands alone
        counts = np.diff(np.flatnonzero(~part), prepend=-1, append=len(part)) - 1
        return [whole[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], counts.tolist()

    def merged(self, part: str) -> list[int]:
        """The symbols of a part, at their places, when its agenda is empty. An agenda entry is a number: the rank of the
        piece that two neighbours make, then the place of the left one."""
        base, gone, other, number, made, rank = self.base, self.gone, self.other, self.symbols.get, self.made, self.rank.get
        n = len(part)
        symbol = [number(c, other) for c in part]
        symbol.append(gone)  # ends the part, and stands before its first symbol
        shift = n.bit_length()
        mask = (1 << shift) - 1
        agenda = [r << shift | i for i in range(n - 1) if (r := rank(symbol[i] * base + symbol[i + 1])) is not None]
        if not agenda:
            return symbol
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & mask
            j = after[i]
            pair = symbol[i] * base + symbol[j]
            if rank(pair) != entry >> shift:
                continue  # one of the two has changed since
            symbol[i] = piece = made[pair]
            symbol[j] = gone
            k = after[i] = after[j]
            before[k] = i
            if (r := rank(piece * base + symbol[k])) is not None:
                heappush(agenda, r << shift | i)
            h = before[i]
            if (r := rank(symbol[h] * base + piece)) is not None:
                heappush(agenda, r << shift | h)
        return symbol

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks not known, and holds those not remembered from before against the library."""
        known, aged = self.known, self.aged
        again = chunks & aged.keys()
        known.update((c, aged[c]) for c in again)
        fresh = list(chunks - again)
        if not fresh:
            return
        parts, counts = self.parted(fresh)
        for part in set(parts).difference(known):
            known[part] = aged.get(part) or self.encoded(part.replace(" ", SPACE))
        got, at = [known[p] for p in parts], 0
        for chunk, n in zip(fresh, counts, strict=True):
            if n > 1:
                known[chunk] = b"".join(got[at : at + n])
            at += n
        self.check(fresh, CHECKED)

    def check(self, chunks: list[str], together: int) -> None:
        """Holds chunks against the library, so many in one text."""
        # in the library a text gets one leading space, which most chunks hold already: they follow one another. Others stand
        # behind a line feed each, and the ids of the leading space and the first line feed come first
        words = [c for c in chunks if c[0] == " " and not c.isspace()]
        lines = [c for c in chunks if c[0] != " " or c.isspace()]
        head = _packed(self.library.encode("\n", num_threads=1))
        for some, first, joint, begin in ((words, b"", b"", ""), (lines, head, self.line, "\n")):
            groups = [some[k : k + together] for k in range(0, len(some), together)]
            asked = [begin + begin.join(g) if begin else "".join(g)[1:] for g in groups]
            for group, told in zip(groups, self.library.encode(asked, num_threads=1) if asked else [], strict=True):
                if _packed(told) != first + joint.join([self.known[c] for c in group]):
                    if together > 1:
                        self.check(group, 1)
                    raise ValueError(f"the library encodes {group[0][:80]!r} differently")

    def encoded(self, part: str) -> bytes:
        symbols, n = self.merged(part), self.n_pieces
        ids = [s for s in symbols if s < n]
        if len(ids) + symbols.count(self.gone) < len(symbols):  # characters that are no piece become bytes
            ids = [i for s, c in zip(symbols, part, strict=False) if s != self.gone for i in ([s] if s < n else [self.bytes[b] for b in c.encode()])]
        return _packed(ids)

    def decoded(self, texts: list[bytes]) -> list[str]:
        """The texts of ids: pieces joined, spaces restored, byte pieces read as UTF-8, without the leading space."""
        ids = np.frombuffer(b"".join(texts), "<u4")
        last = np.cumsum([len(t) // 4 for t in texts])
        out, bounds, total = [], [0], 0
        for at in range(0, len(ids), STEP):
            some = ids[at : at + STEP]
            width = self.width[some]
            to = np.cumsum(width)
            out.append(self.letters[np.repeat(self.start[some] - to + width, width) + np.arange(to[-1])].tobytes())
            bounds += (total + to[last[(last > at) & (last <= at + len(some))] - at - 1]).tolist()
            total += int(to[-1])
        whole = b"".join(out)
        return [whole[a + 1 : b].decode(errors="replace") for a, b in pairwise(bounds)]

    def looked_up(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, begin and end included; chunks not known are learnt."""
        cut = [self.cut(self.normalised(t)) for t in texts]
        ends = list(accumulate(map(len, cut), initial=0))
        known, chunks = self.known, cut[0] if len(cut) == 1 else list(chain.from_iterable(cut))
        del cut  # long texts have many chunks
        got = list(map(known.get, chunks))
        missed = [k for k, ids in enumerate(got) if ids is None]
        self.learn({chunks[k] for k in missed})
        for k in missed:
            got[k] = known[chunks[k]]
        del chunks, missed
        begin, end = _packed([self.begin]), _packed([self.end])
        return [begin + b"".join(got[a:b]) + end for a, b in pairwise(ends)]

    def encode(self, batch: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit numbers, begin and end included, and the decoded text, of each text."""
        for at in range(0, len(batch), TOGETHER):
            if len(self.known) > REMEMBERED:
                self.aged, self.known = self.known, {"\n": self.line}
            ids = self.looked_up(batch[at : at + TOGETHER])
            yield from zip(ids, self.decoded(ids), strict=True)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _each(batch: pa.RecordBatch, path: str) -> Iterator[tuple[bytes, str]]:
    rows = batch.column("text").to_pylist()
    c = codec(path)
    got = c.encode(rows)
    for n, (ids, decoded) in enumerate(got):
        if n == 0:
            whole = c.library.encode(rows[0], add_bos=True, add_eos=True)
            if np.array(whole, "<u4").tobytes() != ids or c.library.decode(whole) != decoded:
                raise ValueError("the library encodes or decodes a text differently")
        yield ids, decoded


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with begin and end) and the decoded text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = list(_each(batch, model))
            yield record(_ENCODED, doc_id=batch.column("doc_id"), ids=[np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got], decoded=[d for _, d in got])

    return texts(docs).mapInArrow(run, ENCODED)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """The contract's rows, made from the same codec without carrying ids and texts out of Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, "text"):
            got = [(len(i) // 4, sha(i), sha(d.encode())) for i, d in _each(batch, model)]
            n, ids, decoded = map(list, zip(*got, strict=True))
            yield record(_DIGESTS, doc_id=batch.column("doc_id"), n_tokens=n, ids_sha256=ids, decoded_sha256=decoded)

    return texts(docs).mapInArrow(run, DIGESTS)
