"""Operators on documents: edge cases, and brute-force versions on small tables."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import fingerprints, jaccard_join, licenses, packing, sentencepiece_codec, substring_dedup, token_output  # noqa: E402
from tessera.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed=5):
    """Random texts with copies, near copies, shared passages, nulls, empty and very long ones, odd spaces."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = words(60), words(150)
    texts = [None, "", " \t\n", "one", "one two three", "ONE two  three", " ".join(words(9000)), "a " * 300, "a b " * 200]
    texts += [" ".join(words(r.randint(1, 200))) for _ in range(40)]
    texts += [" ".join(words(r.randint(0, 50)) + passage + words(r.randint(0, 50))) for _ in range(12)]
    for _ in range(14):
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(base), "\n".join(base).upper(), " ".join(base), texts[12], texts[12], "x\x00y \x1c z w v 😀"]
    rows = [(i * 3 + 1, t, None if i % 4 else "en", "src0" if i % 3 else None, None) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names the operators use within
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({"uid": F.lit(7), "key": F.lit("k"), "size": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def brute_dedup(rows, window=35):
    seen = Counter()
    parts = {i: WORD.findall(t or "") for i, t, *_ in rows}
    for w in parts.values():
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = {}
    for i, w in parts.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def brute_longest(rows, window=35):
    """The greatest of window, twice that, ... at which a window of the row repeats."""
    parts, out, size = [WORD.findall(t or "") for _, t, *_ in rows], [0] * len(rows), window
    while True:
        seen = Counter(tuple(w[k : k + size]) for w in parts for k in range(len(w) - size + 1))
        hit = [any(seen[tuple(w[k : k + size])] > 1 for k in range(len(w) - size + 1)) for w in parts]
        if not any(hit):
            return {r[0]: x for r, x in zip(rows, out, strict=True)}
        out, size = [size if h else x for h, x in zip(hit, out, strict=True)], 2 * size


@pytest.mark.parametrize("window", [35, 8, 1])
def test_substring_dedup(docs, window):
    found = by_id(substring_dedup.dedup(docs, window))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found.items()} == brute_dedup(corpus(), window)
    if window > 1:
        assert {i: r["longest"] for i, r in found.items()} == brute_longest(corpus(), window)


def test_substring_dedup_levels(spark, monkeypatch):
    """A repeat of 300 words goes through 35, 70, 140 and 280 words; no candidate of 560 words survives."""
    r = random.Random(11)
    word = lambda n: [str(r.random()) for _ in range(n)]
    long, short = word(300), word(100)
    rows = [(1, " ".join(word(20) + long + word(9))), (2, " ".join(long + word(50))), (3, " ".join(short + word(40))), (4, " ".join(word(3) + short)), (5, " ".join(word(400))), (6, "x " * 90)]
    seen = []
    plain = substring_dedup.level
    monkeypatch.setattr(substring_dedup, "level", lambda rows, window, body: seen.append(window) or plain(rows, window, body))
    got = by_id(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert seen == [35, 70, 140, 280]
    assert {i: x["longest"] for i, x in got.items()} == {1: 280, 2: 280, 3: 70, 4: 70, 5: 0, 6: 70} == brute_longest(rows)


def test_substring_dedup_counts_across_held_groups(docs, monkeypatch):
    out = substring_dedup.dedup(docs.repartition(1))
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    found = by_id(out)
    assert {i: r["kept_sha256"] for i, r in found.items()} == {i: v[2] for i, v in brute_dedup(corpus()).items()}


def test_substring_dedup_keeps_rows(spark, docs, none):
    out = substring_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256", "longest"] and out.count() == docs.count()
    assert substring_dedup.dedup(docs, levels=False).columns == out.columns[:-1]
    assert substring_dedup.dedup(none).count() == 0
    same = spark.createDataFrame([(1, "w " * 40)] * 2 + [(None, "w2 " * 3)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup.dedup(same).collect()) == [0, 40, 40]
    # names that the operator uses within
    odd = spark.createDataFrame([(1, "w " * 40, 5, 6, "s")], "doc_id long, text string, uid_ long, SPANS_ long, segments_ string")
    row = substring_dedup.dedup(odd).first()
    assert (row["n_removed"], row["uid_"], row["SPANS_"], row["segments_"], row["longest"]) == (40, 5, 6, "s", 35)


def brute_join(rows, percent=75):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = defaultdict(int)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [75, 50, 90])
def test_jaccard_join(docs, percent):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(jaccard_join.join(docs, percent=percent)).items()}
    assert got == brute_join(corpus(), percent)


def test_jaccard_join_on_many_drifting_copies(spark):
    r = random.Random(2)
    base = [str(r.random()) for _ in range(80)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(r.randint(1, 5)):
            copy[r.randrange(80)] = str(r.random())
        rows.append((i, " ".join(copy)))
    got = {i: (x["n_shingles"], x["component_id"]) for i, x in by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    assert got == brute_join(rows)


def test_jaccard_join_counts_all_links(spark):
    r = random.Random(7)
    texts = [" ".join(f"w{k}" for k in range(60)) + f" end{i}" for i in range(3)]
    for group in range(4):
        base = [f"g{group}x{k}" for k in range(70)]
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(1, 3)):
                copy[r.randrange(70)] = str(r.random())
            texts.append(" ".join(copy))
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    linked = lambda a, b: a is not b and 100 * len(a & b) >= 75 * len(a | b)
    rows = spark.createDataFrame([*enumerate(texts), (900, texts[0]), (901, None)], "doc_id long, text string")
    got = by_id(jaccard_join.join(rows, links=True))
    wanted = {i: sum(linked(a, b) for b in shingles) for i, a in enumerate(shingles)}
    assert wanted[0] == 2 and {i: got[i]["n_links"] for i in got} == {**wanted, 900: 2, 901: 0}
    assert {i: x["component_id"] for i, x in by_id(jaccard_join.join(rows)).items()} == {i: x["component_id"] for i, x in got.items()}


def test_jaccard_join_with_a_shingle_in_every_set(spark):
    """20,000 texts that share a phrase and link with nothing else, a few near copies among them."""
    r = random.Random(21)
    phrase = "to be or not to be that is"
    rows = [(i, f"{phrase} " + " ".join(str(r.random()) for _ in range(r.randint(2, 12)))) for i in range(20_000)]
    for i in range(0, 60, 2):  # a long text and the same with one word more
        long = f"{phrase} " + " ".join(str(r.random()) for _ in range(60))
        rows[i], rows[i + 1] = (i, long), (i + 1, long + " more")
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i for i, x in got.items() if x["component_id"] != i} == set(range(1, 60, 2))
    assert all(got[i + 1]["component_id"] == i for i in range(0, 60, 2))


def test_jaccard_join_over_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE_POSTINGS", 2)
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(jaccard_join.join(docs)).items()}
    assert got == brute_join(corpus())


def test_candidates_skip_only_what_cannot_link():
    """Every pair of a leader and a set that shares a key and can reach the overlap is found."""
    r = np.random.default_rng(6)
    table = np.zeros(3000, jaccard_join._POSTING)
    table["sid"] = np.arange(3000)
    table["key"], table["lead"] = r.integers(0, 6, 3000), r.integers(0, 50, 3000)
    table["size"] = r.integers(1, 60, 3000)
    table["pos"] = r.integers(0, 1 + table["size"] // 4)
    a, b, _ = jaccard_join._candidates(table.copy(), 75)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    level = np.floor(np.log(table["size"]) / -np.log(0.75) + 1e-9).astype(int)
    wanted = set()
    for shift in (0, 1):
        lists = defaultdict(list)
        for k in range(3000):
            lists[table["key"][k], (level[k] + shift) >> 1].append(k)
        for members in lists.values():
            lead = max(members, key=lambda k: (table["lead"][k], -table["sid"][k]))
            for k in members:
                sizes = int(table["size"][lead]), int(table["size"][k])
                room = min(sizes[0] - table["pos"][lead], sizes[1] - table["pos"][k])
                if k != lead and 175 * room >= 75 * sum(sizes):
                    wanted.add((lead, k))
    assert found == wanted


def test_one_of_each(spark, docs, none):
    kept = {r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()}
    wanted = brute_join(corpus())
    assert kept == {i for i, (n, c) in wanted.items() if n == 0 or c == i}
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    assert jaccard_join.join(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0
    rows = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in jaccard_join.one_of_each(rows).collect()) == [0, 2, 4]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for a, b in edges if a != b for i in (a, b)}


def tokens_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_special_tokens_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    from tessera.llm import tokens

    library = Tokenizer.from_file(BPE)
    texts = ["plain", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| >", " <|ENDOFTEXT|>"]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.encode(BPE, texts, None)] == wanted and 50256 in wanted[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in packing.pack(docs, BPE).collect()} == {i: [*ids, 0] for i, ids in enumerate(wanted)}
    for r in token_output.read_pieces(spark, token_output.write(docs, BPE)).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array([*wanted[r["doc_id"]], 0], "<u4").tobytes())


def check_pieces(rows, size, sequence):
    whole, used = {i: tokens_of(t) for i, t, *_ in corpus()}, defaultdict(list)
    covered = defaultdict(list)
    for r in rows:
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and 0 < r["length"] <= size
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        covered[r["doc_id"]].append((r["start"], r["length"]))
        used[sequence(r)].append((r["offset"], r["length"]))
    assert covered.keys() == whole.keys()
    for parts, ids in ((sorted(covered[i]), whole[i]) for i in whole):
        assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) == len(ids)
    for parts in map(sorted, used.values()):
        assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= size
    return len(used), sum(map(len, whole.values()))


@pytest.mark.parametrize("size", [1024, 64])
def test_packing(docs, none, size):
    rows = packing.pack(docs, BPE, size).collect()
    n, total = check_pieces(rows, size, lambda r: r["sequence_id"])
    assert n <= 1.03 * total / size + 2
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(none, BPE).count() == 0


def test_packing_plan_fills_sequences():
    r = np.random.default_rng(4)
    lengths, demand = np.unique(np.clip(r.lognormal(5, 1, 40000).astype(int), 1, 1024), return_counts=True)
    slots = packing.plan(lengths, demand)
    sequences = int((slots[:, 4] + (slots[:, 2] - slots[:, 1]) // slots[:, 3]).max())
    assert sequences <= 1.002 * (lengths * demand).sum() / 1024 + 1
    taken = defaultdict(list)
    for length, a, b, *_ in slots:
        taken[length].append((a, b))
    for length, n in zip(lengths, demand, strict=True):
        parts = sorted(taken[length])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
    assert packing.plan(np.array([]), np.array([])).shape == (0, 6)


def test_plan_is_the_linear_programs(monkeypatch):
    """Greedy packing serves only what rounding leaves over, on small histograms too."""
    seen = []
    plain = packing.greedy
    monkeypatch.setattr(packing, "greedy", lambda lengths, rest, size: seen.append(int((lengths * rest).sum())) or plain(lengths, rest, size))
    r = np.random.default_rng(5)
    for n in (50, 3000):
        lengths, demand = np.unique(r.integers(1, 600, n), return_counts=True)
        packing.plan(lengths, demand)
    assert len(seen) == 2 and seen[1] < 0.5 * (lengths * demand).sum()


def test_linear_program_beats_greedy():
    lengths, demand = np.array([14, 31, 36, 45]), np.array([211, 395, 610, 97])
    value = sum(x for _, x in packing.solve(lengths, demand, 100))
    assert value <= 452.26 and all((column * lengths).sum() <= 100 for column, _ in packing.solve(lengths, demand, 100))


def test_token_output(spark, docs, none):
    path = token_output.write(docs, BPE)
    rows = token_output.read_pieces(spark, path).collect()
    check_pieces(rows, 1024, lambda r: (r["shard"], r["sequence"]))
    stored = spark.read.parquet(path).first()
    assert len(stored["ids"]) == 2048 and stored["cu_seqlens"][0] == 0
    assert token_output.read_pieces(spark, token_output.write(none, BPE)).count() == 0


def test_best_fit_matches_a_plain_search():
    r = random.Random(6)
    lengths = [r.randint(1, 64) for _ in range(500)]
    open_, out = [], []
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [k for k, room in enumerate(open_) if room >= lengths[i]]
        if fits:
            k = min(fits, key=lambda k: open_[k])
        else:
            k = len(open_)
            open_.append(64)
            out.append([])
        open_[k] -= lengths[i]
        out[k].append(i)
    got = token_output.best_fit(lengths, 64)
    fills = lambda bins: sorted(sum(lengths[i] for i in b) for b in bins)
    assert fills(got) == fills(out)
    assert all(sum(lengths[i] for i in g) <= 64 for g in got)


def test_sentencepiece(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(sentencepiece_codec.encode(docs, PIECES))
    short = by_id(sentencepiece_codec.digests(docs, PIECES))
    for i, t, *_ in corpus():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids)
        assert tuple(short[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert sentencepiece_codec.encode(none, PIECES).count() == 0


def test_sentencepiece_takes_long_chunks():
    """A megabyte without spaces in seconds, and the same ids as the library's."""
    r = random.Random(14)
    c = sentencepiece_codec.codec(PIECES)
    for text in (base64.b64encode(r.randbytes(750_000)).decode(), "ab" * 100_000, "\n".join("".join(r.choices("etaoin", k=9)) for _ in range(3000))):
        began = time.process_time()
        got = next(c.encode([text]))
        assert time.process_time() - began < 5
        ids = c.library.encode(text, add_bos=True, add_eos=True)
        assert got == (np.array(ids, "<u4").tobytes(), c.library.decode(ids))


def test_sentencepiece_remembers_frequent_chunks(monkeypatch):
    """Chunks of every text are merged once, however many others come between."""
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 2000)
    c = sentencepiece_codec.Codec(PIECES)
    r, merged = random.Random(15), Counter()
    encoded = c.encoded
    monkeypatch.setattr(c, "encoded", lambda part: merged.update([part]) or encoded(part))
    texts = ["often seen " + "".join(r.choices("etaoinshr", k=9)) + " ".join("".join(r.choices("etaoinshr", k=9)) for _ in range(8)) for _ in range(2000)]
    for text, got in zip(texts, c.encode(texts), strict=True):
        ids = c.library.encode(text, add_bos=True, add_eos=True)
        assert got == (np.array(ids, "<u4").tobytes(), c.library.decode(ids))
    assert merged["▁often"] == merged["▁seen"] == 1 and len(c.known) + len(c.aged) < 10_000 < len(merged)


@pytest.mark.parametrize("text", ["", " ", "   a  b ", "\n\n x\ty\r\n", "▁▁ ▁", "　ﬁ🦀é́", "\x00 \x01﻿", "</s><unk><0x41>", "a" * 3000, "1234567890 " * 50])
def test_sentencepiece_oddities(text):
    c = sentencepiece_codec.codec(PIECES)
    ids = c.library.encode(text, add_bos=True, add_eos=True)
    assert next(c.encode([text])) == (np.array(ids, "<u4").tobytes(), c.library.decode(ids))


def test_sentencepiece_works_once_for_a_word(monkeypatch):
    """A word before several signs is merged and held against the library once, with other new words in one text."""
    c = sentencepiece_codec.Codec(PIECES)
    r, asked = random.Random(16), []

    class Library:
        def encode(self, texts, **options):
            asked.extend([texts] if isinstance(texts, str) else texts)
            return library.encode(texts, **options)

    library = c.library
    monkeypatch.setattr(c, "library", Library())
    words = list({"".join(r.choices("etaoinshr", k=9)) for _ in range(400)})
    texts = [f"{' '.join(w + sign for w in words)}\n{' '.join(words)}" for sign in (".", ",", "!", "?", ";", ")", ":", '"')]
    for text, got in zip(texts, c.encode(texts), strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got == (np.array(ids, "<u4").tobytes(), library.decode(ids))
    assert len(asked) < 100 and 4000 < sum(map(len, asked)) < 6000
    # a wrong chunk is found and named, wherever it stands in its text
    encoded = c.encoded
    monkeypatch.setattr(c, "encoded", lambda part: encoded("▁other" if part == "▁wrongly" else part))
    with pytest.raises(ValueError, match="wrongly"):
        next(c.encode(["".join(f" {w}x" for w in words[:50]) + " wrongly" + "".join(f" {w}y" for w in words[:50])]))


def test_sentencepiece_cuts_and_decodes_in_steps(monkeypatch):
    c = sentencepiece_codec.Codec(PIECES)
    monkeypatch.setattr(sentencepiece_codec, "STEP", 7)
    texts = ["", "m². ² ½a 2.²x", "one,two;3.5e_7 (é)  ,b \t \n ", "", "日本語。あ1 ไท้า\u0301x", "🦀's\n\n²", " "]
    for text, got in zip(texts, c.encode(texts), strict=True):
        ids = c.library.encode(text, add_bos=True, add_eos=True)
        assert got == (np.array(ids, "<u4").tobytes(), c.library.decode(ids))
    cut = sentencepiece_codec._runs(["ab", " b", "n't", "'t", " ("]).findall
    assert cut(" ban't, (ab)  c3.\n") == [" ba", "n't,", " (", "ab", ")", "  c", "3.", "\n"]
    assert sentencepiece_codec._runs(["ab", "2a", "bc", "c."]).findall("xabc.d 2a") == ["x", "abc.", "d", " 2a"]


def spark_hash(values):
    """Spark's 64-bit hash of a text, a number, or a list of numbers."""
    import xxhash

    if isinstance(values, str):
        return xxhash.xxh64_intdigest(values.encode(), seed=42)
    h = 42
    for x in values if isinstance(values, list) else [values]:
        h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed=h)
    return h


SCRIPTS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNITS = re.compile(f"[{SCRIPTS}]|[^ \t\n\x0b\f\r{SCRIPTS}]{{1,8}}")


def paragraphs(units, level):
    """The digests of a level."""
    out, part = set(), []
    for k, u in enumerate(units):
        part.append(u)
        if u % (1 << level) == 0 or k == len(units) - 1:
            out.add(spark_hash(part) & (1 << 48) - 1)
            part = []
    return out


def begun(units, level):
    return sum(k == 0 or units[k - 1] % (1 << level) == 0 for k in range(len(units)))


def lowest_level(units):
    first = max(0, int(np.ceil(np.log2(len(units) / 32)))) if units else 0
    level = None
    for x in range(first, -1, -1):
        n = begun(units, x)
        if n > 128:
            break
        level = x
        if n >= 24:
            break
    return first if level is None else level


def plain_likeness(a, b):
    a, b = ([spark_hash(u) for u in UNITS.findall(t)] for t in (a, b))
    level = max(lowest_level(a), lowest_level(b))
    x, y = paragraphs(a, level), paragraphs(b, level)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def edited(t, after):
    half = len(t) // 2
    return t[: len(t) - half] + after[:half]


def read_fingerprint(text):
    """The levels, and of each stratum its cells (count, XOR)."""
    levels, _, body = text.partition(":")
    out = {}
    for part in body.split():
        t, _, cells = part.partition("=")
        out[int(t)] = {int(c): (int(n), int(k, 16)) for c, n, k in (x.split(".") for x in cells.split(","))}
    return *map(int, levels.split("-")), out


def test_fingerprints(spark, docs, none):
    rows = sorted((i, t or "") for i, t, *_ in corpus())
    got = by_id(fingerprints.edited_and_next(docs))
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        other = edited(t, after)
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(t, other)) and got[i]["near_next"] == pytest.approx(plain_likeness(t, after))
    marks = by_id(fingerprints.fingerprint(docs))
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t].add(marks[i]["fingerprint"])
        assert marks[i]["fingerprint"] == got[i]["fingerprint"]
        low, top, strata = read_fingerprint(got[i]["fingerprint"])
        units = [spark_hash(u) for u in UNITS.findall(t)]
        assert low == lowest_level(units) and (not units or begun(units, top) == 1)
        for level in range(low, top + 1) if units else ():
            held = [strata.get(4 * level + k, {}) for k in range(4)]
            wanted = paragraphs(units, level)
            for table in range(3):
                counts = [cells.get(8 * table + c, (0, 0)) for cells in held for c in range(8)]
                assert sum(n for n, _ in counts) == len(wanted)
                assert np.bitwise_xor.reduce([k & (1 << 48) - 1 for _, k in counts] or [0]) == np.bitwise_xor.reduce([*wanted])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_and_next(none).count() == 0
    one = fingerprints.edited_and_next(spark.createDataFrame([(5, "abc def. ghi"), (None, "x")], "doc_id long, text string")).collect()
    assert [r["near_next"] for r in one] == [1.0]


def test_fingerprints_of_any_script_and_length(spark):
    r = random.Random(12)
    written = lambda letters, n, sep: sep.join("".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(n))
    alphabets = ["qrstuvwxyz", "абвгдежз", "אבגדהוזח", "αβγδεζηθ"]
    texts = [written(a, n, " ") for a in alphabets for n in (12, 30, 120, 500, 4000)]
    texts += ["".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n)) for n in (30, 260, 3000)] + [written("abcdef", 4000, "")]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = by_id(fingerprints.edited_and_next(table))
    assert {i: x["near_edited"] for i, x in rows.items() if x["near_edited"] <= 0.3} == {}
    assert all(x["near_next"] < 0.1 for x in rows.values())
    # a text and its beginning, a few characters shorter, are as alike either way
    long = written("abcdefgh", 420, " ")[:2050]
    pair = by_id(fingerprints.edited_and_next(spark.createDataFrame([(1, long), (2, long[:2047])], "doc_id long, text string")))
    assert pair[1]["near_next"] == pair[2]["near_next"] > 0.8


def test_fingerprints_of_repeated_rows(spark):
    rows = [(3, "c c"), (1, "a a"), (1, "a a"), (1, "b b"), (2, None)]
    got = sorted((r["doc_id"], r["n_chars"]) for r in fingerprints.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3), (1, 3), (1, 3), (2, 0), (3, 3)]


def test_next_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 3)
    monkeypatch.setattr(fingerprints, "QUANTILES", 4)
    ids = [1, 2, 3, 10**12, *range(50, 90), -7]
    got = by_id(fingerprints.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")))
    order = sorted(ids)
    assert {i: r["next_text"] for i, r in got.items()} == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_peeling_recovers_the_difference(spark):
    r = random.Random(8)
    lines = [f"sentence number {r.random()} ends here" for _ in range(300)]
    rows = [(k, "\n".join(lines), "\n".join(lines[:150] + [f"new {r.random()}" for j in range(k)] + lines[150:])) for k in (0, 1, 5, 40)]
    rows += [(99, None, "x\n" * 300), (100, "\n".join(lines), " ".join(str(r.random()) for _ in range(3000))), (101, None, "")]
    got = by_id(fingerprints.compare(spark.createDataFrame(rows, "doc_id long, old_text string, new_text string"), 1))
    for i, old, new in rows:
        a, b = (paragraphs([spark_hash(u) for u in UNITS.findall(t or "")], 1) for t in (old, new))
        found = {(d["n"], d["k"] & (1 << 48) - 1) for d in got[i]["differing"]}
        assert found == {(1, k) for k in a - b} | {(-1, k) for k in b - a} and len(found) == len(got[i]["differing"])
        assert got[i]["likeness"] == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)


def test_small_sketches_are_tried_again_larger(spark):
    """Far more differing digests than a first sketch can give away."""
    r = random.Random(13)
    keys = [[r.getrandbits(48) for _ in range(n)] for n in (0, 3, 30, 200)]
    certified = [[k | (spark_hash(k) & 0xFFFF) << 48 for k in x] for x in keys]
    signed = lambda x: [k - (1 << 64) if k >> 63 else k for k in x]
    rows = [(i * 4 + j, signed(u), signed(v + u[:2])) for i, u in enumerate(certified) for j, v in enumerate(certified)]
    out = spark.createDataFrame(rows, "doc_id long, u array<long>, v array<long>").select("doc_id", F.expr(fingerprints.peeled("u", "array_distinct(v)")).alias("found"))
    for x in out.collect():
        u, v = (set(y) for y in rows[x["doc_id"]][1:])
        assert {(d["n"], d["k"]) for d in x["found"]} == {(1, k) for k in u - v} | {(-1, k) for k in v - u}


def test_only_compared_strata_are_sketched(spark):
    """Sketches of every stratum, of one digest or many, against plain ones; and of one level only, as the next text's are."""
    text = " ".join(f"w{k * k}" for k in range(600))
    rows = spark.createDataFrame([(text,)], "text string").withColumn("made", F.expr(fingerprints.cut("text")))
    made, every, some = rows.select("made", F.expr(fingerprints.sketches("made")), F.expr(fingerprints.sketches("made", "4"))).first()
    assert {len(keys) for keys in made["keyed"]} > {0, 1, 2} and len(made["keyed"]) == 4 * (made["top"] - made["level"] + 1)
    for keys, cells in zip(made["keyed"], every, strict=True):
        plain = [[0, 0] for _ in range(24)] if keys else []
        for k in keys:
            for table in range(3):
                cell = plain[8 * table + (k >> 16 * table & 7)]
                cell[:] = cell[0] + 1, cell[1] ^ k
        assert [tuple(c) for c in cells] == [tuple(c) for c in plain]
    assert some == [cells if 4 <= j < 8 else [] for j, cells in enumerate(every)]


def test_licenses(spark, docs, none):
    mit = dict(licenses.TEXTS[:1])["MIT"]
    rows = spark.createDataFrame(
        [(1, mit.replace("<year> <holder>", "2019 Somebody").upper().replace("\n\n", "\n")), (2, mit.replace("Software", "Softwares", 1)), (3, "Prose.\nLicenced under the  apache licence, version 2.0\nAll rights reserved!"), (4, None), (5, "")],
        "doc_id long, text string",
    )
    got = by_id(licenses.scan(rows))
    assert got[1]["license_id"] == "MIT" and got[2]["license_id"] is None
    assert got[3]["notices"] == "Apache-2.0,LicenseRef-all-rights-reserved" and got[3]["license_id"] is None
    assert got[4]["canonical_sha256"] == got[5]["canonical_sha256"] == hashlib.sha256(b"").hexdigest()
    two = by_id(licenses.scan(spark.createDataFrame([(3, "Licensed under the  apache licence; version 2.0")], "doc_id long, text string")))
    assert two[3]["license_id"] == "Apache-2.0" and two[3]["notices"] == "Apache-2.0"
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == docs.count()
    whole = {i: t for i, t in licenses.TEXTS}
    odd = [(1, whole["BSD-3-Clause"].replace("\n\n", "\r\n \r\n").upper()), (2, "Copyright (c) 2001 X\n" + whole["Unlicense"]), (3, "non\ninfringement"), (4, "noninfringement"), (None, "All rights reserved."), (4, "noninfringement")]
    rows = licenses.scan(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'x' as digest", "1 as lines")).collect()
    assert sorted((r["doc_id"], r["license_id"]) for r in rows if r["license_id"]) == [(1, "BSD-3-Clause"), (2, "Unlicense")]
    assert len(rows) == 5 and len({r["canonical_sha256"] for r in rows if r["doc_id"] > 2}) == 1
    mine = by_id(licenses.scan(rows_of(spark, [(1, "My Own licence!"), (2, "x\nmy own, LICENSE")]), [("own", "my own license")]))
    assert mine[1]["license_id"] == "own" and mine[2]["notices"] == "own"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_operators_on_rows_without_id_and_repeated_rows(spark):
    """Rows without id are left out, every other row counts for itself; names of other columns do not matter."""
    rows = rows_of(spark, [(None, "left out"), (1, "one two three"), (1, "one two three"), (2, None), (3, "")]).selectExpr("*", "'n' as ids", "7 as length", "0 as block", "1 as rank", "2 as batch", "3 as tie", "4 as bucket")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(packing.pack(rows, BPE)) == ids(token_output.read_pieces(spark, token_output.write(rows, BPE))) == [1, 1, 2, 3]
    for out in (sentencepiece_codec.encode(rows, PIECES), sentencepiece_codec.digests(rows, PIECES), licenses.scan(rows), fingerprints.fingerprint(rows), fingerprints.edited_and_next(rows)):
        assert ids(out) == [1, 1, 2, 3]


def test_fingerprints_evaluate_no_lambda_per_unit_and_table(spark):
    # interpreted lambdas are what op6 pays for: none for the units of a paragraph, no wide struct for each digest and table
    assert "get(h, i)" not in fingerprints.paragraphs("b") and "slice(h" in fingerprints.paragraphs("b")
    assert "s.k0" not in fingerprints.first_sketch("w") and "element_at" not in fingerprints.sketch("w", "8L")
    # units by the class without its shortcut for ASCII
    scripts = fingerprints._SCRIPTS
    plain = f"transform(regexp_extract_all(text, '[{scripts}]|[^\\\\s{scripts}]{{1,{fingerprints.UNIT}}}', 0), u -> xxhash64(u))"
    texts = ["plain words and extraordinary ones", "caf\u00e9 na\u00efve~!\u00a0x\u2003y\x00z\x1c\x7f", "\u6f22\u5b57ab\u3042\u0e01 \U00020001\U0001f600tail", "", " \t\n", "[]^\\\\-~!"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(r[0] == r[1] for r in rows.selectExpr(plain, fingerprints.units("text")).collect())
    # a sketch by either rule, with and without single digests
    keys = spark.createDataFrame([([k * 0x9E3779B97F4A7C1 % 2**63 for k in range(1, n + 1)],) for n in (1, 2, 9, 40)], "w array<bigint>")
    assert all(r[0] == r[1] and sum(c["n"] for c in r[0]) == 3 * r[2] for r in keys.selectExpr(fingerprints.first_sketch("w"), fingerprints.sketch("w", "8L"), "size(w)").collect())


def test_column_generation_ends_by_its_gap(caplog):
    # many lengths: prices take long to give a bound, while the pieces' length is one at once
    r = np.random.default_rng(5)
    lengths, demand = np.unique((1 + 1022 * r.random(6000) ** 2).astype(int), return_counts=True)
    value = sum(x for _, x in packing.solve(lengths, demand, 1024))
    assert not caplog.records and value <= (lengths * demand).sum() / 1024 / (1 - packing.GAP)
