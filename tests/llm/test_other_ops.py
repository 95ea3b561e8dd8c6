"""Toxicity, WARC, top-k search, the pipeline, and the registered queries."""

import base64
import gzip
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tessera.llm import queries, substring_dedup, topk, toxicity, warc  # noqa: E402

DATA = "/root/testdata/sf0.01"


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    toxic = [p for t, p in held if t]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(p for t, p in held if not t) <= 0.03 * len(held)


def test_toxicity_training_holds_texts_only():
    rng = np.random.default_rng(1)
    rows = [" ".join(f"w{k}" for k in rng.integers(4 * (d % 2), 3000, 600)) for d in range(1600)]
    tracemalloc.start()
    toxicity.fit(rows, np.arange(len(rows)) % 2 == 0, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # the weights and counts have a fixed size of 68 MB; the features of all tokens made it 276 MB


def test_toxicity_edges(spark):
    r = random.Random(1)
    plain = lambda: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(30))
    rows = [(i, plain() + (" vileword " + plain() if i % 3 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (902, "vileword " * 5000), (903, "“Vilewords”"), (None, "vileword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as score", "1 as toxic")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(3, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    field = toxicity.train(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.tag(docs, field).collect()}
    assert len(got) == 404 and got[900]["score"] == got[901]["score"] < 0.5
    assert all(got[i]["score"] >= 0.7 for i in range(0, 400, 3)) and got[902]["score"] >= 0.7
    wrong = {i for i in range(400) if i % 3 and got[i]["score"] >= 0.7}  # short random words: a few share beginnings
    assert len(wrong) <= 8
    text = dict(rows)[6].encode()
    assert b"vileword" in [text[a:b] for a, b in zip(got[6]["starts"], got[6]["stops"], strict=True)]
    kept = toxicity.without_toxic(docs, field)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} >= ({i for i in range(400) if i % 3} - wrong) | {900, 901}
    nothing = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.tag(docs, nothing).where("score <> 0").count() == 0
    assert toxicity.tag(docs.where("false"), field).count() == 0 and toxicity.without_toxic(docs.where("false"), field).count() == 0


def test_forward_backward_matches_enumeration():
    r = np.random.default_rng(2)
    emit, change = r.normal(size=7), r.normal(size=(2, 2))
    first = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    total, on, pairs = 0.0, np.zeros(7), np.zeros((2, 2))
    for code in range(2**7):
        y = np.array([code >> k & 1 for k in range(7)])
        steps = [(y[k - 1], y[k]) for k in range(1, 7) if not first[k]]
        w = math.exp(emit @ y + sum(change[s] for s in steps))
        total, on = total + w, on + w * y
        for s in steps:
            pairs[s] += w
    p, counts = toxicity.marginals(emit, first, change, True)
    assert np.allclose(p, on / total) and np.allclose(counts, pairs / total)


def _chain(w, grow):
    """Marginals of the toxic state along one chain."""
    f, b = [], [np.ones(2)]
    for x in w:
        here = np.array([1, x]) * (f[-1] @ grow if f else 1)
        f.append(here / here.sum())
    for x in w[:0:-1]:
        back = grow @ (np.array([1, x]) * b[-1])
        b.append(back / back.sum())
    p = np.array(f) * np.array(b[::-1])
    return p[:, 1] / p.sum(1)


def test_long_chains_are_exact():
    """Chains of several blocks against a plain loop over one chain at a time."""
    r = np.random.default_rng(5)
    size = [1, 700, 3, 256, 257, 512, 1500, 40]
    emit, change = r.normal(size=sum(size)) * 2, r.normal(size=(2, 2))
    first = np.zeros(len(emit), bool)
    first[np.cumsum([0, *size[:-1]])] = True
    p, counts = toxicity.marginals(emit, first, change, True)
    at, wanted, pairs = 0, [], np.zeros((2, 2))
    for n in size:
        w = np.stack([np.ones(n), np.exp(emit[at : at + n])], 1)
        f, b = np.empty((n, 2)), np.ones((n, 2))
        for t in range(n):
            f[t] = w[t] * (f[t - 1] @ np.exp(change) if t else 1)
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(change) @ (w[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
            x = f[t][:, None] * np.exp(change) * (w[t + 1] * b[t + 1])
            pairs += x / x.sum()
        wanted.append((f * b)[:, 1] / (f * b).sum(1))
        at += n
    assert np.allclose(p, np.concatenate(wanted)) and np.allclose(counts, pairs)


def test_scores_and_spans_against_a_plain_version(spark):
    """Every score of the query from the trained field, a text at a time: words by a regular expression, marginals by loops."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 9 = 0")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    field = toxicity.train(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
    grow = np.exp(field.change)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in toxicity.tag(docs, field).collect():
        raw = texts[row["doc_id"]].encode()
        found, owner = [], []
        blank = re.sub(rb"\xe2[\x80\x81].", b"   ", raw, flags=re.S)  # dashes and quotation marks are no letters
        for k, line in enumerate(re.finditer(rb"[^\n]+", blank)):
            for m in re.finditer(rb"[A-Za-z\x80-\xff]+", line.group()):
                found.append((line.start() + m.start(), line.start() + m.end()))
                owner.append(k)
        if not found:
            best, hot = 0.0, []
        else:
            first = np.array([k == 0 or owner[k] != owner[k - 1] for k in range(len(found))])
            starts, stops = (np.array(x) for x in zip(*found, strict=True))
            x = toxicity.features(np.frombuffer(raw, np.uint8), starts, stops, first)
            w = np.exp(np.clip(field.weights[x].sum(0) + field.weights[-1], -30, 30))
            p = np.concatenate([_chain(w[k], grow) for k in np.split(np.arange(len(w)), np.flatnonzero(first)[1:])])
            best, hot = p.max(), [k for k in range(len(p)) if p[k] >= 0.5]
        top = np.log(np.clip(best, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(best, 1e-6, 1 - 1e-6))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-np.clip(field.slope * top + field.shift, -30, 30))), abs=1e-4)
        spans = []
        for k in hot:
            if spans and spans[-1][2] == k - 1:
                spans[-1][1:] = [found[k][1], k]
            else:
                spans.append([*found[k], k])
        assert list(zip(row["starts"], row["stops"], strict=True)) == [(a, b) for a, b, _ in spans] and row["n_spans"] == len(spans)


def brute_warc(rows):
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((html or "").encode(), i)
    out = {}
    for i, _, html in rows:
        if i is not None:
            body = (html or "").encode()
            out[i] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first[body] == i else "revisit", None if first[body] == i else first[body])
    return out


def test_warc(spark):
    odd = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/ü", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "u\r\nX: y", odd), (9, "http://z", odd), (5, "http://c", "x" * 300_000), (7, "q", "<p>é</p>"), (None, "n", "gone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as refers_to")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == brute_warc(rows)
    path = warc.write_archive(pages, file_bytes=300)
    records = warc.read_records(spark, path)
    assert records.where("target = 'uX: y'").count() == 3
    whole = {r["response"]["payload_digest"]: bytes(r["response"]["payload"]) for r in warc.captures(records).collect() if r["response"]["payload"] is not None}
    assert whole == {d: (h or "").encode() for (i, _, h), (_, d, kind, _) in ((r, brute_warc(rows)[r[0]]) for r in rows if r[0] is not None) if kind == "response"}
    assert all(r["request"] and r["metadata"] for r in warc.captures(records).collect())
    assert warc.round_trip(pages.where("false")).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.captures(warc.read_records(spark, warc.write_archive(pages, least_bytes=100))).selectExpr("cast(metadata.fields['page_id'] as long) as page_id", "response.record_type").collect()}
    assert set(small.values()) == {"response"}


def test_warc_files_are_valid(spark):
    rows = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    path = warc.write_archive(rows, file_bytes=4000)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 1
    ids, refers = set(), set()
    for f in files:
        assert len(f["content"]) < 6000
        found = list(warc.parse(iter([gzip.decompress(bytes(f["content"]))])))  # as one stream, by the standard library
        assert found == list(warc.parse(warc.unzipped(memoryview(bytes(f["content"])), 7)))
        assert bytes(f["content"]).count(b"\x1f\x8b\x08") >= len(found)  # a member a record
        ids |= {h["WARC-Record-ID"] for h, _ in found if h["WARC-Type"] == "response"}
        refers |= {h["WARC-Refers-To"] for h, _ in found if h["WARC-Type"] == "revisit"}
    assert len(ids) == 7 and refers == ids
    plain = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in (b"", b"a\r\n\r\nb", b"c" * 100_000))
    assert [b for _, b in warc.parse(warc.unzipped(memoryview(plain)))] == [b"", b"a\r\n\r\nb", b"c" * 100_000]


def test_warc_keeps_repeated_rows(spark):
    """A row each: equal rows, ids with several payloads, and a payload that a smaller id has too."""
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (1, "u", "other"), (2, "u", "same"), (0, "u", "other"), (3, "u", ""), (3, "u", None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    wanted = [(1, "same", "response", None)] + [(1, "same", "revisit", 1)] * 2 + [(1, "other", "revisit", 0), (2, "same", "revisit", 1), (0, "other", "response", None), (3, "", "response", None), (3, "", "revisit", 3)]
    assert sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in got) == sorted((p, digest(t), k, r or 0) for p, t, k, r in wanted)
    assert len({r["request_id"] for r in got}) == len(rows)


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, 0.25, r.uniform(-1, 1)]) for _ in range(20)]) for i in range(300)]
    rows += [(301, rows[7][1]), (302, rows[7][1]), (350, None), (400, [None] * 20), (450, [float("nan")] * 20), (451, [float("inf")] * 20), (500, [1.0, 2.0]), (503, [3.0, 4.0]), (None, rows[3][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as dim", "'g' as g")
    kept = {i: [math.floor(256 * float(np.float32(v))) for v in x] for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)}
    wanted = set()
    for q in (i for i in kept if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(kept[q], kept[i], strict=True)), i) for i in kept if i != q and len(kept[i]) == len(kept[q]))
        wanted |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    assert {tuple(x) for x in topk.top_five(vectors).collect()} == wanted
    whole = topk.quantised(vectors)
    small = topk.search(whole, whole.where("vec_id % 50 = 0"), 5, candidates=40, wave_bytes=400)
    assert {tuple(x) for x in small.collect()} == wanted
    assert topk.top_five(vectors.where("false")).count() == 0


def brute_top(rows, k=5):
    """Whole numbers of any size; a query for each distinct vector of an id."""
    kept = [(i, [math.floor(256 * Fraction(v)) for v in x]) for i, x in rows]
    out = []
    for q, a in {(i, tuple(x)) for i, x in kept if i % 50 == 0}:
        scored = sorted((-sum(m * n for m, n in zip(a, x, strict=True)), i) for i, x in kept if i != q and len(x) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("candidates", "queries", "dim"), [(1.0, 1.0, 64), (1e7, 1e3, 64), (1e9, 1e3, 64), (3e11, 1.0, 5), (1e15, 1e-3, 3), (1e12, 1.0, 1)])
def test_top_k_is_exact_on_large_numbers(spark, candidates, queries, dim):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) * (queries if i % 50 == 0 else candidates) for _ in range(dim)]) for i in range(1, 301)]
    # queries meet each other too: scores of large with large would not fit a long, so queries stay small
    rows += [(7, rows[20][1]), (7, rows[20][1]), (50, rows[3][1][:1] * dim if candidates == 1.0 else rows[99][1]), (600, rows[149][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.top_five(vectors).collect()) == brute_top(rows)


def test_top_k_over_waves_batches_and_repeats(spark):
    r = random.Random(10)
    rows = [(r.randrange(300), [float(r.randint(-2, 2)) for _ in range(r.choice([4, 6]))]) for _ in range(700)]
    whole = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(whole, whole.where("vec_id % 50 = 0"), 5, candidates=30, wave_bytes=500)
    assert sorted(tuple(x) for x in got.collect()) == brute_top(rows)


def test_top_k_fails_on_scores_beyond_a_long(spark):
    for rows in ([(0, [1e15]), (1, [1e15])], [(0, [1.0]), (1, [1e200])]):
        with pytest.raises(Exception, match="does not fit|too large"):
            topk.top_five(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    from .test_text_ops import brute_dedup, brute_join

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 6000").limit(400).cache()
    now = docs
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        now = stage(spark, now, DATA).cache()
        if name == "packing":
            assert {r["doc_id"] for r in now.select("doc_id").distinct().collect()} == set(before)
            continue
        after = {r["doc_id"]: r for r in now.collect()}
        assert now.columns == docs.columns and after.keys() <= before.keys()
        rows = [(i, r["text"]) for i, r in before.items()]
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert all(after[i] == before[i] for i in after) and 0 < len(before) - len(after) < 0.3 * len(before)
            assert sum(labels.get(i) == 0 for i in before.keys() - after.keys()) <= 0.02 * len(before)
        elif name == "ngram_jaccard_join":
            assert after.keys() == {i for i, (n, c) in brute_join(rows).items() if n == 0 or c == i}
        else:
            cut = brute_dedup(rows)
            assert all(hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == cut[i][2] for i, r in after.items())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_pipeline_run_against_brute_force(spark, tmp_path):
    """All stages in one go over a small folder: what is left of each document by plain means, and its pieces."""
    import corpus_pipeline as pipeline

    from .test_text_ops import brute_dedup, brute_join, tokens_of

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 4000 and doc_id % 3 < 2")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, rows[5][1]), (10**6 + 3, rows[5][1] + " more"), (10**6 + 4, "a <|endoftext|> b")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.tag(table, toxicity.train(table, labels)).collect()}
    left = [(i, t) for i, t in rows if scores[i] < 0.7]
    joined = brute_join(left)
    left = [(i, t) for i, t in left if joined[i][0] == 0 or joined[i][1] == i]
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(left, "doc_id long, text string"), levels=False).collect()}
    told = brute_dedup(left)
    assert all(hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() == told[i][2] for i, t in cut.items()) and len(cut) == len(left) < len(rows)
    pieces, used = {}, {}
    for r in pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == {i: tokens_of(t) for i, t in cut.items()}
    for parts in map(sorted, used.values()):
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 1024


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    assert queries.oracle_sql().keys() <= queries.queries().keys()
