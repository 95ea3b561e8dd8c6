"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard_join, licenses, packing, sentencepiece_codec, substring_dedup, token_output, topk, toxicity, warc
from .common import table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "longest")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), ids=False)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return token_output.read_pieces(spark, path)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_five(table(spark, sf_dir, "embeddings"))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((n[{k // 4 + 1}] >> {15 - 5 * (k % 4)}) & 31), 1)" for k in range(32))
_NUMBERS = ", ".join("(" + " + ".join(f"(instr('0123456789abcdef', substr(h, {5 * j + i + 1}, 1)) - 1) * {16 ** (4 - i)}" for i in range(5)) + ")" for j in range(8))

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: Windows of twice the length whose halves repeat, and which repeat themselves; 71,680 words are more than any text of the
#: checked table has.
_LEVELS = "\n".join(
    f"r{k} as (select doc_id, i, h from (select *, count(*) over (partition by h) as c from (select a.doc_id, a.i, hash(a.h, b.h) as h "
    f"from r{k - 1} a join r{k - 1} b on a.doc_id = b.doc_id and b.i = a.i + {35 << k - 1})) where c > 1),"
    for k in range(1, 12)
)

SQL = {
    "op1_substring_dedup": f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents where doc_id is not null),
s as (select doc_id, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
g as (select s.doc_id, s.i, hash(array_to_string(d.w[s.i:s.i + 34], ' ')) as h from s join d using (doc_id)),
r0 as (select doc_id, i, h from (select *, count(*) over (partition by h) as c from g) where c > 1),
{_LEVELS}
l as (select doc_id, max(size) as longest from ({" union all ".join(f"select distinct doc_id, {35 << k} as size from r{k}" for k in range(12))}) group by 1),
x as (select distinct doc_id, unnest(range(i, i + 35)) as p from r0),
g2 as (select doc_id, list(p) as gone from x group by 1),
k as (select d.doc_id, d.w, coalesce(g2.gone, []) as gone, coalesce(l.longest, 0)::bigint as longest from d left join g2 using (doc_id) left join l using (doc_id)),
m as (select doc_id, w, gone, longest, list_filter(range(1, len(w) + 1), lambda p: not list_contains(gone, p)) as stay from k)
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed,
  sha256(array_to_string(list_transform(stay, lambda p: w[p]), ' ')) as kept_sha256, longest from m""",
    "op2_jaccard_join": f"""
with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents where doc_id is not null),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
e as (select a, b from l union select b, a from l),
r as (select a as doc_id, a as other from (select distinct a from e) union select r.doc_id, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from d left join n using (doc_id) left join (select doc_id, min(other) as component_id from r group by 1) c using (doc_id)""",
    "op7_license_scan": licenses.scan_sql(),
    "op9_warc": f"""
with p as (select page_id, coalesce(html, '') as html from pages where page_id is not null),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as h from p),
b as (select page_id, payload_bytes, h, [{_NUMBERS}] as n, min(page_id) over (partition by h) as first_id from d)
select page_id, payload_bytes, {_BASE32} as payload_digest,
  case when first_id < page_id then 'revisit' else 'response' end as record_type,
  case when first_id < page_id then first_id end as refers_to
from b""",
    "op10_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
