"""Licence scans by canonical digests.

A text is brought to a canonical form (ASCII lower case, copyright lines dropped, punctuation and white space as single
spaces, equivalent spellings unified), digested, and the digest hash-joined to those of the known licence texts, a fixed
table. Each line is brought to that form once; the whole text's form is made from its lines', and the digests of the lines
are looked up too, in the same row, so that one pass without a shuffle does all.

Long licences are known by the digest of their canonical form alone, others by their wording.

Defined results: a null or empty text has the digest of the empty string and no licence; rows without doc_id are left
out; rows that repeat a doc_id are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .license_texts import DIGESTS, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Curly quotes, primes, dashes and the no-break space as ASCII.
MARKS, PLAIN = "‘’‚‛“”„‟′″‐‑‒–—― ", "''''\"\"\"\"'\"------ "
COPYRIGHT = r"^[ \t]*((copyright[ \t]*)?(\(c\)|©)|copyright[ \t]+[0-9<\[{])"
GAP = r"[\x00-\x20!-/:-@\[-`{-~]+"
#: Equivalent spellings (fixed values), as they stand after the gaps are single spaces.
SPELLINGS = [("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("https www", "http www"), ("per cent", "percent")]


def _spelt(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def plain_lines(text: Column) -> Column:
    """The lines in their form but for the spellings, which may reach over lines; empty ones dropped."""

    def line(x: Column) -> Column:
        return F.when(x.rlike(COPYRIGHT), "").otherwise(F.trim(F.regexp_replace(x, GAP, " ")))

    return F.filter(F.transform(F.split(F.translate(text, UPPER + MARKS, LOWER + PLAIN), "\n"), line), lambda x: x != "")


def canonical(lines: Column) -> Column:
    """A text's canonical form from its plain_lines()."""
    return _spelt(F.array_join(lines, " "))


def canonical_sql(text: str) -> str:
    """The same in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(translate({text}, {quote(UPPER + MARKS)}, {quote(LOWER + PLAIN)}), {quote("(^|\\n)" + COPYRIGHT[1:] + "[^\\n]*")}, chr(10), 'g')"
    out = f"trim(regexp_replace({out}, {quote(GAP)}, ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return out


def _digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known(df: DataFrame, listed: list[tuple[str, str]] | None = None) -> DataFrame:
    """Digest and identifier of each known text; a fixed table, or the caller's."""
    rows = df.sparkSession.createDataFrame(TEXTS if listed is None else listed, "license_id string, text string")
    rows = rows.select(_digest(canonical(plain_lines(F.col("text")))).alias("digest"), "license_id")
    if listed is None:
        rows = rows.unionByName(df.sparkSession.createDataFrame(DIGESTS, "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: Known texts at most: the table is broadcast, and its digests stand in the plan.
MOST = 10_000


def scan(docs: DataFrame, listed: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (the whole document is a known text, else null) and notices (identifiers of its
    lines that are known texts, each once, sorted, joined by commas). `listed` has MOST texts at most."""
    if listed is not None and len(listed) > MOST:
        raise ValueError(f"more than {MOST} known texts")
    table = known(docs, listed)
    names = {r["digest"]: r["license_id"] for r in table.collect()}  # MOST at most
    rows = texts(docs).select("doc_id", plain_lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", _digest(canonical(F.col("lines"))).alias("canonical_sha256"), F.transform("lines", lambda x: _digest(_spelt(x))).alias("digests"))
    found = F.array_intersect("digests", F.array(*map(F.lit, sorted(names))).cast("array<string>"))
    name = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]) if names else F.create_map(F.lit(""), F.lit(""))
    notices = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: F.try_element_at(name, d)))), ",")
    rows = rows.withColumn("notices", notices).drop("digests")
    return rows.join(F.broadcast(table), F.col("canonical_sha256") == F.col("digest"), "left").select("doc_id", "canonical_sha256", "license_id", "notices")


def scan_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in TEXTS)
    digest = lambda t: f"sha256({canonical_sql(t)})"
    digests = ", ".join(f"('{i}', '{d}')" for i, d in DIGESTS)
    return f"""
with known as (select digest, min(i) as license_id from (select i, {digest("t")} as digest from (values {values}) as k(i, t)
  union all select * from (values {digests}) as k(i, digest)) group by 1),
docs as (select doc_id, coalesce(text, '') as text from documents where doc_id is not null),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
found as (select l.doc_id, string_agg(distinct k.license_id, ',' order by k.license_id) as notices
  from (select doc_id, {digest("line")} as digest from lines where {canonical_sql("line")} <> '') l join known k using (digest) group by 1)
select d.doc_id, d.canonical_sha256, k.license_id, coalesce(f.notices, '') as notices
from (select doc_id, {digest("text")} as canonical_sha256 from docs) d
left join known k on k.digest = d.canonical_sha256 left join found f on f.doc_id = d.doc_id"""
