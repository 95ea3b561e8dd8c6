"""Document fingerprints as invertible Bloom lookup sketches, by SQL functions only.

A text is cut into units (runs of at most UNIT code points without white space; single characters in scripts that are
written without spaces), and units into paragraphs, at every level: a paragraph of level L ends after each unit whose hash
ends in L zero bits, so one of level 0 is a unit, and one of level L has about 2^L. This is the only rule, whatever the
length or the script; an edit moves only the cuts beside it, and paragraphs of a level are groups of those below.

A fingerprint holds the paragraph digests of all levels from the lowest that has about PARAGRAPHS of them up to that where
the whole text is one. A digest has 48 bits, and 16 that certify them. The digests of a level are held in strata; each is a
sketch of three tables of cells, and each digest is counted and XORed into one cell of each table. Sketches of two versions
subtract cell by cell, which leaves only the digests that differ; cells that hold a single digest give it away and are
peeled until nothing is left. A stratum that does not peel empty is tried again with sketches of twice the cells, and so on
(from 128 cells by eights) until it does; digests that it has given away, and one side alone holds, are left out there. The
likeness of two fingerprints is the share of the digests of both, at the lowest level that both hold, that the other has
too.

compare() recovers all paragraph digests of one level in which two versions differ: their number is estimated from the
fingerprints, and gives the number of strata.

The next document is found without sorting all in one task: ids are cut into ordered buckets by quantiles, a window runs
in each, and the last row of a bucket takes the first of the next one, which is found in the same way among the buckets.
One shuffle carries the texts.

Defined results: a null text is empty; an empty text has no paragraphs and is like another empty one (1.0) and unlike any
other (0.0); a single document is its own next; rows that repeat an id follow each other, ordered by a hash of their
text; rows without id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts

#: Code points of a unit at most.
UNIT = 8
#: Paragraphs of a fingerprint's lowest level, by its number of units; where there are fewer than LEAST, a lower level is
#: taken, unless that has more than four times PARAGRAPHS.
PARAGRAPHS, LEAST = 32, 24
#: Strata of a level; cells of each of the three tables of a first sketch.
STRATA, CELLS = 4, 8
#: Differing digests that a stratum of compare() should hold.
LOAD = 8
#: Tables of up to 2^16 cells: then every digest has three cells of its own.
LARGEST = 1 << 16
#: Rounds of peeling before a larger sketch is tried.
ROUNDS = 6
#: Rows of a bucket, and quantiles of ids, and of the ids between two quantiles, at most.
BUCKET, QUANTILES = 2000, 512
_LOW = (1 << 48) - 1
#: Thai, Lao, Myanmar, Khmer, kana, and CJK ideographs.
_SCRIPTS = r"\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{3ffff}"


def let(name: str, value: str, body: str) -> str:
    """body with a name for a value, which is then computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def units(text: str) -> str:
    """The hashes of a text's units."""
    # printable ASCII, which the second class holds too, is tried first: most characters then take one comparison
    return f"transform(regexp_extract_all({text}, '[!-~[^\\\\s{_SCRIPTS}]]{{1,{UNIT}}}|[{_SCRIPTS}]', 0), u -> xxhash64(u))"


def starts(places: str, level: str) -> str:
    """Those places where paragraphs of a level start, in the units h."""
    return let("mask", f"shiftleft(1L, {level}) - 1L", f"filter({places}, i -> i = 0 OR (get(h, i - 1) & mask) = 0L)")


def all_starts(level: str) -> str:
    """All places where paragraphs of a level start, in the units h."""
    return let("mask", f"shiftleft(1L, {level}) - 1L", "concat(array(0), array_remove(transform(slice(h, 1, size(h) - 1), (x, i) -> IF((x & mask) = 0L, i + 1, 0)), 0))")


def paragraphs(begin: str) -> str:
    """The distinct digests of the paragraphs of h that begin at places."""
    return f"array_distinct(transform({begin}, (s, j) -> xxhash64(slice(h, s + 1, coalesce(get({begin}, j + 1), size(h)) - s)) & {_LOW}L))"


def certified(key: str, z: str) -> str:
    """A digest with the lowest bits of its hash z above it."""
    return f"{key} | shiftleft({z} & 65535L, 48)"


def cut(text: str) -> str:
    """A text's fingerprint before it is sketched: its lowest and its top level, and the certified digests of each stratum of
    each level from one to the other."""
    level = f"greatest(0, CAST(ceil(log2(size(h) / {float(PARAGRAPHS)})) AS INT))"
    # places of a somewhat lower level are among those of all above it; levels below that are seldom needed
    finer = let("f", starts("IF(l >= low, places, sequence(0, size(h) - 1))", "l"), f"IF(size(f) > {4 * PARAGRAPHS}, s, named_struct('l', l, 'b', f))")
    base = f"aggregate(sequence(first, 0, -1), named_struct('l', first, 'b', CAST(array() AS array<int>)), (s, l) -> IF(size(s.b) >= {LEAST}, s, {finer}))"
    base = let("g", base, f"IF(size(g.b) > 0, g, named_struct('l', first, 'b', {starts('places', 'first')}))")
    base = let("first", level, let("low", "greatest(0, first - 2)", let("places", all_starts("low"), base)))
    # the top level is above the most zero bits that a unit between two paragraphs ends in
    zeros = let("y", "get(h, i - 1)", "IF(y = 0L, 63, bit_count((y & -y) - 1L))")
    top = f"aggregate(s.b, s.l, (x, i) -> IF(i = 0, x, greatest(x, least(62, {zeros}) + 1)))"
    each = let("z", "xxhash64(x)", f"named_struct('t', pmod(shiftrightunsigned(z, 48), {STRATA}), 'k', {certified('x', 'z')})")
    strata = let("w", f"transform({paragraphs('b')}, x -> {each})", f"transform(sequence(0, {STRATA - 1}), t -> transform(filter(w, e -> e.t = t), e -> e.k))")
    # a level's places are among those of the level below
    step = let("b", starts("a.b", "l"), f"named_struct('b', b, 'keyed', concat(a.keyed, {strata}))")
    keyed = f"aggregate(sequence(s.l, top), named_struct('b', s.b, 'keyed', CAST(array() AS array<array<bigint>>)), (a, l) -> {step}, a -> a.keyed)"
    made = let("s", base, let("top", top, f"named_struct('level', s.l, 'top', top, 'keyed', {keyed})"))
    none = "named_struct('level', 0, 'top', 0, 'keyed', CAST(array() AS array<array<bigint>>))"
    return let("h", units(text), f"IF(size(h) = 0, {none}, {made})")


def place(key: str, table: int, cells: str) -> str:
    return f"CAST({table} * {cells} + (shiftrightunsigned({key}, {16 * table}) & ({cells} - 1L)) AS INT)"


def empty(cells: str) -> str:
    return f"array_repeat(named_struct('n', 0, 'k', 0L), CAST(3 * {cells} AS INT))"


def counted(lists: str) -> str:
    """Cells from the lists of the digests that fall in each."""
    return f"transform({lists}, hits -> IF(size(hits) = 0, named_struct('n', 0, 'k', 0L), named_struct('n', size(hits), 'k', aggregate(hits, 0L, (x, d) -> x ^ d))))"


def sketch(keys: str, cells: str) -> str:
    """Three tables of cells: how many digests fall in each, and their XOR."""
    spot = f"named_struct('mask', shiftleft({cells} - 1L, 16 * table), 'want', shiftleft(c, 16 * table))"
    spots = f"flatten(transform(sequence(0, 2), table -> transform(sequence(0L, {cells} - 1L), c -> {spot})))"
    return counted(f"transform({spots}, spot -> filter({keys}, d -> (d & spot.mask) = spot.want))")


def first_sketch(keys: str) -> str:
    """The same for CELLS cells; a single digest is put in its places."""
    void = "named_struct('n', 0, 'k', 0L)"
    hits = lambda t: f"transform(array({', '.join(f'{c << 16 * t}L' for c in range(CELLS))}), want -> filter({keys}, d -> (d & {CELLS - 1 << 16 * t}L) = want))"
    many = counted(f"flatten(array({', '.join(map(hits, range(3)))}))")
    one = f"flatten(transform(sequence(0, 2), table -> {let('x', f'shiftrightunsigned(get({keys}, 0), 16 * table) & {CELLS - 1}L', f"array({', '.join(f'IF(x = {c}L, own, {void})' for c in range(CELLS))})")}))"
    return f"IF(size({keys}) = 1, {let('own', f"named_struct('n', 1, 'k', get({keys}, 0))", one)}, {many})"


def sketches(made: str, at: str | None = None) -> str:
    """The first sketch of each stratum, empty where it holds no digest; only of the level whose strata begin at a place, if
    given."""
    wanted = "size(w) > 0" + ("" if at is None else f" AND j >= {at} AND j < {at} + {STRATA}")
    return f"transform({made}.keyed, (w, j) -> IF({wanted}, {first_sketch('w')}, CAST(array() AS array<struct<n: int, k: bigint>>)))"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k))"


def peel(cells_of: str, cells: str) -> str:
    """The digests of a subtracted sketch, with 1 or -1 for the version that has them, and whether it has peeled empty
    in ROUNDS rounds (each takes all digests that cells give away); else a larger sketch does."""
    own = " OR ".join(f"i = {place('c.k', table, cells)}" for table in range(3))
    sure = f"abs(c.n) = 1 AND (shiftrightunsigned(c.k, 48) = (xxhash64(c.k & {_LOW}L) & 65535L)) AND ({own})"
    places = ", ".join(place("c.k", table, cells) for table in range(3))
    single = f"transform(array_distinct(filter(s.cells, (c, i) -> {sure})), c -> named_struct('n', c.n, 'k', c.k, 'at', array({places})))"
    less = "transform(cs, (c, i) -> IF(array_contains(p.at, i), named_struct('n', c.n - p.n, 'k', c.k ^ p.k), c))"
    # a round is two steps, one that finds digests and one that takes them out: a let in between would copy the cells
    find = f"named_struct('cells', s.cells, 'found', s.found, 'one', {single}, 'live', true)"
    take = f"named_struct('cells', aggregate(s.one, s.cells, (cs, p) -> {less}), 'found', concat(s.found, s.one), 'one', s.one, 'live', size(s.one) > 0)"
    none = "CAST(array() AS array<struct<n: int, k: bigint, at: array<int>>>)"
    begin = f"named_struct('cells', {cells_of}, 'found', {none}, 'one', {none}, 'live', true)"
    done = "named_struct('found', transform(s.found, p -> named_struct('n', p.n, 'k', p.k)), 'all', forall(s.cells, c -> c.n = 0 AND c.k = 0L))"
    return f"aggregate(sequence(1, {2 * ROUNDS}), {begin}, (s, r) -> IF(NOT s.live, s, IF(r % 2 = 1, {find}, {take})), s -> {done})"


def peeled(u: str, v: str, published: str | None = None) -> str:
    """The digests that differ between two arrays: what peels off their subtracted sketches (the published ones first, if
    given), of CELLS cells a table, then of more and more. What a sketch gives away before it is stuck, and one of the arrays
    alone holds, goes into no larger one. One expression serves all sizes: each task has to build it."""
    first = subtract(sketch("got.u", "m"), sketch("got.v", "m"))
    if published is not None:
        first = f"IF(m = {CELLS}, {published}, {first})"
    sizes, m = [], CELLS
    while m <= LARGEST:
        sizes.append(f"{m}L")
        m *= 2 if m < 128 else 8
    only = lambda n, one, other: f"array_except(array_intersect(transform(filter(r.found, e -> e.n = {n}), e -> e.k), got.{one}), got.{other})"
    found = "concat(got.found, transform(a, k -> named_struct('n', 1, 'k', k)), transform(b, k -> named_struct('n', -1, 'k', k)))"
    rest = let("a", only(1, "u", "v"), let("b", only(-1, "v", "u"), f"named_struct('u', array_except(got.u, a), 'v', array_except(got.v, b), 'found', {found}, 'all', false)"))
    step = let("r", peel(first, "m"), f"IF(r.all, named_struct('u', got.u, 'v', got.v, 'found', concat(got.found, r.found), 'all', true), {rest})")
    kind = "array<struct<n: int, k: bigint>>"
    begin = f"named_struct('u', {u}, 'v', {v}, 'found', CAST(array() AS {kind}), 'all', false)"
    return f"aggregate(array({', '.join(sizes)}), {begin}, (got, m) -> IF(got.all, got, {step}), got -> IF(got.all, got.found, CAST(raise_error('a sketch does not peel') AS {kind})))"


def common(a: str, b: str) -> str:
    """The place of part 0 among the strata of fingerprint a at the lowest level that it and b both hold (its top one stands
    for those above)."""
    return f"{STRATA} * (least(greatest({a}.level, {b}.level), {a}.top) - {a}.level)"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """The digests that only one of two fingerprints holds at the lowest level of both: their published sketches peeled, then
    larger ones where these fail."""
    cells = lambda side, at: f"IF(size(get({side}, {at} + part)) > 0, get({side}, {at} + part), {empty(f'{CELLS}L')})"
    held = lambda side, at: f"coalesce(get({side}.keyed, {at} + part), CAST(array() AS array<bigint>))"
    found = let("u", held(a, "ia"), let("v", held(b, "ib"), peeled("u", "v", subtract("p", "q"))))
    found = let("p", cells(cells_a, "ia"), let("q", cells(cells_b, "ib"), f"IF(p = q, CAST(array() AS array<struct<n: int, k: bigint>>), {found})"))
    return let("ia", common(a, b), let("ib", common(b, a), f"flatten(transform(sequence(0, {STRATA - 1}), part -> {found}))"))


def likeness(a: str, b: str, gone: str) -> str:
    """The share of the digests that two fingerprints hold at the lowest level of both which the other holds too."""
    held = lambda x, y: f"aggregate(slice({x}.keyed, 1 + {common(x, y)}, {STRATA}), 0, (n, w) -> n + size(w))"
    return let("o", f"{held(a, b)} + {held(b, a)}", f"IF(o = 0, 1.0D, CAST(o - size({gone}) AS DOUBLE) / o)")


def written(made: str, cells: str) -> str:
    """A fingerprint as text: its levels, and each stratum's cells that hold any digest, with place, count and XOR."""
    some = "transform(e, (c, i) -> IF(c.n = 0, NULL, concat(i, '.', c.n, '.', lower(hex(c.k)))))"
    strata = f"transform({cells}, (e, j) -> IF(size(e) = 0, NULL, concat({STRATA} * {made}.level + j, '=', array_join({some}, ','))))"
    return f"concat({made}.level, '-', {made}.top, ':', array_join({strata}, ' '))"


def _among(bounds: Column, value: Column) -> Column:
    """How many of the bounds are not above the value; 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(bounds, lambda b: b <= value)))


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows with bucket: numbers that rise with doc_id. Quantiles of ids make buckets; where these would be too large, each
    is cut by the quantiles of its own ids. Both tables of bounds are of a fixed size at most."""
    n = rows.count()
    quantiles = max(1, min(QUANTILES, n // BUCKET))
    bounds = sorted({int(b) for b in rows.approxQuantile("doc_id", [i / quantiles for i in range(quantiles + 1)], 1 / (4 * quantiles))}) if n else []
    rows = rows.withColumn("bucket", _among(F.array(*map(F.lit, bounds or [0])).cast("array<bigint>"), F.col("doc_id")).cast("long"))
    fine = min(QUANTILES, n // (quantiles * BUCKET))
    if fine <= 1:
        return rows
    inner = rows.groupBy("bucket").agg(F.percentile_approx("doc_id", [i / fine for i in range(fine)], 4 * fine).alias("inner"))
    within = _among(F.col("inner"), F.col("doc_id"))
    return rows.join(F.broadcast(inner), "bucket").withColumn("bucket", F.col("bucket") * (fine + 1) + within).drop("inner")


def _after(heads: DataFrame, width: int) -> DataFrame:
    """heads(bucket, first) with after: the first of the next bucket, of the first one after the last. Buckets in groups of
    `width` numbers have a window each; the last of a group takes the first of the next group."""
    heads = heads.withColumn("part", F.expr(f"bucket DIV {width}"))
    lead = F.lead("first").over(Window.partitionBy("part").orderBy("bucket"))
    parts = heads.groupBy("part").agg(F.min(F.struct("bucket", "first")).alias("least")).select(F.col("part").alias("bucket"), F.col("least.first").alias("first"))
    if parts.count() > 1:
        ahead = _after(stored(parts, "heads"), width)
    else:
        ahead = parts.withColumn("after", F.col("first"))
    ahead = ahead.select(F.col("bucket").alias("part"), F.col("after").alias("over"))
    return heads.withColumn("after", lead).join(ahead, "part").select("bucket", "first", F.coalesce("after", "over").alias("after"))


def with_next(docs: DataFrame, made: str | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next id, of the first after the last; with `made`, an expression of text,
    also its value for both, as own and other."""
    rows = _bucketed(texts(docs).withColumn("tie", F.xxhash64("text")))
    heads = stored(rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie", "text")).alias("first")), "heads")
    over = _after(heads, BUCKET).select("bucket", F.col("after.text").alias("over_text"))
    along = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    names = ["text"]
    if made is not None:
        over = over.withColumn("over_own", F.expr(made.replace("text", "over_text")))
        rows = rows.repartition("bucket").withColumn("own", F.expr(made))
        names.append("own")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(along) for c in names}).join(over, "bucket")
    rows = rows.withColumns({f"next_{c}": F.coalesce(f"next_{c}", f"over_{c}") for c in names})
    return rows.select("doc_id", "text", "next_text", *([] if made is None else ["own", F.col("next_own").alias("other")]))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text."""
    rows = texts(docs).withColumn("made", F.expr(cut("text"))).withColumn("cells", F.expr(sketches("made")))
    return rows.select("doc_id", F.expr(written("made", "cells")).alias("fingerprint"))


def compare(versions: DataFrame, level: int = 2) -> DataFrame:
    """versions(old_text, new_text, ...) with the paragraph digests of a level that differ (n: 1 if only the old text has it,
    -1 if only the new one; k: the digest) and the likeness, the share of all digests of both that the other has too."""
    rows = versions.withColumns({"old_text": F.coalesce("old_text", F.lit("")), "new_text": F.coalesce("new_text", F.lit(""))})
    rows = rows.withColumns({"__a": F.expr(cut("old_text")), "__b": F.expr(cut("new_text"))})
    rows = rows.withColumns({"__p": F.expr(sketches("__a")), "__q": F.expr(sketches("__b"))})
    # the fingerprints tell about how many digests differ, which gives the strata; each is then a slice of all digests by stratum
    guess = f"size({difference('__a', '__b', '__p', '__q')}) * pow(2.0D, greatest(0, greatest(__a.level, __b.level) - {level}))"
    rows = rows.withColumn("__g", F.expr(f"greatest(1, CAST(least(1e9D, ceil(({guess}) / {LOAD}.0D)) AS INT))"))
    keyed = let("z", "xxhash64(k)", f"named_struct('t', CAST(pmod(z, __g) AS INT), 'n', {{}}, 'k', {certified('k', 'z')})")

    def side(text: str, n: int) -> str:
        found = let("h", units(text), f"IF(size(h) = 0, CAST(array() AS array<bigint>), {let('b', starts('sequence(0, size(h) - 1)', str(level)), paragraphs('b'))})")
        return f"transform({found}, k -> {keyed.format(n)})"

    rows = rows.withColumn("__all", F.expr(f"array_sort(concat({side('old_text', 1)}, {side('new_text', -1)}))"))
    rows = rows.withColumn("__at", F.expr("IF(size(__all) = 0, CAST(array() AS array<int>), filter(sequence(1, size(__all)), i -> i = 1 OR get(__all, i - 1).t <> get(__all, i - 2).t))"))
    part = let("w", "slice(__all, s, coalesce(get(__at, j + 1), size(__all) + 1) - s)", let("u", "transform(filter(w, e -> e.n = 1), e -> e.k)", let("v", "transform(filter(w, e -> e.n = -1), e -> e.k)", peeled("u", "v"))))
    rows = rows.withColumn("differing", F.expr(f"flatten(transform(__at, (s, j) -> {part}))"))
    rows = rows.withColumn("likeness", F.expr("IF(size(__all) = 0, 1.0D, CAST(size(__all) - size(differing) AS DOUBLE) / size(__all))"))
    return rows.drop("__a", "__b", "__p", "__q", "__g", "__all", "__at")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    half = "CAST(floor(n_chars / 2) AS INT)"
    rows = with_next(docs, cut("text")).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, CAST(n_chars AS INT) - {half}), substring(next_text, 1, {half}))"))
    rows = rows.withColumns({"new": F.expr(cut("edited")), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)}).drop("text", "edited", "next_text")
    # of the next text only the sketches that are compared are made
    sketched = {"own": sketches("own"), "new": sketches("new"), "other": sketches("other", common("other", "own"))}
    rows = rows.withColumns({f"{c}_cells": F.expr(x) for c, x in sketched.items()})
    versions = "array(named_struct('f', new, 'c', new_cells), named_struct('f', other, 'c', other_cells))"
    near = likeness("own", "w.f", difference("own", "w.f", "own_cells", "w.c"))
    rows = rows.withColumn("near", F.expr(f"transform({versions}, w -> {near})"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.expr(written("own", "own_cells")).alias("fingerprint"),
        F.expr(written("new", "new_cells")).alias("edited_fingerprint"),
        F.col("near")[0].alias("near_edited"),
        F.col("near")[1].alias("near_next"),
    )
