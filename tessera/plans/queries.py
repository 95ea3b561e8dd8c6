"""The registered queries of the engine's own operators, over relations derived from the driver's tables, and the same in
SQL. Paths come out as text joined by '/'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, text
from ..operators import audit, edits, effects, inventory, native, queue, snapshot
from ..sources import declarations, suites
from .fixpoint import reachable

#: The market segments of the tables' generator (fixed values).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_s = lambda c: F.col(c).cast("string")
_joined = lambda c="path": F.array_join(c, "/").alias("path")

_BYTES = "regexp_extract_all(hex(encode({})), '..')"
_PLAIN = "^(3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2D|2E|5F)$"
_NIBBLE = "(instr('0123456789ABCDEF', substr(b, {}, 1)) - 1)"


def _slug_sql(path: str) -> str:
    byte = f"case when regexp_matches(b, '{_PLAIN}') then decode(unhex(b)) else '%' || b end"
    return f"array_to_string(list_transform({path}, lambda p: array_to_string(list_transform({_BYTES.format('lower(p)')}, lambda b: {byte}), '')), '#')"


def _fnv_sql(value: str) -> str:
    number = f"({_NIBBLE.format(1)} * 16 + {_NIBBLE.format(2)})::hugeint"
    fold = f"list_reduce(list_prepend({naming.FNV_START}::hugeint, list_transform({_BYTES.format(value)}, lambda b: {number})), lambda h, b: ((h - h % 256 + xor((h % 256)::bigint, b::bigint)) * {naming.FNV_PRIME}::hugeint) % {naming.FNV_MODULUS}::hugeint)"
    return f"(select lpad(lower(to_hex((v // 4294967296)::bigint)), 8, '0') || lpad(lower(to_hex((v % 4294967296)::bigint)), 8, '0') from (select {fold} as v))"


def _page_callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    rest = F.regexp_replace("url", r"^https?://[^/]+/?", "")
    rows = pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("file"), F.split(rest, "/").alias("path"))
    return rows.groupBy("file", "path").agg(F.min("page_id").alias("page_id")).select(F.lit("node").alias("kind"), F.col("file").alias("lib"), "file", "path", "page_id")


def queue_rows(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    rows = _page_callables(spark, sf_dir)
    have = rows.select("file", "path", F.when(F.col("page_id") % 3 == 0, F.col("page_id")).alias("pending"))
    return queue.page(rows.drop("page_id"), have, limit, kind="node", after="node/24/a").select("id", "node_version", "test_file", _joined("describe_path").alias("describe_path"), "evidence_file", "pending")


_QUEUE = f"""
with c as (select string_split(url, '/')[3] as file, string_split(regexp_replace(url, '^https?://[^/]+/?', ''), '/') as path, page_id from pages),
g as (select file, path, min(page_id) as page_id from c group by 1, 2),
n as (select *, to_json(path)::varchar as key, {_slug_sql('path')} as slug from g),
m as (select *, count(*) over (partition by file, slug) as k from n),
e as (select *, case when k > 1 or length(slug) > 180 or slug in ('.', '..') then substr(slug, 1, 180) || '~' || {_fnv_sql('key')} else slug end as name from m)
select 'node/24/' || file || '::' || key as id, '24' as node_version, 'node/24/' || file as test_file, array_to_string(path, '/') as describe_path,
  'node/24/' || file || '/' || name || '.md' as evidence_file, page_id as pending
from e where page_id % 3 = 0 and 'node/24/' || file || '::' || key > 'node/24/a' order by id limit 50"""


@query(_QUEUE)
def queue_page(spark, sf_dir):
    return queue_rows(spark, sf_dir)


@query(f"""
with c as (select p_brand as file, [p_type, p_name] as path from part union select p_brand, [p_type, upper(p_name)] from part where p_partkey % 2 = 0),
n as (select *, to_json(path)::varchar as key, {_slug_sql('path')} as slug from c),
m as (select *, count(*) over (partition by file, slug) as k from n)
select file, key, slug, case when k > 1 or length(slug) > 180 then substr(slug, 1, 180) || '~' || {_fnv_sql('key')} else slug end as name from m""")
def slug_names(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("file"), F.array("p_type", "p_name").alias("path"))
    rows = rows.union(part.where("p_partkey % 2 = 0").select("p_brand", F.array("p_type", F.upper("p_name")))).distinct()
    return naming.evidence_names(rows.withColumn("kind", F.lit("node"))).select("file", "key", "slug", "name")


@query(f"select n_nationkey, k as key, {_fnv_sql('k')} as hash from (select n_nationkey, to_json([r_name, n_name])::varchar as k from nation join region on n_regionkey = r_regionkey)")
def fnv1a(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("key", naming.json_key(F.array("r_name", "n_name")))
    return rows.select("n_nationkey", "key", naming.fnv1a(F.col("key")).alias("hash"))


@query(
    "with s as (select distinct lower(replace(p_type, ' ', '.')) as stem from part union select 'es2015.bigint.' || lower(p_brand) from part) "
    "select stem, array_to_string(list_transform(string_split(stem, '.'), lambda p: case "
    + " ".join(f"when p = '{a}' then '{b}'" for a, b in naming.SPELT.items())
    + " when starts_with(p, 'es') then upper(p) else upper(substr(p, 1, 1)) || substr(p, 2) end), '.') as name from s"
)
def library_names(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    stems = part.select(F.lower(F.replace("p_type", F.lit(" "), F.lit("."))).alias("stem")).union(part.select(F.concat(F.lit("es2015.bigint."), F.lower("p_brand")))).distinct()
    return stems.select("stem", naming.library_name(F.col("stem")).alias("name"))


def _tree(spark, sf_dir, least: float) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("file"), F.array("n_name", "c_mktsegment").alias("path"), (F.col("c_acctbal") > least).alias("callable"))


_TREE = "with t as (select r_name as file, n_name as a, c_mktsegment as b, c_acctbal > {} as c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


@query(_TREE.format(0) + " select file, a || '/' || b as path, bool_or(c) as callable from t group by all union all select file, a, false from (select distinct file, a from t)")
def tree_merge(spark, sf_dir):
    return inventory.with_ancestors(_tree(spark, sf_dir, 0)).select("file", _joined(), "callable")


@query(_TREE.format(9000) + " select distinct file, a || '/' || b as path, true as callable from t where c union all select distinct file, a, false from t where c")
def tree_prune(spark, sf_dir):
    return inventory.prune(_tree(spark, sf_dir, 9000)).select("file", _joined(), "callable")


@query("""
with s as (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) as seg), n as (select n_nationkey, n_regionkey, n_name, r_name from nation join region on n_regionkey = r_regionkey)
select n_name as path, seg as target, case when n_nationkey % 5 = 0 then r_name || '/' || n_name || '/' || seg
  when n_regionkey % 2 = 0 then r_name || '/' || seg when seg < 'C' then seg end as resolved from n, s""")
def scope_resolve(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = F.array(*map(F.lit, SEGMENTS))
    rows = nation.withColumn("c_mktsegment", F.explode(segments))
    target = F.array("c_mktsegment")
    refs = rows.select(F.lit("f").alias("file"), F.array("n_name").alias("path"), F.array("r_name", "n_name").alias("scope"), target.alias("target"))
    nodes = [rows.where("c_mktsegment < 'C'").select(target), rows.where("n_regionkey % 2 = 0").select(F.array("r_name", "c_mktsegment")), rows.where("n_nationkey % 5 = 0").select(F.array("r_name", "n_name", "c_mktsegment"))]
    known = nodes[0].union(nodes[1]).union(nodes[2]).toDF("path").distinct().withColumn("file", F.lit("f"))
    return inventory.resolve(refs, known).select(_joined(), F.array_join("target", "/").alias("target"), F.array_join("resolved", "/").alias("resolved"))


_LINKS = "select p_partkey as src, case when p_partkey < 2 then p_partkey + 1 when p_partkey = 2 then 0 else p_partkey // 3 end as dst from part"


def _links(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(k.alias("src"), F.when(k < 2, k + 1).when(k == 2, F.lit(0)).otherwise(F.floor(k / 3)).cast("long").alias("dst"))


@query(f"with recursive e as ({_LINKS}), r as (select p_partkey as src, p_partkey as dst from part union select dst, dst from e union select r.src, e.dst from r join e on r.dst = e.src) select src, count(*) as reach, sum(dst)::bigint as total from r group by 1")
def alias_closure(spark, sf_dir):
    return reachable(_links(spark, sf_dir)).groupBy("src").agg(F.count("*").alias("reach"), F.sum("dst").alias("total"))


@query(f"""
with recursive e as ({_LINKS}), r as (select p_partkey as src, p_partkey as dst from part union select r.src, e.dst from r join e on r.dst = e.src),
s as (select p_partkey as k, case when p_partkey % 2 = 0 then null when p_partkey % 3 = 0 then 'new' else 'm' || (p_partkey % 10) end as child from part where p_partkey % 4 <> 0)
select 'n' || e.src as path, count(distinct coalesce(child, '')) as shapes, string_agg(distinct coalesce(child, ''), ',' order by coalesce(child, '')) as children
from e join r on r.src = e.dst join s on s.k = r.dst where e.src % 5 = 0 or child is null or child = 'new' group by 1""")
def alias_expand(spark, sf_dir):
    links = _links(spark, sf_dir)
    name = lambda c: F.array(F.concat(F.lit("n"), _s(c)))
    refs = links.select(F.lit("f").alias("file"), name("src").alias("path"), F.array().cast("array<string>").alias("scope"), name("dst").alias("target"), (F.col("src") % 5 == 0).alias("object"))
    child = F.when(F.col("p_partkey") % 2 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 0, "new").otherwise(F.concat(F.lit("m"), (F.col("p_partkey") % 10).cast("string")))
    shapes = _t(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.lit("f").alias("file"), name("p_partkey").alias("path"), child.alias("child"), F.lit(True).alias("callable"))
    out = inventory.expand(refs, shapes).select(F.element_at("path", 1).alias("path"), F.coalesce(F.try_element_at("path", F.lit(2)), F.lit("")).alias("child"))
    return out.groupBy("path").agg(F.count("*").alias("shapes"), F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children"))


_NODES = """with o as (select o_orderpriority as file, o_custkey as c, o_orderkey as k from orders),
n as (select distinct file, c::varchar as path, c as x, null as up from o union all select file, c::varchar || '/' || k::varchar, k, c::varchar from o),
a as (select *, case when x % 7 <> 0 and x % 3 <> 0 then 'keep' when x % 7 <> 0 then 'add' when x % 5 <> 0 and x % 3 <> 0 then 'delete' else 'ignore' end as action from n where x % 7 <> 0 or x % 5 <> 0 or x % 3 <> 0)"""


def _versions(spark, sf_dir) -> list[DataFrame]:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), "o_custkey", "o_orderkey")
    nodes = o.select("file", F.array(_s("o_custkey")).alias("path"), F.col("o_custkey").alias("x")).distinct().unionByName(o.select("file", F.array(_s("o_custkey"), _s("o_orderkey")).alias("path"), F.col("o_orderkey").alias("x")))
    return [nodes.where(F.col("x") % m != 0) for m in (5, 7, 3)]


@query(_NODES + " select file, path, action from a")
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(*_versions(spark, sf_dir)).select("file", _joined(), "action")


@query(_NODES + " select file, path, action from a where action in ('add', 'delete') and not exists (select 1 from a b where b.file = a.file and b.path = a.up and b.action in ('add', 'delete'))")
def diff_topmost(spark, sf_dir):
    return snapshot.topmost(snapshot.diff(*_versions(spark, sf_dir))).select("file", _joined(), "action")


@query(_NODES + " select file, path from n where x % 7 <> 0 and x % 3 <> 0")
def adopted_suites(spark, sf_dir):
    _, desired, existing = _versions(spark, sf_dir)
    return snapshot.adopted(desired, existing).select("file", _joined())


@query(_NODES + " select file, path from n where x % 3 <> 0 and (x % 5 <> 0 or x % 7 <> 0)")
def managed_suites(spark, sf_dir):
    previous, desired, existing = _versions(spark, sf_dir)
    return snapshot.managed(existing, previous, desired).select("file", _joined())


@query("select c_custkey::varchar as file, c_custkey % 7 = 0 as retired from customer where c_custkey % 5 <> 0 or c_custkey % 7 <> 0")
def retired_files(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(_s("c_custkey").alias("file"), "c_custkey")
    return snapshot.retired_files(rows.where("c_custkey % 5 <> 0"), rows.where("c_custkey % 7 <> 0"))


@query("select count(*) as files, count_if(turn % 3 = 0 or turn % 2 = 1) as changed from conversations")
def change_report(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("file"), "turn", "text")
    now = rows.where("turn % 3 <> 0").select("file", F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return snapshot.report(rows.select("file", "text"), now)


@query("""with e as (select l_orderkey, l_partkey % 1000 as "start", (l_partkey % 1000 + l_quantity)::bigint as "end" from lineitem),
w as (select *, lag("end") over (partition by l_orderkey order by "start", "end") as ahead from e) select * from w where ahead > "start" """)
def edit_overlap(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1000).alias("start"), (F.col("l_partkey") % 1000 + F.col("l_quantity")).cast("long").alias("end"))
    return edits.overlaps(rows, "l_orderkey")


@query("""with s as (select user_id, event_id * 10 as "start", event_id * 10 + 5 as "end", repeat(chr(10), (event_id % 4)::int) || case when event_id % 5 = 0 then 'x' else ' ' end as between from events),
w as (select *, lead("start") over (partition by user_id order by "start", "end") as next from s)
select user_id, "start", case when next is not null and between not like '%x%' then greatest(2 - (length(between) - length(replace(between, chr(10), ''))), 0) else 0 end::int as lines from w""")
def sibling_gaps(spark, sf_dir):
    k = F.col("event_id")
    between = F.concat(F.repeat(F.lit("\n"), (k % 4).cast("int")), F.when(k % 5 == 0, "x").otherwise(" "))
    rows = _t(spark, sf_dir, "events").select("user_id", (k * 10).alias("start"), (k * 10 + 5).alias("end"), between.alias("between"))
    return edits.gaps(rows, ["user_id"]).select("user_id", "start", F.col("lines").cast("int").alias("lines"))


@query("select doc_id, sha256('>> ' || substr(text, 1, length(text) // 2) || '[cut]' || substr(text, length(text) // 2 + 4) || ' <<') as text_sha256 from documents where length(text) >= 8")
def edit_apply(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where(F.length("text") >= 8).select(F.col("doc_id").alias("file"), "text")
    size = lambda n: F.octet_length(F.expr(f"substring(text, 1, CAST({n} AS INT))")).cast("long")
    half = "length(text) DIV 2"
    puts = [(F.lit(0).cast("long"), F.lit(0).cast("long"), ">> "), (size(half), size(f"{half} + 3"), "[cut]"), (F.octet_length("text").cast("long"), F.octet_length("text").cast("long"), " <<")]
    rows = [docs.select("file", a.alias("start"), b.alias("end"), F.lit(t).alias("text")) for a, b, t in puts]
    done = edits.apply(docs, rows[0].unionByName(rows[1]).unionByName(rows[2]))
    return done.select(F.col("file").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("select doc_id, (1 + length(h) - length(replace(h, chr(10), '')))::int as line, case when contains(text, chr(13) || chr(10)) then 'crlf' else 'lf' end as newline from (select doc_id, text, substr(text, 1, length(text) // 2) as h from documents where text is not null)")
def offset_to_line(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    offset = F.octet_length(F.expr("substring(text, 1, CAST(length(text) DIV 2 AS INT))"))
    return docs.select("doc_id", text.line_at(F.col("text"), offset).alias("line"), F.when(text.newline(F.col("text")) == "\r\n", "crlf").otherwise("lf").alias("newline"))


_CALLS = """with recursive t as (select conv_id, turn, min(role) as role, min(length(text)) as n from conversations group by 1, 2),
f as (select conv_id || ':' || turn as fn, conv_id || ':' || (turn + 1) as callee, role = 'assistant' as is_async, turn, turn % 2 = 0 as awaited, turn % 3 = 0 as returned, n % 5 = 0 as consumed, n % 6 = 0 as caught,
  n % 4 = 0 and n % 8 <> 0 as thrown, 'E' || (n % 3) as err from t),
eff as (select fn, case when is_async then 'rejects' else 'throws' end as channel, err from f where thrown
  union select fn, case when is_async or caught then 'rejects' else 'throws' end, 'unknown' from f where (not caught or not awaited and returned and not consumed) and callee not in (select fn from f)
  union select f.fn, case when e.channel = 'throws' or f.awaited then case when f.is_async then 'rejects' else 'throws' end else 'rejects' end, e.err
  from eff e join f on f.callee = e.fn where (e.channel = 'throws' and not f.caught) or (e.channel = 'rejects' and f.awaited and not f.consumed and not f.caught)
    or (e.channel = 'rejects' and not f.awaited and f.returned and not f.consumed))"""


def _calls(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min(F.length("text")).alias("n"))
    rows = rows.withColumn("fn_id", F.concat_ws(":", "conv_id", "turn"))
    fns = rows.select("fn_id", (F.col("role") == "assistant").alias("is_async"), (F.col("turn") % 2 == 0).alias("user_written"))
    region = lambda m: F.when(F.col("n") % m == 0, F.concat(F.lit(f"t{m}:"), "fn_id"))
    site = lambda kind, callee, error, reg: rows.select(F.concat_ws("/", "fn_id", F.lit(kind)).alias("site_id"), "fn_id", F.lit(kind).alias("kind"), callee.alias("callee"), error.alias("error_type"), (F.col("turn") % 2 == 0).alias("awaited"), (F.col("turn") % 3 == 0).alias("returned"), (F.col("n") % 5 == 0).alias("consumed"), reg.alias("region_id"), "n")
    none = F.lit(None).cast("string")
    throws = site("throw", none, F.concat(F.lit("E"), (F.col("n") % 3).cast("string")), region(8)).where("n % 4 = 0")
    calls = site("call", F.concat_ws(":", "conv_id", (F.col("turn") + 1).cast("string")), none, region(6))
    sites = throws.unionByName(calls).drop("n")
    # each region stands inside a plain block, so that the way up is walked too
    tries = sites.where("region_id is not null").select("region_id", F.concat(F.lit("in:"), "region_id").alias("parent_id"), "fn_id")
    regions = tries.select("region_id", "parent_id", "fn_id", F.lit("body").alias("kind")).unionByName(tries.select(F.col("parent_id").alias("region_id"), none.alias("parent_id"), "fn_id", F.lit("try").alias("kind")))
    return fns, sites, regions


def _effects(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    fns, sites, regions = _calls(spark, sf_dir)
    return effects.infer(fns, sites, regions), fns, sites


def _contracts(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").where("turn % 4 < 2").select(F.concat_ws(":", "conv_id", "turn").alias("fn_id"), F.when(F.col("turn") % 4 == 0, "E0").alias("error_type"))
    return rows.distinct()


@query(_CALLS + " select fn as fn_id, channel, err as error_type from eff")
def effect_fixpoint(spark, sf_dir):
    return _effects(spark, sf_dir)[0]


_CONTRACT = """, c as (select fn as fn_id, case when turn % 4 = 0 then 'E0' end as err from f where turn % 4 < 2),
i as (select distinct fn as fn_id, err from eff where fn in (select fn_id from c))"""


@query(_CALLS + _CONTRACT + " select fn_id, err as error_type, 'missing' as problem, 98002 as code from i where (fn_id, err) not in (select fn_id, err from c where err is not null) union all select fn_id, err, 'extra', 98002 from c where err is not null and (fn_id, err) not in (select fn_id, err from i)")
def contract_check(spark, sf_dir):
    return effects.contract_check(_effects(spark, sf_dir)[0], _contracts(spark, sf_dir))


@query(_CALLS + " select fn as fn_id, string_agg(distinct eff.err, ' | ' order by eff.err) as inferred, 98003 as code from eff join f using (fn) where turn % 2 = 0 and turn % 4 >= 2 group by 1")
def implicit_contract(spark, sf_dir):
    found, fns, _ = _effects(spark, sf_dir)
    return effects.implicit_contracts(found, fns, _contracts(spark, sf_dir))


@query(_CALLS + " select '<root>' as fn_id, split_part(fn, ':', 1) as program, channel, eff.err as error_type from eff join f using (fn) where turn = (select min(turn) from t)")
def root_unhandled(spark, sf_dir):
    found = _effects(spark, sf_dir)[0]
    first = _t(spark, sf_dir, "conversations").agg(F.min("turn").cast("string").alias("first"))
    top = found.join(F.broadcast(first), F.split_part("fn_id", F.lit(":"), F.lit(2)) == F.col("first")).select(F.lit(effects.ROOT).alias("fn_id"), F.split_part("fn_id", F.lit(":"), F.lit(1)).alias("program"), "channel", "error_type")
    return effects.unhandled_root(top)


@query(_CALLS + " select fn || '/call' as site_id, fn as fn_id from f where not awaited and not returned and not consumed and callee in (select fn from eff where channel = 'rejects')")
def promise_unhandled(spark, sf_dir):
    found, _, sites = _effects(spark, sf_dir)
    return effects.unhandled_promises(found, sites).select("site_id", "fn_id")


@query(_CALLS + " select fn as fn_id, case when is_async then 'Promise<Returns<string, ' || e || '>>' else 'Returns<string, ' || e || '>' end as annotation from (select fn, is_async, coalesce(string_agg(distinct eff.err, ' | ' order by eff.err), 'never') as e from f left join eff using (fn) group by 1, 2)")
def return_types(spark, sf_dir):
    found, fns, _ = _effects(spark, sf_dir)
    return effects.return_type(found, fns, F.lit("string"))


@query("""with b as (select distinct p_brand as region_id, p_type as error_type from part), t as (select p_brand, min(p_type) as a, split_part(max(p_type), ' ', 1) as z from part group by 1)
select region_id, error_type, case when error_type = a then 1 when split_part(error_type, ' ', 1) = z then 2 end::int as branch from b join t on p_brand = region_id""")
def narrowing(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    bound = part.select(F.col("p_brand").alias("region_id"), F.col("p_type").alias("error_type")).distinct()
    ends = part.groupBy("p_brand").agg(F.min("p_type").alias("a"), F.split_part(F.max("p_type"), F.lit(" "), F.lit(1)).alias("z"))
    tests = ends.select(F.col("p_brand").alias("region_id"), F.lit(1).alias("branch"), F.col("a").alias("type")).union(ends.select("p_brand", F.lit(2), "z"))
    subtypes = part.select(F.col("p_type").alias("sub"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("super")).where("sub <> super").distinct()
    return effects.narrow(bound, tests, subtypes)


@query("select c_custkey::varchar as config, 'strict' as name, coalesce(case when c_custkey % 10 = 0 then (c_acctbal > 0)::varchar end, case when n_nationkey % 2 = 0 then 'false' end, 'true') as value from customer join nation on c_nationkey = n_nationkey")
def option_inherit(spark, sf_dir):
    customer, nation = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(_s("c_custkey").alias("config"), F.concat(F.lit("n"), _s("n_nationkey")).alias("n"), F.concat(F.lit("r"), _s("n_regionkey")).alias("r"))
    chain = rows.select("config", F.posexplode(F.array("config", "n", "r")).alias("distance", "ancestor"))
    opts = customer.select(_s("c_custkey").alias("config"), F.when(F.col("c_custkey") % 10 == 0, (F.col("c_acctbal") > 0).cast("string")).alias("value"))
    opts = opts.union(nation.select(F.concat(F.lit("n"), _s("n_nationkey")), F.when(F.col("n_nationkey") % 2 == 0, "false"))).union(nation.select(F.concat(F.lit("r"), _s("n_regionkey")), F.lit("true")).distinct())
    return effects.option_values(chain, opts.withColumn("name", F.lit("strict")))


@query("select toxic, count(*) as attempted, count_if(quality = 1) as accepted, count_if(quality = 0) as blocked from labels group by 1")
def audit_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select("toxic", F.when(F.col("quality") == 1, "complete").when(F.col("quality") == 0, "blocked").otherwise("open").alias("status"))
    return audit.rollup(rows, ["toxic"])


@query("select event_type as id, case when user_id % 2 = 0 then 'throws' else 'rejects' end as channel, string_agg(distinct 'E' || (event_id % 4), ' | ' order by 'E' || (event_id % 4)) as errors from events group by 1, 2")
def error_unions(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.when(F.col("user_id") % 2 == 0, "throws").otherwise("rejects").alias("channel"), F.concat(F.lit("E"), (F.col("event_id") % 4).cast("string")).alias("outcome"))
    return audit.unions(rows)


@query("""with m as (select o_orderdate as t, o_orderpriority as label, 'order ' || o_orderkey as x from orders where o_orderkey % 2 = 0)
select label, count(*)::int as n, sha256(string_agg(x, ';' order by t, x)) as entries_sha256 from m group by 1""")
def changelog(spark, sf_dir):
    tag = F.when(F.col("o_orderkey") % 2 == 0, "[bin] ").otherwise("[lib] ")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"), F.concat(tag, "o_orderpriority", F.lit(": order "), _s("o_orderkey")).alias("message"))
    return audit.changelog(rows).select("label", F.size("entries").alias("n"), F.sha2(F.array_join("entries", ";").cast("binary"), 256).alias("entries_sha256"))


_NATIVE = """with recursive e as (select p_partkey as k, p_partkey // 2 as c, case p_partkey % 11 when 0 then 'lambda' when 1 then 'virtual' else 'call' end as kind from part),
r as (select max(p_partkey) as k from part union select e.c from r join e on e.k = r.k where kind = 'call' and e.c in (select p_partkey from part))"""


def _native(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    part = _t(spark, sf_dir, "part")
    k, sig = F.col("p_partkey"), F.lit("void (int)")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    functions = part.select(name(k).alias("name"), sig.alias("signature"), F.lit(True).alias("defined"))
    kind = F.when(k % 11 == 0, "lambda").when(k % 11 == 1, "virtual").otherwise("call")
    edges = part.select(name(k).alias("caller"), sig.alias("caller_signature"), name(F.floor(k / 2)).alias("callee"), sig.alias("signature"), kind.alias("kind"))
    return functions, edges, part.agg(F.max("p_partkey")).first()[0]


@query(_NATIVE + " select 'f' || k as name, 'void (int)' as signature from r")
def native_reach(spark, sf_dir):
    functions, edges, last = _native(spark, sf_dir)
    return native.reached(functions, edges, native.entry(functions, f"f{last}"))


@query(_NATIVE + " select distinct 'f' || e.k as caller, case kind when 'lambda' then 'lambda' else 'f' || e.c end as operation, case kind when 'lambda' then 'Lambda bodies are not walked eagerly' when 'virtual' then 'Virtual dispatch' else 'No definition is visible' end as reason from r join e on e.k = r.k where kind <> 'call' or e.c not in (select p_partkey from part)")
def native_boundaries(spark, sf_dir):
    functions, edges, last = _native(spark, sf_dir)
    return native.unresolved(native.reached(functions, edges, native.entry(functions, f"f{last}")), edges, functions)


@query("select r_name || '.test.ts' as file, 'R' || r_regionkey as path, false as callable from region where r_regionkey in (select n_regionkey from nation) union all select r_name || '.test.ts', 'R' || r_regionkey || '/N' || n_nationkey || x.s, x.c from nation join region on n_regionkey = r_regionkey, (values ('', false), ('/new', true), ('/static run', true), ('/get size', true)) as x(s, c) union all select r_name || '.test.ts', 'V' || n_nationkey || x.s, x.c from nation join region on n_regionkey = r_regionkey, (values ('', false), ('/m', true)) as x(s, c)")
def declaration_inventory(spark, sf_dir):
    """Declaration sources written from the tables, then parsed, resolved and merged."""
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = _s("n_nationkey")
    body = F.concat(F.lit("class N"), n, F.lit(" { constructor(x: { y(): void }); static run(): void; get size(): number; private gone(): void; size2: number }\n interface I"), n, F.lit(" { data: string }"))
    outer = F.concat(F.lit("interface W"), n, F.lit(" { m(): void }\ndeclare var V"), n, F.lit(": W"), n, F.lit(";"))
    per = rows.groupBy("r_name", "r_regionkey").agg(F.array_join(F.array_sort(F.collect_list(body)), "\n").alias("inner"), F.array_join(F.array_sort(F.collect_list(outer)), "\n").alias("outer"))
    source = F.concat(F.lit("declare namespace R"), _s("r_regionkey"), F.lit(" {\n"), "inner", F.lit("\n}\n"), "outer")
    found = declarations.declared(declarations.parse(per.select(F.concat("r_name", F.lit(".test.ts")).alias("file"), source.alias("text"))))
    # the interfaces W are nodes of their own beside the variables that take their methods
    return found.where(~F.element_at("path", 1).startswith("W")).select("file", _joined(), "callable")


@query("select r_name as file, sha256('" + suites.HEADER.strip() + """' || chr(10) || 'import { describe, it } from "vitest";' || chr(10) || chr(10) || string_agg('describe("N' || n_nationkey || '", () => {' || chr(10) || '  it("TODO", () => {' || chr(10) || '    // TODO' || chr(10) || '  });' || chr(10) || '});' || chr(10), chr(10) order by 'N' || n_nationkey)) as text_sha256 from nation join region on n_regionkey = r_regionkey group by 1""")
def suite_sync(spark, sf_dir):
    """New test files for an inventory."""
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    desired = rows.select(F.col("r_name").alias("file"), F.array(F.concat(F.lit("N"), _s("n_nationkey"))).alias("path"), F.lit(True).alias("callable"))
    none = desired.where("false")
    blank = desired.select("file").distinct().withColumn("text", F.lit(None).cast("string"))
    return suites.synchronised(blank, none, desired).select("file", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("""with m as (select r_name as file, n_name as owner, k.kind, k.name, k.vis, k.static from nation join region on n_regionkey = r_regionkey,
  (values ('method', 'run', null, true), ('get', 'size', null, false), ('constructor', 'x', null, false), ('method', 'gone', 'private', false), ('method', 'prototype', null, false), ('call', null, null, false), ('data', 'd', null, false)) as k(kind, name, vis, static))
select file, owner || case kind when 'method' then '/static run' when 'get' then '/get size' when 'constructor' then '/new' when 'data' then '/d' else '' end as path, kind <> 'data' as callable from m where vis is null and coalesce(name, '') <> 'prototype'""")
def member_projection(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kinds = [("method", "run", None, True), ("get", "size", None, False), ("constructor", "x", None, False), ("method", "gone", "private", False), ("method", "prototype", None, False), ("call", None, None, False), ("data", "d", None, False)]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).cast("string").alias("member"), F.lit(c).cast("string").alias("visibility"), F.lit(d).alias("is_static")) for a, b, c, d in kinds])).alias("m")
    members = rows.select(F.col("r_name").alias("file"), F.array().cast("array<string>").alias("scope"), F.col("n_name").alias("owner"), each).select("file", "scope", "owner", "m.*")
    return inventory.member_paths(members).select("file", _joined(), "callable")


@query("select event_type as file, 'u' || user_id as path, min(event_id) as pending from events where event_id % 3 = 0 group by 1, 2")
def first_pending(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.array(F.concat(F.lit("u"), _s("user_id"))).alias("path"), F.when(F.col("event_id") % 3 == 0, "TODO").otherwise("works").alias("title"), F.col("event_id").alias("offset"))
    return inventory.first_pending(rows).select("file", _joined(), "pending")


@query("select event_type as file, 'u' || user_id as path, count(*) as count from events group by 1, 2 having count(*) > 1")
def duplicate_suites(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.array(F.concat(F.lit("u"), _s("user_id"))).alias("path"))
    return inventory.duplicates(rows).select("file", _joined(), "count")


@query("select r_name as file, sha256(string_agg('describe(\"' || n_name || '\", () => {' || chr(10) || '  it(\"TODO\", () => {' || chr(10) || '    // TODO' || chr(10) || '  });' || chr(10) || '});', chr(10) order by n_name)) as text_sha256 from nation join region on n_regionkey = r_regionkey group by 1")
def render_tree(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = rows.select(F.col("r_name").alias("file"), F.array("n_name").alias("path"), F.lit(True).alias("callable"))
    return edits.render(nodes).select("file", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("select 'p' || (p_partkey % 50) as id, case when p_partkey % 5 = 2 then 'R' || (p_partkey % 3) else 'E' || (p_partkey % 7) end as error_type from part where p_partkey % 5 not in (3, 4) group by all")
def effect_dispositions(spark, sf_dir):
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["intrinsic", "propagated", "replaced", "caught", "avoided"]))
    rows = _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), (k % 50).cast("string")).alias("id"), F.concat(F.lit("E"), (k % 7).cast("string")).alias("error_type"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("disposition"), F.concat(F.lit("R"), (k % 3).cast("string")).alias("replacement"))
    return effects.dispositions(rows)


@query("""with e as (select 'r' || l_suppkey as region_id, case when l_orderkey % 97 = 0 then 'unknown' else 'E' || (l_partkey % 9) end as t from lineitem)
select region_id, case when l_suppkey % 10 = 0 then 'Error' when u then 'unknown' else x end as binding from (select region_id, substr(region_id, 2)::int as l_suppkey, bool_or(t = 'unknown') as u, string_agg(distinct t, ' | ' order by t) as x from e group by 1)""")
def catch_bindings(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), _s("l_suppkey")).alias("region_id"), F.when(F.col("l_orderkey") % 97 == 0, "unknown").otherwise(F.concat(F.lit("E"), (F.col("l_partkey") % 9).cast("string"))).alias("error_type"), "l_suppkey")
    notes = rows.where("l_suppkey % 10 = 0").select("region_id", F.lit("Error").alias("annotated")).distinct()
    return effects.catch_bindings(rows, notes)


@query("""select 'c' || s_suppkey as call_id, 'throws' as channel, case when s_suppkey % 2 = 0 then 'A' || s_nationkey else 'T' end as error_type from supplier union select 'c' || s_suppkey, 'throws', 'Fixed' from supplier""")
def effect_arguments(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier")
    found = rows.select(F.concat(F.lit("f"), _s("s_suppkey")).alias("fn_id"), F.lit("throws").alias("channel"), F.explode(F.array(F.lit("T"), F.lit("Fixed"))).alias("error_type"))
    given = rows.select(F.concat(F.lit("c"), _s("s_suppkey")).alias("call_id"), F.concat(F.lit("f"), _s("s_suppkey")).alias("fn_id"), F.when(F.col("s_suppkey") % 2 == 0, "T").otherwise("U").alias("variable"), F.concat(F.lit("A"), _s("s_nationkey")).alias("type"))
    return effects.instantiate(found, given)


@query("select conv_id || '/' || turn as file, case when turn % 2 = 0 then '[' || text || ']' else text end as text from conversations")
def editor_overlay(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("file"), "text", "turn")
    return effects.overlaid(rows.select("file", "text"), rows.where("turn % 2 = 0").select("file", F.concat(F.lit("["), "text", F.lit("]")).alias("text")))


@query(f"with recursive e as ({_LINKS}), r as (select p_partkey as src, p_partkey as dst from part where p_partkey % 10 = 0 union select r.src, e.dst from r join e on r.dst = e.src) select distinct dst as variable, 'T' || (src % 4) as type from r union select dst, 'unknown' from r")
def value_flow(spark, sf_dir):
    seeds = _t(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("variable"), F.concat(F.lit("T"), (F.col("p_partkey") % 4).cast("string")).alias("type"))
    return effects.values(_links(spark, sf_dir), seeds)


@query("select 'f' || c_custkey as fn_id, case when c_custkey % 2 = 0 then 'intact' else 'any' end as assumption, string_agg(distinct 'E' || (o_orderkey % 3), ' | ' order by 'E' || (o_orderkey % 3)) as errors from customer join orders on o_custkey = c_custkey where o_orderkey % 4 <> 0 group by 1, 2")
def scoped_contracts(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.concat(F.lit("f"), _s("c_custkey")).alias("fn_id"), F.when(F.col("c_custkey") % 2 == 0, "intact").otherwise("any").alias("assumption"), F.when(F.col("o_orderkey") % 4 == 0, "callback").otherwise("throws").alias("channel"), F.concat(F.lit("E"), (F.col("o_orderkey") % 3).cast("string")).alias("error_type"))
    return effects.scoped_contracts(rows)


@query("select p_partkey, case when p_partkey % 2 = 0 then '[' || replace(p_name, ' ', '') || ']' else replace(p_name, ' ', '') end as member, case when p_type like 'S%' then 'node:' || p_type else case when starts_with('node:' || p_type, 'node:') then 'node:' || p_type end end as module, replace(lower(p_brand), '#', '') || '.' || p_size || '.test.ts' as file from part")
def key_names(spark, sf_dir):
    k = F.col("p_partkey")
    module = F.when(F.col("p_type").startswith("S"), F.col("p_type")).otherwise(F.concat(F.lit("node:"), "p_type"))
    path = F.concat(F.lit("lib."), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("."), _s("p_size"), F.lit(".d.ts"))
    return _t(spark, sf_dir, "part").select("p_partkey", naming.member_key(F.col("p_name"), k % 2 == 0).alias("member"), naming.module_name(module).alias("module"), naming.test_file(path, False).alias("file"))


@query("select doc_id, (1 + list_max(list_transform(regexp_extract_all(text || 'x' || repeat('_', (doc_id % 90)::int), 'x(_*)', 1), lambda r: length(r))))::int as underscores from documents where text is not null")
def unused_names(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    body = F.concat("text", F.lit("x"), F.repeat(F.lit("_"), (F.col("doc_id") % 90).cast("int")))
    return docs.select("doc_id", (F.length(text.unused_name(body, "x")) - 1).alias("underscores"))
