"""More registered queries of the engine's own operators: sources and sinks, test files, promise chains, native findings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, effects, inventory, native, queue
from ..sources import declarations, manifest, suites
from .queries import _TREE, _joined, _native, _page_callables, _QUEUE, _NATIVE, _s, _t, _tree, query
from .store import shared_root


def _folder(spark) -> str:
    import uuid

    return f"{shared_root(spark)}/rounds/{uuid.uuid4().hex}"


_sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
_nation = lambda spark, sf_dir: _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), _s("n_nationkey")).alias("n"), "n_name", "n_nationkey")


@query("""
select 'ts' as kind, 'n' || n_nationkey || '.test.ts' as file, sha256('type T = "' || n_name || '";') as text_sha256 from nation where n_nationkey % 3 = 0
union all select 'node', 'sub/n' || n_nationkey || '.test.ts', sha256('type T = "' || n_name || '";') from nation where n_nationkey % 3 = 1
union all select 'node', 'lib.n' || n_nationkey || '.test.ts', sha256('type T = "' || n_name || '";') from nation where n_nationkey % 3 = 0""")
def scan_declarations(spark, sf_dir):
    """Files written to a folder and found again: declarations only, by the rules of either kind."""
    root = _folder(spark)
    rows = _nation(spark, sf_dir)
    k = F.col("n_nationkey") % 3
    places = F.when(k == 0, F.array(F.concat(F.lit("lib."), "n", F.lit(".d.ts")), F.concat("n", F.lit(".txt")))).when(k == 1, F.array(F.concat(F.lit("sub/"), "n", F.lit(".d.ts")))).otherwise(F.array(F.concat(F.lit("node_modules/"), "n", F.lit(".d.ts")), F.concat(F.lit("ts5.6/"), "n", F.lit(".d.ts"))))
    files = rows.select(F.explode(places).alias("file"), F.concat(F.lit('type T = "'), "n_name", F.lit('";')).alias("text"))
    manifest.write(spark, files, root)
    found = [declarations.read(spark, root, kind == "node").select(F.lit(kind).alias("kind"), "file", _sha("text")) for kind in ("ts", "node")]
    return found[0].unionByName(found[1])


@query(_TREE.format(0) + " select '@types/node@24.1.0' as source, file, a || '/' || b as path, bool_or(c) as callable from t group by all union all select '@types/node@24.1.0', file, a, false from (select distinct file, a from t)")
def manifest_round_trip(spark, sf_dir):
    """An inventory written as a manifest and read again, its source from a package file of the wanted version."""
    version = manifest.package_gate(json.dumps({"name": "@types/node", "version": "24.1.0"}), 24)
    told = manifest.write_text(inventory.with_ancestors(_tree(spark, sf_dir, 0)), f"@types/node@{version}")
    return manifest.read(told.select(F.lit("node").alias("kind"), "text")).select("source", "file", _joined(), "callable")


@query("select c_custkey::varchar as file, case when c_custkey % 3 = 0 then c_name end as text from customer")
def optional_texts(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(_s("c_custkey").alias("file"), F.col("c_name").alias("text"), "c_custkey")
    return manifest.optional_texts(rows, rows.where("c_custkey % 3 = 0"))


@query("select 'd' || (n_nationkey % 4) || '/' || n_name || '.ts' as file, sha256(n_name || case when n_nationkey % 2 = 0 then '!' else '' end) as text_sha256, n_nationkey % 2 = 0 as changed from nation")
def written_files(spark, sf_dir):
    """A tree of files, and a second plan of which only what differs is written."""
    root = _folder(spark)
    rows = _nation(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("n_nationkey") % 4).cast("string"), F.lit("/"), "n_name", F.lit(".ts")).alias("file"), F.col("n_name").alias("text"), "n_nationkey")
    manifest.write(spark, rows, root)
    wanted = rows.select("file", F.when(F.col("n_nationkey") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    changed = manifest.write(spark, manifest.plan(wanted, manifest.present(spark, root)), root)
    return manifest.present(spark, root).select("file", _sha("text"), F.col("file").isin(changed).alias("changed"))


@query(_QUEUE.rsplit("\nselect ", 1)[0] + """,
p as (select 'node/24/' || file || '::' || key as id, 'node' as kind, file as lib, '24' as node_version, 'node/24/' || file as test_file, path as describe_path, page_id as pending, 'node/24/' || file || '/' || name || '.md' as evidence_file, name
  from e where page_id % 3 = 0 order by id limit 20)
select sha256('[' || string_agg(to_json({id: id, kind: kind, lib: lib, node_version: node_version, test_file: test_file, describe_path: describe_path, pending: pending, evidence_file: evidence_file, name: name})::varchar, ',' order by id) || ']') as json_sha256 from p""")
def page_json(spark, sf_dir):
    """A page of the queue as the document that is printed."""
    rows = _page_callables(spark, sf_dir)
    have = rows.select("file", "path", F.when(F.col("page_id") % 3 == 0, F.col("page_id")).alias("pending"))
    return manifest.page_json(queue.page(rows.drop("page_id"), have, 20, kind="node")).select(_sha("json"))


_TYPES = [("type U{n} = string | ((x: number) => void);", "U{n}"), ("type C{n}<T> = T extends string ? () => void : new () => T;", "C{n}"), ("", "C{n}/new"), ("declare function f{n}(g: () => void): () => void;", "f{n}"), ("declare namespace S{n} {{ namespace I {{ interface M {{ run(): void }} }} }}", "S{n}/I/M/run"), ("declare var q{n}: S{n}.I.M;", "q{n}/run"), ("type K{n} = keyof U{n}; type A{n} = U{n}[];", None)]


@query("select 'n' || n_nationkey as file, replace(x.p, '{n}', n_nationkey::varchar) as path from nation, (values " + ", ".join(f"('{p}')" for _, p in _TYPES if p) + ") as x(p)")
def type_shapes(spark, sf_dir):
    """Unions, conditional types, parentheses, functions and qualified names."""
    key = _s("n_nationkey")
    source = F.replace(F.lit("\n".join(t.replace("{{", "{").replace("}}", "}") for t, _ in _TYPES)), F.lit("{n}"), key)
    files = _nation(spark, sf_dir).select(F.col("n").alias("file"), source.alias("text"))
    return declarations.declared(declarations.parse(files)).where("callable").select("file", _joined())


@query(_TREE.format(9000) + " select distinct file, file || '/' || a || '/' || b as path, to_json([file, a, b])::varchar as key from t where c")
def library_callables(spark, sf_dir):
    nodes = inventory.in_library(inventory.prune(_tree(spark, sf_dir, 9000)), F.col("file"))
    return inventory.callables(nodes).select("file", _joined(), "key")


_CHAIN = """with e as (select event_id as i, event_id % 5 = 0 as is_async, event_id % 2 = 0 as awaited, event_id % 3 = 0 as returned, event_id % 4 as s, event_id % 7 = 0 as caught from events),
r as (select *, unnest(case s when 0 then ['H'] when 1 then ['T', 'Net'] when 2 then ['F'] else ['Net'] end) as error_type from e)"""


@query(_CHAIN + " select distinct 'f' || i as fn_id, case when awaited and not is_async then 'throws' else 'rejects' end as channel, error_type from r where awaited and not caught or not awaited and returned")
def promise_chains(spark, sf_dir):
    """Calls of a rejecting function with chains: a handler that raises, a plain step that raises, a handler before a
    finally that throws, none."""
    i = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), _s("event_id")).alias("fn_id"), F.concat(F.lit("s"), _s("event_id")).alias("site_id"))
    none = F.lit(None).cast("string")
    fns = rows.select("fn_id", (i % 5 == 0).alias("is_async"))
    sites = rows.select("site_id", "fn_id", F.lit("call").alias("kind"), F.lit("api").alias("callee"), none.alias("error_type"), (i % 2 == 0).alias("awaited"), (i % 3 == 0).alias("returned"), F.when(i % 7 == 0, F.concat(F.lit("t"), _s("event_id"))).alias("region_id"))
    regions = sites.where("region_id is not null").select("region_id", none.alias("parent_id"), "fn_id", F.lit("try").alias("kind"))
    step = lambda s, n, kind, error: rows.where(i % 4 == s).select("site_id", F.lit(n).alias("step"), F.lit(kind).alias("kind"), F.lit(error).cast("string").alias("error_type"))
    steps = step(0, 1, "catch", "H").unionByName(step(1, 1, "then", "T")).unionByName(step(2, 1, "catch", "H")).unionByName(step(2, 2, "finally", "F"))
    models = spark.createDataFrame([("api", "rejects", "Net")], "callee string, channel string, error_type string")
    return effects.infer(fns, sites, regions, models, steps=steps)


@query("""select 'f' || p_partkey as fn_id, case when p_partkey % 3 = 2 then 'iterates' when p_partkey % 5 = 0 then 'rejects' else 'throws' end as channel, 'Stop' as error_type from part where p_partkey % 3 in (0, 2) and (p_partkey % 3 = 0 or p_partkey % 2 = 0)
union all select 'f' || p_partkey, case when p_partkey % 5 = 0 then 'rejects' else 'throws' end, 'Parse' from part where p_partkey % 3 = 1""")
def modelled_effects(spark, sf_dir):
    """Host functions by their models: an iterator that is walked or handed on, and one that throws."""
    k = F.col("p_partkey")
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), _s("p_partkey")).alias("fn_id"))
    none = F.lit(None).cast("string")
    fns = rows.select("fn_id", (k % 5 == 0).alias("is_async"))
    sites = rows.select(F.concat(F.lit("s"), "fn_id").alias("site_id"), "fn_id", F.when(k % 3 == 0, "iterate").otherwise("call").alias("kind"), F.when(k % 3 == 1, "JSON.parse").otherwise("walk").alias("callee"), none.alias("error_type"), F.lit(False).alias("awaited"), (k % 2 == 0).alias("returned"), F.lit(False).alias("consumed"), none.alias("region_id"))
    models = spark.createDataFrame([("walk", "iterates", "Stop"), ("JSON.parse", "throws", "Parse")], "callee string, channel string, error_type string")
    return effects.infer(fns, sites, sites.select("region_id", none.alias("parent_id"), "fn_id", F.lit("try").alias("kind")).where("false"), models)


@query("select l_orderkey, l_linenumber, p_brand as signature, p.p_partkey as declared from lineitem join part q on q.p_partkey = l_partkey left join part p using (p_brand) where l_orderkey % 50 = 0 and p.p_partkey % 100 = 0 union all select l_orderkey, l_linenumber, q.p_brand, null from lineitem join part q on q.p_partkey = l_partkey where l_orderkey % 50 = 0 and q.p_brand not in (select p_brand from part where p_partkey % 100 = 0)")
def call_candidates(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    calls = _t(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 0").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("signature"))
    return effects.candidates(calls, part.where("p_partkey % 100 = 0").select(F.col("p_brand").alias("signature"), F.col("p_partkey").alias("declared")))


@query("select distinct 'f' || user_id as fn_id, event_type as channel, 'E' || (event_id % 3) as error_type from (select user_id, event_id, case event_id % 4 when 0 then 'throws' when 1 then 'rejects' when 2 then 'callback' else 'event' end as event_type from events) where event_type in ('throws', 'rejects')")
def delivered_effects(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["throws", "rejects", "callback", "event"]))
    rows = _t(spark, sf_dir, "events").select(F.concat(F.lit("f"), _s("user_id")).alias("fn_id"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("channel"), F.concat(F.lit("E"), (F.col("event_id") % 3).cast("string")).alias("error_type"))
    return effects.delivered(rows).distinct()


@query("select 'd' || s_suppkey as fn_id, 'r' || s_suppkey as runtime_id, 'r' || p.p_partkey as dst from supplier join part p on p.p_size = s_suppkey % 50 where s_suppkey % 2 = 0")
def runtime_edges(spark, sf_dir):
    """Only explicitly paired functions have runtime edges, whatever their names."""
    key = _s("s_suppkey")
    rows = _t(spark, sf_dir, "supplier")
    declared = rows.select(F.concat(F.lit("d"), key).alias("fn_id"))
    paired = rows.where("s_suppkey % 2 = 0").select(F.concat(F.lit("d"), key).alias("declared_id"), F.concat(F.lit("r"), key).alias("runtime_id"))
    edges = rows.join(_t(spark, sf_dir, "part"), F.col("p_size") == F.col("s_suppkey") % 50).select(F.concat(F.lit("r"), key).alias("src"), F.concat(F.lit("r"), _s("p_partkey")).alias("dst"))
    return effects.runtime_edges(declared, paired, edges)


@query(_NATIVE + """, x as (select p_partkey as k, case when p_partkey % 2 = 0 then 'cpp' else 'js' end as kind, 'P' || (p_size % 5) as payload, p_size % 2 = 0 as caught from part)
select 'f' || r.k as name, 'void (int)' as signature, kind, payload as payload_symbols from r join x on x.k = r.k""")
def native_findings(spark, sf_dir):
    """Candidates of the reached functions; a throw that is caught stays one."""
    functions, edges, last = _native(spark, sf_dir)
    part = _t(spark, sf_dir, "part")
    raises = part.select(F.concat(F.lit("f"), _s("p_partkey")).alias("name"), F.lit("void (int)").alias("signature"), F.when(F.col("p_partkey") % 2 == 0, "cpp").otherwise("js").alias("kind"), F.concat(F.lit("P"), (F.col("p_size") % 5).cast("string")).alias("payload"), (F.col("p_size") % 2 == 0).alias("caught"))
    inside = native.reached(functions, edges, native.entry(functions, f"f{last}"))
    return native.findings(inside, raises).select("name", "signature", "kind", F.array_join("payload_symbols", ",").alias("payload_symbols"))


_RUN = "strftime(o_orderdate, '%Y-%m-%d') || '-' || case o_orderkey % 5 when 0 then 'all' when 1 then 'ts' when 2 then 'node24' when 3 then 'web' else 'node' end || case when o_orderkey % 3 = 0 then '-' else '-batch-' end || lpad((o_orderkey % 10000)::varchar, 4, '0') || case when o_orderkey % 2 = 0 then '.md' else '.json' end"


@query(f"select {_RUN} as name, o_orderkey % 5 < 3 and o_orderkey % 3 <> 0 as is_run from orders")
def run_records(spark, sf_dir):
    k = F.col("o_orderkey")
    scope = F.element_at(F.array(*map(F.lit, ["all", "ts", "node24", "web", "node"])), (k % 5 + 1).cast("int"))
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), scope, F.when(k % 3 == 0, "-").otherwise("-batch-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 2 == 0, ".md").otherwise(".json"))
    return _t(spark, sf_dir, "orders").select(name.alias("name"), audit.is_run_record(name).alias("is_run"))


@query("select r_name, i::int as index, 'l' || r_regionkey || i as id, 'onLanguage:l' || r_regionkey || i as event from region, (values (0), (1), (2)) as x(i)")
def packaged_entries(spark, sf_dir):
    ids = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.struct(F.concat(F.lit("l"), _s("r_regionkey"), i.cast("string")).alias("id")))
    rows = _t(spark, sf_dir, "region").select("r_name", F.to_json(ids).alias("json"))
    return rows.select("r_name", audit.packaged_columns()).select("r_name", "index", F.col("entry.id").alias("id"), F.concat(F.lit("onLanguage:"), "entry.id").alias("event"))


@query("select doc_id, (doc_id % 7)::int as width from documents where text is not null")
def indented_lines(spark, sf_dir):
    """The white space at the start of the line that a byte offset stands in."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    pad = F.repeat(F.lit(" "), (F.col("doc_id") % 7).cast("int"))
    head = F.concat("text", F.lit("\n"), pad)
    return docs.select("doc_id", F.length(text.indentation(F.concat(head, F.lit("x y")), F.octet_length(head) + 2)).alias("width"))


@query("""select 'n' || n_nationkey as file, sha256('import { describe, it } from "vitest";' || chr(10) || chr(10) || 'describe("L' || n_nationkey || '", () => {' || chr(10) ||
  '  describe("keep", () => {' || chr(10) || '    const t = `a' || chr(10) || ' b`; // ' || n_name || chr(10) || '  });' || chr(10) || chr(10) ||
  '  describe("more", () => {' || chr(10) || '    it("TODO", () => {' || chr(10) || '      // TODO' || chr(10) || '    });' || chr(10) || '  });' || chr(10) || '});' || chr(10)) as text_sha256 from nation""")
def library_sync(spark, sf_dir):
    """Flat files taken into a library's suite: one suite kept, one removed, one added."""
    rows = _nation(spark, sf_dir)
    body = F.concat(F.lit('import { describe, it } from "vitest";\n\ndescribe("keep", () => {\n  const t = `a\n b`; // '), "n_name", F.lit('\n});\n\ndescribe("gone", () => {});\n'))
    texts = rows.select(F.col("n").alias("file"), body.alias("text"), F.concat(F.lit("L"), _s("n_nationkey")).alias("library"))
    named = lambda *names: texts.select("file", F.explode(F.array(*[F.array(F.lit(x)) for x in names])).alias("path"), F.lit(True).alias("callable"))
    return suites.synchronised(texts, named("keep", "gone"), named("keep", "more"), "library").select("file", _sha("text"))


@query("""select 'n' || n_nationkey as file, sha256('describe("own", () => {});' || e || 'describe("keep", () => { it("' || n_name || '", () => {}); });' || e || e || 'describe("more", () => {' || e || '  it("TODO", () => {' || e || '    // TODO' || e || '  });' || e || '});' || e) as text_sha256
from (select *, case when n_nationkey % 2 = 0 then chr(13) || chr(10) else chr(10) end as e from nation)""")
def kept_sync(spark, sf_dir):
    """Files with either kind of newline: foreign and managed suites stay byte for byte, the removed one goes."""
    head = F.lit('import { describe, it } from "vitest";\n')
    body = F.concat(F.lit('describe("own", () => {});\ndescribe("keep", () => { it("'), "n_name", F.lit('", () => {}); });\ndescribe("gone", () => {});\n'))
    whole = F.concat(head, body)
    texts = _nation(spark, sf_dir).select(F.col("n").alias("file"), F.when(F.col("n_nationkey") % 2 == 0, F.replace(whole, F.lit("\n"), F.lit("\r\n"))).otherwise(whole).alias("text"))
    named = lambda *names: texts.select("file", F.explode(F.array(*[F.array(F.lit(x)) for x in names])).alias("path"), F.lit(True).alias("callable"))
    done = suites.synchronised(texts, named("keep", "gone"), named("keep", "more"))
    return done.select("file", F.regexp_replace("text", r"^import[^\n]*\n", "").alias("text")).select("file", _sha("text"))
