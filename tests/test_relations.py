import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, edits, effects, native, queue, snapshot
from tessera.plans.generate import generate, pending


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def nodes(spark, paths):
    return frame(spark, [("f", p.split("/"), True) for p in paths], "file string, path array<string>, callable boolean")


def test_diff_yields_only_the_topmost(spark):
    acts = snapshot.diff(nodes(spark, ["a", "a/x", "b", "d"]), nodes(spark, ["a", "c", "c/y"]), nodes(spark, ["a", "a/x", "b", "own"]))
    got = {"/".join(r["path"]): r["action"] for r in acts.collect()}
    assert got == {"a": "keep", "a/x": "delete", "b": "delete", "c": "add", "c/y": "add", "d": "ignore", "own": "ignore"}
    assert {"/".join(r["path"]) for r in snapshot.topmost(acts).collect()} == {"a/x", "b", "c"}


def test_edits(spark):
    texts = frame(spark, [("f", "héllo wörld"), ("g", "same")], "file string, text string")
    put = frame(spark, [("f", 0, 0, ">"), ("f", 7, 13, "x"), ("f", 13, 13, "!")], "file string, start long, end long, text string")
    assert {r["file"]: r["text"] for r in edits.apply(texts, put).collect()} == {"f": ">héllo x!", "g": "same"}
    bad = put.unionByName(frame(spark, [("f", 8, 9, "")], "file string, start long, end long, text string"))
    assert edits.overlaps(bad).count() == 1
    with pytest.raises(Exception, match="overlapping"):
        edits.apply(texts, bad).collect()


def test_pages_are_stable(spark):
    rows = frame(spark, [("node", "fs", "fs.test.ts", ["node:fs", n]) for n in "abcde"], "kind string, lib string, file string, path array<string>")
    suites = frame(spark, [("fs.test.ts", ["node:fs", n], None if n == "b" else i) for i, n in enumerate("abcde")], "file string, path array<string>, pending long")
    path = lambda page: [r["describe_path"][1] for r in page.collect()]
    first = queue.page(rows, suites, 2).collect()
    assert [r["describe_path"][1] for r in first] == ["a", "c"]
    assert path(queue.page(rows, suites, 9, after=first[-1]["id"])) == ["d", "e"]
    done = suites.withColumn("pending", F.when(F.col("path")[1] != "a", F.col("pending")))
    assert path(queue.page(rows, done, 1, after=first[0]["id"])) == ["c"]
    assert first[0]["id"] == 'node/24/fs.test.ts::["node:fs","a"]' and first[0]["evidence_file"] == "node/24/fs/node%3Afs#a.md"
    assert (first[0]["node_version"], first[0]["test_file"]) == ("24", "node/24/fs.test.ts")
    ts = queue.page(rows.withColumn("kind", F.lit("ts")), suites, 1, root="/out").first()
    assert (ts["id"], ts["node_version"], ts["test_file"]) == ('ts/fs.test.ts::["node:fs","a"]', None, "/out/ts/fs.test.ts")
    for wrong in ({"limit": 0}, {"limit": -1}, {"limit": 1, "kind": "web"}, {"limit": 1, "node_version": "v24"}):
        with pytest.raises(ValueError, match="limit|kind|major"):
            queue.page(rows, suites, **wrong)
    # d has no suite: an error where the page reaches it, and only there
    fewer = suites.where("pending is null or pending <> 3")
    assert path(queue.page(rows, fewer, 2)) == ["a", "c"] and path(queue.page(rows, fewer, 9, after='node/24/fs.test.ts::["node:fs","d"]')) == ["e"]
    with pytest.raises(Exception, match="missing"):
        queue.page(rows, fewer, 3).collect()
    assert path(queue.page(rows, fewer, 9, strict=False)) == ["a", "c", "e"]


FN = "fn_id string, is_async boolean, user_written boolean"
SITE = "site_id string, fn_id string, kind string, callee string, error_type string, awaited boolean, returned boolean, consumed boolean, region_id string"
REGION = "region_id string, parent_id string, fn_id string, kind string"


def test_effects(spark):
    fns = frame(spark, [(n, n.startswith("a"), True) for n in ("raise", "araise", "safe", "await", "loose", "ret", "rec1", "rec2", "lib", "tryloose", "tryunknown", "<root>")], FN)
    sites = frame(
        spark,
        [
            ("1", "raise", "throw", None, "Error", False, False, False, None),
            ("2", "araise", "throw", None, "E2", False, False, False, None),
            ("3", "safe", "call", "raise", None, False, False, False, "inner"),
            ("4", "await", "call", "araise", None, True, False, False, None),
            ("5", "loose", "call", "araise", None, False, False, False, None),
            ("6", "ret", "call", "araise", None, False, True, False, None),
            ("7", "rec1", "call", "rec2", None, False, False, False, None),
            ("8", "rec2", "call", "rec1", None, False, False, False, None),
            ("9", "rec2", "call", "raise", None, False, False, False, None),
            ("10", "lib", "call", "JSON.parse", None, False, False, False, None),
            ("11", "lib", "call", "mystery", None, False, False, False, None),
            ("12", "tryloose", "call", "araise", None, False, True, False, "inner2"),
            ("13", "<root>", "call", "raise", None, False, False, False, None),
            ("14", "tryunknown", "call", "mystery", None, False, True, False, "inner2"),
        ],
        SITE,
    )
    regions = frame(spark, [("t", None, "safe", "try"), ("inner", "t", "safe", "body"), ("inner2", None, "tryloose", "try")], REGION)
    models = frame(spark, [("JSON.parse", "throws", "SyntaxError")], "callee string, channel string, error_type string")
    found = effects.infer(fns, sites, regions, models)
    got = {}
    for r in found.collect():
        got.setdefault(r["fn_id"], set()).add((r["channel"], r["error_type"]))
    assert got == {
        "raise": {("throws", "Error")}, "araise": {("rejects", "E2")}, "await": {("rejects", "E2")}, "ret": {("rejects", "E2")},
        "rec1": {("throws", "Error")}, "rec2": {("throws", "Error")}, "lib": {("throws", "SyntaxError"), ("throws", "unknown")},
        "tryloose": {("rejects", "E2")}, "tryunknown": {("rejects", "unknown")}, "<root>": {("throws", "Error")},
    }
    assert [r["site_id"] for r in effects.unhandled_promises(found, sites).collect()] == ["5"]
    contracts = frame(spark, [("raise", "Error"), ("rec1", "Other"), ("safe", None)], "fn_id string, error_type string")
    assert {tuple(r)[:3] for r in effects.contract_check(found, contracts).collect()} == {("rec1", "Error", "missing"), ("rec1", "Other", "extra")}
    assert {r["fn_id"] for r in effects.implicit_contracts(found, fns, contracts).collect()} == {"araise", "await", "ret", "rec2", "lib", "tryloose", "tryunknown", "<root>"}
    assert effects.unhandled_root(found).count() == 1


def test_chains_and_narrowing(spark):
    sites = frame(spark, [("1", "f", "call", "g", None, False, False, None)], "site_id string, fn_id string, kind string, callee string, error_type string, awaited boolean, returned boolean, region_id string")
    steps = frame(spark, [("1", 1, "then", "A"), ("1", 2, "catch", "B"), ("1", 3, "then", "C")], "site_id string, step int, kind string, error_type string")
    assert effects.chains(sites, steps).first()["consumed"]
    assert {r["raised"] for r in effects.handlers(steps).collect()} == {"B", "C"}
    ended = steps.unionByName(frame(spark, [("1", 4, "finally", "D")], steps.schema))
    assert {r["raised"] for r in effects.handlers(ended).collect()} == {"D"}
    bound = frame(spark, [("r", t) for t in ("Custom", "Error", '"NOPE"')], "region_id string, error_type string")
    tests = frame(spark, [("r", 1, "Custom"), ("r", 2, "Error")], "region_id string, branch int, type string")
    got = {r["error_type"]: r["branch"] for r in effects.narrow(bound, tests, frame(spark, [("Custom", "Error")], "sub string, super string")).collect()}
    assert got == {"Custom": 1, "Error": 2, '"NOPE"': None}


def test_native(spark):
    functions = frame(spark, [("node::f", "void (int)", True), ("node::f", "void (double)", True), ("node::entry", "void ()", True)], "name string, signature string, defined boolean")
    edges = frame(spark, [("node::entry", "void ()", "node::f", "void (int)", "call"), ("node::f", "void (int)", "node::f", "void (int)", "call"), ("node::f", "void (int)", "v8::Throw", "void (int)", "call"), ("node::f", "void (int)", "", "", "lambda")], "caller string, caller_signature string, callee string, signature string, kind string")
    raises = frame(spark, [("node::f", "void (double)", "cpp", None)], "name string, signature string, kind string, payload string")
    report = native.report("node::entry", functions, edges, raises)
    assert report["functions"].count() == 2 and report["findings"].count() == 0 and not report["sound"]
    assert {r["signature"] for r in report["edges"].collect()} == {"void (int)"}
    assert {r["operation"] for r in report["unresolved"].collect()} == {"v8::Throw", "lambda"}
    with pytest.raises(ValueError, match="several"):
        native.entry(functions, "node::f")
    assert native.roots('{"a":1}\n[2] 3') == [{"a": 1}, [2], 3]


def test_audit(spark):
    rows = frame(spark, [("complete",), (" Blocked",), ("complete",)], "status string")
    assert tuple(audit.rollup(rows).first()) == (3, 2, 1)
    names = {"2026-10-29-all-batch-0001.md": True, "2026-10-29-node24-batch-0012.json": True, "notes.md": False, "2026-10-29-web-batch-0001.md": False, "2026-10-29-all-0001.md": False, "2026-10-29-ts-batch-1.md": False}
    assert {r[0]: r[1] for r in frame(spark, [(n,) for n in names], "n string").select("n", audit.is_run_record(F.col("n"))).collect()} == names
    packed = audit.packaged(frame(spark, [('[{"id":"ts"},{"id":"js"}]',)], "json string")).collect()
    assert [tuple(r) for r in packed] == [(0, "ts", "onLanguage:ts"), (1, "js", "onLanguage:js")]


def test_whole_synchronisation_is_idempotent(spark):
    files = frame(spark, [("es5.test.ts", "interface A { f(): void; g(): void }"), ("refs.test.ts", "interface Data { n: number }")], "file string, text string")
    none = frame(spark, [], "file string, text string")
    first = generate(files, none, frame(spark, [], "file string, path array<string>, callable boolean"))
    written = frame(spark, [tuple(r) for r in first["writes"].collect()], "file string, text string")
    assert written.count() == 2 and tuple(first["report"].first()) == (2, 2)
    inventory = frame(spark, [tuple(r) for r in first["inventory"].collect()], "file string, path array<string>, callable boolean")
    assert generate(files, written, inventory)["writes"].count() == 0
    page = pending(inventory, written, "ts", 5).collect()
    assert [r["describe_path"] for r in page] == [["ES5", "A", "f"], ["ES5", "A", "g"]] and page[0]["line"] == 7
