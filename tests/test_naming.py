from pyspark.sql import functions as F

from tessera.functions import naming, text

CLUSTER = ["node:cluster", "Cluster", "addListener"]


def test_collisions_take_the_hash_of_their_key(spark):
    rows = spark.createDataFrame(
        [("node", "f", CLUSTER), ("node", "f", ["node:cluster", "cluster", "addListener"]), ("node", "f", ["node:fs/promises", "open"]), ("ts", "g", ["ES2015.Reflect", "Reflect", "apply"]), ("node", "h", ["."]), ("node", "h", ["x" * 200])],
        "kind string, file string, path array<string>",
    )
    got = {r["key"]: r["name"] for r in naming.evidence_names(rows).collect()}
    assert got['["node:cluster","Cluster","addListener"]'] == "node%3Acluster#cluster#addlistener~422e4295832982d0"
    assert got['["node:cluster","cluster","addListener"]'] == "node%3Acluster#cluster#addlistener~a3b78520b741aaf0"
    assert got['["node:fs/promises","open"]'] == "node%3Afs%2Fpromises#open"
    assert got['["ES2015.Reflect","Reflect","apply"]'] == "reflect#apply"
    assert got['["."]'].startswith(".~")
    long = next(v for k, v in got.items() if "xxx" in k)
    assert len(long) == 180 + 17


def test_names(spark):
    one = spark.range(1)
    names = {"es2015.reflect": "ES2015.Reflect", "es2020.bigint": "ES2020.BigInt", "dom.asynciterable": "DOM.AsyncIterable", "webworker.importscripts": "WebWorker.ImportScripts", "decorators": "Decorators"}
    for stem, wanted in names.items():
        assert one.select(naming.library_name(F.lit(stem))).first()[0] == wanted
    assert one.select(naming.test_file(F.lit("sub\\lib.es5.d.ts"), False)).first()[0] == "sub/es5.test.ts"
    assert one.select(naming.member_key(F.lit("Symbol . iterator"), F.lit(True))).first()[0] == "[Symbol.iterator]"


def test_lines_count_bytes(spark):
    row = spark.createDataFrame([("é🦀\nb\nc",)], "t string")
    assert row.select(text.line_at(F.col("t"), F.lit(7))).first()[0] == 2
    assert row.select(text.line_at(F.col("t"), F.lit(0))).first()[0] == 1
    assert row.select(text.unused_name(F.lit("a v a v_"), "v")).first()[0] == "v__"
    assert row.select(text.indentation(F.lit("a\n\t  b"), F.lit(5))).first()[0] == "\t  "
