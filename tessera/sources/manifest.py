"""Manifests (JSON), their gates, and the plan-then-write sink."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshot import changed

VERSION = 1
SAFE = r"^(?!/)(?!.*(^|/)\.\.(/|$))(?!.*\\).+$"


def check(condition: Column, message: Column | str) -> Column:
    """True, or the query fails."""
    told = message if isinstance(message, Column) else F.lit(message)
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))


def _nodes(files: dict) -> list[tuple[str, list[str], bool]]:
    out = []
    for file, suite in files.items():
        todo = [([], suite)]
        while todo:
            path, node = todo.pop()
            if path:
                out.append((file, path, bool(node.get("callable", False))))
            todo += [([*path, name], child) for name, child in node.get("children", {}).items()]
    return out


def read(manifests: DataFrame) -> DataFrame:
    """kind, source, file, path, callable of manifests(kind, text: JSON). A version other than 1, or a file outside the
    root, fails the query. A null text is an empty manifest."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for kind, text in zip(batch["kind"], batch["text"], strict=True):
                if text is None:
                    continue
                told = json.loads(text)
                rows += [(kind, told["version"], told.get("source", ""), *n) for n in _nodes(told.get("files", {}))]
            yield pd.DataFrame(rows, columns=["kind", "version", "source", "file", "path", "callable"])

    rows = manifests.select("kind", "text").mapInPandas(run, "kind string, version int, source string, file string, path array<string>, callable boolean")
    good = check(F.col("version") == VERSION, "unsupported manifest version") & check_path(F.col("file"))
    return rows.where(good).drop("version")


def write_text(nodes: DataFrame, source: str) -> DataFrame:
    """One row with the manifest of nodes(file, path, callable) as JSON. Each file's tree is made by itself; only their texts
    come together, as they must in one document."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree: dict = {}
        for path, callable_ in sorted(zip(rows["path"], rows["callable"], strict=True), key=lambda r: list(r[0])):
            at = tree
            for part in path:
                at = at.setdefault("children", {}).setdefault(part, {})
            if callable_:
                at["callable"] = True
        body = json.dumps(tree, indent=2, ensure_ascii=False, sort_keys=True).replace("\n", "\n    ")
        return pd.DataFrame({"file": [key[0]], "body": [f"    {json.dumps(key[0], ensure_ascii=False)}: {body}"]})

    each = nodes.groupBy("file").applyInPandas(run, "file string, body string")
    bodies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "body"))), lambda r: r["body"]), ",\n")
    start = '{\n  "files": {\n'
    end = f'\n  }},\n  "source": {json.dumps(source, ensure_ascii=False)},\n  "version": {VERSION}\n}}\n'
    return each.agg(F.concat(F.lit(start), bodies, F.lit(end)).alias("text"))


def package_gate(package: str, major: int, name: str = "@types/node") -> str:
    """The version of a package file's JSON, which must be of the named package and major version."""
    told = json.loads(package)
    if told.get("name") != name:
        raise ValueError(f"expected {name}, found {told.get('name')}")
    if told["version"].split(".")[0] != str(major):
        raise ValueError(f"expected {name} {major}, found {told['version']}")
    return told["version"]


def optional_texts(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted(file) with text, null where the file is not there; a file that is there and cannot be read still fails."""
    return wanted.select("file").distinct().join(present.select("file", "text"), "file", "left")


def plan(generated: DataFrame, current: DataFrame) -> DataFrame:
    """The writes that are due: file and text that differ from what is there."""
    return changed(generated, current)


def below(root: str) -> Column:
    """The part of a file's path below a folder, however its scheme and host are written."""
    return F.substring_index("path", re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/", -1)


def present(spark: SparkSession, root: str, pattern: str = "*.ts") -> DataFrame:
    """file (relative to root) and text of the files of a tree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(below(root).alias("file"), F.decode("content", "UTF-8").alias("text"))


def write(spark: SparkSession, plan: DataFrame, root: str, check: bool = False) -> list[str]:
    """Writes each planned file, after all of them are computed, through Spark's file systems; returns their names in order.
    check only tells them. Texts pass through the driver one at a time: a tree of sources is meant, not a corpus."""
    from ..plans.store import kept

    ready = kept(plan.where(check_path(F.col("file"))).select("file", "text"))
    names = sorted(r["file"] for r in ready.select("file").collect())
    if check:
        return names
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in ready.toLocalIterator():
        path = hadoop.Path(f"{root.rstrip('/')}/{r['file']}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray((r["text"] or "").encode()))
        out.close()
    return names


def check_path(file: Column) -> Column:
    return check(file.rlike(SAFE), F.concat(F.lit("unsafe path "), file))


def page_json(page: DataFrame) -> DataFrame:
    """A result page as one row with a JSON array in the page's order, null fields left out."""
    whole = F.struct(*page.columns)
    ordered = page.select(F.struct(F.monotonically_increasing_id().alias("at"), F.to_json(whole).alias("row")).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"])
    return ordered.agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("json"))
