"""A whole synchronisation: declarations to inventory, inventory and test files to planned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import library_name
from ..operators import queue, snapshot
from ..sources import declarations, manifest, suites


def generate(files: DataFrame, tests: DataFrame, previous: DataFrame, *, node: bool = False) -> dict[str, DataFrame]:
    """files(file, text) are declarations, tests(file, text) the present test files, previous(file, path, callable) the last
    inventory. Returns the new inventory, the writes that are due, and the report of file counts. Everything is computed
    before anything is written; a file of either inventory that cannot be read fails the whole."""
    desired = declarations.declared(declarations.parse(files, node))
    # a file without callables still gets its placeholder
    wanted = files.select("file").unionByName(previous.select("file")).distinct()
    texts = manifest.optional_texts(wanted, tests)
    library = F.lit(None).cast("string") if node else library_name(F.regexp_replace("file", r"\.test\.ts$", ""))
    # each text rides along with its file, its library's name beside it
    texts = texts.withColumn("library", library)
    every = texts.select("file").join(desired, "file", "left").select("file", F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.coalesce("callable", F.lit(False)).alias("callable"))
    made = suites.synchronised(texts, previous, every, "library")
    return {"inventory": desired, "writes": manifest.plan(made, tests), "report": snapshot.report(made, tests)}


def pending(inventory: DataFrame, tests: DataFrame, kind: str, limit: int, after: str | None = None, node_version: str = "24") -> DataFrame:
    """A page of the pending queue of one inventory and its test files."""
    stem = F.regexp_replace("file", r"\.test\.ts$", "")
    path = F.concat(F.array(library_name(stem)), F.col("path")) if kind == "ts" else F.col("path")
    rows = inventory.where("callable").select(F.lit(kind).alias("kind"), stem.alias("lib"), "file", path.alias("path"))
    roots = rows.select("file", F.slice("path", 1, 1).alias("path"))
    found = suites.read_suites(tests, rows.select("file", "path").unionByName(roots).distinct())
    return queue.page(rows, found, limit, kind=kind, after=after, texts=tests, node_version=node_version)


def read_and_generate(spark: SparkSession, root: str, tests: DataFrame, previous: DataFrame, *, node: bool = False) -> dict[str, DataFrame]:
    return generate(declarations.read(spark, root, node), tests, previous, node=node)
