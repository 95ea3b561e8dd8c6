"""Stable keyset pages over pending callables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import evidence_names
from ..functions.text import line_at

KINDS = ("ts", "node")


def named(callables: DataFrame, node_version: str = "24") -> DataFrame:
    """callables(kind, lib, file, path) with key, name, node_version (null for ts), id and evidence_file. Both begin with the
    kind, and the runtime's major version for node, so equal file names of two kinds stay apart."""
    rows = evidence_names(callables)
    node = F.col("kind") == "node"
    prefix = F.when(node, F.lit(f"node/{node_version}")).otherwise(F.col("kind"))
    return rows.withColumns({
        "node_version": F.when(node, F.lit(node_version)),
        "id": F.concat(prefix, F.lit("/"), "file", F.lit("::"), "key"),
        "evidence_file": F.concat(prefix, F.lit("/"), "lib", F.lit("/"), "name", F.lit(".md")),
        "test_file": F.concat(prefix, F.lit("/"), "file"),
    })


def page(
    callables: DataFrame, suites: DataFrame, limit: int, *, kind: str | None = None, lib: str | None = None, after: str | None = None,
    texts: DataFrame | None = None, strict: bool = True, node_version: str = "24", root: str = "",
) -> DataFrame:
    """The first `limit` pending callables after the id `after`, by id: id, kind, lib, node_version, test_file (under root),
    describe_path, pending (the leaf's offset), line (with texts) and evidence_file.

    suites(file, path, pending) has the existing suites, pending null where nothing is left to do. texts(file, text) are the
    test files. Names are made from all callables of a file, pending or not, so they do not change as work proceeds; the
    cursor need not be pending itself. A callable without a suite fails the query if it comes before the page is full;
    strict=False passes it over.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if not re.fullmatch("[0-9]+", node_version):
        raise ValueError("the node version must be a major number")
    rows = callables
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if lib is not None:
        rows = rows.where(F.col("lib") == lib)
    rows = named(rows, node_version)
    if after is not None:
        rows = rows.where(F.col("id") > after)
    lost = F.col("there").isNull()
    rows = rows.join(suites.select("file", "path", "pending", F.lit(True).alias("there")), ["file", "path"], "left")
    rows = rows.where(F.col("pending").isNotNull() | lost if strict else F.col("pending").isNotNull())
    # of the first rows that are pending or lost, a lost one comes before the page is full
    rows = rows.orderBy("id").limit(limit)
    if strict:
        rows = rows.withColumn("id", F.when(lost, F.raise_error(F.concat(F.lit("managed suite is missing: "), "id")).cast("string")).otherwise(F.col("id")))
    names = ["id", "kind", "lib", "node_version", F.concat(F.lit(f"{root}/" if root else ""), "test_file").alias("test_file"), F.col("path").alias("describe_path"), "pending", "evidence_file", "name"]
    if texts is None:
        return rows.select(*names).orderBy("id")
    line = line_at(F.col("text"), F.col("pending")).alias("line")
    return rows.join(texts.select("file", "text"), "file").select(*names, line).orderBy("id")
