"""Three-way differences of suite trees, and the files and texts that change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inventory import prefixes

KEY = ["file", "path"]


def diff(previous: DataFrame, desired: DataFrame, existing: DataFrame) -> DataFrame:
    """file, path and action of each node of the three: delete (no longer desired, exists), keep, add, or ignore (in
    neither manifest, or gone anyway)."""
    mark = lambda df, name: df.select(*KEY).distinct().withColumn(name, F.lit(True))
    rows = mark(previous, "p").join(mark(desired, "d"), KEY, "full").join(mark(existing, "e"), KEY, "full")
    action = F.when(F.col("d") & F.col("e"), "keep").when(F.col("d"), "add").when(F.col("p") & F.col("e"), "delete").otherwise("ignore")
    return rows.select(*KEY, action.alias("action"))


def topmost(actions: DataFrame) -> DataFrame:
    """Of added and deleted nodes, those with no added or deleted node above."""
    changed = actions.where(F.col("action").isin("add", "delete"))
    above = changed.withColumn("up", F.explode(prefixes(F.col("path")))).where(F.size("up") < F.size("path"))
    covered = above.join(changed.select("file", F.col("path").alias("up")), ["file", "up"]).select(*KEY).distinct()
    return changed.join(covered, KEY, "left_anti")


def adopted(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Desired nodes that stand already: kept as they are, even empty."""
    return desired.join(existing.select(*KEY), KEY, "left_semi")


def retired_files(previous: DataFrame, desired: DataFrame) -> DataFrame:
    """Every file of either manifest with whether it is still desired."""
    p, d = previous.select("file").distinct().withColumn("p", F.lit(True)), desired.select("file").distinct().withColumn("d", F.lit(True))
    return p.join(d, "file", "full").select("file", F.col("d").isNull().alias("retired"))


def managed(suites: DataFrame, previous: DataFrame, desired: DataFrame) -> DataFrame:
    """Suites that a manifest names; others are not the generator's."""
    names = previous.select(*KEY).unionByName(desired.select(*KEY)).distinct()
    return suites.join(names, KEY, "left_semi")


def changed(generated: DataFrame, current: DataFrame) -> DataFrame:
    """file and text of generated(file, text) that differ from current(file, text); a missing file is a change."""
    now = current.select("file", F.col("text").alias("now"))
    return generated.join(now, "file", "left").where(~F.col("text").eqNullSafe(F.col("now"))).drop("now")


def report(generated: DataFrame, current: DataFrame) -> DataFrame:
    """How many files there are and how many change."""
    marks = changed(generated, current).select("file").withColumn("c", F.lit(1))
    return generated.join(marks, "file", "left").agg(F.count("*").alias("files"), F.count("c").alias("changed"))
