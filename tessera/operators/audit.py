"""Audit ledgers: rollups of evidence, run records, changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of run records, as documented (fixed value).
RUN = r"^\d{4}-\d{2}-\d{2}-(all|ts|node[0-9]+)-batch-[0-9]{4}\.(json|md)$"


def rollup(evidence: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many were attempted, accepted (complete) and blocked, per scope if asked."""
    status = F.lower(F.trim("status"))
    return evidence.groupBy(*(by or [])).agg(F.count("*").alias("attempted"), F.count_if(status == "complete").alias("accepted"), F.count_if(status == "blocked").alias("blocked"))


def is_run_record(name: Column) -> Column:
    return name.rlike(RUN)


def unions(mechanisms: DataFrame) -> DataFrame:
    """Each evidence's error union by channel, from mechanisms(id, channel, outcome)."""
    return mechanisms.groupBy("id", "channel").agg(F.array_join(F.array_sort(F.collect_set("outcome")), " | ").alias("errors"))


def changelog(commits: DataFrame, tag: str = "bin") -> DataFrame:
    """commits(time, message) that start with [tag], by the label after it, oldest first."""
    mine = commits.where(F.col("message").startswith(f"[{tag}]"))
    body = F.trim(F.substring("message", len(tag) + 3, 1 << 30))
    label = F.when(F.contains(body, F.lit(":")), F.trim(F.substring_index(body, ":", 1))).otherwise(F.lit("other"))
    rows = mine.select(label.alias("label"), F.struct("time", F.when(F.contains(body, F.lit(":")), F.trim(F.regexp_replace(body, "^[^:]*:", ""))).otherwise(body).alias("text")).alias("entry"))
    return rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["text"]).alias("entries"))


def packaged_columns() -> Column:
    """index and entry of each object with id in the JSON array `json`."""
    return F.posexplode(F.from_json("json", "array<struct<id:string>>")).alias("index", "entry")


def packaged(entries: DataFrame, prefix: str = "onLanguage:") -> DataFrame:
    """entries(json: an array of objects with id) as rows of position, id and the prefixed id."""
    return entries.select(packaged_columns()).select("index", F.col("entry.id").alias("id"), F.concat(F.lit(prefix), "entry.id").alias("event"))
