"""Interval edits of texts. Starts and ends are UTF-8 byte offsets, ends exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import opening


def overlaps(edits: DataFrame, key: str = "file") -> DataFrame:
    """Edits that begin before the edit ahead of them in their file ends."""
    order = Window.partitionBy(key).orderBy("start", "end")
    return edits.withColumn("ahead", F.lag("end").over(order)).where("ahead > start")


def gaps(siblings: DataFrame, key: list[str], text_between: str = "between") -> DataFrame:
    """siblings(..., start, end, between: the text up to the next one) with `lines`: how many newlines must be put after
    each so that neighbours parted by white space alone have a blank line between them."""
    following = F.lead("start").over(Window.partitionBy(*key).orderBy("start", "end"))
    blank = F.trim(F.regexp_replace(text_between, r"\s+", " ")) == ""
    have = F.length(text_between) - F.length(F.replace(text_between, F.lit("\n"), F.lit("")))
    return siblings.withColumn("next", following).withColumn("lines", F.when(F.col("next").isNotNull() & blank, F.greatest(2 - have, F.lit(0))).otherwise(0))


def apply(texts: DataFrame, edits: DataFrame, key: str = "file") -> DataFrame:
    """texts(key, text) after non-overlapping edits(key, start, end, text); overlapping ones fail the query. The parts
    between edits are cut from the bytes, so the rest stays as it was."""
    wanted = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("text").alias("put")))).alias("edits"))
    whole = F.encode("text", "UTF-8")
    piece = lambda a, b: F.decode(F.substring(F.col("raw"), a.cast("int") + 1, (b - a).cast("int")), "UTF-8")
    kind = "array<struct<start:bigint,end:bigint,put:string>>"
    rows = texts.join(wanted, key, "left").withColumn("raw", whole).withColumn("edits", F.coalesce(F.col("edits").cast(kind), F.array().cast(kind)))
    before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("edits", i - 1)["end"])
    bad = F.exists(F.transform("edits", lambda e, i: e["start"] < before(i)), lambda x: x)
    parts = F.transform("edits", lambda e, i: F.concat(piece(before(i), e["start"]), e["put"]))
    last = F.coalesce(F.get("edits", F.size("edits") - 1)["end"], F.lit(0).cast("bigint"))
    out = F.concat(F.array_join(parts, ""), piece(last, F.length("raw").cast("bigint")))
    return rows.withColumn("text", F.when(bad, F.raise_error(F.lit("overlapping edits")).cast("string")).otherwise(out)).drop("edits", "raw")


def render(nodes: DataFrame, unit: str = "  ") -> DataFrame:
    """Each file's tree of nodes(file, path, callable) as nested suites, with a TODO leaf in each callable, closing lines after
    the last node below, nodes in path order."""
    depth = F.size("path") - 1
    at = F.transform("path", lambda p: F.concat(p, F.lit("\u0000")))
    row = lambda at, side, text: F.struct(at.alias("at"), F.lit(side).alias("side"), text.alias("text")).alias("row")
    pad = F.repeat(F.lit(unit), depth)
    leaf = F.concat(pad, F.lit(f'{unit}it("TODO", () => {{\n'), pad, F.lit(f"{unit}{unit}// TODO\n"), pad, F.lit(f"{unit}}});"))
    opened = nodes.select("file", row(at, 0, opening(F.element_at("path", -1), depth, unit)))
    todo = nodes.where("callable").select("file", row(at, 1, leaf))
    closed = nodes.select("file", row(F.concat(at, F.array(F.lit("\U0010ffff"))), 2, F.concat(pad, F.lit("});"))))
    rows = opened.unionByName(todo).unionByName(closed)
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["text"]), "\n").alias("text"))
