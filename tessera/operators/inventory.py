"""Declaration inventories as one row per node: file, path, callable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import reachable

HIDDEN = ("private", "protected", "#")


def member_paths(members: DataFrame) -> DataFrame:
    """file, path and callable of declared members(file, scope, owner, member, kind, visibility, is_static): methods and
    function-typed properties by name, accessors as 'get x' and 'set x', constructors and construct signatures as 'new',
    call signatures as the owner itself; static members prefixed; hidden ones and 'prototype' left out."""
    static = F.when(F.col("is_static"), F.lit("static ")).otherwise(F.lit(""))
    name = (
        F.when(F.col("kind").isin("constructor", "construct"), F.lit("new"))
        .when(F.col("kind").isin("get", "set"), F.concat(static, F.col("kind"), F.lit(" "), F.col("member")))
        .otherwise(F.concat(static, F.col("member")))
    )
    owner = F.when(F.col("owner").isNull(), F.col("scope")).otherwise(F.concat("scope", F.split("owner", r"\.")))
    visible = F.coalesce(~F.col("visibility").isin(*HIDDEN), F.lit(True)) & F.coalesce(F.col("member") != "prototype", F.lit(True))
    path = F.when(F.col("kind") == "call", owner).otherwise(F.concat(owner, F.array(name)))
    return members.where(visible).select("file", path.alias("path"), (F.col("kind") != "data").alias("callable"))


def merge(nodes: DataFrame) -> DataFrame:
    """Equal nodes (overloads, merged declarations) as one, callable if any is."""
    return nodes.groupBy("file", "path").agg(F.bool_or("callable").alias("callable"))


def prefixes(path: Column, least: int = 1) -> Column:
    """Every beginning of a path, itself included."""
    return F.when(F.size(path) >= least, F.transform(F.sequence(F.lit(least), F.size(path)), lambda k: F.slice(path, 1, k))).otherwise(F.array().cast("array<array<string>>"))


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """The merged nodes and all nodes above them."""
    rows = nodes.withColumn("up", F.explode(prefixes(F.col("path"))))
    return rows.groupBy("file", F.col("up").alias("path")).agg(F.bool_or(F.col("callable") & (F.size("up") == F.size("path"))).alias("callable"))


def prune(nodes: DataFrame) -> DataFrame:
    """Only callable nodes and those above them."""
    return with_ancestors(nodes.where("callable"))


def resolve(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """references(file, path, scope, target, ...) with `resolved`: the target under the innermost scope that declares it
    (null: nowhere). The depth is chosen before anything else is joined, so an empty shape still wins."""
    key = [F.coalesce(F.col(c).cast("string") if dict(references.dtypes)[c] != "array<string>" else F.to_json(c), F.lit("")) for c in references.columns]
    ref = F.md5(F.to_json(F.array(*key)))  # 128 bits
    tried = references.withColumn("ref", ref).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("scope"))))
    tried = tried.withColumn("candidate", F.concat(F.slice("scope", F.lit(1), F.col("depth")), F.col("target")))
    known = nodes.select(F.col("file"), F.col("path").alias("candidate")).distinct()
    hits = tried.join(known, ["file", "candidate"]).groupBy("ref").agg(F.max_by("candidate", "depth").alias("resolved"))
    return references.withColumn("ref", ref).join(hits, "ref", "left").drop("ref")


def expand(references: DataFrame, shapes: DataFrame) -> DataFrame:
    """What references add: references(file, path, scope, target, object) take the shapes(file, path, child, callable) of
    all that their target reaches. Other than for objects, only callable itself and the child 'new' count. Cycles add
    nothing of their own."""
    declared = shapes.select("file", "path").union(references.select("file", "path")).distinct()
    linked = resolve(references, declared).where("resolved is not null")
    key = lambda c: F.concat_ws("\u0000", "file", F.to_json(c))
    edges = linked.select(key("path").alias("src"), key("resolved").alias("dst"))
    pairs = reachable(edges, linked.select(key("resolved").alias("start")))
    found = linked.select("file", "path", "object", key("resolved").alias("src")).join(pairs, "src")
    shape = shapes.select(key("path").alias("dst"), "child", "callable")
    rows = found.join(shape, "dst").where(F.col("object") | F.col("child").isNull() | (F.col("child") == "new"))
    path = F.when(F.col("child").isNull(), F.col("path")).otherwise(F.concat("path", F.array("child")))
    return merge(rows.select("file", path.alias("path"), "callable"))


def callables(nodes: DataFrame) -> DataFrame:
    return nodes.where("callable").select("file", "path", F.to_json("path").alias("key"))


def duplicates(suites: DataFrame) -> DataFrame:
    """Names that stand twice in one scope: an error of the file that has them."""
    return suites.groupBy("file", "path").count().where("count > 1")


def first_pending(leaves: DataFrame) -> DataFrame:
    """The first pending offset of each suite, from direct leaves(file, path, title, offset) titled TODO."""
    return leaves.where(F.col("title") == "TODO").groupBy("file", "path").agg(F.min("offset").alias("pending"))


def in_library(nodes: DataFrame, name: Column) -> DataFrame:
    """Paths below a library's root level."""
    return nodes.withColumn("path", F.concat(F.array(name), F.col("path")))
