"""Reachability over native call graphs, exact for overloads, with candidates and unresolved boundaries.

  function(name, signature, defined)
  edge(caller, caller_signature, callee, signature, kind): kind call, external, lambda, indirect, virtual, constructor
  raise(name, signature, kind, payload): kind cpp (a throw) or js (an exception handed to the runtime)
Reports are never complete nor sound: a caught throw stays a candidate, payloads are not traced to their factory, and
methods count by their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import reachable

REASONS = {"external": "No definition is visible", "lambda": "Lambda bodies are not walked eagerly", "indirect": "Indirect call", "virtual": "Virtual dispatch", "constructor": "Constructor invocation"}


def _key(name: str, signature: str) -> Column:
    return F.concat_ws("\u0000", name, signature)


def entry(functions: DataFrame, name: str, signature: str | None = None) -> DataFrame:
    """The entry's row; a name with several signatures needs one, else the query fails."""
    rows = functions.where(F.col("name") == name)
    if signature is not None:
        rows = rows.where(F.col("signature") == signature)
    n = rows.select("name", "signature").distinct().limit(2).count()
    if n != 1:
        raise ValueError(f"{name} has {'several signatures' if n else 'no definition'}")
    return rows.select("name", "signature").distinct()


def reached(functions: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """name and signature of the defined functions that calls reach from the start rows; each overload by itself."""
    calls = edges.where("kind = 'call'").select(_key("caller", "caller_signature").alias("src"), _key("callee", "signature").alias("dst"))
    defined = functions.where("defined").select("name", "signature", _key("name", "signature").alias("dst")).distinct()
    inner = calls.join(defined.select("dst"), "dst", "left_semi")
    return reachable(inner, start.select(_key("name", "signature").alias("src"))).join(defined, "dst").select("name", "signature").distinct()


def findings(functions: DataFrame, raises: DataFrame) -> DataFrame:
    """Candidates of the reached functions: their throws and runtime exceptions, with all payload symbols."""
    rows = raises.join(functions, ["name", "signature"], "left_semi")
    return rows.groupBy("name", "signature", "kind").agg(F.array_sort(F.collect_set("payload")).alias("payload_symbols"))


def unresolved(functions: DataFrame, edges: DataFrame, defined: DataFrame) -> DataFrame:
    """Boundaries of the reached functions: what is called there and not followed, with the reason."""
    here = edges.join(functions.select(F.col("name").alias("caller"), F.col("signature").alias("caller_signature")), ["caller", "caller_signature"], "left_semi")
    known = defined.where("defined").select(F.col("name").alias("callee"), "signature", F.lit(True).alias("known")).distinct()
    rows = here.join(known, ["callee", "signature"], "left").where((F.col("kind") != "call") | F.col("known").isNull())
    kind = F.when(F.col("kind") == "call", F.lit("external")).otherwise(F.col("kind"))
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    operation = F.when(kind == "lambda", "lambda").when(kind == "indirect", "indirect-call").otherwise(F.col("callee"))
    return rows.select("caller", operation.alias("operation"), F.element_at(table, kind).alias("reason")).distinct()


def report(name: str, functions: DataFrame, edges: DataFrame, raises: DataFrame, signature: str | None = None) -> dict[str, DataFrame | bool]:
    start = entry(functions.where("defined"), name, signature)
    inside = reached(functions, edges, start)
    followed = edges.where("kind = 'call'").join(inside.select(F.col("name").alias("caller"), F.col("signature").alias("caller_signature")), ["caller", "caller_signature"], "left_semi").join(inside.select(F.col("name").alias("callee"), "signature"), ["callee", "signature"], "left_semi")
    return {"functions": inside, "edges": followed, "findings": findings(inside, raises), "unresolved": unresolved(inside, edges, functions), "complete": False, "sound": False}


def roots(text: str) -> list:
    """Concatenated JSON documents as one list."""
    import json

    out, at, decode = [], 0, json.JSONDecoder()
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        value, at = decode.raw_decode(text, at)
        out.append(value)
    return out
