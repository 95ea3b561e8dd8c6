"""Which errors can escape each function: set-valued fixed points over call sites, and checks of the results.

Relations
  fn(fn_id, is_async, user_written)
  site(site_id, fn_id, kind, callee, error_type, awaited, returned, region_id): kind throw, call, iterate
  region(region_id, parent_id, fn_id, kind): kind try (has a handler), finally (always ends abruptly), body (neither)
  step(site_id, step, kind, error_type): a promise chain's steps: catch, then (no handler), then2, finally
  contract(fn_id, error_type): a declared error; a row with a null type declares that there is none
  effect(fn_id, channel, error_type): channel throws, rejects or iterates; error type 'unknown' stands for any
No row means no error. Whether a site is handled is settled before the loop, so that the loop only grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import fixpoint, reachable

UNKNOWN = "unknown"
ROOT = "<root>"
#: Diagnostic codes of a broken and of a missing contract (fixed values).
BROKEN, MISSING = 98002, 98003
EFFECT = ["fn_id", "channel", "error_type"]


def handled(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """sites with caught (a region around has a handler, or a finally that always ends abruptly)."""
    up = regions.where("parent_id is not null").select(F.col("region_id").alias("src"), F.col("parent_id").alias("dst"))
    around = reachable(up, regions.select("region_id"))
    guard = regions.where(F.col("kind").isin("try", "finally")).select(F.col("region_id").alias("dst"))
    guarded = around.join(guard, "dst").select(F.col("src").alias("region_id")).distinct().withColumn("guarded", F.lit(True))
    return sites.join(guarded, "region_id", "left").withColumn("caught", F.coalesce("guarded", F.lit(False))).drop("guarded")


#: Steps that take a rejection: handlers, and a finally that throws in its place.
_TAKES = "kind in ('catch', 'then2') or kind = 'finally' and error_type is not null"


def chains(sites: DataFrame, steps: DataFrame) -> DataFrame:
    """sites with consumed: a step of their promise chain handles rejections, or is a finally that throws in their place."""
    ends = steps.where(_TAKES).select("site_id").distinct().withColumn("c", F.lit(True))
    return sites.drop("consumed").join(ends, "site_id", "left").withColumn("consumed", F.coalesce("c", F.lit(False))).drop("c")


def handlers(steps: DataFrame) -> DataFrame:
    """site_id and error_type of what the steps of a chain raise themselves and no later step takes."""
    last = steps.where(_TAKES).groupBy("site_id").agg(F.max("step").alias("last"))
    own = steps.where("error_type is not null").join(last, "site_id", "left").where(F.col("last").isNull() | (F.col("step") >= F.col("last")))
    return own.select("site_id", F.col("error_type").alias("raised")).distinct()


def _raised(sync: Column) -> Column:
    """The channel in which an error leaves a function."""
    return F.when(F.col("is_async"), F.lit("rejects")).otherwise(sync)


def infer(fns: DataFrame, sites: DataFrame, regions: DataFrame, models: DataFrame | None = None, extra: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """The effects of every function. sites need awaited, returned, and consumed unless their chains' steps are given;
    models(callee, channel, error_type) say what functions outside do; calls of what neither has are unknown. extra are
    effects given from elsewhere. What a chain's steps raise leaves with its promise: where that is awaited, or returned."""
    if steps is not None:
        sites = chains(sites, steps)
    marked = handled(sites, regions).join(fns.select("fn_id", "is_async"), "fn_id")
    thrown = marked.where("kind = 'throw' and not caught").select("fn_id", _raised(F.lit("throws")).alias("channel"), "error_type")
    calls = marked.where(F.col("kind").isin("call", "iterate"))

    def carried(callee: DataFrame) -> DataFrame:
        """What a call passes on of its callee's effects: errors thrown, or awaited rejections, unless caught; rejections
        of returned promises unless a handler in the chain takes them, whatever try stands around."""
        of = callee.select(F.col("fn_id").alias("callee"), F.col("channel").alias("of"), "error_type")
        rows = calls.drop("error_type").join(of, "callee")
        free = ~F.col("caught")
        waited = F.col("awaited") & ~F.col("consumed")
        channel = (
            F.when((F.col("kind") == "iterate") & (F.col("of") == "iterates") & free, _raised(F.lit("throws")))
            .when((F.col("of") == "throws") & free, _raised(F.lit("throws")))
            .when((F.col("of") == "rejects") & waited & free, _raised(F.lit("throws")))
            .when((F.col("of") == "rejects") & ~F.col("awaited") & F.col("returned") & ~F.col("consumed"), F.lit("rejects"))
            .when((F.col("of") == "iterates") & F.col("returned"), F.lit("iterates"))
        )
        return rows.select("fn_id", channel.alias("channel"), "error_type").where("channel is not null")

    known = fns.select(F.col("fn_id").alias("callee"))
    base = thrown
    if models is not None:
        base = base.unionByName(carried(models.select(F.col("callee").alias("fn_id"), "channel", "error_type")))
        known = known.unionByName(models.select("callee"))
    foreign = calls.join(known.distinct(), "callee", "left_anti")
    # a returned promise leaves a try around it, so what it may be rejected with is not handled there
    gone = F.col("caught") & ~F.col("awaited") & F.col("returned") & ~F.col("consumed")
    channel = F.when(~F.col("caught"), _raised(F.lit("throws"))).when(gone, F.lit("rejects"))
    base = base.unionByName(foreign.select("fn_id", channel.alias("channel"), F.lit(UNKNOWN).alias("error_type")).where("channel is not null"))
    if steps is not None:
        left = F.when(F.col("awaited") & ~F.col("caught"), _raised(F.lit("throws"))).when(~F.col("awaited") & F.col("returned"), F.lit("rejects"))
        base = base.unionByName(marked.join(handlers(steps), "site_id").select("fn_id", left.alias("channel"), F.col("raised").alias("error_type")).where("channel is not null"))
    if extra is not None:
        base = base.unionByName(extra.select(EFFECT))
    return fixpoint(base.select(EFFECT), carried)


def candidates(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """A row for each declaration a resolved signature may mean; dispatch is not claimed to be unique."""
    return calls.join(declarations, "signature", "left")


def contract_check(effects: DataFrame, contracts: DataFrame) -> DataFrame:
    """fn_id, error_type, problem (missing or extra) and code where declared and inferred sets differ, of functions with a
    contract."""
    declared = contracts.where("error_type is not null").select("fn_id", "error_type").distinct().withColumn("d", F.lit(True))
    inferred = effects.select("fn_id", "error_type").distinct().join(contracts.select("fn_id").distinct(), "fn_id", "left_semi").withColumn("i", F.lit(True))
    rows = declared.join(inferred, ["fn_id", "error_type"], "full").where("d is null or i is null")
    return rows.select("fn_id", "error_type", F.when(F.col("d").isNull(), "missing").otherwise("extra").alias("problem"), F.lit(BROKEN).alias("code"))


def implicit_contracts(effects: DataFrame, fns: DataFrame, contracts: DataFrame) -> DataFrame:
    """User-written functions with errors and no contract, and what their contract would say."""
    rows = effects.join(fns.where("user_written").select("fn_id"), "fn_id", "left_semi").join(contracts.select("fn_id").distinct(), "fn_id", "left_anti")
    return rows.groupBy("fn_id").agg(rendered(F.col("error_type")).alias("inferred"), F.lit(MISSING).alias("code"))


def rendered(error_type: Column) -> Column:
    """A set of types as a union, sorted."""
    return F.array_join(F.array_sort(F.collect_set(error_type)), " | ")


def return_type(effects: DataFrame, fns: DataFrame, value: Column) -> DataFrame:
    """The annotation that a fix would write for each function of fns, with its value type."""
    union = effects.groupBy("fn_id").agg(rendered(F.col("error_type")).alias("errors"))
    body = F.concat(F.lit("Returns<"), value, F.lit(", "), F.coalesce("errors", F.lit("never")), F.lit(">"))
    return fns.join(union, "fn_id", "left").select("fn_id", F.when(F.col("is_async"), F.concat(F.lit("Promise<"), body, F.lit(">"))).otherwise(body).alias("annotation"))


def unhandled_root(effects: DataFrame) -> DataFrame:
    """Errors, unknown ones too, that escape top-level execution."""
    return effects.where(F.col("fn_id") == ROOT)


def unhandled_promises(effects: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls whose promise may reject and which neither await nor return it nor handle its rejection."""
    loose = sites.where("kind = 'call' and not awaited and not returned and not consumed")
    return loose.join(effects.where("channel = 'rejects'").select(F.col("fn_id").alias("callee")).distinct(), "callee", "left_semi")


def catch_bindings(escaping: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """The type of each handler's variable from escaping(region_id, error_type) of its body: the union, unknown if any is
    unknown; an explicit annotation(region_id, annotated) wins."""
    rows = escaping.groupBy("region_id").agg(F.bool_or(F.col("error_type") == UNKNOWN).alias("any"), rendered(F.col("error_type")).alias("types"))
    rows = rows.select("region_id", F.when(F.col("any"), UNKNOWN).otherwise(F.col("types")).alias("binding"))
    if annotations is None:
        return rows
    return rows.join(annotations, "region_id", "full").select("region_id", F.coalesce("annotated", "binding").alias("binding"))


def narrow(bindings: DataFrame, tests: DataFrame, subtypes: DataFrame) -> DataFrame:
    """binding(region_id, error_type) through ordered tests(region_id, branch, type): the types each branch takes (its own
    and its subtypes, of those no earlier branch took); what is left has a null branch. subtypes(sub, super)."""
    below = reachable(subtypes.select(F.col("sub").alias("src"), F.col("super").alias("dst")))
    matches = tests.select("region_id", "branch", F.col("type").alias("dst")).join(below, "dst", "left").select("region_id", "branch", F.coalesce("src", "dst").alias("error_type"))
    matches = matches.unionByName(tests.select("region_id", "branch", F.col("type").alias("error_type")))
    first = matches.groupBy("region_id", "error_type").agg(F.min("branch").alias("branch"))
    return bindings.join(first, ["region_id", "error_type"], "left")


def instantiate(effects: DataFrame, arguments: DataFrame) -> DataFrame:
    """Effects of calls(call_id, fn_id) by their arguments(call_id, fn_id, variable, type): effects named after a type
    variable, callbacks included, take the argument's types; others stay."""
    calls = arguments.select("call_id", "fn_id").distinct()
    bound = arguments.select("call_id", F.col("variable").alias("error_type"), "type").distinct()
    return calls.join(effects, "fn_id").join(bound, ["call_id", "error_type"], "left").select("call_id", "channel", F.coalesce("type", "error_type").alias("error_type")).distinct()


def option_values(chain: DataFrame, options: DataFrame) -> DataFrame:
    """Each config's effective options: chain(config, ancestor, distance) with itself at distance 0, options(config, name,
    value); the nearest explicit value, false included, wins."""
    rows = chain.join(options.select(F.col("config").alias("ancestor"), "name", "value").where("value is not null"), "ancestor")
    return rows.groupBy("config", "name").agg(F.min_by("value", "distance").alias("value"))


def delivered(effects: DataFrame) -> DataFrame:
    """Effects of the call itself; errors that callbacks or events deliver later are none."""
    return effects.where(~F.col("channel").isin("callback", "event"))


def dispositions(mechanisms: DataFrame) -> DataFrame:
    """mechanisms(id, error_type, disposition, replacement): intrinsic and propagated errors as they are, replaced ones as
    their replacement, caught and avoided ones not at all."""
    kept = mechanisms.where(~F.col("disposition").isin("caught", "avoided"))
    return kept.select("id", F.when(F.col("disposition") == "replaced", F.col("replacement")).otherwise(F.col("error_type")).alias("error_type")).distinct()


def scoped_contracts(contracts: DataFrame) -> DataFrame:
    """contracts(fn_id, assumption, channel, error_type) by assumption, each with its own union; never merged across."""
    rows = contracts.where(~F.coalesce(F.col("channel").isin("callback", "event"), F.lit(False)))
    return rows.groupBy("fn_id", "assumption").agg(rendered(F.col("error_type")).alias("errors"))


def overlaid(disk: DataFrame, overlay: DataFrame) -> DataFrame:
    """file and text with unsaved text in place of saved."""
    return disk.join(overlay.select("file", F.col("text").alias("unsaved")), "file", "full").select("file", F.coalesce("unsaved", "text").alias("text"))


def runtime_edges(declared: DataFrame, paired: DataFrame, runtime: DataFrame) -> DataFrame:
    """Runtime edges of declared functions, by an explicit pairing(declared_id, runtime_id); equal names prove nothing."""
    return declared.join(paired, declared["fn_id"] == paired["declared_id"]).join(runtime, runtime["src"] == F.col("runtime_id")).select(declared["fn_id"], "runtime_id", runtime["dst"])


def values(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The types that may reach each variable over flows(src, dst) from seeds(variable, type), always with an unknown
    alternative."""
    reach = reachable(flows.select("src", "dst"), seeds.select("variable"))
    found = reach.join(seeds.select(F.col("variable").alias("src"), "type"), "src").select(F.col("dst").alias("variable"), "type").distinct()
    return found.unionByName(found.select("variable").distinct().withColumn("type", F.lit(UNKNOWN))).distinct()
