import pytest
from pyspark.sql import functions as F

from tessera.operators import inventory
from tessera.plans.fixpoint import reachable
from tessera.sources import declarations
from tessera.sources.lexer import SourceError


def tree(spark, source, node=False):
    files = spark.createDataFrame([("a.test.ts", source)], "file string, text string")
    return {tuple(r["path"]): r["callable"] for r in declarations.declared(declarations.parse(files, node)).collect()}


def callables(spark, source, node=False):
    return {"/".join(p) for p, c in tree(spark, source, node).items() if c}


def test_interfaces_and_variables_of_one_name_are_one_node(spark):
    source = """
    interface Kettle { boil(): void; boil(minutes: number): void; colour: string }
    declare var Kettle: { new (litres: number): Kettle; new (): Kettle; readonly prototype: Kettle };
    """
    assert callables(spark, source) == {"Kettle/boil", "Kettle/new"}


@pytest.mark.parametrize(
    ("member", "path"),
    [
        ("pour(): void", "pour"), ("static wash(): void", "static wash"), ("get lid(): boolean", "get lid"), ("set lid(open: boolean)", "set lid"),
        ("constructor(size: number)", "new"), ("onSteam: (heat: number) => void", "onSteam"), ("[Symbol.dispose](): void", "[Symbol.dispose]"),
        ("'with-dash'(): void", "with-dash"), ("protected inner(): void", None), ("private hidden(): void", None), ("#own(): void", None), ("weight: number", None),
    ],
)
def test_class_members(spark, member, path):
    assert callables(spark, f"declare class Pot {{ {member}; }}") == ({f"Pot/{path}"} if path else set())


def test_types_are_walked_and_parameters_are_not(spark):
    source = """
    type Pour = (cup: string) => number;
    type Same = Pour;
    type Fold = Unfold; type Unfold = Fold;
    type Plain = { grams: number };
    type Maybe<T> = T extends number ? (x: T) => void : (abstract new () => T) | null;
    interface Maker { new (): object; (): object }
    declare const maker: Maker, made: { run(): void };
    declare function serve(guest: (name: string) => void, ...rest: { eat(): void }[]): { leave(): void };
    """
    assert callables(spark, source) == {"Pour", "Same", "Maybe", "Maybe/new", "Maker", "Maker/new", "maker", "maker/new", "made/run", "serve"}


def test_names_resolve_from_the_inside_out(spark):
    source = """
    type Cook = () => void;
    declare namespace Kitchen {
      namespace Stove { interface Cook { stir(): void } interface Ring { heat: Cook; other: Outer.Timer } }
      interface Sink { drain: Cook }
    }
    declare namespace Outer { type Timer = (seconds: number) => void }
    """
    # the nearer Cook has no call signature, and still hides the farther one
    assert callables(spark, source) == {"Cook", "Kitchen/Stove/Cook/stir", "Kitchen/Stove/Ring/other", "Kitchen/Sink/drain", "Outer/Timer"}


def test_modules_have_canonical_names(spark):
    source = """
    declare module "tea/leaf" { export function steep(minutes: number): void; }
    declare module "node:tea" { global { namespace pot { function fill(): void } var lid: { lift(): void } } }
    declare module "tea" { export { default } from "node:tea"; }
    """
    assert callables(spark, source, node=True) == {"node:tea/leaf/steep", "node:tea/global/pot/fill", "node:tea/global/lid/lift"}
    assert callables(spark, source.replace("node:tea", "x")) == {"tea/leaf/steep", "x/global/pot/fill", "x/global/lid/lift"}


@pytest.mark.parametrize("source", ["declare function (", "interface A {", "type X = ;", "declare class A { x: 'unclosed }"])
def test_broken_sources_fail(source):
    with pytest.raises(SourceError):
        declarations.Reader(source)


def test_first_scope_hit_wins_even_if_empty(spark):
    refs = spark.createDataFrame([("f", ["x"], ["A", "B"], ["T"], False)], "file string, path array<string>, scope array<string>, target array<string>, object boolean")
    nodes = spark.createDataFrame([("f", ["T"]), ("f", ["A", "T"])], "file string, path array<string>")
    assert inventory.resolve(refs, nodes).first()["resolved"] == ["A", "T"]


def test_reachability_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    got = {tuple(r) for r in reachable(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, b) for b in (1, 2, 3, 4)}
    assert reachable(edges.where("src > 9")).count() == 0


def test_long_chains_are_put_together(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert reachable(edges, spark.range(1)).count() == 41


def test_callables_of_a_library(spark):
    nodes = spark.createDataFrame([("f", ["a"], False), ("f", ["a", "b"], True)], "file string, path array<string>, callable boolean")
    assert [tuple(r) for r in inventory.callables(inventory.in_library(nodes, F.lit("L"))).collect()] == [("f", ["L", "a", "b"], '["L","a","b"]')]
