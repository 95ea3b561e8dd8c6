"""Names: path keys, file-name slugs with collision suffixes, library names, file keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest slug without a suffix.
LONGEST = 180
#: FNV-1a of 64 bits (fixed values).
FNV_START, FNV_PRIME, FNV_MODULUS = "14695981039346656037", "1099511628211", "18446744073709551616"
#: Library name parts that are spelt in their own way (fixed values).
SPELT = {"dom": "DOM", "esnext": "ESNext", "webworker": "WebWorker", "scripthost": "ScriptHost", "bigint": "BigInt", "arraybuffer": "ArrayBuffer", "sharedmemory": "SharedMemory", "typedarrays": "TypedArrays", "asynciterable": "AsyncIterable", "asyncgenerator": "AsyncGenerator", "importscripts": "ImportScripts", "weakref": "WeakRef", "regexp": "RegExp", "json": "JSON", "modulesource": "ModuleSource", "wellknown": "WellKnown"}


def json_key(path: Column) -> Column:
    """The path as compact JSON: the canonical key of a node."""
    return F.to_json(path)


def _byte_pairs(text: Column) -> Column:
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))


def slug(path: Column) -> Column:
    """Lower-cased parts joined by '#'; every byte but ASCII letters, digits and -_. as %XX."""
    plain = r"^(3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2D|2E|5F)$"
    byte = lambda b: F.when(b.rlike(plain), F.decode(F.unhex(b), "UTF-8")).otherwise(F.concat(F.lit("%"), b))
    return F.array_join(F.transform(path, lambda part: F.array_join(F.transform(_byte_pairs(F.lower(part)), byte), "")), "#")


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 64 bits wrapping, as 16 hexadecimal digits. Decimals carry what BIGINT cannot."""
    wide = lambda c: c.cast("decimal(20,0)")

    def step(h: Column, pair: Column) -> Column:
        low = (h % F.lit(256)).cast("bigint")
        mixed = wide(h - wide(low) + wide(low.bitwiseXOR(F.conv(pair, 16, 10).cast("bigint"))))
        return wide((mixed * F.lit(FNV_PRIME).cast("decimal(13,0)")) % F.lit(FNV_MODULUS).cast("decimal(20,0)"))

    h = F.aggregate(_byte_pairs(text), F.lit(FNV_START).cast("decimal(20,0)"), step)
    half = F.lit("4294967296").cast("decimal(20,0)")
    digits = lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 8, "0")
    low = wide(h % half)
    return F.concat(digits((h - low) / half), digits(low))


def evidence_names(callables: DataFrame) -> DataFrame:
    """callables(kind, file, path, ...) with key, slug and name. Within a file a slug that several keys share, that is too
    long, or that is a dot name, gets the hash of its key as a suffix; kind 'ts' leaves out the library part."""
    rest = F.when(F.col("kind") == "ts", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.col("path"))
    rows = callables.withColumn("key", json_key(F.col("path"))).withColumn("slug", slug(rest))
    shared = F.count("*").over(Window.partitionBy("kind", "file", "slug")) > 1
    marked = shared | (F.length("slug") > LONGEST) | F.col("slug").isin(".", "..")
    return rows.withColumn("name", F.when(marked, F.concat(F.substring("slug", 1, LONGEST), F.lit("~"), fnv1a(F.col("key")))).otherwise(F.col("slug")))


def library_name(stem: Column) -> Column:
    """Dot-separated parts: the spelt ones, es* in capitals, else the first letter capitalised."""
    table = F.create_map(*[F.lit(x) for pair in SPELT.items() for x in pair])

    def part(p: Column) -> Column:
        ascii_upper = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        first = F.concat(ascii_upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))
        return F.coalesce(F.try_element_at(table, p), F.when(p.startswith("es"), ascii_upper(p)), first)

    return F.array_join(F.transform(F.split(stem, r"\."), part), ".")


def module_name(name: Column) -> Column:
    """A module's canonical name: the legacy name with the node: prefix."""
    return F.when(name.startswith("node:"), name).otherwise(F.concat(F.lit("node:"), name))


def member_key(text: Column, computed: Column) -> Column:
    """A property key's name: its text without white space, in brackets when computed."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    return F.when(computed, F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)


def test_file(path: Column, node: bool) -> Column:
    """The test file of a declaration file, relative to its root."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.d\.ts$", "")
    return F.concat(stem if node else F.regexp_replace(stem, r"(^|/)lib\.", "$1"), F.lit(".test.ts"))
