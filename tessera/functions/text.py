"""Text positions, newlines and names in source text. Offsets are UTF-8 bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_at(text: Column, offset: Column) -> Column:
    """The 1-based line of a byte offset."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    return F.size(F.split(before, "\n"))


def newline(text: Column) -> Column:
    """CR LF if the text has any, else LF."""
    return F.when(F.contains(text, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def indentation(text: Column, offset: Column) -> Column:
    """The white space at the start of the line that holds a byte offset."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    return F.regexp_extract(F.substring_index(before, "\n", -1), r"^([ \t]*)", 1)


def unused_name(text: Column, name: str) -> Column:
    """The name with as few underscores appended as make it new to the text: one more than follow it anywhere."""
    runs = F.regexp_extract_all(text, F.lit(f"(?={re.escape(name)}(_*))"), F.lit(1))
    more = F.array_max(F.transform(runs, lambda r: F.length(r) + 1))
    return F.concat(F.lit(name), F.repeat(F.lit("_"), F.coalesce(more, F.lit(0))))


def opening(name: Column, depth: Column, unit: str = "  ") -> Column:
    """A suite's opening line at its depth."""
    quoted = F.to_json(F.array(name))
    return F.concat(F.repeat(F.lit(unit), depth), F.lit("describe("), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(", () => {"))
