"""Text expressions: sizes, joined lists, word tokens, run keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units above plain bytes, each 1024 times the one before.
SIZE_UNITS = ("kB", "MB", "GB", "TB")
BYTES_LIMIT = 10 * 1024
UNIT_LIMIT = 20 * 1024 - 1

# The code points that stripping a text takes away, as ranges.
WHITE = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A))
WHITE += ((0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
WHITE_CLASS = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in WHITE)


def is_blank(line: Column) -> Column:
    """Whether a text has nothing but white space."""
    return ~line.rlike(f"[^{WHITE_CLASS}]")


def stripped(text: Column) -> Column:
    """A text without the white space at both ends."""
    return F.regexp_replace(text, f"\\A[{WHITE_CLASS}]+|[{WHITE_CLASS}]+\\z", "")


def pretty_size(size: Column) -> Column:
    """Bytes as text the way PostgreSQL prints them (sizes are never negative).

    Each unit is looked at in half-units, so that the printed number is the size rounded half up.
    """
    text = F.when(size < BYTES_LIMIT, F.format_string("%d bytes", size))
    for power, unit in enumerate(SIZE_UNITS, start=1):
        halves = F.shiftright(size, 10 * power - 1)
        shown = F.format_string(f"%d {unit}", F.shiftright(halves + 1, 1))
        text = text.otherwise(shown) if unit == SIZE_UNITS[-1] else text.when(halves < UNIT_LIMIT, shown)
    return text


def joined_or(names: Column, default: str) -> Column:
    """``', '``-joined array, or ``default`` when it is empty or missing."""
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit(default)).otherwise(F.concat_ws(", ", names))


def in_order(position: Column, value: Column) -> Column:
    """Aggregate: values as an array ordered by position.  For catalog rows only, where groups are short."""
    pairs = F.array_sort(F.collect_list(F.struct(position.alias("position"), value.alias("value"))))
    return F.transform(pairs, lambda pair: pair["value"])


def space_tokens(line: Column) -> Column:
    """Tokens between single spaces: leading and inner empty tokens stay, trailing ones go.

    An empty line is one empty token, a line of spaces has none.
    """
    kept = F.rtrim(line)
    return (
        F.when(line == "", F.array(F.lit("")))
        .when(kept == "", F.array().cast("array<string>"))
        .otherwise(F.split(kept, " "))
    )


def run_key(job_name: Column, started: Column) -> Column:
    """Lower-case job name with spaces and underscores as dashes, then the start in epoch seconds."""
    seconds = F.unix_seconds(started.cast("timestamp"))
    return F.concat_ws("-", F.translate(F.lower(job_name), " _", "--"), seconds.cast("string"))


def first_value_after(line: Column, word: str) -> Column:
    """Stripped text between the first and the second occurrence of ``word``; null when it is absent."""
    start = F.locate(word, line)
    rest = F.substr(line, start + F.lit(len(word)))
    stop = F.locate(word, rest)
    found = F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.when(start > 0, stripped(found))


def json_at(column: Column, path: str, default: str = "") -> Column:
    """The text at a dotted path in a JSON text; ``default`` where any part of the path is missing or null."""
    return F.coalesce(F.get_json_object(column, f"$.{path}"), F.lit(default))
