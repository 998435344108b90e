"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return day * 86_400_000 + seconds * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signature(values: Column) -> Column:
    """64 numbers as 64 bits: bit i is set where number i is above the median (the mean of the two middle ones)."""
    numbers = values.cast("array<double>")
    ordered = F.sort_array(F.array_compact(numbers))
    middle = (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / 2
    bit = lambda x, i, m: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    # A lambda binds the median, which is sorted for once a row and not once a number.
    of = lambda m: F.aggregate(F.transform(numbers, lambda x, i: bit(x, i, m)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.transform(F.array(middle), of)[0]


def half(sig: Column, right: bool) -> Column:
    """The 32 bits of one side of a signature."""
    return F.shiftrightunsigned(sig, 32) if right else sig.bitwiseAND(F.lit(0xFFFFFFFF))


def ordinal_id(kind: str, n: Column) -> Column:
    return F.format_string(f"{kind}_%04d", n)


def strip(text: Column) -> Column:
    """Without white space at its ends, as Unicode has it, and the four separators of ASCII."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def any_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.contains(low, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(low, F.lit(word))
    return found
