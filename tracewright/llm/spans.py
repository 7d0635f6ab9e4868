"""Places of regular-expression matches as columns, in code points, without Python on the workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(text: Column, pattern: str) -> Column:
    """What stands between the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Values of one block of a running total; a total over n values costs about n times the sum of this and n / BLOCK copies.
BLOCK = 512


def before(values: Column, start, join) -> Column:
    """Of each element of an array what ``join`` makes of ``start`` and all elements before it, such as a running sum.

    Arrays grow within blocks and over block totals only, so long arrays aren't copied at every step.
    """

    def grown(part: Column, first: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(first), lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x)))), F.lit(1), F.size(part))

    def joined(blocks: Column) -> Column:
        firsts = grown(F.transform(blocks, lambda b: F.aggregate(b, start, join)), start)
        return F.flatten(F.zip_with(blocks, firsts, grown))

    def blocked(all_values: Column) -> Column:
        last = F.floor((F.size(all_values) - 1) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_values, i * BLOCK + 1, F.lit(BLOCK))), joined)

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(blocked(v)))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start int, end int, value string, part string>> of all matches, leftmost and non-overlapping.

    ``value`` is the whole match and ``part`` its group. Starts are running sums of the lengths between and of matches;
    texts without a match cost one search.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,part:string>>")
    parts = F.arrays_zip(matches(text, pattern).alias("value"), matches(text, pattern, group).alias("part")) if group else F.transform(matches(text, pattern), lambda m: F.struct(m.alias("value"), m.alias("part")))
    steps = F.filter(F.zip_with(pieces(text, pattern), parts, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m["value"].alias("value"), m["part"].alias("part"))), lambda x: x["value"].isNotNull())

    def placed(steps: Column) -> Column:
        ends = before(F.transform(steps, lambda x: x["gap"] + F.char_length(x["value"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(steps, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.char_length(x["value"])).alias("end"), x["value"].alias("value"), x["part"].alias("part")))

    return F.when(text.rlike(pattern), let(steps, placed)).otherwise(empty)


def replaced(text: Column, pattern: str, change) -> Column:
    """``text`` with every match m replaced by ``change(m)``; null stays null."""
    joined = F.zip_with(pieces(text, pattern), F.transform(matches(text, pattern), change), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)
