"""Spans of pattern matches, their resolution and replacement, as Column expressions.

All work on a text is done in passes over whole arrays, none of which copies
what it has so far at each step: running sums and maxima by doubling, overlapping
spans cluster by cluster, and texts cut into pieces before they are sliced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EMAIL, PHONE, PHONE_END

SPANS = "array<struct<start:int,end:int,entity:string,value:string>>"
#: Characters of a piece of text.
PIECE = 4096


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or what else ``combine`` (associative) makes, of an array of numbers.

    After pass k each place holds what the 2^k values up to it make, so there are
    log2(size) passes.
    """

    def pass_(acc: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= back, combine(F.get(acc, i - back), x)).otherwise(x))

    passes = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
    return bound(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(passes(v), v, pass_)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points.

    Spark has no function for match positions. Matches and the gaps between them
    (a split by the same pattern) alternate, so running sums of their lengths are
    the positions.
    """
    t = F.coalesce(text, F.lit(""))

    def placed(found: Column) -> Column:
        lengths = F.transform(F.arrays_zip(F.slice(F.split(t, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("value")), lambda m: F.length(m["gap"]) + F.length(m["value"]))
        ends = running(lengths, lambda a, b: a + b)
        return F.zip_with(ends, found, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return bound(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def contact_spans(text: Column) -> Column:
    """array<struct<start, end, entity, value>> of e-mail addresses and phone numbers, resolved.

    A text without an @, or without the last digits of a number, isn't searched
    for what needs them. Spaces and digits are those of any script, here too.
    """
    none = F.array().cast(SPANS)

    def typed(entity: str, pattern: str, needed: Column) -> Column:
        found = F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(entity).alias("entity"), m["value"].alias("value")))
        return F.when(needed, found).otherwise(none)

    mail, phone = F.contains(text, F.lit("@")), text.rlike(PHONE_END)
    return F.when(mail | phone, resolve(F.concat(typed("em", EMAIL, mail), typed("ph", PHONE, phone)))).otherwise(none)


def resolve(spans: Column) -> Column:
    """A disjoint choice from array<struct<start, end, entity, value>>.

    In order of start, then typed before "name", then length, then place in the
    array, a span is taken if it starts at or after the end of what was taken.
    Spans that touch no earlier one begin a cluster; clusters don't bear on each
    other, so the choice is made in each by itself.
    """
    keyed = F.transform(spans.cast(SPANS), lambda s, i: F.struct(s["start"], (s["entity"] == "name").alias("loose"), (s["start"] - s["end"]).alias("short"), i.alias("i"), s.alias("span")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        free = k["start"] >= acc["at"]
        return F.struct(F.when(free, k["span"]["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(k["span"]))).otherwise(acc["out"]).alias("out"))

    def chosen(own: Column) -> Column:
        ordinary = F.when(own[0]["start"] >= 0, F.array(own[0]["span"])).otherwise(F.array().cast(SPANS))
        return F.when(F.size(own) == 1, ordinary).otherwise(F.aggregate(own, zero, step)["out"])

    def by_cluster(s: Column) -> Column:
        reach = running(F.transform(s, lambda k: k["span"]["end"]), F.greatest)
        first = lambda r: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(r, i - 1)))
        clusters = lambda at: F.transform(at, lambda a, i: F.slice(s, a + 1, F.coalesce(F.get(at, i + 1), F.size(s)) - a))
        return F.flatten(F.transform(bound(bound(reach, first), clusters), chosen))

    return bound(F.array_sort(keyed), lambda s: F.when(F.size(s) == 0, F.array().cast(SPANS)).otherwise(by_cluster(s)))


def cut(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, in code points, of what ``cut`` has cut."""
    size = F.lit(PIECE)
    a, b = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    one = F.substring(F.get(pieces, a), start - a * size + 1, end - start)
    head, tail = F.substring(F.get(pieces, a), start - a * size + 1, size), F.substring(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), end - b * size)
    many = F.concat(head, F.array_join(F.slice(pieces, a + 2, b - a - 1), ""), tail)
    return F.when(end <= start, "").when(a == b, one).otherwise(many)


def splice(text: Column, pieces: Column) -> Column:
    """``text`` with each of array<struct<start, end, token>> (disjoint, in order) replaced by its token."""

    def whole(p: Column) -> Column:
        def joined(t: Column) -> Column:
            gap = lambda i, to: between(t, F.coalesce(F.get(p, i - 1)["end"], F.lit(0)), to)
            parts = F.transform(p, lambda x, i: F.concat(gap(i, x["start"]), x["token"]))
            return F.concat(F.array_join(parts, ""), gap(F.size(p), F.length(text)))

        return bound(cut(text), joined)

    return bound(pieces, lambda p: F.when(F.size(p) == 0, text).otherwise(whole(p)))


def valid(spans: Column, length: Column) -> Column:
    """Spans with 0 <= start < end <= length."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= length))
