"""Places of matches in texts, as column expressions.

Every expression takes time that grows in proportion to the text and its matches: running sums go block by
block, for appending one number at a time to an array copies the array each time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of an array of spans; offsets count code points, the end is exclusive.
Span = "array<struct<kind:string,start:long,end:long>>"
#: The same with what matched.
Match = "array<struct<kind:string,start:long,end:long,v:string>>"
#: Numbers that are summed one by one, and levels of blocks above them. The blocks of the last level are summed one by
#: one too: 4096 of them in a text of 16 million matches.
BLOCK, LEVELS = 64, 2


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _one_by_one(numbers: Column) -> Column:
    def step(acc, n):
        return F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + n)

    return F.aggregate(numbers, F.array().cast("array<long>"), step)


def running_sums(numbers: Column, levels: int = LEVELS) -> Column:
    """The sum of each number and those before it."""
    numbers = numbers.cast("array<long>")
    if not levels:
        return _one_by_one(numbers)

    def joined(inner):
        ends = running_sums(F.transform(inner, lambda b: F.get(b, F.size(b) - 1)), levels - 1)
        return let(ends, lambda e: F.flatten(F.transform(inner, lambda b, i: F.transform(b, lambda n: n + F.coalesce(F.get(e, i - 1), F.lit(0).cast("long"))))))

    def blocks(a):
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda s: _one_by_one(F.slice(a, s, F.lit(BLOCK))))

    return let(let(numbers, blocks), joined)


def n_below(points: Column, queries: Column) -> Column:
    """For each of ``queries``, how many ``points`` are less than it."""
    point = F.transform(points, lambda p: F.struct(p.cast("long").alias("at"), F.lit(1).alias("point"), F.lit(0).alias("i")))
    query = F.transform(queries, lambda q, i: F.struct(q.cast("long").alias("at"), F.lit(0).alias("point"), i.alias("i")))

    def counted(events):
        sums = running_sums(F.transform(events, lambda e: e["point"]))
        both = F.zip_with(events, sums, lambda e, n: F.struct(e["i"].alias("i"), n.alias("n"), e["point"].alias("point")))
        return F.transform(F.sort_array(F.filter(both, lambda b: b["point"] == 0)), lambda b: b["n"])

    return let(F.sort_array(F.concat(point, query)), counted)


def place_matches(found: Column, between: Column) -> Column:
    """(v, start, end) of matches ``found`` in a text that has ``between`` around them."""

    def placed(pairs):
        ends = running_sums(F.transform(pairs, lambda p: p["gap"] + p["n"]))
        return F.zip_with(pairs, ends, lambda p, e: F.struct(p["v"].alias("v"), (e - p["n"]).alias("start"), e.alias("end")))

    def paired(f):
        return F.zip_with(f, F.slice(between, F.lit(1), F.size(f)), lambda m, b: F.struct(m.alias("v"), F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("n")))

    return let(let(found, paired), placed)


def matches(text: Column, kind: str, regex: str, test: Callable[[Column], Column] | None = None, hint: str | None = None) -> Column:
    """(kind, start, end, v) of the leftmost, non-overlapping matches of ``regex`` that pass ``test``.

    Splitting a text by the expression gives what stands between the matches, so lengths
    alone give the places. ``hint`` is a string that every match holds: texts without
    it are not searched.
    """
    placed = place_matches(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1))
    if test is not None:
        placed = F.filter(placed, lambda s: test(s["v"]))
    spans = F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["v"].alias("v")))
    possible = F.contains(text, F.lit(hint)) if hint is not None else F.rlike(text, F.lit(regex))
    return F.when(possible, spans).otherwise(F.array().cast(Match)).cast(Match)


def match_spans(text: Column, kind: str, regex: str, test: Callable[[Column], Column] | None = None, hint: str | None = None) -> Column:
    """The spans of :func:`matches`."""
    return without_values(matches(text, kind, regex, test, hint))


def without_values(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(Span)


def spans_of_kinds(parts: Sequence[Column]) -> Column:
    """All spans in one array."""
    if not parts:
        return F.array().cast(Span)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def in_order(found: Column, kinds: Sequence[str], values: bool = False) -> Column:
    """Spans, or matches with their ``values``, by start, then by the order of ``kinds``."""
    place = F.array(*[F.lit(k) for k in kinds])
    more = ("v",) if values else ()

    def keyed(s):
        return F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("k"), *[s[c].alias(c) for c in ("end", "kind", *more)])

    ordered = F.sort_array(F.transform(found, keyed))
    return F.transform(ordered, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", *more)])).cast(Match if values else Span)


def spelled(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans (of ``kinds`` only) in their order, joined by commas."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
