"""Secrets found through an inverted index of trigrams.

Each rule's regular expression is turned into a Boolean query over trigrams that any match
must hold (public-domain technique of regular-expression search engines). Postings are
kept for the trigrams of the rules only; a rule's candidates are the texts in the
intersections of its postings, and only they run its expression. Rules without a
mandatory trigram scan every text. All of it is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.llm.common import Columns
from findling.llm.spans import Span, in_order, match_spans, spans_of_kinds
from findling.storage import written

#: Alternatives of a rule's query beyond which it counts as having none.
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class SecretRule:
    """``regex`` is common to Java and Python; ``group`` must have ``least`` code points (0: no test)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0

    @property
    def alternatives(self) -> list[frozenset[str]] | None:
        """Sets of lower-case trigrams: a match holds all of one set. None if nothing is mandatory."""
        found = _queries(self.regex)
        return found and sorted(found, key=sorted)

    @property
    def read(self) -> list[frozenset[str]] | None:
        """The trigrams of each alternative whose postings are read: those that, side by side, cover its strings."""
        found = _queries(self.regex)
        return found and sorted(set(found.values()), key=sorted)


def _queries(regex: str) -> dict[frozenset[str], frozenset[str]] | None:
    """Strings that a match must contain in a row give the trigrams, and those that cover them; classes break strings."""
    flags = re.match(r"\(\?([a-z]+)\)", regex)
    tree = re._parser.parse(regex[flags.end() :] if flags else regex)
    found = {}
    # At most 60 trigrams a set, so that their bits fit a long: fewer only make more candidates.
    for run in _runs(tree):
        whole = [[s[i : i + 3] for i in range(len(s) - 2)] for s in run if len(s) > 2]
        found[frozenset(g for grams in whole for g in grams)] = frozenset(sorted({g for grams in whole for g in (*grams[::3], grams[-1])})[:60])
    if frozenset() in found:
        return None
    # A set that contains another is implied by it.
    least = {f: t for f, t in found.items() if not any(g < f for g in found)}
    return least if 0 < len(least) <= MAX_ALTERNATIVES else None


def _runs(tree) -> list[tuple[str, ...]]:
    """All ways through the expression, each as its literal strings, cut where anything may stand."""
    ways: list[tuple[str, ...]] = [("",)]

    def then(rights: list[tuple[str, ...]]) -> None:
        nonlocal ways
        ways = list(dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a, b in product(ways, rights)))
        if len(ways) > 4 * MAX_ALTERNATIVES:
            ways = [("", "")]

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            then([(chr(value).lower(),)])
        elif name == "SUBPATTERN":
            then(_runs(value[3]))
        elif name == "BRANCH":
            then([way for branch in value[1] for way in _runs(branch)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            inner = _runs(body)
            if (low, high) == (0, 1):
                then([("",), *inner])
            elif low == 0:
                then([("", "")])
            elif low == high and low <= 4:
                for _ in range(low):
                    then(inner)
            else:
                then(inner)
                then([("", "")])
                then(inner if low > 1 else [("",)])
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            then([("",)])
        elif name == "IN" and len(value) <= 6 and all(str(k) == "LITERAL" for k, _ in value):
            then([(chr(c).lower(),) for _, c in value])
        else:
            then([("", "")])
    return ways


def find_secrets(docs: DataFrame, rules: Sequence[SecretRule], text_col: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with ``name``: an array of (kind, start, end) ordered by start, then by the order of the rules.

    Matches are leftmost and non-overlapping per rule; one that fails its test of length is
    dropped and not tried again. Offsets count code points, the end is exclusive. Null and
    empty texts have no secrets. Postings and candidates go by text, however many rows repeat it, and
    texts, not identifiers, are the key, so null and repeated identifiers don't matter. Whole
    texts are read, in time that grows in proportion to their length and matches. The table of candidates is written,
    so Spark knows its size: it is broadcast below Spark's bound and joined by a shuffle beyond. An empty table or
    rule list works; columns may have any names, and one called ``name`` (in any case) is replaced.
    """
    own = Columns(docs, [name])
    queries = {r.kind: r.read for r in rules}
    indexed = [r for r in rules if queries[r.kind] is not None]
    kinds = [r.kind for r in rules]
    keyed = own.table.withColumn("text", F.coalesce(F.col(own.at(text_col)), F.lit("")))
    if not indexed:
        found = in_order(spans_of_kinds([_matches(r, F.col("text")) for r in rules]), kinds)
        return keyed.withColumn("found", found).select(*own.own(), F.col("found").alias(name))

    # Postings: the trigrams of the rules that each text holds. The lowered text is a column of
    # its own, for a projection that used it inside each test would lower it for each of them.
    ways = [(r.kind, i, q) for r in indexed for i, q in enumerate(queries[r.kind])]
    grams = sorted({g for _, _, q in ways for g in q})
    keyed = keyed.withColumn("key", F.md5("text"))
    lowered = keyed.select("key", F.lower("text").alias("lower"))
    postings = lowered.select("key", F.explode(F.array(*[F.when(F.contains("lower", F.lit(g)), F.lit(g)) for g in grams])).alias("gram")).filter("gram IS NOT NULL")
    # As many rows as the rule list has trigrams; a way is whole when all its bits are seen, however often.
    terms = [(kind, i, g, 1 << at, (1 << len(q)) - 1) for kind, i, q in ways for at, g in enumerate(sorted(q))]
    terms = docs.sparkSession.createDataFrame(terms, "kind string, way int, gram string, bit long, whole long")
    hits = postings.join(F.broadcast(terms), "gram").groupBy("key", "kind", "way", "whole").agg(F.bit_or("bit").alias("seen"))
    candidates = hits.filter("seen = whole").groupBy("key").agg(F.collect_set("kind").alias("kinds"))
    candidates = written(candidates, "secret-candidates")

    out = keyed.join(candidates, "key", "left")
    found = [_matches(r, F.col("text")) if queries[r.kind] is None else F.when(F.array_contains("kinds", r.kind), _matches(r, F.col("text"))).otherwise(_none()) for r in rules]
    return out.withColumn("found", in_order(spans_of_kinds(found), kinds)).select(*own.own(), F.col("found").alias(name))


def _matches(rule: SecretRule, text: Column) -> Column:
    test = None
    if rule.least:
        inner = rule.regex

        def test(value):
            return F.length(F.regexp_extract(value, f"^(?:{inner})" if not inner.startswith("(?i)") else f"(?i)^(?:{inner[4:]})", rule.group)) >= rule.least

    return match_spans(text, rule.kind, rule.regex, test)


def _none() -> Column:
    return F.array().cast(Span)
