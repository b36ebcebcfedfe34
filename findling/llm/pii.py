"""Personal data by expressions and by bootstrapped contexts.

Expressions with checks find seeds, each of which is one identifier however many words it
has. Words around a seed are lexical patterns; the graph of
patterns and the identifiers they surround is scored in rounds: a pattern is as good as
the share of its identifiers that are known, an identifier as good as its patterns make
it. Identifiers that no expression knows are reported where a pattern of high confidence,
seen around enough different seeds, surrounds them. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.llm.common import Columns
from findling.llm.spans import Match, Span, in_order, matches, n_below, place_matches, without_values
from findling.storage import written

KINDS = ("email", "ip", "card", "phone")
#: What the contexts discover.
FOUND = "context"
#: The expressions match what the plain ones `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`,
#: `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`, `[0-9]([\x20-]?[0-9])+` and `\+[0-9][\x20().0-9-]+[0-9]` do, without their
#: retries inside a run of characters and without recursion, so long runs take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPACE = r"\x20\x09-\x0D"
#: A word with a digit or an at sign.
CANDIDATE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
ROUNDS, LEAST_SEEDS, LEAST_CONFIDENCE = 3, 5, 0.9
#: Tasks that share the instances of a pattern.
SALTS = 8


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\.", -1), lambda p: F.rlike(p, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.transform(F.regexp_extract_all(F.reverse(d), F.lit("[0-9]"), F.lit(0)), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.length(d).between(14, 19) & (F.aggregate(n, F.lit(0), lambda a, x: a + x) % 10 == 0)


def base_matches(text: Column) -> Column:
    """What the four expressions match, by start, then by kind as listed in KINDS."""
    digit = F.rlike(text, F.lit("[0-9]"))
    none = F.array().cast(Match)
    parts = [
        matches(text, "email", EMAIL, hint="@"),
        F.when(digit, matches(text, "ip", IP, _octets)).otherwise(none),
        F.when(digit, matches(text, "card", CARD, _luhn)).otherwise(none),
        matches(text, "phone", PHONE, lambda v: F.length(_digits(v)).between(10, 15), hint="+"),
    ]
    return in_order(F.concat(*parts), KINDS, values=True)


def base_spans(text: Column) -> Column:
    """Spans of the four expressions, by start, then by kind as listed in KINDS."""
    return without_values(base_matches(text))


def _words(found: Column, gaps: Column) -> Column:
    """(value, start, end, left, right, from, upto) of the words with digits or at signs.

    Ends of punctuation are cut off the value; the whole word reaches from ``from`` to ``upto``. A
    neighbour may be such a word itself. ``found`` and ``gaps`` are columns, matches and what stands between them: an
    expression would be evaluated again for each element.
    """
    word = rf"[^{_SPACE}]++"

    def one(p, i):
        tail = F.regexp_replace(p["v"], "^[^A-Za-z0-9+@]++", "")
        core = F.regexp_replace(tail, "(?<=[A-Za-z0-9]|^)[^A-Za-z0-9]++$", "")
        start = p["start"] + F.length(p["v"]) - F.length(tail)
        left = _beside(F.regexp_extract(F.get(gaps, i), rf"(?<![^{_SPACE}])({word})[{_SPACE}]*+$", 1), F.get(found, i - 1))
        right = _beside(F.regexp_extract(F.get(gaps, i + 1), rf"^[{_SPACE}]*+({word})", 1), F.get(found, i + 1))
        return F.struct(core.alias("value"), start.alias("start"), (start + F.length(core)).alias("end"), left.alias("left"), right.alias("right"), p["start"].alias("from"), p["end"].alias("upto"))

    return F.transform(place_matches(found, gaps), one)


def _beside(word: Column, candidate: Column) -> Column:
    return F.lower(F.when(word != "", word).otherwise(F.coalesce(candidate, F.lit(""))))


def _instances(base: Column, words: Column) -> Column:
    """(value, start, end, left, right, seed): each base span as a whole, then the words that overlap none.

    The neighbours of a span are those of its first and its last word; each of its ends has a digit or an at sign
    in its word. Both arguments are columns.
    """
    first = n_below(F.transform(words, lambda w: w["from"]), F.transform(base, lambda s: s["start"] + 1))
    last = n_below(F.transform(words, lambda w: w["from"]), F.transform(base, lambda s: s["end"]))
    begun = n_below(F.transform(base, lambda s: s["start"]), F.transform(words, lambda w: w["upto"]))
    ended = n_below(F.transform(base, lambda s: s["end"]), F.transform(words, lambda w: w["from"] + 1))
    sides = F.zip_with(first, last, lambda i, j: F.struct(F.get(words, (i - 1).cast("int"))["left"].alias("left"), F.get(words, (j - 1).cast("int"))["right"].alias("right")))
    seeds = F.zip_with(base, sides, lambda s, e: _instance(s["v"], s, e, True))
    touched = F.zip_with(words, F.zip_with(begun, ended, lambda x, y: x - y), lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    free = F.filter(touched, lambda x: x["n"] == 0)
    return F.concat(seeds, F.transform(free, lambda x: _instance(x["w"]["value"], x["w"], x["w"], False)))


def _instance(value: Column, place: Column, sides: Column, seed: bool) -> Column:
    return F.struct(value.alias("value"), place["start"].alias("start"), place["end"].alias("end"), sides["left"].alias("left"), sides["right"].alias("right"), F.lit(seed).alias("seed"))


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int"))


def _for_salts(patterns: DataFrame) -> DataFrame:
    """Patterns once for each salt: they are few beside their instances, and a frequent one meets those in several tasks."""
    return patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern``, ``confidence``, ``seeds`` of a graph (pattern, instance, seed)."""
    scores = edges.select("instance", F.col("seed").cast("double").alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    patterns = None
    for _ in range(rounds):
        known = edges.join(scores, "instance")
        patterns = known.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        trusted = _for_salts(patterns.filter(F.col("seeds") >= LEAST_SEEDS).select("pattern", "confidence"))
        miss = F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("confidence", F.lit(0.0))))
        spread = _salted(edges).join(trusted, ["pattern", "salt"], "left").groupBy("instance")
        scores = spread.agg(F.when(F.max(F.col("seed").cast("int")) == 1, F.lit(1.0)).otherwise(1 - F.exp(F.sum(miss))).alias("score"))
    return patterns


def find_personal_data(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with ``name``: an array of (kind, start, end) by start, then kind.

    Base spans come from :func:`base_spans`; spans of kind ``context`` are words with a digit
    or an at sign (inside, not only at an end that is cut off) that touch none of them and that a pattern of at least
    LEAST_CONFIDENCE, seen around LEAST_SEEDS different seeds or more, surrounds. Patterns
    come from all texts; repeats of a text or an identifier count once. Null and
    empty texts have no spans. The text is the key, so null and repeated identifiers don't
    matter. Time grows in proportion to a text's length and matches, however many. An empty table gives an empty
    result; columns may have any names, and one called ``name`` (in any case) is replaced.
    """
    own = Columns(docs, [name])
    text = F.coalesce(F.col(own.at(text_col)), F.lit(""))
    marked = own.table.select(text.alias("text")).filter(F.rlike("text", F.lit("[0-9@]")))
    marked = marked.select("text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    marked = marked.select(F.md5("text").alias("key"), base_matches(F.col("text")).alias("base"), _words(F.col("found"), F.col("gaps")).alias("words"))
    flat = marked.select("key", F.explode(_instances(F.col("base"), F.col("words"))).alias("c")).select("key", "c.*")
    flat = flat.withColumn("patterns", F.array(F.concat_ws("|", F.lit("L"), "left"), F.concat_ws("|", F.lit("R"), "right"), F.concat_ws("|", F.lit("B"), "left", "right")))
    flat = written(flat.distinct(), "pii-candidates")

    edges = flat.select(F.explode("patterns").alias("pattern"), F.col("value").alias("instance"), "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = written(edges, "pii-graph")
    good = score_patterns(edges).filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")
    unseen = flat.filter(~F.col("seed") & F.rlike("value", F.lit("[0-9@]"))).select("key", F.col("value").alias("instance"), "start", "end", F.explode("patterns").alias("pattern"))
    unseen = _salted(unseen).join(_for_salts(good), ["pattern", "salt"])
    unseen = unseen.select("key", F.struct(F.lit(FOUND).alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("s"))
    unseen = unseen.groupBy("key").agg(F.collect_set("s").cast(Span).alias("more"))

    out = own.table.select(*own.kept, F.md5(text).alias("key"), base_spans(text).alias("base")).join(unseen, "key", "left")
    both = F.concat(F.col("base"), F.coalesce("more", F.array().cast(Span)))
    return out.withColumn("all", in_order(both, (*KINDS, FOUND))).select(*own.own(), F.col("all").alias(name))
