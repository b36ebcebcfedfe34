"""Cleaning, retention, keys, state and sync of documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.functions import checks

#: Entities that expressions find, with what replaces them and the check that a match must pass, in the order of replacement.
#: Where one class of characters ends another begins, so runs are taken whole and from their start: no match goes back over one,
#: begins in the middle of one, or recurses.
ENTITIES = (
    ("EMAIL_ADDRESS", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "<EMAIL_ADDRESS>", None),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "<IBAN>", checks.iban),
    ("IP_ADDRESS", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "<IP_ADDRESS>", checks.octets),
    ("PHONE_NUMBER", r"\+[0-9][0-9() .-]{8,}[0-9]", "<PHONE_NUMBER>", None),
    ("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", "<CREDIT_CARD>", checks.luhn),
    ("CRYPTO_WALLET", r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|(?i:bc1)[02-9A-Za-z]{11,71})\b", "<CRYPTO_WALLET>", checks.wallet),
)
SECRET = r"(?i)(?:password|secret|token|api_?key)[ ]*[:=]|AKIA[A-Z0-9]{16}|-----BEGIN [A-Z ]*PRIVATE KEY"


def detect(text: Column) -> Column:
    """A struct of the strings found for each entity; what fails its check is none."""
    found = lambda p, good: F.regexp_extract_all(text, F.lit(p), F.lit(0)) if good is None else F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(0)), good)
    return F.struct(*[found(p, good).alias(name) for name, p, _, good in ENTITIES])


def replaced(text: Column, pattern: str, by: str, good: Callable[[Column], Column]) -> Column:
    """``text`` with ``by`` for each match that is ``good``; the others stay as they are."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(between, found, lambda b, m: F.concat(b, F.when(m.isNull(), "").when(good(m), by).otherwise(m)))
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(parts, "")).otherwise(text)


def redact(text: Column) -> Column:
    """Entities replaced by their names; a failure fails the row's task instead of passing the text on.

    Each step's text is bound as an element, so the next one reads it instead of computing it again. All kinds but mail have
    a digit, so a text without one is done after the first step.
    """
    (_, mail, by, _), *others = ENTITIES

    def rest(t: Column) -> Column:
        for _, pattern, by, good in others:
            t = F.regexp_replace(t, F.lit(pattern), F.lit(by)) if good is None else F.get(F.transform(F.array(t), lambda x: replaced(x, pattern, by, good)), F.lit(0))  # noqa: B023
        return t

    first = F.array(F.regexp_replace(text, F.lit(mail), F.lit(by)))
    return F.get(F.transform(first, lambda t: F.when(F.rlike(t, F.lit("[0-9]")), rest(t)).otherwise(t)), F.lit(0))


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.filter(~F.coalesce(F.rlike(text_col, F.lit(SECRET)), F.lit(False)))


def expired(rows: DataFrame, time_col: str, days: int, as_of: Column) -> DataFrame:
    """Rows at or before ``as_of`` minus ``days``; 0 or fewer days keep everything."""
    return rows.filter((F.lit(days) > 0) & (F.col(time_col) <= as_of - F.make_dt_interval(F.lit(days))))


def retained(rows: DataFrame, time_col: str, days: int, as_of: Column) -> DataFrame:
    """What :func:`expired` leaves; rows without a time stay."""
    return rows.filter((F.lit(days) <= 0) | F.coalesce(F.col(time_col) > as_of - F.make_dt_interval(F.lit(days)), F.lit(True)))


def cache_key(prompt: Column, ids: Column, query: Column) -> Column:
    return F.sha2(F.concat(prompt, F.array_join(F.array_sort(ids), ""), query), 256)


#: Fixed value: the name space of domain names in RFC 4122.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """The UUID of version 5 of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def entity_id(workspace: Column, name: Column) -> Column:
    """The same for the same name in whatever case."""
    return uuid5(F.concat_ws(":", workspace, F.lower(name)))


def repeated_calls(calls: DataFrame, key_cols: Sequence[str], time_col: str, cooldown_s: int, order_col: str) -> DataFrame:
    """``is_repeat``: an equal call came at most ``cooldown_s`` before."""
    w = Window.partitionBy("call_key").orderBy(time_col, order_col)
    keyed = calls.withColumn("call_key", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]), 256))
    gap = F.unix_micros(F.col(time_col).cast("timestamp")) - F.unix_micros(F.lag(time_col).over(w).cast("timestamp"))
    return keyed.withColumn("is_repeat", F.coalesce(gap <= cooldown_s * 1_000_000, F.lit(False)))


def latest_state(events: DataFrame, key_col: str, time_col: str, order_col: str, cols: Sequence[str]) -> DataFrame:
    """The last event of each key: one aggregation, without a sort of the groups."""
    last = F.max(F.struct(time_col, order_col, *cols)).alias("last")
    return events.groupBy(key_col).agg(last).select(key_col, *[F.col(f"last.{c}").alias(c) for c in (time_col, *cols)])


def sync_difference(old: DataFrame, new: DataFrame, key_col: str, content_col: str) -> DataFrame:
    """``action`` of each key: add, replace, keep or remove, by a digest of the content."""
    a = old.select(key_col, F.sha2(F.coalesce(content_col, F.lit("")), 256).alias("was"))
    b = new.select(key_col, F.sha2(F.coalesce(content_col, F.lit("")), 256).alias("now"))
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("was") == F.col("now"), "keep").otherwise("replace")
    return a.join(b, key_col, "full").select(key_col, action.alias("action"))


def prune_failures(runs: DataFrame, key_col: str, failed: Column, order_cols: Sequence[str], most: int = 5) -> DataFrame:
    """Keys whose last ``most`` runs or more all failed."""
    good = F.max(F.when(~failed, F.struct(*order_cols))).alias("good")
    last = runs.groupBy(key_col).agg(good)
    since = runs.join(last, key_col).filter(failed & (F.col("good").isNull() | (F.struct(*order_cols) > F.col("good"))))
    return since.groupBy(key_col).agg(F.count("*").alias("failures")).filter(F.col("failures") >= most)


def json_value(text: Column, path: str) -> Column:
    """The value at ``a.b[0]['c']`` as text, objects as JSON, empty where there is none."""
    import re

    parts = re.findall(r"\[([^\]]*)\]|([^.\[\]]+)", path)
    steps = "".join(f"[{b}]" if b.isdigit() else f"['{b.strip(chr(39) + chr(34))}']" if b else f".{d}" for b, d in parts)
    return F.coalesce(F.get_json_object(text, f"$ {steps}".replace(" ", "")), F.lit(""))


def cost_text(tokens: Column, per_thousand: float = 0.0004) -> Column:
    total = tokens * F.lit(per_thousand) / 1000
    return F.when(total >= 0.01, F.concat(F.lit("$"), F.format_number(total, 2))).otherwise("< $0.01")


def parse_iso(text: Column) -> Column:
    """UTC timestamp of an ISO text with or without zone; null if it isn't one."""
    return F.try_to_timestamp(text)
