"""URL rules found through their rarest literal token.

A rule is written in the public syntax of ad-block lists: ``||`` anchors at a label of
the host, ``|`` at the start or end, ``*`` stands for anything and ``^`` for a separator.
Each rule is indexed under that of its literal tokens which the fewest URLs hold; the
tokens of a URL fetch candidate rules, and only those run their regular expression.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.common import Columns
from findling.storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tasks that share the URLs of a token.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``kind`` ``site`` decides by the longest match, ``pattern`` blocks where no site rule fits."""

    text: str
    action: str
    kind: str = "pattern"

    @property
    def regex(self) -> str:
        if self.kind == "site":
            host, slash, path = self.text.partition("/")
            return rf"^(?:[^/]*\.)?{_quote(host)}{_quote(slash + path)}"
        out, body = "", self.text
        if body.startswith("||"):
            out, body = r"^(?:[^/]*\.)?", body[2:]
        elif body.startswith("|"):
            out, body = "^", body[1:]
        end = body.endswith("|")
        # A star at an open end says nothing, and would try every place.
        body = body if out else body.lstrip("*")
        body = body if end else body.rstrip("*")
        for c in body[:-1] if end else body:
            out += {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or _quote(c)
        return out + ("$" if end else "")

    @property
    def tokens(self) -> list[str]:
        """Runs of ASCII letters and digits that must stand whole in any URL that fits."""
        body, found = self.text, []
        if self.kind == "site":
            left, right = True, False
        else:
            left, right = body.startswith("|"), body.endswith("|")
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            before, after = body[: m.start()], body[m.end() :]
            bounded = (before[-1] != "*" if before else left) and (after[0] != "*" if after else right)
            if bounded:
                found.append(m[0])
        return found


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty for null or without ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``pattern``.

    The longest fitting site rule decides (of equally long ones a blocking one) and is
    named in ``rule``; else a fitting pattern rule decides and is named in ``pattern``
    (blocking first, then by text); else ``default`` holds. Null, empty and malformed
    URLs have empty host and path and get ``default``. Repeated rows and URLs get the same
    verdict; a URL is judged once however many rows hold it, and URLs of any length are read whole. An empty table or
    rule list works. Columns may have any names; those called like the added ones, in any case, are replaced.

    Rules are joined by token; Spark broadcasts them if their written table is below its bound. Beyond it, rules and
    URLs are dealt by token and a hash of the URL, with each rule once for each of SALTS values, so a frequent token, or
    none, which rules without literal tokens have, meets its URLs in many tasks.
    """
    spark = pages.sparkSession
    own = Columns(pages, ("host", "path", "rule", "verdict", "pattern"))
    url = F.col(own.at(url_col))
    host, path = host_and_path(url)
    urls = own.table.select(url.alias("url")).filter(F.col("url").isNotNull()).distinct()
    host_u, path_u = host_and_path(F.col("url"))
    urls = urls.select("url", F.concat(host_u, path_u).alias("target"))

    listed = sorted(set(rules), key=lambda r: (r.kind, r.text, r.action))
    known = sorted({t for r in listed for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.col("target"), F.lit("[A-Za-z0-9]+"), F.lit(0)))
    salt = F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int").alias("salt")
    seen = urls.select("url", "target", salt, F.explode(F.array_append(tokens, F.lit(""))).alias("token"))
    counts: dict[str, int] = {}
    if known:
        # One count for each token of the rules, so the driver gets what the rule list bounds.
        vocabulary = _listed(spark, [(t,) for t in known], "token string", "url-tokens")
        counts = {r["token"]: r["n"] for r in seen.join(vocabulary, ["token", "salt"]).groupBy("token").agg(F.count("*").alias("n")).collect()}
    index = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", r.regex, r.kind, r.text, r.action) for r in listed]
    index = _listed(spark, index, "token string, regex string, kind string, rule string, action string", "url-rules")
    hits = seen.join(index, ["token", "salt"]).filter(F.expr("target RLIKE regex"))
    order = F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("b"), F.col("rule").alias("r"), F.col("action").alias("a"))
    fallback = F.struct((F.col("action") != "block").alias("b"), F.col("rule").alias("r"), F.col("action").alias("a"))
    judged = hits.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "site", order)).alias("site"),
        F.min(F.when(F.col("kind") == "pattern", fallback)).alias("block"),
    )
    joined = own.table.join(judged, url == F.col("url"), "left")
    return joined.select(
        *own.own(),
        host.alias("host"),
        path.alias("path"),
        F.col("site.r").alias("rule"),
        F.coalesce(F.col("site.a"), F.col("block.a"), F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("block.r")).alias("pattern"),
    )


def _listed(spark: SparkSession, rows: list[tuple], schema: str, name: str) -> DataFrame:
    """What the rule list bounds, written so that its size is known, once for each salt."""
    return written(spark.createDataFrame(rows, schema), name).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
