"""Crawls over stored pages: a link table, and a breadth-first frontier on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.functions import urls
from findling.storage import release, written

#: An anchor's reference, in either kind of quotes; a tag ends before the next one begins, so time is linear.
_ANCHOR = r"""<[aA]\s(?:[^<>]*?\s)?[hH][rR][eE][fF]\s*=\s*("[^"<>]*"|'[^'<>]*')"""


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, position) of each page's anchors, absolute and without fragments.

    Pages of one address count as one; of several anchors to an address the first has its position. Null
    addresses and texts have no links.
    """
    found = F.regexp_extract_all(html_col, F.lit(_ANCHOR), F.lit(1))
    src = F.substring_index(F.col(url_col), "#", 1)
    out = pages.filter(F.col(url_col).isNotNull()).select(src.alias("src"), F.posexplode(found).alias("position", "href"))
    # An anchor of several thousand pages' template is resolved once a page, never expanded into pairs.
    dst = urls.resolve(F.col("src"), F.expr("substring(href, 2, length(href) - 2)"))
    return out.select("src", dst.alias("dst"), "position").filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.min("position").alias("position"))


def scope_of(start: str) -> str:
    """The folder of ``start``, under which a crawl stays."""
    scheme, _, rest = start.partition("://")
    host, slash, path = rest.partition("/")
    return f"{scheme}://{host}{slash}{path.rpartition('/')[0]}"


def crawl(links: DataFrame, start: str, depth: int, most: int | None = None, scope: str | None = None) -> DataFrame:
    """(url, depth, place) of what is found within ``depth`` links of ``start``, itself included, in the order of finding.

    ``links`` are (src, dst, position); addresses that don't begin with ``scope`` (by default the folder of ``start``)
    aren't followed. A level stands in the order of the pages that lead to it, then of their anchors, then by address,
    and ``most`` cuts exactly there; so with ``most`` the frontier and what was seen are bounded by it, and each level is
    a top-k. Without, ``place`` is null, and both are tables of any size, joined on the address. Each level is written
    once: a lost executor costs none of the levels before.
    """
    if depth < 0 or (most is not None and most < 1):
        raise ValueError("depth must not be negative and most must be positive")
    spark = links.sparkSession
    ways = links.filter(F.startswith("dst", F.lit(scope_of(start) if scope is None else scope))).select("src", "dst", "position")
    schema = "url string, depth int, place long"
    seen = written(spark.createDataFrame([(start, 0, None if most is None else 0)], schema), "crawl")
    count = 1
    for step in range(1, depth + 1):
        if most is not None and count >= most:
            break
        front = seen.filter(F.col("depth") == step - 1).select(F.col("url").alias("src"), "place")
        reached = front.join(ways, "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("place", "position")).alias("by"))
        fresh = reached.join(seen.select("url"), "url", "left_anti")
        if most is None:
            level = fresh.select("url", F.lit(step).alias("depth"), F.lit(None).cast("long").alias("place"))
        else:
            # At most ``most`` rows, so ranking them in one task is bounded.
            first = fresh.orderBy("by.place", "by.position", "url").limit(most - count)
            ranked = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("by.place", "by.position", "url"))).alias("rows"))
            rows = ranked.select(F.posexplode("rows").alias("i", "row"))
            level = rows.select("row.url", F.lit(step).alias("depth"), (F.col("i") + F.lit(count)).cast("long").alias("place"))
        level = written(level, "crawl-level")
        more = level.count()
        if not more:
            release(level)
            break
        grown = written(seen.unionByName(level), "crawl")
        release(seen, level)
        seen, count = grown, count + more
    return seen
