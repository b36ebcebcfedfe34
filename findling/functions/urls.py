"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First numbers of addresses that are not fetched, two addresses that are, and where videos live.
_INNER = (192, 172, 10, 127)
_ALLOWED = ("127.0.0.1", "0.0.0.0")
_VIDEO_SITE, _VIDEO_SHORT = "youtube.com", "youtu.be"
_VIDEO_LABELS = ("www", "m", "music")
_VIDEO_FOLDERS = ("embed", "v", "live", "shorts")
_VIDEO_CHARS = 11


def _rest(url: Column) -> Column:
    """What follows ``://``."""
    return F.substring_index(url, "://", -1)


def _authority(url: Column) -> Column:
    return F.split(_rest(url), "[/?#]")[0]


def _host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.lower(F.substring_index(F.substring_index(_authority(url), "@", -1), ":", 1))


def _is_address(host: Column) -> Column:
    """Four decimal numbers of at most 255 between dots."""
    parts = F.split(host, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.rlike(p, F.lit("^[0-9]{1,3}$")) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))


def is_valid(url: Column) -> Column:
    """An http(s) URL whose host isn't an inner IPv4 address."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    host = _host(url)
    first = F.substring_index(host, ".", 1).try_cast("int")
    inner = _is_address(host) & first.isin(*_INNER) & ~host.isin(*_ALLOWED)
    named = (host != "") & ~F.rlike(host, F.lit(r"\s"))
    return F.coalesce(F.contains(url, F.lit("://")) & scheme.isin("http", "https") & named & ~inner, F.lit(False))


def normalise(url: Column) -> Column:
    """``https://`` added where no scheme stands, one trailing slash cut."""
    u = F.trim(url)
    u = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(u, "/$", "")


def resolve(base: Column, href: Column) -> Column:
    """``href`` as it stands on the page ``base``: absolute, without fragment and dot segments; null where it names no page.

    Fragments alone, empty references, other schemes than http(s) and null are no pages.
    """
    to = F.substring_index(F.trim(href), "#", 1)
    scheme, authority = F.substring_index(base, "://", 1), _authority(base)
    path = F.regexp_extract(base, "://[^/?#]*([^?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), authority)
    whole = (
        F.when(F.rlike(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, to))
        .when(F.startswith(to, F.lit("?")), F.concat(root, path, to))
        .otherwise(F.concat(root, F.regexp_replace(path, "[^/]*$", ""), F.when(F.contains(path, F.lit("/")), F.lit("")).otherwise("/"), to))
    )
    folders = F.split(F.regexp_extract(whole, "://[^/?#]*([^?]*)", 1), "/")
    last = F.element_at(folders, -1)
    open_end = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    kept = F.aggregate(folders, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    clean = F.concat(F.regexp_extract(whole, "^([^:]*://[^/?#]*)", 1), F.array_join(F.concat(kept, open_end), "/"), F.regexp_extract(whole, r"(\?.*)$", 1))
    return F.when((to != "") & F.rlike(whole, F.lit("^https?://[^/?#]")), clean)


def youtube_id(url: Column) -> Column:
    """Identifier of the video, null for other URLs.

    The first folder of a short address, what follows the folder of a player, or the parameter ``v`` of a watch page.
    """
    site = F.regexp_replace(_authority(url), f"^({'|'.join(_VIDEO_LABELS)})[.]", "")
    rest = _rest(url)
    folders = F.split(F.regexp_extract(rest, "/([^?#]*)", 1), "/")
    given = F.filter(F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&"), lambda p: F.startswith(p, F.lit("v=")))
    first, second = F.get(folders, F.lit(0)), F.get(folders, F.lit(1))
    page = F.when(first == "watch", F.substring_index(F.get(given, F.lit(0)), "=", -1)).when(first.isin(*_VIDEO_FOLDERS), second).otherwise(first)
    video = F.substring(F.when(site == _VIDEO_SITE, page).when(site == _VIDEO_SHORT, first), 1, _VIDEO_CHARS)
    whole = F.rlike(video, F.lit(f"^[A-Za-z0-9_-]{{{_VIDEO_CHARS}}}$")) & ~F.rlike(url, F.lit(r"\s"))
    scheme = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1)).otherwise("https")
    return F.when(whole & scheme.isin("http", "https"), video)
