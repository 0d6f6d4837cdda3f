"""Url functions.

The column functions cover absolute http(s) urls and the common forms of relative reference and stay in the JVM. What
they cannot express, dot segments and international names, is what :func:`resolved_any` (an Arrow function) is for.
A url that cannot be parsed gives null.
"""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import col, trimmed

PARTS = r"(?is)^\s*(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"

# Extensions of files that are not pages.
NOT_PAGES = (
    ".txt .xml .json .rss .atom .pdf .csv .zip .gz .svg .png .jpg .jpeg .gif .webp .ico .css .js .mjs .cjs .map .woff .woff2 .ttf .eot .mp3 .mp4 .webm .mov .avi .m4a"
).split()


def once(value: Column, make) -> Column:
    """``make(value)`` with ``value`` computed once per row, however often ``make`` names it."""
    return F.transform(F.array(value), make)[0]


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(url: Column | str) -> Column:
    return F.lower(_part(col(url), 1))


def normal_host(host: Column | str) -> Column:
    """Trimmed, lower case, without one closing dot and a leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(host)), r"\.$", ""), r"^www\.", "")


def host(url: Column | str) -> Column:
    """Host without user and port; null if the url is not absolute http(s)."""
    url = col(url)
    bare = F.regexp_replace(F.regexp_replace(_part(url, 2), r"^.*@", ""), r":\d*$", "")
    return F.when(url.rlike(PARTS) & (bare != ""), F.lower(bare))


def same_site(a: Column | str, b: Column | str) -> Column:
    """Equal hosts, or one is a subdomain of the other; blank hosts match nothing."""
    a, b = normal_host(a), normal_host(b)
    match = (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))
    return F.coalesce((a != "") & (b != "") & match, F.lit(False))


def _authority(url: Column) -> Column:
    """Normal host, with the port unless it is the scheme's own."""
    port = F.regexp_extract(_part(url, 2), r":(\d+)$", 1)
    own = ((scheme(url) == "https") & (port == "443")) | ((scheme(url) == "http") & (port == "80"))
    return F.concat(normal_host(host(url)), F.when((port == "") | own, "").otherwise(F.concat(F.lit(":"), port)))


def path(url: Column | str) -> Column:
    p = _part(col(url), 3)
    return F.when(p == "", "/").otherwise(p)


def comparable(url: Column | str, strip_slash: bool = True) -> Column:
    """Key that equivalent urls share: normal host, no default port, no fragment, one closing slash less."""

    def key(u: Column) -> Column:
        p = path(u)
        if strip_slash:
            p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
        return F.when(host(u).isNotNull(), F.concat(scheme(u), F.lit("://"), _authority(u), p, _part(u, 4)))

    return once(col(url), key)


def crawl_url(url: Column | str) -> Column:
    """As :func:`comparable`, closing slash kept."""
    return comparable(url, strip_slash=False)


def site_url(url: Column | str) -> Column:
    """A site's root key: https whatever was given (and if nothing was), normal host, no fragment or closing slashes."""
    url = trimmed(url)
    given = F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.regexp_replace(url, r"(?i)^http://", "https://")).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.regexp_replace(crawl_url(given), r"/+$", ""), r"/+(\?)", "$1")


def resolved(href: Column | str, base: Column | str) -> Column:
    """``href`` as an absolute url; null for blanks, other schemes and what only the Arrow form can resolve."""
    base = col(base)

    def absolute(h: Column) -> Column:
        root = F.concat(scheme(base), F.lit("://"), _part(base, 2))
        folder = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
        return (
            F.when(h.rlike(r"(?i)^https?://"), h)
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
            .when(h.startswith("/"), F.concat(root, h))
            .when(h.startswith("?"), F.concat(root, path(base), h))
            .when(h.startswith("#") | (h == ""), F.regexp_replace(base, "#.*$", ""))
            .otherwise(F.concat(root, folder, h))
        )

    return once(once(trimmed(href), absolute), lambda u: F.when(host(u).isNotNull(), u))


def comparable_ref(href: Column | str, base: Column | str) -> Column:
    return comparable(resolved(href, base))


def equivalent(a: Column | str, b: Column | str, base: Column | str) -> Column:
    """Equal keys, or where one has none, equal strings but for one closing slash."""
    bare = lambda c: F.regexp_replace(col(c), "/$", "")
    return F.coalesce(comparable_ref(a, base) == comparable_ref(b, base), bare(a) == bare(b), F.lit(False))


def equivalent_sites(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(site_url(a) == site_url(b), F.lit(False))


def bare_slash(url: Column | str) -> Column:
    """Only one closing slash removed: the key of language alternates."""
    return F.regexp_replace(col(url), "/$", "")


def lenient(url: Column | str) -> Column:
    """:func:`comparable`, or the url without a closing slash where that is null."""
    return F.coalesce(comparable(url), bare_slash(url))


def is_page(url: Column | str) -> Column:
    """No file extension, or one that is not of a known non-page kind; false for an invalid url."""
    last = F.lower(F.regexp_extract(path(url), r"([^/]*)$", 1))
    extension = F.regexp_extract(last, r"(\.[^.]+)$", 1)
    return F.coalesce(host(url).isNotNull() & ~extension.isin(*NOT_PAGES), F.lit(False))


def segments(url: Column | str) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def group(url: Column | str) -> Column:
    """First path segment, or ``root``."""
    return F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit("root"))


def query_names(url: Column | str) -> Column:
    """Parameter names in order, repeats included."""
    query = F.substring(_part(col(url), 4), 2, 1 << 20)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.element_at(F.split(p, "="), 1))


def sitemap_url(raw: Column | str, site: Column | str) -> Column:
    """A sitemap reference as an absolute url of the site: relative ones resolved, host without ``www.``, no fragment; null
    if it is blank or not http(s)."""
    text = trimmed(col(raw))
    full = resolved(text, F.concat(site_url(site), F.lit("/")))

    def parts(u: Column) -> Column:
        at = F.when(path(u) == "", "/").otherwise(path(u))
        return F.when(scheme(u).isin("http", "https"), F.concat(scheme(u), F.lit("://"), normal_host(host(u)), F.regexp_extract(u, r"(?s)^[^/?#]*//[^/?#]*?(:\d+)?(?:[/?#]|$)", 1), at, F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1)))

    return F.when(text != "", once(full, parts))


def query_map(url: Column | str) -> Column:
    """Decoded parameters by name: of repeated names the last value, in the place of the first."""
    query = F.substring(_part(col(url), 4), 2, 1 << 20)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    value = lambda p: F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    names = F.transform(pairs, lambda p: decoded(F.element_at(F.split(p, "="), 1)))
    values = F.transform(pairs, lambda p: decoded(value(p)))
    last = lambda n: F.element_at(F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda e: e["n"] == n), -1)["v"]
    kept = F.array_distinct(names)
    return F.map_from_arrays(kept, F.transform(kept, last))


def token_words(url: Column | str) -> Column:
    """Words of the path for keyword use; a malformed escape anywhere gives none."""
    decoded = F.transform(segments(url), lambda s: F.try_url_decode(s))
    words = F.split(F.lower(F.regexp_replace(F.array_join(decoded, " "), r"[^a-zA-Z0-9_-]", " ")), r"[\s_-]+")
    return F.when(F.exists(decoded, lambda s: s.isNull()), F.array().cast("array<string>")).otherwise(F.filter(words, lambda w: w != ""))


def resolve_text(href: str | None, base: str | None) -> str | None:
    """Absolute, percent-encoded form of ``href``; null if there is none."""
    if href is None:
        return None
    try:
        whole = urlsplit(urljoin(base, href.strip()) if base else href.strip())
        if whole.scheme.lower() not in ("http", "https") or not whole.hostname:
            return None
        name = whole.hostname.encode("idna").decode() if not whole.hostname.isascii() else whole.hostname
        port = f":{whole.port}" if whole.port else ""
        safe = "%/:;@&=+$,!~*'()-._"
        query = f"?{quote(whole.query, safe=safe + '?')}" if whole.query else ""
        return f"{whole.scheme.lower()}://{name.lower()}{port}{quote(whole.path, safe=safe) or '/'}{query}"
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def resolved_any(href: pd.Series, base: pd.Series) -> pd.Series:
    """Full resolution: dot segments, international hosts and paths. For what :func:`resolved` leaves null."""
    return pd.Series([resolve_text(h, b) for h, b in zip(href, base)], dtype=object)
