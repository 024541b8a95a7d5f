"""Expressions on URLs: hosts, identity, owners, admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from herald.functions.text import col

#: Query keys that only track where a visit came from, besides ``utm_*`` (fixed values).
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
_PARTS = r"^\s*(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def host(url: str | Column) -> Column:
    """Lower-case host without port and credentials; empty without one."""
    authority = F.regexp_replace(_part(col(url), 2), "^.*@", "")
    return F.lower(F.regexp_replace(authority, r":\d*$", ""))


def official_host(url: str | Column, domain: str) -> Column:
    """Whether the host is ``domain`` or below it."""
    h = host(url)
    return F.coalesce((h == domain.lower()) | F.endswith(h, F.lit("." + domain.lower())), F.lit(False))


def normalize_url(url: str | Column, domain: str = "") -> Column:
    """The URL by which pages are told apart.

    Lower-case host, https on the official domain, no default port, fragment,
    doubled or trailing slashes, no tracking keys, the rest of the query sorted
    by key and value.
    """
    u = col(url)
    h = host(u)
    scheme = F.lower(_part(u, 1))
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    if domain:
        scheme = F.when(official_host(u, domain), "https").otherwise(scheme)
    port = F.regexp_extract(_part(u, 2), r":(\d+)$", 1)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    netloc = F.when((port == "") | default, h).otherwise(F.concat(h, F.lit(":"), port))
    path = F.regexp_replace(_part(u, 3), "/{2,}", "/")
    path = F.when(F.regexp_like(path, F.lit("^/*$")), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(_part(u, 4), "&"), lambda p: p != F.lit(""))
    pairs = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("k"),
            F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")
        )
    )
    plain = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%20")))
    pairs = F.transform(
        pairs, lambda p: F.struct(F.coalesce(plain(p["k"]), p["k"]).alias("k"), F.coalesce(plain(p["v"]), p["v"]).alias("v"))
    )
    kept = F.filter(pairs, lambda p: ~(F.startswith(F.lower(p["k"]), F.lit("utm_")) | F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), netloc, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def notice_id(url: str | Column, domain: str, pattern: str, namespace: str) -> Column:
    """``namespace:id`` of a URL on exactly the official host whose path has ``pattern`` with the id as group 1; else null."""
    found = F.regexp_extract(_part(col(url), 3), pattern, 1)
    return F.when((host(url) == domain.lower()) & (found != ""), F.concat(F.lit(f"{namespace}:"), found))


def source_of(url: str | Column, fallback: str | Column, prefixes: list[tuple[str, str]]) -> Column:
    """The owner by the first path prefix that fits (any case), else ``fallback``."""
    path = F.lower(_part(col(url), 3))
    out = F.when(F.lit(False), "")
    for prefix, source in prefixes:
        out = out.when(F.startswith(path, F.lit(prefix)), source)
    return out.otherwise(col(fallback))


#: Address blocks that are not public, as (first, last) (fixed values).
_PRIVATE = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    (
        "192.168.0.0", "192.168.255.255"
    ), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def admission(url: str | Column) -> Column:
    """Null for a URL that may be fetched, else ``INVALID_URL`` or ``UNSAFE_URL``; names are not resolved."""
    u = col(url)
    scheme, authority, h = F.lower(_part(u, 1)), _part(u, 2), F.regexp_replace(host(u), r"\.$", "")
    quad = F.regexp_like(h, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    number = F.aggregate(F.transform(F.split(h, r"\."), lambda x: x.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    private = F.lit(False)
    for first, last in _PRIVATE:
        private = private | number.between(_number(first), _number(last))
    local = h.isin("localhost", "localhost.localdomain") | F.endswith(h, F.lit(".localhost"))
    return (F.when(u.isNull() | (F.trim(u) == ""), "INVALID_URL")
            .when(~scheme.isin("http", "https") | (h == ""), "INVALID_URL")
            .when(F.regexp_like(F.regexp_replace(authority, "^.*@", ""), F.lit(r":\d{6,}$|:[^\d\]]")), "INVALID_URL")
            .when(F.contains(authority, F.lit("@")) | local, "UNSAFE_URL")
            .when(quad & private, "UNSAFE_URL")
            .when(~quad & (F.contains(h, F.lit(":")) | ~F.contains(h, F.lit("."))), "UNSAFE_URL"))
