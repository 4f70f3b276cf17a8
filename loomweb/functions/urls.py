"""URL algebra: resolved, normalised and compared URLs as columns.

normalise(): what a crawl takes as the same page. identity(): keeps tracking parameters and runs of slashes.
node(): as normalise, but keeps runs of slashes. hygiene(): protocol, www and case of the path don't matter.
The exact forms are Arrow-batched functions of (url, base); normalise_expr is the form without Python, for absolute
http(s) URLs whose parameters need no re-encoding.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import BINARY, TRACKING

_TRACKING = frozenset(TRACKING)


def _join(url: str, base: str | None) -> str:
    try:
        return urljoin(base, url) if base else url
    except ValueError:
        return url


def _host(netloc: str, scheme: str) -> str:
    netloc = netloc.lower()
    port = {"http": ":80", "https": ":443"}[scheme]
    return netloc.removesuffix(port)


def _canonical(url: str, base: str | None, tracking: bool, collapse: bool) -> str:
    url = _join(url, base).strip()
    try:
        u = urlsplit(url)
    except ValueError:
        return url
    scheme = u.scheme.lower()
    if scheme not in ("http", "https"):
        return url
    path = re.sub(r"/+", "/", u.path) if collapse else u.path
    if len(path) > 1:
        path = path.rstrip("/") or ("/" if collapse else "")
    pairs = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if tracking or k.lower() not in _TRACKING)
    return urlunsplit((scheme, _host(u.netloc, scheme), path or "/", urlencode(pairs), ""))


def normalise_one(url: str, base: str | None = None) -> str:
    return _canonical(url, base, tracking=False, collapse=True)


def identity_one(url: str, base: str | None = None) -> str:
    return _canonical(url, base, tracking=True, collapse=False)


def node_one(url: str, base: str | None = None) -> str:
    return _canonical(url, base, tracking=False, collapse=False)


def hygiene_one(url: str) -> str:
    u = urlsplit(url.strip())
    host = u.netloc.lower().removesuffix(":80").removesuffix(":443").removeprefix("www.")
    path = re.sub(r"/+", "/", u.path or "/").lower()
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    pairs = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in _TRACKING)
    return urlunsplit(("https", host, path, urlencode(pairs), ""))


def _two(f):
    def of(url: Column, base: Column | None = None) -> Column:
        def run(urls: pd.Series, bases: pd.Series) -> pd.Series:
            return pd.Series([f(u, b if isinstance(b, str) else None) if isinstance(u, str) else None for u, b in zip(urls, bases, strict=True)], dtype=object)

        return F.pandas_udf(run, "string")(url, base if base is not None else F.lit(None).cast("string"))

    return of


normalise, identity, node = _two(normalise_one), _two(identity_one), _two(node_one)
resolve = _two(lambda u, b: _join(u, b))
hygiene = _two(lambda u, b: hygiene_one(u))


def host(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without its port; an empty string if it has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def root_domain(h: Column) -> Column:
    """The last two labels of a host."""
    parts = F.split(h, r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(h)


def same_domain(url: Column, base: Column, subdomains: bool = False) -> Column:
    """Relative URLs, and those on the base's host; with subdomains, those under its last two labels."""
    h, b = host(url), host(base)
    same = (h == "") | (h == b)
    if subdomains:
        same = same | (h == root_domain(b)) | F.endswith(h, F.concat(F.lit("."), root_domain(b)))
    return same


def crawlable(url: Column) -> Column:
    """http, https or relative, and not a path that ends as a file that isn't a page."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    bare = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return scheme.isin("", "http", "https") & ~bare.rlike("(" + "|".join(re.escape(x) for x in BINARY) + ")$")


def link_class(url: Column, base: Column, subdomains: bool = False) -> Column:
    """INTERNAL, EXTERNAL or SPECIAL (other schemes, and fragments of the page itself)."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    special = F.trim(url).startswith("#") | ~scheme.isin("", "http", "https")
    absolute = F.when(F.trim(url).startswith("//"), F.concat(F.lit("http:"), F.trim(url))).otherwise(F.trim(url))
    return F.when(special, "SPECIAL").when(same_domain(absolute, base, subdomains), "INTERNAL").otherwise("EXTERNAL")


def normalise_expr(url: Column) -> Column:
    """normalise() without Python: for absolute URLs whose parameters need no re-encoding."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    authority = F.regexp_replace(authority, F.when(scheme == "http", ":80$").otherwise(":443$"), F.lit(""))
    p = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "(.)/$", "$1")
    kept = F.array_sort(F.filter(F.split(query_of(url), "&"), lambda x: (x != "") & ~F.lower(F.regexp_extract(x, "^([^=]*)", 1)).isin(*TRACKING)))
    q = F.array_join(kept, "&")
    return F.concat(scheme, F.lit("://"), authority, F.when(p == "", "/").otherwise(p), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
