"""Column functions on urls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_key(url: Column) -> Column:
    """The registry key of a page: its url without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*", "")


def without_query(url: Column) -> Column:
    """The url up to the first question mark; a fragment before it stays."""
    return F.substring_index(url, "?", 1)


def authority(url: Column) -> Column:
    """Host part with port and user info, in its written case; empty for a url without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def site_key(domain: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(domain, ".", -2)


def same_domain(url: Column, domains: tuple[str, ...], include_subdomains: bool = True) -> Column:
    """Whether the url is on one of a few literal domains."""
    if not domains:
        return F.lit(False)
    host = authority(url)
    test = host.isin(*domains)
    if include_subdomains:
        test = reduce(lambda acc, d: acc | host.endswith("." + d), domains, test)
    return F.coalesce(test, F.lit(False))


def domain_suffixes(host: Column) -> Column:
    """All domains a host belongs to, itself first: a.b.c gives [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def extension(url: Column) -> Column:
    """Lower-case file extension of the url path, or an empty string; tar.gz counts as one."""
    path = F.regexp_extract(F.lower(url_key(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(/.*)?$", 1)
    return F.regexp_extract(path, r"\.(tar\.gz|[^./]+)$", 1)
