"""URL columns for absolute http and https addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query keys that only track, besides all that begin with utm_.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
_PARTS = r"^(?i)(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _PARTS, 1))


def host(url: Column) -> Column:
    """The host in lower case without a port; empty if the address is no absolute one."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _PARTS, 2)), r":\d+$", "")


def normalize_url(url: Column) -> Column:
    """Host in lower case, no fragment, no tracking keys, sorted keys, no slash at the end."""
    trimmed = F.trim(url)
    query = F.regexp_extract(trimmed, _PARTS, 4)
    key = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(key(p)).isin(*TRACKING) & ~F.lower(key(p)).startswith("utm_"))
    joined = F.array_join(F.array_sort(kept), "&")
    path = F.when(F.regexp_extract(trimmed, _PARTS, 3) == "", "/").otherwise(F.regexp_extract(trimmed, _PARTS, 3))
    whole = F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_extract(trimmed, _PARTS, 2)), path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(trimmed.rlike(_PARTS), F.regexp_replace(whole, "/$", ""))


def registrable_domain(name: Column, three_label_suffixes: list[str]) -> Column:
    """The last two labels, or three under the suffixes given."""
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(two.isin(*three_label_suffixes), three).otherwise(two)


def host_allowed(name: Column, hosts: list[str]) -> Column:
    """Equal to an allowed host or below one."""
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (name == h) | F.endswith(name, F.concat(F.lit("."), h)))


def url_rejection(url: Column, aggregators: list[str]) -> Column:
    """Why an address is refused: invalid, not https, or an aggregator's; null if it is not."""
    return F.when(url.isNull() | (host(url) == ""), "invalid").when(scheme(url) != "https", "not-https").when(host(url).isin(*aggregators), "aggregator")


def last_number(url: Column) -> Column:
    """The last path segment of six digits or more; empty without one."""
    found = F.regexp_extract_all(url, F.lit(r"/(\d{6,})(?=[/?#]|$)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
