"""Hosts, paths, parameters and links of page URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def parameters(url: Column) -> Column:
    """array of struct(k, v): the query's parameters in order, decoded no further."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))


def fingerprint(url: Column, without: list[str]) -> Column:
    """Host, path and sorted parameters but those named: equal for every order of parameters."""
    kept = F.array_sort(F.transform(F.filter(parameters(url), lambda p: ~p["k"].isin(without)), lambda p: F.concat(p["k"], F.lit("="), p["v"])))
    return F.concat(host(url), path(url), F.lit("?"), F.array_join(kept, "&"))


def encoded(x: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def resolved(link: Column, base: Column) -> Column:
    """A link as an address: relative to the page base that it was read on; steps up are left as they are."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_extract(base, r"^[^?#]*", 0), r"^(.*://[^/]*/.*/|.*://[^/]*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.rlike(r"^[?]"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), link))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), link))
    )


# Parameters that hold the address that a redirect leads to, that only say where a visit came from, and that hold a person.
REDIRECTS = ["url", "u", "target", "dest", "redirect"]
TRACKING = r"(?i)^(?:utm_.*|ref|fbclid|gclid|mc_.*|session(?:id)?)$"
PRIVATE = r"(?i)(?:email|phone|name|address|buyer|user)"


def unwrapped(url: Column) -> Column:
    """The address that a redirect's parameter holds, decoded; the URL itself if it has none."""
    targets = F.filter(parameters(url), lambda p: p["k"].isin(*REDIRECTS))
    inner = F.filter(F.transform(targets, lambda p: F.coalesce(F.try_url_decode(p["v"]), p["v"])), lambda v: v.rlike("^https?://"))
    return F.coalesce(F.get(inner, F.lit(0)), url)


def canonical_link(url: Column) -> Column:
    """A link without its fragment and without parameters of tracking or persons; the others stay in order."""
    kept = F.filter(parameters(url), lambda p: ~p["k"].rlike(TRACKING) & ~p["k"].rlike(PRIVATE))
    query = F.array_join(F.transform(kept, lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
