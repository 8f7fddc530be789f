"""What a catalogue's page URL stands for, its fingerprint, and the requests that read its lots.

``site`` is the catalogue's domain; its subdomains count too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

#: Page size of the catalogue's services, at most.
PAGE_SIZE = 100


def on_site(host: Column, site: str) -> Column:
    return (host == site) | host.endswith("." + site)


def bare_path(url: Column) -> Column:
    """The path without slashes at its end; a slash if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(U.path(url), "/+$", ""), F.lit("")), F.lit("/"))


def decoded(url: Column) -> Column:
    """array of struct(k, v): the parameters in order, decoded; what cannot be decoded stays as it is."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(U.parameters(url), lambda p: F.struct(plain(p["k"]).alias("k"), plain(p["v"]).alias("v")))


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter; empty if it has none."""
    return F.coalesce(F.get(F.filter(decoded(url), lambda p: p["k"] == name), F.lit(0))["v"], F.lit(""))


def route(url: Column, site: str) -> Column:
    """struct(supported, kind, host, path, auction_id, category_id, state_prefix, site_type, status, reason) of a page.

    Kinds: watchlist, currentbids-winning, currentbids-outbid, pastbids, pastwatchlist, catalog, livecatalog, lot, search,
    unsupported. A page below a state's name has that as its prefix; its catalogue, lot and search pages are of site type 2.
    """
    host, path = U.host(url), bare_path(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    low = F.transform(parts, F.lower)
    account, lots, lot = (F.array_position(low, F.lit(n)).cast("int") for n in ("account", "lots", "lot"))
    either = F.transform(low, lambda p: p.isin("catalog", "livecatalog"))
    sale = F.array_position(either, F.lit(True)).cast("int")
    after = lambda i: F.get(low, i)  # noqa: E731  what follows the i-th part, from 1
    number = lambda i: F.when(F.coalesce(F.get(parts, i), F.lit("")).rlike(r"^\d+$"), F.get(parts, i))
    prefix = lambda i: F.when(i > 1, F.array_join(F.slice(parts, 1, F.greatest(i - 1, F.lit(0))), "/"))
    page = F.when(account > 0, after(account))
    status = F.upper(F.trim(parameter(url, "status")))
    none, zero, two = F.lit(None).cast("string"), F.lit(0), F.lit(2)

    def result(supported: bool, kind: Column | str, reason: Column = none, auction: Column = none, category: Column = none, state: Column = none, kind_of_site: Column = zero, bids: Column = none) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            F.lit(supported).alias("supported"), kind.alias("kind"), host.alias("host"), path.alias("path"), auction.alias("auction_id"), category.alias("category_id"),
            state.alias("state_prefix"), kind_of_site.alias("site_type"), bids.alias("status"), reason.alias("reason"),
        )

    home = F.get(low, F.lit(0))
    catalogue = after(sale - 1)
    missing = F.when(number(sale).isNull(), F.concat(F.lit("missing "), catalogue, F.lit(" auction id")))
    return (
        F.when(~F.coalesce(on_site(host, site), F.lit(False)), result(False, "unsupported", F.lit("unsupported host")))
        .when(page == "watchlist", result(True, "watchlist", state=prefix(account)))
        .when((page == "currentbids") & status.isin("WINNING", "OUTBID"), result(True, F.concat(F.lit("currentbids-"), F.lower(status)), state=prefix(account), bids=status))
        .when(page == "currentbids", result(False, "unsupported", F.lit("current bids requires WINNING or OUTBID status"), state=prefix(account)))
        .when(page == "pastbidsm", result(True, "pastbids", state=prefix(account)))
        .when(page == "pastwatchlist", result(True, "pastwatchlist", state=prefix(account)))
        .when(sale > 0, result(True, catalogue, missing, auction=number(sale), state=prefix(sale), kind_of_site=F.when(sale > 1, two).otherwise(zero)))
        .when(home == "lot", result(True, "lot"))
        .when(home == "lots", result(True, "search", category=number(F.lit(1))))
        .when(lots > 1, result(True, "search", category=number(lots), state=prefix(lots), kind_of_site=two))
        .when(lot > 1, result(True, "lot", state=prefix(lot), kind_of_site=two))
        .otherwise(result(False, "unsupported", F.lit("unsupported route")))
    )


def canonical(url: Column, route: Column, without: tuple[str, ...] = ("apage",)) -> Column:
    """A page's fingerprint: JSON of host, path, kind, ids and the sorted parameters but those named (whatever their case).

    Parameters are in order of name and value, small letters before capitals where nothing else differs.
    """
    kept = F.filter(decoded(url), lambda p: ~F.lower(p["k"]).isin(*without))
    order = F.array_sort(F.transform(kept, lambda p: F.struct(F.lower(p["k"]).alias("a"), F.lower(p["v"]).alias("b"), p["k"].alias("k"), p["v"].alias("v"))))
    filters = F.transform(order, lambda p: F.array(p["k"], p["v"]))
    return F.to_json(F.struct(route["host"].alias("host"), route["path"].alias("path"), route["kind"].alias("kind"), route["auction_id"].alias("auctionId"), route["category_id"].alias("categoryId"), filters.alias("filters")), {"ignoreNullFields": "false"})


def statuses(url: Column, kind: Column) -> Column:
    """Distinct upper-case values of all status parameters, split at commas; what the kind of page stands for if there are none."""
    values = F.flatten(F.transform(F.filter(decoded(url), lambda p: p["k"] == "status"), lambda p: F.split(p["v"], ",")))
    values = F.array_distinct(F.filter(F.transform(values, lambda v: F.upper(F.trim(v))), lambda v: v != ""))
    usual = F.when(kind == "catalog", F.array(F.lit("ALL"))).when(kind == "livecatalog", F.array(F.lit("OPEN"))).otherwise(F.array(F.lit("OPEN"), F.lit("UPCOMING")))
    return F.when(F.size(values) > 0, values).otherwise(usual)


def is_on(url: Column, name: str) -> Column:
    return parameter(url, name).rlike("(?i)^(1|true|yes|on)$")


def archived(url: Column) -> Column:
    return is_on(url, "archive") | is_on(url, "isArchive") | parameter(url, "filter").rlike("(?i)(?:^|[-_])archived?(?:$|[-_])")


def sort_code(x: Column) -> Column:
    """Upper case, other signs than letters, digits and underscores as underscores; LOT_NUMBER for none."""
    return F.coalesce(F.nullif(F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9_]", "_"), F.lit("")), F.lit("LOT_NUMBER"))


def country_code(x: Column) -> Column:
    country = F.nullif(F.trim(x), F.lit(""))
    return F.when(country.rlike("(?i)^(?:united states(?: of america)?|usa|us)$"), "USA").when(country.rlike("(?i)^(?:canada|can)$"), "CAN").otherwise(country)


def _text(url: Column, name: str) -> Column:
    return F.nullif(F.trim(parameter(url, name)), F.lit(""))


def _number(x: Column) -> Column:
    return F.nullif(x, F.lit("")).try_cast("double")


def search_request(url: Column, route: Column, page: Column, size: Column) -> Column:
    """struct of the id search's request for one page: query, auction_id, category_id, country, zip, radius, page, size, shipping, sort_order, status, site_type."""
    zip_code = _text(url, "zip")
    order = F.coalesce(F.nullif(parameter(url, "s"), F.lit("")), F.when(route["kind"] == "catalog", "LOT_NUMBER").otherwise("NO_ORDER"))
    return F.struct(
        _text(url, "q").alias("query"), _number(route["auction_id"]).alias("auction_id"), _number(route["category_id"]).alias("category_id"), country_code(parameter(url, "countryname")).alias("country"),
        zip_code.alias("zip"), F.when(zip_code.isNotNull(), F.coalesce(_number(parameter(url, "miles")), F.lit(50.0))).alias("radius"), F.greatest(F.lit(1), page.cast("int")).alias("page"),
        F.greatest(F.lit(1), F.least(F.lit(PAGE_SIZE), F.coalesce(F.nullif(size.cast("int"), F.lit(0)), F.lit(PAGE_SIZE)))).alias("size"), is_on(url, "shippingoffered").alias("shipping"),
        sort_code(order).alias("sort_order"), statuses(url, route["kind"]).alias("status"), route["site_type"].alias("site_type"),
    )


def page_variables(url: Column, route: Column, page: Column, size: Column, ids: Column | None = None) -> Column:
    """struct of the lot scan's variables for one page. With ids (array of long) records are read by id: every filter is null then."""
    ids = F.lit(None).cast("array<bigint>") if ids is None else ids
    by_id = F.coalesce(F.size(ids) > 0, F.lit(False))
    unless = lambda x: F.when(~by_id, x)
    states = statuses(url, route["kind"])
    return F.struct(
        unless(_number(route["auction_id"])).alias("auction_id"), F.greatest(F.lit(1), page.cast("int")).alias("page_number"), F.greatest(F.lit(1), F.least(F.lit(PAGE_SIZE), size.cast("int"))).alias("page_length"),
        unless(_number(route["category_id"])).alias("category"), unless(_text(url, "q")).alias("search_text"), unless(_text(url, "zip")).alias("zip"), unless(_number(parameter(url, "miles"))).alias("miles"),
        (~by_id & is_on(url, "shippingoffered")).alias("shipping_offered"), unless(_text(url, "countryname")).alias("country_name"),
        F.when(by_id | (F.size(states) != 1), F.lit("ALL")).otherwise(F.get(states, F.lit(0))).alias("status"), sort_code(parameter(url, "s")).alias("sort_order"), unless(F.upper(_text(url, "filter"))).alias("filter"),
        archived(url).alias("is_archive"), F.when(by_id, ids).alias("ids"),
    )
