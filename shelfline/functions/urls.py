"""URLs as texts: product links, page identity, next pages, search queries.

URLs are split by regular expressions: the parsers among Spark's functions
refuse what browsers accept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.js import WHITE, decoded, either, filled, group, let, squeeze, trim
from shelfline.functions.lexicon import VOLATILE_PARAMS, VOLATILE_PREFIXES

# The shops in the order of their registration, their domains,
# whether they can be read, and the parameters that hold a search.
SITES = {
    "Amazon": (["amazon.in", "amazon.com"], True, ["k"]),
    "Flipkart": (["flipkart.com"], True, ["q"]),
    "Meesho": (["meesho.com"], True, ["q"]),
    "Myntra": (["myntra.com"], False, ["q", "search"]),
}
HOME = "https://www.amazon.in"
_ABSOLUTE = r"(?i)^(https?)://([^/:?#\\]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"
_PRODUCT = r"(?i)/(?:dp|gp/product|product)/([A-Z0-9]{10})"
_PRODUCT_LINK = r"(?i)/dp/|/gp/product/|/gp/aw/|/exec/obidos/"
_REVIEW_LINK = r"(?i)product-reviews|customer-reviews|/review/"
_ACCOUNT_LINK = r"(?i)/gp/cart|/gp/huc|/hz/cart|/gp/css|/wishlist|/list/|/gp/buy|/ap/signin|/gp/your-account|/gp/registry"
_SEARCH_PARAM = r"(?i)[?&#](?:k|rh|page|pg|bbn|i|rn|ref|__mk|dchild)="


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute http(s) URL, or null."""
    return F.lower(group(url, _ABSOLUTE, 2))


def site_of_host(host: Column) -> Column:
    """The first shop of which ``host`` is a domain, with or without "www.";
    other subdomains are none of it."""
    names = {}
    for name, (domains, _, _) in SITES.items():
        for d in domains:
            names.setdefault(d, name)
            names.setdefault(f"www.{d}", name)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.element_at(table, F.coalesce(host, F.lit("")))


def site_of(url: Column) -> Column:
    return site_of_host(host_of(url))


def site_name(url: str | None) -> str | None:
    """As :func:`site_of`, of one URL."""
    found = re.match(_ABSOLUTE, url or "")
    host = re.sub(r"^www\.", "", found.group(2).lower()) if found else None
    return next((name for name, (domains, _, _) in SITES.items() if host in domains), None)


def is_supported(url: Column) -> Column:
    """Whether the URL's host is a shop's, readable or not."""
    return site_of(url).isNotNull()


def is_search_page(url: Column, site: Column) -> Column:
    """Whether a URL is a search page by the rules of ``site``."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(site == "Amazon", u.contains("/s?") | u.contains("/s/") | u.rlike("[?&#]k="))
        .when(site == "Flipkart", u.contains("/search?") | u.contains("/pr?") | u.rlike("[?&#]q=") | u.rlike(r"page=\d+"))
        .when(site == "Meesho", u.contains("/search?") | u.rlike("[?&#]q=") | u.contains("/pl/"))
        .otherwise(False)
    )


def product_id_in(url: Column) -> Column:
    """The ten-character id of a product URL, in upper case, or null."""
    return F.upper(group(url, _PRODUCT))


def product_url(url: Column) -> Column:
    """The canonical form of a product link; of other URLs the path without
    trailing slashes; null for an empty one."""

    def of(full: Column) -> Column:
        path = F.when(full.rlike(_ABSOLUTE), F.substring_index(F.regexp_replace(F.regexp_extract(full, _ABSOLUTE, 4), r"\A\z", "/"), "/ref=", 1))
        return let(path, lambda path: F.coalesce(F.concat(F.lit(f"{HOME}/dp/"), product_id_in(path)), F.regexp_replace(F.coalesce(path, F.substring_index(full, "?", 1)), r"/+\z", "")))

    # An empty link is null before it is looked at.
    return let(F.when(filled(url), F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(HOME), url))), of)


def with_host(href: Column, host: str) -> Column:
    """A link that is not absolute, after ``host``; null for an empty one."""
    return F.when(filled(href), F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(host), href)))


def flipkart_id(href: Column) -> Column:
    pid = group(href, r"(?i)[?&]pid=([^&]+)")
    return F.upper(F.coalesce(pid, group(href, r"(?i)/p/(itm[^/?]*)")))


def meesho_id(href: Column) -> Column:
    """The parameter pid, the segment after the last "/p/", or after "/s/p/"."""
    last = F.when(href.contains("/p/"), F.regexp_extract(F.element_at(F.split(href, "/p/"), -1), r"^([^?/#]*)", 1))
    last = F.when(last.rlike(r"\A[A-Za-z0-9]{3,}\z"), last)
    return F.upper(F.coalesce(group(href, r"(?i)[?&]pid=([A-Za-z0-9]+)"), last, group(href, r"(?i)/s/p/([A-Za-z0-9]+)")))


def srcset_best(srcset: Column) -> Column:
    """The URL of the largest descriptor in a srcset, the first among equals;
    null for none."""
    pair = lambda part: F.split(trim(part), f"{WHITE}+")
    size = lambda words: F.coalesce(F.regexp_extract(F.coalesce(F.get(words, F.lit(1)), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    found = F.filter(F.transform(F.split(srcset, ","), pair), lambda w: F.get(w, F.lit(0)) != "")
    numbered = F.transform(found, lambda w, i: F.struct(F.greatest(size(w), F.lit(-1).cast("bigint")).alias("size"), (-i).alias("at"), F.get(w, F.lit(0)).alias("url")))
    return F.when(F.size(numbered) > 0, F.array_max(numbered)["url"])


def is_product_url(url: Column) -> Column:
    """Whether a URL may be a product's: not a script, review, list, cart or
    navigation link, but a link of a known shop or product path, or any path
    of the site itself."""
    t = trim(url)
    low = F.lower(t)
    no = (t == "") | (t == "#") | low.startswith("javascript:") | low.startswith("data:") | t.rlike("(?i)customerReviews|product-reviews|wishlist|boughtTogether|nav|cart")
    shop = t.rlike(r"(?i)^https?://[^/]+/") & t.rlike(r"(?i)flipkart\.com|myntra\.com|meesho\.com|/product/|/p/")
    yes = t.rlike(r"(?i)amazon\.[a-z.]+/|/dp/|/gp/product/") | shop | (t.startswith("/") & (F.length(t) > 2))
    return F.coalesce(~no & yes, F.lit(False))


def is_next_page(href: Column) -> Column:
    """Whether a link can be another search page."""
    t = trim(href)
    low = F.lower(t)
    no = (t == "") | (t == "#") | low.startswith("javascript:") | low.startswith("mailto:") | low.startswith("tel:")
    no = no | t.rlike(_PRODUCT_LINK) | t.rlike(_REVIEW_LINK) | t.rlike(_ACCOUNT_LINK)
    return F.coalesce(~no & (t.rlike("/s[/?]") | t.rlike(_SEARCH_PARAM)), F.lit(False))


def is_flipkart_next_page(href: Column) -> Column:
    t = trim(href)
    no = (t == "") | (t == "#") | t.startswith("javascript:") | t.startswith("mailto:") | t.startswith("tel:")
    return F.coalesce(~no & t.rlike(r"/search\?|/.*/pr\?|page=\d+"), F.lit(False))


def is_volatile(name: Column) -> Column:
    """Whether a page's URL is the same page without this parameter."""

    def volatile(n: Column) -> Column:
        out = n.isin(VOLATILE_PARAMS)
        for prefix in VOLATILE_PREFIXES:
            out = out | n.startswith(prefix)
        return F.coalesce(out, F.lit(False))

    return let(F.lower(name), volatile)


def resolved(href: Column, base: Column) -> Column:
    """An http(s) link against an absolute page URL."""
    origin = F.concat(F.regexp_extract(base, r"^(https?://[^/?#]*)", 1))
    path = F.regexp_extract(base, r"^https?://[^/?#]*([^?#]*)", 1)
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), href))
        .when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
        .otherwise(F.concat(origin, F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1)), href))
    )


def _canonical(url: Column, pairs: Column) -> Column:
    """``url``: a lambda variable, as it is named often."""
    part = lambda n: F.regexp_extract(url, _ABSOLUTE, n)
    port = lambda p: F.when((p == "") | (p == "https:443") | (p == "http:80"), "").otherwise(F.concat(F.lit(":"), F.substring_index(p, ":", -1)))
    port = let(F.when(part(3) == "", "").otherwise(F.concat(F.lower(part(1)), F.lit(":"), part(3))), port)
    # Without the slash at its end, but that of the root.
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(part(4), r"\A\z", "/"), " ", "%20"), r"(?s)(?<=.)/\z", "")
    query = F.array_join(F.array_sort(F.array_distinct(pairs)), "&")
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), port, path, F.regexp_replace(query, r"(?s)\A(?=.)", "?"))


def _pairs(url: Column) -> Column:
    query = F.regexp_replace(F.regexp_extract(url, _ABSOLUTE, 5), " ", "%20")
    return F.filter(F.split(query, "&"), lambda p: p != "")


def canonical_page(url: Column, base: str = HOME + "/") -> Column:
    """The identity of a page: no fragment, no volatile parameters, the other
    pairs distinct and sorted, host in lower case, no default port, no
    trailing slash; empty for an empty URL."""
    return let(trim(F.coalesce(url, F.lit(""))), lambda t: _canonical_of(t, base))


def _canonical_of(t: Column, base: str) -> Column:
    kept = lambda full: F.filter(_pairs(full), lambda p: ~is_volatile(decoded(F.substring_index(p, "=", 1))))
    known = lambda full: F.when(full.rlike(_ABSOLUTE), _canonical(full, kept(full))).otherwise(F.substring_index(t, "#", 1))
    return F.when(t == "", "").otherwise(let(resolved(t, F.lit(base)), known))


def canonical_page_of_site(url: Column) -> Column:
    """As :func:`canonical_page`; a lone "#" is empty."""
    return let(trim(F.coalesce(url, F.lit(""))), lambda t: F.when(t == "#", "").otherwise(_canonical_of(t, HOME + "/")))


def canonical_page_decoded(url: Column) -> Column:
    """As :func:`canonical_page`, with names and values decoded, for absolute
    URLs; others lose their fragment only."""

    def named(t: Column) -> Column:
        pairs = F.transform(_pairs(t), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("n"), decoded(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v")))
        return F.transform(F.filter(pairs, lambda p: ~is_volatile(p["n"])), lambda p: F.concat(p["n"], F.lit("="), p["v"]))

    return let(trim(F.coalesce(url, F.lit(""))), lambda t: F.when(t.rlike(_ABSOLUTE), _canonical(t, named(t))).otherwise(F.substring_index(F.coalesce(url, F.lit("")), "#", 1)))


def admission(url: Column, origin: Column) -> Column:
    """Why a next page is refused, or "ok": it must be a search page of the
    origin's shop host and, where both name one, of the same search."""
    t = trim(url)
    low = F.lower(t)
    href = resolved(t, F.coalesce(F.nullif(origin, F.lit("")), F.lit(HOME + "/")))
    return let(href, lambda href: _admission(url, t, low, href, origin))


def _admission(url: Column, t: Column, low: Column, href: Column, origin: Column) -> Column:
    bare = lambda u: F.regexp_replace(host_of(u), r"^www\.", "")
    term = lambda u: F.nullif(decoded(group(u, r"^[^?#]*\?(?:[^#]*&)?k=([^&#]*)")), F.lit(""))
    return (
        F.when(url.isNull(), "bad-type")
        .when((t == "") | (t == "#"), "empty")
        .when(low.startswith("javascript:"), "javascript")
        .when(low.startswith("mailto:") | low.startswith("tel:"), "scheme")
        .when(~href.rlike("(?i)^https?:"), "protocol")
        .when(~href.rlike(_ABSOLUTE), "unparseable")
        .when(~host_of(href).contains("amazon."), "off-amazon")
        .when(href.rlike(_PRODUCT_LINK), "product-link")
        .when(href.rlike(_REVIEW_LINK), "review-link")
        .when(href.rlike(_ACCOUNT_LINK), "account-link")
        .when(~href.rlike("/s[/?]") & ~href.rlike(_SEARCH_PARAM), "not-search-page")
        .when(origin.rlike(_ABSOLUTE) & (bare(origin) != bare(href)), "host-changed")
        .when(origin.rlike(_ABSOLUTE) & (term(origin) != term(href)), "query-changed")
        .otherwise("ok")
    )


def query_param(url: Column, names: str = "k", ends: str = "&#", marks: str = "?&#") -> Column:
    """The first parameter of one of ``names`` (alternatives), decoded and
    trimmed; empty if none."""
    return trim(decoded(F.regexp_extract(F.coalesce(url, F.lit("")), f"[{marks}](?:{names})=([^{ends}]*)", 1)))


def _param(url: Column, name: str) -> Column:
    value = decoded(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), f"(?:^|&){name}=([^&]*)", 1))
    return F.nullif(trim(F.replace(value, F.lit("+"), F.lit(" "))), F.lit(""))


def search_query(url: Column, site: Column | None = None) -> Column:
    """The search a URL names: by its shop's parameters, else k, q or search;
    failing these the first of the three anywhere; empty if none."""
    anywhere = F.coalesce(_param(url, "k"), _param(url, "q"), _param(url, "search"))
    own = anywhere
    if site is not None:
        for name, (_, _, params) in SITES.items():
            own = F.when(site == name, F.coalesce(*[_param(url, p) for p in params])).otherwise(own)
    return F.coalesce(own, query_param(url, "k|q|search"))


def search_query_of(typed: Column, url: Column) -> Column:
    """What was typed, if at least two characters; else the URL's search."""
    t = squeeze(typed)
    return F.when(F.length(trim(typed)) >= 2, t).otherwise(search_query(url))


def resolve_query(content: Column, url: Column) -> Column:
    """The page's own query, if any; else the search of the tab's URL."""
    t = squeeze(F.coalesce(content, F.lit("")))
    return F.when(t != "", t).otherwise(search_query(url, site_of(url)))


def increment_key(product_id: Column, source: Column, canonical_url: Column, url: Column, title: Column) -> Column:
    """The identity of a product between two scans of a page."""
    by_id = F.concat(F.lit("id:"), F.nullif(product_id, F.lit("")), F.coalesce(F.concat(F.lit(":"), F.nullif(source, F.lit(""))), F.lit("")))
    by_url = F.concat(F.lit("url:"), either(canonical_url, url))
    return F.coalesce(by_id, by_url, F.concat(F.lit("untitled:"), F.coalesce(title, F.lit(""))))
