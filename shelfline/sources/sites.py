"""The shops' pages: which nodes hold a field, and what a field makes of them.

Selectors and word patterns are fixed values of the pages they read.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import numbers, urls
from shelfline.functions.js import LEFT, RIGHT, WHITE, filled, group, leading_number, squeeze, trim
from shelfline.functions.lexicon import COUNT_CEILING
from shelfline.plans.storage import stored
from shelfline.sources.dom import Node
from shelfline.sources.nodes import Pick, Spec, select_nodes

_BOX = Pick("box", ('input[name="q"], input[placeholder*="Search"], input[aria-label*="Search"]',), ("value",))

# What a rule needs at least of a node that is picked by its tag alone.
_DIGIT, _SPONSORED, _COUNTED = "[0-9]", "(?i)sponsored", "(?i)rating|review"

# Where the first shop's pages keep their fields.
AMAZON = Spec(
    cards=lambda root: root.select('[data-component-type="s-search-result"]'),
    card_attrs=("data-asin", "data-component-type"),
    fields=(
        Pick("title", (
            "h2 a span", "h2 span", "h2", "span.a-size-base-plus.a-color-base.a-text-normal", ".s-title-instructions-style span", 'span[role="heading"]',
            "a.a-link-normal.a-text-normal", "a.a-link-normal span", "div.a-section.a-spacing-small span", "span.a-size-base.a-size-base-plus",
        ), up=40),
        Pick("link", ("h2 a", "a.a-link-normal.s-no-outline", 'a[href*="/dp/"]', 'a[href*="/gp/product"]'), ("href",)),
        Pick("image", ("img.s-image", "img.a-dynamic-image", 'img[data-image-latency*="product"]'), ("src", "data-src", "srcset", "width", "height")),
        Pick("price", (".a-offscreen", ".a-price-whole"), ("data-a-strike", "class"), within=".a-price"),
        Pick("price", (".a-price-whole",), first_tier=1),
        Pick("rating", (".a-icon-star-small .a-icon-alt", ".a-icon-star .a-icon-alt", ".a-icon-star-medium .a-icon-alt", '[aria-label*="out of 5"]'), ("aria-label",)),
        Pick("count", ('[aria-label*="ratings"], [aria-label*="reviews"]',), ("aria-label",)),
        Pick("count", (
            'a[href*="customerReviews"] span', 'a[href*="product-reviews"] span', "span.a-size-base.s-underline-text", "span.a-size-base.a-color-base", "a span.a-size-base",
        ), first_tier=1),
        Pick("count", ("span, a, div",), longest=40, first_tier=6, has=_DIGIT),
        Pick("ad", ('[data-component-type="sp-sponsored-result"]', ".puis-sponsored-label-text, .s-sponsored-label-text, .puis-sponsored-label-txt, .s-sponsored-label-info-icon"), longest=0),
        Pick("leaf", ("span, div, a, i, b",), longest=20, leaf=True, has=_SPONSORED),
        Pick("label", ("[aria-label], [title]",), ("aria-label", "title"), has=_SPONSORED),
    ),
    page=(
        Pick("box", ("#twotabsearchtextbox", 'input[name="field-keywords"]', '#nav-search input[type="text"]', 'input[aria-label*="Search"]'), ("value",)),
        Pick("more", (
            '[data-action="load-more"]', '[data-action="loadmore"]', '[data-load-more="true"]', '[data-loadmore="true"]', '[data-testid*="load-more"]', '[data-testid*="loadmore"]',
            "#pabk-button-container button", "#pabk-button", ".pabk-button", ".load-more-button", ".loadmore", ".see-more", ".see-more-results", 'button, [role="button"], a',
        ), ("id", "class", "data-action", "data-testid", "aria-label", "title", "aria-disabled", "aria-hidden", "disabled")),
        Pick("next", tuple(f'a[aria-label="{t}"]' for t in ("Go to next page", "Next", "next", "Next page", "next page")), ("href", "aria-disabled", "aria-hidden", "disabled")),
        Pick("next", ("a, button",), ("href", "class", "aria-label", "title", "aria-disabled", "aria-hidden", "disabled"), first_tier=5),
    ),
)

#: Where page links are looked for.
AMAZON_REGIONS = '.s-pagination-container, [role="navigation"], .a-pagination, nav'

# The second shop's.
FLIPKART = Spec(
    cards=lambda root: root.select("div[data-id]"),
    fields=(
        Pick("title", ("._4rR01T", "a._4rR01T", "div._4rR01T", "._2cLu-l", "a._2cLu-l", 'div[class*="product-title"]', 'div[class*="ProductTitle"]')),
        Pick("title", ("a",), first_tier=7),
        Pick("link", ('a[href*="/p/itm"]',), ("href",)),
        Pick("price", ("._30jeq3", "div._30jeq3", "span._30jeq3", "._1vC4OE", "div._1vC4OE", 'span[class*="price"]')),
        Pick("rating", ("._3LWZlK", "div._3LWZlK", "span._3LWZlK", "._2beYZw", "._1x2VEC", "._1nLEql", '[class*="rating"]')),
        Pick("ratings", ("span._2U9tEA", "._2U9tEA", 'span[class*="rating-count"]', 'span[class*="RatingCount"]')),
        Pick("reviews", ('span[class*="review-count"]', 'span[class*="ReviewCount"]', "span._2U9tEA", "._2U9tEA")),
        Pick("span", ("span",), longest=60, has=_COUNTED),
        Pick("image", ("img",), ("src", "data-src")),
        Pick("ad", ('[class*="sponsored"], [class*="ad-label"], [class*="adLabel"]',)),
    ),
    page=(
        _BOX,
        Pick("next", ('a[rel="next"]', "a._1LKTO3", "a._3fVaIS", 'a[class*="next"]', 'a[class*="Next"]', "a, button"), ("href", "aria-disabled", "aria-hidden", "disabled")),
    ),
)


def _meesho_cards(root: Node) -> list[Node]:
    """The card around each product link: the nearest block that carries an
    id or has at most 20 elements, ten levels up at most; else the link."""
    cards = []
    for link in root.select('a[href*="/p/"]'):
        ident = re.split(r"[?/#]", link.attrs["href"].strip().rpartition("/p/")[2])[0]
        if re.fullmatch(r"[A-Za-z0-9]{3,}", ident):
            above = [n for n in islice(link.above(), 10) if n.tag == "div" and (n.attrs.get("data-id") or 0 < n.kids <= 20)]
            cards.append(above[0] if above else link)
    return cards


# The third shop's.
MEESHO = Spec(
    cards=_meesho_cards,
    fields=(
        Pick("title", (
            '[data-testid="productTitle"]', "h3", "h2", "h4", "p", "a", 'span[class*="Title"]', 'span[class*="title"]', 'div[class*="Title"]', 'div[class*="title"]', 'span[class*="Name"]', 'span[class*="name"]',
        )),
        Pick("link", ('a[href*="/p/"]',), ("href",)),
        Pick("price", (
            'span[class*="Price"]', 'span[class*="price"]', 'div[class*="Price"]', 'div[class*="price"]', 'span[class*="Selling"]', 'span[class*="selling"]', 'span[class*="MRP"]', 'span[class*="Mrp"]', 'span[class*="mrp"]',
        )),
        Pick("price", ("*",), longest=30, first_tier=10, has="₹"),
        Pick("rating", (
            '[class*="AverageRating"]', '[class*="Rating"]', '[class*="rating"]', 'span[class*="rating"]', 'div[class*="rating"]', 'span[class*="Star"]', 'span[class*="star"]',
        )),
        Pick("ratings", ('[class*="Ratings"]', '[class*="ratings"]', 'span[class*="Rating"]', 'div[class*="Rating"]')),
        Pick("reviews", ('[class*="Reviews"]', '[class*="reviews"]', 'span[class*="Review"]', 'div[class*="Review"]')),
        Pick("span", ("span",), longest=60, has=_COUNTED),
        Pick("image", ("img",), ("src", "data-src")),
        Pick("ad", ('[class*="sponsored"], [class*="promoted"], [class*="ad-label"]',)),
        Pick("gold", ('[class*="Gold"], [class*="gold"], [class*="badge"]',)),
    ),
    page=(
        _BOX,
        Pick("next", ('a[rel="next"]', 'a[class*="next"]', 'a[class*="Next"]', 'button[class*="next"]', 'button[class*="Next"]', "a, button"), ("href", "aria-disabled", "aria-hidden", "disabled")),
    ),
)

SPECS = {"Amazon": AMAZON, "Flipkart": FLIPKART, "Meesho": MEESHO}


def register(name: str, domains: list[str], spec: Spec | None, params: list[str]) -> None:
    """Adds a shop; one without a name or domains is passed over.  Without a
    spec it is known but cannot be read."""
    if name and domains:
        urls.SITES[name] = (domains, spec is not None, params)
        if spec:
            SPECS[name] = spec


def registered(spark) -> DataFrame:
    """The shops in the order of their registration."""
    rows = [(k, name, domains, implemented) for k, (name, (domains, implemented, _)) in enumerate(urls.SITES.items())]
    return spark.createDataFrame(rows, "place int, name string, domains array<string>, implemented boolean")


def _prepared(nodes: DataFrame) -> DataFrame:
    """Node rows with what many fields look at worked out once: the trimmed
    and the squeezed text."""
    return nodes.withColumns({"trimmed": trim(F.col("text")), "squeezed": squeeze(F.col("text")), "at": _as_it_is("at")})


def _as_it_is(name: str) -> Column:
    """An array through a lambda: a projection with one stays out of
    whole-stage code.  There the rules of a shop are one method, too large for
    the JVM to compile (8000 bytes), which is then interpreted row by row."""
    return F.transform(name, lambda x: x)


def _attr(name: str) -> Column:
    """An attribute, empty where missing; looked up by the rules that ask for it."""
    return F.coalesce(F.element_at("attrs", F.lit(name)), F.lit(""))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def _text() -> Column:
    return F.col("text")


def _tier() -> Column:
    return F.col("at")[0]


def _reduce(nodes: DataFrame, fields: dict[str, tuple[str, Column, Column | None]], flags: dict[str, dict[str, Column]], **more: tuple[Column, Column]) -> DataFrame:
    """One row a page and card.

    A field (node name, value, condition) takes its first node, by tier and
    place, that has a value and meets the condition; a flag is set by any node
    of a name that meets its condition; ``more`` takes the value of the largest
    order.  Values are worked out once a node, then reduced.
    """
    of = lambda name, value: F.when(F.col("name") == name, value)
    staged = nodes.select(
        "page", "card", _as_it_is("at").alias("at"),
        *[of(name, value if ok is None else F.when(ok, value)).alias(a) for a, (name, value, ok) in fields.items()],
        *[F.coalesce(*[of(name, ok) for name, ok in by_name.items()]).alias(a) for a, by_name in flags.items()],
        *[x for a, (value, order) in more.items() for x in (value.alias(a), order.alias(f"{a}_order"))],
    )
    return staged.groupBy("page", "card").agg(
        *[F.min_by(a, F.when(F.col(a).isNotNull(), F.col("at"))).alias(a) for a in fields],
        *[F.coalesce(F.bool_or(a), F.lit(False)).alias(a) for a in flags],
        *[F.max_by(a, f"{a}_order").alias(a) for a in more],
    )


def _amazon(nodes: DataFrame) -> DataFrame:
    clean = lambda c: trim(F.regexp_replace(c, f"(?i)^sponsored{WHITE}+", ""))
    title = clean(F.col("squeezed"))
    is_title = (F.col("name") == "title") & (F.length(title) >= 3) & ~title.rlike(r"(?i)\Asponsored\z")
    widest = F.when(is_title, F.struct(F.length(title).alias("n"), F.transform("at", lambda x: -x).alias("at")))
    href = trim(_attr("href"))
    link = ~href.startswith("#") & (href != "") & ~href.rlike("(?i)customerReviews|product-reviews|wishlist|boughtTogether|javascript:") & href.rlike(r"(?i)/dp/|/(?:gp/)?product/")
    source = F.coalesce(F.nullif(_attr("src"), F.lit("")), F.nullif(_attr("data-src"), F.lit("")), urls.srcset_best(F.nullif(_attr("srcset"), F.lit(""))))
    side = lambda a: F.coalesce(F.regexp_extract(_attr(a), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    image = ~source.rlike("(?i)^data:|sprites|g-ecx|gno") & ~side("width").between(1, 19) & ~side("height").between(1, 19)
    shown = (_attr("data-a-strike") != "true") & ~_attr("class").contains("a-text-price")
    said = F.coalesce(F.nullif(_text(), F.lit("")), _attr("aria-label"))
    stars = F.coalesce(group(said, rf"(?i)(\d+(?:\.\d+)?){WHITE}*out of 5").try_cast("double"), leading_number(said))
    nodes = nodes.withColumn("counted", F.when(F.col("name") == "count", F.when(_tier() == 0, _attr("aria-label")).otherwise(F.col("trimmed"))))
    nodes = nodes.withColumns({"n": numbers.feedback_count(F.col("counted")), "at": _as_it_is("at")})
    count = F.col("n")
    plausible = F.when(_tier() == 0, count > 0).otherwise(numbers.plausible_count(F.col("counted"), count) & ((_tier() < 6) | F.element_at("attrs", F.lit("#heading")).isNull()))
    label = lambda a: trim(_attr(a)).rlike("(?i)^sponsored")
    found = _reduce(
        nodes,
        {
            "link": ("link", F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(urls.HOME), href)), link), "image": ("image", source, image),
            "price": ("price", _positive(numbers.indian_number(_text())), shown | (_tier() == 1)), "rating": ("rating", stars, stars.between(0, 5)), "rating_count": ("count", count, plausible),
            "own_id": ("card", F.nullif(trim(_attr("data-asin")), F.lit("")), None),
        },
        {"ad": {"ad": F.lit(True), "leaf": F.col("trimmed").rlike(r"(?i)\Asponsored\z"), "label": label("aria-label") | label("title"), "card": _attr("data-component-type") == "sp-sponsored-result"}},
        t=(F.struct(title.alias("text"), F.transform("up", lambda u: clean(squeeze(u))).alias("up")), widest),
    )
    text = F.col("t.text")
    wider = F.get(F.filter("t.up", lambda u: (F.length(u) > 2 * F.length(text)) & u.contains(text)), F.lit(0))
    canonical = urls.product_url(F.col("link"))
    ident = F.upper(F.coalesce(F.col("own_id"), urls.product_id_in(canonical)))
    ident = F.when(ident.rlike(r"\A[A-Z0-9]{10}\z"), ident)
    return found.where("t is not null").select(
        "page", "card", F.when(F.length(text) < 15, F.coalesce(wider, text)).otherwise(text).alias("title"), "price", "rating", "rating_count", F.lit(None).cast("double").alias("review_count"),
        "image", F.col("image").alias("image_url"), F.coalesce("link", canonical).alias("url"), canonical.alias("canonical_url"), ident.alias("product_id"), ident.alias("asin"),
        F.col("ad").alias("sponsored"), F.col("ad").alias("is_sponsored"), F.lit("Amazon").alias("source"), F.lit("Amazon").alias("marketplace"),
    )


def _other(nodes: DataFrame, name: str, host: str, title: Column, price: Column, own_price: Column, numbers: dict[str, tuple[list[str], Column]], counts: dict[str, str], spans: dict[str, str], image: Column, any_image: Column, ident, ad: dict[str, Column]) -> DataFrame:
    """What the second and third shop have in common.

    ``numbers`` are worked out once for the nodes named with them; ``counts``
    and ``spans`` say which of them a count's own nodes and the spans give."""
    of = lambda names, value: F.when(F.col("name").isin(names), _positive(value))
    nodes = nodes.withColumns({f"#{k}": of(names, value) for k, (names, value) in numbers.items()} | {"#price": of(["price"], price), "at": _as_it_is("at")})
    price, counts, spans = F.col("`#price`"), {k: F.col(f"`#{n}`") for k, n in counts.items()}, {k: F.col(f"`#{n}`") for k, n in spans.items()}
    href = trim(_attr("href"))
    stars = F.regexp_extract(_text(), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    source = F.coalesce(F.nullif(_attr("src"), F.lit("")), F.nullif(_attr("data-src"), F.lit("")))
    low = F.lower(F.col("trimmed"))
    mentions = {"ratings": low.contains("rating"), "reviews": low.contains("review") & ~low.contains("rating")}
    fields = {
        "title": ("title", F.col("squeezed"), title), "href": ("link", href, None), "price_own": ("price", price, _tier() < 10), "price_card": ("card", own_price, None),
        "price_any": ("price", price, (_tier() == 10) & _text().contains("₹")), "rating": ("rating", stars, stars.between(0, 5)),
        "image_own": ("image", source, image), "image_any": ("image", F.nullif(_attr("src"), F.lit("")), any_image),
    }
    for k in ("ratings", "reviews"):
        fields[k] = (k, counts[k], None)
        fields[f"{k}_span"] = ("span", spans[k], mentions[k] & ~_text().rlike("[₹$€%]") & (spans[k] < COUNT_CEILING))
    found = _reduce(nodes, fields, {"sponsored": ad})
    url = urls.with_host(F.col("href"), host)
    none = F.lit(None)
    return found.where("title is not null").select(
        "page", "card", "title", F.coalesce("price_own", "price_card", "price_any").alias("price"), "rating", F.coalesce("ratings", "ratings_span").alias("rating_count"),
        F.coalesce("reviews", "reviews_span").alias("review_count"), F.coalesce("image_own", "image_any").alias("image"), none.cast("string").alias("image_url"),
        F.coalesce(F.nullif(F.col("href"), F.lit("")), url).alias("url"), url.alias("canonical_url"), ident(F.col("href")).alias("product_id"), none.cast("string").alias("asin"),
        "sponsored", none.cast("boolean").alias("is_sponsored"), F.lit(name).alias("source"), F.lit(name).alias("marketplace"),
    )


def _advert(words: str, labels: list[str]) -> dict[str, Column]:
    low = F.lower(_text())
    alone = low.contains("ad") & ~low.contains("add to cart") & _text().rlike(f"{LEFT}Ad{RIGHT}")
    return {"card": low.rlike(words) | alone, "ad": F.lower(F.col("trimmed")).isin(labels)}


def _flipkart(nodes: DataFrame) -> DataFrame:
    t = F.col("squeezed")
    title = F.when(_tier() < 7, F.length(t) >= 3).otherwise(F.length(t).between(5, 299) & ~t.rlike(r"\A\d+\z"))
    rupees = F.regexp_replace(group(_text(), rf"₹{WHITE}*([\d,]+)"), ",", "").try_cast("double")
    ratings, reviews = numbers.flipkart_count(F.col("trimmed"), "rating"), numbers.flipkart_count(F.col("trimmed"), "review")
    image = F.coalesce(F.nullif(_attr("src"), F.lit("")), _attr("data-src"))
    good = ~image.rlike("(?i)^data:|sprites|icons|logo|placeholder") & image.rlike(r"(?i)rukminim2\.flixcart\.com|flipkart\.com/images")
    return _other(
        nodes, "Flipkart", "https://www.flipkart.com", title, numbers.price_text(_text()), _positive(rupees), {"rated": (["ratings", "reviews", "span"], ratings), "reviewed": (["span"], reviews)},
        {"ratings": "rated", "reviews": "rated"}, {"ratings": "rated", "reviews": "reviewed"}, good, ~_attr("src").rlike("(?i)^data:"), urls.flipkart_id, _advert("sponsored", ["sponsored", "ad", "advertisement"]),
    )


def _meesho(nodes: DataFrame) -> DataFrame:
    t = F.col("squeezed")
    title = F.length(t).between(3, 299) & ~t.rlike(r"\A\d+\z") & ~t.rlike("^[₹$€]")
    # The last amount in rupees that is positive.
    amounts = F.transform(F.regexp_extract_all(_text(), F.lit(rf"(₹{WHITE}*[\d,]+)"), 1), lambda m: numbers.price_text(m))
    last = F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.filter(amounts, lambda x: x > 0)), -1)
    count = lambda kind, bare: numbers.meesho_count(F.col("trimmed"), kind, bare)
    image = F.coalesce(F.nullif(_attr("src"), F.lit("")), _attr("data-src"))
    good = ~image.rlike("(?i)^data:|sprites|icons|logo|placeholder|default") & image.rlike(r"(?i)meesho\.com")
    return _other(
        nodes, "Meesho", "https://www.meesho.com", title, numbers.price_text(_text()), last, {"bare": (["ratings"], count("rating", True)), "rated": (["span"], count("rating", False)), "reviewed": (["reviews", "span"], count("review", False))},
        {"ratings": "bare", "reviews": "reviewed"}, {"ratings": "rated", "reviews": "reviewed"}, good, ~_attr("src").rlike("(?i)^data:|sprites|icons|logo|placeholder"), urls.meesho_id,
        _advert("sponsored|promoted", ["sponsored", "ad", "promoted", "advertisement"]) | {"gold": _text().rlike("(?i)meesho gold")},
    )


READERS = {"Amazon": _amazon, "Flipkart": _flipkart, "Meesho": _meesho}
#: Bits of a product's ordinal that hold its card; the page is above them.
CARD_BITS = 20


def with_reader(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page, url, site, reader (the shop whose rules read it; the first shop's
    where there are none) and html."""
    site = urls.site_of(F.col(url_col))
    return pages.select(F.col(page_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), site.alias("site"), F.when(site.isin(list(READERS)), site).otherwise("Amazon").alias("reader"), F.col(html_col).alias("html"))


def extract_products(pages: DataFrame, **columns: str) -> DataFrame:
    """Raw product rows of search pages (page_id, url, html): one a card, in
    the order of page and card.  Cards without a title are none.

    The pages are read and parsed once, and their node rows written, a folder
    a shop; every shop's rules then are one aggregation by page and card."""
    return products_of(card_nodes(pages, **columns))


def card_nodes(pages: DataFrame, **columns: str) -> DataFrame:
    """The node rows of all cards of search pages."""
    return select_nodes(with_reader(pages, **columns), card_specs())


def card_specs() -> dict[str, Spec]:
    """What is read of cards, by shop."""
    return {name: Spec(spec.cards, spec.fields, (), spec.card_attrs) for name, spec in SPECS.items() if name in READERS}


def products_of(nodes: DataFrame) -> DataFrame:
    """Raw product rows of node rows (:func:`card_nodes`)."""
    nodes = stored(nodes.where("card >= 0"), "card-nodes", by="reader")
    out = None
    for name, reader in READERS.items():
        rows = reader(_prepared(nodes.where(F.col("reader") == name)))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("ordinal", F.col("page") * (1 << CARD_BITS) + F.col("card"))


def unreadable_cards(pages: DataFrame, **columns: str) -> DataFrame:
    """page, card (-1: all of the page) and reason of what could not be read."""
    return card_nodes(pages, **columns).where("name = 'unreadable'").select("page", "card", F.col("text").alias("reason"))


def scan_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """page, site, more_available, next_page_url and search_query of each
    page.  Whether an element is laid out cannot be told from HTML: what is
    not marked as hidden counts as visible."""
    read = with_reader(pages, **columns)
    whole = {name: Spec(lambda root: [], (), spec.page) for name, spec in SPECS.items()}
    # The first shop's links count only within its page regions.
    whole["Amazon"] = Spec(
        lambda root: [], (),
        (*[p for p in AMAZON.page if not (p.name == "next" and p.first_tier)],
         Pick("next", ("a, button",), ("href", "class", "aria-label", "title", "aria-disabled", "aria-hidden", "disabled"), within=AMAZON_REGIONS, own=True, first_tier=5),
         Pick("next", ("a.s-pagination-next", ".s-pagination-item.s-pagination-next"), ("href", "class", "aria-label", "title", "aria-disabled", "aria-hidden", "disabled"), first_tier=6)),
    )
    nodes = _prepared(select_nodes(read, whole, keep=["url", "site"]))
    amazon, flipkart = F.col("reader") == "Amazon", F.col("reader") == "Flipkart"
    known = F.coalesce(F.col("site"), F.lit("Amazon")) != "Myntra"
    visible = (_attr("aria-disabled") != "true") & (_attr("aria-hidden") != "true") & F.element_at("attrs", F.lit("disabled")).isNull()
    words = F.coalesce(F.nullif(F.col("squeezed"), F.lit("")), F.nullif(squeeze(_attr("aria-label")), F.lit("")), squeeze(_attr("title")))
    low, href, link = F.lower(F.col("trimmed")), _attr("href"), F.col("attrs")["#tag"] == "a"
    role = "loadmore|see-more"
    loads = F.lower(F.coalesce(F.nullif(_attr("data-action"), F.lit("")), _attr("data-testid"))).rlike("load-more|loadmore|load_more") | F.lower(_attr("id")).rlike(role) | F.lower(_attr("class")).rlike(role)
    text = words.rlike(rf"(?i)load{WHITE}*more|see{WHITE}*more{WHITE}*(?:results|products)?|more{WHITE}*products")
    more = visible & F.when(_tier() < 6, loads).when(_tier() < 13, F.col("at")[3] == 0).otherwise(text)
    token = _attr("class").contains("s-pagination-next") & link
    says_next = words.rlike(rf"(?i)^{WHITE}*next{WHITE}*\z|→") | F.lower(words).contains("go to next page")
    onward = F.when(_tier() < 5, F.lit(True)).otherwise(token | (says_next & link))
    has_next, exact = low.contains("next") | low.contains("→"), low.isin("next", "next page")
    flip = F.when(_tier() == 0, F.col("at")[3] == 0).when(_tier() < 5, has_next).otherwise(exact) & urls.is_flipkart_next_page(href)
    meesho_url = urls.with_host(href, "https://www.meesho.com")
    target = F.when(amazon, urls.resolved(href, F.col("url"))).when(flipkart, urls.with_host(href, "https://www.flipkart.com")).otherwise(meesho_url)
    ok = visible & F.when(amazon, onward & urls.is_next_page(href)).when(flipkart, flip).otherwise(F.when(_tier() < 5, has_next).otherwise(exact) & meesho_url.contains("meesho.com"))
    box = squeeze(_attr("value"))
    typed = (F.length(box) >= 2) & (~amazon | (F.col("at")[3] == 0))
    fields = {"next_page_url": ("next", target, ok & known & filled(href)), "typed": ("box", box, typed & known)}
    # What is the page's own is the same in all its rows.
    nodes = nodes.withColumn("own", F.struct("url", "site", "reader"))
    found = _reduce(nodes, fields, {"more_available": {"more": more & amazon & known}}, own=(F.col("own"), F.when(F.col("name") == "page", F.lit(1)))).select("*", "own.*")
    named = F.when(F.col("reader") == "Amazon", urls.query_param(F.col("url"))).otherwise(urls.query_param(F.col("url"), "q", "&", "?&"))
    named = F.when(known, named).otherwise("")
    return found.select("page", "site", "more_available", "next_page_url", F.coalesce("typed", named).alias("search_query"))


