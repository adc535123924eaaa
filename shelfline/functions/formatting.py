"""What is shown: amounts, counts, headers, messages, product cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.js import either, round_half_up
from shelfline.functions.lexicon import GENERIC_ERROR, MESSAGES
from shelfline.functions.validate import is_price


def indian_digits(c: Column) -> Column:
    """Grouped by three, then by two; at most three decimals; null for null
    and NaN."""
    d = c.cast("double")
    size = F.abs(d)
    text = F.format_string("%.3f", F.round(size, 3))
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    rest = F.regexp_replace(F.concat(F.lit("."), F.substring_index(text, ".", -1)), r"\.?0*$", "")
    sign = F.when((d < 0) & (F.round(size, 3) > 0), "-").otherwise("")
    return F.when(d.isNotNull() & ~F.isnan(d), F.concat(sign, whole, rest))


def rupees(c: Column) -> Column:
    return F.concat(F.lit("₹"), indian_digits(c))


def count_text(review_count: Column, rating_count: Column, kind: Column | None = None) -> Column:
    """The feedback a product has, or null."""
    n = F.coalesce(F.when(review_count > 0, review_count), F.when(rating_count > 0, rating_count))
    noun = F.lit(" customer feedback") if kind is None else F.when(kind == "reviews", " customer reviews").otherwise(" customer feedback")
    return F.concat(indian_digits(n), noun)


def rating_text(c: Column) -> Column:
    """One decimal; null for none or zero."""
    return F.when(c > 0, F.concat(F.format_string("%.1f", c.cast("double")), F.lit(" average rating")))


def budget_text(low: Column, high: Column) -> Column:
    both = F.concat(rupees(low), F.lit(" – "), rupees(high))
    return F.coalesce(both, F.concat(F.lit("above "), rupees(low)), F.concat(F.lit("under "), rupees(high)))


def header_text(n: Column, low: Column, high: Column, relevant: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    noun = F.when(n == 1, "PRODUCT").otherwise("PRODUCTS")
    kind = F.when(relevant, "RELEVANT ").otherwise("")
    end = F.coalesce(F.concat(F.lit(" IN "), budget_text(low, high)), F.lit(" FOUND"))
    return F.concat(n.cast("string"), F.lit(" "), kind, noun, end)


def safe_message(c: Column) -> Column:
    """A known message as it is, any other the generic one."""
    return F.when(c.isin(list(MESSAGES.values())), c).otherwise(GENERIC_ERROR)


def budget_count_text(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return F.concat(n.cast("string"), F.when(n == 1, " product within budget").otherwise(" products within budget"))


def pages_text(n: Column) -> Column:
    return F.when(n <= 1, "1 PAGE ANALYZED").otherwise(F.concat(n.cast("string"), F.lit(" PAGES ANALYZED")))


def position_text(price: Column, lowest: Column, average: Column) -> Column:
    """Where a price lies, in words; null where it is the average or none."""
    diff = round_half_up(average - price)
    words = F.when(price == lowest, "Lowest priced").when(diff > 0, F.concat(rupees(diff), F.lit(" below average"))).when(diff < 0, F.concat(rupees(-diff), F.lit(" above average")))
    return F.when(is_price(price) & lowest.isNotNull(), words)


def escape_html(c: Column) -> Column:
    """The five marks of HTML as entities; null as empty."""
    out = F.coalesce(c, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


# The markup of the statistics cell and of the card, element by
# element, with its class names and words.
def stats_html(has: Column, lowest: Column, average: Column, highest: Column) -> Column:
    cells = [
        F.concat(F.lit(f'<div class="price-cell"><span class="price-label">{name}</span><span class="price-value">'), escape_html(rupees(c)), F.lit("</span></div>"))
        for name, c in (("Lowest", lowest), ("Average", average), ("Highest", highest))
    ]
    row = F.concat(F.lit('<div class="price-row">'), *cells, F.lit("</div>"))
    return F.when(has, row).otherwise('<div class="price-insights-unavailable">Price insights unavailable</div>')


def card_html(rank: Column, title: Column, url: Column, canonical_url: Column, image: Column, source: Column, price: Column, review_count: Column, rating_count: Column, rating: Column, insight: Column) -> Column:
    """A product's card."""
    number, safe = rank.cast("string"), escape_html(title)
    link = either(url, canonical_url)
    picture = F.when(
        F.coalesce(image != "", F.lit(False)),
        F.concat(F.lit('<div class="product-image"><img src="'), escape_html(image), F.lit('" alt="'), safe, F.lit('" loading="lazy"></div>')),
    ).otherwise('<div class="product-image product-image-empty" aria-hidden="true">📦</div>')

    def line(name: str, text: Column, missing: str) -> Column:
        return F.coalesce(F.concat(F.lit(f'<div class="{name}">'), text, F.lit("</div>")), F.lit(f'<div class="{name} unavailable">{missing}</div>'))

    stars = F.concat(F.lit('<div class="product-rating"><span class="rating-stars" aria-hidden="true">★</span><span class="rating-value">'), rating_text(rating), F.lit("</span></div>"))
    hint = F.when(insight != "", F.concat(F.lit('<div class="product-price-insight">'), escape_html(insight), F.lit("</div>")))
    action = F.concat(F.lit('<a class="view-btn" href="'), escape_html(link), F.lit('" target="_blank" rel="noopener noreferrer">View on '), escape_html(F.coalesce(F.nullif(source, F.lit("")), F.lit("Amazon"))), F.lit("</a>"))
    return F.concat(
        F.lit('<div class="product-card" data-rank="'), number, F.lit('"><div class="product-rank"><div class="rank-badge '),
        F.when(rank <= 3, F.concat(F.lit("rank-"), number)).otherwise("rank-default"), F.lit('" aria-hidden="true">#'), number,
        F.lit('</div><span class="sr-only">Rank '), number, F.lit("</span></div>"), picture,
        F.lit('<div class="product-info"><div class="product-title">'), F.coalesce(F.nullif(safe, F.lit("")), F.lit("Title unavailable")), F.lit("</div>"),
        line("product-price", rupees(price), "Price unavailable"), line("review-count", count_text(review_count, rating_count), "Review count unavailable"),
        F.coalesce(stars, F.lit("")), F.coalesce(hint, F.lit("")), F.lit('</div><div class="product-actions">'),
        F.when(link.isNotNull(), action).otherwise(""), F.lit("</div></div>"),
    )
