"""Fixed word lists and limits, stated plainly, and the small maps derived from
them."""

from __future__ import annotations

# Terms that mark an accessory.
ACCESSORY_TERMS = [
    "case", "cover", "cable", "charger", "charging", "adapter", "holder", "stand", "skin", "protector", "guard",
    "replacement", "tips", "tip", "pouch", "sleeve", "strap", "cord", "dock", "mount", "clip", "band",
]

# Words of one intent; the first names the group.
INTENT_GROUPS = [
    ["airpods", "airdopes", "earbuds", "earbud", "earphones", "earphone", "headphones", "headphone", "buds", "bud", "pods", "pod", "airbuds", "earpods", "tws", "neckband"],
    ["case", "cover", "protector", "guard", "pouch", "sleeve", "skin"],
    ["cable", "charger", "charging", "adapter", "cord"],
    ["holder", "stand", "dock", "mount", "strap", "clip", "band"],
    ["tips", "tip"],
]

# Two words that are read as one.
PHRASES = [("bear", "buds", "earbuds"), ("bear", "phones", "earphones"), ("bear", "pods", "earpods")]

# Words of a query that say nothing.  The last one is a quirk of
# the lookup it stands for, which finds an inherited name.
STOPWORDS = [
    "the", "a", "an", "and", "or", "for", "with", "of", "in", "on", "to", "is", "are", "by", "at", "from", "under", "below", "above", "over", "rs", "inr",
    "constructor",
]

# Terms of the audio category, and words of a query that ask for it.
AUDIO_TERMS = [
    "earbud", "earbuds", "earphone", "earphones", "headphone", "headphones", "headset", "speaker", "speakers", "bluetooth", "tws", "neckband",
    "earpods", "airpods", "airbuds", "audio", "sound", "wireless ear", "wireless earbud", "wireless earphone",
]
AUDIO_QUERY = [
    "airpods", "airpod", "airbuds", "earbud", "earbuds", "earphone", "earphones", "headphone", "headphones", "headset", "speaker", "speakers",
    "tws", "neckband", "bluetooth", "audio", "sound", "earpod",
]

# Titles that are none.
PLACEHOLDER_TITLES = ["sponsored", "untitled", "no title", "n/a", "na", "unknown", "product", "loading"]

# Parameters of a page's URL that do not identify it.
VOLATILE_PARAMS = ["ref", "psc", "qid", "sr", "th", "keywords", "__mk", "smid", "dchild", "srs", "spia", "sp_ia", "slot", "slotid", "pf"]
VOLATILE_PREFIXES = ["pd_", "ref_", "pf_rd_", "pldn"]

# Messages that may be shown; the rest become the last one.
MESSAGES = {
    "noProducts": "No products found on this page.",
    "noProductsHint": "Make sure a supported shopping site search-results page is open, then analyze again.",
    "budgetNoMatch": "No products found within your budget.",
    "budgetNoMatchHint": "Try widening or increasing your budget range.",
    "allSponsored": "No non-sponsored products found.",
    "allSponsoredHint": "Sponsored listings are excluded from the rankings.",
    "noRelevant": "No relevant products found for this search.",
    "noRelevantHint": "Products were detected, but none closely match your search. Try a different search term.",
    "notAmazonPage": "Open a supported shopping site search-results page first.",
    "notSearchResults": "Navigate to a search results page, then click Analyze.",
    "cannotAccessTab": "Cannot access the current tab. Please try again.",
    "analyzeFailed": "Could not analyze this page. Please refresh and try again.",
}
GENERIC_ERROR = "Something went wrong while analyzing this page. Please refresh and try again."

#: Products of a display page; search pages of one analysis.
PAGE_SIZE, MAX_PAGES = 4, 5
#: A count of feedback at or above this is no count.
COUNT_CEILING = 100_000_000


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


#: Singular accessory terms, and the name of the group of each singular word.
ACCESSORIES = sorted({singular(t) for t in ACCESSORY_TERMS})
GROUP_OF = {singular(word): singular(group[0]) for group in reversed(INTENT_GROUPS) for word in reversed(group)}
#: Audio terms, the longest first, as they are looked for.
AUDIO_BY_LENGTH = sorted(AUDIO_TERMS, key=len, reverse=True)
