"""The five small lookup tables of the catalog, as data.

They are user-replaceable: every operator takes a ``Dictionaries`` bundle, and the
default bundle holds the values below.  The tables are tiny and fixed in size, so
operators compile them into column expressions (no join, no broadcast needed).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the catalog's published label rules for
# results to agree.  Order matters: it is the tie-break order ("ord").
# ---------------------------------------------------------------------------

# Platform label -> substring signals looked for in the lower-cased page HTML.
# The last label is the fallback and has no signal.
PLATFORM_SIGNALS: list[tuple[str, list[str]]] = [
    ("WordPress", ["/wp-content/", "wp-json", "wp-includes", "wordpress"]),
    ("Webflow", ["webflow.js", "data-wf-page", "webflow.com"]),
    ("Shopify", ["cdn.shopify.com", "x-shopify", "shopify-section", "shopify"]),
    ("Wix", ["wixstatic.com", "wixsite.com", "wix.com"]),
    ("Squarespace", ["static.squarespace.com", "squarespace"]),
    ("Framer", ["framerusercontent.com", "framer"]),
    ("Ghost", ["ghost.io", "data-ghost", "ghost-content-api"]),
    ("Kajabi", ["kajabi.com", "cdn.kajabi.com", "kajabi-storefront"]),
    ("Bubble", ["bubble.io", "bubble.is", "bubbleapps.io"]),
    ("Magento", ["magento", "mage/", "mage."]),
    ("Drupal", ["drupal", "drupal-settings-json", "sites/default"]),
    ("Joomla", ["joomla", "com_content", "Joomla"]),
    ("Next.js", ["_next/static", "__NEXT_DATA__", "next/dist"]),
    ("Nuxt", ["_nuxt", "__NUXT__", "nuxt/"]),
    ("Laravel", ["laravel", "laravel_session", "csrf-token"]),
    ("Weebly", ["weebly.com", "weebly.cloud"]),
    ("Notion", ["notion.site", "notion.so", "notion-api"]),
    ("Carrd", ["carrd.co", "carrd.co/assets"]),
    ("Tilda", ["tilda.ws", "tilda.cc"]),
    ("Thinkific", ["thinkific.com", "thinkific"]),
    ("Teachable", ["teachable.com", "teachable"]),
    ("ClickFunnels", ["clickfunnels.com", "clickfunnels"]),
    ("HubSpot CMS", ["hubspot", "hs-scripts", "hs-sdk"]),
    ("React", ["react", "data-reactroot", "ReactDOM"]),
    ("Vue", ["vue", "vue.js", "__VUE__"]),
    ("Custom", []),
]
FALLBACK_PLATFORM = ("Custom", 0.5)

# Industry label -> keywords counted (non-overlapping) in the cleaned text.
# "it " keeps its trailing blank.
INDUSTRY_KEYWORDS: list[tuple[str, list[str]]] = [
    ("SaaS", ["saas", "software", "platform", "api", "dashboard", "cloud", "subscription"]),
    ("E-commerce", ["shop", "store", "cart", "checkout", "product", "buy", "e-commerce", "ecommerce"]),
    ("Blog", ["blog", "post", "article", "writing", "newsletter"]),
    ("Portfolio", ["portfolio", "projects", "case study", "resume", "cv", "work"]),
    ("Agency", ["agency", "studio", "consulting", "solutions", "services", "we help"]),
    ("Education", ["education", "course", "academy", "learning", "training", "teach", "school"]),
    ("Finance", ["finance", "bank", "loan", "investment", "crypto", "trading", "payment"]),
    ("Healthcare", ["health", "clinic", "medical", "doctor", "wellness", "hospital", "care"]),
    ("Community", ["community", "forum", "members", "discord", "slack", "network"]),
    ("Marketplace", ["marketplace", "market", "vendors", "listings", "buyers", "sellers"]),
    ("Media", ["media", "news", "magazine", "articles", "content", "publish"]),
    ("Fitness", ["fitness", "gym", "workout", "training", "sports", "athlete"]),
    ("Real Estate", ["real estate", "property", "listing", "rent", "housing", "realtor"]),
    ("Restaurant", ["restaurant", "menu", "food", "cafe", "dining", "reservation"]),
    ("Travel", ["travel", "hotel", "booking", "tour", "vacation", "trip"]),
    ("Nonprofit", ["nonprofit", "ngo", "charity", "foundation", "donation", "cause"]),
    ("Technology", ["technology", "developer", "engineering", "it ", "software"]),
    ("Marketing", ["marketing", "seo", "ads", "campaign", "branding", "growth"]),
]

# Words never used as tags.
STOPWORDS: list[str] = [
    "the", "and", "for", "with", "this", "that", "from", "your",
    "you", "are", "was", "were", "has", "have", "will", "our",
    "their", "they", "them", "into", "about", "all", "can", "get",
]

# Query term -> extra terms added once (one level deep).
SYNONYMS: list[tuple[str, list[str]]] = [
    ("shop", ["store", "ecommerce", "e-commerce", "cart", "checkout"]),
    ("store", ["shop", "ecommerce", "e-commerce"]),
    ("ecommerce", ["shop", "store", "online shop", "online store"]),
    ("blog", ["content", "publishing", "articles", "news"]),
    ("content", ["blog", "media"]),
    ("no-code", ["nocode", "bubble", "webflow", "framer"]),
    ("nocode", ["no-code", "bubble", "webflow"]),
    ("design", ["designer", "agency", "studio", "portfolio", "ui", "ux", "creative"]),
    ("portfolio", ["case study", "projects", "design"]),
    ("agency", ["studio", "design", "creative"]),
]

# Platform (lower-cased, trimmed) -> icon key; anything else -> DEFAULT_ICON.
PLATFORM_ICONS: list[tuple[str, str]] = [
    ("wordpress", "layout"),
    ("webflow", "globe"),
    ("shopify", "shopping-bag"),
    ("wix", "layout"),
    ("squarespace", "square"),
    ("framer", "move"),
    ("ghost", "ghost"),
    ("kajabi", "video"),
    ("bubble", "circle"),
    ("notion", "file-text"),
    ("custom", "wrench"),
    ("unknown", "help-circle"),
]
DEFAULT_ICON = "help-circle"

# Label thresholds and sizes.
MIN_CONFIDENCE = 0.15
MAX_TAGS = 10
MAX_INDUSTRIES = 5
MIN_TAG_LENGTH = 4
STYLE_TEXT_LIMIT = 50000
MAX_PARAGRAPHS = 14


@dataclass(frozen=True)
class Dictionaries:
    """Bundle of the lookup tables; pass your own to change the labels."""

    platforms: list = field(default_factory=lambda: PLATFORM_SIGNALS)
    industries: list = field(default_factory=lambda: INDUSTRY_KEYWORDS)
    stopwords: list = field(default_factory=lambda: STOPWORDS)
    synonyms: list = field(default_factory=lambda: SYNONYMS)
    icons: list = field(default_factory=lambda: PLATFORM_ICONS)

    def synonym_map(self) -> dict[str, list[str]]:
        return {k: list(v) for k, v in self.synonyms}

    def platform_rows(self):
        """(ord, label, signal) rows, signals lower-cased, duplicates kept."""
        return [(o, lab, s.lower()) for o, (lab, sigs) in enumerate(self.platforms)
                for s in sigs]


DEFAULT = Dictionaries()
