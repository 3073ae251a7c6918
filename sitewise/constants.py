"""Fixed values and default limits."""

from __future__ import annotations

from itertools import product

# Words which mark a URL as worth visiting.
KEYWORDS = (
    "about", "contact", "services", "service", "products", "product", "solutions",
    "pricing", "plans", "menu", "locations", "location", "stores", "store",
    "team", "people", "leadership", "company", "who-we-are", "our-story",
    "careers", "jobs", "faq", "support", "help", "shipping", "returns",
)

# Paths tried on every site, in this order.
COMMON_PATHS = (
    "/about", "/about-us", "/company", "/who-we-are", "/our-story",
    "/contact", "/contact-us", "/locations", "/location",
    "/services", "/products", "/solutions", "/pricing", "/plans",
    "/menu", "/shop", "/collections", "/catalog",
    "/faq", "/support", "/help",
)

# Traces of client-side rendering in the raw HTML.
SHELL_MARKERS = (
    r'id="__next"', r'id="root"', r"data-reactroot",
    r"window\.__INITIAL_STATE__", r"__NUXT__",
)

# Elements and ARIA roles treated as page clutter.
CLUTTER_TAGS = ("nav", "header", "footer", "aside", "iframe", "form", "svg", "canvas")
CLUTTER_ROLES = ("navigation", "banner", "contentinfo")

# Hrefs with these starts are never followed.
SKIPPED_HREF_STARTS = ("mailto:", "tel:", "javascript:", "#")

# Statuses worth another try.
RETRY_STATUSES = (429, 500, 502, 503, 504)

# Sitemap files in order of preference.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml")

# Default limits.
MAX_PAGES = 12
MAX_LINKS = 20
MAX_HINTS = 10
MAX_RETRIES = 3
MAX_HEADINGS = 50
MAX_STATUSES = 50
MAX_FAILURES = 25
MAX_CHARS_FULL = 250_000
PREVIEW_CHARS = 8_000
MIN_TEXT = 900
MIN_PAGE_CHARS = 100
MIN_EXTRACT_CHARS = 200
SHELL_CHARS = 800
CLUTTER_CHARS = 400
TIME_BUDGET_SEC = 45
PAGE_DELAY_SEC = 0.6
SAVE_EVERY = 10
COMMON_PATH_SCORE = 3

# Default public suffixes.  A short, rule-built list; callers with the full
# public list pass their own (plain, ``*.x`` and ``!x`` rules are understood).
_GENERIC = (
    "com", "net", "org", "info", "biz", "edu", "gov", "mil", "int", "io", "co",
    "ai", "app", "dev", "shop", "store", "online", "site", "tech", "me", "tv",
)
_COUNTRIES = (
    "ar", "at", "au", "be", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "es",
    "eu", "fi", "fr", "gr", "hk", "hu", "id", "ie", "il", "in", "it", "jp", "kr",
    "mx", "my", "nl", "no", "nz", "pe", "ph", "pl", "pt", "ro", "ru", "se", "sg",
    "th", "tr", "tw", "ua", "uk", "us", "vn", "za",
)
_SECOND_LEVEL = ("co", "com", "net", "org", "gov", "edu", "ac")
_WITH_SECOND_LEVEL = (
    "ar", "au", "br", "cn", "hk", "id", "il", "in", "jp", "kr", "mx", "my", "nz",
    "pe", "ph", "sg", "th", "tr", "tw", "ua", "uk", "vn", "za",
)
DEFAULT_SUFFIXES = (
    _GENERIC
    + _COUNTRIES
    + tuple(f"{second}.{country}" for second, country in product(_SECOND_LEVEL, _WITH_SECOND_LEVEL))
)

# What a character in a link takes from a block's weight, and what every block pays.
LINK_WEIGHT = 3
BLOCK_TOLL = 20

# Above this many rules a suffix list is joined as a table, not inlined.
MAX_INLINE_SUFFIXES = 20_000

# Fixed value: the fetch method which means that a browser rendered the page.
BROWSER_METHOD = "playwright"
