"""Results depend on these exact lists, patterns and texts.

Every pattern here is valid both for Java regular expressions and for RE2
(no lookaround, no backreference), so the same text can be used on either.
"""

# Sources in order of precedence.
SOURCE_RANK = {"edgar": 0, "lse": 1, "ir": 2}

# Filing forms kept by default.
FORMS = ("10-Q", "10-K", "8-K", "6-K", "20-F", "40-F")

# Title keywords per source, unanchored, case ignored.
RNS_KEYWORDS = (
    r"interim|half[-\s]?year|halfyear|h1|h2|q[1-4]|quarter|trading update"
    r"|results|preliminary|full[-\s]?year|fy"
)
IR_KEYWORDS = (
    r"results|earnings|trading update|quarter|q[1-4]|interim|half[-\s]?year"
    r"|halfyear|h1|h2|full[-\s]?year|fy|financial statements|annual report"
)

# Filing archive and list page addresses.
ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data/"
RNS_HOST = "https://www.londonstockexchange.com"

# Markers inside filing bodies and filing indexes.
ITEM_202 = r"(?i)\bItem\s*2\.02\b"
EXHIBIT_LINK = r'(?i)href="([^"]+?)"[^>]*>\s*(?:EX|Exhibit)[-\s]?99\.1'

# Nodes dropped before reading a page's text.
JUNK_SELECTORS = (
    "nav", "footer", "header", "aside", "script", "style", "form",
    ".ad", ".advert", "[class*='ad-']", ".promo", ".newsletter", ".subscribe",
    ".related", ".social", ".share", ".breadcrumbs", ".tags", ".paywall",
    ".cookie", ".disclaimer", "#comments",
)

# Selectors tried in order for the anchors of an IR page.
IR_ITEM_SELECTORS = (
    "article a", "li a", ".news a", "a.news__link", "a.rss__link",
    ".press-release a",
)

# Class names that mark a date element on an IR page.
IR_DATE_CLASS = r"(?i)date|time|posted|publish"

# Amounts, units and percentages.
CURRENCY = r"[$£€]"
NUMBER = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
UNIT = r"(?:billion|bn|millions?|mn|m|thousand|k)\b"
PERCENT = r"-?\d{1,3}(?:\.\d+)?\s?%"

# Metric -> (shown label, label pattern, longest gap to the amount).
METRICS = {
    "revenue": ("Revenue", r"\b(?:total\s+)?revenue\b", 160),
    "ebitda": ("Adj. EBITDA", r"\b(?:adjusted\s+)?ebitda\b", 160),
    "net_income": ("Net income", r"\bnet\s+(?:income|loss)\b", 160),
    "eps": ("EPS", r"\b(?:adjusted\s+)?(?:diluted\s+)?eps\b", 120),
}

# Year-on-year wording. Group 1 is the verb, group 2 the figure.
YOY_PHRASE = (
    r"(?i)(?:yoy|year[-\s]?over[-\s]?year|vs\.\s*prior\s*year|prior\s*year)[^\n\r]{0,40}?"
    r"(?:(up|down|increase|decrease|grew|rose|fell)\s+)?(" + PERCENT + ")"
)
YOY_VERB = (
    r"(?i)\b(up|down|increase(?:d)?|decrease(?:d)?|grew|rose|fell)\s+(" + PERCENT + ")"
)
YOY_REACH = 200

# Reporting periods in order of precedence; group 2 is the year.
PERIODS = (
    r"(?i)\b(Q[1-4])\s*(20\d{2})\b",
    r"(?i)\b(H[12])\s*(20\d{2})\b",
    r"(?i)\b(first|second|third|fourth)\s+quarter\s+(20\d{2})\b",
    r"(?i)\b(full[-\s]?year|FY)\s*(20\d{2})\b",
)
PERIOD_HEAD = 1000
ORDINAL_QUARTERS = {"first": "Q1", "second": "Q2", "third": "Q3", "fourth": "Q4"}

# Guidance wording and how far a snippet may run on.
GUIDANCE = (
    r"(?i)\b(?:guidance|outlook|reaffirm|raise[sd]?|lower[sd]?|update[sd]? guidance)\b"
    r"[^\n\r]{0,200}"
)
# One of these stands in every text the pattern matches.
GUIDANCE_WORDS = ("guidance", "outlook", "reaffirm", "raise", "lower")
GUIDANCE_TAIL = 160
MAX_GUIDANCE = 2
MAX_HIGHLIGHTS = 6

# Texts of an alert.
SUBJECT_PREFIX = "[Earnings Watch]"
BLANK_HEADLINE = "Update"
NO_FIGURES_NOTE = "Could not confidently extract KPIs; included link and summary context."

# Default lookback in days and list pages per issuer.
LOOKBACK_DAYS = 90
MAX_PAGES = 2

# Sections of an alert's body, in order, by what they hold.
SECTIONS = {
    "_headline": "Headline: ",
    "_final_url": "URL: ",
    "_short_summary": "\nSummary: ",
    "_bullets": "\nKey Highlights:\n - ",
    "_metrics": "\nMetrics:\n - ",
    "_final_thoughts": "\nNotes: ",
}
