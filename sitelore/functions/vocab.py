"""Word lists, limits, prices and titles that decide the results.

They are data, not logic: each list is stated plainly in its natural order.
"""

# --- URL rules (all matched as substrings of lower-cased text unless noted) -----------------
ASSET_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".tiff", ".css", ".js",
    ".mjs", ".json", ".xml", ".rss", ".atom", ".pdf", ".zip", ".rar", ".gz", ".tar", ".7z", ".mp4",
    ".mp3", ".avi", ".mov", ".wmv", ".webm", ".wav", ".ogg", ".woff", ".woff2", ".ttf", ".eot",
    ".otf", ".webmanifest", ".map",
)
TRANSACTIONAL_PATHS = (
    "/cart", "/checkout", "/basket", "/account", "/my-account", "/login", "/logout", "/signin",
    "/sign-in", "/signup", "/sign-up", "/register", "/wishlist", "/compare", "/admin", "/wp-admin",
    "/wp-login", "/wp-json", "/order-tracking", "/track-order", "/payment", "/سبد-خرید", "/تسویه",
    "/ورود", "/ثبت-نام", "/حساب-کاربری",
)
ARCHIVE_PATHS = (
    "/tag/", "/tags/", "/author/", "/feed/", "/page/", "/comment", "/برچسب/", "/نویسنده/",
)
FACET_QUERIES = (
    "add-to-cart", "orderby=", "filter_", "filter=", "replytocom=", "add_to_wishlist", "compare=",
    "paged=", "page=", "sort=", "pagenum",
)
PRODUCT_PATHS = (
    "/product/", "/products/", "/dp/", "/item/", "/sku/", "/-p-", "/buy/", "/محصول/", "/کالا/",
)

TIER_SKIP = (
    "wp-admin", "wp-content", "assets", "css", "js", "images", "cache", "login", "register", "cart",
    "checkout",
)
TIER_HIGH = (
    "how-to", "guide", "tutorial", "tips", "best-", "what-is", "vs-", "comparison", "install",
    "setup", "troubleshoot", "solve", "fix", "error", "problem", "about", "contact", "policy",
    "terms", "faq", "help", "support", "service", "branch", "location", "درباره", "تماس", "راهنما",
    "آموزش", "نصب", "حل",
)
TIER_MEDIUM = ("category", "brand", "tag", "archive")
TIER_LOW = ["product"]

CATEGORY_PRIORITY = (
    "about", "contact", "home", "index", "service", "policy", "help", "faq", "support", "terms",
    "privacy",
)
CATEGORY_SKIP = (
    "wp-content", "assets", "css", "js", "images", "uploads", "cache", "admin", "login", "register",
    "cart", "checkout",
)
CATEGORY_COMPANY = (
    "about", "contact", "home", "index", "درباره", "تماس", "قوانین", "شرایط", "privacy", "policy",
    "terms", "faq", "help", "support",
)
CATEGORY_SERVICE = ("service", "support", "help", "خدمات", "پشتیبانی", "راهنما")
CATEGORY_NOT_PRODUCT = (
    "login", "register", "cart", "checkout", "wp-admin", "wp-content", "assets", "css", "js",
    "images",
)

CLUSTER_WORDS = {
    "educational_content": ("how-to", "tutorial", "guide", "install", "setup", "آموزش", "نصب"),
    "company_information": (
        "about", "contact", "policy", "terms", "branch", "location", "درباره", "تماس", "قوانین",
        "شرایط",
    ),
    "troubleshooting_support": (
        "help", "support", "faq", "troubleshoot", "solve", "fix", "error", "problem", "پشتیبانی",
        "راهنما",
    ),
}
# every cluster name, and the order in which the keyword clusters are picked from
# fixed values: lists of an answer that sorts addresses
ANSWER_CATEGORIES = (
    "company_info_pages", "product_pages", "service_pages", "technical_pages", "asset_pages", "other_pages",
)
CLUSTERS = (
    "educational_content", "buying_guides", "technical_explanations", "troubleshooting_support",
    "company_information", "service_information",
)
CLUSTER_PICK_ORDER = ("company_information", "educational_content", "troubleshooting_support")

CORE_PATHS = (
    "/about/", "/about-us/", "/درباره-ما/", "/contact/", "/contact-us/", "/تماس-با-ما/", "/تماس/",
    "/terms/", "/terms-and-conditions/", "/قوانین/", "/شرایط/", "/قوانین-شرایط/", "/privacy/",
    "/privacy-policy/", "/حریم-خصوصی/", "/faq/", "/faqs/", "/سوالات-متداول/", "/پرسش-های-متداول/",
    "/help/", "/support/", "/پشتیبانی/", "/راهنما/", "/services/", "/خدمات/", "/returns/",
    "/return-policy/", "/بازگشت-کالا/", "/shipping/", "/delivery/", "/ارسال/",
    "/installments-rules/", "/اقساط/",
)

# --- limits ---------------------------------------------------------------------------------
PRODUCT_SAMPLE = 15
DISCOVERY_CAP = 5000  # an option of the discovery, off by default
CRAWL_FALLBACK_BELOW = 5
CRAWL_FALLBACK_PAGES = 30
COMPANY_CRAWL_PAGES = 10
PAGE_BUDGET_DEFAULT, PAGE_BUDGET_MAX = 25, 80
TIER_THRESHOLD, TIER_HIGH_LIMIT = 400, 150
CATEGORY_THRESHOLD, CATEGORY_PRIORITY_LIMIT, CATEGORY_TOTAL = 300, 50, 250
CONTACT_LIMIT = 30  # an option of the contact lists, off by default
BATCH_TOKENS = 14000
PART_CHARS = 8_192  # of a part of a long document
TARGET_TOKENS_MIN, TARGET_TOKENS_DEFAULT, TARGET_TOKENS_MAX = 2000, 18000, 120000
CONDENSE_MIN_TOKENS, CONDENSE_TOKENS = 400, 4000
OVERVIEW_CHARS = 6000
PREVIEW_CHARS = 500
# Character caps of the reference behaviour; operators take them as options and default to
# whole texts (None).
HTML_CAP = 3_500_000
LANG_SNIPPET_CHARS = 20_000
CLEAN_CAP, PLAIN_CAP = 40_000, 15_000
SCRIPT_LANG_CAP, LANG_CAP, COLOR_CAP = 5_000, 6_000, 5_000
# response-token ceilings per request kind
MAX_OUTPUT_TOKENS = {"page_extraction": 4000, "section_synthesis": 8000,
                     "language": 50, "prospect": 800, "company_page": 300}

# --- sections -------------------------------------------------------------------------------
SECTIONS = {  # canonical order
    "company_overview": "Company Overview",
    "contact": "Contact Information",
    "products_services": "Products & Services",
    "policies": "Policies (Shipping / Returns / Warranty / Privacy / Terms)",
    "faq": "Frequently Asked Questions",
    "ordering_payment": "How to Order & Payment Methods",
    "support_howto": "Support, How-To & Troubleshooting",
    "additional": "Additional Information",
}
SECTIONS_FA = {
    "company_overview": "معرفی شرکت",
    "contact": "اطلاعات تماس",
    "products_services": "محصولات و خدمات",
    "policies": "قوانین و سیاست‌ها (ارسال / بازگشت / گارانتی / حریم خصوصی / شرایط)",
    "faq": "پرسش‌های متداول",
    "ordering_payment": "نحوه سفارش و روش‌های پرداخت",
    "support_howto": "پشتیبانی، راهنما و عیب‌یابی",
    "additional": "اطلاعات تکمیلی",
}
SECTION_PRIORITY = (
    "contact", "policies", "company_overview", "ordering_payment", "faq", "support_howto",
    "products_services", "additional",
)
REQUIRED_SECTIONS = {  # audit name -> section
    "contact": "contact", "policies": "policies", "faq": "faq", "services": "products_services",
}
TOC_TITLE, TOC_TITLE_FA = "Table of Contents", "فهرست مطالب"

# Page-to-section words, first match wins (our own extractive rule over path and title).
SECTION_WORDS = {
    "contact": ["contact", "تماس"],
    "faq": ["faq", "سوالات-متداول", "پرسش-های-متداول"],
    "policies": ["terms", "privacy", "policy", "policies", "legal", "returns", "refund",
                 "shipping", "delivery", "warranty", "installments-rules", "قوانین", "شرایط",
                 "حریم-خصوصی", "بازگشت-کالا", "ارسال", "اقساط"],
    "ordering_payment": ["how-to-order", "payment-methods", "راهنمای-خرید"],
    "support_howto": ["support", "help", "how-to", "troubleshoot", "پشتیبانی", "راهنما"],
    "products_services": ["services", "products", "خدمات"],
    "company_overview": ["about", "company", "درباره-ما"],
}

# --- languages ------------------------------------------------------------------------------
LANGUAGE_NAMES = {
    "fa": "Persian (Farsi)", "ar": "Arabic", "en": "English", "fr": "French", "de": "German",
    "es": "Spanish", "it": "Italian", "tr": "Turkish", "ru": "Russian", "zh": "Chinese",
    "ja": "Japanese", "ko": "Korean", "hi": "Hindi", "ur": "Urdu", "pt": "Portuguese",
    "nl": "Dutch",
}
DEFAULT_LANGUAGE = "en"
UNKNOWN_LANGUAGE = "the source language"
ARABIC_RANGES = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
PERSIAN_LETTERS = "پچژکگی"
SCRIPT_MIN_LETTERS, SCRIPT_MIN_SHARE = 20, 0.15
STOPWORDS = {  # common function words, our own choice
    "en": (
        "the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "on", "as", "are",
        "this", "be", "by", "at", "from", "or", "an",
    ),
    "fr": (
        "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans",
        "pour", "sur", "au", "avec", "pas", "ne", "ce",
    ),
    "de": (
        "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "nicht", "ein", "eine", "im",
        "auf", "für", "dem", "sich", "des", "als", "auch",
    ),
    "es": (
        "el", "los", "las", "del", "y", "un", "una", "es", "que", "en", "por", "con", "para", "se",
        "su", "al", "lo", "como", "más", "pero",
    ),
}

# --- contacts -------------------------------------------------------------------------------
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_RE = (  # \p{Nd} and \p{Z}: digits and blanks of every script
    r"(?:(?:\+|00)\p{Nd}{1,3}[\s\p{Z}-]?)?(?:\(?\p{Nd}{2,4}\)?[\s\p{Z}-]?){2,5}\p{Nd}{2,4}"
)
PHONE_DIGITS = (7, 15)
DOC_PHONE_RE = r"\p{Nd}{3}[\s\p{Z}-]?\p{Nd}{3,}"

# --- prices, $ per million tokens (input, output) -------------------------------------------
CHEAP_MODEL = "gpt-5-nano"
DEFAULT_PRICE = (0.05, 0.40)
PRICES = {
    "gpt-5-nano": (0.05, 0.40), "gpt-5-mini": (0.25, 2.00), "gpt-5": (1.25, 10.00),
    "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00),
}

# --- colours --------------------------------------------------------------------------------
DEFAULT_BACKGROUND, DEFAULT_BRAND = "#ffffff", "#000000"
# fixed values: descriptions of the defaults
BACKGROUND_FALLBACK = "Default white background (fallback)"
BRAND_FALLBACK = "Default black text (fallback)"
# our own descriptions of colours that were found
BACKGROUND_FORMAT = "Set as a background %d times on the start page"
BRAND_FORMAT = "Used %d times besides backgrounds on the start page"

# --- page elements --------------------------------------------------------------------------
STABLE_IDS = ("react-root", "app", "main", "header", "footer", "content", "nav", "menu")
DYNAMIC_ID_WORDS = ("random", "temp", "gen", "auto")
PERSONAL_ID_WORDS = ("username", "user_", "profile_")
ACTION_WORDS = (
    "follow", "following", "unfollow", "like", "share", "comment", "login", "sign", "submit",
    "home", "profile", "search", "menu", "save", "edit", "delete", "add", "create", "more", "view",
    "show", "hide", "close", "open", "next", "previous", "back", "forward", "up", "down",
    "settings", "options", "message", "send", "posts", "story", "stories", "reels", "tagged",
)
PERSONAL_TEXT_WORDS = ("followers", "following", "posts")
CLASS_WORDS = (
    "btn", "button", "nav", "menu", "header", "footer", "post", "like", "share", "follow",
)
ATTRIBUTE_VALUES = {  # None: any value
    "role": ("button", "link", "menu", "dialog", "tab", "navigation", "main"),
    "type": ("button", "submit", "search"),
    "aria-label": None, "data-testid": None, "name": None, "placeholder": None, "alt": None,
    "title": None,
}
PERSONAL_HREFS = ("/@", "/user/", "/profile/")
# fixed values: tags without content
EMPTY_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source",
    "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
)
# (category, selector, tag or None, attribute or None, test, value)
SELECTORS = [
    ("buttons", "button", "button", None, None, None),
    ("buttons", '[role="button"]', None, "role", "equals", "button"),
    ("buttons", 'input[type="button"]', "input", "type", "equals", "button"),
    ("buttons", 'input[type="submit"]', "input", "type", "equals", "submit"),
    ("links", "a[href]", "a", "href", "present", None),
    ("inputs", "input", "input", None, None, None),
    ("inputs", "textarea", "textarea", None, None, None),
    ("inputs", "select", "select", None, None, None),
    ("forms", "form", "form", None, None, None),
    ("images", "img", "img", None, None, None),
    ("headings", "h1", "h1", None, None, None),
    ("headings", "h2", "h2", None, None, None),
    ("headings", "h3", "h3", None, None, None),
    ("like_buttons", '[aria-label*="like" i]', None, "aria-label", "icontains", "like"),
    ("like_buttons", '[data-testid*="like"]', None, "data-testid", "contains", "like"),
    ("share_buttons", '[aria-label*="share" i]', None, "aria-label", "icontains", "share"),
    ("share_buttons", '[data-testid*="share"]', None, "data-testid", "contains", "share"),
    ("follow_buttons", '[aria-label*="follow" i]', None, "aria-label", "icontains", "follow"),
    ("follow_buttons", '[data-testid*="follow"]', None, "data-testid", "contains", "follow"),
    ("follow_buttons", 'button:contains("Follow")', "button", None, "text", "Follow"),
    ("follower_counts", '[href*="/followers"]', None, "href", "contains", "/followers"),
    ("following_counts", '[href*="/following"]', None, "href", "contains", "/following"),
    ("tweet_content", '[data-testid="tweetText"]', None, "data-testid", "equals", "tweetText"),
]

# --- progress messages, English -> Persian, in match order ----------------------------------
PROGRESS_FA = {
    "Detecting language...": "تشخیص زبان...",
    "Discovering all pages (Sitemap)...": "کشف تمام صفحات (نقشه سایت)...",
    "Performing fallback crawl...": "انجام خزیدن پشتیبان...",
    "Identifying knowledge-rich content clusters...": "شناسایی خوشه‌های محتوای غنی از دانش...",
    "Extracting from company information pages...": "استخراج از صفحات اطلاعات شرکت...",
    "Extracting from educational content pages...": "استخراج از صفحات محتوای آموزشی...",
    "Extracting from troubleshooting support pages...": "استخراج از صفحات پشتیبانی عیب‌یابی...",
    "Extracting from buying guides pages...": "استخراج از صفحات راهنمای خرید...",
    "Extracting from technical explanations pages...": "استخراج از صفحات توضیحات فنی...",
    "Extracting from service information pages...": "استخراج از صفحات اطلاعات خدمات...",
    "Compiling comprehensive knowledge base...": "تدوین پایگاه دانش جامع...",
    "Knowledge base generation completed successfully.": "تولید پایگاه دانش با موفقیت تکمیل شد.",
    "Failed to generate knowledge base.": "تولید پایگاه دانش با شکست مواجه شد.",
    "Capturing main page screenshot...": "گرفتن تصویر کامل صفحه اصلی...",
    "Extracting website colors...": "استخراج رنگ‌های وب‌سایت...",
    "Discovering core website pages...": "کشف صفحات اصلی وب‌سایت...",
    "Extracting knowledge from core pages...": "استخراج دانش از صفحات اصلی...",
    "Fetching homepage...": "دریافت صفحه اصلی...",
    "Extracting knowledge from pages...": "استخراج دانش از صفحات...",
    "Extracting knowledge": "استخراج دانش از صفحات...",
    "Writing section": "در حال نوشتن بخش پایگاه دانش...",
    "Auditing knowledge base completeness...": "بررسی کامل بودن پایگاه دانش...",
}
PAGE_PROGRESS_RE = r"^Extracting from page\s+(\d+/\d+):\s*(.*)$"
PAGE_PROGRESS_FA = "استخراج از صفحه "

# --- sinks ----------------------------------------------------------------------------------
PROSPECT_COLUMNS = (
    "website", "status", "is_potential_customer", "confidence_score", "reasoning_for",
    "reasoning_against", "error",
)
RUN_COLUMNS = (
    "url", "status", "job_id", "start_time", "end_time", "duration_seconds", "pages_processed",
    "main_background_color", "primary_brand_color", "background_color_description",
    "brand_color_description", "total_cost_usd", "prompt_tokens", "completion_tokens", "error",
    "knowledge_base_length",
)
EMPTY_PAGE_ERROR = "Fetched content is empty."

# --- text formats ---------------------------------------------------------------------------
NO_CONTENT = "# Knowledge Base\n\nNo extractable customer knowledge was found on "
SUMMARY_FORMAT = (
    "Deep pipeline: discovered ~%d URLs, selected %d knowledge pages, extracted %d, synthesised %d sections."
)
COMPANY_HEAD, COMPANY_URL, COMPANY_TEXT = "Based on analyses of pages from ", "- URL: ", "\n  Summary: "
LEGACY_HEAD, LEGACY_TITLE, LEGACY_TEXT = "--- Chunk from ", " ---\nTitle: ", "\nContent:\n"
CHUNK_RULE = "\n\n---\n\n"
START_TITLE, START_TYPE = "Main Page", "main_page"
CORE_TYPE, GIVEN_TYPE, GIVEN_TITLE = "auto_discovered_core_page", "specified_core_page", "N/A"
START_CLUSTER = "company_information"
