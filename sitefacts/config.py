"""Tunable settings and the fixed rule lists of the extraction.

Patterns are written in the Python ``re`` dialect; ``functions.regex.jvm`` turns
``\\w \\s \\d \\b`` into explicit character classes so that a pattern means the
same thing on every Java version.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: the results depend on them, keep them as they are -----------------

PRIORITY_PATHS = (
    "/about", "/company", "/products", "/solutions", "/industries",
    "/pricing", "/contact", "/careers", "/team", "/services",
)

SOCIAL_DOMAINS = {
    "linkedin": ("linkedin.com",),
    "twitter": ("twitter.com", "x.com"),
    "youtube": ("youtube.com", "youtu.be"),
    "instagram": ("instagram.com",),
    "facebook": ("facebook.com", "fb.com"),
    "github": ("github.com",),
}

PROMOTIONAL_PATTERNS = (
    r"free shipping", r"%\s*off", r"use code", r"coupon", r"discount",
    r"limited time", r"special offer", r"order now", r"buy now",
    r"add to cart", r"checkout", r"subscribe", r"newsletter",
)

TRACKING_MARKS = ("utm_", "ref=", "source=", "affiliate")

KEY_PAGES = {
    "about": ("/about", "/company", "/who-we-are", "/our-story", "/about-us", "/who-are-we"),
    "products": ("/products", "/product", "/offerings", "/portfolio"),
    "solutions": ("/solutions", "/solution", "/services", "/service"),
    "industries": ("/industries", "/industry", "/markets", "/sectors", "/therapeutic-areas"),
    "pricing": ("/pricing", "/price", "/plans", "/purchase", "/buy"),
    "careers": ("/careers", "/career", "/jobs", "/join-us", "/hiring", "/work-with-us", "/team"),
    "contact": ("/contact", "/contact-us", "/get-in-touch", "/reach-us", "/connect"),
}

LOGIN_PATHS = ("/login", "/signin", "/sign-in", "/auth", "/authenticate", "/account/login")
LOGIN_TITLE_WORDS = (
    "login", "sign in", "sign-in", "authentication", "access denied",
    "please log in", "member login", "customer login",
)
LOGIN_FORM_ATTR = r"login|signin|auth"
LOGIN_PASSWORD_NAME = r"password|pass"
LOGIN_MAIN_CLASS = r"main|content|hero"
LOGIN_FORM_WORDS = ("login", "sign in", "email", "password")
LOGIN_TEXT_PATTERNS = (
    r"please (log|sign) in to (continue|access|view)",
    r"login (required|to continue|to access)",
    r"sign in (required|to continue|to access)",
    r"you must be (logged in|signed in)",
    r"access denied",
    r"authentication required",
    r"please authenticate",
)
LOGIN_NOTE = (
    "LOGIN_REQUIRED: This website requires login/authentication to access information. "
    "Only publicly accessible content can be scraped."
)

LOGO_ALT = r"logo|company|brand"
LOGO_SKIP_WORDS = ("image", "picture", "icon")
LOGO_TAIL = r"\s*(logo|company|brand).*$"
TITLE_HOME_TAIL = r"\s*[-|–—]\s*(Home|Welcome|Official Site|Official Website).*$"
TITLE_HOME_HEAD = r"^(Home\s*[-|–—]\s*)"
TITLE_SEPARATOR = r"\s*[-|–—]\s*"
TITLE_SLOGAN_WORDS = r"manufacturer|provider|leading|world"
TITLE_SLOGAN_WORDS_LAST = r"manufacturer|provider|leading|world|solutions"
TITLE_ALL_CAPS = r"^[A-Z][A-Z\s-]+[A-Z]?$"
H1_PROMO_WORDS = ("shop", "buy", "order", "welcome to")

HERO_CLASS = r"hero|banner|intro"
TAGLINE_CLASS = r"tagline|subtitle|lead"
TAGLINE_SELECTORS = (
    "p.tagline", ".tagline", "#tagline",
    "h2.subtitle", ".subtitle", ".hero-subtitle",
    "p.lead", ".lead", ".slogan", "p.slogan",
)

EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_SKIP_PAGE = (
    "example.com", "domain.com", "your-email", "email@",
    "test@", "sample@", "placeholder@", "noreply@",
    "no-reply@", "donotreply@", "privacy@", "legal@",
)
EMAIL_SKIP_FOOTER = ("example.com", "domain.com", "noreply@", "no-reply@")

PHONE_PATTERNS = (
    r"\+?\d{1,4}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    r"\+?91[-.\s]?\d{2,5}[-.\s]?\d{5,8}",
    r"\+?\d{1,3}[-.\s]?\d{1,3}[-.\s]?\d{1,3}[-.\s]?\d{1,4}",
    r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\+?44[-.\s]?\d{2,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}",
    r"\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
)
PHONE_PATTERNS_FOOTER = PHONE_PATTERNS[:2]

CLIENT_WORDS = ("our clients", "clients", "customer", "trusted by", "partners")
CLIENT_IMAGE_ALT = r"client|customer|partner"
CLIENT_CLASS = r"client|customer"
CASE_STUDY_WORDS = ("case study", "case studies", "success story", "success stories")
TESTIMONIAL_WORDS = ("testimonial", "testimonials", "what our", "customer review")
CERTIFICATION_WORDS = ("certified", "certification", "award", "awards", "accredited", "iso")

OFFERING_SELECTORS = (
    "section.products", ".product-list", "#products",
    "section.services", ".service-list", "#services",
    ".offerings", "#offerings", ".solutions", "#solutions",
    ".portfolio", "#portfolio",
)
OFFERING_SKIP_WORDS = (
    "about", "contact", "home", "menu", "language", "sort", "filter",
    "search", "cart", "checkout", "login", "sign up", "subscribe",
    "read more", "learn more", "view all", "see all", "shop", "buy now",
)
HEADING_PROMO_WORDS = ("% off", "free shipping", "sale", "discount")

TARGET_KEYWORDS = (
    "industries", "markets", "sectors", "verticals", "therapeutic-areas", "customers", "clients",
)
TARGET_SKIP_WORDS = ("learn more", "read more", "view all", "see all")
TARGET_PATTERNS = (
    r"(?:serving|targeting|focusing on|for)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:industry|market|sector)",
    r"(?:industries|markets|sectors):\s*([^.\n]+)",
)

FOOTER_CLASS = r"footer"
ADDRESS_CLASS = r"address|location|office"
ADDRESS_HINT = r"\d+|street|road|avenue|st|rd|ave|boulevard|blvd"
ADDRESS_LD_PARTS = (
    "streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry",
)
ADDRESS_PATTERNS = (
    r"\d+[\s\w]+(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|circle|ct|place|pl)[\s\w,]+(?:[A-Z]{2}\s)?\d{5,10}",
    r"[\w\s]+(?:street|st|avenue|ave|road|rd|boulevard|blvd)[\s\w,]+(?:[A-Z][a-z]+\s?)+",
)
ADDRESS_WORDS_ZIP = (
    "street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "drive", "dr",
    "lane", "ln", "way", "circle", "ct", "place", "pl",
)
ADDRESS_WORDS_CITY = ("street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd")

SUMMARY_CLASS = r"about|intro|hero|mission"
SUMMARY_CART_WORDS = ("cart", "checkout", "add to", "buy now")

DEPARTMENT_CLASS = r"department|team|organization"
DEPARTMENT_WORDS = (
    "research", "development", "sales", "marketing",
    "operations", "quality", "regulatory", "medical",
    "clinical", "supply", "business",
)
JOB_WORDS = (
    "engineer", "developer", "manager", "analyst", "designer",
    "sales", "marketing", "product", "operations", "scientist",
    "researcher", "director", "specialist", "coordinator", "executive",
)
ROLE_PATTERNS = (r"\b\w+\s+{word}\b", r"\b{word}\s+\w+\b", r"\b\w+\s+\w+\s+{word}\b")

CONTACT_LINK_TEXT = r"contact|get in touch|reach us|connect"

USER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
)

# --- End of the fixed values ---------------------------------------------------------


@dataclass(frozen=True)
class ExtractConfig:
    """Settings of one extraction run.

    ``compat``        reproduce the observed quirks instead of the documented behaviour:
                      head data (JSON-LD, meta) is ignored, social hosts match by substring,
                      ``mailto:`` and other host-less links take up link slots, a bare
                      ``<footer>`` is missed, an empty title part counts as the name.
    ``unicode``       ``\\w \\s \\d \\b`` are Unicode aware (ASCII when False).
    ``login_scope``   ``any`` visited page or only the ``seed`` page can empty the record.
    ``max_emails``, ``max_phones``, ``max_items`` (offerings, targets, roles) bound what one page gives;
    ``max_headings`` (searched for offerings), ``max_section_items`` (of a section), ``max_h1`` (searched
                      for a name), ``max_paragraphs`` and ``max_about_paragraphs`` (searched for a
                      summary) and ``max_summary`` (joined into one) bound what is looked at. None
                      keeps all.
    """

    max_pages: int = 15
    max_depth: int = 5
    links_per_page: int = 5
    priority_paths: tuple[str, ...] = PRIORITY_PATHS
    social_domains: tuple[tuple[str, tuple[str, ...]], ...] = tuple(SOCIAL_DOMAINS.items())
    promotional_patterns: tuple[str, ...] = PROMOTIONAL_PATTERNS
    user_agent: str = USER_AGENT
    compat: bool = False
    unicode: bool = True
    login_scope: str = "any"
    max_emails: int | None = 10
    max_phones: int | None = 5
    max_items: int | None = 15
    max_headings: int | None = 15
    max_section_items: int | None = 15
    max_h1: int | None = 3
    max_paragraphs: int | None = 6
    max_about_paragraphs: int | None = 4
    max_summary: int | None = 3

    @property
    def link_bound(self) -> int:
        """Links of a page that can matter: at most ``max_pages`` of them are ever skipped as visited."""
        return self.links_per_page + self.max_pages
