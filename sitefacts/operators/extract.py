"""Facts of one page as column expressions over ``nodes``, ``text`` and ``url``.

Nothing here moves a row: a page's facts need that page only.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import config as C
from sitefacts.config import ExtractConfig
from sitefacts.functions import nodes as N
from sitefacts.functions import patterns as P
from sitefacts.functions.regex import (
    any_of, collapse, contains_any, empty_strings, first, jvm, len_between, let, strip,
)
from sitefacts.functions.urls import (
    domain_name, is_tracking_url, join_url, resolve_parts, resolve_url, split_url, url_host,
    url_path, without_port,
)
from sitefacts.operators.links import page_links
from sitefacts.operators.login import login_columns

SECTION = ("section", "div")
DEFAULT = ExtractConfig()


def node_page_text(nodes: Column) -> Column:
    """Visible text of the page, white space collapsed."""
    return collapse(F.array_join(N.texts(nodes), " "))


def _plain(text: Column) -> Column:
    """Lower case, hyphens and underscores as blanks."""
    return F.translate(F.lower(text), "-_", "  ")


def _too_short(part: Column, domain: Column) -> Column:
    """Under four characters while the domain name says more."""
    return (F.length(part) < 4) & F.coalesce(F.length(domain) > F.length(part), F.lit(False))


def name_from_title(title: Column, domain: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Company name read from a page title, null when no part qualifies."""
    cut = F.regexp_replace(title, jvm(C.TITLE_HOME_TAIL, ignore_case=True), "")
    cut = F.regexp_replace(cut, jvm(C.TITLE_HOME_HEAD, ignore_case=True), "")
    split_title = F.transform(F.split(cut, jvm(C.TITLE_SEPARATOR)), strip)

    def slogan(p: Column, words: str) -> Column:
        return p.rlike(f"(?i){words}")

    def choose(parts: Column) -> Column:
        known = lambda p: _plain(p).contains(_plain(domain)) | _plain(domain).contains(_plain(p))
        usable = known if cfg.compat else (lambda p: (p != "") & known(p))
        by_domain = F.when(domain.isNotNull(), first(F.filter(parts, usable)))
        by_shape = first(
            F.filter(
                parts,
                lambda p: (p != "")
                & (F.length(p) < 50)
                & ~slogan(p, C.TITLE_SLOGAN_WORDS)
                & (p.rlike(jvm(C.TITLE_ALL_CAPS)) | ((F.length(p) < 30) & ~p.contains(" ")))
                & ~_too_short(p, domain),
            )
        )
        last, head = F.element_at(parts, -1), F.element_at(parts, 1)
        by_last = F.when(
            (F.size(parts) > 1)
            & (last != "")
            & (F.length(last) < 30)
            & ~slogan(last, C.TITLE_SLOGAN_WORDS_LAST)
            & ~_too_short(last, domain),
            last,
        )
        by_head = F.when((head != "") & (F.length(head) < 100) & ~_too_short(head, domain), head)
        return F.coalesce(by_domain, by_shape, by_last, by_head)

    return F.when(title.isNotNull(), let(split_title, choose))


def name_from_headings(headings: Column) -> Column:
    """First of the given ``h1`` texts that is short and not promotional."""
    return first(
        F.filter(
            headings,
            lambda h: (h != "") & (F.length(h) < 100) & ~contains_any(h, C.H1_PROMO_WORDS),
        )
    )


def name_from_logos(alts: Column, domain: Column) -> Column:
    """Name cut from logo texts: the first of four or more characters, else a weak short one."""
    usable = F.filter(
        F.transform(alts, strip),
        lambda a: (a != "") & (F.length(a) < 100) & ~contains_any(a, C.LOGO_SKIP_WORDS),
    )
    tail = jvm(C.LOGO_TAIL, ignore_case=True)
    names = F.filter(
        F.transform(usable, lambda a: strip(F.regexp_replace(a, tail, ""))), lambda a: a != ""
    )
    longer_domain = lambda a: F.coalesce(F.length(domain) > F.length(a), F.lit(False))
    # A short name is dropped again by any later one that the domain name outdoes.
    deciding = F.filter(names, lambda a: longer_domain(a) | (F.length(a) >= 3))
    weak = let(F.try_element_at(deciding, F.lit(-1)), lambda a: F.when(~longer_domain(a), a))
    return F.coalesce(first(F.filter(names, lambda a: F.length(a) >= 4)), weak)


def name_from_domain_or_logo(domain: Column, logo: Column) -> Column:
    outdone = (F.length(logo) <= 3) & (F.length(domain) > F.length(logo))
    return F.coalesce(F.when(logo.isNull() | outdone, domain), logo)


def company_name(nodes: Column, url: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    domain = F.nullif(domain_name(url), F.lit(""))
    return let(domain, lambda d: _company_name(nodes, d, cfg))


def _company_name(nodes: Column, domain: Column, cfg: ExtractConfig) -> Column:
    title = N.first_node(nodes, N.tag_is("title"))
    h1s = at_most(N.find_nodes(nodes, N.tag_is("h1")), cfg.max_h1)
    logos = N.find_nodes(nodes, N.tag_is("img"), N.attr_like("alt", C.LOGO_ALT))
    sources = [
        name_from_title(N.node_text(nodes, title), domain, cfg),
        name_from_headings(F.transform(h1s, lambda h: N.node_text(nodes, h))),
        name_from_domain_or_logo(
            domain, name_from_logos(F.transform(logos, lambda i: N.attr(i, "alt")), domain)
        ),
    ]
    if not cfg.compat:
        names = F.transform(
            N.json_ld(nodes),
            lambda v: F.coalesce(
                N.json_text(v, "$.name"), N.json_text(v, "$.legalName"), N.json_text(v, "$['@name']")
            ),
        )
        site_name = N.first_node(nodes, N.tag_is("meta"), N.attr_is("property", "og:site_name"))
        og = let(
            strip(N.attr(site_name, "content")),
            lambda s: F.when((s != "") & (F.length(s) < 100), s),
        )
        sources = [strip(first(F.filter(names, lambda s: F.length(s) < 100))), og, *sources]
    return F.coalesce(*sources)


def _if_len(text: Column, lo: int, hi: int) -> Column:
    return let(text, lambda t: F.when(len_between(t, lo, hi), t))


def _meta_description(nodes: Column) -> Column:
    meta = N.first_node(nodes, N.tag_is("meta"), N.attr_is("name", "description"))
    return strip(N.attr(meta, "content"))


def tagline(nodes: Column, marked: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """``marked`` holds the nodes with a class or an id."""
    hero = N.first_node(marked, N.tag_is(SECTION), N.attr_like("class", C.HERO_CLASS))

    def in_hero(h: Column) -> Column:
        lead = first(
            N.descendants(
                nodes, h, N.tag_is(("h2", "p", "span")), N.attr_like("class", C.TAGLINE_CLASS)
            )
        )
        paragraph = first(N.descendants(nodes, h, N.tag_is("p")))
        return F.coalesce(
            _if_len(N.node_text(nodes, lead), 10, 200), _if_len(N.node_text(nodes, paragraph), 10, 200)
        )

    h1 = N.first_node(nodes, N.tag_is("h1"))
    h2 = let(h1, lambda h: F.when(h.isNotNull(), N.next_sibling(nodes, h, "h2")))
    selected = [
        _if_len(N.node_text(nodes, N.select_first(marked, css)), 10, 200) for css in C.TAGLINE_SELECTORS
    ]
    described = [] if cfg.compat else [_if_len(_meta_description(nodes), 10, 200)]
    return F.coalesce(
        let(hero, lambda h: F.when(h.isNotNull(), in_hero(h))),
        *described,
        _if_len(N.node_text(nodes, h2), 10, 200),
        *selected,
    )


def at_most(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def _link_targets(links: Column, scheme: str) -> Column:
    """Targets of ``mailto:`` or ``tel:`` links; the scheme is found in any case, cut in lower case."""
    found = F.filter(links, lambda n: N.attr(n, "href").rlike(f"^(?i){scheme}"))
    return F.transform(found, lambda n: F.replace(N.attr(n, "href"), F.lit(scheme), F.lit("")))


def extract_emails(links: Column, text: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Addresses of mail links, then of the text; ``max_emails`` at most."""
    linked = F.transform(
        _link_targets(links, "mailto:"), lambda t: strip(F.substring_index(t, "?", 1))
    )
    linked = F.filter(linked, lambda e: e.contains("@"))
    found = P.email_matches(text, C.EMAIL_SKIP_PAGE, cfg.unicode)
    return at_most(F.array_distinct(F.concat(linked, found)), cfg.max_emails)


def extract_phones(links: Column, text: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Numbers of phone links, then of the text; ``max_phones`` at most."""
    linked = F.filter(F.transform(_link_targets(links, "tel:"), strip), lambda t: t != "")
    found = P.phone_matches(text, C.PHONE_PATTERNS, cfg.unicode)
    return at_most(F.array_distinct(F.concat(linked, found)), cfg.max_phones)


def _on_platform(host: Column, domains: tuple[str, ...], cfg: ExtractConfig) -> Column:
    if cfg.compat:
        return F.lower(host).rlike(any_of(domains))
    return without_port(host).rlike(rf"(?:^|\.)(?:{any_of(domains)})$")


def social_links(links: Column, site_url: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Platform to the first link of the page that leads there; a link serves one platform."""
    every_domain = any_of(d for _, domains in cfg.social_domains for d in domains)
    mentioned = F.filter(
        links,
        lambda n: F.lower(N.attr(n, "href")).rlike(every_domain)
        | F.lower(url_host(site_url)).rlike(every_domain),
    )
    resolved = let(
        split_url(site_url),
        lambda base: F.transform(
            mentioned,
            lambda n: let(
                resolve_parts(base, N.attr(n, "href")),
                lambda link: F.struct(join_url(link).alias("url"), link["host"].alias("host")),
            ),
        ),
    )
    usable = F.filter(resolved, lambda u: ~is_tracking_url(u["url"]))
    platforms = [p for p, _ in cfg.social_domains]
    none = F.struct(*[F.lit(None).cast("string").alias(p) for p in platforms])

    def take(found: Column, link: Column) -> Column:
        fields, free = [], F.lit(True)
        for platform, domains in cfg.social_domains:
            fits = free & found[platform].isNull() & _on_platform(link["host"], domains, cfg)
            fields.append(F.when(fits, link["url"]).otherwise(found[platform]).alias(platform))
            free = free & ~fits
        return F.struct(*fields)

    def to_map(found: Column) -> Column:
        entries = [F.struct(F.lit(p).alias("key"), found[p].alias("value")) for p in platforms]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    return let(F.aggregate(usable, none, take), to_map)


def key_pages(url: Column) -> Column:
    """Labels of a URL by path, in rule order."""
    path = url_path(url)
    labels = [F.when(contains_any(path, words), F.lit(label)) for label, words in C.KEY_PAGES.items()]
    return F.filter(F.array(*labels), lambda label: label.isNotNull())


def proof_signals(nodes: Column, marked: Column, text: Column) -> Column:
    shown = F.exists(nodes, N.both(N.tag_is("img"), N.attr_like("alt", C.CLIENT_IMAGE_ALT))) | F.exists(
        marked, N.both(N.tag_is(SECTION), N.attr_like("class", C.CLIENT_CLASS))
    )
    return F.struct(
        F.when(contains_any(text, C.CLIENT_WORDS), shown).otherwise(False).alias("clients"),
        contains_any(text, C.CASE_STUDY_WORDS).alias("case_studies"),
        contains_any(text, C.TESTIMONIAL_WORDS).alias("testimonials"),
        contains_any(text, C.CERTIFICATION_WORDS).alias("certifications_awards"),
    )


def _item_texts(nodes: Column, section: Column, tags: tuple[str, ...], limit: int | None) -> Column:
    """Texts of the first items of a section, counted before any filter."""

    def read(s: Column) -> Column:
        items = N.descendants(nodes, s, N.tag_is(tags), limit=limit)
        return F.transform(items, lambda i: N.node_text(nodes, i))

    return let(section, lambda s: F.when(s.isNotNull(), read(s)).otherwise(empty_strings()))


def primary_offerings(nodes: Column, marked: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    listed = F.flatten(
        F.array(
            *[
                _item_texts(nodes, N.select_first(marked, css), ("li", "div", "h3", "h4", "article"), cfg.max_section_items)
                for css in C.OFFERING_SELECTORS
            ]
        )
    )
    kept = F.array_distinct(
        F.filter(
            listed, lambda t: len_between(t, 3, 100) & ~contains_any(t, C.OFFERING_SKIP_WORDS)
        )
    )
    headings = F.transform(
        at_most(N.find_nodes(nodes, N.tag_is(("h2", "h3"))), cfg.max_headings),
        lambda h: N.node_text(nodes, h),
    )
    headings = F.filter(
        headings,
        lambda t: len_between(t, 3, 80)
        & ~contains_any(t, C.OFFERING_SKIP_WORDS + C.HEADING_PROMO_WORDS),
    )
    return let(
        kept,
        lambda k: at_most(
            F.when(F.size(k) < 5, F.array_distinct(F.concat(k, headings))).otherwise(k), cfg.max_items
        ),
    )


def target_customers(
    nodes: Column, marked: Column, text: Column, cfg: ExtractConfig = DEFAULT
) -> Column:
    sections = [
        F.coalesce(
            N.first_node(marked, N.tag_is(SECTION), N.attr_like("class", word)),
            N.first_node(marked, N.tag_is(SECTION), N.attr_like("id", word)),
        )
        for word in C.TARGET_KEYWORDS
    ]
    listed = F.flatten(
        F.array(*[_item_texts(nodes, s, ("li", "div", "span", "h3", "h4"), cfg.max_section_items) for s in sections])
    )
    kept = F.filter(
        listed, lambda t: len_between(t, 3, 100) & ~contains_any(t, C.TARGET_SKIP_WORDS)
    )
    mentioned = P.target_mentions(text, cfg.unicode)
    return at_most(F.array_distinct(F.concat(kept, mentioned)), cfg.max_items)


def _footer_by_class(nodes: Column, cfg: ExtractConfig) -> Column:
    """Footer by class; the bare element counts too unless ``compat`` is set."""
    by_class = N.attr_like("class", C.FOOTER_CLASS)
    footer, div = N.tag_is("footer"), N.tag_is("div")
    if cfg.compat:
        return N.first_node(nodes, N.tag_is(("footer", "div")), by_class)
    return N.first_node(nodes, N.either(footer, N.both(div, by_class)))


def physical_address(
    nodes: Column, marked: Column, text: Column, cfg: ExtractConfig = DEFAULT
) -> Column:
    placed = N.attr_like("class", C.ADDRESS_CLASS)

    def in_footer(footer: Column) -> Column:
        place = first(N.descendants(nodes, footer, N.tag_is(("address", "div", "p")), placed))
        blanks = jvm(r"\s+")
        return _if_len(F.regexp_replace(N.node_text(nodes, place, ", "), blanks, " "), 10, 300)

    def from_parts(block: Column) -> Column:
        parts = [N.json_number_or_text(block, f"$.address.{part}") for part in C.ADDRESS_LD_PARTS]
        return F.nullif(F.concat_ws(", ", *parts), F.lit(""))

    footer = _footer_by_class(nodes, cfg)
    tagged = N.first_node(nodes, N.tag_is("address"))
    boxes = F.transform(
        N.find_nodes(marked, N.tag_is(("div", "p", "span")), placed),
        lambda n: N.node_text(nodes, n, ", "),
    )
    hint = jvm(C.ADDRESS_HINT, ignore_case=True)
    described = (
        []
        if cfg.compat
        else [first(F.filter(F.transform(N.json_ld(nodes), from_parts), lambda a: a.isNotNull()))]
    )
    return F.coalesce(
        let(footer, lambda f: F.when(f.isNotNull(), in_footer(f))),
        *described,
        _if_len(N.node_text(nodes, tagged, ", "), 10, 300),
        first(F.filter(boxes, lambda t: len_between(t, 10, 300) & t.rlike(hint))),
        P.address_in_text(text, cfg.unicode),
    )


def _summary(paragraphs: Column, cfg: ExtractConfig) -> Column:
    """The first paragraphs joined; a joined text that does not fit is dropped, not cut."""
    return _if_len(F.array_join(at_most(paragraphs, cfg.max_summary), " "), 50, 500)


def what_they_do(nodes: Column, marked: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    plain = lambda t: (F.length(t) > 30) & ~P.is_promotional(t, cfg.promotional_patterns)
    about = N.first_node(marked, N.tag_is(SECTION), N.attr_like("class", C.SUMMARY_CLASS))
    in_about = F.filter(_item_texts(nodes, about, ("p",), cfg.max_about_paragraphs), plain)
    in_page = F.filter(
        F.transform(
            at_most(N.find_nodes(nodes, N.tag_is("p")), cfg.max_paragraphs), lambda p: N.node_text(nodes, p)
        ),
        lambda t: plain(t) & ~contains_any(t, C.SUMMARY_CART_WORDS),
    )
    described = (
        []
        if cfg.compat
        else [
            let(
                _meta_description(nodes),
                lambda d: F.when(
                    len_between(d, 50, 500) & ~P.is_promotional(d, cfg.promotional_patterns), d
                ),
            )
        ]
    )
    return F.coalesce(*described, _summary(in_about, cfg), _summary(in_page, cfg))


def roles_departments(
    nodes: Column, marked: Column, text: Column, cfg: ExtractConfig = DEFAULT
) -> Column:
    section = N.first_node(marked, N.tag_is(SECTION), N.attr_like("class", C.DEPARTMENT_CLASS))
    departments = F.filter(
        _item_texts(nodes, section, ("li", "div", "h3", "h4"), cfg.max_section_items),
        lambda t: len_between(t, 3, 100) & contains_any(t, C.DEPARTMENT_WORDS),
    )
    roles = P.role_mentions(text, cfg.unicode)
    return at_most(F.array_distinct(F.concat(departments, roles)), cfg.max_items)


def footer_contacts(nodes: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Addresses and numbers of the footer; no cap, and a shorter list of placeholders."""
    footer = F.coalesce(
        _footer_by_class(nodes, cfg),
        N.first_node(nodes, N.tag_is(("footer", "div")), N.attr_like("id", C.FOOTER_CLASS)),
    )
    text = let(
        footer, lambda f: F.when(f.isNotNull(), N.node_text(nodes, f, " ")).otherwise(F.lit(""))
    )
    return let(
        text,
        lambda t: F.struct(
            F.array_distinct(P.email_matches(t, C.EMAIL_SKIP_FOOTER, cfg.unicode)).alias("emails"),
            F.array_distinct(P.phone_matches(t, C.PHONE_PATTERNS_FOOTER, cfg.unicode)).alias("phones"),
        ),
    )


def contact_page(nodes: Column, url: Column, labels: Column) -> Column:
    """The page itself when it is a contact page, else its first link that reads like one."""
    link = first(N.links_by_text(nodes, C.CONTACT_LINK_TEXT))
    linked = F.when(link.isNotNull(), resolve_url(url, N.attr(link, "href")))
    return F.when(F.array_contains(labels, "contact"), url).otherwise(linked)


def careers_page(url: Column, labels: Column) -> Column:
    return F.when(F.array_contains(labels, "careers"), url)


FACTS = (
    "key_pages", "company_name", "tagline", "what_they_do", "offerings", "targets", "proof",
    "social", "emails", "phones", "address", "contact_page", "careers_page", "roles",
)


@lru_cache(maxsize=8)
def _shared_columns(application: str) -> dict[str, Column]:
    nodes = F.col("nodes")
    return {
        "text": node_page_text(nodes),
        "marked": F.filter(
            nodes,
            lambda n: F.map_contains_key(n["attrs"], "class") | F.map_contains_key(n["attrs"], "id"),
        ),
        "anchors": N.find_nodes(nodes, N.tag_is("a"), N.has_attr("href")),
        "key_pages": key_pages(F.col("url")),
    }


def structured_pages(parsed: DataFrame) -> DataFrame:
    """Parsed pages with the columns the extractors share: ``text``, ``marked``, ``anchors``, ``key_pages``."""
    return parsed.withColumns(_shared_columns(_application(parsed)))


def _application(df: DataFrame) -> str:
    return df.sparkSession.sparkContext.applicationId


@lru_cache(maxsize=8)
def _fact_columns(cfg: ExtractConfig, application: str) -> dict[str, Column]:
    """The extractors bound to the shared columns, built once per session and setting.

    A column is only an unresolved expression, so the same objects serve every page table; building
    them takes some seconds of round trips to the JVM.
    """
    nodes, marked, text = F.col("nodes"), F.col("marked"), F.col("text")
    anchors, url = F.col("anchors"), F.col("url")
    labels, footer = F.col("key_pages"), F.col("footer")
    flags = list(login_columns(cfg).values())
    return {
        "login": reduce(lambda a, b: a | b, flags),
        "links": page_links(anchors, url, F.col("site"), cfg),
        "company_name": company_name(nodes, url, cfg),
        "tagline": tagline(nodes, marked, cfg),
        "what_they_do": what_they_do(nodes, marked, cfg),
        "offerings": primary_offerings(nodes, marked, cfg),
        "targets": target_customers(nodes, marked, text, cfg),
        "proof": proof_signals(nodes, marked, text),
        "social": social_links(anchors, F.col("site_url"), cfg),
        "emails": F.array_distinct(F.concat(footer["emails"], extract_emails(anchors, text, cfg))),
        "phones": F.array_distinct(F.concat(footer["phones"], extract_phones(anchors, text, cfg))),
        "address": physical_address(nodes, marked, text, cfg),
        "contact_page": contact_page(nodes, url, labels),
        "careers_page": careers_page(url, labels),
        "roles": F.when(
            F.array_contains(labels, "careers"), roles_departments(nodes, marked, text, cfg)
        ).otherwise(empty_strings()),
    }


@lru_cache(maxsize=8)
def _footer_column(cfg: ExtractConfig, application: str) -> dict[str, Column]:
    return {"footer": footer_contacts(F.col("nodes"), cfg)}


def page_facts(parsed: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """All facts of every parsed page plus its login verdict and its links; one narrow stage.

    Needs ``site``, ``site_url``, ``url``, ``headers`` and ``nodes``. Name and tagline are
    extracted on every page; which pages may supply them depends on the visit (see ``fold``).
    """
    application = _application(parsed)
    return (
        structured_pages(parsed)
        .withColumns(_footer_column(cfg, application))
        .select(
            *[c for c in parsed.columns if c != "nodes"],
            "key_pages",
            *[c.alias(name) for name, c in _fact_columns(cfg, application).items()],
        )
    )


def walk_facts(parsed: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """Only what a walk needs of every parsed page: its login verdict and its links; one narrow stage."""
    application = _application(parsed)
    shared, facts = _shared_columns(application), _fact_columns(cfg, application)
    return parsed.withColumns({name: shared[name] for name in ("text", "anchors")}).select(
        *[c for c in parsed.columns if c != "nodes"], *[facts[name].alias(name) for name in ("login", "links")]
    )
