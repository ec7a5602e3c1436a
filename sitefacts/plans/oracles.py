"""The named queries again as SQL over the raw tables, for a second engine to check.

Written from the rules, not from the Spark plans: regular expressions over the HTML stand in for the
parsed elements, and the walks are recursive queries.
"""

from __future__ import annotations

import re

from sitefacts import config as C

_WORD, _DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
_SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def rx(pattern: str, ignore_case: bool = False) -> str:
    """SQL literal of a Python pattern in the RE2 dialect (``\\b`` stays ASCII there)."""
    classes = {"w": _WORD, "s": _SPACE, "d": _DIGIT}
    out, in_class = [], False
    for piece in re.findall(r"\\.|.", pattern, re.S):
        if piece[0] == "\\" and piece[1] in classes:
            out.append(classes[piece[1]] if in_class else f"[{classes[piece[1]]}]")
        else:
            in_class = piece == "[" or (in_class and piece != "]")
            out.append(piece)
    return "'" + ("(?i)" if ignore_case else "") + "".join(out).replace("'", "''") + "'"


def words(items) -> str:
    """SQL literal of an alternation of plain words."""
    return "'" + "|".join(re.sub(r"([.+*?^$()\[\]{}|\\])", r"\\\1", w) for w in items) + "'"


def has(text: str, items) -> str:
    return f"regexp_matches(lower({text}), {words(items)})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def decode(x: str) -> str:
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        # A missing semicolon is fine where the name clearly ends.
        name = entity.removesuffix(";")
        x = rf"regexp_replace({x}, '{name}(?:;|$|([^-.a-zA-Z0-9;]))', '{char}\1', 'g')"
    return x


_OPAQUE = (
    r"'(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>'"
)
_TAG = r"'(?s)</?[A-Za-z!?][^>]*>'"


def glue(x: str) -> str:
    pieces = f"string_split_regex({x}, {_TAG})"
    return f"array_to_string(list_transform({pieces}, lambda z: {trim(decode('z'))}), '')"


def collapse(x: str) -> str:
    blanks = f"'[{_SPACE}]+'"
    return trim(f"regexp_replace({x}, {blanks}, ' ', 'g')")


def distinct(items: str) -> str:
    """Ordered distinct of a list column (a plain name, since it is used twice)."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def joined(items: str) -> str:
    return f"array_to_string({items}, ' ; ')"


def scheme(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def host(u: str) -> str:
    return rf"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def path(u: str) -> str:
    full = rf"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"regexp_replace({full}, ';[^/]*$', '')"


def canonical(u: str) -> str:
    return f"{scheme(u)} || '://' || {host(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END"


def emails(text: str, skip) -> str:
    found = f"regexp_extract_all({text}, {rx(C.EMAIL_PATTERN)})"
    return f"list_filter({found}, lambda e: NOT {has('e', skip)})"


def phones(text: str, patterns) -> str:
    found = ", ".join(f"regexp_extract_all({text}, {rx(p)})" for p in patterns)
    ten = f"length(regexp_replace(m, '[^{_DIGIT}+]', '', 'g')) >= 10"
    kept = f"list_filter(flatten([{found}]), lambda m: {ten})"
    return f"list_transform({kept}, lambda m: {trim('m')})"


def promotional(text: str) -> str:
    pattern = rx("|".join(C.PROMOTIONAL_PATTERNS))
    return f"regexp_matches(lower({text}), {pattern})"


def targets(text: str) -> str:
    a = f"regexp_extract_all({text}, {rx(C.TARGET_PATTERNS[0], True)}, 1)"
    b = f"regexp_extract_all({text}, {rx(C.TARGET_PATTERNS[1], True)}, 1)"
    stripped = f"list_transform(flatten([{a}, {b}]), lambda m: {trim('m')})"
    return f"list_filter({stripped}, lambda m: length(m) > 3 AND length(m) < 100)"


def roles(text: str) -> str:
    """Job words in rule order. Title case restarts after each character without case."""
    found = []
    for w in C.JOB_WORDS:
        for p in C.ROLE_PATTERNS:
            pattern = rx(p.format(word=w))
            found.append(f"regexp_extract_all(lower({text}), {pattern})")
    pieces = r"regexp_extract_all(m, '[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+')"
    titled = f"array_to_string(list_transform({pieces}, lambda q: upper(q[1]) || q[2:]), '')"
    every = f"list_transform(flatten([{', '.join(found)}]), lambda m: {titled})"
    return f"list_filter({every}, lambda m: length(m) > 5 AND length(m) < 50)"


def longest(items: str) -> str:
    top = f"list_max(list_transform({items}, lambda y: length(y)))"
    return f"list_filter({items}, lambda x: length(x) = {top})[1]"


def fits(x: str, lo: int, hi: int) -> str:
    return f"CASE WHEN length({x}) > {lo} AND length({x}) < {hi} THEN {x} END"


# --- Pages with their text, links and facts --------------------------------------------

_DOMAIN_LABEL = rf"regexp_extract(regexp_replace({host('url')}, '^www\.', ''), '^([^.]*)', 1)"
_CAPITAL = "upper(p[1]) || lower(p[2:])"
_DOMAIN = f"""
  CASE WHEN contains({_DOMAIN_LABEL}, '-') THEN array_to_string(list_transform(
         list_filter(string_split({_DOMAIN_LABEL}, '-'), lambda p: p <> ''), lambda p: {_CAPITAL}), '-')
       WHEN {_DOMAIN_LABEL} <> '' THEN array_to_string(list_transform(
         regexp_extract_all({_DOMAIN_LABEL}, '[A-Za-z]+|[^A-Za-z]+'), lambda p: {_CAPITAL}), '') END"""

_PAGES = rf"""
base AS (
  SELECT page_id, {host('url')} AS site, {canonical('url')} AS url,
         regexp_replace(html, {_OPAQUE}, ' ', 'g') AS body
  FROM pages),
page AS (
  SELECT *, {collapse(decode(f"regexp_replace(body, {_TAG}, ' ', 'g')"))} AS text,
         {glue("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         list_transform(regexp_extract_all(body, '(?is)<h1[^>]*>(.*?)</h1>', 1)[1:3],
                        lambda h: {glue('h')}) AS h1s,
         list_transform(regexp_extract_all(body, '(?s)<a\s[^>]*?href="([^"]*)"', 1),
                        lambda h: {decode('h')}) AS hrefs,
         {_DOMAIN} AS domain
  FROM base)"""

_PLAIN_P = "translate(lower(p), '-_', '  ')"
_PLAIN_D = "translate(lower(domain), '-_', '  ')"
_SHORT = "(length(p) < 4 AND coalesce(length(domain) > length(p), false))"
_NAMES = rf"""
titled AS (
  SELECT *, list_transform(string_split_regex(
           regexp_replace(regexp_replace(title, {rx(C.TITLE_HOME_TAIL, True)}, ''),
                          {rx(C.TITLE_HOME_HEAD, True)}, ''),
           {rx(C.TITLE_SEPARATOR)}), lambda p: {trim('p')}) AS parts
  FROM page),
chosen AS (
  SELECT *, list_filter(parts, lambda p: p <> '' AND
              (contains({_PLAIN_P}, {_PLAIN_D}) OR contains({_PLAIN_D}, {_PLAIN_P})))[1] AS by_domain,
         list_filter(parts, lambda p: p <> '' AND length(p) < 50 AND NOT {_SHORT}
              AND NOT regexp_matches(p, {rx(C.TITLE_SLOGAN_WORDS, True)})
              AND (regexp_matches(p, {rx(C.TITLE_ALL_CAPS)}) OR (length(p) < 30 AND NOT contains(p, ' '))))[1]
           AS by_shape,
         list_filter(parts[-1:], lambda p: len(parts) > 1 AND p <> '' AND length(p) < 30 AND NOT {_SHORT}
              AND NOT regexp_matches(p, {rx(C.TITLE_SLOGAN_WORDS_LAST, True)}))[1] AS by_last,
         list_filter(parts[1:1], lambda p: p <> '' AND length(p) < 100 AND NOT {_SHORT})[1] AS by_head,
         list_filter(h1s, lambda h: h <> '' AND length(h) < 100
              AND NOT {has('h', C.H1_PROMO_WORDS)})[1] AS by_h1
  FROM titled),
named AS (
  SELECT *, coalesce(by_domain, by_shape, by_last, by_head, by_h1, domain) AS company_name FROM chosen)"""

# An unclosed <p><b> keeps every later paragraph of the article inside itself.
_SUMMARIES = rf"""
segmented AS (
  SELECT page_id, string_split(regexp_extract(body, '(?s)<article>(.*)</article>', 1), '<p>')[2:] AS segs
  FROM page),
paragraphs AS (
  SELECT page_id, list_transform(segs[1:6], lambda s, i: CASE WHEN contains(s, '</p>')
           THEN {glue("split_part(s, '</p>', 1)")}
           ELSE {glue("array_to_string(segs[i:], '<p>')")} END) AS ps
  FROM segmented),
summed AS (
  SELECT page_id, array_to_string(list_filter(ps, lambda t: length(t) > 30 AND NOT {promotional('t')}
           AND NOT {has('t', C.SUMMARY_CART_WORDS)})[1:3], ' ') AS summary
  FROM paragraphs),
summaries AS (SELECT page_id, {fits('summary', 50, 500)} AS summary FROM summed)"""

_ADDRESS = f"""
  CASE WHEN length({longest('zipped')}) BETWEEN 11 AND 299 THEN {longest('zipped')}
       ELSE {fits(longest('named'), 10, 300)} END"""


def addresses(source: str, key: str) -> str:
    return f"""
candidates AS (
  SELECT {key}, regexp_extract_all(text, {rx(C.ADDRESS_PATTERNS[0], True)}) AS zipped,
         regexp_extract_all(text, {rx(C.ADDRESS_PATTERNS[1], True)}) AS named
  FROM {source})"""


_LINKS = rf"""
linked AS (
  SELECT page_id, site, url AS src_url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos
  FROM page),
resolved AS (
  SELECT *, {scheme('src_url')} || '://' || site || href AS link FROM linked),
internal AS (
  SELECT *, {canonical('link')} AS dst_url FROM resolved),
first_links AS (
  SELECT page_id, site, src_url, dst_url, min(pos) AS pos,
         {has(path('dst_url'), C.PRIORITY_PATHS)} AS is_priority
  FROM internal GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY is_priority DESC, pos) AS rank
  FROM first_links),
link_lists AS (
  SELECT page_id, list(dst_url ORDER BY rank) AS links
  FROM ranked GROUP BY page_id)"""

_KEY_LABELS = "list_filter([{}], lambda l: l IS NOT NULL)".format(
    ", ".join(
        "CASE WHEN " + has(path("{u}"), w) + f" THEN '{label}' END" for label, w in C.KEY_PAGES.items()
    ).replace("{u}", "URLCOLUMN")
)


def key_labels(u: str) -> str:
    return _KEY_LABELS.replace("URLCOLUMN", u)


_FOOTERS = f"""
footed AS (
  SELECT page_id, {collapse(decode("regexp_replace(regexp_extract(body, '(?s)<footer[^>]*>(.*)</footer>', 1), " + _TAG + ", ' ', 'g')"))} AS footer
  FROM page),
footers AS (
  SELECT page_id, {emails('footer', C.EMAIL_SKIP_FOOTER)} AS footer_emails,
         {phones('footer', C.PHONE_PATTERNS_FOOTER)} AS footer_phones
  FROM footed)"""


def contacts(source: str, key: str, emails_kept: str = "[1:10]", phones_kept: str = "[1:5]") -> str:
    return f"""
raw_contacts AS (
  SELECT {key}, {emails('text', C.EMAIL_SKIP_PAGE)} AS e, {phones('text', C.PHONE_PATTERNS)} AS p
  FROM {source}),
contacts AS (SELECT {key}, {distinct('e')}{emails_kept} AS emails, {distinct('p')}{phones_kept} AS phones FROM raw_contacts)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes) + "\n"


def walk(order: str) -> str:
    """Recursive walk over ``seeds(site, url)`` and ``idx(site, url, outcome, links)``."""
    queued = "list_concat(children, rest)" if order == "dfs" else "list_concat(rest, children)"
    cfg = C.ExtractConfig()
    return f"""
walk AS (
  SELECT site, [struct_pack(url := url, depth := 0)] AS queue, CAST([] AS VARCHAR[]) AS visited,
         -1 AS attempt, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS INTEGER) AS depth,
         CAST(NULL AS VARCHAR) AS outcome
  FROM seeds
  UNION ALL
  SELECT site, CASE WHEN outcome = 'login' THEN [] ELSE {queued} END, now_visited, attempt, url, depth, outcome
  FROM (
    SELECT *, CASE WHEN outcome = 'ok' AND depth < {cfg.max_depth}
             THEN list_transform(list_filter(links, lambda u: NOT list_contains(now_visited, u))[1:{cfg.links_per_page}],
                                 lambda u: struct_pack(url := u, depth := depth + 1))
             ELSE [] END AS children
    FROM (
      SELECT t.site, t.queue[2:] AS rest, t.attempt, t.queue[1].url AS url, t.queue[1].depth AS depth,
             coalesce(i.outcome, 'absent') AS outcome, i.links,
             CASE WHEN i.outcome = 'ok' THEN list_append(t.visited, t.queue[1].url) ELSE t.visited END AS now_visited
      FROM (
        SELECT site, list_filter(queue, lambda s: NOT list_contains(visited, s.url)) AS queue, visited,
               attempt + 1 AS attempt
        FROM walk) t
      LEFT JOIN idx i ON i.site = t.site AND i.url = t.queue[1].url
      WHERE len(t.queue) > 0 AND len(t.visited) < {cfg.max_pages}))),
attempts AS (SELECT site, attempt, url, depth, outcome FROM walk WHERE attempt >= 0),
visits AS (
  SELECT site, url, depth, row_number() OVER (PARTITION BY site ORDER BY attempt) - 1 AS seq
  FROM attempts WHERE outcome = 'ok')"""


_PAGE_INDEX = """
idx AS (
  SELECT p.site, p.url, 'ok' AS outcome, coalesce(l.links, []) AS links
  FROM page p LEFT JOIN link_lists l USING (page_id)),
seeds AS (SELECT site, arg_min(url, page_id) AS url FROM page GROUP BY site)"""

# --- Supplier sites --------------------------------------------------------------------

_BASE = "'https://www.supplier-' || k || '.com'"
_NAV = f"[{_BASE} || '/about', {_BASE} || '/products', {_BASE} || '/contact', {_BASE} || '/careers', {_BASE} || '/news/1']"
_SUPPLIERS = f"""
sup AS (
  SELECT s_suppkey AS k, n_name AS nation, r_name AS region, coalesce(lines, 0) AS lines,
         coalesce(segments, []) AS segments
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
  LEFT JOIN (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments
             FROM customer GROUP BY 1) ON c_nationkey = s_nationkey),
cat AS (
  SELECT l_suppkey AS k, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS b,
         count(DISTINCT l_partkey) AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
brands AS (SELECT k, list(b ORDER BY b) AS bs, list(n ORDER BY b) AS ns FROM cat GROUP BY k),
catalogued AS (SELECT sup.*, coalesce(bs, []) AS bs, coalesce(ns, []) AS ns FROM sup LEFT JOIN brands USING (k)),
nav AS (
  SELECT k, CASE WHEN k % 10 = 3 THEN list_append({_NAV}, {_BASE} || '/portal') ELSE {_NAV} END AS nav,
         bs FROM catalogued),
raw_idx AS (
  SELECT k, '/' AS path, 'ok' AS outcome, nav AS links FROM nav
  UNION ALL SELECT k, '/about', CASE WHEN k % 9 = 2 THEN 'skipped' ELSE 'ok' END, nav FROM nav
  UNION ALL SELECT k, '/products', 'ok', list_concat(nav, list_transform(bs, lambda b: {_BASE} || '/brands/' || b)) FROM nav
  UNION ALL SELECT k, '/contact', CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END, nav FROM nav
  UNION ALL SELECT k, '/careers', 'ok', nav FROM nav WHERE k % 4 <> 1
  UNION ALL SELECT k, '/portal', 'login', nav FROM nav WHERE k % 10 = 3
  UNION ALL SELECT k, '/news/' || i, 'ok', list_append(nav, {_BASE} || '/news/' || (i + 1))
            FROM nav, (SELECT unnest([1, 2, 3]) AS i)
  UNION ALL SELECT k, '/brands/' || b, 'ok', list_concat(nav, list_transform(
              list_filter(bs, lambda x: x > b)[1:5], lambda x: {_BASE} || '/brands/' || x))
            FROM nav JOIN cat USING (k)),
idx AS (SELECT 'www.supplier-' || k || '.com' AS site, {_BASE} || path AS url, outcome, links FROM raw_idx),
seeds AS (SELECT 'www.supplier-' || k || '.com' AS site, {_BASE} || '/' AS url FROM sup)"""

_JOBS = "['Engineer', 'Analyst', 'Designer', 'Scientist', 'Director'][k % 5 + 1]"
_404 = "'Request error: ' || url || ' - 404 Client Error for url: ' || url"


def supplier_fold(robots: bool) -> str:
    robot = (
        "CASE WHEN k % 6 = 0 AND contains(url, '.com/brands/1') THEN 'robots.txt restriction noted for ' || url END"
        if robots
        else "NULL"
    )
    return f"""
tried AS (
  SELECT a.*, CAST(regexp_extract(site, '([0-9]+)', 1) AS BIGINT) AS k FROM attempts a),
notes AS (
  SELECT site, bool_or(outcome = 'login') AS login,
         list_filter(flatten(list([{robot}, CASE WHEN outcome = 'error' THEN {_404} END] ORDER BY attempt)),
                     lambda n: n IS NOT NULL) AS notes
  FROM tried GROUP BY site),
seen AS (
  SELECT v.*, c.*, regexp_extract(v.url, '[.]com(.*)$', 1) AS path
  FROM visits v JOIN catalogued c ON v.site = 'www.supplier-' || c.k || '.com'),
page_lists AS (
  SELECT *, CASE path WHEN '/about' THEN ['Our story'] WHEN '/contact' THEN ['Write to us']
              WHEN '/careers' THEN ['Supply in ' || nation, 'Canteen']
              WHEN '/products' THEN list_transform(bs[1:15], lambda b, i: 'Brand ' || b || ': ' || ns[i] || ' parts')
              ELSE [] END AS offered,
         {key_labels('url')} AS labels
  FROM seen),
folded AS (
  SELECT site, any_value(k) AS k, any_value(nation) AS nation,
         max(CASE WHEN path = '/about' THEN 'Supplier ' || k || ' has shipped ' || lines ||
               ' lines of parts to its buyers. It sits in ' || nation || ' and works across the region ' ||
               region || '.' END) AS what_they_do,
         flatten(list(offered ORDER BY seq)) AS offered, flatten(list(labels ORDER BY seq)) AS labels,
         bool_or(path = '/products') AS products, any_value(segments) AS segments,
         bool_or(path = '/contact') AS contact, bool_or(path = '/careers') AS careers,
         list(url ORDER BY seq) AS pages, max(depth) AS depth
  FROM page_lists GROUP BY site),
flat AS (
  SELECT s.site, 'Supplier ' || k AS company_name, s.url AS website_url, 'Partsfrom' || nation AS tagline,
         what_they_do, {joined(distinct('offered'))} AS offerings,
         CASE WHEN products THEN {joined('segments')} ELSE '' END AS targets,
         {joined(distinct('labels'))} AS key_pages, products AS clients, false AS case_studies,
         false AS testimonials, k % 5 = 0 AS certifications_awards,
         'linkedin=https://www.linkedin.com/company/supplier-' || k ||
           CASE WHEN k % 3 = 0 THEN ' ; twitter=https://x.com/supplier' || k ELSE '' END AS social,
         'info' || k || '@supplier-' || k || '.com' ||
           CASE WHEN contact THEN ' ; sales' || k || '@supplier-' || k || '.com' ELSE '' END AS emails,
         CASE WHEN contact THEN '+1-555-' || lpad(CAST(k AS VARCHAR), 7, '0') ELSE '' END AS phones,
         k || ' Main Street, ' || nation AS physical_address,
         {_BASE} || '/contact?from=nav' AS contact_page_url,
         CASE WHEN careers THEN {_BASE} || '/careers' END AS careers_page_url,
         CASE WHEN careers THEN 'Clinical research ; Supply in ' || nation || ' ; Senior ' || {_JOBS} ||
           ' ; ' || {_JOBS} || ' Wanted' ELSE '' END AS roles,
         {joined('pages')} AS pages_visited, depth AS crawl_depth_used, {joined('notes')} AS limitations,
         login AS login_required
  FROM seeds s JOIN folded f USING (site) JOIN notes n USING (site)),
records AS (
  SELECT site, website_url, login_required,
         {", ".join(f"CASE WHEN NOT login_required THEN {c} END AS {c}" for c in (
             "company_name", "tagline", "what_they_do", "physical_address", "contact_page_url", "careers_page_url"))},
         {", ".join(f"CASE WHEN login_required THEN '' ELSE {c} END AS {c}" for c in (
             "offerings", "targets", "key_pages", "social", "emails", "phones", "roles", "pages_visited"))},
         {", ".join(f"{c} AND NOT login_required AS {c}" for c in (
             "clients", "case_studies", "testimonials", "certifications_awards"))},
         CASE WHEN login_required THEN 0 ELSE depth_used END AS crawl_depth_used,
         CASE WHEN login_required THEN '{C.LOGIN_NOTE}' ELSE limitations END AS limitations
  FROM (SELECT *, crawl_depth_used AS depth_used FROM flat))"""


_SITE_RECORDS = f"""
facts AS (
  SELECT n.page_id, n.site, n.url, n.company_name, s.summary, n.text, {key_labels('n.url')} AS labels,
         {_ADDRESS} AS address, k.emails, k.phones, f.footer_emails, f.footer_phones,
         {targets('n.text')} AS t, {roles('n.text')} AS r
  FROM named n JOIN summaries s USING (page_id) JOIN candidates c USING (page_id)
  JOIN contacts k USING (page_id) JOIN footers f USING (page_id)),
seen AS (SELECT v.seq, v.depth, f.* FROM visits v JOIN facts f ON f.site = v.site AND f.url = v.url),
folded AS (
  SELECT site, arg_min(company_name, seq) FILTER (WHERE company_name <> ''
                   AND (depth = 0 OR list_contains(labels, 'about'))) AS company_name,
         arg_min(summary, seq) FILTER (WHERE summary <> '') AS what_they_do,
         arg_min(address, seq) FILTER (WHERE address <> '') AS physical_address,
         arg_min(url, seq) FILTER (WHERE list_contains(labels, 'contact')) AS contact_page_url,
         arg_min(url, seq) FILTER (WHERE list_contains(labels, 'careers')) AS careers_page_url,
         flatten(list(labels ORDER BY seq)) AS labels,
         flatten(list({distinct('t')}[1:15] ORDER BY seq)) AS targets,
         flatten(list(list_concat(footer_emails, emails) ORDER BY seq)) AS emails,
         flatten(list(list_concat(footer_phones, phones) ORDER BY seq)) AS phones,
         flatten(list(CASE WHEN list_contains(labels, 'careers') THEN {distinct('r')}[1:15] ELSE [] END ORDER BY seq)) AS roles,
         bool_or({has('text', C.CASE_STUDY_WORDS)}) AS case_studies,
         bool_or({has('text', C.TESTIMONIAL_WORDS)}) AS testimonials,
         bool_or({has('text', C.CERTIFICATION_WORDS)}) AS certifications_awards,
         list(url ORDER BY seq) AS pages, max(depth) AS depth
  FROM seen GROUP BY site)"""


def oracle_sql() -> dict[str, str]:
    page = with_(_PAGES)
    linked = with_(_PAGES, _LINKS)
    named = with_(_PAGES, _NAMES)
    doc_contacts = contacts("documents", "doc_id", "", "")
    page_contacts = contacts("page", "page_id")
    tail = rf"regexp_extract({path('url')}, '([^/]*)/?$', 1)"
    origin = f"{scheme('url')} || '://' || {host('url')}"
    folder = rf"regexp_replace({path('url')}, '[^/]*$', '')"
    parent = rf"CASE WHEN {folder} = '/' THEN '/' ELSE regexp_replace({folder}, '[^/]*/$', '') END"
    base_query = r"coalesce('?' || nullif(regexp_extract(url, '\?([^#]*)', 1), ''), '')"
    skip_any = C.OFFERING_SKIP_WORDS + C.HEADING_PROMO_WORDS
    supplier = lambda order: with_(_SUPPLIERS, walk(order), recursive=True)
    page_walk = lambda order: with_(_PAGES, _LINKS, _PAGE_INDEX, walk(order), recursive=True)
    attempts = "SELECT site, attempt, url, depth, outcome FROM attempts"
    text_login = rx("|".join(C.LOGIN_TEXT_PATTERNS))
    pages_login = f"""
      SELECT page_id, {has(path('url'), C.LOGIN_PATHS)} AS by_url, {has('title', C.LOGIN_TITLE_WORDS)} AS by_title,
             regexp_matches(body, '(?i)<input[^>]*type="password"') AS by_form,
             regexp_matches(lower(text), {text_login}) AS by_text,
             regexp_matches(body, '(?i)http-equiv="refresh"') AS by_refresh, false AS by_header
      FROM page"""
    flags = f"""
      SELECT page_id, site, {has('text', C.CLIENT_WORDS)} AND regexp_matches(body,
               '(?i)<img[^>]*alt="[^"]*(client|customer|partner)|<(div|section)[^>]*class="[^"]*(client|customer)') AS clients,
             {has('text', C.CASE_STUDY_WORDS)} AS case_studies, {has('text', C.TESTIMONIAL_WORDS)} AS testimonials,
             {has('text', C.CERTIFICATION_WORDS)} AS certifications_awards
      FROM page"""
    return {
        "url_canonical": f"SELECT page_id, {canonical('url')} AS canonical FROM pages",
        "seed_normalize": f"""
            SELECT page_id, 'https://' || {host('url')} || {path('url')} AS seed FROM pages""",
        "url_host_path": f"""
            SELECT page_id, {scheme('url')} AS scheme, {host('url')} AS host, {path('url')} AS path FROM pages""",
        "url_resolution": f"""
            WITH t AS (SELECT page_id, {origin} AS origin, {folder} AS folder, {parent} AS parent, {tail} AS tail,
                              {path('url')} AS path, {base_query} AS query FROM pages),
            forms AS (SELECT page_id, unnest([
                struct_pack(form := 0, href := '/' || tail, resolved := origin || '/' || tail),
                struct_pack(form := 1, href := tail || '/x', resolved := origin || folder || tail || '/x'),
                struct_pack(form := 2, href := '../' || tail, resolved := origin || parent || tail),
                struct_pack(form := 3, href := './' || tail || '/../y', resolved := origin || folder || 'y'),
                struct_pack(form := 4, href := '?k=v', resolved := origin || path || '?k=v'),
                struct_pack(form := 5, href := '#top', resolved := origin || path || query || '#top'),
                struct_pack(form := 6, href := '//cdn.example.org/' || tail,
                            resolved := split_part(origin, ':', 1) || '://cdn.example.org/' || tail),
                struct_pack(form := 7, href := 'mailto:x@y.z', resolved := 'mailto:x@y.z')]) AS f FROM t)
            SELECT page_id, f.form AS form, f.href AS href, f.resolved AS resolved FROM forms""",
        "domain_name": f"SELECT page_id, {_DOMAIN} AS name FROM pages",
        "tracking_urls": f"SELECT page_id, {has('url', C.TRACKING_MARKS)} AS tracking FROM pages",
        "key_pages": f"SELECT page_id, {joined(key_labels('url'))} AS labels FROM pages",
        "key_page_counts": """
            SELECT 'about' AS label, count(*) AS n FROM supplier
            UNION ALL SELECT 'products', count(*) FROM supplier
            UNION ALL SELECT 'contact', count(*) FROM supplier
            UNION ALL SELECT 'careers', count(*) FROM supplier WHERE s_suppkey % 4 <> 1""",
        "page_title": page + "SELECT page_id, title FROM page",
        "page_text": page + "SELECT page_id, text FROM page",
        "page_text_parsed": page + "SELECT page_id, text FROM page",
        "page_h1": page + f"SELECT page_id, {joined('h1s')} AS h1 FROM page",
        "html_tokens_by_tag": r"""
            WITH t AS (SELECT unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+')) AS token FROM pages)
            SELECT CASE WHEN starts_with(token, '<!--') THEN 'comment' WHEN starts_with(token, '</') THEN 'end'
                        WHEN starts_with(token, '<!') THEN 'declaration' WHEN starts_with(token, '<') THEN 'start'
                        ELSE 'text' END AS kind,
                   lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, count(*) AS n
            FROM t GROUP BY 1, 2""",
        "dom_tag_counts": r"""
            WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                         '(?is)(<(script|style)[^>]*>).*?</', '\1</', 'g') AS body FROM pages)
            SELECT page_id, lower(tag) AS tag, count(*) AS n
            FROM (SELECT page_id, unnest(regexp_extract_all(body, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM b)
            GROUP BY 1, 2""",
        "dom_nodes_lateral": r"""
            WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                         '(?is)(<(script|style)[^>]*>).*?</', '\1</', 'g') AS body FROM pages)
            SELECT page_id, len(regexp_extract_all(body, '<[A-Za-z]')) AS elements,
                   len(regexp_extract_all(body, '<a\s')) AS links, 1 AS title_size FROM b""",
        "nav_links": r"""
            WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                         '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS body FROM pages),
            c AS (SELECT page_id, body, len(regexp_extract_all(body, '<a\s')) AS links,
                         len(regexp_extract_all(regexp_extract(body, '(?s)<nav>.*?</nav>'), '<a\s')) AS in_nav FROM b)
            SELECT page_id, in_nav, links AS in_block,
                   len(list_filter(string_split_regex(body, '<(li|p|article)[ >]'), lambda x, i: i > 1 AND regexp_matches(x, '<a\s'))) AS blocks
            FROM c WHERE links > 0""",
        "byte_bodies": r"""
            WITH k AS (SELECT page_id, html, replace(html, '<meta charset="utf-8">', '') AS bare,
                              CASE WHEN page_id % 5 = 1 AND NOT regexp_full_match(html, '(?s)[\x00-\x7f\x{a0}-\x{ff}]*') THEN 0
                                   ELSE page_id % 5 END AS kind FROM pages)
            SELECT page_id, CASE kind WHEN 1 THEN 'windows-1252' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'windows-1252' ELSE 'utf-8' END AS charset,
                   md5(CASE kind WHEN 0 THEN html WHEN 3 THEN
                     array_to_string(list_transform(list_transform(regexp_extract_all(hex(encode(bare)), '..'),
                       lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1),
                       lambda b: CASE WHEN b < 128 OR b > 159 THEN chr(b::INT) ELSE ['€', chr(129), '‚', 'ƒ', '„', '…', '†', '‡', 'ˆ',
                         '‰', 'Š', '‹', 'Œ', chr(141), 'Ž', chr(143), chr(144), '‘', '’', '“', '”', '•', '–', '—', '˜', '™',
                         'š', '›', 'œ', chr(157), 'ž', 'Ÿ'][b - 127] END), '') || '€ÿ'
                     ELSE bare END) AS text_md5 FROM k""",
        "social_profiles": """
            SELECT s_suppkey * 1000 AS page_id, 'linkedin' AS platform,
                   'https://www.linkedin.com/company/supplier-' || s_suppkey AS url FROM supplier
            UNION ALL SELECT s_suppkey * 1000, 'twitter', 'https://x.com/supplier' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0""",
        "emails_pages": with_(_PAGES, page_contacts) + f"SELECT page_id, {joined('emails')} AS emails FROM contacts",
        "emails_documents": with_(doc_contacts) + f"SELECT doc_id, {joined('emails')} AS emails FROM contacts",
        "phones_pages": with_(_PAGES, page_contacts) + f"SELECT page_id, {joined('phones')} AS phones FROM contacts",
        "phones_documents": with_(doc_contacts) + f"SELECT doc_id, {joined('phones')} AS phones FROM contacts",
        "email_domains_topk": f"""
            SELECT lower(split_part(email, '@', 2)) AS domain, count(*) AS n
            FROM (SELECT unnest(regexp_extract_all(text, {rx(C.EMAIL_PATTERN)})) AS email FROM documents)
            GROUP BY 1 ORDER BY n DESC, domain LIMIT 10""",
        "role_mentions": f"""
            WITH f AS (SELECT doc_id, {roles('text')} AS r FROM documents)
            SELECT doc_id, {joined(distinct('r'))} AS roles FROM f""",
        "target_mentions": f"""
            WITH f AS (SELECT doc_id, {targets('text')} AS t FROM documents)
            SELECT doc_id, {joined(distinct('t'))} AS targets FROM f""",
        "address_candidates": with_(addresses("documents", "doc_id"))
        + f"""SELECT doc_id, len(zipped) AS n_zip, len(named) AS n_city, {longest('named')} AS longest_city,
                     {_ADDRESS} AS address FROM candidates""",
        "promotional_docs": f"SELECT doc_id, {promotional('text')} AS promotional FROM documents",
        "promotional_turns": f"SELECT conv_id, turn, {promotional('text')} AS promotional FROM conversations",
        "login_signals": page
        + f"SELECT *, by_url OR by_title OR by_form OR by_text OR by_refresh OR by_header AS login FROM ({pages_login})",
        "proof_signals": page + f"SELECT * EXCLUDE (site) FROM ({flags})",
        "company_name": named + "SELECT page_id, company_name FROM named",
        "tagline": page
        + """SELECT page_id, CASE WHEN regexp_matches(body,
                 '(?i)class="[^"]*(hero|banner|intro|tagline|subtitle|lead|slogan)|id="tagline"|name="description"|<h2')
               THEN 'has a source' END AS tagline FROM page""",
        "what_they_do": with_(_PAGES, _SUMMARIES) + "SELECT page_id, summary FROM summaries",
        "offerings": page
        + f"""SELECT page_id, {joined(
            "list_filter(list_transform(regexp_extract_all(body, '(?is)<h[23][^>]*>(.*?)</h[23]>', 1)[1:15], lambda h: "
            + glue('h') + "), lambda h: length(h) > 3 AND length(h) < 80 AND NOT " + has('h', skip_any) + ")")} AS offerings
             FROM page""",
        "targets": with_(_PAGES, f"f AS (SELECT page_id, {targets('text')} AS t FROM page)")
        + f"SELECT page_id, {joined(distinct('t') + '[1:15]')} AS targets FROM f",
        "physical_address": with_(_PAGES, addresses("page", "page_id"))
        + f"SELECT page_id, {_ADDRESS} AS address FROM candidates",
        "footer_contacts": with_(_PAGES, _FOOTERS)
        + f"""SELECT page_id, {joined(distinct('footer_emails'))} AS emails,
                     {joined(distinct('footer_phones'))} AS phones FROM footers""",
        "social_links": page
        + rf"""SELECT page_id, len(list_distinct(list_filter(hrefs, lambda h: regexp_matches(lower(h),
                 '^(https?:)?//([^/]*[.])?({"|".join(d.replace(".", "[.]") for ds in C.SOCIAL_DOMAINS.values() for d in ds)})(/|$)')))) AS n_social
              FROM page""",
        "contact_page": page
        + rf"""SELECT page_id, CASE WHEN list_contains({key_labels('url')}, 'contact') THEN url
                 ELSE {scheme('url')} || '://' || site || list_filter(hrefs, lambda h, i: regexp_matches(
                   regexp_extract_all(body, '(?s)<a\s[^>]*>([^<]*)</a>', 1)[i],
                   {rx(C.CONTACT_LINK_TEXT, True)}))[1] END AS contact_page FROM page""",
        "page_links": linked + "SELECT src_url, pos, href, link FROM resolved",
        "internal_links": linked + "SELECT src_url, dst_url, pos FROM first_links",
        "prioritized_top5": linked + "SELECT src_url, dst_url, is_priority, rank FROM ranked WHERE rank <= 5",
        "followed_links": linked
        + f"""SELECT p.url, coalesce({joined('l.links')}, '') AS links
             FROM page p LEFT JOIN link_lists l USING (page_id)""",
        "site_first_nonempty": named
        + "SELECT site, arg_min(company_name, page_id) FILTER (WHERE company_name <> '') AS name FROM named GROUP BY site",
        "site_ordered_union": linked
        + """SELECT site, dst_url AS item, min(page_id) AS first_seq, arg_min(rank - 1, page_id) AS first_pos
             FROM ranked GROUP BY site, dst_url""",
        "site_bool_or": page
        + f"""SELECT site, bool_or(clients) AS clients, bool_or(case_studies) AS case_studies,
                     bool_or(testimonials) AS testimonials, bool_or(certifications_awards) AS certifications_awards
              FROM ({flags}) GROUP BY site""",
        "site_map_last": rf"""
            WITH q AS (SELECT {host('url')} AS site, page_id,
                              unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS pair FROM pages),
            last AS (SELECT site, split_part(pair, '=', 1) AS name, arg_max(split_part(pair, '=', 2), page_id) AS value
                     FROM q WHERE pair <> '' GROUP BY 1, 2)
            SELECT site, name, value FROM last""",
        "site_pages": page
        + f"""SELECT site, count(*) AS n_pages,
                     max(len(list_filter(string_split({path('url')}, '/'), lambda s: s <> ''))) AS depth,
                     arg_min(url, page_id) AS first_url FROM page GROUP BY site""",
        "site_budget": page
        + """SELECT site, rank, url FROM (
               SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank FROM page)
             WHERE rank <= 15""",
        "fetch_outcomes": f"""
            WITH c AS (SELECT page_id, {canonical('url')} AS url FROM pages)
            SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' WHEN 3 THEN 'error' ELSE 'ok' END AS outcome,
                   CASE page_id % 5 WHEN 1 THEN 'Request error: ' || url || ' - 503 Server Error for url: ' || url
                                    WHEN 3 THEN 'Timeout: ' || url END AS note FROM c""",
        "robots_notes": page
        + rf""", first_paths AS (SELECT site, arg_min(regexp_extract({path('url')}, '^(/[^/]*)', 1), page_id) AS prefix
                                 FROM page GROUP BY site)
             SELECT page_id, CASE WHEN NOT starts_with({path('url')}, '/en/1') AND starts_with({path('url')}, prefix)
                                  THEN 'robots.txt restriction noted for ' || url END AS robots_note
             FROM page JOIN first_paths USING (site)""",
        "crawl_dfs": page_walk("dfs") + attempts,
        "crawl_bfs": page_walk("bfs") + attempts,
        "site_records": with_(
            _PAGES, _NAMES, _SUMMARIES, addresses("page", "page_id"), page_contacts, _FOOTERS, _LINKS,
            _PAGE_INDEX, walk("dfs"), _SITE_RECORDS, recursive=True,
        )
        + f"""
            SELECT s.site, company_name, s.url AS website_url, CAST(NULL AS VARCHAR) AS tagline, what_they_do,
                   '' AS offerings, {joined(distinct('targets'))} AS targets, {joined(distinct('labels'))} AS key_pages,
                   false AS clients, case_studies, testimonials, certifications_awards, '' AS social,
                   {joined(distinct('emails'))} AS emails, {joined(distinct('phones'))} AS phones,
                   physical_address, contact_page_url, careers_page_url, {joined(distinct('roles'))} AS roles,
                   {joined('pages')} AS pages_visited, depth AS crawl_depth_used, '' AS limitations,
                   false AS login_required
            FROM seeds s JOIN folded USING (site)""",
        "supplier_walk_dfs": supplier("dfs") + attempts,
        "supplier_walk_bfs": supplier("bfs") + attempts,
        "supplier_records": with_(_SUPPLIERS, walk("dfs"), supplier_fold(True), recursive=True)
        + "SELECT * FROM records",
        "login_override": with_(_SUPPLIERS, walk("dfs"), supplier_fold(False), recursive=True)
        + "SELECT site, login_required, company_name, offerings = '' AS no_offerings, limitations FROM records",
    }
