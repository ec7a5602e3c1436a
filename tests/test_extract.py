"""Page facts on small hand-written pages, in the documented and in the ``compat`` mode."""

import pytest

from sitefacts.config import ExtractConfig
from sitefacts.operators.extract import page_facts
from sitefacts.operators.parse import parse_pages
from sitefacts.plans.company import with_site_url
from sitefacts.sources.pages import as_pages

P40 = ["%s %s" % (w, "x" * (39 - len(w))) for w in ("one", "two", "three", "four")]
HERO = '<div class="hero"><p>%s</p></div>'
LD = '<script type="application/ld+json">%s</script>'

# case: (url, html)
CASES = {
    "hyphen title": ("https://www.ab-widgets.com/", "<title>AB-WIDGETS - Gadgets</title>"),
    "empty part": ("https://www.bar.com/", "<title>| Foo</title>"),
    "home suffix": ("https://acme.io/", "<title>Acme | Home</title>"),
    "home prefix": ("https://zzz.io/", "<title>Home - Widgets of the north</title>"),
    "name fallback": ("https://acme.io/", "<p>x</p>"),
    "h1 name": ("https://acme.io/", "<h1>Shop now</h1><h1>Initech <b>Labs</b></h1>"),
    "logo last": ("https://acme.io/", '<img alt="Globex logo"><title>Initech</title>'),
    "logo only": ("https://acme.io/", '<img alt="Globex logo here">'),
    "short logo": ("https://acme.io/", '<img alt="GX logo"><img alt="brand icon">'),
    "last part": ("https://zzz.io/", "<title>The leading maker of things in town | Initech Labs</title>"),
    "glued": ("https://a.co/", HERO % "managed<b>by</b> us all"),
    "tagline 10": ("https://a.co/", HERO % ("t" * 10)),
    "tagline 11": ("https://a.co/", HERO % ("t" * 11)),
    "tagline 199": ("https://a.co/", HERO % ("t" * 199)),
    "tagline 200": ("https://a.co/", HERO % ("t" * 200)),
    "tagline lead": ("https://a.co/", '<section class="banner"><p>first paragraph</p><span class="sub lead">the lead text</span></section>'),
    "tagline sibling": ("https://a.co/", "<h1>A</h1><div><h2>not a sibling</h2></div><h2>a real sibling</h2>"),
    "tagline selector": ("https://a.co/", '<p class="slogan">slogan text here</p><b class="subtitles">no</b>'),
    "emails body": ("https://a.co/", "<p>noreply@a.co privacy@a.co x@a.co</p>"),
    "emails footer": ("https://a.co/", '<div class="footer">noreply@a.co privacy@a.co x@a.co</div>'),
    "mailto": ("https://a.co/", '<a href="mailto:noreply@a.co?subject=s">m</a><a href="mailto:none">m</a>'),
    "email cap": ("https://a.co/", "<p>" + " ".join(f"u{i:02}@a.co" for i in range(12)) + "</p>"),
    "phone plus": ("https://a.co/", "<p>+123456789</p>"),
    "phone short": ("https://a.co/", "<p>555-1234</p>"),
    "tel": ("https://a.co/", '<a href="tel: 1 2 ">c</a><a href="TEL:5">c</a>'),
    "netflix": ("https://a.co/", '<a href="https://www.netflix.com/x">n</a>'),
    "social": ("https://a.co/", '<a href="https://linkedin.com/company/a?utm_source=b">t</a><a href="//www.GitHub.com/a">g</a>'
               '<a href="https://fb.com/1">1</a><a href="https://facebook.com/2">2</a><a href="/x">x</a>'),
    "team page": ("https://a.co/about-us/team", "<p>the marketing team</p>"),
    "roles elsewhere": ("https://a.co/", "<p>the marketing team</p>"),
    "departments": ("https://a.co/careers", '<div class="our-team"><li>Sales <b>&amp; Ops</b></li><h3>Kitchen</h3></div>'),
    "clients text": ("https://a.co/", "<p>our clients</p>"),
    "clients image": ("https://a.co/", '<p>our clients</p><img alt="Client logos">'),
    "iso": ("https://a.co/", "<p>a comparison</p>"),
    "island": ("https://a.co/", "<p>an island</p>"),
    "rapid": ("https://a.co/", "<p>ready for rapid market entry</p>"),
    "limit first": ("https://a.co/", '<section class="products">' + "<li>contact us</li>" * 15 + "<li>Good thing</li></section>"),
    "offerings": ("https://a.co/", '<ul id="services"><li>Alpha work</li><li>Beta work</li><li>Alpha work</li><li>abc</li></ul><h2>Gamma work</h2><h3>Sale today</h3>'),
    "many offerings": ("https://a.co/", '<ul class="offerings">' + "".join(f"<li>Item {i}</li>" for i in range(20)) + "</ul><h2>Not this one</h2>"),
    "targets": ("https://a.co/", '<div id="Markets"><span>Food makers</span><span>Read more</span></div><p>sectors: dairy, meat. x</p>'),
    "address tie": ("https://a.co/", "<p>one st Abcd.two st Abcd.</p>"),
    "bare footer": ("https://a.co/", '<footer><address class="address">1  Main Road, X</address></footer>'),
    "address parts": ("https://a.co/", '<div class="footer"><p class="office">1 Main<br>Road  9</p></div>'),
    "address box": ("https://a.co/", '<div class="location">somewhere warm</div><div class="locations">12 somewhere</div>'),
    "summary": ("https://a.co/", "".join(f"<p>{p}</p>" for p in P40)),
    "summary long": ("https://a.co/", ("<p>" + "y" * 200 + "</p>") * 3),
    "promo": ("https://a.co/", f"<p>Use code SAVE for all of the things here</p><p>{P40[0]}</p><p>{P40[1]}</p>"),
    "promo late": ("https://a.co/", f"<p>{'z' * 600} discount</p><p>{P40[0]}</p><p>{P40[1]}</p>"),
    "about": ("https://a.co/", f"<p>{P40[3]}</p><div class='about'><p>{P40[0]}</p><p>{P40[1]}</p></div>"),
    "head data": ("https://acme.io/", '<title>Initech</title><meta name="description" content="%s">' % ("d" * 60)
                  + LD % '{"name": " Globex ", "address": {"streetAddress": "1 Road", "postalCode": "", "addressCountry": "ES"}}'),
    "bad json": ("https://acme.io/", LD % "{bad" + LD % '[{"name": "List"}]' + LD % '{"legalName": "Legal SA"}'),
    "og name": ("https://acme.io/", '<meta property="og:site_name" content=" Globex "><title>Initech</title>'),
    "contact link": ("https://a.co/x/y", '<a href="../get">Get in <b>touch</b></a><a href="/c?x=1"><span>Reach us</span></a>'),
    "contact page": ("https://a.co/contact-us", '<a href="/c">Contact</a>'),
    "links": ("https://a.co/", '<a href="/z">1</a><a href="/about?x=1">2</a><a href="/y#t">3</a><a href="/team">4</a><a href="/about#t">5</a>'
              '<a href="/about/">6</a><a href="mailto:x@a.co">7</a><a href="https://www.a.co/w">8</a><a href="//a.co">9</a>'),
}


def run(spark, cfg):
    rows = [(i, url, html) for i, (url, html) in enumerate(CASES.values())]
    pages = with_site_url(as_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)))
    facts = page_facts(parse_pages(pages), cfg).collect()
    names = list(CASES)
    return {names[r.page_id]: r for r in facts}


@pytest.fixture(scope="module")
def intended(spark):
    return run(spark, ExtractConfig())


@pytest.fixture(scope="module")
def compat(spark):
    return run(spark, ExtractConfig(compat=True))


NAMES = {
    "hyphen title": "AB", "home suffix": "Acme", "home prefix": "Widgets of the north", "name fallback": "Acme",
    "h1 name": "InitechLabs", "logo last": "Initech", "short logo": "Acme",
    "logo only": "Globex", "last part": "Initech Labs",
}


@pytest.mark.parametrize("case", NAMES)
def test_company_name(intended, compat, case):
    assert intended[case].company_name == compat[case].company_name == NAMES[case]


def test_empty_title_part(intended, compat):
    assert intended["empty part"].company_name == "Foo"
    assert compat["empty part"].company_name == ""


def test_head_data(intended, compat):
    assert intended["head data"].company_name == "Globex"
    assert intended["head data"].tagline == "d" * 60
    assert intended["head data"].what_they_do == "d" * 60
    assert intended["head data"].address == "1 Road, ES"
    assert intended["bad json"].company_name == "Legal SA"
    assert intended["og name"].company_name == "Globex"
    old = compat["head data"]
    assert (old.company_name, old.tagline, old.what_they_do, old.address) == ("Initech", None, None, None)
    assert compat["bad json"].company_name == "Acme"


TAGLINES = {
    "glued": "managedbyus all", "tagline 10": None, "tagline 11": "t" * 11, "tagline 199": "t" * 199,
    "tagline 200": None, "tagline lead": "the lead text", "tagline sibling": "a real sibling",
    "tagline selector": "slogan text here",
}


@pytest.mark.parametrize("case", TAGLINES)
def test_tagline(intended, case):
    assert intended[case].tagline == TAGLINES[case]


EMAILS = {
    "emails body": ["x@a.co"], "emails footer": ["privacy@a.co", "x@a.co"], "mailto": ["noreply@a.co"],
    "email cap": [f"u{i:02}@a.co" for i in range(10)],
}


@pytest.mark.parametrize("case", EMAILS)
def test_emails(intended, case):
    assert intended[case].emails == EMAILS[case]


def test_phones(intended):
    assert intended["phone plus"].phones == ["+123456789"]
    assert intended["phone short"].phones == []
    assert intended["tel"].phones == ["1 2", "TEL:5"]


def test_social(intended, compat):
    assert intended["netflix"].social == {}
    assert compat["netflix"].social == {"twitter": "https://www.netflix.com/x"}
    expected = {"github": "https://www.GitHub.com/a", "facebook": "https://fb.com/1"}
    assert intended["social"].social == compat["social"].social == expected


def test_key_pages_and_roles(intended):
    assert intended["team page"].key_pages == ["about", "careers"]
    assert intended["team page"].careers_page == "https://a.co/about-us/team"
    assert intended["team page"].roles == ["The Marketing", "Marketing Team"]
    assert intended["roles elsewhere"].roles == []
    assert intended["departments"].roles[0] == "Sales& Ops"
    assert "Kitchen" not in intended["departments"].roles


def test_proof(intended):
    assert not intended["clients text"].proof.clients
    assert intended["clients image"].proof.clients
    assert intended["iso"].proof.certifications_awards
    assert not intended["island"].proof.certifications_awards


def test_offerings(intended):
    assert intended["limit first"].offerings == []
    assert intended["offerings"].offerings == ["Alpha work", "Beta work", "Gamma work"]
    assert intended["many offerings"].offerings == [f"Item {i}" for i in range(15)]


def test_targets(intended):
    assert intended["rapid"].targets == ["rapid"]
    assert intended["targets"].targets == ["Food makers", "dairy, meat"]


def test_address(intended, compat):
    assert intended["address tie"].address == "one st Abcd"
    assert intended["bare footer"].address == "1 Main Road, X"
    assert compat["bare footer"].address == "1  Main Road, X"
    assert intended["address parts"].address == "1 Main, Road 9"
    assert intended["address box"].address == "12 somewhere"


def test_summary(intended):
    assert intended["summary"].what_they_do == " ".join(P40[:3])
    assert intended["summary long"].what_they_do is None
    assert intended["promo"].what_they_do == " ".join(P40[:2])
    assert intended["promo late"].what_they_do == " ".join(P40[:2])
    assert intended["about"].what_they_do == " ".join(P40[:2])


def test_contact(intended):
    assert intended["contact link"].contact_page == "https://a.co/c?x=1"
    assert intended["contact page"].contact_page == "https://a.co/contact-us"


def test_links(intended, compat):
    local = ["https://a.co/" + p for p in ("about", "team", "about/", "z", "y")]
    assert intended["links"].links == local + ["https://a.co/"]
    assert compat["links"].links == local + ["mailto://a.co/x@a.co", "https://a.co/"]


def test_no_list_repeats_an_item(intended, compat):
    for rows in (intended, compat):
        for row in rows.values():
            for name in ("links", "key_pages", "offerings", "targets", "emails", "phones", "roles"):
                assert len(row[name]) == len(set(row[name]))
