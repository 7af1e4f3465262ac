"""Key normalisation: each function takes a column and returns a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import rules

# White space the way web data uses it: also no-break space and byte order mark.
SPACE = r"[\s\u00A0\uFEFF]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A capture group of the first match, null when there is none or it is empty."""
    return blank_to_null(F.regexp_extract(col(c), pattern, group))


def norm_name(c: Column | str) -> Column:
    """Business name key: legal form and punctuation go, sector words stay."""
    suffix = "|".join(rules.LEGAL_SUFFIXES)
    x = F.regexp_replace(F.lower(col(c)), "['`\"]", "")
    x = F.replace(x, F.lit("&"), F.lit(" and "))
    # Java's \b counts accented letters as word characters, so spell it out.
    x = F.regexp_replace(x, rf"(?<![A-Za-z0-9_])(?:{suffix})(?![A-Za-z0-9_])\.?", "")
    return squeeze(F.regexp_replace(x, r"[^\w\s]", " "))


def with_scheme(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), "^(?!http)", "https://")


def url_host(c: Column | str) -> Column:
    """Lower-case host of an http(s) URL; null when the URL has none."""
    return first_group(
        F.lower(col(c)), r"^https?://(?:[^/?#@]*@)?([^/?#:@\s<>^|%\\\[\]]+)(?::\d*)?(?:[/?#]|$)"
    )


def domain_root(c: Column | str) -> Column:
    """Registered domain of a URL or bare host. Each step reads the one before once, so none is worked out again."""
    drop = "|".join(rules.DROPPED_SUBDOMAINS)
    host = F.regexp_replace(
        url_host(with_scheme(F.lower(col(c)))), rf"^(?:(?:{drop})\.)+(?=[^.]+\.[^.]+)", ""
    )
    compound = "|".join(map(re.escape, rules.COMPOUND_TLDS))
    return F.regexp_replace(host, rf"(?s)^.*?([^.]+\.(?:{compound})|[^.]+\.[^.]+)$.*", "$1")


def digits_and_plus(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\d+]", "")


def phone_e164(c: Column | str) -> Column:
    """International phone number; numbers without a country are taken as UK ones."""
    d = F.regexp_replace(digits_and_plus(c), r"^\+.{0,6}$", "")
    d = F.regexp_replace(d, "^44", "+44")
    d = F.regexp_replace(d, "^0", "+44")
    d = F.regexp_replace(d, r"^(?=\d.{9})", "+44")
    return first_group(d, r"^\+.*$", 0)


def phone_e164_site(c: Column | str, site: Column | str) -> Column:
    """International phone number, the country guessed from the site's domain."""
    d = digits_and_plus(c)
    n = F.length(d)
    host = F.coalesce(url_host(with_scheme(site)), F.lit(""))
    # fixed values: country code by domain ending
    code = (
        F.when(host.endswith(".uk"), "+44")
        .when(host.endswith(".ca"), "+1")
        .when(host.endswith(".au"), "+61")
        .when(host.endswith(".ie"), "+353")
        .otherwise("")
    )
    return (
        F.when(d.startswith("+") & n.between(8, 16), d)
        .when(
            (code == "+44") & d.startswith("0") & n.between(10, 11),
            F.concat(code, F.substring(d, 2, 1 << 30)),
        )
        .when((code == "") & d.rlike(r"^\d{10}$"), F.concat(F.lit("+1"), d))
    )


def outward_postcode(c: Column | str) -> Column:
    """First half of the UK postcode in a text, or the text if it is just that half."""
    u = F.upper(col(c))
    return F.coalesce(
        first_group(u, r"\b([A-Z]{1,2}\d{1,2}[A-Z]?)\s*\d[A-Z]{2}\b"),
        first_group(u, r"^([A-Z]{1,2}\d{1,2}[A-Z]?)$"),
    )


def outward_of_postcode(c: Column | str) -> Column:
    """Registry variant: the first word of a postcode field."""
    return blank_to_null(F.split(F.upper(col(c)), rf"{SPACE}+", 2)[0])


def norm_email(c: Column | str) -> Column:
    """Inbox key: the tag goes, and for Gmail also the dots."""
    x = F.regexp_replace(F.lower(strip(c)), r"^([^@+]*)\+[^\s\u00A0\uFEFF@]*@", "$1@")
    x = F.regexp_replace(x, r"@googlemail\.com$", "@gmail.com")
    x = F.regexp_replace(x, r"\.(?=[^@]*@gmail\.com$)", "")
    word = r"[^\s\u00A0\uFEFF@]+"
    return first_group(x, rf"^{word}@{word}\.{word}$", 0)


def norm_vrn(c: Column | str) -> Column:
    """VAT number key: 9 or 12 digits, else null."""
    d = F.regexp_replace(F.regexp_replace(F.upper(col(c)), "^GB", ""), "[^0-9]", "")
    return F.when(F.length(d).isin(9, 12), d)


def norm_handle(c: Column | str) -> Column:
    """Instagram handle from a handle, an @handle or a profile URL."""
    v = F.regexp_replace(strip(c), "^@", "")
    v = F.regexp_replace(v, r"(?i)^https?://(?:www\.)?instagram\.com/", "")
    v = F.lower(F.regexp_replace(v, r"[/?#].*$", ""))
    ok = v.rlike(r"^[a-z0-9_.]{1,30}$") & ~v.isin(rules.SOCIAL_STOPWORDS)
    return F.when(ok, v)


def norm_person(c: Column | str) -> Column:
    return squeeze(F.lower(col(c)))


def norm_company_no(c: Column | str) -> Column:
    return blank_to_null(F.upper(F.regexp_replace(col(c), rf"{SPACE}+", "")))


def full_address(*parts: Column | str) -> Column:
    """The non-empty parts joined by commas; null when there is none."""
    kept = F.filter(F.array(*map(col, parts)), lambda p: p.isNotNull() & (p != ""))
    return blank_to_null(F.array_join(kept, ", "))


def greeting_name(c: Column | str) -> Column:
    first = F.split(col(c), rf"{SPACE}+", 2)[0]
    name = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 30))
    return F.when(first.rlike("^[A-Za-z'-]{2,}$"), name).otherwise("there")


def format_gbp(c: Column | str) -> Column:
    """Short money text: 1.23m, 45k or 678."""
    n = col(c).cast("double")
    return (
        F.when(F.abs(n) >= 1e6, F.format_string("%.2fm", n / 1e6))
        .when(F.abs(n) >= 1e3, F.format_string("%.0fk", n / 1e3))
        .otherwise(F.floor(n + 0.5).cast("string"))
    )
