"""Text and markup functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.keys import blank_to_null, col, strip


def _code_unit(n: Column) -> Column:
    """The character of a code number, as UTF-16 has it."""
    unit = F.lpad(F.hex(F.pmod(n, F.lit(65536))), 4, "0")
    return F.decode(F.unhex(unit), "UTF-16BE")


def _replace_numbered(c: Column, pattern: str, to_number) -> Column:
    """Replace every numbered entity in one pass, so that results are not re-read."""
    pieces = F.split(c, pattern, -1)
    numbers = F.regexp_extract_all(c, F.lit(pattern), 1)
    joined = F.zip_with(
        pieces, numbers, lambda p, n: F.concat(p, F.coalesce(_code_unit(to_number(n)), F.lit("")))
    )
    return F.when(c.rlike(pattern), F.array_join(joined, "")).otherwise(c)


def decimal_entities(c: Column) -> Column:
    return _replace_numbered(c, "&#([0-9]+);", lambda n: n.try_cast("bigint"))


def hex_entities(c: Column) -> Column:
    return _replace_numbered(
        c, "(?i)&#x([0-9a-f]+);", lambda n: F.conv(n, 16, 10).try_cast("bigint")
    )


def _chain(c: Column, steps) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


# fixed values: markup rules, applied in this order
_MARKUP = [
    (r"(?is)<script.*?</script>", ""),
    (r"(?is)<style.*?</style>", ""),
    (r"(?is)<noscript.*?</noscript>", ""),
    (r"(?is)<svg.*?</svg>", ""),
    (r"""(?i)<img[^>]*alt=["']([^"']+)["'][^>]*>""", " [IMG: $1] "),
    (r"""(?is)<a\s[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""", "$2 [$1]"),
    (r"(?i)</(p|div|h[1-6]|li|tr|section|article|header|footer|blockquote)>", "\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]*>", " "),
]
_BASIC_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def html_to_text(c: Column | str) -> Column:
    x = _chain(col(c), _MARKUP + _BASIC_ENTITIES)
    x = hex_entities(decimal_entities(x))
    x = _chain(
        x,
        [(r"(?i)&[a-z]+;", " "), (r"[ \t]+", " "), (r"\n\s*\n\s*\n+", "\n\n")],
    )
    return strip(x)


# fixed values: elements whose content is no text
_HIDDEN = "script|style|noscript|svg"


def text_floor(c: Column | str) -> Column:
    """A number of characters that ``html_to_text`` gives at least, counted in a few passes without extracting them.

    Letters and digits outside of tags, hidden elements and what may be entities: all steps of the extraction keep
    them where hidden elements are closed and not nested, no tag stands in another, and no link or
    alternative text holds a ">". Pages of other shapes have a floor of 0, null pages too.
    """
    html = col(c)
    marks = F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{_HIDDEN})|</(?:{_HIDDEN})>"), F.lit(0))
    paired = F.regexp_replace(F.lower(F.array_join(marks, "")), rf"<({_HIDDEN})</\1>", "") == ""
    shown = F.regexp_replace(html, rf"(?is)<({_HIDDEN}).*?</\1>", "")
    plain = paired & ~shown.rlike("<[^<>]*<") & ~shown.rlike(r"""(?i)(?:alt|href)=["'][^"']*>""")
    kept = F.regexp_replace(
        shown, r"<[^>]*+>|&(?:[a-zA-Z0-9#;&]++|<[^>]*+>)*+|[^\p{L}\p{N}<&]++|[<&]", ""
    )
    return F.coalesce(F.when(plain, F.length(kept)), F.lit(0))


def decode_entities(c: Column | str) -> Column:
    x = _chain(col(c), _BASIC_ENTITIES + [("&quot;", '"'), ("&#39;", "'")])
    return decimal_entities(x)


def strip_html(c: Column | str) -> Column:
    """Plain text of a mail body."""
    return strip(
        _chain(
            col(c),
            [
                (r"(?i)</(p|div)>", "\n\n"),
                (r"(?i)<br\s*/?>", "\n"),
                (r"<[^>]*>", ""),
                ("&nbsp;", " "),
            ],
        )
    )


def visible_text(c: Column | str) -> Column:
    """Tags become blanks and white space is squeezed."""
    return _chain(col(c), [(r"<[^>]+>", " "), (r"[\s\u00A0\uFEFF]+", " ")])


def paragraphs(c: Column | str) -> Column:
    parts = F.filter(F.transform(F.split(col(c), "\n{2,}"), strip), lambda p: p != "")
    marked = F.transform(
        parts,
        lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>")),
    )
    return F.array_join(marked, "\n")


def plain_to_html(c: Column | str) -> Column:
    """Paragraph markup, unless the text is markup already."""
    return F.when(col(c).rlike(r"^[\s\u00A0\uFEFF]*<"), col(c)).otherwise(paragraphs(c))


def word_count(c: Column | str) -> Column:
    x = strip(_chain(col(c), [(r"<[^>]+>", " "), ("&nbsp;", " ")]))
    words = F.filter(F.split(x, r"[\s\u00A0\uFEFF]+"), lambda w: w != "")
    return F.size(words)


def plain_punctuation(c: Column | str) -> Column:
    """Typographic dashes, quotes and dots become plain ones."""
    return strip(
        _chain(
            col(c),
            [
                ("[—–]", ","),
                ("[‘’]", "'"),
                ("[“”]", '"'),
                ("…", "..."),
                (r"[\s\u00A0\uFEFF]+\n", "\n"),
            ],
        )
    )


def subject_line(c: Column | str, max_chars: int = 55) -> Column:
    """A subject cut at a word end where that keeps more than 60 % of the room."""
    s = plain_punctuation(c)
    cut = F.left(s, F.lit(max_chars))
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_word = F.when(
        (F.instr(cut, " ") > 0) & (space > max_chars * 0.6), F.left(cut, space)
    ).otherwise(cut)
    tidy = strip(F.regexp_replace(at_word, r"[,\-–—:]\s*$", ""))
    return F.when(F.length(s) > max_chars, tidy).otherwise(s)


def mention_site_once(c: Column | str, brand: str, site: str) -> Column:
    """Name the site once, in brackets after the first mention of the brand."""
    import re

    brand_re = rf"(?i)\b{re.escape(brand)}\b"
    bare = F.regexp_replace(col(c), rf"(?i)\s*\({re.escape(site)}\)", "")
    once = F.regexp_replace(bare, rf"(?is)^(.*?\b{re.escape(brand)})\b", f"$1 ({site})")
    return F.when(col(c).rlike(brand_re), once).otherwise(col(c))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used: branches share no expressions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def draft_body(c: Column | str, brand: str, site: str) -> Column:
    def marked(x: Column) -> Column:
        return F.when(x.rlike(r"(?i)<p[\s>]"), x).otherwise(paragraphs(x))

    return _once(_once(plain_punctuation(c), lambda x: mention_site_once(x, brand, site)), marked)


def body_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(F.coalesce(col(c), F.lit("")), 256), 1, 16)


def edit_summary(old: Column | str, new: Column | str) -> Column:
    o, n = blank_to_null(col(old)), blank_to_null(col(new))
    delta = F.length(n) - F.length(o)
    return (
        F.when(o.eqNullSafe(n), "none")
        .when(o.isNull(), "created")
        .when(n.isNull(), "cleared")
        .otherwise(
            F.concat(F.when(delta > 0, "+").otherwise(""), delta.cast("string"), F.lit(" chars"))
        )
    )


# ---- ordered sets --------------------------------------------------------------


def distinct_first_seen(values: Column | str) -> Column:
    """The values of an array without repeats, each at the place it is first seen."""
    return F.array_distinct(col(values))


def first_n(values: Column | str, n: int) -> Column:
    """The first ``n`` different values of an array in sorted order."""
    return F.slice(F.array_sort(F.array_distinct(col(values))), 1, n)
