"""Structured data beside a plain walk, and floors of text lengths beside the texts."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.functions.text import html_to_text, text_floor
from leadloom.operators import web

PAGE = "page_id int, domain string, page_ord int, url string, html string"


def plain_nodes(blocks):
    def walk(node):
        if isinstance(node, dict):
            if node.get("@type"):
                yield node
            node = list(node.values())
        if isinstance(node, list):
            for child in node:
                yield from walk(child)

    def refuse(name):
        raise ValueError(name)

    for block in blocks:
        try:
            yield from walk(json.loads(block, parse_constant=refuse))
        except ValueError:
            continue


def nodes_of(spark, pages, **options):
    html = ["".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) for blocks in pages]
    df = spark.createDataFrame([(i, "d", i, "u", h) for i, h in enumerate(html)], PAGE)
    rows = web.with_nodes(df, **options).orderBy("page_id").collect()
    return [[json.loads(n) for n in r["_nodes"]] for r in rows]


def nest(depth):
    inner = {"@type": "Person", "name": "deep"}
    for _ in range(depth):
        inner = {"b": inner, "a": [1]}
    return json.dumps({"@type": "Store", "x": inner})


ODD = [
    [], [""], ["null"], ["5"], ["[]"], ['"text"'], ['{"@type":"A"} tail'], ['{"@type":"A"},{"@type":"B"}'],
    ["{'@type':'A'}"], ['{"@type":"A","v":NaN}'], ['{"@type":"A","v":"a\nb"}'], ['{"@type":""}'],
    ['{"@type":"A","@type":"B"}'], ['{"@type":"A","x":{"k":1,"k":{"@type":"B"}}}'],
    ['{"z":{"@type":"Z"},"a":{"@type":"A"}}', '[[{"@type":"C"}],{"@type":["D","E"]}]'],
    ['{"@type":"A","s":"{\\"@type\\":\\"No\\"}"}', '"{\\"@type\\":\\"No\\"}"'],
    ["  \n" + '{"@type" : "A" , "c" : [ { "@type" : "B" } ] }' + "\n"],
    [nest(d) for d in range(9)], [nest(60)], ['{"@type":"A"', '{"@type":"B"}'],
]


@pytest.mark.parametrize("levels", [1, 6])
def test_walk_equals_a_plain_one(spark, levels):
    assert nodes_of(spark, ODD, levels=levels) == [list(plain_nodes(blocks)) for blocks in ODD]


def test_random_objects(spark):
    keys = st.sampled_from(["@type", "a", "b", "ä"])
    leaf = st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["Person", "", "{", '{"@type":"x"}', "[1]"])
    values = st.recursive(leaf, lambda v: st.lists(v, max_size=3) | st.dictionaries(keys, v, max_size=3), max_leaves=12)

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.lists(values.map(json.dumps), max_size=3), min_size=60, max_size=60))
    def same(pages):
        def named(node):
            return isinstance(node["@type"], str | list | dict)

        got = [[n for n in nodes if named(n)] for nodes in nodes_of(spark, pages, levels=3)]
        assert got == [[n for n in plain_nodes(blocks) if named(n)] for blocks in pages]

    same()


def test_blocks_without_a_type_count_as_structured_data(spark):
    blocks = {"typed": '{"@type":"A"}', "plain": '{"name":"x"}', "empty": "[ ]", "bad": "{", "list": "[1]"}
    df = spark.createDataFrame(
        [(1, d, 0, "u", f'<script type="application/ld+json">{b}</script>') for d, b in blocks.items()], PAGE
    )
    assert {r.domain for r in web.ld_sites(df).collect()} == {"typed", "plain", "list"}


PARTS = [
    "word", " two words ", "é9", "&amp;", "&", "copy;", "&nbsp;", "&#38;", "&#x41;", "#", ";", "<p>", "</p>", "<br/>", "<b>", "</b>",
    '<a href="x/y">', '<a href="a>b">', '<a href="a<b">', "</a>", '<img alt="pic">', "<img alt='p>q \" r'>", "<script>", "</script>",
    "<style>", "</style>", "<svg", ">", "</svg>", "<noscript>", "</noscript>", "<sty", "le>", "<", "<!-- c -->", "\n\n\n", " ",
    "</SCRIPT>", "</script >", '"', "'",
]


def test_floors_are_no_longer_than_texts(spark):
    rng = random.Random(5)
    shapes = [PARTS, PARTS[:19] + PARTS[20:30:3], [p for p in PARTS if p not in ("<", "<sty", '<a href="a<b">')]]
    pages = ["".join(rng.choices(rng.choice(shapes), k=rng.randrange(30))) for _ in range(30_000)]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    rows = df.select("html", text_floor("html").alias("low"), F.length(html_to_text("html")).alias("size"))
    assert rows.where("low > size").take(5) == []
    assert rows.where("low > 0").count() > 1000


def test_floor_of_a_common_page(spark):
    html = "<html><head><style>p {}</style></head><body><p>Four &amp; twenty</p><script>x<y</script><a href='/q'>Baked</a></body>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert [r[0] for r in df.select(text_floor("html")).collect()] == [15, 0, 0]


def test_pages_beyond_the_limit_are_left_out(spark):
    def page(i, n):
        return (i, "long.org", i, "https://long.org", f"<p>{'a' * n}</p>")

    rows = [page(i, 400) for i in range(2500)] + [(9000, "short.org", 0, "s", "<p>x</p>"), (9001, "short.org", 1, "s", None)]
    df = spark.createDataFrame(rows, PAGE).repartition(7)
    kept = web.pages_within(df, 40_000)
    assert kept.where("domain = 'short.org'").count() == 2
    n = kept.where("domain = 'long.org'").count()
    whole = "\n\n".join(
        ("--- HOMEPAGE: " if i == 0 else "--- PAGE: ") + "https://long.org ---\n" + "a" * 400 for i in range(2500)
    )
    assert 85 <= n <= 100
    texts = {r.domain: r.text for r in web.page_assembly(df).collect()}
    assert texts["long.org"] == whole[:40_000] and texts["short.org"] == "--- HOMEPAGE: s ---\nx"
