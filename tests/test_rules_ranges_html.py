"""Rule texts, range sweeps and balanced HTML against brute force."""

import html
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.functions.html import VOID, balanced_html, safe
from tidemark.functions.strings import ATTRIBUTES, EVERYWHERE, TAGS
from tidemark.operators import governance, ranges

# Rules


def test_all_hits_in_order(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 5), (4, "c", 5), (5, None, 5)], "id int, k string, x int")
    good = '[{"name": "z", "when": "x > 1", "then": ["one", "two"]}, {"name": "a", "when": "x > 1 AND NOT x > 9", "then": ["three"]}, {"name": "top", "when": "x = 5 OR x IS NULL", "then": ["first"], "salience": 7}, {"name": "mute", "when": "true", "then": []}]'
    got = governance.evaluate_rules(df, {"a": good, "b": '[{"name": "n", "when": "x >", "then": ["y"]}]'}, "k", ["id"])
    assert [tuple(r) for r in got.orderBy("id", "place").collect()] == [(1, 1, "top", "first"), (1, 2, "a", "three"), (1, 3, "z", "one"), (1, 4, "z", "two"), (2, 1, "top", "first")]
    assert governance.evaluate_rules(df, {}, "k", ["id"]).count() == 0


@pytest.mark.parametrize("bad", ["{", "{}", '[{"name": "n"}]', '[{"name": "n", "when": "y > 1", "then": ["c"]}]', '[{"name": "n", "when": "x + 1", "then": ["c"]}]', '[{"name": "n", "when": "x > (1", "then": ["c"]}]'])
def test_rules_that_do_not_compile(spark, bad):
    df = spark.createDataFrame([(1, "a", 5)], "id int, k string, x int")
    with pytest.raises(Exception):
        governance.check_rules(df, bad)
    fine = '[{"name": "n", "when": "x = 5", "then": ["c"]}]'
    assert governance.evaluate_rules(df.unionByName(df.withColumn("k", F.lit("b"))), {"a": bad, "b": fine}, "k", ["id"]).count() == 1


def test_the_latest_enabled_rule_counts(spark):
    rows = [("a", 1, 1, 1, "old"), ("a", 2, 2, 1, "new"), ("a", 3, 3, 0, "off"), ("b", 1, 4, 2, "gray"), (None, 9, 5, 1, "none")]
    df = spark.createDataFrame(rows, "rule_key string, version int, id int, status int, content string")
    assert governance.latest_rules(df) == {"a": "new"}


# Ranges


@pytest.mark.parametrize("kind", ["long", "double"])
def test_sweep_matches_brute_force(spark, kind):
    r = random.Random(6)
    spans = [(i, lo := r.randrange(-500, 500), lo + r.choice([0, 1, 5, 40, 300])) for i in range(120)]
    spans += [(200, -(2**40), 2**40), (201, 7, 7), (202, 7, 7), (203, 9, 8), (204, None, 5), (205, 5, None)]
    at = [(i, r.randrange(-700, 700)) for i in range(400)] + [(i, 7) for i in range(1000, 1300)] + [(2000, None), (2001, 2**41)]
    points = spark.createDataFrame([(i, None if v is None else float(v) if kind == "double" else v) for i, v in at], f"id int, v {kind}").repartition(3)
    found = ranges.range_lookup(points, "v", spark.createDataFrame(spans, "area int, lo long, hi long"), "lo", "hi")
    want = []
    for i, v in at:
        held = [a for a, lo, hi in spans if None not in (v, lo, hi) and lo <= v <= hi]
        want += [(i, a) for a in held] or [(i, None)]
    assert found.columns == ["id", "v", "area", "lo", "hi"]
    assert sorted(map(str, (tuple(x) for x in found.select("id", "area").collect()))) == sorted(map(str, want))


def test_a_range_of_everything_costs_a_row_a_part(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        points = spark.range(3000).select(F.col("id"), (F.col("id") * 1_000_003 % 2**32).alias("v"))
        wide = spark.createDataFrame([(1, 0, 2**32)], "area int, lo long, hi long")
        assert ranges.range_lookup(points, "v", wide, "lo", "hi").where("area = 1").count() == 3000
        assert ranges.range_lookup(points.limit(0), "v", wide, "lo", "hi").count() == 0
        assert ranges.range_lookup(points, "v", wide.limit(0), "lo", "hi").where("area IS NULL").count() == 3000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_addresses(spark):
    df = spark.createDataFrame([(x,) for x in ("0.0.0.0", "255.255.255.255", " 10.1.2.3 ", "256.1.1.1", "1.2.3", "a.b.c.d", "1.2.3.4.5", "", "1..2.3", None)], "a string")
    got = [r.n for r in df.select(ranges.address_number(F.col("a")).alias("n")).collect()]
    assert got == [0, 2**32 - 1, (10 << 24) + (1 << 16) + 515, *[None] * 7]
    back = spark.range(1).select(*[ranges.address_text(F.lit(n)).alias(f"c{n}") for n in (0, 168428035, 2**32 - 1)]).first()
    assert tuple(back) == ("0.0.0.0", "10.10.2.3", "255.255.255.255")


# HTML


CASES = {
    "<b>one<i>two</b>three</i>": "<b>one<i>two</i></b>three",
    "<p>a<p>b<ul><li>c<li>d</ul>e": "<p>a</p><p>b</p><ul><li>c</li><li>d</li></ul>e",
    '<a href="jav&#97;script:alert(1)" title="x&quot;y">t</a>': '<a title="x&quot;y">t</a>',
    '<a href=" https://a.b/?c=1&amp;d=2" href="http://second">t': '<a href=" https://a.b/?c=1&amp;d=2">t</a>',
    '<a href="java\tscript:x">t</a><img src="data:x" onerror="y">': '<a>t</a><img src="data:x">',
    "1 < 2 &amp; 3 > 2 &lt;b&gt;": "1 &lt; 2 &amp; 3 &gt; 2 &lt;b&gt;",
    "<script>var t='<b>';</script><style>p{}</style>x<!-- c --></b></div>": "x",
    "<table><tr><td>1<td>2<tr><td>3</table>": "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>",
    "<article><br/>a<br></article>": "<br>a<br>",
    "": "",
}


@pytest.mark.parametrize("text", CASES)
def test_balanced_cases(text):
    assert safe(text) == CASES[text]


class Nested(HTMLParser):
    def __init__(self):
        super().__init__()
        self.stack, self.tags, self.text = [], [], []

    def handle_starttag(self, tag, attrs):
        assert tag in TAGS and all(k in EVERYWHERE or k in ATTRIBUTES.get(tag, []) for k, _ in attrs)
        self.tags.append((tag, tuple(attrs)))
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack.pop() == tag

    def handle_data(self, data):
        self.text.append(data)


def well_nested(text):
    n = Nested()
    n.feed(text)
    n.close()
    assert not n.stack
    return n


def test_every_page_is_well_nested_with_its_tags_and_attributes(spark):
    from tidemark.functions.strings import clean_html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("html", balanced_html(F.col("html")).alias("safe"), clean_html(F.col("html")).alias("plain")).collect()
    for p in pages:
        n = well_nested(p.safe)
        # The plain cleaner keeps tags as they stand: the same tags are opened, with the same attributes.
        opened = [(t, re.findall(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", a)) for t, a in re.findall(r"<([a-z][a-z0-9]*)([^>]*)>", p.plain)]
        assert [(t, [(k, v) for k, v in a]) for t, a in n.tags] == [(t, [(k, html.unescape(x or y)) for k, x, y in a]) for t, a in opened]
        assert safe(p.safe) == p.safe


def test_random_tag_soup_is_well_nested():
    r = random.Random(3)
    bits = [f"<{t}>" for t in ("b", "i", "p", "ul", "li", "td", "tr", "table", "br", "div", "script", "a href=x", "q cite='http://a'")] + [f"</{t}>" for t in ("b", "i", "p", "ul", "li", "td", "tr", "table", "div", "script")] + ["text", "<", ">", "&amp;", "&#60;", "<!--", "-->", '"']
    for _ in range(500):
        text = safe("".join(r.choice(bits) for _ in range(r.randint(1, 40))))
        well_nested(text)
        assert safe(text) == text


def test_null_html(spark):
    assert spark.range(1).select(balanced_html(F.lit(None).cast("string")).alias("h")).first().h == ""
