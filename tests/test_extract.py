"""Extraction rules on hand-written HTML (one row per platform, nesting,
elements outside any rule, short texts)."""

from msgshield.operators.detect import filter_messages
from msgshield.sources.html import REFERENCE_RULES, extract_from_html, extract_messages, parse_selector

HTML = """<html><body>
<div class="message-in x"><span data-testid="selectable-text">hello from whatsapp</span></div>
<div class="message-out"><span data-testid="selectable-text">reply <b>bold</b> text</span></div>
<article><div data-testid="tweetText">a tweet here<br>second line</div></article>
<div role="row"><div dir="auto">dm message <div dir="auto">nested dm</div></div></div>
<div dir="auto">outside any row</div>
<div role="row"><div dir="auto">hey</div></div>
<script>var s = "<div role='row'><div dir='auto'>fake</div></div>";</script>
</body></html>"""


def test_rules_in_order_with_nesting():
    rules = [parse_selector(r) for r in REFERENCE_RULES]
    rows = extract_from_html(HTML, rules)
    texts = [(r, t) for r, _, t in rows]
    assert texts == [
        (0, "hello from whatsapp"),
        (1, "reply bold text"),
        (2, "a tweet here\nsecond line"),
        (3, "dm message\nnested dm"),
        (3, "nested dm"),
        (3, "hey"),
    ]


def test_element_matched_by_two_rules_emitted_once():
    rules = [parse_selector('div[role="row"] div[dir="auto"]'), parse_selector('div[dir="auto"]')]
    rows = extract_from_html(HTML, rules)
    assert sum(1 for r, _, t in rows if t == "nested dm") == 1
    assert (1, "outside any row") in [(r, t) for r, _, t in rows]


def test_malformed_html_implied_ends():
    html = "<article><p>one <b>bold<p>two</article><p>three"
    rows = extract_from_html(html, [parse_selector("article p")])
    assert [t for _, _, t in rows] == ["one bold", "two"]


def test_distributed_extraction_and_short_filter(spark):
    pages = spark.createDataFrame([(1, "https://web.example.com/x", HTML)], "page_id long, url string, html string")
    m = extract_messages(pages)
    assert m.count() == 6
    assert {r.source for r in m.collect()} == {"web.example.com"}
    kept = filter_messages(m)
    assert "hey" not in [r.text for r in kept.collect()]


def test_distributed_equals_local_loop_on_fixture_pages(spark):
    """Brute force on the small fixture: the distributed query equals a plain
    loop over the same pages."""
    from urllib.parse import urlparse

    import __spark_entry__ as E
    from msgshield.plans.catalog import FIXTURE_RULES
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in E.queries()["extract_messages"](spark, sf).collect())
    rules = [parse_selector(r) for r in FIXTURE_RULES]
    want = []
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        for r_idx, n_idx, text in extract_from_html(p.html, rules):
            want.append((p.page_id, urlparse(p.url).hostname, r_idx, n_idx, text))
    assert got == sorted(want) and len(got) > 0


def test_source_is_lower_case_host_without_port(spark):
    pages = spark.createDataFrame([(1, "https://Web.Example.COM:8443/x?y=1", HTML)],
                                  "page_id long, url string, html string")
    assert {r.source for r in extract_messages(pages).collect()} == {"web.example.com"}
