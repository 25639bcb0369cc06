"""HTML annotation against an independent reading with the standard parser."""

import re
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptmill.functions import refs
from promptmill.operators import pages

SPAN = '<span class="dlv-ref" data-kind="TAX" data-main="01">TAX-01</span>'


@pytest.mark.parametrize("html,want", [
    ("<p>TAX-01</p>TAX-01", f"<p>{SPAN}</p>TAX-01"),
    ("<div>TAX-01<li><b>x TAX-01</b></li></div>", f"<div>TAX-01<li><b>x {SPAN}</b></li></div>"),
    ('<p><span class="a DLV-REF">TAX-01 <b>TAX-01</b></span> TAX-01</p>', f'<p><span class="a DLV-REF">TAX-01 <b>TAX-01</b></span> {SPAN}</p>'),
    ("<p>TAX-01", f"<p>{SPAN}</p>"),                                            # left open: closed at the end
    ("<p><b>TAX-01</p>TAX-01", f"<p><b>{SPAN}</b></p>TAX-01"),                  # closed where its parent ends
    ("<p>a<br>TAX-01<img src='x'></p>", f"<p>a<br>{SPAN}<img src='x'></p>"),    # void elements stay single
    ("<p>a<p>TAX-01</p>TAX-01</p>TAX-01", f"<p>a<p>{SPAN}</p>{SPAN}</p>TAX-01"),
    ("<p><!-- TAX-01 --><script>TAX-01</script></b>TAX-01</p>", f"<p><!-- TAX-01 --><script>TAX-01</script></b>{SPAN}</p>"),
    ("<P>TAX-01</p>", f"<P>{SPAN}</p>"), ("<p title='TAX-01'>1 < 2 TAX-01</p>", f"<p title='TAX-01'>1 < 2 {SPAN}</p>"),
    ("", ""), ("no tags TAX-01", "no tags TAX-01"),
])
def test_annotation_cases(html, want):
    assert pages.annotate_html(html) == want


def test_span_attributes():
    got = pages.annotate_html("<p>SEC–MKT-12..14/02</p>")
    assert got == '<p><span class="dlv-ref" data-kind="SEC-MKT" data-main="12" data-range-end="14" data-alt="02">SEC–MKT-12..14/02</span></p>'


class Reader(HTMLParser):
    """Texts inside p or li and there outside reference spans; text overall; number of reference spans."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.stack, self.inside, self.text, self.spans = [], [], [], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        is_ref = tag == "span" and "dlv-ref" in dict(attrs).get("class", "").split()
        self.spans += is_ref
        if tag not in pages.VOID_ELEMENTS:
            self.stack.append("ref" if is_ref else tag)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.text.append(data)
        outer = next((i for i, tag in enumerate(self.stack) if tag in ("p", "li")), None)
        if outer is not None and "ref" not in self.stack[outer:]:  # a reference span around the paragraph does not count
            self.inside.append(data)


leaf = st.sampled_from(["TAX-01", " DOC-05..07 ", "x", "GOV-1", "SEC—MKT-12/34", "<br>", "XPAY-999"])
tree = st.recursive(leaf, lambda kids: st.builds(
    lambda tag, body: f"<{tag}>{''.join(body)}</{tag.split()[0]}>",
    st.sampled_from(["p", "li", "b", "div", "em", 'span class="dlv-ref"', "span"]), st.lists(kids, max_size=4)), max_leaves=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(tree, max_size=4).map("".join))
def test_annotation_against_parser(html):
    out = pages.annotate_html(html)
    before, after = Reader(html), Reader(out)
    assert "".join(before.text) == "".join(after.text)
    found = sum(len(re.findall(refs.REF_PATTERN, t)) for t in before.inside)
    assert after.spans == before.spans + found
    assert not any(re.search(refs.REF_PATTERN, t) for t in after.inside)
    assert pages.annotate_html(out) == out


@pytest.mark.parametrize("html,want", [
    ("<hr>", '<hr class="my-8 border-t">'), ("<hr/>", '<hr class="my-8 border-t"/>'),
    ('<LI id="1" class="MY-1 a">', '<LI id="1" class="MY-1 a">'), ("<li class=k>x</li>", '<li class="k my-1">x</li>'), ("<b><!-- <hr> -->", "<b><!-- <hr> -->"),
])
def test_tag_classes(html, want):
    assert pages.classed_html(html) == want


def test_page_pass(spark):
    df = spark.createDataFrame([(1, "<head></head><p>TAX-01</p>"), (2, None)], "k int, html string")
    got = {r.k: r.html for r in pages.annotated_pages(df).collect()}
    assert got == {1: f'<head>{refs.HEAD_ASSETS}</head><p class="my-3 text-justify">{SPAN}</p>', 2: None}


def test_pages_reach_python_in_batches_of_bounded_bytes(spark):
    session = spark.newSession()
    df = session.range(40, numPartitions=1).select(F.repeat(F.lit("<p>TAX-01</p>"), 40_000).alias("html"))
    annotated = pages.annotated_pages(df)
    rows = df.mapInArrow(lambda batches: (pa.record_batch({"n": [len(b)]}) for b in batches), "n bigint").collect()
    assert sum(r.n for r in rows) == 40 and max(r.n for r in rows) < 20
    assert annotated.where(F.col("html").endswith(f"{SPAN}</p>")).count() == 40


def test_character_and_math_audits(spark):
    df = spark.createDataFrame([(1, "H₂O ₂ ✓ $^a$ $x$ $\\d{2}$"), (2, "none")], "k int, text string")
    assert {(r.k, r.code_point, r.n) for r in pages.uncovered_characters(df, "k").collect()} == {(1, "U+2082", 2), (1, "U+2713", 1)}
    assert [(r.span, r.is_regex) for r in pages.math_spans(df, "k").orderBy("pos").collect()] == [("^a", True), ("x", False), ("\\d{2}", True)]
    texts = spark.createDataFrame([(1, "TAX-01 TAX-02 DOC-01"), (2, "TAX‑09")], "k int, text string")
    assert {(r.kind, r.n_refs, r.n_docs) for r in pages.ref_summary(texts).collect()} == {("TAX", 3, 2), ("DOC", 1, 1)}
    inventory = pages.tag_inventory(spark.createDataFrame([(1, '<p><p class="x">')], "k int, html string"), "k").orderBy(F.col("class")).collect()
    assert [(r["class"], r.merged_class, r.n) for r in inventory] == [(None, "my-3 text-justify", 1), ("x", "x my-3 text-justify", 1)]
