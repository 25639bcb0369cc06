"""The annotation pass against the relational reading of tags, on pages of awkward nesting."""

import duckdb
import pandas as pd

from promptmill.operators import pages
from promptmill.plans.annotations import _SPANS_SQL, _spans

PAGES = [
    "<p>DOC-01 <b>GOV-02..03</b></p> DOC-04",
    "<ul><li>DOC-01<li>DOC-02/07</ul>DOC-03",
    '<p><span class="a DLV-REF x">TAX-01 <b>TAX-03</b></span> TAX-02</p><!-- <p>DOC-05 --><script>"<p>DOC-06"</script>DOC-07',
    "<div>INT-01<p>DOC-01</p></div><P class='x'>SEC–MKT-02</P>",
    "", None,
    "</p>DOC-01<p>DOC-02</p></p>DOC-03<p>PAY-01/02",
    '<p>DOC-01<br/>DOC-02<img alt="a>b">DOC-03 a < b</p><hr>DOC-04',
    "<p>" + "<b>" * 300 + "DOC-01" + "</b>" * 300 + "OPN-02</p>OPN-03",
    "<li>" + "word DOC-09 " * 5000 + "</li>DOC-01",
    "<p><span class='y'>DOC-01</span></p><span class=\"dlv-ref\">DOC-02</span><li>DOC-03</li>",
]


def test_spans_equal_the_relation_of_tags(spark):
    rows = list(enumerate(PAGES))
    con = duckdb.connect()
    con.register("ref_pages", pd.DataFrame(rows, columns=["page_id", "html"]))
    wanted = {r[0]: r[1:] for r in con.sql(_SPANS_SQL).fetchall()}
    got = {r.page_id: (r.n_spans, r.spans, r.text_digest) for r in _spans(pages.annotate_refs(spark.createDataFrame(rows, "page_id bigint, html string"))).collect()}
    assert got == wanted
    assert [got[i][0] for i in range(len(PAGES))] == [2, 3, 1, 2, 0, 0, 2, 3, 2, 5000, 2]


def test_no_pages(spark):
    assert _spans(pages.annotated_pages(spark.createDataFrame([], "page_id bigint, html string"))).count() == 0
