"""Page records: what stands before the content area is cut, and no step walks a page slowly."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import dates
from pagequarry.functions.text import any_text, ci
from pagequarry.operators import content

DETAIL = '<div class="detail">{} with more than twenty letters</div>'
AREA = '<SPAN id=x class="a Title3">Heading</SPAN>'


def test_area_begins_behind_the_first_heading(spark):
    pages = [
        (1, DETAIL.format("before, long enough to be the best") + "İ é 😀\n" + AREA + DETAIL.format("after") + AREA),
        (2, AREA + AREA + DETAIL.format("after")), (3, DETAIL.format("alone\n")), (4, None), (5, ""), (6, "x" + AREA),
    ]
    got = spark.createDataFrame(pages, "page_id long, html string").select("page_id", content.content_html(F.col("html")).alias("b"))
    assert {r["page_id"]: r["b"] for r in got.collect()} == {
        1: "after with more than twenty letters", 2: "after with more than twenty letters", 3: "alone\n with more than twenty letters", 4: "", 5: "", 6: "",
    }


def test_published_text_skips_empty_finds(spark):
    pages = [
        (1, '<time datetime="2024-05-06::x">a</time>'), (2, '<time datetime=" ">a</time> 2024-05-07'), (3, None), (4, "none"),
        (5, "ประกาศเมื่อ <span>\n1 มิ.ย. 2569</span>"), (6, '<meta name="date" content="<b></b>"><time datetime="2024-01-02">'),
    ]
    got = spark.createDataFrame(pages, "page_id long, html string").select("page_id", dates.published_text(F.col("html")).alias("d"))
    assert {r["page_id"]: r["d"] for r in got.collect()} == {1: "2024-05-06", 2: "2024-05-07", 3: "", 4: "", 5: "1 มิ.ย. 2569", 6: "2024-01-02"}


@pytest.mark.parametrize("pattern", [r"<a>([\s\S]*?)</a>", r"<([ab])>[\s\S]*?</\1>"])
def test_patterns_find_what_they_found(spark, pattern):
    text = "<A>x\r\n 😀</a><a></A><b>1</a>2</b>"
    found = spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit("(?i)" + pattern), F.lit(0)), F.regexp_extract_all(F.lit(text), F.lit(ci(pattern)), F.lit(0))).first()
    assert found[0] == found[1] and any_text(pattern) != pattern


def test_records_have_no_slow_pattern(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/?id=1", "<p>x</p>")], "page_id long, url string, html string")
    plan = content.page_records(pages)._jdf.queryExecution().analyzed().toString()
    # visible texts look for these two only where a script or style is
    for rare in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>"):
        plan = plan.replace(rare, "")
    assert r"[\s\S]*?" not in plan
