"""Small inputs with known results, per job."""

from pyspark.sql import functions as F

from pagequarry.functions import dates as D
from pagequarry.functions import media as M
from pagequarry.functions import urls as U
from pagequarry.functions.text import clean_text
from pagequarry.operators import audit as A
from pagequarry.operators import classify as C
from pagequarry.operators import content as N
from pagequarry.operators import extract as X
from pagequarry.operators import file_index as I
from pagequarry.operators import files as B
from pagequarry.operators import media as G
from pagequarry.operators import policy as P
from pagequarry.operators.ordinals import with_ordinal

BASE = "https://www.example.go.th/news/list.php?cat_id=1"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def each(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def page(spark, html, url=BASE):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


def test_resolution(spark):
    refs = ["a.html", "/x y", "//h.org", "?p=2", "#t", "../up/./z", "HTTP://H.org:80", "mailto:a@b", "http://", "ก", "b\\c", "", "x'?q='"]
    got = each(spark, lambda v: U.resolve(v, F.lit(BASE)), refs)
    root = "https://www.example.go.th"
    assert got == [
        f"{root}/news/a.html", f"{root}/x%20y", "https://h.org/", f"{root}/news/list.php?p=2", f"{BASE}#t", f"{root}/up/z",
        "http://h.org/", None, None, f"{root}/news/%E0%B8%81", f"{root}/news/b/c", BASE, f"{root}/news/x'?q=%27",
    ]


def test_canonical_forms(spark):
    u = "https://www.example.go.th/page.php?utm_source=x&id=10#top"
    assert each(spark, U.crawl_canonical, [u, "mailto:x"]) == ["https://www.example.go.th/page.php?id=10", ""]
    got = each(spark, U.canonical, ["https://a.b/?z=1&A=2&gclid=3&a=c d#f", "https://a.b/?utm_term=1", "https://a.b/x?e"])
    assert got == ["https://a.b/?A=2&a=c+d&z=1", "https://a.b/", "https://a.b/x?e="]
    assert each(spark, U.canonical, got) == got


def test_entities_before_tags(spark):
    got = each(spark, clean_text, ["a&nbsp;&amp;lt;b&#x41;&#66;&lt;i&gt;z&unknown;", "<p>x<script>1</script> y</p>"])
    assert got == ["a &lt;bABz&unknown;".replace("z", " z"), "x y"]


def test_identity(spark):
    ident = lambda v: U.record_id(v, U.first_params(v))
    h = "https://a.go.th"
    assert each(spark, ident, [f"{h}/detail.php?id=101", f"{h}/news/view/public-relations-123", f"{h}/x_data.php?record=501", f"{h}/news/"]) == [
        "101", "public-relations-123", "501", None,
    ]
    album = lambda v: U.album_id(v, U.first_params(v))
    assert each(spark, album, [f"{h}/gallery/detail/22807/data.html", f"{h}/gallery/view/99"]) == ["22807", "99"]
    assert each(spark, lambda v: U.page_number(v, U.first_params(v)), [f"{h}/gallery/page/7", f"{h}/?pagenum=2", h + "/"]) == ["7", "2", "1"]


def test_asset_classes_and_scope(spark):
    h = "https://a.go.th"
    got = each(spark, lambda v: M.asset_class(v, F.lit("")), [f"{h}/r.PDF", f"{h}/p.webp", f"{h}/a.js", f"{h}/f.woff2", f"{h}/x"])
    assert got == ["documents", "images", "scripts", "fonts", "other"]
    assert each(spark, P.is_public_page, [f"{h}/news.php?id=10", f"{h}/admin/login.php", f"{h}/files/report.pdf"]) == [True, False, False]


def test_skip_policy(spark):
    urls = ["https://info.go.th/x", "https://sub.info.go.th/x", "https://drive.google.com/file/d/1/view",
            "https://drive.google.com/uc?export=download", "https://example.go.th/a", "https://b.go.th/private-preview/x", "ftp://a/b"]
    skipped = each(spark, lambda v: P.skip_reason(v, hosts=["example.go.th"], fragments=["/private-preview/"]).isNotNull(), urls)
    assert skipped == [True, True, True, False, True, True, True]
    assert each(spark, lambda v: P.skip_reason(v, use_defaults=False).isNotNull(), urls[:1]) == [False]


def test_links_of_malformed_table(spark):
    html = (
        '<table><tr><td><a href="/d.php?id=241">First <b>title</b></td></tr>'
        '<tr><td><a href="/d.php?id=240">Second title</a></td></tr></table>'
    )
    rows = X.navigation_links(page(spark, html)).orderBy("pos").collect()
    assert [(r.href.split("=")[1], r.text) for r in rows] == [("241", "First title"), ("240", "Second title")]


def test_script_and_form_links(spark):
    html = (
        "<a href=\"javascript:MM_openBrWindow('news_detail.php?news_id=912','','')\">one record</a>"
        "<div onclick=\"window.open('news_detail.php?id=913')\">x</div>"
        '<form action="list.php"><input type="hidden" name="cat_id" value="1"><input name="pagenum" value="2"></form>'
    )
    links = X.navigation_links(page(spark, html))
    seeds = spark.createDataFrame([("s", BASE, "generic")], "seed_id string, seed_url string, vendor_id string")
    rows = C.classified_links(links, seeds).collect()
    assert sorted(r.kind for r in rows) == ["detail", "detail", "listing"]


def test_legacy_category_links(spark):
    html = (
        '<a href="/news/detail.php?id=101">Some record title</a><a href="/news/list.php?cat_id=1&amp;page=2">2</a>'
        '<a href="/news/list.php?cat_id=2&amp;page=2">2</a>'
    )
    seeds = spark.createDataFrame([("s", BASE, "generic")], "seed_id string, seed_url string, vendor_id string")
    rows = {r.target.split("/")[-1]: r.kind for r in C.classified_links(X.navigation_links(page(spark, html)), seeds).collect()}
    assert rows == {"detail.php?id=101": "detail", "list.php?cat_id=1&page=2": "listing", "list.php?cat_id=2&page=2": "other"}


def test_media_types(spark):
    html = (
        '<video><source src="/v.mp4" type="video/mp4"></video><audio src="/a.mp3"></audio>'
        '<iframe src="https://www.youtube.com/embed/x1"></iframe><a href="/f.pdf">file</a><script>var u = "/live/s.m3u8";</script>'
    )
    rows = {r.href.rsplit("/", 1)[-1]: (r.kind, r.provider, r.downloadable) for r in G.media_candidates(page(spark, html)).collect()}
    assert rows == {
        "v.mp4": ("video", None, True), "a.mp3": ("audio", None, True), "x1": ("video_embed", "youtube", False),
        "f.pdf": ("document", None, True), "s.m3u8": ("video", None, False),
    }


def test_listing_metadata(spark):
    df = spark.createDataFrame([
        ("ประกาศราคากลาง 💾 [อ่าน 10 คน] เมื่อ 11 มิ.ย. 2569", "x"), ("เรื่อง: ทดสอบประกาศ [อ่าน 5 คน] เมื่อ 1/8/2569", "")], "text string, context_text string")
    rows = N.listing_metadata(df).collect()
    assert [(r.title, r.published_raw) for r in rows] == [("ประกาศราคากลาง", "11 มิ.ย. 2569"), ("ทดสอบประกาศ", "1/8/2569")]


def test_dates(spark):
    raw = "ประกาศเมื่อวันที่ 5 กรกฎาคม 2568 เวลา 09:30 น."
    assert one(spark, D.published_raw(F.col("v")), v=raw) == "5 กรกฎาคม 2568 เวลา 09:30 น."
    assert str(one(spark, D.to_timestamp(F.col("v")), v=raw)) == "2025-07-05 09:30:00"
    got = each(spark, lambda v: D.to_date(v).cast("string"), ["31/02/2568", "1/8/69", "2569-1-2", "5 ก.ค. 68", "none"])
    assert got == [None, "2069-08-01", "2026-01-02", None, None]


def test_signatures(spark):
    bodies = spark.createDataFrame(
        [(bytearray(b"%PDF-1.7"), "text/html"), (bytearray(b"PK\x03\x04"), ""), (bytearray.fromhex("D0CF11E0A1B11AE1"), ""),
         (bytearray(b"<html><body>"), "application/pdf"), (bytearray(b"\xff\xfb\x90"), "")],
        "content binary, declared_type string",
    )
    rows = B.file_signatures(bodies).collect()
    assert [(r.kind, r.looks_like_html) for r in rows] == [("pdf", False), ("zip", False), ("ole", False), ("unknown", True), ("mp3", False)]


def test_thai_body_and_sanitize(spark):
    body = "<meta charset=tis-620>ข่าว".encode("cp874")
    row = B.decoded_bodies(spark.createDataFrame([(bytearray(body), "")], "content binary, declared_type string")).first()
    assert (row.charset, row.text) == ("windows-874", "<meta charset=tis-620>ข่าว")
    assert one(spark, B.tis620_text(F.col("v")), v="หัวข้อ ✅ test") == "หัวข้อ  test"
    assert one(spark, B.tis620_text(F.col("v"), compose=True), v="a✅") == "a"


def test_audit_ties_and_totals(spark):
    rows = [(1, "https://a/f#1", "timeout"), (2, "https://a/f", "timeout"), (3, "https://a/g", "not_found"), (4, "https://a/g", "downloaded")]
    audit = spark.createDataFrame(rows, "seq bigint, file_url string, status string")
    assert sorted(r.seq for r in A.unique_files(audit).collect()) == [1, 4]
    s = A.audit_summary(audit).first()
    assert (s.total_references, s.unique_files, s.duplicate_references, s.failed) == (4, 2, 2, 1)
    assert {r.seq: r.is_duplicate for r in A.flag_duplicates(audit).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_index_modes(spark):
    ddl = "seq bigint, url string, final_url string, local_path string, sha256 string, file_size bigint, mime_type string, added_at timestamp_ntz"
    index = spark.createDataFrame([(1, "https://a/1", "https://a/one", "/p1", "h1", 1, "", None)], ddl)
    got = spark.createDataFrame([
        (2, "https://a/1#x", "https://a/1", "/n", "h9", 1, "", None), (3, "https://a/2", "https://a/one", "/n", "h9", 1, "", None),
        (4, "https://a/3", "https://a/3", "/n", "h1", 1, "", None), (5, "https://a/4", "https://a/4", "/n", "h5", 1, "", None)], ddl)
    by = lambda **o: {r.seq: r.found_by for r in I.index_lookup(got, index, **o).collect()}
    assert by() == {2: "url", 3: "final_url", 4: "sha256", 5: None}
    assert by(force_refresh=True) == {2: None, 3: None, 4: "sha256", 5: None}
    assert set(by(skip_existing=False).values()) == {None}


def test_ordinals_across_blocks(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 7 AS string) END AS k")
    got = {(r.k, r.id): r.n for r in with_ordinal(df, ["k"], "id", "n", ranges=10).collect()}
    seen = {}
    for (k, i) in sorted(got, key=lambda x: x[1]):
        seen[k] = seen.get(k, 0) + 1
        assert got[k, i] == seen[k]


def test_section_titles(spark):
    url = "https://www.testtown.go.th/datacenter/information.php"
    pages = [
        "<h1>เทศบาลตำบลทดสอบ</h1><h2>ข่าวจัดซื้อ</h2>", '<div class="breadcrumb"><a>หน้าแรก</a> » <a>ข่าวประชาสัมพันธ์</a></div>',
        '<ul class="breadcrumb">หน้าแรก » แผนพัฒนา</ul>', "<title>ราคากลาง | เทศบาลตำบลทดสอบ</title>",
        "<meta property='og:title' content='กิจกรรม'>", "<p>x</p>",
    ]
    assert each(spark, lambda v: N.section_title(v, F.lit(url)), pages) == [
        "ข่าวจัดซื้อ", "ข่าวประชาสัมพันธ์", "แผนพัฒนา", "ราคากลาง", "กิจกรรม", "information",
    ]
