"""Album pages: which area is the detail, and what is left of its text."""

from pagequarry.operators.albums import album_details

LONG = "เทศบาลจัดกิจกรรมปลูกต้นไม้ร่วมกับประชาชนในพื้นที่ตำบลบ้านนา เพื่อเพิ่มพื้นที่สีเขียวในชุมชนของเราและสร้างความสามัคคี"
SHORT = "เชิญร่วมกิจกรรมทำบุญ"


def page(body):
    return f"<html><body>{body}</body></html>"


CASES = {  # html, title: block, text
    "marked span": (page(f"<span class='detail'> <!-- c -->{SHORT}<img src=a></span>"), "", SHORT, SHORT),
    "unquoted class": (page(f"<span class=detail>{SHORT}</span>"), "", SHORT, SHORT),
    "span before label": (page(f'<span class="detail">{SHORT}</span><td class="title3">รายละเอียด</td><td class="styles1">{LONG}</td>'), "", SHORT, SHORT),
    "label": (page(f'<td class="x title3"><b>รายละเอียด :</b></td>\n<td class="styles1 y">{SHORT}</td>'), "", SHORT, SHORT),
    "the fullest div above a gallery": (
        page(f'<b>อัลบั้มภาพ "x"</b><div style="margin-top: 20px">{LONG}</div><div style="margin-top:20px">{LONG} {LONG}</div><a rel="lightbox[a]" href=b>1</a>'), "",
        f"{LONG} {LONG}", f"{LONG} {LONG}",
    ),
    "centred div below": (
        page(f'<div id="svDivAlbumsMoreC"><i>m</i></div><div align="center" style="margin-top:20px">x</div><div align="center" style="margin-top:20px"><p>{SHORT}</p></div><iframe></iframe>'), "",
        f"<p>{SHORT}</p>", SHORT,
    ),
    "between marker and attachments": (page(f'<div id="svDivAlbumsMoreC"></div> <p>{LONG}</p> <!--attach files--> <iframe>'), "", f"<p>{LONG}</p>", LONG),
    "below the gallery": (page(f'<table><tr><td>/album/picture/b_1.jpg</td></tr></table><p>{LONG}</p><script>x</script>'), "", f"<p>{LONG}</p>", LONG),
    "above the gallery": (page(f'<b>อัลบั้มภาพ "งาน"</b><p>{LONG}</p><img src="picture/b_1.jpg"></div>'), "", f'<b>อัลบั้มภาพ "งาน"</b><p>{LONG}</p><img src="', LONG),
    "title leads": (page(f"<span class=detail>งานบุญ > {LONG}</span>"), "งานบุญ", f"งานบุญ > {LONG}", LONG),
    "only the way here": (page("<span class=detail>หน้าแรก > อัลบั้มภาพกิจกรรม > งาน</span>"), "", "", ""),
    "page text": (page(f"<nav>เมนู</nav><p>โครงการ {LONG[:45]}</p>"), "โครงการ", "", LONG[:45].strip()),
    "no thai": (page("<p>" + "plain english text " * 20 + "</p>"), "", "", ""),
    "no page": (None, None, "", ""),
    "empty": ("", "", "", ""),
}


def test_blocks_and_texts(spark):
    rows = [(n, html, title) for n, (html, title, _, _) in CASES.items()]
    got = {r["page_id"]: (r["album_block"], r["album_text"]) for r in album_details(spark.createDataFrame(rows, "page_id string, html string, title string")).collect()}
    assert got == {n: (block, text) for n, (_, _, block, text) in CASES.items()}


def test_texts_are_cut_only_when_a_limit_is_given(spark):
    words = " ".join([LONG] * 600)
    df = spark.createDataFrame([(1, page(f"<span class=detail>{words}</span>"), None)], "page_id long, html string, title string")
    assert album_details(df).first()["album_text"] == words
    assert album_details(df, limit=50).first()["album_text"] == words[:50]
