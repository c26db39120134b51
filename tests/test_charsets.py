"""Bodies in the charset they name, against Python's codecs."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from pagequarry.operators import files
from pagequarry.plans.media_queries import declared_bodies

SF = "/root/testdata/sf0.001"
BODIES = [  # label, Python's codec, text
    ("iso-8859-1", "cp1252", "é “x” €"), ("latin1", "cp1252", "ÿ …"), ("us-ascii", "cp1252", "ü"), ("windows-1250", "cp1250", "žluť"), ("windows-1251", "cp1251", "слово"),
    ("iso-8859-2", "iso8859-2", "žluť"), ("iso-8859-9", "cp1254", "ığş"), ("koi8-r", "koi8-r", "слово"), ("gb2312", "gb18030", "中文"), ("gbk", "gbk", "中文"), ("big5", "big5", "中文"),
    ("euc-jp", "euc-jp", "日本語"), ("shift_jis", "cp932", "日本語"), ("euc-kr", "cp949", "한국어"), ("iso-8859-11", "cp874", "ข่าว"), ("tis-620", "cp874", "ข่าว"), ("none-such", "utf-8", "ข่าว é"),
]


@pytest.fixture
def replacing(spark):
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    yield spark
    spark.conf.unset("spark.sql.legacy.codingErrorAction")


def test_charset_labels(replacing):
    rows = [(i, bytearray(text.encode(codec)), f"text/html; charset={label}") for i, (label, codec, text) in enumerate(BODIES)]
    rows += [(98, bytearray(b"a\xff"), "text/html; charset=tis-620"), (99, bytearray(b"a\x81\xff"), "charset=iso-8859-1")]
    got = {r["i"]: r["text"] for r in files.decoded_bodies(replacing.createDataFrame(rows, "i int, content binary, declared_type string")).collect()}
    assert [got[i] for i in range(len(BODIES))] == [text for _, _, text in BODIES]
    assert got[98] == "a�" and got[99] == "a\x81ÿ"


def test_whole_pages_come_back(replacing):
    pages = replacing.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    want = {r["page_id"]: hashlib.sha256(r["html"].encode()).hexdigest() for r in pages.collect()}
    got = contract.queries()["decoded_bodies"](replacing, SF).collect()
    assert {r["page_id"]: r["text_sha256"] for r in got} == want and len(got) == pages.count()
    odd = replacing.createDataFrame([(1, "ข่าว “a” €"), (4, "ข่าว é"), (2, "é ß ÿ"), (5, "é €"), (3, "中文 é")], "page_id long, html string")
    back = {r["page_id"]: (r["charset"], r["text"]) for r in files.decoded_bodies(declared_bodies(odd)).collect()}
    assert back == {1: ("windows-874", "ข่าว “a” €"), 4: ("utf-8", "ข่าว é"), 2: ("iso-8859-1", "é ß ÿ"), 5: ("utf-8", "é €"), 3: ("utf-8", "中文 é")}
    assert pages.where(F.col("html").rlike(r"[^\x00-\x7F]")).count() > 0
