"""Rules from tables, host names of all scripts, runs appended twice, gaps of ids."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.hosts import ascii_host
from pagequarry.operators import file_index as X
from pagequarry.operators import rules as R
from pagequarry.sources import corpus, sinks


def test_ascii_hosts_equal_the_standard_codec(spark):
    dice = random.Random(1)
    thai = [chr(c) for c in [*range(0xE01, 0xE3A), *range(0xE40, 0xE4E)]]
    hosts = ["example.org", "เทศบาล.example.org", "bücher.DE", "ü", "中文。com", "a-b.日本語", "😀.la", "x" * 40 + "é", ""]
    hosts += ["".join(dice.choices(thai + list("abc-12"), k=dice.randrange(1, 25))) + ".th" for _ in range(60)]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", ascii_host(F.col("h")).alias("a")).collect()
    for row in got:
        labels = row["h"].lower().replace("。", ".").split(".")
        assert row["a"] == ".".join("xn--" + p.encode("punycode").decode() if not p.isascii() else p for p in labels)


def test_ipv6_hosts_are_short(spark):
    good = ["::1", "2001:db8:0:0:0:0:0:1", "2001:0DB8::1:0:0:1", "::", "1:2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "fe80::", "0:0:1:0:0:1:0:0"]
    rows = spark.createDataFrame([(f"[{h}]",) for h in [*good, "1:2", "zz::1"]] + [(None,)], "h string")
    got = {r["h"]: r["a"] for r in rows.select("h", ascii_host(F.col("h")).alias("a")).collect()}
    assert all(got[f"[{h}]"] == f"[{ipaddress.ip_address(h)}]" for h in good)
    assert got["[1:2]"] is None and got["[zz::1]"] is None and got[None] is None


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([
        (2, "host", "https://www.Bad.org:80/x", None), (1, "host", "deep.bad.org", None), (5, "url_regex", r"/file/d/", "viewer"), (4, "url_regex", r"/FILE/", "file"),
        (1, "fragment", "Secret", None), (1, "host", "", None), (3, "fragment", None, None),
    ], "rank int, kind string, pattern string, reason string")
    links = ["https://bad.org/a", "https://x.deep.bad.org/", "https://notbad.org/", "ftp://bad.org/", "http://ok.net/file/d/1", "http://ok.net/SECRET", "http://www.bad.org/file/2", None]
    got = {r["href"]: r["skip_reason"] for r in R.table_skips(spark.createDataFrame([(u, 1) for u in links], "href string, n int"), rules).collect()}
    host = lambda h: f"โดเมน {h} อยู่ในรายการห้ามเปิด"
    assert got == {
        links[0]: host("bad.org"), links[1]: host("deep.bad.org"), links[2]: None, links[3]: "ข้าม protocol ที่ไม่รองรับ: ftp:", links[4]: "file",
        links[5]: "URL ตรงกับข้อความที่กำหนดให้ข้าม: secret", links[6]: "file", None: None,
    }
    many = spark.range(R.MAX_PATTERNS + 1).selectExpr("CAST(id AS INT) AS rank", "'fragment' AS kind", "'x' AS pattern", "'' AS reason")
    with pytest.raises(ValueError, match="pattern rules"):
        R.table_skips(spark.createDataFrame([("http://a/",)], "href string"), many)


def test_unknown_vendors_get_the_generic_adapter(spark):
    adapters = spark.createDataFrame([(" CJWorld", "b", {"m": "1"}), ("cjworld", "a", {"m": "2"}), ("generic", "g", {})], "adapter_id string, adapter_name string, settings map<string,string>")
    sites = spark.createDataFrame([("s1", "cjWORLD "), ("s2", "nobody"), ("s3", None)], "site string, vendor_id string")
    got = {r["site"]: (r["adapter_id"], r["adapter_name"], r["settings"]) for r in R.with_adapters(sites, adapters).collect()}
    assert got == {"s1": ("cjworld", "a", {"m": "2"}), "s2": ("generic", "g", {}), "s3": ("generic", "g", {})}


def test_runs_replace_their_own_rows(spark, tmp_path):
    made = lambda run, urls: spark.createDataFrame([(run, u) for u in urls], "run_id string, page_url string")
    folder = str(tmp_path)
    sinks.append_runs(made("a b/c", ["1", "2", "3"]), "crawl_pages", folder)
    sinks.append_runs(made("other", ["9"]), "crawl_pages", folder)
    sinks.append_runs(made("a b/c", ["1", "4"]), "crawl_pages", folder)
    # a load that broke off before its manifest
    sinks.conform(made("other", ["8"]), "crawl_pages").withColumn("load", F.lit("broken")).write.mode("append").partitionBy("run_id", "load").parquet(f"{folder}/crawl_pages/data")
    back = sinks.read_runs(spark, "crawl_pages", folder)
    assert back.columns == sinks.target_schema("crawl_pages").names
    assert sorted((r["run_id"], r["page_url"]) for r in back.collect()) == [("a b/c", "1"), ("a b/c", "4"), ("other", "9")]


def test_gaps_of_ids_as_ranges(spark):
    far = 900_000_000_000_000_000
    details = [("s", i) for i in (1, 2, 5, 5, 9, far)] + [("full", i) for i in (1, 2, 3)] + [("low", 4), ("s", -3), ("s", 0), ("plain", 7)]
    seeds = [("s", 100, True), ("full", 3, True), ("low", 5, True), ("none", 5, True), ("plain", 5, False)]
    d, s = spark.createDataFrame(details, "seed string, detail_id long"), spark.createDataFrame(seeds, "seed string, declared long, has_category boolean")
    for ranges in (1, 3, 8):
        got = sorted(tuple(r) for r in X.id_gap_ranges(s, d, ranges=ranges).collect())
        assert got == [("low", 1, 3), ("s", 3, 4), ("s", 6, 8), ("s", 10, far - 1)]
    capped = sorted(tuple(r) for r in X.id_gap_ranges(s, d, cap=7, ranges=3).collect())
    assert capped == [("low", 1, 3), ("low", 5, 7), ("none", 1, 7), ("s", 3, 4), ("s", 6, 7)]


def test_scanned_pages_that_name_a_category(spark):
    pages = spark.createDataFrame([
        (1, "u1", "x news.php?cat_id=12&p=1 NEWS.PHP?cat_id=7"), (2, "u2", "news.php?cat_id=news.php?cat_id=Ab"), (3, "u3", None), (4, "u4", "news_php?cat_id=12"), (5, "u5", "news.php?cat_id=12"),
    ], "detail_id long, url string, html string")
    seeds = spark.createDataFrame([("one", "1"), ("twelve", "12"), ("ab", "aB"), ("empty", ""), ("null", None)], "seed string, cat_id string")
    known = spark.createDataFrame([("twelve", 5)], "seed string, detail_id long")
    got = sorted((r["seed"], r["detail_id"]) for r in X.scan_readmitted(pages, seeds, known).collect())
    assert got == [("ab", 2), ("one", 1), ("one", 5), ("twelve", 1)]


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "b.txt").write_text("\n".join(lines[100:]) + "\n")
    (tmp_path / "a.txt").write_text("\n".join(lines[:100]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = {r["seq"]: r["line"] for r in corpus.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(lines, 1))
