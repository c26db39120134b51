"""Named queries against their DuckDB checks on the smallest tables.

Set ``ALL_CHECKS=1`` to run every query; by default a cross-section runs.
"""

import os

import pytest

import __spark_entry__ as contract
import oracle

SF = "/root/testdata/sf0.001"
QUICK = [
    "http_urls", "canonical_urls", "page_hrefs", "skip_policy", "audit_unique", "section_summary", "duplicate_refs", "index_lookup",
    "thumb_pairs", "vendor_winner", "media_candidates", "unique_names", "published_dates", "registry_check", "crawl_reach", "audit_csv",
    "page_caps", "pagination_closure", "stream_resume", "stream_audit", "stream_first_per_key", "id_gap_ranges", "scan_readmitted", "seed_files",
    "file_listing_check", "table_append", "vendor_adapters", "rule_table_skips", "page_text",
]
CHECKS = contract.oracle_sql()
NAMES = sorted(CHECKS) if os.environ.get("ALL_CHECKS") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check(spark, con, name):
    ok, message = oracle.compare(contract.queries()[name](spark, SF), con, CHECKS[name])
    assert ok, message


def test_entry(spark):
    assert contract.entry(spark).count() > 0
