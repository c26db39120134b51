"""Target schemas of the stored tables (Spark DDL)."""

SCHEMAS = {
    "announcements": """
        site STRING, run_id STRING, page_id INT, detail_id STRING, listing_url STRING, listing_path STRING,
        detail_url STRING, detail_path STRING, section_key STRING, section_label STRING, folder_path STRING,
        record_text_path STRING, title STRING, detail_html STRING, detail_text STRING,
        published_text DATE, published_raw STRING, published_at TIMESTAMP_NTZ, media_type STRING,
        media_provider STRING, embed_url STRING, is_downloaded BOOLEAN, file_type STRING, file_name STRING,
        file_url STRING, local_path STRING, file_size BIGINT, file_mime_type STRING, file_sha256 STRING,
        pdf_data BINARY, pdf_stored_in_db BOOLEAN, downloaded_at TIMESTAMP_NTZ""",
    "activity_details": """
        page_no INT, album_id STRING, listing_url STRING, listing_path STRING, activity_url STRING,
        activity_path STRING, title STRING, detail_html STRING, detail_text STRING,
        detail_text_path STRING, announced_text STRING, announced_date DATE, announced_at TIMESTAMP_NTZ,
        folder_path STRING, scraped_at TIMESTAMP_NTZ""",
    "activity_images": """
        page_no INT, album_id STRING, listing_url STRING, activity_url STRING, title STRING,
        detail_html STRING, detail_text STRING, announced_date DATE, announced_text STRING,
        announced_at TIMESTAMP_NTZ, detail_text_path STRING, folder_path STRING, image_index INT,
        image_name STRING, image_url STRING, local_path STRING, file_size BIGINT,
        download_source STRING, media_type STRING, media_mime_type STRING, media_provider STRING,
        embed_url STRING, downloaded_at TIMESTAMP_NTZ""",
    "activity_media": """
        album_id STRING, activity_url STRING, title STRING, media_index INT,
        media_type STRING, media_provider STRING, media_name STRING, media_url STRING,
        embed_url STRING, local_path STRING, file_size BIGINT, media_mime_type STRING, file_sha256 STRING,
        pdf_data BINARY, pdf_stored_in_db BOOLEAN, download_source STRING, is_downloaded BOOLEAN,
        downloaded_at TIMESTAMP_NTZ""",
    "crawl_pages": """
        run_id STRING, page_url STRING, final_url STRING, title STRING, depth INT,
        status STRING, http_status INT, html_path STRING, text_path STRING, detail_text STRING,
        discovered_from STRING, content_sha256 STRING, error_message STRING, scraped_at TIMESTAMP_NTZ""",
    "crawl_assets": """
        run_id STRING, page_url STRING, asset_url STRING, final_url STRING, asset_type STRING,
        file_name STRING, local_path STRING, mime_type STRING, file_size BIGINT, file_sha256 STRING,
        status STRING, http_status INT, discovered_via STRING, pdf_data BINARY,
        pdf_stored_in_db BOOLEAN, error_message STRING, downloaded_at TIMESTAMP_NTZ""",
    "fetch_audit": """
        seq BIGINT, run_id STRING, section_key STRING, section_label STRING, table_name STRING,
        source_type STRING, detail_id STRING, detail_url STRING, title STRING, file_url STRING,
        normalized_file_url STRING, file_name STRING, file_type STRING, discovered_via STRING,
        link_text STRING, status STRING, http_status INT, downloadable BOOLEAN, downloaded BOOLEAN,
        error_message STRING, local_path STRING, file_size BIGINT, content_type STRING, final_url STRING,
        duplicate_of_url STRING, checked_at TIMESTAMP_NTZ""",
    "site_profiles": """
        run_id STRING, website_name STRING, site_url STRING, vendor_id STRING,
        vendor_name STRING, adapter_id STRING, confidence INT, score INT,
        evidence ARRAY<STRUCT<type: STRING, label: STRING, value: STRING, weight: INT>>,
        probes ARRAY<STRUCT<requested_url: STRING, final_url: STRING, status_code: INT, error: STRING>>,
        suggested MAP<STRING, STRING>, detected_at TIMESTAMP_NTZ""",
    "topic_registry": """
        table_name STRING, section_key STRING, full_title STRING, section_label STRING,
        source_url STRING, run_id STRING, name_truncated BOOLEAN, created_at TIMESTAMP_NTZ,
        updated_at TIMESTAMP_NTZ""",
    "file_index": """
        seq BIGINT, url STRING, final_url STRING, local_path STRING, sha256 STRING, file_size BIGINT,
        mime_type STRING, added_at TIMESTAMP_NTZ""",
}
