"""Record schemas as DDL; nothing is inferred."""

RICH_BLOCK = "STRUCT<type: STRING, anchor: STRING, summary: STRING>"
PAGE_FIELDS = (
    "path: STRING, title: STRING, parent_page_id: STRING, url: STRING, last_synced_at: STRING, local_hash: STRING, remote_hash: STRING, "
    f"rich_blocks: ARRAY<{RICH_BLOCK}>, has_children: BOOLEAN, local_ignored: BOOLEAN"
)
TRASH_FIELDS = "page_id: STRING, path: STRING, trashed_at: STRING, trashed_by: STRING, title: STRING, last_local_hash: STRING"
MANIFEST = (
    "schema_version INT, plugin_version STRING, parent STRUCT<page_id: STRING, url: STRING, title: STRING>, "
    f"pages MAP<STRING, STRUCT<{PAGE_FIELDS}>>, trash_log ARRAY<STRUCT<{TRASH_FIELDS}>>"
)
CONFIG = "schema_version INT, plugin_version STRING, parent STRUCT<page_id: STRING, url: STRING, title: STRING>, created_at STRING"
READ_RECORD = (
    "page_id STRING, path STRING, remote_hash STRING, manifest_remote_hash STRING, has_children BOOLEAN, "
    f"child_link_tags ARRAY<STRING>, rich_blocks ARRAY<{RICH_BLOCK}>, title STRING"
)
WRITE_RESULT = "page_id STRING, path STRING, pushed BOOLEAN, new_remote_hash STRING, warnings ARRAY<STRING>, error STRING"
DIFF_RECORD = "page_id STRING, path STRING, diff_text STRING, ok BOOLEAN, error STRING"
