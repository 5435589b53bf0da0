"""Explicit schemas of the archive's tables; nothing is inferred."""

from __future__ import annotations

ADDRESS = "array<struct<name: string, address: string>>"
MESSAGES = (
    "id long, message_id string, thread_id string, maildir_path string, maildir_filename string, folder string, subject string, "
    f"from_address string, from_name string, to_addresses {ADDRESS}, cc_addresses {ADDRESS}, date_sent timestamp, date_sent_raw string, "
    "date_received timestamp, size_bytes long, has_attachments boolean, attachment_names string, attachment_text string, body_text string, "
    "body_html string, raw_headers string, indexed_at timestamp, embedded_at timestamp, deleted_at timestamp, content_hash string, embed_epoch long"
)
ATTACHMENTS = "id long, message_id long, part_index int, filename string, content_type string, size_bytes long, extracted_text string, extracted_at timestamp, extraction_status string, ocr_model string"
CHUNKS = "id long, message_id long, chunk_index int, chunk_text string, token_count int, source string, attachment_id long"
CHUNK_EMBEDDINGS = "chunk_id long, embedding array<float>"
SYNC_STATE = "maildir_full_path string, message_id string, last_seen_at timestamp, content_hash string, folder string, file_mtime_utc timestamp, file_size long"
METADATA = "key string, value string"
QRELS = "query_id string, message_id string, grade double"
EVAL_QUERIES = "query_id string, query string, folder string, date_from string, date_to string, from_contains string, from_exact string, expect_empty boolean, relevant array<struct<message_id: string, grade: double>>"
OCR_PAGES = "engine string, attachment_id long, page int, reference string, hypothesis string, elapsed_ms double, error string"
TOOL_CALLS = "ts timestamp, tool string, args string"
VERSION = 11
