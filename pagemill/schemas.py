"""Row types and versions that more than one module names."""

from __future__ import annotations

PAGE = "page_id bigint, url string, html string"
SCHEMA_VERSION = "2.0"
