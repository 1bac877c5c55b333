"""The tables of the library."""

from __future__ import annotations

#: A parsed definition; ordinal is its place among those of a run.
PARSED = "file_path string, qualname string, entity_type string, signature string, source_code string, start_line int, end_line int, content_hash string, ordinal long"
#: A stored definition of a project.
ENTITY = "id long, project_id string, file_path string, qualname string, entity_type string, signature string, source_code string, description string, start_line int, end_line int, content_hash string, last_seen_run string, created_at timestamp, updated_at timestamp"
JOB = "id long, project_id long, status string, attempts int, run_after timestamp_ntz, heartbeat_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, last_error string, entities_total int, entities_done int"
KEYS = ["file_path", "qualname"]
#: What an entity's search vector is made of, by weight letter.
SEARCHED = {"A": "qualname", "B": "description", "C": "file_path", "D": "source_code"}
