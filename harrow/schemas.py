"""Schemas and exact strings that are part of the outputs."""

RECORD = "company string, title string, location string, date_posted timestamp, job_url string, apply_url string, employment_type string, remote boolean, description string, ats_provider string, scraping_method string"
STATE = "job_id string, job_url string, company string, title string, location string, first_seen timestamp, last_seen timestamp, date_posted timestamp, misses int, record_hash string, changed_at timestamp, changed_fields array<string>"
NOTIFIED = "job_id string, kind string, sent_at timestamp"

# Exported strings.
WITHIN, OLDER, UNDATED = "within_window", "older_than_window", "date_unavailable"
POSTED, FIRST_SEEN, NO_DATE = "posted", "first_seen", "none"
REMOTE_US, RESTRICTED, NON_US, HYBRID, ONSITE = "remote_us", "remote_restricted", "remote_non_us", "hybrid", "onsite"
NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"
PROBLEMS = ("partial", "failed", "blocked")
