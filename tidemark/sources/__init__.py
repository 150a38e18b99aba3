"""Tables in and out: scans, lookups, validated ingest, upserts, models."""
