"""The ingest job and the five views."""
