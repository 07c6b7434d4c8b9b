"""Plan-level helpers: checked broadcast joins and end-to-end jobs."""
