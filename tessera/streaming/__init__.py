"""Incremental runs: documents are checked as they arrive."""
