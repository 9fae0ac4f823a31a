"""Incremental versions of the batch operators over arriving log files."""
