"""Readers and writers of files: CSV exports, uploaded payment tables, partitioned splits and metadata."""
