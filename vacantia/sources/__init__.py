"""Readers: stored tables, JSON lines, raw pages and crawl requests."""
