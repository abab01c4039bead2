"""Readers and writers for the feed and the three tables."""
