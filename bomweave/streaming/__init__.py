"""Structured Streaming forms of the scan, the event intake, the quota and the
account fold."""
