"""Readers and writers: JSON lines, CSV, text, write-once folders, logs, checks of artifacts."""
