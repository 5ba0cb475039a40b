"""Readers and writers: the versioned store, logs, transcripts, files."""
