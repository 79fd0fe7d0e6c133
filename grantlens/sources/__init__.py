"""Readers and writers: relational tables, nested JSON documents, exports."""
