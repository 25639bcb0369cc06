"""Readers and writers for corpora, JSONL files, objects and tables."""
