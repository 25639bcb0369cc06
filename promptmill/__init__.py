"""Promptmill: document-production pipelines as Spark DataFrame jobs.

Sub-packages
------------
functions   Column builders (text, JSON, hashing, references, templates)
sources     readers and writers (corpora, JSONL, object index, tables)
operators   DataFrame -> DataFrame operators over the pipeline's tables
plans       multi-step batch plans and the catalogue of registered queries
streaming   Structured Streaming forms of the submit / poll / fetch steps
"""

__version__ = "0.1.0"
