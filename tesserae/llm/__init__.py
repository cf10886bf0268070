"""Operators for large text corpora: filters, detectors, near-duplicate joins and tokenization as Spark jobs."""
