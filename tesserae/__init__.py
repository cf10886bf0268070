"""Spark jobs for the data work around tissue images: tiles, instances, spatial joins, scores, expression and corpora."""
