"""Bulk table maintenance and OCR-result processing as Spark DataFrame jobs."""
