"""Operators of a training-data pipeline: deduplication, decontamination,
language and quality filters, packing and formatting of documents."""
