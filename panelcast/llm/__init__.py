"""Operators for training-data pipelines: packing, deduplication, decontamination, search, chat and token files."""
