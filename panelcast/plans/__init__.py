"""Operators composed into the end-to-end jobs."""
