"""Whole pipelines: preprocessing variants, the detector, and the report over variants and seeds."""
