"""Operators on DataFrames: retrieval, scoring, comparison, re-ranking, calibration, audits, samples."""
