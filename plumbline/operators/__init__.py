"""Relational operators: selection, splitting, leakage, validation, metrics, calibration, page plans."""
