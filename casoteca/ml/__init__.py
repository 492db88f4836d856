"""Leakage-checked datasets, splits, preprocessing, models and exact evaluation."""
