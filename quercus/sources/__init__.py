"""Readers and writers of datasets, models and results."""
