"""Operators and the pipeline for training data."""
