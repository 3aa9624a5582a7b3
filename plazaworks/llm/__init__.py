"""Preparation of large text corpora."""
