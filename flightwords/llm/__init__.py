"""Operators for training-data pipelines: text tables in, decisions and texts out."""
