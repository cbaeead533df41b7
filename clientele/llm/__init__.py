"""Operators of a training-data pipeline, each a module of its own."""
